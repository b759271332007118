"""Jobs put together from the operators, and the registry of named queries."""

from corpusql.plans import corpus_queries, eval_queries, sql_queries  # noqa: F401
from corpusql.plans.registry import all_oracles, all_queries

__all__ = ["all_oracles", "all_queries"]
