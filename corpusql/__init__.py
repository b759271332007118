"""corpusql: Spark jobs over question/SQL corpora and the query logs around them."""

from corpusql.session import build_session

__all__ = ["build_session"]
