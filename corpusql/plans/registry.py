"""Named queries: a Spark job each, with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusql.plans.views import VIEWS, Inputs, with_views

_JOBS: dict[str, Callable[[Inputs], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def named(name: str, oracle: str | None = None) -> Callable:
    """Register a job. Views named in the oracle are defined in front of it."""

    def register(job: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
        if name in _JOBS:
            raise ValueError(f"{name} is registered twice")
        _JOBS[name] = job
        if oracle:
            _ORACLES[name] = with_views(oracle, [v for v in VIEWS if v in oracle])
        return job

    return register


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(job):
        return lambda spark, folder: job(Inputs(spark, folder))

    return {name: bind(job) for name, job in _JOBS.items()}


def all_oracles() -> dict[str, str]:
    return dict(_ORACLES)
