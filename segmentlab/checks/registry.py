"""Register of queries: a name, the DataFrame job and the matching SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from segmentlab.checks.views import Views

MODULES = ["transcripts", "texts", "voices", "detections", "jobs", "ingest", "streams"]
_JOBS: dict[str, Callable[[Views], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(job: Callable[[Views], DataFrame]):
        if name in _JOBS:
            raise ValueError(f"query {name} is registered twice")
        _JOBS[name] = job
        if sql is not None:
            _SQL[name] = sql.strip()
        return job

    return register


def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"segmentlab.checks.{module}")


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()

    def bind(job):
        return lambda spark, sf_dir: job(Views(spark, sf_dir))

    return {name: bind(job) for name, job in _JOBS.items()}


def all_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
