"""Queries over the relational tables and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import guard
from tidemark.plans.combine import Handle, combine_frames
from tidemark.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """The tables of one folder, by attribute, and SQL over those that a query names."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    def sql(self, text: str, *names: str, **args: object) -> DataFrame:
        """Named tables become parameters of the statement; nothing is registered in the caller's session."""
        return self.spark.sql(text, args=args or None, **{n: getattr(self, n) for n in names})

    def guarded(self, text: str, *names: str) -> DataFrame:
        """The engine's own way for free SQL: checked against the named tables, run in a session that holds views of these and nothing else."""
        session = self.spark.newSession()
        for n in names:
            guard.session_view(session, n, getattr(self, n))
        return session.sql(guard.check(session, text, {*names}))

    def combined(self, text: str, **results: DataFrame | Handle) -> DataFrame:
        """The engine's own way to combine results: guarded, and checked for mixed currencies."""
        held = {k: r if isinstance(r, Handle) else Handle(r) for k, r in results.items()}
        return combine_frames(self.spark, text, held).frame


def query(sql: str | None = None):
    """Register the decorated function of Tables under its name, with its oracle."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


from tidemark.operators import dataflow_queries, engine_queries, graph_queries, metric_queries, sql_queries  # noqa: E402, F401  they register themselves
