"""The engine's calls: describe, run_metric, query, combine, get_rows, lineage, context."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidemark.errors import Refused
from tidemark.functions.text import judged_question
from tidemark.operators import context
from tidemark.plans import guard
from tidemark.plans.catalog import METRICS
from tidemark.plans.combine import Handle, Store, jsonable, of_metric
from tidemark.plans.metrics import MAX_ROWS, Metric, compile_metric
from tidemark.plans.policy import Policy
from tidemark.plans.security import MASKED, ROW_SCOPES, Claims, secure, secured_views
from tidemark.session import cut as settled
from tidemark.streaming.admission import Admission, within

SQL_ROWS, SQL_BYTES, SQL_SECONDS, CONTEXT_SECONDS = 500, 1_000_000, 30, 120


class Engine:
    """read(source, table) gives a table's DataFrame or None; everything else goes through the caller's claims."""

    def __init__(self, spark: SparkSession, read: Callable[[str, str], DataFrame | None], metrics: Mapping[str, Metric] | None = None, as_of: date | None = None, graph: tuple[DataFrame, DataFrame] | None = None, admission: Admission | None = None, sql_seconds: float = SQL_SECONDS):
        self.sql_seconds = sql_seconds
        self.spark, self.read, self.as_of, self.graph, self.admission = spark, read, as_of or date.today(), graph, admission or Admission(16, 3, 32)
        self.policy, self.store = Policy(METRICS if metrics is None else metrics), Store()

    def _secured(self, claims: Claims, source: str) -> Callable[[str], DataFrame]:
        def table(name: str) -> DataFrame:
            df = self.read(source, name)
            if df is None:
                raise Refused("source_unavailable", f"{source}.{name} can't be read")
            return secure(df, claims, source, name, ROW_SCOPES.get(source, {}).get(name), MASKED.get((source, name)))

        return table

    def describe(self, claims: Claims, source: str) -> dict:
        return self.policy.describe(claims, source)

    def metric(self, claims: Claims, metric_id: str, dimensions: list[str] = (), filters: Mapping | None = None, limit: int | None = None, **asked: object) -> Handle:
        """A lazy, checked metric with one row more than its limit."""
        plan = self.policy.check_metric(claims, metric_id, dimensions, filters, limit)
        m = plan.metric
        df = compile_metric(m, self._secured(claims, m.source), list(plan.dimensions), plan.filters, as_of=self.as_of, limit=limit or 100, extra=1, **asked)
        return of_metric(df, m.unit or ("amount" if m.type in ("sum", "max", "min") and "ccy" in m.dimensions else "count"), (m.id,))

    def run_metric(self, claims: Claims, metric_id: str, *args: object, limit: int | None = None, **asked: object) -> dict:
        """Stores the result and returns its summary."""
        handle = self.metric(claims, metric_id, *args, limit=limit, **asked)
        name = self.store.put(claims.sub, handle, min(limit or 100, MAX_ROWS))
        return self.store.summary(claims.sub, name)


    def query(self, claims: Claims, source: str, sql: str) -> dict:
        """Free SQL on one source: guarded, over the caller's secured views of the tables that it names, within rows, bytes and time.

        A row-scoped table of which the caller has a part is settled first, that part alone, so that no expression of the caller meets other rows.
        """
        self.policy.check_query(claims, source)
        allowed = {t for t in ROW_SCOPES[source] if claims.can(source, t)}
        text, named = guard.check(self.spark, sql, allowed), guard.relations(self.spark, sql, allowed)
        session = secured_views(self.spark, claims, source, lambda t: self._settled(self.read(source, t), claims, source, t) if t in named else None)

        def fetch() -> tuple[DataFrame, list, bool]:
            df = session.sql(text).limit(SQL_ROWS + 1)
            rows, size = [], 0
            for r in df.toLocalIterator():
                size += len(json.dumps([jsonable(v) for v in r], default=str))
                if size > SQL_BYTES and not rows:
                    raise Refused("too_large", "one row is larger than the result may be")
                if size > SQL_BYTES or len(rows) >= SQL_ROWS:
                    return df, rows, True
                rows.append(tuple(r))
            return df, rows, False

        try:
            with self.admission.admitted(claims.sub):
                df, rows, cut = within(session, self.sql_seconds, fetch, claims.sub)
        except Refused:
            raise
        except Exception as e:  # noqa: BLE001  the engine's own errors, without its internals
            raise Refused("query_failed", str(e).strip().splitlines()[0][:200]) from None
        made = self.spark.createDataFrame(rows, T.StructType([T.StructField(f.name, f.dataType) for f in df.schema]))
        name = self.store.put(claims.sub, Handle(made, truncated=cut, lineage=(source,), plan=text), SQL_ROWS)
        return self.store.summary(claims.sub, name)

    def _settled(self, df: DataFrame | None, claims: Claims, source: str, table: str) -> DataFrame | None:
        dimension = ROW_SCOPES[source][table]
        if df is None or dimension is None or "*" in claims.allowed(dimension):
            return df
        return settled(secure(df, claims, source, table, dimension))

    def combine(self, claims: Claims, sql: str, handles: Mapping[str, str]) -> dict:
        with self.admission.admitted(claims.sub):
            name = within(self.spark, self.sql_seconds, lambda: self.store.combine(claims.sub, sql, handles), claims.sub)
        return self.store.summary(claims.sub, name)

    def get_rows(self, claims: Claims, handle: str, offset: int = 0, limit: int = 200) -> dict:
        got = self.store.page(claims.sub, handle, offset, limit)
        return got | {"rows": [[jsonable(v) for v in r] for r in got["rows"]]}

    def context(self, claims: Claims, question: str, vectors: DataFrame | None = None, asked: DataFrame | None = None) -> dict[str, list]:
        """What this caller should know to answer a question; see operators.context. vectors: uid, embedding; asked: the question's own."""
        if self.graph is None:
            raise Refused("no_graph", "this engine has no context graph")
        text, why = judged_question(question)
        if text is None:
            raise Refused("invalid_request", f"the question can't be used: {why}")
        nodes, edges = self.graph
        with self.admission.admitted(claims.sub):
            return within(self.spark, CONTEXT_SECONDS, lambda: context.pack(nodes, edges, context.scopes_of(claims), text, claims.metrics_only, vectors, asked), claims.sub)

    def lineage(self, claims: Claims, handle: str) -> list[str]:
        return self.store.lineage(claims.sub, handle)
