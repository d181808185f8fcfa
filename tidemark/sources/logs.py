"""Append-only logs on Parquet: audit rows, the query log with confirmations, saved dashboards, run traces."""

from __future__ import annotations

import json
import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.errors import Refused

IDENT, MAX_LIST, MAX_SUB, MAX_DASHBOARDS, TRACE_TTL_S = re.compile(r"[A-Za-z0-9_.:@+-]{1,256}"), 20, 256, 20, 30 * 86400


class Log:
    """A folder that only grows; one append a batch of events."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, T.StructType.fromDDL(schema)

    def append(self, *events: dict) -> None:
        rows = [tuple(e.get(f.name) for f in self.schema) for e in events]
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.schema).parquet(self.path)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], self.schema)
            raise


def valid_caller(sub: object) -> bool:
    return isinstance(sub, str) and IDENT.fullmatch(sub) is not None


class Audit:
    """Exactly one sanitised row a call: names outside the allowed letters and odd numbers become null."""

    def __init__(self, spark: SparkSession, path: str):
        self.log = Log(spark, path, "ts double, sub string, tool string, source string, metric_ids array<string>, rows long, handle string, error_code string")

    def write(self, event: dict) -> dict:
        name = lambda v: v if isinstance(v, str) and IDENT.fullmatch(v) else None
        rows = event.get("rows")
        clean = {
            "ts": time.time(), "sub": event.get("sub") if isinstance(event.get("sub"), str) and 0 < len(event["sub"]) <= MAX_SUB else None, "tool": name(event.get("tool")), "source": name(event.get("source")),
            "metric_ids": [m for m in (event.get("metric_ids") or [])[:MAX_LIST] if name(m)], "rows": rows if isinstance(rows, int) and not isinstance(rows, bool) and rows >= 0 else None, "handle": name(event.get("handle")), "error_code": name(event.get("error_code")),
        }
        self.log.append(clean)
        return clean


class QueryLog:
    """Answers by question; a confirmation is a later row of the same record, and the latest row counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.log = Log(spark, path, "ts double, record_id string, sub string, question string, plan string, metric_ids array<string>, metric_backed boolean, status string, verified boolean")

    def record(self, sub: str, question: str, plan: object, metric_ids: list[str], metric_backed: bool, status: str = "ok") -> str:
        id_ = uuid.uuid4().hex
        self.log.append({"ts": time.time(), "record_id": id_, "sub": sub, "question": question, "plan": json.dumps(plan, sort_keys=True), "metric_ids": metric_ids, "metric_backed": metric_backed, "status": status, "verified": False})
        return id_

    def current(self) -> DataFrame:
        w = Window.partitionBy("record_id").orderBy(F.col("ts").desc(), F.col("verified").desc())
        return self.log.read().withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")

    def confirm(self, sub: str, record_id: str) -> bool:
        """Only the caller's own, metric-backed, successful answers."""
        row = self.current().filter((F.col("record_id") == record_id) & (F.col("sub") == sub) & F.col("metric_backed") & (F.col("status") == "ok")).first()
        if row is not None:
            self.log.append(row.asDict() | {"ts": time.time(), "verified": True})
        return row is not None

    def history(self, sub: str, limit: int) -> DataFrame:
        return self.current().filter(F.col("sub") == sub).orderBy(F.col("ts").desc(), F.col("record_id").desc()).limit(limit)


class Dashboards:
    """Saved dashboards by owner; a deletion is a row too."""

    def __init__(self, spark: SparkSession, path: str):
        self.log = Log(spark, path, "ts double, id string, sub string, title string, items string, deleted boolean")

    def _mine(self, sub: str) -> DataFrame:
        w = Window.partitionBy("id").orderBy(F.col("ts").desc(), F.col("deleted").desc())
        return self.log.read().filter(F.col("sub") == sub).withColumn("_n", F.row_number().over(w)).filter("_n = 1 and not deleted").drop("_n")

    def list(self, sub: str) -> DataFrame:
        return self._mine(sub).select("id", "title", F.json_array_length("items").alias("widgets"), "ts").orderBy(F.col("ts").desc(), "id")

    def create(self, sub: str, title: str, items: list[dict]) -> str:
        if self._mine(sub).count() >= MAX_DASHBOARDS:
            raise Refused("quota", f"{MAX_DASHBOARDS} dashboards at most")
        id_ = uuid.uuid4().hex
        self.log.append({"ts": time.time(), "id": id_, "sub": sub, "title": title, "items": json.dumps(items), "deleted": False})
        return id_

    def get(self, sub: str, id_: str) -> dict | None:
        row = self._mine(sub).filter(F.col("id") == id_).first()
        return row and {"id": row.id, "title": row.title, "items": json.loads(row["items"])}

    def delete(self, sub: str, id_: str) -> bool:
        row = self._mine(sub).filter(F.col("id") == id_).first()
        if row is not None:
            self.log.append(row.asDict() | {"ts": time.time(), "deleted": True})
        return row is not None


class Traces:
    """How a run reached its answer: ordered steps, read by their owner until they expire, touching only what the reader sees today."""

    def __init__(self, spark: SparkSession, path: str, clock=time.time):
        self.log = Log(spark, path, "ts double, run_id string, sub string, question string, expires double, steps array<struct<seq:int,kind:string,label:string,tool:string,touched:array<string>>>")
        self.clock = clock

    def record(self, sub: str, run_id: str, question: str, steps: list[dict]) -> None:
        held = self.log.read().filter(F.col("run_id") == run_id).select("sub").first()
        if held is not None and held.sub != sub:
            raise Refused("not_permitted", "this run belongs to another caller")
        rows = [(k, s.get("kind"), s.get("label"), s.get("tool"), s.get("touched", [])) for k, s in enumerate(steps)]
        self.log.append({"ts": self.clock(), "run_id": run_id, "sub": sub, "question": question, "expires": self.clock() + TRACE_TTL_S, "steps": rows})

    def get(self, sub: str, run_id: str, visible: DataFrame) -> DataFrame:
        """(seq, kind, label, tool, touched), touched limited to uids in visible."""
        last = self.log.read().filter((F.col("run_id") == run_id) & (F.col("sub") == sub) & (F.col("expires") >= self.clock())).orderBy(F.col("ts").desc()).limit(1)
        steps = last.select(F.explode("steps").alias("s")).select("s.*")
        seen = steps.select("seq", F.explode("touched").alias("uid")).join(visible.select("uid"), "uid", "left_semi").groupBy("seq").agg(F.array_sort(F.collect_list("uid")).alias("touched"))
        return steps.drop("touched").join(seen, "seq", "left").withColumn("touched", F.coalesce("touched", F.array().cast("array<string>"))).orderBy("seq")
