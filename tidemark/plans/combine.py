"""Results kept as handles, and their combination by guarded SQL."""

from __future__ import annotations

import itertools
import re
import threading
import time
import uuid
from collections import OrderedDict
from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.errors import Refused
from tidemark.plans import guard
from tidemark.plans.lineage import check_currency
from tidemark.session import remove, shared_dir, size_of

MAX_HANDLES, MAX_ROWS, PAGE, TTL_S, OWN_HANDLES, SAMPLE, CELL, MAX_COLUMNS = 8, 10_000, 200, 900, 50, 5, 200, 50
#: Stored bytes of one owner's handles together.
OWN_BYTES = 64 << 20
CCY, ORDINAL = "ccy", "_ordinal"


@dataclass(frozen=True)
class Handle:
    """A result: its rows, which columns are amounts and which is their currency, and what it was made from."""

    frame: DataFrame
    amounts: frozenset[str] = frozenset()
    ccy: str | None = None
    truncated: bool = False
    partial: bool = False
    inputs: tuple[str, ...] = ()
    lineage: tuple[str, ...] = ()
    plan: object = None


def of_metric(frame: DataFrame, unit: str, lineage: tuple[str, ...] = (), truncated: bool = False) -> Handle:
    """A metric's result: with an unknown unit beside a currency column, every number is an amount."""
    names = {c.lower(): c for c in frame.columns}
    numeric = {f.name for f in frame.schema if isinstance(f.dataType, T.NumericType)}
    amounts = numeric if CCY in names and not unit else {"value"} & numeric if unit == "amount" else set()
    return Handle(frame, frozenset(amounts), names.get(CCY), truncated, lineage=lineage, plan=f"metric:{','.join(lineage)}")


def column_names(names: list[str]) -> list[str]:
    """Lower case, without outer space, col_<n> for empty ones, _<n> after repeats."""
    out: list[str] = []
    for k, name in enumerate(names):
        base = name.strip().lower() or f"col_{k}"
        made, n = base, 1
        while made in out:
            n += 1
            made = f"{base}_{n}"
        out.append(made)
    return out


def inferred_types(columns: list[str], rows: list[list]) -> T.StructType:
    """The ladder for untyped rows: boolean, long, double, string; all null, mixed, or beyond 64 bits gives string."""

    def kind(values: list) -> T.DataType:
        some = [v for v in values if v is not None]
        if some and all(isinstance(v, bool) for v in some):
            return T.BooleanType()
        if some and all(isinstance(v, int) and not isinstance(v, bool) for v in some):
            return T.LongType() if all(-(2**63) <= v < 2**63 for v in some) else T.StringType()
        if some and all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in some):
            return T.DoubleType()
        return T.StringType()

    return T.StructType([T.StructField(c, kind([r[k] for r in rows])) for k, c in enumerate(columns)])


def load(spark: SparkSession, columns: list[str], rows: list[list]) -> DataFrame:
    """Untyped rows as a table; dates are ISO text, lists and objects JSON text."""
    import json

    schema = inferred_types(column_names(columns), rows)
    text = lambda v: v if v is None or isinstance(v, str) else json.dumps(v) if isinstance(v, (list, dict, bool)) else str(v)
    cast = [text if isinstance(f.dataType, T.StringType) else float if isinstance(f.dataType, T.DoubleType) else (lambda v: v) for f in schema]
    return spark.createDataFrame([tuple(None if v is None else c(v) for c, v in zip(cast, r, strict=True)) for r in rows], schema)


def combine_frames(spark: SparkSession, sql: str, handles: Mapping[str, Handle]) -> Handle:
    """One SELECT over the named handles, in a session that knows nothing else; lazy and whole. A store keeps MAX_ROWS of it, and says so."""
    if not 1 <= len(handles) <= MAX_HANDLES or any(not re.fullmatch(r"[a-z_][a-z0-9_]{0,30}", a) for a in handles):
        raise Refused("invalid_request", f"combine takes 1..{MAX_HANDLES} handles under plain lower-case names")
    text = guard.check(spark, sql, {*handles}, guard.COMBINE, guard.COMBINE_NODES, recursive=False)
    session = spark.newSession()
    for alias, h in handles.items():
        empty = session.createDataFrame([], h.frame.schema)  # the same statement over empty inputs carries the lineage
        empty.createOrReplaceTempView(alias)
    try:
        infos = check_currency(session.sql(text), {a: h.amounts for a, h in handles.items()}, {a: h.ccy for a, h in handles.items()})
    except Refused:
        raise
    except Exception as e:  # noqa: BLE001  analysis errors come over the gateway
        raise Refused("invalid_sql", str(e).strip().splitlines()[0][:300]) from None
    for alias, h in handles.items():
        guard.session_view(session, alias, h.frame)
    made = session.sql(text)
    made = made.toDF(*column_names(made.columns))
    amounts = frozenset(c for c, i in zip(made.columns, infos, strict=True) if i.amount)
    own = [c for c, i in zip(made.columns, infos, strict=True) if i.ccy]
    cut = any(h.truncated or h.partial for h in handles.values())
    return Handle(made, amounts, own[0] if len(own) == 1 else None, cut, cut, tuple(handles), tuple(sorted({x for h in handles.values() for x in h.lineage})), sql)


def storable(frame: DataFrame) -> DataFrame:
    """Under names that differ, with what Parquet has no type for as text."""
    named = frame.toDF(*column_names(frame.columns)) if len({c.lower() for c in frame.columns}) < len(frame.columns) else frame
    odd = (T.NullType, T.DayTimeIntervalType, T.YearMonthIntervalType, T.CalendarIntervalType)
    return named.select(*(F.col(f"`{f.name}`").cast("string").alias(f.name) if isinstance(f.dataType, odd) else F.col(f"`{f.name}`") for f in named.schema))


@dataclass
class Kept:
    """A stored handle: its rows lie in the shared folder under ordinals, so that pages stay as they are whatever executors are lost."""

    until: float
    handle: Handle
    path: str
    size: int


class Store:
    """Handles by owner: read by their owner only, expiring, the owner's oldest going first when they are too many or too large."""

    def __init__(self, ttl_s: float = TTL_S, own: int = OWN_HANDLES, own_bytes: int = OWN_BYTES, clock=time.monotonic):
        self.ttl_s, self.own, self.own_bytes, self.clock, self.lock = ttl_s, own, own_bytes, clock, threading.RLock()
        self.held: OrderedDict[tuple[str, str], Kept] = OrderedDict()

    def put(self, sub: str, handle: Handle, cap: int = MAX_ROWS) -> str:
        """Keeps `cap` rows; more are told by the handle's truncated flag."""
        spark = handle.frame.sparkSession
        name = f"r_{uuid.uuid4().hex[:12]}"
        path = f"{shared_dir(spark)}/tidemark-handles/{uuid.uuid4().hex}"
        # a limit's rows are one partition, so the ids count from 0
        storable(handle.frame).limit(cap + 1).coalesce(1).withColumn(ORDINAL, F.monotonically_increasing_id()).write.parquet(path)
        rows = spark.read.parquet(path)
        over, size = rows.filter(F.col(ORDINAL) >= cap).limit(1).count() > 0, size_of(spark, path)
        if size > self.own_bytes:
            remove(spark, path)
            raise Refused("too_large", f"the result takes {size} bytes, of {self.own_bytes}")
        kept = Kept(0.0, replace(handle, frame=rows.filter(F.col(ORDINAL) < cap), truncated=handle.truncated or over), path, size)
        with self.lock:
            self._expire()
            mine = [k for k in self.held if k[0] == sub]
            while mine and (len(mine) >= self.own or sum(self.held[k].size for k in mine) + size > self.own_bytes):
                self._drop(mine.pop(0))
            kept.until = self.clock() + self.ttl_s
            self.held[sub, name] = kept
        return name

    def _drop(self, key: tuple[str, str]) -> None:
        kept = self.held.pop(key)
        remove(kept.handle.frame.sparkSession, kept.path)

    def _expire(self) -> None:
        for k in [k for k, kept in self.held.items() if kept.until <= self.clock()]:
            self._drop(k)

    def _stored(self, sub: str, name: str) -> Handle:
        with self.lock:
            self._expire()
            if (sub, name) not in self.held:
                raise Refused("unknown_handle", f"no result {str(name)[:40]!r}")
            self.held.move_to_end((sub, name))
            return self.held[sub, name].handle

    def get(self, sub: str, name: str) -> Handle:
        h = self._stored(sub, name)
        return replace(h, frame=h.frame.drop(ORDINAL))

    def page(self, sub: str, name: str, offset: int = 0, limit: int = PAGE) -> dict:
        if not (isinstance(offset, int) and offset >= 0 and isinstance(limit, int) and 1 <= limit <= PAGE):
            raise Refused("invalid_request", f"offset is 0 or more, limit 1..{PAGE}")
        rows = self._stored(sub, name).frame
        found = rows.filter(F.col(ORDINAL).between(offset, offset + limit - 1)).orderBy(ORDINAL).drop(ORDINAL)
        return {"columns": found.columns, "rows": [list(r) for r in found.collect()], "offset": offset}

    def summary(self, sub: str, name: str) -> dict:
        h = self.get(sub, name)
        shown = h.frame.columns[:MAX_COLUMNS]
        cut = lambda v: v[:CELL] if isinstance(v, str) else v
        first = self._stored(sub, name).frame.filter(F.col(ORDINAL) < SAMPLE).orderBy(ORDINAL)
        rows = [[cut(v) for v in r] for r in first.select(*(f"`{c}`" for c in shown)).collect()]
        return {"handle": name, "columns": shown, "sample": rows, "truncated": h.truncated, "partial": h.partial}

    def combine(self, sub: str, sql: str, handles: Mapping[str, str]) -> str:
        held = {a: self.get(sub, n) for a, n in handles.items()}
        if not held:
            raise Refused("invalid_request", f"combine takes 1..{MAX_HANDLES} handles")
        made = combine_frames(next(iter(held.values())).frame.sparkSession, sql, held)
        return self.put(sub, replace(made, inputs=tuple(handles.values())))

    def metric_backed(self, sub: str, name: str, depth: int = 8) -> bool:
        """Is a result a metric's, or made of such alone, through all its inputs?"""
        h = self.get(sub, name)
        if not h.inputs:
            return isinstance(h.plan, str) and h.plan.startswith("metric:")
        return depth > 0 and all(self.metric_backed(sub, i, depth - 1) for i in h.inputs)

    def lineage(self, sub: str, name: str, most: int = 64) -> list[str]:
        return list(itertools.islice(dict.fromkeys(self.get(sub, name).lineage), most))


def jsonable(value: object) -> object:
    """A cell as JSON can hold it: decimals as numbers, dates as ISO text, NaN and infinities as text, bytes as text."""
    import datetime
    import decimal
    import math

    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float) and not math.isfinite(value):
        return "NaN" if math.isnan(value) else "Infinity" if value > 0 else "-Infinity"
    if isinstance(value, (datetime.date, datetime.datetime, datetime.time)):
        return value.isoformat()
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).decode("utf-8", "replace")
    if isinstance(value, dict):
        return {str(k): jsonable(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [jsonable(v) for v in value]
    return value if value is None or isinstance(value, (bool, int, float, str)) else str(value)
