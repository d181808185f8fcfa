"""Shaping of results: pivots, top rows, comparisons, dashboards' replay and KPI tiles."""

from __future__ import annotations

import json
import math
import threading
import time
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.errors import Refused

MAX_DEPTH, MAX_NODES, MAX_WIDGETS, KPI_TTL_S, MAX_TILES = 3, 8, 8, 60, 4


def pivot(df: DataFrame, x: str, series: str, y: str, names: Mapping[str, str] | None = None) -> DataFrame:
    """A column for each series, duplicates summed, missing ones null. Named series save a pass over the data to find them."""
    made = df.groupBy(x).pivot(series, list(names) if names else None).agg(F.sum(y))
    return made.select(x, *(F.col(f"`{k}`").alias(v) for k, v in names.items())) if names else made


def heatmap(df: DataFrame, z: str) -> DataFrame:
    """Cells with the range of all; the range is one aggregate row, not a window over all rows."""
    span = df.agg(F.min(z).alias("low"), F.max(z).alias("high"))
    return df.crossJoin(F.broadcast(span))  # one row


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """Spark prunes each task to n rows a group before the shuffle (window group limit)."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def nearest_rank(df: DataFrame, keys: list[str], value: str, shares: Mapping[str, float]) -> DataFrame:
    """Nearest-rank percentiles: the element at ceil(share * n) of the sorted values."""
    return df.groupBy(*keys).agg(*(F.expr(f"percentile_disc({p}) within group (order by {value})").alias(k) for k, p in shares.items()))


def nearest_rank_of(values: list[float], share: float) -> float | None:
    some = sorted(values)
    return some[max(0, math.ceil(share * len(some)) - 1)] if some else None


def rows_compared(want: DataFrame, got: DataFrame, keys: list[str], values: list[str], relative: float = 1e-6) -> DataFrame:
    """Rows paired within a key in order of their values; same: both there, every value equal within the relative tolerance."""
    number = lambda df: df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*values)))
    a = number(want).select(*keys, "_n", *(F.col(v).alias(f"want_{v}") for v in values), F.lit(True).alias("_a"))
    b = number(got).select(*keys, "_n", *(F.col(v).alias(f"got_{v}") for v in values), F.lit(True).alias("_b"))
    same = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    for v in values:
        w, g = F.col(f"want_{v}"), F.col(f"got_{v}")
        same = same & F.coalesce(F.abs(w - g) <= relative * F.greatest(F.abs(w), F.abs(g)), w.isNull() & g.isNull())
    return a.join(b, [*keys, "_n"], "full_outer").withColumn("same", same).drop("_a", "_b", "_n")


def rows_match(want: DataFrame, got: DataFrame, keys: list[str], values: list[str], relative: float = 1e-6) -> bool:
    return rows_compared(want, got, keys, values, relative).filter("not same").limit(1).count() == 0


def story_holds(df: DataFrame, top: tuple[str, str, object] | None = None, contains: tuple[str, object] | None = None, count: int | None = None) -> bool:
    """top: (label, value, expected label of the largest value); contains: (column, value); count: rows."""
    if top and (not (row := df.orderBy(F.col(top[1]).desc_nulls_last()).select(top[0]).first()) or row[0] != top[2]):
        return False
    if contains and df.filter(F.col(contains[0]) == F.lit(contains[1])).limit(1).count() == 0:
        return False
    return count is None or df.count() == count


def source_usage(df: DataFrame, source: str, access: str) -> DataFrame:
    return df.groupBy(source).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set(access)), ",").alias("access"))


def cost(df: DataFrame, model: str, tokens: str, prices: Mapping[str, float]) -> DataFrame:
    """Cost by model; null, not left out, where a model has no price."""
    price = F.create_map(*(x for k, v in prices.items() for x in (F.lit(k), F.lit(v))))
    spent = (F.col(tokens) * F.try_element_at(price, F.col(model))).cast("decimal(20,4)")
    return df.groupBy(model).agg(F.sum(spent).cast("double").alias("cost"))


# ---- replay ----


def check_recipe(recipe: Mapping, depth: int = 1) -> int:
    """Nodes of a recipe tree: run_metric, query_source or combine(inputs)."""
    kind = recipe.get("kind")
    if kind not in ("run_metric", "query_source", "combine") or depth > MAX_DEPTH:
        raise Refused("invalid_request", "a recipe is a tree of run_metric, query_source and combine, three deep at most")
    total = 1 + sum(check_recipe(r, depth + 1) for r in recipe.get("inputs", {}).values())
    if total > MAX_NODES or (kind == "combine") != bool(recipe.get("inputs")):
        raise Refused("invalid_request", f"a recipe has {MAX_NODES} nodes at most, and inputs for combine alone")
    return total


class Replayer:
    """Builds a recipe's frames bottom-up with today's claims; equal parts, by canonical JSON, are built once."""

    def __init__(self, builders: Mapping[str, Callable[[Mapping, dict], object]]):
        self.builders, self.made = builders, {}

    def run(self, recipe: Mapping) -> object:
        check_recipe(recipe)
        return self._node(recipe)

    def _node(self, recipe: Mapping) -> object:
        key = json.dumps(recipe, sort_keys=True, default=str)
        if key not in self.made:
            inputs = {k: self._node(r) for k, r in recipe.get("inputs", {}).items()}
            self.made[key] = self.builders[recipe["kind"]](recipe, inputs)
        return self.made[key]

    def dashboard(self, items: list[Mapping]) -> list[dict]:
        """A status for each widget; one that is refused doesn't stop the others."""
        if not 1 <= len(items) <= MAX_WIDGETS:
            raise Refused("invalid_request", f"a dashboard has 1..{MAX_WIDGETS} widgets")
        out = []
        for item in items:
            try:
                out.append({"status": "ok", "result": self.run(item)})
            except Refused as e:
                out.append({"status": "error", "code": e.code})
        return out


class Tiles:
    """KPI tiles by role: each the first row's last column, scaled; kept for a minute for equal roles and scopes."""

    def __init__(self, compute: Callable[[str], DataFrame], clock=time.monotonic):
        self.compute, self.clock, self.held, self.lock = compute, clock, {}, threading.Lock()

    def tiles(self, role: str, scopes: frozenset[str], wanted: list[tuple[str, float]]) -> list[dict]:
        key = role, scopes, tuple(wanted[:MAX_TILES])
        with self.lock:
            if key in self.held and self.held[key][0] > self.clock():
                return self.held[key][1]
        out = []
        for metric, scale in wanted[:MAX_TILES]:
            try:
                row = self.compute(metric).limit(1).first()
                out.append({"metric": metric, "value": None if row is None or row[-1] is None else float(row[-1]) * scale})
            except Refused as e:
                out.append({"metric": metric, "error": e.code})
        with self.lock:
            self.held[key] = self.clock() + KPI_TTL_S, out
        return out
