"""List and summary endpoints: parameterised reads with typed filters, stable order and pages."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.errors import Refused
from tidemark.plans.metrics import coerce

MAX_PAGE, MAX_NAMES = 500, 20


def text_like(column: str, text: str) -> Column:
    """Contains, whatever the case; %, _ and \\ in the text stand for themselves."""
    return F.col(column).ilike("%" + re.sub(r"([\\%_])", r"\\\1", text) + "%")


def conditions(filters: Mapping[str, object]) -> Column:
    """A scalar is equality, null is no filter; gte, lte, lt, like; day_lte: a timestamp up to the end of a day."""
    out = F.lit(True)
    for column, spec in filters.items():
        for op, value in (spec if isinstance(spec, Mapping) else {"eq": spec}).items():
            if value is not None:
                c, v = F.col(column), F.lit(value)
                out = out & {"eq": lambda c=c, v=v: c == v, "gte": lambda c=c, v=v: c >= v, "lte": lambda c=c, v=v: c <= v, "lt": lambda c=c, v=v: c < v, "like": lambda column=column, value=value: text_like(column, value), "day_lte": lambda c=c, v=v: c < F.date_add(v, 1)}[op]()
    return out


def check_range(start: date | None, end: date | None) -> None:
    if start and end and start > end:
        raise Refused("invalid_request", "the range ends before it starts")


def listing(df: DataFrame, columns: list[str], filters: Mapping[str, object], order: list[str], limit: int | None = 100, offset: int = 0, extra: int = 0) -> DataFrame:
    """A page in a stable order, and `extra` rows after it; limit None: all rows, in no order."""
    found = df.filter(conditions(filters)).select(*columns, *(F.col(c) for c in order if c not in columns))
    if limit is not None:
        found = found.orderBy(*order).offset(offset).limit(min(limit, MAX_PAGE) + extra)
    return found.select(*columns)


def page(df: DataFrame, limit: int, offset: int) -> dict:
    """df has one row more than the page where there are more; they are told, not shown."""
    rows = [r.asDict() for r in df.collect()]
    items = rows[:limit]
    return {"items": items, "count": len(items), "limit": limit, "offset": offset, "truncated": len(rows) > limit}


def summary(df: DataFrame, by: list[str], limit: int | None = MAX_PAGE, open_if: str | None = None) -> DataFrame:
    """Counts by the named columns (each once, in the order given), largest first; open_if adds open_count."""
    names = [*dict.fromkeys(by)]
    if not names:
        raise Refused("invalid_request", "group by one column or more")
    made = df.groupBy(*names).agg(*([F.count_if(F.expr(open_if)).alias("open_count")] if open_if else []), F.count(F.lit(1)).alias("total" if open_if else "n"))
    return made if limit is None else made.orderBy(F.col("total" if open_if else "n").desc(), *names).limit(limit)


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, as one aggregation (no sort, combined before the shuffle)."""
    rest = [c for c in df.columns if c not in keys]
    row = F.max_by(F.struct(*rest), F.struct(*order)).alias("row")
    return df.groupBy(*keys).agg(row).select(*keys, *(F.col(f"row.{c}").alias(c) for c in rest))


@dataclass(frozen=True)
class Param:
    kind: str = "str"  # str, int, date or str_list
    required: bool = False
    choices: tuple[str, ...] = ()
    least: int | None = None
    most: int | None = None
    pattern: str = ""


@dataclass(frozen=True)
class Endpoint:
    """A named read: the table, what it returns, and how its parameters filter it."""

    path: str
    table: str
    columns: tuple[str, ...] = ()
    order: tuple[str, ...] = ()
    params: Mapping[str, Param] = field(default_factory=dict)
    filters: Mapping[str, tuple[str, str]] = field(default_factory=dict)  # parameter to (column, operator)
    base: str = ""
    group: tuple[str, ...] = ()  # the default groups of a summary
    groups: tuple[str, ...] = ()  # those that a caller may name
    open_if: str = ""

    def page(self, df: DataFrame, asked: Mapping[str, object] | None = None, limit: int | None = None, offset: int = 0) -> dict:
        """The page as an answer: items, and whether more were cut off. A summary is one page of MAX_PAGE groups."""
        limit = MAX_PAGE if self.group else min(limit or 100, MAX_PAGE)
        return page(self.run(df, asked, limit, offset, 1), limit, offset)

    def run(self, df: DataFrame, asked: Mapping[str, object] | None = None, limit: int = 100, offset: int = 0, extra: int = 0) -> DataFrame:
        given = validate(self.params, asked or {})
        by: dict[str, dict] = {}
        for name, value in given.items():
            if name in self.filters:
                column, op = self.filters[name]
                by.setdefault(column, {})[op] = value
        df = df.filter(F.expr(self.base)) if self.base else df
        if self.group:
            names = list(given.get("group_by") or self.group)
            if unknown := [n for n in names if n not in (self.groups or self.group)]:
                raise Refused("invalid_request", f"group_by takes {sorted(self.groups or self.group)}, not {unknown}")
            return summary(df.filter(conditions(by)), names, MAX_PAGE + extra, self.open_if or None)
        return listing(df, list(self.columns or df.columns), by, list(self.order), limit, offset, extra)


def validate(params: Mapping[str, Param], asked: Mapping[str, object]) -> dict[str, object]:
    """Declared parameters only, each of its kind and within its bounds."""
    if unknown := {*asked} - {*params}:
        raise Refused("invalid_request", f"unknown parameters {sorted(unknown)[:5]}")
    out = {}
    for name, p in params.items():
        value = asked.get(name)
        if value is None:
            if p.required:
                raise Refused("invalid_request", f"parameter {name} is missing")
            continue
        if p.kind == "str_list":
            value = [coerce(v, "str") for v in (value if isinstance(value, (list, tuple)) else [value])]
            if not value or len(value) > MAX_NAMES or len({*value}) < len(value):
                raise Refused("invalid_request", f"parameter {name} takes 1..{MAX_NAMES} different names")
        else:
            value = coerce(value, p.kind)
        if (p.choices and value not in p.choices) or (p.least is not None and value < p.least) or (p.most is not None and value > p.most) or (p.pattern and not re.fullmatch(p.pattern, str(value))):
            raise Refused("invalid_request", f"parameter {name} is out of its bounds")
        out[name] = value
    check_range(out.get("from"), out.get("to"))
    return out


_D, _L = Param("date"), Param("str_list")
_RANGE = {"from": _D, "to": _D}


def _e(path: str, table: str, order: str = "", names: str = "", ranged: str = "", like: str = "", ends: str = "lte", **more: object) -> tuple[str, Endpoint]:
    names_ = names.split()
    params = {n: Param() for n in names_} | ({like: Param()} if like else {}) | (_RANGE if ranged else {}) | ({"group_by": _L} if "group" in more else {})
    filters = {n: (n, "eq") for n in names_} | ({like: (like, "like")} if like else {}) | ({"from": (ranged, "gte"), "to": (ranged, ends)} if ranged else {})
    more = {k: tuple(v.split()) if k in ("group", "groups", "columns") else v for k, v in more.items()}
    return path, Endpoint(path, table, order=tuple(order.split()), params=params, filters=filters, **more)


# Paths, tables, filters and orders of the nineteen endpoints.
REFMASTER = dict([
    _e("/securities", "securities", "security_id", "asset_class ccy country status", like="name"), _e("/securities/{id}", "securities", "security_id", "security_id"), _e("/entities", "legal_entities", "entity_id", "country sector", like="name"),
    _e("/accounts", "accounts", "account_id", "region lifecycle_state product_id"), _e("/corporate-actions", "corporate_actions", "ex_date ca_id", "security_id event_type status", "ex_date"),
    _e("/corporate-actions/pending/summary", "corporate_actions", names="security_id event_type", ranged="ex_date", base="status = 'pending'", group="event_type", groups="security_id event_type ex_date"),
    _e("/exceptions", "exceptions", "opened_at exc_id", "domain asset_class status", "opened_at", ends="day_lte"),
    _e("/exceptions/summary", "exceptions", names="domain asset_class status", ranged="opened_at", ends="day_lte", group="domain asset_class", groups="domain asset_class status rule_id record_ref", open_if="status <> 'closed'"), _e("/data-dictionary", "data_dictionary", "domain attribute", "domain"),
])
MARKETMASTER = dict([
    _e("/vendors", "vendors", "rank_default vendor_id"), _e("/instruments", "instruments", "security_id", "asset_class", like="name"), _e("/instruments/{id}/timeseries", "golden_prices", "price_date", "security_id", "price_date"),
    _e("/prices/conflicts", "price_suspects", "price_date suspect_id", "vendor_id asset_class status", "price_date", base="kind = 'conflict'"), _e("/prices/conflicts/summary", "price_suspects", names="vendor_id asset_class status", ranged="price_date", base="kind = 'conflict'", group="vendor_id asset_class", groups="vendor_id asset_class price_date status"),
    _e("/prices/suspects/summary", "price_suspects", names="kind vendor_id asset_class status", ranged="price_date", group="kind", groups="kind vendor_id asset_class price_date status security_id"), _e("/prices/suspects", "price_suspects", "price_date suspect_id", "kind vendor_id asset_class status", "price_date"),
    _e("/golden-copy/{id}", "golden_prices", "price_date", "security_id", "price_date"), _e("/dq/metrics", "dq_stage_metrics", "business_date domain stage", "domain stage", "business_date"), _e("/esg/{entity}", "esg_scores", "as_of provider", "entity_id"),
])


def golden_copy(golden: DataFrame, quotes: DataFrame, security_id: str, day: date | None = None, with_quotes: bool = True) -> DataFrame:
    """A security's golden price of a day, the latest by default, with that day's vendor quotes where the caller may see them."""
    own = golden.filter(F.col("security_id") == security_id)
    own = own.filter(F.col("price_date") == day) if day else own
    best = latest(own, ["security_id"], ["price_date"]).select("security_id", "price_date", F.col("value").alias("golden"))
    if not with_quotes:
        return best
    return best.join(quotes.select("security_id", "price_date", "vendor_id", F.col("value").alias("quote")), ["security_id", "price_date"], "left").orderBy("vendor_id")
