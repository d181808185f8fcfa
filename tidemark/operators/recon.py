"""Reconciliation and data-quality dataflows, each a lazy DataFrame over the inputs it names."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import cut


def business_days(spark: SparkSession, n: int, as_of: date) -> DataFrame:
    """(day, ordinal): the last n weekdays that end at as_of; ordinal 1 is the last."""
    days = spark.range(1).select(F.explode(F.sequence(F.date_sub(F.lit(as_of), n * 7 // 5 + 7), F.lit(as_of))).alias("day")).filter("dayofweek(day) not in (1, 7)")
    return days.withColumn("ordinal", F.row_number().over(Window.orderBy(F.col("day").desc())).cast("long")).filter(F.col("ordinal") <= n)  # a row a day


def basis_points(own: Column, other: Column, digits: int = 3) -> Column:
    return F.round(F.try_divide((own - other).cast("double"), other.cast("double")) * 10_000, digits)


def net_asset_values(positions: DataFrame, prices: DataFrame, keys: list[str]) -> DataFrame:
    """Per portfolio and day: value at golden and at true prices, and the difference in basis points."""
    priced = positions.join(prices, ["security_id", "price_date"])
    total = priced.groupBy(*keys).agg(F.sum(F.col("qty") * F.col("golden")).alias("internal"), F.sum(F.col("qty") * F.col("true")).alias("admin"))
    return total.withColumn("diff_bps", basis_points(F.col("internal"), F.col("admin")))


def reconcile(left: DataFrame, right: DataFrame, keys: list[str], amounts: list[str], tolerance: float = 0.0) -> DataFrame:
    """Full outer by key: each amount's difference (missing counts as 0), and matched, missing_left, missing_right or difference."""
    a = left.select(*keys, *(F.col(c).alias(f"left_{c}") for c in amounts), F.lit(True).alias("in_left"))
    b = right.select(*keys, *(F.col(c).alias(f"right_{c}") for c in amounts), F.lit(True).alias("in_right"))
    diff = {c: F.coalesce(f"left_{c}", F.lit(0)) - F.coalesce(f"right_{c}", F.lit(0)) for c in amounts}
    off = F.lit(False)
    for d in diff.values():
        off = off | (F.abs(d) > tolerance)
    status = F.when(F.col("in_left").isNull(), "missing_left").when(F.col("in_right").isNull(), "missing_right").when(off, "difference").otherwise("matched")
    return a.join(b, keys, "full_outer").select(*keys, *(d.alias(f"diff_{c}") for c, d in diff.items()), status.alias("outcome"))


def match_outcomes(ledger: DataFrame, statement: DataFrame, key: str, amount: str, day: str, tolerance: float = 0.0, days: int = 0) -> DataFrame:
    """Cash matching on a reference: matched, missing_statement, missing_ledger, amount_diff or date_diff."""
    a = ledger.select(key, F.col(amount).alias("ledger_amount"), F.col(day).alias("ledger_day"))
    b = statement.select(key, F.col(amount).alias("statement_amount"), F.col(day).alias("statement_day"))
    outcome = (
        F.when(F.col("statement_amount").isNull(), "missing_statement").when(F.col("ledger_amount").isNull(), "missing_ledger")
        .when(F.abs(F.col("ledger_amount") - F.col("statement_amount")) > tolerance, "amount_diff").when(F.abs(F.datediff("ledger_day", "statement_day")) > days, "date_diff").otherwise("matched")
    )
    return a.join(b, key, "full_outer").withColumn("outcome", outcome)


@dataclass(frozen=True)
class MatchRule:
    """cardinality: 1:1, 1:N (one statement entry for several of the ledger) or N:M; tolerances: None is any."""

    rule: str
    cardinality: str
    amount: float | None = 0.0
    days: int | None = 0


# The match rules.
MATCH_RULES = (MatchRule("MR01", "1:1", 0.0, 0), MatchRule("MR02", "1:1", 1.0, 0), MatchRule("MR03", "1:1", 0.0, 2), MatchRule("MR04", "1:N", 0.0, 1), MatchRule("MR05", "N:M", None, None))


def _within(rule: MatchRule, amount: Column, days: Column) -> Column:
    ok = F.lit(True) if rule.amount is None else F.abs(amount) <= rule.amount
    return ok if rule.days is None else ok & (days <= rule.days)


def match_by_rules(ledger: DataFrame, statement: DataFrame, rules: tuple[MatchRule, ...] = MATCH_RULES) -> DataFrame:
    """(rule, side, entry, ref): entries matched by the rules in turn, each on what the rules before left. Both tables: entry, ref, amount, day.

    Entries meet only under one reference. 1:1 pairs the k-th entry of each side in order of amount, day and entry. 1:N and N:M compare what
    is left of a reference as a whole: its sums, and the days between the first and last entries of both sides.
    """
    side = lambda df, name: df.select(F.lit(name).alias("side"), "entry", "ref", "amount", "day")
    return match_entries(side(ledger, "ledger").unionByName(side(statement, "statement")), rules)


def match_entries(entries: DataFrame, rules: tuple[MatchRule, ...] = MATCH_RULES) -> DataFrame:
    """match_by_rules over both sides in one table: side (ledger or statement), entry, ref, amount, day.

    Rows are dealt once, by reference, and not at all if they lie so: the first window is over ref alone, and all others fit what it asks for.
    A rule marks rows instead of taking them out, so that nothing is joined or written between rules. What is taken is known by side, entry and
    ref, so rows alike in these go together, and rows without an entry stay for the rules after.
    """
    own = F.col("side") == "ledger"
    rows = entries.filter("ref is not null").select(own.alias("own"), "entry", "ref", "amount", "day", F.lit(True).alias("left"))
    whole, hits = Window.partitionBy("ref"), []
    mine = lambda value, own: F.when(F.col("left") & (F.col("own") == own), value)
    gap = lambda group: F.datediff(F.max("day").over(group), F.min("day").over(group))
    for i, rule in enumerate(rules):
        if rule.cardinality == "1:1":
            place = F.row_number().over(whole.orderBy(F.col("left").desc(), F.col("own").desc(), "amount", "day", "entry"))  # the ledger's, then the statement's
            rows = rows.withColumns({"k": place, "before": F.count(mine(F.lit(1), True)).over(whole)})
            rows = rows.withColumn("k", F.when(F.col("left"), F.when(F.col("own"), F.col("k")).otherwise(F.col("k") - F.col("before"))))
            # two of one place are one of each side; no column is made for these sums, which would be sorted along
            pair = Window.partitionBy("ref", "k")
            off = F.when(F.count("amount").over(pair) == 2, F.max("amount").over(pair) - F.min("amount").over(pair))
            rows = rows.withColumns({"n": F.count(F.lit(1)).over(pair), "off": off, "gap": gap(pair)})
            shape = "n = 2"
        else:
            off = F.sum(mine(F.col("amount"), True)).over(whole) - F.sum(mine(F.col("amount"), False)).over(whole)
            rows = rows.withColumns({"n": F.count(mine(F.lit(1), True)).over(whole), "m": F.count(mine(F.lit(1), False)).over(whole), "off": off, "gap": gap(whole)})
            shape = {"1:N": "n >= 1 and m = 1", "N:M": "n >= 1 and m >= 1"}[rule.cardinality]
        good = F.coalesce(F.expr(shape) & _within(rule, F.col("off"), F.col("gap")), F.lit(False))
        rows = rows.withColumn(f"hit{i}", F.col("left") & good)
        # by the other rules a whole reference goes together anyway
        taken = F.max(f"hit{i}").over(Window.partitionBy("ref", "own", "entry")) if rule.cardinality == "1:1" else F.col(f"hit{i}")
        rows = rows.withColumn("left", F.col("left") & ~(taken & F.col("entry").isNotNull()))
        rows = rows.withColumns({c: F.when(F.col("left"), F.col(c)) for c in ("amount", "day")})
        hits.append(F.when(F.col(f"hit{i}"), rule.rule))
    side = F.when(F.col("own"), "ledger").otherwise("statement").alias("side")
    return rows.select(F.explode(F.array_compact(F.array(*hits))).alias("rule"), side, "entry", "ref")


def run_status(runs: DataFrame, day: str = "business_date", unmatched: str = "unmatched", open_days: int = 3) -> DataFrame:
    """The last day is in progress; unmatched items within the days before keep a run open; else it is signed off."""
    last = runs.select(F.col(day).alias("_day")).filter(F.col("_day").isNotNull()).distinct().orderBy(F.col("_day").desc()).limit(open_days + 1)
    span = last.agg(F.max("_day").alias("_last"), F.min("_day").alias("_first"))  # one row
    status = F.when(F.col(day) == F.col("_last"), "in_progress").when((F.col(day) >= F.col("_first")) & (F.col(unmatched) > 0), "open").otherwise("signed_off")
    return runs.crossJoin(F.broadcast(span)).withColumn("status", status).drop("_last", "_first")


def age_days(opened: Column, closed: Column | None, as_of: date) -> Column:
    """Days open; a closed item's age stands still."""
    end = F.lit(as_of) if closed is None else F.coalesce(closed, F.lit(as_of))
    return F.datediff(end, opened)


def action_log(breaks: DataFrame, key: str, opened: str, steps: Mapping[str, int]) -> DataFrame:
    """(key, step, at): one row for each step, so many days after opening."""
    log = F.array(*(F.struct(F.lit(s).alias("step"), F.date_add(F.col(opened), d).alias("at")) for s, d in steps.items()))
    return breaks.select(key, F.explode(log).alias("e")).select(key, "e.step", "e.at")


def running_balance(entries: DataFrame, account: str, order: list[str], amount: Column) -> DataFrame:
    """opening and closing balance of each entry: an opening is the closing before it."""
    w = Window.partitionBy(account).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    closing = F.sum(amount).over(w)
    return entries.withColumn("closing", closing).withColumn("opening", F.col("closing") - amount)


def sla_status(delivered: Column, expected: Column, failed: Column, grace_min: int = 0) -> tuple[Column, Column]:
    """(status, minutes late) of a delivery: failed, missing, late or on time."""
    late = (F.unix_timestamp(delivered) - F.unix_timestamp(expected)) / 60
    status = F.when(failed, "failed").when(delivered.isNull(), "missing").when(late > grace_min, "late").otherwise("on_time")
    return status, F.when(status == "late", late)


def golden_vendor(quotes: DataFrame, keys: list[str], vendor: str, rank: list[str], price: str) -> DataFrame:
    """The covering vendor of best rank for each key, as one aggregation."""
    return quotes.groupBy(*keys).agg(F.min_by(F.struct(vendor, price), F.struct(*rank)).alias("g")).select(*keys, f"g.{vendor}", F.col(f"g.{price}").alias("golden"))


def price_suspects(quotes: DataFrame, golden: Column, quote: Column, before: Column, conflict_pct: float, spike_pct: float) -> DataFrame:
    """Quotes that are missing, stale (unchanged), spiking against the day before, or in conflict with the golden price; with their deviation."""
    away = F.round(F.try_divide(quote - golden, golden) * 100, 4)
    jump = F.try_divide(F.abs(quote - before), before) * 100
    kind = F.when(quote.isNull(), "missing").when(F.abs(away) > conflict_pct, "conflict").when(jump > spike_pct, "spike").when(quote == before, "stale")
    return quotes.withColumn("kind", kind).withColumn("deviation_pct", away).filter("kind is not null")


def funnel(counted: DataFrame, key: str, stages: list[str]) -> DataFrame:
    """Stage counts as rows, in order, with the share of the first stage."""
    long = counted.unpivot([key], stages, "stage", "n")
    first = F.max(F.when(F.col("stage") == stages[0], F.col("n"))).over(Window.partitionBy(key))
    return long.withColumn("share", F.try_divide(F.col("n").cast("double"), first.cast("double")))


def recount_funnel(stages: DataFrame, suspects: DataFrame, days: int, approved_share: float = 0.8) -> DataFrame:
    """(day, stage, n): inside the last `days` days of `stages` the funnel follows from the day's suspects; earlier days stay as they are.

    stages: day, stage, n. suspects: a row each, with its day. Approved is what was valid, with a share of the suspects but on the last day,
    and so is distributed.
    """
    recent = stages.select("day").distinct().orderBy(F.col("day").desc()).limit(days)
    span = recent.agg(F.min("day").alias("first"), F.max("day").alias("last"))  # one row
    counted = suspects.groupBy("day").agg(F.count(F.lit(1)).alias("suspects"))
    whole = F.max(F.when(F.col("stage") == "acquired", F.col("n"))).over(Window.partitionBy("day"))
    rows = stages.withColumn("whole", whole).join(counted, "day", "left").crossJoin(F.broadcast(span)).withColumn("suspects", F.coalesce("suspects", F.lit(0)))
    valid = F.col("whole") - F.col("suspects")
    approved = valid + F.when(F.col("day") < F.col("last"), F.floor(F.col("suspects") * approved_share)).otherwise(0)
    new = F.when(F.col("stage") == "validated", valid).when(F.col("stage") == "suspect", F.col("suspects")).when(F.col("stage").isin("approved", "distributed"), approved).otherwise(F.col("n"))
    return rows.select("day", "stage", F.when(F.col("day") >= F.col("first"), new).otherwise(F.col("n")).cast("long").alias("n"))


def change_over(df: DataFrame, day: str, as_of: date, days: int, keys: list[str]) -> DataFrame:
    """Counts of the last `days` days and of as many before, and their relative change."""
    at = F.datediff(F.lit(as_of), F.to_date(day))
    out = df.filter(at.between(0, 2 * days - 1)).groupBy(*keys).agg(F.count_if(at < days).alias("now"), F.count_if(at >= days).alias("before"))
    return out.withColumn("change", F.try_divide((F.col("now") - F.col("before")).cast("double"), F.col("before").cast("double")))


def overlay(base: DataFrame, owned: Column, changes: Mapping[str, Column], more: DataFrame | None = None) -> DataFrame:
    """Rows that an incident owns with changed values, others as they are, and the incident's own rows after them."""
    out = base.select(*(F.when(owned, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in base.columns))
    return out.unionByName(more, allowMissingColumns=True) if more is not None else out


def continue_ids(base: DataFrame, more: DataFrame, key: str, order: list[str]) -> DataFrame:
    """New rows numbered on from the largest id, without gathering rows in one task: rows are settled with their task's number, tasks count
    theirs, and each row's number follows from its place in its task."""
    top = base.agg(F.coalesce(F.max(key), F.lit(0))).first()[0]  # one number
    held = cut(more.withColumn("_p", F.spark_partition_id()))
    counts = held.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.withColumn("_start", F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)))  # a row a task
    numbered = held.join(F.broadcast(starts), "_p").withColumn(key, (F.lit(top) + F.coalesce("_start", F.lit(0)) + F.row_number().over(Window.partitionBy("_p").orderBy(*order))).cast("long"))
    return numbered.drop("_p", "_n", "_start")


def carry_forward(df: DataFrame, keys: list[str], order: list[str], column: str) -> DataFrame:
    """The last known value where there is none (a stale price)."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(column, F.last(column, ignorenulls=True).over(w))


def price_walk(returns: DataFrame, keys: list[str], order: list[str], start: Column, log_return: Column) -> DataFrame:
    """Prices from a start by a running sum of log returns."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return returns.withColumn("price", start * F.exp(F.sum(log_return).over(w)))


def table_digest(df: DataFrame) -> DataFrame:
    """One row: count and a digest of all columns, whatever the order of rows, by partial sums. A row's text tells nulls from texts and where
    each column ends; 60 bits of its MD5 are added up."""
    column = lambda c: F.coalesce(F.concat(F.char_length(F.col(c).cast("string")), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    row = F.conv(F.left(F.md5(F.concat_ws("|", *(column(c) for c in df.columns))), F.lit(15)), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(row), F.lit(0)).cast("string").alias("digest"))


def scaled(sizes: Mapping[str, int], factor: float) -> dict[str, int]:
    """Generator sizes times a factor, one at least."""
    return {k: max(1, round(v * factor)) for k, v in sizes.items()}


def incident_pick(holdings: DataFrame, eligible: DataFrame, late: DataFrame, entity: str, holder: str) -> DataFrame:
    """The eligible entity that most holders hold and that is in no late row; the lowest id of equals."""
    ok = holdings.join(eligible, entity, "left_semi").join(late, entity, "left_anti")
    return ok.groupBy(entity).agg(F.count_distinct(holder).alias("holders")).orderBy(F.col("holders").desc(), entity).limit(1)
