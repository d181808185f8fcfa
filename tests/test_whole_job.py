"""Operators do the whole job: no subset of ids, no cut."""

import os
import random
from datetime import date
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import registry
from tidemark.operators import graph, recon, shape
from tidemark.sources import endpoints

FOLDER = os.environ.get("TIDEMARK_TEST_SF", "/root/testdata/sf0.001")
tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@tables
def test_gate_judges_every_customer(spark):
    region = {r.n_nationkey: r.n_regionkey for r in spark.read.parquet(f"{FOLDER}/nation.parquet").collect()}
    used = {}
    for r in spark.read.parquet(f"{FOLDER}/customer.parquet").collect():
        used.setdefault(f"q{r.c_custkey // 3}", []).append(region[r.c_nationkey])
    got = {r.uid for r in registry.QUERIES["g12_gate_all_customers"](spark, FOLDER).collect() if r.uid[0] == "q"}
    assert got and got == {k for k, v in used.items() if {*v} <= {1, 2}}


@tables
def test_every_hundredth_vector_asks(spark):
    vectors = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()}
    got = {}
    for r in registry.QUERIES["g13_cosine_topk_all"](spark, FOLDER).collect():
        got.setdefault(r.question, set()).add(r.item)
    cos = lambda a, b: round(float(a @ b / np.sqrt((a @ a) * (b @ b))), 6)
    assert got == {q: {i for _, i in sorted((-cos(v, vectors[q]), i) for i, v in vectors.items() if i != q)[:10]} for q in vectors if q % 100 == 0}


@tables
def test_questions_go_in_bounded_blocks(spark):
    every = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    items, asked = every.withColumnRenamed("vec_id", "item"), every.filter("vec_id % 10 = 0").withColumnRenamed("vec_id", "question")
    top = lambda block: sorted(map(tuple, graph.vector_top(items, asked, 3, "item", "question", block=block).collect()))
    assert asked.count() > 16 and top(16) == top(10_000) and len(top(16)) == 3 * asked.count()


def test_run_status_keeps_every_day(spark):
    days = 100_500
    runs = spark.range(days).select(F.date_add(F.lit("1800-01-01").cast("date"), F.col("id").cast("int")).alias("business_date"), F.lit(1).alias("unmatched"))
    got = {r.status: r["count"] for r in recon.run_status(runs).groupBy("status").count().collect()}
    assert got == {"in_progress": 1, "open": 3, "signed_off": days - 4}


def test_cut_pages_are_told(spark):
    df = spark.range(1203).select(F.concat(F.lit("r"), F.col("id") % 601).alias("rule_id"), F.lit("d").alias("domain"), F.lit("open").alias("status"), F.lit("equity").alias("asset_class"), F.lit("x").alias("record_ref"), F.current_timestamp().alias("opened_at"))
    s = endpoints.REFMASTER["/exceptions/summary"]
    cut = s.page(df, {"group_by": ["rule_id"]})
    assert cut["truncated"] and cut["count"] == endpoints.MAX_PAGE
    whole = s.page(df, {"group_by": ["domain"]})
    assert not whole["truncated"] and whole["items"][0]["total"] == 1203
    rows = spark.range(7).select(F.concat(F.lit("S"), "id").alias("security_id"), *(F.lit("x").alias(c) for c in ("asset_class", "ccy", "country", "status", "name")))
    e = endpoints.REFMASTER["/securities"]
    assert [e.page(rows, {}, limit, offset)["truncated"] for limit, offset in ((3, 0), (3, 4), (7, 0), (6, 0))] == [True, False, False, True]


def test_table_digest_tells_nulls_and_columns(spark):
    digest = lambda *rows: recon.table_digest(spark.createDataFrame([*rows], "a string, b string")).first().digest
    assert len({digest(("x", None)), digest((None, "x")), digest(("x", "")), digest(("x", "-")), digest(("x|1:y", "z")), digest(("x", "y|1:z")), digest((None, None))}) == 7
    assert digest(("a", "b"), ("c", None)) == digest(("c", None), ("a", "b"))


def test_ids_go_on_whatever_the_tasks(spark):
    base = spark.createDataFrame([(41,)], "id long")
    for parts in (1, 7):
        more = spark.range(50).selectExpr("id as v").repartition(parts).sample(0.9, seed=3)
        got = recon.continue_ids(base, more, "id", ["v"]).collect()
        assert sorted(r.id for r in got) == list(range(42, 42 + len(got))) and len({r.v for r in got}) == len(got)


def test_models_without_a_price_stay(spark):
    df = spark.createDataFrame([("m", 10.0), ("n", 5.0)], "model string, tokens double")
    assert {r.model: r.cost for r in shape.cost(df, "model", "tokens", {"m": 2.0}).collect()} == {"m": 20.0, "n": None}


def test_match_rules_in_turn(spark):
    row = "entry long, ref string, amount decimal(10,2), day date"
    side = lambda rows: spark.createDataFrame([(k, ref, Decimal(a), date(2026, 1, d)) for k, ref, a, d in rows], row)
    ledger = side([(1, "exact", "5.00", 1), (2, "near", "7.00", 1), (3, "late", "9.00", 1), (4, "split", "1.00", 1), (5, "split", "2.00", 2), (6, "many", "4.00", 1), (7, "many", "6.00", 9), (8, "gone", "1.00", 1)])
    statement = side([(11, "exact", "5.00", 1), (12, "near", "7.80", 1), (13, "late", "9.00", 3), (14, "split", "3.00", 1), (15, "many", "2.50", 1), (16, "many", "7.50", 5), (17, "lost", "1.00", 1)])
    got = {(r.rule, r.side, r.entry) for r in recon.match_by_rules(ledger, statement).collect()}
    assert got == {("MR01", "ledger", 1), ("MR01", "statement", 11), ("MR02", "ledger", 2), ("MR02", "statement", 12), ("MR03", "ledger", 3), ("MR03", "statement", 13), ("MR04", "ledger", 4), ("MR04", "ledger", 5), ("MR04", "statement", 14)} | {("MR05", "ledger", k) for k in (6, 7)} | {("MR05", "statement", k) for k in (15, 16)}


def match_in_turn(entries, rules):
    """match_by_rules, plainly. entries: side, entry, ref, amount, day."""
    left, found = [e for e in entries if e[2] is not None], []
    low = lambda v: (v is not None, v)
    for rule in rules:
        groups, places = {}, {}
        for e in sorted(left, key=lambda e: [low(v) for v in (*e[3:], e[1])]):
            k = places[e[0], e[2]] = places.get((e[0], e[2]), 0) + 1
            groups.setdefault((e[2], k if rule.cardinality == "1:1" else 0), []).append(e)
        hit = []
        for g in groups.values():
            a, b = ([e for e in g if e[0] == side] for side in ("ledger", "statement"))
            known = [[e[3] for e in s if e[3] is not None] for s in (a, b)]
            days = [e[4] for e in g if e[4] is not None]
            shape = {"1:1": len(a) == len(b) == 1, "1:N": bool(a) and len(b) == 1, "N:M": bool(a) and bool(b)}[rule.cardinality]
            amount = rule.amount is None or all(known) and abs(sum(known[0]) - sum(known[1])) <= rule.amount
            if shape and amount and (rule.days is None or days and (max(days) - min(days)).days <= rule.days):
                hit += g
        found += [(rule.rule, *e[:3]) for e in hit]
        taken = {e[:3] for e in hit if e[1] is not None}
        left = [e for e in left if e[:3] not in taken]
    return sorted(found, key=repr)


def test_match_rules_deal_rows_once(spark):
    pick = random.Random(6).choice
    rows = [(pick(("ledger", "ledger", "statement")), pick((None, *range(5))), pick((None, *"abcdefghijklmnopqrstuvwxyz")), pick((None, *(Decimal(x) / 2 for x in range(-2, 6)))), pick((None, *(date(2026, 1, d) for d in range(1, 5))))) for _ in range(240)]
    both = spark.createDataFrame(rows, "side string, entry long, ref string, amount decimal(10,2), day date")
    for rules in (recon.MATCH_RULES, (recon.MatchRule("a", "N:M", 0.5, 3), recon.MatchRule("b", "1:1", None, 1), recon.MatchRule("c", "1:1", 1.0, None), recon.MatchRule("d", "1:N", None, None))):
        got = recon.match_by_rules(*(both.filter(F.col("side") == s).drop("side") for s in ("ledger", "statement")), rules)
        assert sorted(map(tuple, got.select("rule", "side", "entry", "ref").collect()), key=repr) == match_in_turn(rows, rules)
        assert exchanges(got) == 1


def exchanges(df):
    """Times that rows are dealt anew, of a whole job in one plan; where a part is settled before, its exchanges aren't in it."""
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange hashpartitioning")


@tables
def test_match_query_deals_lines_once(spark):
    assert exchanges(registry.QUERIES["d06_match_rules"](spark, FOLDER)) == 1
