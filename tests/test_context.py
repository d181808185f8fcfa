"""The derived graph and the context pack."""

import pytest
from pyspark.sql import functions as F

from tidemark.engine import Engine
from tidemark.errors import Refused
from tidemark.operators import context, graph
from tidemark.plans.catalog import METRICS
from tidemark.plans.security import PERSONAS
from tidemark.sources import catalog
from tidemark.sources.endpoints import REFMASTER

WANTED = ("open_breaks", "open_break_amount", "late_feeds", "funds", "open_dq_exceptions")


@pytest.fixture(scope="module")
def built(spark):
    d = catalog.declared
    schemas = {
        "cashrecon": {"breaks": d("break_id int, region string, ccy string, break_type string, legal_entity_id string, bank_source_id string, status string, amount decimal(20,2), age_days int, opened_on date", "break_id")},
        "assetrecon": {"portfolios": d("portfolio_id string, fund_group string, fund_entity_id string, custodian_source_id string", "portfolio_id")},
        "feedhub": {"sources": d("source_id string, source_type string", "source_id"), "feed_deliveries": d("source_id string, source_type string, feed_type string, status string, business_date date", references={"source_id": "sources.source_id"})},
        "refmaster": {"legal_entities": d("entity_id string, country string, sector string", "entity_id"), "exceptions": d("exc_id string, rule_id string, domain string, record_ref string, asset_class string, status string, opened_at timestamp", "exc_id")},
    }
    knowledge = context.Knowledge(
        (context.Term("break", "a difference between ledger and statement", ("mismatch",), ("metric:open_breaks", "metric:open_break_amount")), context.Term("nostro break", "a break on a nostro account", (), ("metric:open_breaks",), "break")),
        (context.Concept("legal entity", "a company", ("table:refmaster.legal_entities", "column:cashrecon.breaks.legal_entity_id"), ("column:refmaster.legal_entities.entity_id",), (("OWNS", "fund"),)), context.Concept("fund", "a pot of money", ("table:assetrecon.portfolios",))),
        {"entity": ("column:cashrecon.breaks.legal_entity_id", "column:refmaster.legal_entities.entity_id", "column:assetrecon.portfolios.fund_entity_id"), "bank": ("column:cashrecon.breaks.bank_source_id", "column:feedhub.feed_deliveries.source_id")},
    )
    endpoints = {"refmaster": {p: e for p, e in REFMASTER.items() if e.table in schemas["refmaster"] and "sector" not in e.table}}
    metrics = {k: METRICS[k] for k in WANTED}
    nodes, edges = context.derive(spark, schemas, metrics, endpoints, knowledge, PERSONAS)
    questions = spark.createDataFrame([("question:1", "Question", "", "q1", "how many open breaks by region", ["*"], "history", 1), ("question:2", "Question", "", "q2", "open breaks last week", ["*"], "declared", 1), ("question:3", "Question", "", "q3", "open breaks and late feeds", ["*"], "declared", 1)], nodes.schema)
    used = spark.createDataFrame([("question:1", "USED", "metric:open_breaks"), ("question:2", "USED", "metric:open_breaks"), ("question:3", "USED", "metric:open_breaks"), ("question:3", "USED", "metric:late_feeds")], edges.schema)
    return nodes.union(questions).cache(), edges.union(used).cache()


def test_derived_graph(built):
    nodes, edges = built
    kinds = {r.kind for r in nodes.select("kind").distinct().collect()}
    assert kinds == {"Source", "Table", "Column", "Endpoint", "Field", "Metric", "Dimension", "BusinessTerm", "Concept", "Role", "Question"}
    types = {r.type for r in edges.select("type").distinct().collect()}
    assert {"HAS_TABLE", "HAS_COLUMN", "REFERENCES", "HAS_ENDPOINT", "BACKED_BY", "RETURNS", "MAPS_TO", "COMPUTED_FROM", "HAS_DIMENSION", "ON_COLUMN", "DEFINES", "BROADER", "IMPLEMENTED_BY", "IDENTIFIED_BY", "OWNS", "SAME_KEY_AS", "CAN_READ", "JOINABLE_ON", "USED"} == types
    assert graph.dangling(nodes, edges).isEmpty()
    pairs = {(r.src, r.dst) for r in edges.filter("type = 'JOINABLE_ON'").collect()}
    assert ("metric:funds", "metric:open_breaks") in pairs and ("metric:late_feeds", "metric:open_break_amount") in pairs and ("metric:funds", "metric:late_feeds") not in pairs


def test_edges_without_ends_are_refused(spark):
    with pytest.raises(ValueError):
        context.derive(spark, {}, {}, {}, context.Knowledge((context.Term("x", "y", (), ("metric:gone",)),)), {})


def test_catalog_read(built):
    nodes, edges = built
    roles = {r.name: r.roles for r in context.load_catalog(nodes, edges).collect()}
    assert roles["open_breaks"] == ["role:bi_analyst", "role:cash_ops_emea", "role:head_data"] and set(roles) == set(WANTED)
    for bad in (nodes.withColumn("version", F.lit(0)), nodes.drop("version")):
        with pytest.raises(Refused):
            context.load_catalog(bad, edges)


def test_pack(spark, built):
    engine = Engine(spark, lambda s, t: None, graph=built)
    head = engine.context(PERSONAS["head_data"], "how many open breaks are there by region")
    assert "open_breaks" in [m["id"] for m in head["metrics"][:2]] and {t["term"] for t in head["terms"]} == {"break", "nostro break"}
    assert [e["question"] for e in head["examples"]][-1] == "how many open breaks by region"  # seeds come before history
    assert all({x["a"], x["b"]} <= {m["id"] for m in head["metrics"]} for x in head.get("metric_links", []))
    assert context.tokens(head) <= context.BUDGET
    bi = engine.context(PERSONAS["bi_analyst"], "open breaks by region and country")
    assert "columns" not in bi and "join_paths" not in bi and bi["metrics"]
    steward = engine.context(PERSONAS["steward"], "open breaks by region")
    assert "open_breaks" not in {m["id"] for m in steward.get("metrics", [])} and not any("break" in e["question"] for e in steward.get("examples", []))
    far = engine.context(PERSONAS["head_data"], "open breaks by entity country sector")
    assert any(p["from"].startswith("metric:open_break") and p["to"].startswith("column:refmaster.legal_entities") for p in far["join_paths"])
    for bad in ("", "see http://x"):
        with pytest.raises(Refused):
            engine.context(PERSONAS["head_data"], bad)
    with pytest.raises(Refused):
        Engine(spark, lambda s, t: None).context(PERSONAS["head_data"], "breaks")


def test_pack_is_trimmed_and_links_pruned(built):
    nodes, edges = built
    whole = context.pack(nodes, edges, context.scopes_of(PERSONAS["head_data"]), "open breaks by region")
    small = context.pack(nodes, edges, context.scopes_of(PERSONAS["head_data"]), "open breaks by region", budget=60)
    assert context.tokens(small) <= 60 < context.tokens(whole) and all({x["a"], x["b"]} <= {m["id"] for m in small.get("metrics", [])} for x in small.get("metric_links", []))


def test_vectors_rank_too(spark, built):
    nodes, edges = built
    vectors = spark.createDataFrame([("metric:late_feeds", [1.0, 0.0]), ("metric:funds", [0.0, 1.0])], "uid string, embedding array<float>")
    asked = spark.createDataFrame([("q", [0.9, 0.1])], "question string, embedding array<float>")
    hits = context.ranked_hits(nodes.filter("kind = 'Metric'"), "zzz", vectors, asked)
    assert [r.uid for r in hits.orderBy("rank").collect()][0] == "metric:late_feeds"


def test_path_pairs(spark):
    m = spark.createDataFrame([("m1", "a", 1), ("m2", "b", 2)], "uid string, source string, rank int")
    t = spark.createDataFrame([("c1", "b", "t1", 1), ("c2", "b", "t1", 2), ("c3", "a", "t2", 3), ("c4", "", "t3", 1)], "uid string, source string, table string, rank int")
    assert [tuple(r) for r in context.path_pairs(m, t).collect()] == [("m1", "c1"), ("m2", "c3")]
