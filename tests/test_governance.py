"""Metrics, policy, row security and masks on a small hand-made domain."""

import datetime as dt
from decimal import Decimal

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidemark.engine import Engine
from tidemark.errors import Refused
from tidemark.plans import metrics as M
from tidemark.plans.catalog import METRICS
from tidemark.plans.policy import Policy
from tidemark.plans.security import PERSONAS, ROW_SCOPES, Claims, secure

AS_OF = dt.date(2026, 9, 30)
BREAKS = [  # break_id, region, ccy, break_type, legal_entity_id, bank_source_id, status, amount, age_days, opened_on
    (k, ["EMEA", "APAC", "AMER"][k % 3], ["USD", "EUR"][k % 2], ["fx", "fee"][k % 2], f"LE{k % 4}", f"BNK{k % 2}", ["open", "closed", "investigating"][k % 7 % 3], Decimal(k * 10), k % 11, AS_OF - dt.timedelta(days=k)) for k in range(60)
]
SCHEMAS = {
    ("cashrecon", "breaks"): ("break_id int, region string, ccy string, break_type string, legal_entity_id string, bank_source_id string, status string, amount decimal(20,2), age_days int, opened_on date", BREAKS),
    ("cashrecon", "match_groups"): ("group_id int, region string, status string, matched_by string, rule_id string", [(k, ["EMEA", "APAC"][k % 2], ["auto", "manual"][k % 4 == 0], f"op{k % 3}", f"R{k % 2}") for k in range(20)]),
    ("cashrecon", "cash_accounts"): ("account_id string, region string, nostro_no string", [("A1", "EMEA", "GB12345678"), ("A2", "APAC", "JP87654321")]),
    ("feedhub", "feed_deliveries"): ("source_id string, source_type string, feed_type string, status string, business_date date, latency_min double", [(f"S{k % 3}", ["bank", "custodian"][k % 2], "px", ["on_time", "late", "missing", "failed"][k % 4], AS_OF - dt.timedelta(days=k % 5), float(k)) for k in range(24)]),
    ("feedhub", "support_tickets"): ("ticket_id int, category string, source_id string, source_type string, status string", [(k, "c", "S1", "bank", ["open", "done"][k % 2]) for k in range(6)]),
    ("assetrecon", "recon_exceptions"): ("cause_code string, fund_group string, portfolio_id string, business_date date, security_id string, status string, diff_mv decimal(20,2)", [("late", ["Growth", "Income"][k % 2], f"P{k % 3}", AS_OF, f"S{k}", ["open", "closed"][k % 2], Decimal(k - 5)) for k in range(12)]),
    ("assetrecon", "recon_runs"): ("recon_type string, fund_group string, portfolio_id string, business_date date, unmatched int", [("pos", "Growth", f"P{k % 3}", AS_OF, k % 2) for k in range(6)]),
    ("assetrecon", "nav_checks"): ("portfolio_id string, fund_group string, nav_date date, diff_bps decimal(10,3)", [(f"P{k}", "Growth", AS_OF, Decimal(k * 3 - 6)) for k in range(5)]),
    ("assetrecon", "portfolios"): ("portfolio_id string, fund_group string, fund_entity_id string, custodian_source_id string", [(f"P{k}", ["Growth", "Income"][k % 2], f"LE{k}", "CUS1") for k in range(4)]),
    ("marketmaster", "price_suspects"): ("suspect_id string, security_id string, vendor_id string, asset_class string, price_date date, kind string, status string", [(f"X{k}", f"S{k % 3}", f"V{k % 2}", ["equity", "bond"][k % 2], AS_OF, ["conflict", "spike"][k % 2], "open") for k in range(10)]),
    ("refmaster", "exceptions"): ("exc_id string, rule_id string, domain string, record_ref string, asset_class string, status string, opened_at timestamp", [(f"E{k}", "R1", "securities", f"S{k}", ["equity", None][k % 2], ["open", "closed"][k % 3 == 0], dt.datetime(2026, 9, 1, k)) for k in range(10)]),
    ("refmaster", "corporate_actions"): ("ca_id string, security_id string, issuer_entity_id string, event_type string, ex_date date, status string", [(f"C{k}", f"S{k}", "LE1", ["dividend", "split"][k % 2], AS_OF, ["pending", "done"][k % 3 == 0]) for k in range(9)]),
}


@pytest.fixture(scope="module")
def tables(spark):
    return {k: spark.createDataFrame(rows, schema) for k, (schema, rows) in SCHEMAS.items()}


@pytest.fixture(scope="module")
def engine(spark, tables):
    return Engine(spark, lambda s, t: tables.get((s, t)), as_of=AS_OF)


def code(f, *a, **k):
    with pytest.raises(Refused) as e:
        f(*a, **k)
    return e.value.code


HEAD, BI, EMEA = PERSONAS["head_data"], PERSONAS["bi_analyst"], PERSONAS["cash_ops_emea"]


def test_every_metric_runs(engine):
    assert len(METRICS) == 25
    for id_, m in METRICS.items():
        df = engine.metric(HEAD, id_, list(m.required)).frame
        assert df.columns == [*m.required, "value"] and df.count() >= 1
        for d in m.dimensions:
            assert engine.metric(HEAD, id_, list(dict.fromkeys([*m.required, d]))).frame.count() >= 1


def test_values_orders_and_truncation(engine):
    want = {}
    for b in BREAKS:
        if b[6] != "closed":
            want[b[1]] = want.get(b[1], 0) + 1
    got = engine.run_metric(HEAD, "open_breaks", ["region"])
    assert dict(map(tuple, got["sample"])) == want and [r[1] for r in got["sample"]] == sorted(want.values(), reverse=True)
    assert [r[0] for r in engine.run_metric(HEAD, "open_breaks", ["region"], order_by="-region")["sample"]] == ["EMEA", "APAC", "AMER"]
    assert engine.run_metric(HEAD, "open_breaks", ["region"], limit=2)["truncated"] and not got["truncated"]
    assert code(engine.run_metric, HEAD, "open_breaks", ["region"], order_by="nope") == "invalid_request"


def test_time_ranges():
    f = M.last_business_days
    assert f(1, dt.date(2026, 9, 27)) == (dt.date(2026, 9, 25), dt.date(2026, 9, 25))
    for n in range(1, 30):
        for day in range(14):
            end = AS_OF - dt.timedelta(days=day)
            days = [end - dt.timedelta(days=k) for k in range(60)]
            week = [d for d in days if d.weekday() < 5][:n]
            assert f(n, end) == (week[-1], week[0])
    for bad in (0, 367, True, "3"):
        assert code(f, bad, AS_OF) == "invalid_request"
    assert code(M.time_bounds, {"from": "2026-02-02", "to": "2026-01-01"}, AS_OF) == "invalid_request"


@pytest.mark.parametrize(("value", "kind", "want"), [("12", "int", 12), (3.0, "int", 3), (-5, "int", -5), ("2026-01-02", "date", dt.date(2026, 1, 2)), (True, "bool", True), ("a", "str", "a"), ("1.5", "float", 1.5)])
def test_coerce(value, kind, want):
    assert M.coerce(value, kind) == want


@pytest.mark.parametrize(("value", "kind"), [(True, "int"), (1.5, "int"), ("1e3", "int"), (2**63, "int"), ("x" * 201, "str"), ("a\0", "str"), (1, "str"), ("yesterday", "date"), (1, "bool"), (None, "int"), ([], "float"), (True, "float"), ("x", "float")])
def test_coerce_refuses(value, kind):
    assert code(M.coerce, value, kind) == "invalid_request"


_AGES = st.integers(-2, 12)
_SPEC = st.one_of(_AGES, st.lists(_AGES, min_size=1, max_size=4), st.fixed_dictionaries({}, optional={"gt": _AGES, "gte": _AGES, "lt": _AGES, "lte": _AGES}).filter(bool), st.fixed_dictionaries({"ne": _AGES}), st.fixed_dictionaries({"between": st.tuples(_AGES, _AGES).map(list)}))


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(spec=_SPEC)
def test_filters_agree_with_sql(spark, engine, spec):
    ops = {"eq": "=", "ne": "<>", "gt": ">", "gte": ">=", "lt": "<", "lte": "<="}
    if isinstance(spec, list):
        where = f"age IN ({', '.join(map(str, spec))})"
    elif isinstance(spec, dict):
        where = " AND ".join(f"age BETWEEN {v[0]} AND {v[1]}" if o == "between" else f"age {ops[o]} {v}" for o, v in spec.items())
    else:
        where = f"age = {spec}"
    con = duckdb.connect()
    con.execute("create table b(age int, status varchar)")
    con.executemany("insert into b values (?, ?)", [(b[8], b[6]) for b in BREAKS])
    want = con.execute(f"select count(*) from b where status <> 'closed' and {where}").fetchone()[0]
    assert engine.metric(HEAD, "open_breaks", filters={"age_days": spec}).frame.first()["value"] == want


@pytest.mark.parametrize("spec", [{"eq": 1, "gt": 0}, {"in": []}, {"like": "x"}, {}, {"between": [1]}, {"between": [1, 2], "lt": 9}])
def test_filters_refuse(engine, spec):
    assert code(engine.metric, HEAD, "open_breaks", filters={"age_days": spec}) == "invalid_request"


def test_definitions_are_checked():
    for bad in ({"type": "mode"}, {"type": "sum"}, {"type": "ratio"}, {"frm": "a, b"}, {"id": "Bad"}, {"required": ("x",)}, {"joins": (("(select 1)", "true"),)}):
        with pytest.raises(ValueError):
            M.Metric(**({"id": "m", "source": "s", "type": "count", "frm": "t"} | bad))
    m = M.Metric("m", "s", "count", "t")
    with pytest.raises(ValueError):
        M.register([m, m])


# ---- policy ----


def test_policy_matrix(engine):
    assert code(engine.run_metric, BI, "auto_match_rate", ["matched_by"]) == "sensitive_dimension"
    assert code(engine.run_metric, BI, "manual_matches", (), {"matched_by": "op1"}) == "sensitive_dimension"
    assert code(engine.run_metric, HEAD, "open_break_amount", ["region"]) == "missing_required_dimension"
    assert code(engine.run_metric, BI, "late_feeds", ["source_id"], {"business_date": "2026-09-30"}) == "grain_too_fine"
    assert engine.run_metric(HEAD, "late_feeds", ["source_id", "business_date"])["sample"]
    assert code(engine.run_metric, EMEA, "price_conflicts") == code(engine.run_metric, EMEA, "no_such_metric") == "not_permitted"
    assert code(engine.run_metric, HEAD, "Bad Id") == "unknown_metric"
    for bad in (["region", "region"], ["nope"], "region", [1]):
        assert code(engine.run_metric, HEAD, "open_breaks", bad) == "invalid_request"
    assert code(engine.policy.check_query, BI, "cashrecon") == "metrics_only"
    assert code(engine.policy.check_query, EMEA, "refmaster") == "not_permitted"
    assert Claims("x").metrics_only  # a missing claim restricts


@pytest.mark.parametrize("persona", list(PERSONAS))
def test_visibility_matrix(persona):
    c = PERSONAS[persona]
    for source, ts in ROW_SCOPES.items():
        for t in ts:
            assert c.can(source, t) == (source in c.scopes or f"{source}.{t}" in c.scopes)
    seen = {s: len(Policy(METRICS).describe(c, s)["metrics"]) for s in ROW_SCOPES}
    assert {s for s, n in seen.items() if n} <= {s for s in ROW_SCOPES if any(x == s or x.startswith(f"{s}.") for x in c.scopes)}


def test_row_security(spark, tables):
    breaks = tables["cashrecon", "breaks"]
    assert {r.region for r in secure(breaks, EMEA, "cashrecon", "breaks", "region").collect()} == {"EMEA"}
    assert secure(breaks, Claims("x", frozenset({"cashrecon"}), {}, False), "cashrecon", "breaks", "region").count() == 0
    assert secure(breaks, PERSONAS["steward"], "cashrecon", "breaks", "region").count() == 0
    plan = secure(breaks, EMEA, "cashrecon", "breaks", "region")._jdf.queryExecution().optimizedPlan().toString()
    assert "EMEA" in plan


def test_denied_rows_give_zero_and_null(engine):
    none = Claims("none", frozenset({"cashrecon"}), {"region": ("MOON",)}, False)
    assert engine.metric(none, "open_breaks").frame.first()["value"] == 0
    assert engine.metric(none, "break_resolution_rate").frame.first()["value"] is None


def test_masks(engine):
    hidden = Claims("ops", frozenset({"cashrecon"}), {"region": ("*",)}, False)
    assert {r[0] for r in engine.query(hidden, "cashrecon", "select nostro_no from cash_accounts")["sample"]} == {"****5678", "****4321"}
    assert {r[0] for r in engine.query(HEAD, "cashrecon", "select nostro_no from cash_accounts")["sample"]} == {"GB12345678", "JP87654321"}


# ---- calls ----


def test_query_pages_and_combine(engine):
    q = engine.query(EMEA, "cashrecon", "select region, ccy, sum(amount) as value from breaks group by 1, 2 order by 2;")
    assert [r[:2] for r in q["sample"]] == [["EMEA", "EUR"], ["EMEA", "USD"]]
    page = engine.get_rows(EMEA, q["handle"], 1, 1)
    assert page["rows"][0][1] == "USD" and isinstance(page["rows"][0][2], float)
    assert code(engine.get_rows, HEAD, q["handle"]) == "unknown_handle"
    assert code(engine.get_rows, EMEA, q["handle"], -1) == "invalid_request"
    a = engine.run_metric(HEAD, "open_break_amount", ["ccy", "region"])["handle"]
    b = engine.run_metric(HEAD, "open_breaks", ["region"])["handle"]
    both = engine.combine(HEAD, "select a.ccy, a.region, a.value, b.value as n from a join b on a.region = b.region", {"a": a, "b": b})
    assert both["columns"] == ["ccy", "region", "value", "n"]
    total = engine.combine(HEAD, "select ccy, sum(value) as total from a group by ccy", {"a": both["handle"]})
    assert len(total["sample"]) == 2 and engine.lineage(HEAD, total["handle"]) == ["open_break_amount", "open_breaks"]
    assert code(engine.combine, HEAD, "select sum(value) as total from a", {"a": both["handle"]}) == "mixed_currency"
    assert code(engine.query, EMEA, "cashrecon", "select * from parquet.`/etc/passwd`") == "sql_not_allowed"
    assert code(engine.query, EMEA, "cashrecon", "select 1 / (age_days - age_days) from breaks") == "query_failed"
    assert engine.store.metric_backed(HEAD.sub, total["handle"]) and not engine.store.metric_backed(EMEA.sub, q["handle"])


def test_yaml_definitions(tmp_path):
    from tidemark.plans.catalog import load_metrics

    text = "id: m\nsource: cashrecon\ntype: count\nfrom: breaks\ndimensions: {region: region}\nfilters: {age: {expr: age_days, type: int}}\nfine_grain: [region]\n"
    (tmp_path / "m.yaml").write_text(text)
    m = load_metrics(str(tmp_path))["m"]
    assert (m.frm, m.filters["age"], m.fine_grain) == ("breaks", ("age_days", "int"), ("region",))
    (tmp_path / "n.yaml").write_text(text)
    with pytest.raises(ValueError):
        load_metrics(str(tmp_path))
    (tmp_path / "n.yaml").write_text(text.replace("id: m", "id: n") + "sql: drop\n")
    with pytest.raises(ValueError):
        load_metrics(str(tmp_path))
