"""Governed metrics and list or summary endpoints, on the benchmark tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.metrics import Metric, compile_metric, register
from tidemark.plans.security import Claims, masked, row_filter
from tidemark.registry import Tables, query
from tidemark.sources.endpoints import latest, listing, summary, text_like

#: The day that ages are counted to, and the stand-ins for the governed domain on these tables.
AS_OF = date(2001, 8, 1)
_CUSTOMER, _NATION, _REGION = ("customer", "o_custkey = c_custkey"), ("nation", "c_nationkey = n_nationkey"), ("region", "n_regionkey = r_regionkey")
_AGE = f"datediff(date'{AS_OF}', to_date(o_orderdate))"
_OPEN, _DIMS = "o_orderstatus <> 'F'", {"region": "r_name", "ccy": "c_mktsegment", "entity": "c_custkey", "kind": "o_orderpriority", "status": "o_orderstatus"}
_FILTERS = {"region": ("r_name", "str"), "ccy": ("c_mktsegment", "str"), "kind": ("o_orderpriority", "str"), "status": ("o_orderstatus", "str"), "age": (_AGE, "int"), "amount": ("o_totalprice", "float")}


def _breaks(id_: str, type_: str, joins: tuple = (_CUSTOMER, _NATION, _REGION), **more: object) -> Metric:
    return Metric(id_, "cashrecon", type_, "orders", joins=joins, dimensions=more.pop("dimensions", _DIMS), filters=more.pop("filters", _FILTERS), time_column="o_orderdate", **more)


METRICS = register([
    _breaks("open_breaks", "count", base_filter=_OPEN),
    _breaks("aged_open_breaks", "count", base_filter=_OPEN),
    _breaks("avg_break_age", "avg", expr=_AGE, base_filter=_OPEN),
    _breaks("resolution_rate", "ratio", numerator="o_orderstatus = 'F'"),
    _breaks("open_amount", "sum", expr="cast(o_totalprice as decimal(20,2))", base_filter=_OPEN, required=("ccy",)),
    Metric("move_abs", "marketmaster", "sum", "lineitem", expr="abs(cast(l_extendedprice * (l_discount - 0.05) as decimal(20,4)))", dimensions={"flag": "l_returnflag"}, filters={"flag": ("l_returnflag", "str")}, time_column="l_shipdate"),
    Metric("bps_max", "assetrecon", "max", "lineitem", expr="abs(l_extendedprice - l_quantity * 1000) / l_quantity", dimensions={"flag": "l_returnflag", "line": "l_linestatus"}),
    _breaks("entities", "distinct", expr="o_custkey"),
])


def run(t: Tables, metric: str, dims: list[str] = (), **asked: object) -> DataFrame:
    return compile_metric(METRICS[metric], lambda name: getattr(t, name), list(dims), as_of=AS_OF, **({"limit": None} | asked))


_J = "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
_D = f"date_diff('day', CAST(o_orderdate AS DATE), DATE '{AS_OF}')"


@query(f"SELECT r_name AS region, count(*) AS value FROM {_J} WHERE o_orderstatus <> 'F' GROUP BY 1")
def m01_open_by_region(t: Tables) -> DataFrame:
    return run(t, "open_breaks", ["region"])


@query(f"SELECT c_custkey AS entity, count(*) AS value FROM {_J} WHERE o_orderstatus <> 'F' AND {_D} > 1000 GROUP BY 1 ORDER BY value DESC, entity LIMIT 50")
def m02_aged_by_entity(t: Tables) -> DataFrame:
    """A top-k report: the 50 entities with most aged items."""
    return run(t, "aged_open_breaks", ["entity"], filters={"age": {"gt": 1000}}, order_by="metric_desc", limit=50)


@query(f"SELECT r_name AS region, c_mktsegment AS ccy, avg({_D}) AS value FROM {_J} WHERE o_orderstatus <> 'F' GROUP BY 1, 2")
def m03_avg_age(t: Tables) -> DataFrame:
    return run(t, "avg_break_age", ["region", "ccy"])


@query(f"SELECT r_name AS region, o_orderpriority AS kind, count(*) FILTER (WHERE o_orderstatus = 'F') / count(*) AS value FROM {_J} GROUP BY 1, 2")
def m04_resolution_ratio(t: Tables) -> DataFrame:
    return run(t, "resolution_rate", ["region", "kind"])


@query(f"SELECT c_mktsegment AS ccy, CAST(sum(CAST(o_totalprice AS DECIMAL(20,2))) AS DOUBLE) AS value FROM {_J} WHERE o_orderstatus <> 'F' GROUP BY 1")
def m05_amount_by_ccy(t: Tables) -> DataFrame:
    return run(t, "open_amount", ["ccy"])


@query("SELECT l_returnflag AS flag, round(CAST(sum(abs(CAST(l_extendedprice * (l_discount - 0.05) AS DECIMAL(20,4)))) AS DOUBLE), 1) AS value FROM lineitem GROUP BY 1")
def m06_sum_abs(t: Tables) -> DataFrame:
    return run(t, "move_abs", ["flag"]).withColumn("value", F.round("value", 1))


@query("SELECT l_returnflag AS flag, l_linestatus AS line, max(abs(l_extendedprice - l_quantity * 1000) / l_quantity) AS value FROM lineitem GROUP BY 1, 2")
def m07_max_abs_bps(t: Tables) -> DataFrame:
    return run(t, "bps_max", ["flag", "line"])


@query(f"SELECT r_name AS region, count(DISTINCT o_custkey) AS value FROM {_J} GROUP BY 1")
def m08_distinct_entities(t: Tables) -> DataFrame:
    return run(t, "entities", ["region"])


@query(f"SELECT count(*) FILTER (WHERE o_orderstatus = 'F') / nullif(count(*), 0) AS value FROM {_J} WHERE r_name = 'NOWHERE'")
def m09_global_empty_ratio(t: Tables) -> DataFrame:
    """No rows: one row, null."""
    return run(t, "resolution_rate", filters={"region": "NOWHERE"})


@query(f"SELECT r_name AS region, count(*) AS value FROM {_J} WHERE o_orderstatus <> 'F' AND CAST(o_orderdate AS DATE) BETWEEN DATE '2000-08-14' AND DATE '2001-08-01' GROUP BY 1")
def m10_last_business_days(t: Tables) -> DataFrame:
    return run(t, "open_breaks", ["region"], time_range={"last_business_days": 253})


@query(f"""SELECT c_mktsegment AS ccy, o_orderstatus AS status, count(*) AS value FROM {_J} WHERE r_name IN ('ASIA', 'EUROPE') AND c_mktsegment <> 'BUILDING' AND o_totalprice >= 1000 AND o_totalprice < 200000
           AND {_D} BETWEEN 100 AND 2000 AND o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F' GROUP BY 1, 2""")
def m11_filter_ops(t: Tables) -> DataFrame:
    asked = {"region": ["ASIA", "EUROPE"], "ccy": {"ne": "BUILDING"}, "amount": {"gte": 1000, "lt": 200000}, "age": {"between": [100, 2000]}, "kind": "1-URGENT"}
    return run(t, "open_breaks", ["ccy", "status"], filters=asked)


@query(f"SELECT r_name AS region, count(*) AS value FROM {_J} WHERE o_orderstatus <> 'F' AND r_name IN ('EUROPE', 'ASIA') GROUP BY 1")
def m12_secured_region(t: Tables) -> DataFrame:
    claims = Claims("emea", frozenset({"cashrecon"}), {"region": ("EUROPE", "ASIA")}, False)
    scoped = lambda n: t.region.filter(row_filter(claims, "cashrecon", "breaks", "region", F.col("r_name"))) if n == "region" else getattr(t, n)
    return compile_metric(METRICS["open_breaks"], scoped, ["region"], limit=None)


@query("SELECT c_custkey, '****' || right(c_name, 4) AS c_name FROM customer")
def m13_masked_name(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", masked("c_name", 4, False))


@query(f"SELECT r_name AS region, o_orderstatus AS status, count(*) AS value FROM {_J} WHERE o_orderstatus <> 'F' GROUP BY 1, 2 ORDER BY region DESC, status LIMIT 7")
def m14_order_by_dimension(t: Tables) -> DataFrame:
    return run(t, "open_breaks", ["region", "status"], order_by="-region", limit=7)


# ---- endpoints ----


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_nationkey, c_custkey LIMIT 40 OFFSET 20")
def r01_list_page(t: Tables) -> DataFrame:
    return listing(t.customer, ["c_custkey", "c_name", "c_acctbal"], {"c_mktsegment": "BUILDING"}, ["c_nationkey", "c_custkey"], 40, 20)


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%l\\_%' ESCAPE '\\' OR p_name ILIKE '%d wid%'")
def r02_ilike(t: Tables) -> DataFrame:
    """Metacharacters of the caller's text are literal."""
    return t.part.filter(text_like("p_name", "l_") | text_like("p_name", "D WID")).select("p_partkey", "p_name")


@query("SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus <> 'F') AS open_count, count(*) AS total FROM orders GROUP BY 1")
def r03_dual_count(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") != "F").alias("open_count"), F.count(F.lit(1)).alias("total"))


@query("SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2")
def r04_dynamic_group(t: Tables) -> DataFrame:
    return summary(t.events, ["event_type", "user_id", "event_type"], limit=None)


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, max(o_orderdate) AS o_orderdate FROM orders GROUP BY 1")
def r05_latest_row(t: Tables) -> DataFrame:
    return latest(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderdate")


@query("SELECT event_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-08' + INTERVAL 1 DAY")
def r06_half_open_range(t: Tables) -> DataFrame:
    """The end day counts whole."""
    return listing(t.events, ["event_id", "event_type"], {"ts": {"gte": date(2024, 1, 5), "day_lte": date(2024, 1, 8)}}, ["event_id"], None)


@query("""WITH g AS (SELECT l_partkey, max(l_shipdate) AS day FROM lineitem GROUP BY 1)
          SELECT l_partkey, l_suppkey, day, count(*) AS quotes, max(l_extendedprice / l_quantity) AS price, max(p_retailprice) AS golden FROM lineitem JOIN g USING (l_partkey) JOIN part ON p_partkey = l_partkey WHERE l_shipdate = day GROUP BY 1, 2, 3""")
def r07_golden_quotes(t: Tables) -> DataFrame:
    """Each part's latest day, its golden price, and that day's quotes of every supplier."""
    day = t.lineitem.groupBy("l_partkey").agg(F.max("l_shipdate").alias("day"))
    quotes = t.lineitem.join(day, "l_partkey").filter("l_shipdate = day").join(t.part, F.expr("p_partkey = l_partkey"))
    return quotes.groupBy("l_partkey", "l_suppkey", "day").agg(F.count(F.lit(1)).alias("quotes"), F.max(F.expr("l_extendedprice / l_quantity")).alias("price"), F.max("p_retailprice").alias("golden"))


@query("SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS value FROM (SELECT count(*) AS n FROM events WHERE event_type = 'none' GROUP BY event_type)")
def r08_reaggregate(t: Tables) -> DataFrame:
    """The sum of an endpoint's default groups; 0 where there are none."""
    return summary(t.events.filter("event_type = 'none'"), ["event_type"], limit=None).agg(F.coalesce(F.sum("n"), F.lit(0)).cast(T.LongType()).alias("value"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey = 42")
def r09_point_lookup(t: Tables) -> DataFrame:
    return t.customer.filter("c_custkey = 42").select("c_custkey", "c_name").limit(1)


@query("SELECT event_type, user_id, n FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2) ORDER BY n DESC, event_type, user_id LIMIT 25")
def r10_summary_top(t: Tables) -> DataFrame:
    return summary(t.events, ["event_type", "user_id"], limit=25)
