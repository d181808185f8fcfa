"""The engine's calls under its own metric definitions and personas: the governed tables are views of the benchmark tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.engine import Engine
from tidemark.plans.security import PERSONAS
from tidemark.registry import Tables, query

#: The day that ages are counted to, and the views: regions, statuses and feeds in terms of orders and events.
AS_OF = date(2001, 8, 1)
HEAD, EMEA = PERSONAS["head_data"], PERSONAS["cash_ops_emea"]


def governed(t: Tables) -> Engine:
    """An engine over breaks (an order each), feed deliveries (an event each) and reconciliation runs (an order's lines each)."""
    region = F.when(F.col("r_name").isin("EUROPE", "MIDDLE EAST", "AFRICA"), "EMEA").when(F.col("r_name") == "ASIA", "APAC").otherwise("AMER")

    def breaks() -> DataFrame:
        joined = t.orders.join(t.customer, F.expr("o_custkey = c_custkey")).join(t.nation, F.expr("c_nationkey = n_nationkey")).join(t.region, F.expr("n_regionkey = r_regionkey"))
        status = F.when(F.col("o_orderstatus") == "F", "closed").when(F.col("o_orderstatus") == "O", "open").otherwise("investigating")
        return joined.select(
            F.col("o_orderkey").alias("break_id"), region.alias("region"), F.col("c_mktsegment").alias("ccy"), F.col("o_orderpriority").alias("break_type"), F.concat(F.lit("LE"), "c_nationkey").alias("legal_entity_id"),
            F.concat(F.lit("BNK"), F.col("c_nationkey") % 7).alias("bank_source_id"), status.alias("status"), F.col("o_totalprice").cast("decimal(20,2)").alias("amount"),
            F.datediff(F.lit(AS_OF), F.to_date("o_orderdate")).alias("age_days"), F.to_date("o_orderdate").alias("opened_on"),
        )

    def deliveries() -> DataFrame:
        status = F.when(F.col("event_type") == "error", "failed").when(F.col("value") > 60, "late").otherwise("on_time")
        return t.events.select(
            F.concat(F.lit("S"), F.col("user_id") % 5).alias("source_id"), F.when(F.col("user_id") % 2 == 0, "bank").otherwise("custodian").alias("source_type"), F.col("event_type").alias("feed_type"), status.alias("status"),
            F.to_date("ts").alias("business_date"), F.col("value").alias("latency_min"),
        )

    def runs() -> DataFrame:
        return t.lineitem.groupBy("l_orderkey", "l_returnflag", "l_linestatus").agg(F.count_if(F.col("l_quantity") > 45).cast("int").alias("unmatched"), F.to_date(F.max("l_shipdate")).alias("business_date")).select(
            F.col("l_linestatus").alias("recon_type"), F.when(F.col("l_returnflag") == "A", "Growth").otherwise("Income").alias("fund_group"), F.concat(F.lit("P"), F.col("l_orderkey") % 9).alias("portfolio_id"), "business_date", "unmatched"
        )

    views = {("cashrecon", "breaks"): breaks, ("feedhub", "feed_deliveries"): deliveries, ("assetrecon", "recon_runs"): runs}
    return Engine(t.spark, lambda source, table: views[source, table]() if (source, table) in views else None, as_of=AS_OF, sql_seconds=1800)


_BREAKS = f"""b AS (SELECT CASE WHEN r_name IN ('EUROPE', 'MIDDLE EAST', 'AFRICA') THEN 'EMEA' WHEN r_name = 'ASIA' THEN 'APAC' ELSE 'AMER' END AS region, c_mktsegment AS ccy, o_orderpriority AS break_type,
              CASE o_orderstatus WHEN 'F' THEN 'closed' WHEN 'O' THEN 'open' ELSE 'investigating' END AS status, CAST(o_totalprice AS DECIMAL(20,2)) AS amount, date_diff('day', CAST(o_orderdate AS DATE), DATE '{AS_OF}') AS age_days
              FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
_FEEDS = "f AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'bank' ELSE 'custodian' END AS source_type, CASE WHEN event_type = 'error' THEN 'failed' WHEN value > 60 THEN 'late' ELSE 'on_time' END AS status, event_type AS feed_type, value FROM events)"


@query(f"WITH {_BREAKS} SELECT region, ccy, count(*) AS value FROM b WHERE status <> 'closed' GROUP BY 1, 2")
def k01_open_breaks(t: Tables) -> DataFrame:
    return governed(t).metric(HEAD, "open_breaks", ["region", "ccy"]).frame


@query(f"WITH {_BREAKS} SELECT ccy, avg(age_days) AS value FROM b WHERE status <> 'closed' AND region = 'EMEA' GROUP BY 1")
def k02_avg_break_age(t: Tables) -> DataFrame:
    return governed(t).metric(HEAD, "avg_break_age", ["ccy"], {"region": "EMEA"}).frame


@query(f"WITH {_BREAKS} SELECT region, break_type, count_if(status = 'closed') / count(*) AS value FROM b WHERE region = 'EMEA' GROUP BY 1, 2")
def k03_resolution_as_emea(t: Tables) -> DataFrame:
    """The caller's claims, not a filter, leave one region."""
    return governed(t).metric(EMEA, "break_resolution_rate", ["region", "break_type"]).frame


@query(f"WITH {_BREAKS} SELECT ccy, CAST(sum(amount) AS DOUBLE) AS value FROM b WHERE status <> 'closed' GROUP BY 1")
def k04_open_amount(t: Tables) -> DataFrame:
    return governed(t).metric(HEAD, "open_break_amount", ["ccy"]).frame


@query(f"WITH {_BREAKS} SELECT region, count(*) AS value FROM b WHERE status <> 'closed' AND age_days > 5 AND age_days BETWEEN 1000 AND 1400 GROUP BY 1")
def k05_aged_between(t: Tables) -> DataFrame:
    return governed(t).metric(HEAD, "aged_open_breaks", ["region"], {"age_days": {"between": [1000, 1400]}}).frame


@query(f"WITH {_FEEDS} SELECT source_type, status, count(*) AS value FROM f WHERE status <> 'on_time' GROUP BY 1, 2")
def k06_late_feeds(t: Tables) -> DataFrame:
    return governed(t).metric(HEAD, "late_feeds", ["source_type", "status"]).frame


@query(f"WITH {_FEEDS} SELECT source_type, count_if(status = 'on_time') / count(*) AS value FROM f GROUP BY 1")
def k07_on_time_rate(t: Tables) -> DataFrame:
    return governed(t).metric(HEAD, "feed_on_time_rate", ["source_type"]).frame


@query("""SELECT l_linestatus AS recon_type, CASE l_returnflag WHEN 'A' THEN 'Growth' ELSE 'Income' END AS fund_group, CAST(count_if(l_quantity > 45) AS DOUBLE) AS value FROM lineitem GROUP BY 1, 2""")
def k08_unmatched_items(t: Tables) -> DataFrame:
    return governed(t).metric(HEAD, "recon_unmatched_items", ["recon_type", "fund_group"]).frame


@query(f"WITH {_BREAKS} SELECT region, ccy, CAST(sum(amount) AS DOUBLE) AS total, count(*) AS n FROM b WHERE region = 'EMEA' AND break_type <> '5-LOW' GROUP BY 1, 2")
def k09_free_sql_as_emea(t: Tables) -> DataFrame:
    """Guarded SQL on the caller's own rows, settled, read back from its handle."""
    engine = governed(t)
    made = engine.query(EMEA, "cashrecon", "select region, ccy, cast(sum(amount) as double) as total, count(*) as n from breaks where break_type <> '5-LOW' group by 1, 2")
    return engine.store.get(EMEA.sub, made["handle"]).frame


@query(f"WITH {_BREAKS}, a AS (SELECT ccy, region, CAST(sum(amount) AS DOUBLE) AS value FROM b WHERE status <> 'closed' GROUP BY 1, 2), n AS (SELECT region, count(*) AS value FROM b WHERE status <> 'closed' GROUP BY 1) SELECT a.ccy, a.region, a.value / n.value AS mean FROM a JOIN n ON a.region = n.region")
def k10_combined_metrics(t: Tables) -> DataFrame:
    """Two stored metrics, combined under the lineage rule."""
    engine = governed(t)
    a = engine.run_metric(HEAD, "open_break_amount", ["ccy", "region"])["handle"]
    n = engine.run_metric(HEAD, "open_breaks", ["region"])["handle"]
    made = engine.combine(HEAD, "select a.ccy, a.region, a.value / n.value as mean from a join n on a.region = n.region", {"a": a, "n": n})
    return engine.store.get(HEAD.sub, made["handle"]).frame
