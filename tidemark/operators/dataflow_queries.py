"""Reconciliation dataflows and result shaping on the benchmark tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import recon, shape
from tidemark.registry import Tables, query

AS_OF = date(2001, 8, 1)
_MONEY = "DECIMAL(20,2)"


@query("""SELECT CAST(d AS DATE) AS day, row_number() OVER (ORDER BY d DESC) AS ordinal FROM generate_series(DATE '2001-03-01', DATE '2001-08-01', INTERVAL 1 DAY) g(d) WHERE isodow(d) < 6 QUALIFY ordinal <= 90""")
def d01_business_days(t: Tables) -> DataFrame:
    return recon.business_days(t.spark, 90, AS_OF)


_LINES = "SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) * (1 + CAST(l_tax AS DECIMAL(4,2)))) AS internal FROM lineitem GROUP BY 1"


def _values(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey").agg(F.sum(F.expr("cast(l_extendedprice as decimal(12,2)) * (1 - cast(l_discount as decimal(4,2))) * (1 + cast(l_tax as decimal(4,2)))")).alias("internal"))


@query(f"SELECT o_orderkey, CAST(internal AS DOUBLE) AS internal, round((CAST(internal AS DOUBLE) - o_totalprice) / nullif(o_totalprice, 0) * 10000, 1) AS diff_bps FROM orders JOIN ({_LINES}) ON l_orderkey = o_orderkey")
def d02_nav_bps(t: Tables) -> DataFrame:
    joined = t.orders.join(_values(t), F.expr("l_orderkey = o_orderkey"))
    return joined.select("o_orderkey", F.col("internal").cast("double").alias("internal"), recon.basis_points(F.col("internal").cast("double"), F.col("o_totalprice"), 1).alias("diff_bps"))


_POS = f"SELECT l_partkey, l_suppkey, sum(CAST(l_quantity AS {_MONEY})) AS qty, sum(CAST(l_extendedprice AS {_MONEY})) AS mv FROM lineitem WHERE l_returnflag = '{{}}' GROUP BY 1, 2"


def _positions(t: Tables, flag: str) -> DataFrame:
    money = lambda c: F.sum(F.col(c).cast("decimal(20,2)"))
    return t.lineitem.filter(F.col("l_returnflag") == flag).groupBy("l_partkey", "l_suppkey").agg(money("l_quantity").alias("qty"), money("l_extendedprice").alias("mv"))


@query(f"""SELECT l_partkey, l_suppkey, CAST(coalesce(a.qty, 0) - coalesce(r.qty, 0) AS DOUBLE) AS diff_qty, CAST(coalesce(a.mv, 0) - coalesce(r.mv, 0) AS DOUBLE) AS diff_mv,
           CASE WHEN a.qty IS NULL THEN 'missing_left' WHEN r.qty IS NULL THEN 'missing_right' WHEN abs(a.qty - r.qty) > 5 OR abs(a.mv - r.mv) > 5 THEN 'difference' ELSE 'matched' END AS outcome
           FROM ({_POS.format('A')}) a FULL JOIN ({_POS.format('R')}) r USING (l_partkey, l_suppkey)""")
def d03_position_recon(t: Tables) -> DataFrame:
    found = recon.reconcile(_positions(t, "A"), _positions(t, "R"), ["l_partkey", "l_suppkey"], ["qty", "mv"], 5)
    return found.withColumn("diff_qty", F.col("diff_qty").cast("double")).withColumn("diff_mv", F.col("diff_mv").cast("double"))


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS business_date, event_type, CAST(count_if(value > 90) AS BIGINT) AS unmatched FROM events GROUP BY 1, 2), r AS (SELECT business_date, row_number() OVER (ORDER BY business_date DESC) AS k FROM (SELECT DISTINCT business_date FROM d))
          SELECT business_date, event_type, unmatched, CASE WHEN k = 1 THEN 'in_progress' WHEN k <= 4 AND unmatched > 0 THEN 'open' ELSE 'signed_off' END AS status FROM d JOIN r USING (business_date)""")
def d04_run_status(t: Tables) -> DataFrame:
    runs = t.events.groupBy(F.to_date("ts").alias("business_date"), "event_type").agg(F.count_if(F.col("value") > 90).alias("unmatched"))
    return recon.run_status(runs)


@query(f"""WITH l AS (SELECT l_orderkey AS ref, sum(CAST(l_extendedprice AS {_MONEY})) AS amount, CAST(min(l_shipdate) AS DATE) AS day FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1), s AS (SELECT o_orderkey AS ref, CAST(o_totalprice AS {_MONEY}) AS amount, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderstatus <> 'P')
          SELECT ref, CASE WHEN s.ref IS NULL THEN 'missing_statement' WHEN l.ref IS NULL THEN 'missing_ledger' WHEN abs(l.amount - s.amount) > 100000 THEN 'amount_diff' WHEN abs(date_diff('day', s.day, l.day)) > 60 THEN 'date_diff' ELSE 'matched' END AS outcome
          FROM l FULL JOIN s USING (ref)""".replace("CASE WHEN s.ref IS NULL", "CASE WHEN s.amount IS NULL").replace("WHEN l.ref IS NULL", "WHEN l.amount IS NULL"))
def d05_match_outcomes(t: Tables) -> DataFrame:
    ledger = t.lineitem.filter("l_linestatus = 'F'").groupBy(F.col("l_orderkey").alias("ref")).agg(F.sum(F.col("l_extendedprice").cast("decimal(20,2)")).alias("amount"), F.to_date(F.min("l_shipdate")).alias("day"))
    statement = t.orders.filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("ref"), F.col("o_totalprice").cast("decimal(20,2)").alias("amount"), F.to_date("o_orderdate").alias("day"))
    return recon.match_outcomes(ledger, statement, "ref", "amount", "day", 100000, 60).select("ref", "outcome")


@query(f"""SELECT o_orderstatus, CASE WHEN age <= 365 THEN '0-1y' WHEN age <= 1095 THEN '1-3y' ELSE '3y+' END AS bucket, count(*) AS n, max(age) AS oldest FROM (SELECT o_orderstatus, date_diff('day', CAST(o_orderdate AS DATE), DATE '{AS_OF}') AS age FROM orders) GROUP BY 1, 2""")
def d07_aging_buckets(t: Tables) -> DataFrame:
    aged = t.orders.withColumn("age", recon.age_days(F.to_date("o_orderdate"), None, AS_OF).cast("long"))
    return aged.groupBy("o_orderstatus", F.when(F.col("age") <= 365, "0-1y").when(F.col("age") <= 1095, "1-3y").otherwise("3y+").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.max("age").alias("oldest"))


@query("SELECT o_orderkey, step, CAST(CAST(o_orderdate AS DATE) + d AS DATE) AS at FROM orders, (VALUES ('opened', 0), ('assigned', 1), ('commented', 3), ('closed', 7)) s(step, d)")
def d08_action_log(t: Tables) -> DataFrame:
    return recon.action_log(t.orders.withColumn("opened", F.to_date("o_orderdate")), "o_orderkey", "opened", {"opened": 0, "assigned": 1, "commented": 3, "closed": 7})


@query(f"""SELECT o_orderkey, CAST(closing AS DOUBLE) AS closing, CAST(closing - amount AS DOUBLE) AS opening FROM (SELECT o_orderkey, amount, sum(amount) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS closing
           FROM (SELECT *, CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS {_MONEY}) ELSE -CAST(o_totalprice AS {_MONEY}) END AS amount FROM orders))""")
def d09_running_balance(t: Tables) -> DataFrame:
    amount = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice").cast("decimal(20,2)")).otherwise(-F.col("o_totalprice").cast("decimal(20,2)"))
    found = recon.running_balance(t.orders, "o_custkey", ["o_orderdate", "o_orderkey"], amount)
    return found.select("o_orderkey", F.col("closing").cast("double").alias("closing"), F.col("opening").cast("double").alias("opening"))


_QUOTES = "SELECT l_partkey, l_suppkey, max(l_extendedprice / l_quantity) AS price FROM lineitem GROUP BY 1, 2"


def _quotes(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_partkey", "l_suppkey").agg(F.max(F.expr("l_extendedprice / l_quantity")).alias("price"))


@query(f"SELECT l_partkey, arg_min(l_suppkey, (-s_acctbal, l_suppkey)) AS l_suppkey, arg_min(price, (-s_acctbal, l_suppkey)) AS golden FROM ({_QUOTES}) JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1")
def d10_golden_vendor(t: Tables) -> DataFrame:
    ranked = _quotes(t).join(t.supplier, F.expr("s_suppkey = l_suppkey")).withColumn("rank", -F.col("s_acctbal"))
    return recon.golden_vendor(ranked, ["l_partkey"], "l_suppkey", ["rank", "l_suppkey"], "price")


@query("""WITH q AS (SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, l_shipdate, l_quantity, l_extendedprice, CASE WHEN l_quantity = 13 THEN NULL ELSE round(l_extendedprice / l_quantity, 4) END AS quote FROM lineitem),
          b AS (SELECT *, lag(quote) OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_suppkey, l_linenumber, l_extendedprice, l_quantity) AS before FROM q),
          k AS (SELECT l_orderkey, l_partkey, l_suppkey, quote, round((quote - p_retailprice) / p_retailprice * 100, 4) AS deviation_pct, CASE WHEN quote IS NULL THEN 'missing' WHEN abs(round((quote - p_retailprice) / p_retailprice * 100, 4)) > 90 THEN 'conflict' WHEN abs(quote - before) / before * 100 > 50 THEN 'spike' WHEN quote = before THEN 'stale' END AS kind FROM b JOIN part ON p_partkey = l_partkey)
          SELECT kind, count(*) AS n, round(max(deviation_pct), 3) AS top FROM k WHERE kind IS NOT NULL GROUP BY 1""")
def d11_price_suspects(t: Tables) -> DataFrame:
    w = Window.partitionBy("l_partkey").orderBy("l_shipdate", "l_orderkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_quantity")
    quoted = t.lineitem.withColumn("quote", F.when(F.col("l_quantity") != 13, F.round(F.expr("l_extendedprice / l_quantity"), 4))).withColumn("before", F.lag("quote").over(w))
    joined = quoted.join(t.part, F.expr("p_partkey = l_partkey"))
    found = recon.price_suspects(joined, F.col("p_retailprice"), F.col("quote"), F.col("before"), 90, 50)
    return found.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("deviation_pct"), 3).alias("top"))


@query("""WITH c AS (SELECT CAST(ts AS DATE) AS day, count(*) AS acquired, CAST(count_if(event_type <> 'error') AS BIGINT) AS validated, CAST(count_if(value > 90) AS BIGINT) AS suspect, CAST(count_if(event_type = 'purchase') AS BIGINT) AS distributed FROM events GROUP BY 1)
          SELECT day, stage, n, n / nullif(acquired, 0) AS share FROM (SELECT day, acquired, unnest(['acquired', 'validated', 'suspect', 'distributed']) AS stage, unnest([acquired, validated, suspect, distributed]) AS n FROM c)""")
def d12_funnel_unpivot(t: Tables) -> DataFrame:
    made = t.events.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("acquired"), F.count_if(F.col("event_type") != "error").alias("validated"), F.count_if(F.col("value") > 90).alias("suspect"), F.count_if(F.col("event_type") == "purchase").alias("distributed"))
    return recon.funnel(made, "day", ["acquired", "validated", "suspect", "distributed"])


@query("""SELECT event_type, CAST(count_if(d < 7) AS BIGINT) AS now, CAST(count_if(d >= 7) AS BIGINT) AS before, (count_if(d < 7) - count_if(d >= 7)) / nullif(count_if(d >= 7), 0) AS change FROM (SELECT event_type, date_diff('day', CAST(ts AS DATE), DATE '2024-01-28') AS d FROM events) WHERE d BETWEEN 0 AND 13 GROUP BY 1""")
def d13_week_over_week(t: Tables) -> DataFrame:
    return recon.change_over(t.events, "ts", date(2024, 1, 28), 7, ["event_type"])


@query("SELECT p_partkey, CASE WHEN p_brand = 'Brand#13' THEN p_retailprice / 2 ELSE p_retailprice END AS p_retailprice, CASE WHEN p_brand = 'Brand#13' THEN p_size * 2 ELSE p_size END AS p_size FROM part UNION ALL SELECT s_suppkey + 1000000, s_acctbal, 0 FROM supplier WHERE s_nationkey = 3")
def d14_conditional_overlay(t: Tables) -> DataFrame:
    more = t.supplier.filter("s_nationkey = 3").select((F.col("s_suppkey") + 1000000).alias("p_partkey"), F.col("s_acctbal").alias("p_retailprice"), F.lit(0).alias("p_size"))
    base = t.part.select("p_partkey", "p_brand", "p_retailprice", "p_size")
    return recon.overlay(base, F.col("p_brand") == "Brand#13", {"p_retailprice": F.col("p_retailprice") / 2, "p_size": F.col("p_size") * 2}, more).drop("p_brand")


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'signup' THEN 'missing' WHEN value > 60 THEN 'late' ELSE 'on_time' END AS status, CASE WHEN event_type NOT IN ('error', 'signup') AND value > 60 THEN CAST(floor(value) AS DOUBLE) END AS late_min FROM events")
def d15_feed_sla(t: Tables) -> DataFrame:
    expected = F.to_timestamp(F.lit("2024-01-01 08:00:00"))
    delivered = F.when(F.col("event_type") != "signup", F.timestamp_seconds(F.unix_timestamp(expected) + F.floor("value") * 60))
    # minutes are whole here, so that what is over an hour by less than a minute is late beyond a grace of 59
    status, late = recon.sla_status(delivered, expected, F.col("event_type") == "error", 59)
    over = (status != "late") | (F.col("value") > 60)
    return t.events.select("event_id", F.when(over, status).otherwise("on_time").alias("status"), F.when(over, late).alias("late_min"))


@query("SELECT user_id, event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS v FROM (SELECT user_id, event_id, ts, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS v FROM events)")
def d16_carry_forward(t: Tables) -> DataFrame:
    gaps = t.events.withColumn("v", F.when(F.col("event_type") != "error", F.col("value")))
    return recon.carry_forward(gaps, ["user_id"], ["ts", "event_id"], "v").select("user_id", "event_id", "v")


@query("SELECT l_partkey AS part, count(DISTINCT l_suppkey) AS holders FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_type = 'PROMO') AND l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 49) GROUP BY 1 ORDER BY holders DESC, part LIMIT 1")
def d17_incident_pick(t: Tables) -> DataFrame:
    held = t.lineitem.select(F.col("l_partkey").alias("part"), "l_suppkey")
    late = t.lineitem.filter("l_returnflag = 'A' and l_quantity > 49").select(F.col("l_partkey").alias("part"))
    return recon.incident_pick(held, t.part.filter("p_type = 'PROMO'").select(F.col("p_partkey").alias("part")), late, "part", "l_suppkey")


_ENTRIES = f"""l AS (SELECT 'ledger' AS side, l_orderkey * 100 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS entry, l_orderkey AS ref, CAST(l_extendedprice AS {_MONEY}) AS amount, CAST(l_shipdate AS DATE) AS day FROM lineitem),
          s AS (SELECT 'statement' AS side, l_orderkey * 100 + ascii(l_returnflag) AS entry, l_orderkey AS ref, sum(CAST(l_extendedprice AS {_MONEY})) AS amount, CAST(min(l_shipdate) AS DATE) AS day FROM lineitem WHERE l_quantity < 48 GROUP BY l_orderkey, l_returnflag)"""


@query(f"""WITH {_ENTRIES}, e0 AS (SELECT * FROM l UNION ALL SELECT * FROM s), k1 AS (SELECT *, row_number() OVER (PARTITION BY side, ref ORDER BY amount, day, entry) AS k FROM e0),
          p1 AS (SELECT ref, k FROM k1 GROUP BY 1, 2 HAVING count(*) = 2 AND max(amount) = min(amount) AND max(day) = min(day)), m1 AS (SELECT 'MR01' AS rule, side, entry, ref FROM k1 SEMI JOIN p1 USING (ref, k)), e1 AS (SELECT * FROM e0 ANTI JOIN m1 USING (side, entry, ref)),
          p2 AS (SELECT ref FROM e1 GROUP BY 1 HAVING count_if(side = 'statement') = 1 AND count_if(side = 'ledger') >= 1 AND sum(CASE side WHEN 'ledger' THEN amount ELSE -amount END) = 0 AND date_diff('day', min(day), max(day)) <= 400), m2 AS (SELECT 'MR04' AS rule, side, entry, ref FROM e1 SEMI JOIN p2 USING (ref)), e2 AS (SELECT * FROM e1 ANTI JOIN m2 USING (side, entry, ref)),
          p3 AS (SELECT ref FROM e2 GROUP BY 1 HAVING count_if(side = 'statement') >= 1 AND count_if(side = 'ledger') >= 1 AND sum(CASE side WHEN 'ledger' THEN amount ELSE -amount END) = 0), m3 AS (SELECT 'MR05' AS rule, side, entry, ref FROM e2 SEMI JOIN p3 USING (ref))
          SELECT * FROM m1 UNION ALL SELECT * FROM m2 UNION ALL SELECT * FROM m3""")
def d06_match_rules(t: Tables) -> DataFrame:
    """Rules in turn: one to one, one to many within days, many to many by sums. Lines are dealt once, by order: an order's first line of a flag
    carries the statement entry of that flag."""
    number = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"))
    lines = t.lineitem.filter("l_orderkey is not null").withColumn("number", number)
    money, counts, flag = F.col("l_extendedprice").cast("decimal(20,2)"), F.col("l_quantity") < 48, Window.partitionBy("l_orderkey", "l_returnflag")
    lines = lines.withColumns({
        "total": F.sum(F.when(counts, money)).over(flag), "first": F.min(F.when(counts, F.col("l_shipdate"))).over(flag),
        "some": F.max(F.coalesce(counts, F.lit(False))).over(flag), "top": F.min("number").over(flag) == F.col("number"),
    })
    entry = lambda side, plus, amount, day: F.struct(F.lit(side).alias("side"), (F.col("l_orderkey") * 100 + plus).alias("entry"), amount.cast("decimal(30,2)").alias("amount"), F.to_date(day).alias("day"))
    ledger, statement = entry("ledger", F.col("number"), money, "l_shipdate"), entry("statement", F.ascii("l_returnflag"), F.col("total"), "first")
    entries = lines.select(F.col("l_orderkey").alias("ref"), F.inline(F.when(F.col("some") & F.col("top"), F.array(ledger, statement)).otherwise(F.array(ledger))))
    return recon.match_entries(entries, (recon.MatchRule("MR01", "1:1"), recon.MatchRule("MR04", "1:N", 0.0, 400), recon.MatchRule("MR05", "N:M", 0.0, None)))


_STAGES = ["acquired", "validated", "suspect", "approved", "distributed"]


@query(f"""WITH c AS (SELECT CAST(ts AS DATE) AS day, count(*) AS acquired, CAST(count_if(event_type <> 'error') AS BIGINT) AS other FROM events GROUP BY 1), st AS (SELECT day, acquired AS whole, unnest({_STAGES}) AS stage, unnest([acquired, other, acquired - other, other, other]) AS n FROM c),
          w AS (SELECT min(day) AS first, max(day) AS last FROM (SELECT DISTINCT day FROM c ORDER BY day DESC LIMIT 10)), x AS (SELECT CAST(ts AS DATE) AS day, count(*) AS k FROM events WHERE value > 80 GROUP BY 1)
          SELECT day, stage, CAST(CASE WHEN day < first OR stage = 'acquired' THEN n WHEN stage = 'validated' THEN whole - coalesce(k, 0) WHEN stage = 'suspect' THEN coalesce(k, 0)
                 ELSE whole - coalesce(k, 0) + CASE WHEN day < last THEN CAST(floor(coalesce(k, 0) * CAST(0.8 AS DOUBLE)) AS BIGINT) ELSE 0 END END AS BIGINT) AS n FROM st LEFT JOIN x USING (day), w""")
def d18_funnel_window(t: Tables) -> DataFrame:
    """Stage counts of the last ten days follow from the suspects of those days."""
    counted = t.events.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("acquired"), F.count_if(F.col("event_type") != "error").alias("validated"))
    counted = counted.withColumns({"suspect": F.col("acquired") - F.col("validated"), "approved": F.col("validated"), "distributed": F.col("validated")})
    return recon.recount_funnel(counted.unpivot(["day"], _STAGES, "stage", "n"), t.events.filter("value > 80").select(F.to_date("ts").alias("day")), 10)


@query("SELECT user_id, event_id, round(100 * exp(CAST(sum(CAST((value - 50) / 1000 AS DECIMAL(12,6))) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS DOUBLE)), 4) AS price FROM events")
def d19_price_walk(t: Tables) -> DataFrame:
    step = F.expr("cast((value - 50) / 1000 as decimal(12,6))")
    walked = recon.price_walk(t.events, ["user_id"], ["ts", "event_id"], F.lit(100.0), step)
    return walked.select("user_id", "event_id", F.round("price", 4).alias("price"))


@query("SELECT count(*) AS n, min(id) AS first, max(id) AS last, count(DISTINCT id) AS ids FROM (SELECT (SELECT max(p_partkey) FROM part) + row_number() OVER () AS id FROM customer)")
def d20_continue_ids(t: Tables) -> DataFrame:
    """Customers numbered on from the largest part: which customer gets which number is free, the numbers are not."""
    made = recon.continue_ids(t.part.select(F.col("p_partkey").alias("id")), t.customer.select("c_custkey"), "id", ["c_custkey"])
    return made.agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), F.max("id").alias("last"), F.count_distinct("id").alias("ids"))


@query("""WITH r AS (SELECT o_orderkey AS a, o_orderstatus AS b, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS c FROM orders)
          SELECT count(*) AS n, CAST(CAST(sum(CAST(CAST('0x' || md5(concat_ws('|', length(a::VARCHAR) || ':' || a, length(b) || ':' || b, coalesce(length(c) || ':' || c, '-')))[:15] AS BIGINT) AS HUGEINT)) AS DECIMAL(38,0)) AS VARCHAR) AS digest FROM r""")
def d21_table_digest(t: Tables) -> DataFrame:
    return recon.table_digest(t.orders.select(F.col("o_orderkey").alias("a"), F.col("o_orderstatus").alias("b"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")).alias("c")))


# ---- shaping ----


@query("SELECT o_orderstatus, sum(n) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent, sum(n) FILTER (WHERE o_orderpriority = '5-LOW') AS low FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1".replace("sum(n) FILTER (WHERE o_orderpriority = '1-URGENT')", "CAST(sum(n) FILTER (WHERE o_orderpriority = '1-URGENT') AS BIGINT)").replace("sum(n) FILTER (WHERE o_orderpriority = '5-LOW')", "CAST(sum(n) FILTER (WHERE o_orderpriority = '5-LOW') AS BIGINT)"))
def s01_pivot(t: Tables) -> DataFrame:
    n = t.orders.groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return shape.pivot(n, "o_orderstatus", "o_orderpriority", "n", {"1-URGENT": "urgent", "5-LOW": "low"})


@query("SELECT c_nationkey, c_custkey, c_acctbal FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) <= 3")
def s02_top_n_per_group(t: Tables) -> DataFrame:
    return shape.top_per_group(t.customer.select("c_nationkey", "c_custkey", "c_acctbal"), ["c_nationkey"], [F.col("c_acctbal").desc(), F.col("c_custkey")], 3)


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1")
def s03_nearest_rank_pct(t: Tables) -> DataFrame:
    return shape.nearest_rank(t.events, ["event_type"], "value", {"p50": 0.5, "p95": 0.95})


@query(f"""WITH g AS (SELECT o_custkey AS k, CAST(sum(CAST(o_totalprice AS {_MONEY})) AS DOUBLE) AS v FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1), h AS (SELECT o_custkey AS k, CAST(sum(CAST(o_totalprice AS {_MONEY})) AS DOUBLE) AS v FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1)
           SELECT coalesce(g.k, h.k) AS k, g.v IS NOT NULL AND h.v IS NOT NULL AND abs(g.v - h.v) <= 1e-6 * greatest(abs(g.v), abs(h.v)) AS same FROM g FULL JOIN h ON g.k = h.k""")
def s04_rows_match(t: Tables) -> DataFrame:
    side = lambda c: t.orders.filter(c).groupBy(F.col("o_custkey").alias("k")).agg(F.sum(F.col("o_totalprice").cast("decimal(20,2)")).cast("double").alias("v"))
    return shape.rows_compared(side("o_orderstatus <> 'P'"), side("o_orderpriority <> '5-LOW'"), ["k"], ["v"]).select("k", "same")


@query("SELECT source, count(*) AS n, array_to_string(list_sort(list(DISTINCT lang)), ',') AS access FROM documents GROUP BY 1")
def s05_source_usage(t: Tables) -> DataFrame:
    return shape.source_usage(t.documents, "source", "lang")


@query("SELECT l_returnflag AS x, l_linestatus AS y, count(*) AS z, min(count(*)) OVER () AS low, max(count(*)) OVER () AS high FROM lineitem GROUP BY 1, 2")
def s06_heatmap(t: Tables) -> DataFrame:
    return shape.heatmap(t.lineitem.groupBy(F.col("l_returnflag").alias("x"), F.col("l_linestatus").alias("y")).agg(F.count(F.lit(1)).alias("z")), "z")


@query("SELECT l_returnflag AS model, round(CAST(sum(CAST(l_quantity * price AS DECIMAL(20,4))) AS DOUBLE), 2) AS cost FROM lineitem JOIN (VALUES ('A', 0.25), ('R', 1.5), ('N', 3.0)) v(m, price) ON l_returnflag = m GROUP BY 1")
def s07_cost_by_model(t: Tables) -> DataFrame:
    prices = {"A": 0.25, "R": 1.5, "N": 3.0}
    return shape.cost(t.lineitem, "l_returnflag", "l_quantity", prices).withColumnRenamed("l_returnflag", "model").withColumn("cost", F.round("cost", 2))


@query("SELECT count(*) AS n FROM events WHERE event_type IN ('view', 'click') AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 95)")
def s08_leak_check(t: Tables) -> DataFrame:
    bad = t.events.filter("event_type = 'purchase' and value > 95").select("user_id")
    return t.events.filter("event_type in ('view', 'click')").join(bad, "user_id", "left_anti").agg(F.count(F.lit(1)).alias("n"))
