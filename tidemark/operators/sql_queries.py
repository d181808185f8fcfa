"""The executed SQL surface: joins, windows, sets, grouping, functions; and combinations of earlier results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.combine import Handle
from tidemark.registry import Tables, query

# ---- joins ----


@query("""SELECT o_orderkey, n FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey ORDER BY n DESC NULLS LAST, o_orderkey LIMIT 100""")
def q01_left_nulls_last(t: Tables) -> DataFrame:
    n = t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return t.orders.join(n, F.expr("l_orderkey = o_orderkey"), "left").select("o_orderkey", "n").orderBy(F.col("n").desc_nulls_last(), "o_orderkey").limit(100)


_SIDES = "SELECT l_partkey AS part, l_suppkey AS supp, sum(CAST(l_quantity AS DECIMAL(20,2))) AS qty FROM lineitem WHERE l_returnflag = '{}' GROUP BY 1, 2"


@query(f"""SELECT coalesce(a.part, r.part) AS part, coalesce(a.supp, r.supp) AS supp, CAST(coalesce(a.qty, 0) - coalesce(r.qty, 0) AS DOUBLE) AS diff, a.qty IS NULL AS no_a, r.qty IS NULL AS no_r
           FROM ({_SIDES.format('A')}) a FULL OUTER JOIN ({_SIDES.format('R')}) r ON a.part = r.part AND a.supp = r.supp""")
def q02_full_outer(t: Tables) -> DataFrame:
    side = lambda flag: t.lineitem.filter(F.col("l_returnflag") == flag).groupBy(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp")).agg(F.sum(F.col("l_quantity").cast("decimal(20,2)")).alias(flag))
    zero = F.lit(0).cast("decimal(20,2)")
    return side("A").join(side("R"), ["part", "supp"], "full_outer").select("part", "supp", (F.coalesce("A", zero) - F.coalesce("R", zero)).cast("double").alias("diff"), F.col("A").isNull().alias("no_a"), F.col("R").isNull().alias("no_r"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 200000)")
def q03_semi_in(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.filter("o_orderpriority = '1-URGENT' and o_totalprice > 200000"), F.expr("c_custkey = o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o.o_orderkey)")
def q04_anti_exists(t: Tables) -> DataFrame:
    return t.orders.join(t.lineitem, F.expr("o_orderkey = l_orderkey"), "left_anti").select("o_orderkey")


@query("SELECT c_custkey, m.top AS top FROM customer c, LATERAL (SELECT max(o_totalprice) AS top FROM orders WHERE o_custkey = c.c_custkey) m")
def q05_lateral_max(t: Tables) -> DataFrame:
    return t.guarded("select c_custkey, m.top from customer c, lateral (select max(o_totalprice) as top from orders where o_custkey = c.c_custkey) m", "customer", "orders")


@query("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c.c_custkey) AS n, (SELECT max(o_orderdate) FROM orders) AS last FROM customer c")
def q06_scalar_corr(t: Tables) -> DataFrame:
    return t.guarded("select c_custkey, (select count(*) from orders where o_custkey = c.c_custkey) as n, (select max(o_orderdate) from orders) as last from customer c", "customer", "orders")


@query("SELECT r_name, n_name, c_name FROM region JOIN nation ON n_regionkey = r_regionkey AND n_nationkey > 5 JOIN customer ON c_nationkey = n_nationkey AND c_acctbal < n_nationkey * 100")
def q34_join_on_theta(t: Tables) -> DataFrame:
    return t.region.join(t.nation, F.expr("n_regionkey = r_regionkey and n_nationkey > 5")).join(t.customer, F.expr("c_nationkey = n_nationkey and c_acctbal < n_nationkey * 100")).select("r_name", "n_name", "c_name")


# ---- windows ----


@query("SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS rnk FROM orders")
def q07_rank(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.rank().over(Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc())).cast("long").alias("rnk"))


@query("SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(20,2))) OVER (PARTITION BY o_custkey) AS DOUBLE) AS whole FROM orders")
def q08_sum_over(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.sum(F.col("o_totalprice").cast("decimal(20,2)")).over(Window.partitionBy("o_custkey")).cast("double").alias("whole"))


@query("""SELECT user_id, event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS ma5 FROM events""")
def q09_rows_frame_ma5(t: Tables) -> DataFrame:
    return t.events.select("user_id", "event_id", F.round(F.avg("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-4, 0)), 6).alias("ma5"))


@query("SELECT user_id, event_id, lag(value) OVER w AS before, lead(event_type, 2, 'none') OVER w AS later FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def q10_lag(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.select("user_id", "event_id", F.lag("value").over(w).alias("before"), F.lead("event_type", 2, "none").over(w).alias("later"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def q11_rownum_latest(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return t.events.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("user_id", "event_id", "event_type")


@query("""SELECT s_suppkey, row_number() OVER w AS a, rank() OVER w AS b, dense_rank() OVER w AS c, percent_rank() OVER w AS d, cume_dist() OVER w AS e, ntile(4) OVER w AS f,
          first_value(s_suppkey) OVER w AS g, last_value(s_suppkey) OVER w AS h, nth_value(s_suppkey, 2) OVER w AS i FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_suppkey)""")
def q12_all_rank_fns(t: Tables) -> DataFrame:
    w = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    whole = {"a": F.row_number(), "b": F.rank(), "c": F.dense_rank(), "f": F.ntile(4)}
    other = {"d": F.percent_rank(), "e": F.cume_dist(), "g": F.first("s_suppkey"), "h": F.last("s_suppkey"), "i": F.nth_value("s_suppkey", 2)}
    return t.supplier.select("s_suppkey", *(f.over(w).cast("long").alias(k) for k, f in whole.items()), *(f.over(w).alias(k) for k, f in other.items()))


# ---- sets, grouping ----


@query("SELECT c_nationkey AS k, 'c' AS side FROM customer UNION ALL SELECT s_nationkey, 's' FROM supplier")
def q13_union_all(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_nationkey").alias("k"), F.lit("c").alias("side")).unionAll(t.supplier.select("s_nationkey", F.lit("s")))


@query("SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def q14_except(t: Tables) -> DataFrame:
    return t.orders.filter("o_orderstatus = 'O'").select(F.col("o_custkey").alias("k")).subtract(t.orders.filter("o_orderpriority = '1-URGENT'").select("o_custkey"))


@query("SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'P' INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW'")
def q15_intersect(t: Tables) -> DataFrame:
    return t.orders.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k")).intersect(t.orders.filter("o_orderpriority = '5-LOW'").select("o_custkey"))


@query("SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer")
def q35_union_distinct(t: Tables) -> DataFrame:
    return t.supplier.select(F.col("s_nationkey").alias("k")).union(t.customer.select("c_nationkey")).distinct()


@query("SELECT l_returnflag, l_linestatus, grouping(l_linestatus) AS whole, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def q16_rollup(t: Tables) -> DataFrame:
    return t.lineitem.rollup("l_returnflag", "l_linestatus").agg(F.grouping("l_linestatus").cast("long").alias("whole"), F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def q17_grouping_sets(t: Tables) -> DataFrame:
    return t.guarded("select o_orderstatus, o_orderpriority, count(*) as n from orders group by grouping sets ((o_orderstatus), (o_orderpriority), ())", "orders")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def q18_cube(t: Tables) -> DataFrame:
    return t.orders.cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderpriority, round(percentile_cont(0.9) WITHIN GROUP (ORDER BY o_totalprice), 4) AS p90, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY o_totalprice), 4) AS p50 FROM orders GROUP BY 1")
def q19_percentile_cont(t: Tables) -> DataFrame:
    return t.guarded("select o_orderpriority, round(percentile_cont(0.9) within group (order by o_totalprice), 4) as p90, round(percentile_cont(0.5) within group (order by o_totalprice), 4) as p50 from orders group by 1", "orders")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12")
def q20_having(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).filter("n > 12")


@query("SELECT CASE WHEN o_totalprice < 50000 THEN 'small' WHEN o_totalprice < 200000 THEN 'mid' ELSE 'big' END AS bucket, count(*) AS n FROM orders GROUP BY 1")
def q21_case_bucket(t: Tables) -> DataFrame:
    bucket = F.when(F.col("o_totalprice") < 50000, "small").when(F.col("o_totalprice") < 200000, "mid").otherwise("big")
    return t.orders.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(date_trunc('week', max(o_orderdate)) AS DATE) AS week, count(*) AS n FROM orders GROUP BY 1")
def q22_date_trunc(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.to_date(F.date_trunc("month", "o_orderdate")).alias("month")).agg(F.to_date(F.date_trunc("week", F.max("o_orderdate"))).alias("week"), F.count(F.lit(1)).alias("n"))


@query(r"SELECT p_partkey, regexp_replace(p_brand, '[0-9]+', '#', 'g') AS masked, regexp_extract(p_brand, '([0-9]+)', 1) AS digits FROM part WHERE regexp_matches(p_brand, '[13579]$')")
def q23_regexp(t: Tables) -> DataFrame:
    return t.part.filter(F.col("p_brand").rlike("[13579]$")).select("p_partkey", F.regexp_replace("p_brand", "[0-9]+", "#").alias("masked"), F.regexp_extract("p_brand", "([0-9]+)", 1).alias("digits"))


@query("WITH RECURSIVE r(n, total) AS (SELECT CAST(1 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT n + 1, total + n + 1 FROM r WHERE n < 40) SELECT n, total FROM r")
def q24_recursive_cte(t: Tables) -> DataFrame:
    return t.guarded("with recursive r(n, total) as (select 1L, 1L union all select n + 1, total + n + 1 from r where n < 40) select n, total from r")


@query("""SELECT p_partkey, abs(-p_size) AS a, round(p_retailprice / 7, 4) AS b, CAST(floor(p_retailprice) AS BIGINT) AS c, CAST(ceil(p_retailprice) AS BIGINT) AS d, CAST(sign(p_size - 25) AS DOUBLE) AS e, round(sqrt(p_size), 6) AS f,
          round(pow(p_size, 2), 2) AS g, round(ln(p_size + 1), 6) AS h, round(log10(p_size + 1), 6) AS i, round(exp(p_size / 50.0), 6) AS j, greatest(p_size, 10) AS k, least(p_size, 10) AS l, nullif(p_size, 7) AS m, coalesce(nullif(p_size, 7), -1) AS n FROM part""")
def q25_scalar_math(t: Tables) -> DataFrame:
    p, s = F.col("p_retailprice"), F.col("p_size")
    made = {
        "a": F.abs(-s), "b": F.round(p / 7, 4), "c": F.floor(p), "d": F.ceil(p), "e": F.signum((s - 25).cast("double")), "f": F.round(F.sqrt(s), 6), "g": F.round(F.pow(s, F.lit(2)), 2), "h": F.round(F.ln(s + 1), 6), "i": F.round(F.log10(s + 1), 6), "j": F.round(F.exp(s / 50.0), 6),
        "k": F.greatest(s, F.lit(10)), "l": F.least(s, F.lit(10)), "m": F.nullif(s, F.lit(7)), "n": F.coalesce(F.nullif(s, F.lit(7)), F.lit(-1)),
    }
    return t.part.select("p_partkey", *(c.alias(k) for k, c in made.items()))


@query("""SELECT c_custkey, upper(c_name) AS a, lower(c_name) AS b, length(c_name) AS c, substring(c_name, 2, 4) AS d, trim('  ' || c_name || ' ') AS e, c_name || '-' || c_mktsegment AS f, replace(c_name, '0', 'o') AS g,
          starts_with(c_name, 'Cust') AS h, left(c_name, 3) AS i, right(c_name, 3) AS j, contains(c_mktsegment, 'BUILD') AS k, TRY_CAST(right(c_name, 3) AS INTEGER) AS l, strftime(DATE '2024-03-09', '%Y-%m') AS m FROM customer""")
def q26_scalar_string(t: Tables) -> DataFrame:
    n = F.col("c_name")
    made = {
        "a": F.upper(n), "b": F.lower(n), "c": F.length(n).cast("long"), "d": F.substring(n, 2, 4), "e": F.trim(F.concat(F.lit("  "), n, F.lit(" "))), "f": F.concat_ws("-", n, "c_mktsegment"), "g": F.replace(n, F.lit("0"), F.lit("o")), "h": F.startswith(n, F.lit("Cust")),
        "i": F.left(n, F.lit(3)), "j": F.right(n, F.lit(3)), "k": F.contains(F.col("c_mktsegment"), F.lit("BUILD")), "l": F.right(n, F.lit(3)).try_cast("int"), "m": F.date_format(F.lit("2024-03-09").cast("date"), "yyyy-MM"),
    }
    return t.customer.select("c_custkey", *(c.alias(k) for k, c in made.items()))


@query("SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS closed, CAST(sum(CAST(o_totalprice AS DECIMAL(20,2))) FILTER (WHERE o_orderstatus = 'O') AS DOUBLE) AS open_sum FROM orders GROUP BY 1")
def q27_filter_agg(t: Tables) -> DataFrame:
    return t.guarded("select o_orderpriority, count(*) filter (where o_orderstatus = 'F') as closed, cast(sum(cast(o_totalprice as decimal(20,2))) filter (where o_orderstatus = 'O') as double) as open_sum from orders group by 1", "orders")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def q28_group_by_all(t: Tables) -> DataFrame:
    return t.guarded("select o_orderstatus, o_orderpriority, count(*) as n from orders group by all", "orders")


@query("""SELECT s_nationkey, round(median(s_acctbal), 4) AS a, round(stddev_samp(s_acctbal), 4) AS b, round(stddev_pop(s_acctbal), 4) AS c, round(var_samp(s_acctbal), 2) AS d, round(var_pop(s_acctbal), 2) AS e, CAST(count_if(s_acctbal > 0) AS BIGINT) AS f, min(s_acctbal) AS g, max(s_acctbal) AS h, any_value(s_nationkey) AS i FROM supplier GROUP BY 1""")
def q29_stat_aggs(t: Tables) -> DataFrame:
    b = F.col("s_acctbal")
    made = {"a": F.round(F.median(b), 4), "b": F.round(F.stddev_samp(b), 4), "c": F.round(F.stddev_pop(b), 4), "d": F.round(F.var_samp(b), 2), "e": F.round(F.var_pop(b), 2), "f": F.count_if(b > 0), "g": F.min(b), "h": F.max(b), "i": F.any_value("s_nationkey")}
    return t.supplier.groupBy("s_nationkey").agg(*(c.alias(k) for k, c in made.items()))


@query("SELECT event_id, json_extract_string(json_object('user', user_id, 'tags', json_array(event_type, 'x')), '$.tags[0]') AS tag, CAST(json_array_length(json_array(1, 2, user_id)) AS BIGINT) AS n FROM events")
def q30_json_extract(t: Tables) -> DataFrame:
    made = F.to_json(F.struct(F.col("user_id").alias("user"), F.array("event_type", F.lit("x")).alias("tags")))
    return t.events.select("event_id", F.get_json_object(made, "$.tags[0]").alias("tag"), F.json_array_length(F.to_json(F.array(F.lit(1), F.lit(2), "user_id"))).cast("long").alias("n"))


@query("SELECT o_orderkey, label FROM orders JOIN (VALUES ('F', 'closed'), ('O', 'open')) v(code, label) ON o_orderstatus = code")
def q31_values_join(t: Tables) -> DataFrame:
    return t.guarded("select o_orderkey, label from orders join (values ('F', 'closed'), ('O', 'open')) v(code, label) on o_orderstatus = code", "orders")


@query("SELECT CAST(d AS DATE) AS day, x FROM generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY) g(d), unnest([1, 2, 3]) u(x)")
def q32_series(t: Tables) -> DataFrame:
    return t.guarded("select day, x from (select explode(sequence(date'2024-01-01', date'2024-01-31')) as day), (select explode(array(1, 2, 3)) as x)")


@query("SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def q33_distinct(t: Tables) -> DataFrame:
    return t.customer.select("c_nationkey", "c_mktsegment").distinct()


@query("""SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS epoch, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS days, year(ts) AS y, month(ts) AS m, day(ts) AS d, quarter(ts) AS q, CAST(CAST(ts AS DATE) + INTERVAL 3 DAY AS DATE) AS later FROM events""")
def q36_dates(t: Tables) -> DataFrame:
    ts = F.col("ts")
    seconds = F.unix_date(F.to_date(ts)).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)  # whatever the session's time zone
    made = {"epoch": seconds, "days": F.datediff(F.to_date(ts), F.lit("2024-01-01").cast("date")).cast("long"), "y": F.year(ts).cast("long"), "m": F.month(ts).cast("long"), "d": F.day(ts).cast("long"), "q": F.quarter(ts).cast("long"), "later": F.date_add(F.to_date(ts), 3)}
    return t.events.select("event_id", *(c.alias(k) for k, c in made.items()))


# ---- combine: results of several sources ----


def _by_nation(t: Tables) -> tuple[DataFrame, DataFrame]:
    return t.customer.groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("customers")), t.supplier.groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("suppliers"))


_A, _B = "(SELECT c_nationkey AS k, count(*) AS customers FROM customer GROUP BY 1)", "(SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier GROUP BY 1)"


@query(f"SELECT a.k, customers, suppliers FROM {_A} a JOIN {_B} b ON a.k = b.k")
def c01_two_handles(t: Tables) -> DataFrame:
    a, b = _by_nation(t)
    return t.combined("select a.k, customers, suppliers from a join b on a.k = b.k", a=a, b=b)


@query(f"SELECT n_name, coalesce(suppliers, 0) AS suppliers FROM nation LEFT JOIN (SELECT * FROM {_B} WHERE suppliers > 3) b ON n_nationkey = b.k")
def c02_left_coalesce(t: Tables) -> DataFrame:
    b = _by_nation(t)[1].filter("suppliers > 3")
    return t.combined("select n_name, coalesce(suppliers, 0) as suppliers from n left join b on n_nationkey = b.k", n=t.nation, b=b)


@query(f"""SELECT n_name, r_name, customers, coalesce(suppliers, 0) AS suppliers, coalesce(orders, 0) AS orders, coalesce(urgent, 0) AS urgent FROM nation JOIN region ON n_regionkey = r_regionkey JOIN {_A} a ON a.k = n_nationkey LEFT JOIN {_B} b ON b.k = n_nationkey
           LEFT JOIN (SELECT c_nationkey AS k, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) o ON o.k = n_nationkey
           LEFT JOIN (SELECT c_nationkey AS k, count(*) AS urgent FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT' GROUP BY 1) u ON u.k = n_nationkey""")
def c03_chain_six(t: Tables) -> DataFrame:
    """Six results in one statement; both counts of orders come from one pass."""
    a, b = _by_nation(t)
    placed = t.orders.join(t.customer, F.expr("o_custkey = c_custkey")).groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("orders"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"))
    return t.combined(
        """select n_name, r_name, customers, coalesce(suppliers, 0) as suppliers, coalesce(orders, 0) as orders, coalesce(urgent, 0) as urgent
           from n join r on n_regionkey = r_regionkey join a on a.k = n_nationkey left join b on b.k = n_nationkey left join o on o.k = n_nationkey left join u on u.k = n_nationkey""",
        n=t.nation, r=t.region, a=a, b=b, o=placed.select("k", "orders"), u=placed.select("k", "urgent"),
    )


@query(f"SELECT k, customers, NULL::BIGINT AS suppliers FROM {_A} UNION ALL SELECT k, NULL, suppliers FROM {_B}")
def c04_union_by_name(t: Tables) -> DataFrame:
    a, b = _by_nation(t)
    return t.combined("select k, customers, cast(null as bigint) as suppliers from a union all select k, cast(null as bigint), suppliers from b", a=a, b=b)


@query("""WITH v AS (SELECT c_mktsegment AS ccy, r_name AS region, sum(CAST(o_totalprice AS DECIMAL(20,2))) AS value FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2)
          SELECT ccy, CAST(sum(value) AS DOUBLE) AS total, CAST(max(value) AS DOUBLE) AS top FROM v GROUP BY ccy""")
def c05_genuine_ccy_chain(t: Tables) -> DataFrame:
    """Amounts are added within one genuine currency."""
    value = t.orders.join(t.customer, F.expr("o_custkey = c_custkey")).join(t.nation, F.expr("c_nationkey = n_nationkey")).join(t.region, F.expr("n_regionkey = r_regionkey"))
    value = value.groupBy(F.col("c_mktsegment").alias("ccy"), F.col("r_name").alias("region")).agg(F.sum(F.col("o_totalprice").cast("decimal(20,2)")).alias("value"))
    sql = "with x as (select ccy, region, value from a) select ccy, cast(sum(value) as double) as total, cast(max(value) as double) as top from x group by ccy"
    return t.combined(sql, a=Handle(value, amounts=frozenset({"value"}), ccy="ccy"))


@query(f"SELECT k, customers + suppliers AS both_sides FROM {_A} JOIN {_B} USING (k)")
def c06_using(t: Tables) -> DataFrame:
    a, b = _by_nation(t)
    return t.combined("select k, customers + suppliers as both_sides from a join b using (k)", a=a, b=b)


@query(f"SELECT a.k AS x, b.k AS y FROM {_A} a JOIN {_B} b ON a.customers < b.suppliers * 12 AND a.k < b.k")
def c07_theta(t: Tables) -> DataFrame:
    """A theta join of two small results (a row for each nation): both sides are grouped first, so the size is bounded."""
    a, b = _by_nation(t)
    return t.combined("select a.k as x, b.k as y from a join b on a.customers < b.suppliers * 12 and a.k < b.k", a=a, b=b)


# ---- more of free SQL, through the guard ----


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def q37_any_of_subquery(t: Tables) -> DataFrame:
    """What `= ANY (ARRAY (subquery))` asks elsewhere, as Spark writes it."""
    return t.guarded("select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_acctbal < 0)", "orders", "customer")


@query("""WITH top AS (SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(20,2))) AS spent FROM orders GROUP BY 1), ranked AS (SELECT c_nationkey, c_custkey, spent, row_number() OVER (PARTITION BY c_nationkey ORDER BY spent DESC, c_custkey) AS k FROM top JOIN customer ON c_custkey = o_custkey)
          SELECT n_name, c_custkey, CAST(spent AS DOUBLE) AS spent, k FROM ranked JOIN nation ON n_nationkey = c_nationkey WHERE k <= 3 AND EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey)""")
def q38_nested_ctes(t: Tables) -> DataFrame:
    return t.guarded(
        """with top as (select o_custkey, sum(cast(o_totalprice as decimal(20,2))) as spent from orders group by 1),
           ranked as (select c_nationkey, c_custkey, spent, row_number() over (partition by c_nationkey order by spent desc, c_custkey) as k from top join customer on c_custkey = o_custkey)
           select n_name, c_custkey, cast(spent as double) as spent, cast(k as bigint) as k from ranked join nation on n_nationkey = c_nationkey where k <= 3 and exists (select 1 from supplier where s_nationkey = c_nationkey)""",
        "orders", "customer", "nation", "supplier",
    )


@query("SELECT event_type, user_id, count(*) AS n, round(CAST(sum(CAST(value AS DECIMAL(20,6))) AS DOUBLE), 2) AS total FROM events WHERE event_type IN ('view', 'click') OR regexp_matches(event_type, '^p') GROUP BY 1, 2 HAVING count(*) > 1")
def q39_filtered_groups(t: Tables) -> DataFrame:
    return t.guarded("select event_type, user_id, count(*) as n, round(cast(sum(cast(value as decimal(20,6))) as double), 2) as total from events where event_type in ('view', 'click') or event_type rlike '^p' group by 1, 2 having count(*) > 1", "events")
