"""Graph, retrieval and history operators on the benchmark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import graph
from tidemark.registry import Tables, query

_COS = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


@query(f"""SELECT q AS question, item, kind, score, k AS rank FROM (SELECT b.vec_id AS q, a.vec_id AS item, CASE a.vec_id % 3 WHEN 0 THEN 'Metric' WHEN 1 THEN 'Concept' ELSE 'Other' END AS kind, round({_COS}, 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND b.vec_id % 100 = 0)
           QUALIFY row_number() OVER (PARTITION BY q, kind ORDER BY score DESC, item) AS k <= CASE kind WHEN 'Metric' THEN 5 WHEN 'Concept' THEN 2 ELSE 10 END""".replace("k AS rank", "row_number() OVER (PARTITION BY q, kind ORDER BY score DESC, item) AS rank").replace(" AS k <=", " <="))
def g01_cosine_topk(t: Tables) -> DataFrame:
    """Every vector whose id is divisible by 100 asks all vectors for the best of each kind."""
    kind = F.when(F.col("vec_id") % 3 == 0, "Metric").when(F.col("vec_id") % 3 == 1, "Concept").otherwise("Other")
    items = t.embeddings.select(F.col("vec_id").alias("item"), "embedding", kind.alias("kind"))
    asked = t.embeddings.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("question"), "embedding")
    return graph.vector_top(items, asked, 10, "item", "question", kind="kind")


_TERMS = ["the", "license", "und", "estion", "token"]
_BM25 = """WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS ws FROM documents), t AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM w), f AS (SELECT doc_id, len(ws) AS l, u.term, count(*) AS tf FROM w, unnest(ws) u(term) WHERE u.term IN ('the', 'license', 'und', 'estion', 'token') GROUP BY 1, 2, 3),
d AS (SELECT term, count(*) AS df FROM f GROUP BY 1), s AS (SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / mean))), 6) AS score FROM f JOIN d USING (term), t GROUP BY 1)"""


@query(f"{_BM25} SELECT doc_id, score FROM s")
def g02_bm25_topk(t: Tables) -> DataFrame:
    return graph.bm25(t.documents, _TERMS, "doc_id", "text")


@query(f"""{_BM25}, a AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM s QUALIFY r <= 50), b AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM documents QUALIFY r <= 50)
           SELECT doc_id, round(sum(1.0 / (60 + r)), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1""")
def g03_rrf(t: Tables) -> DataFrame:
    words = graph.ranked(graph.bm25(t.documents, _TERMS, "doc_id", "text"), "doc_id", 50)
    size = graph.ranked(t.documents.select("doc_id", F.col("n_chars").alias("score")), "doc_id", 50)
    return graph.fuse([words, size], "doc_id")


@query("""WITH d AS (SELECT DISTINCT event_type AS metric, 's' || user_id % 3 AS source, 'c' || user_id % 7 AS col FROM events), k AS (SELECT metric, source, CASE WHEN col IN ('c1', 'c2') THEN 'g1' WHEN col IN ('c4', 'c5', 'c6') THEN 'g2' END AS grp FROM d)
          SELECT DISTINCT a.metric AS metric_a, b.metric AS metric_b, a.grp AS grp FROM k a JOIN k b ON a.grp = b.grp AND a.source <> b.source AND a.metric < b.metric""")
def g04_joinable(t: Tables) -> DataFrame:
    dims = t.events.select(F.col("event_type").alias("metric"), F.concat(F.lit("s"), F.col("user_id") % 3).alias("source"), F.concat(F.lit("c"), F.col("user_id") % 7).alias("column")).distinct()
    return graph.joinable(dims, {"g1": ["c1", "c2"], "g2": ["c4", "c5", "c6"]})


@query("""WITH RECURSIVE e AS (SELECT 'n' || n_nationkey AS a, 'r' || n_regionkey AS b FROM nation UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
          p(start, spot, hops, path) AS (SELECT 's1', 's1', CAST(0 AS BIGINT), ['s1'] UNION ALL SELECT start, u.b, hops + 1, list_append(path, u.b) FROM p JOIN u ON p.spot = u.a WHERE hops < 6 AND NOT list_contains(path, u.b))
          SELECT start, spot AS goal, hops, array_to_string(path, '>') AS path FROM p WHERE spot <> 's1' AND (spot LIKE 's%' OR spot = 'n7') QUALIFY row_number() OVER (PARTITION BY start, spot ORDER BY hops, path) = 1""")
def g05_shortest_path(t: Tables) -> DataFrame:
    edges = t.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst")).union(t.supplier.select(F.concat(F.lit("s"), "s_suppkey"), F.concat(F.lit("n"), "s_nationkey")))
    start = t.spark.createDataFrame([("s1",)], "uid string")
    goals = t.supplier.filter("s_suppkey <> 1").select(F.concat(F.lit("s"), "s_suppkey").alias("uid")).union(t.spark.createDataFrame([("n7",)], "uid string"))
    return graph.shortest_paths(edges, start, goals, 6).withColumn("path", F.array_join("path", ">"))


@query("""WITH e AS (SELECT 'customer' || c_custkey AS src, 'IN' AS type, 'nation' || c_nationkey AS dst FROM customer UNION SELECT 'nation' || n_nationkey, 'OF', 'region' || n_regionkey FROM nation UNION SELECT 'nation' || s_nationkey, 'SELLS', 'supplier' || s_suppkey FROM supplier),
          a AS (SELECT * FROM e WHERE type = 'IN' AND src IN ('customer1', 'customer2', 'customer3'))
          SELECT src, type, dst FROM a UNION SELECT e.* FROM e WHERE type IN ('OF', 'SELLS') AND src IN (SELECT dst FROM a)""")
def g06_lineage_union(t: Tables) -> DataFrame:
    edge = lambda df, a, ak, type_, b, bk: df.select(F.concat(F.lit(a), F.col(ak)).alias("src"), F.lit(type_).alias("type"), F.concat(F.lit(b), F.col(bk)).alias("dst"))
    edges = edge(t.customer, "customer", "c_custkey", "IN", "nation", "c_nationkey").union(edge(t.nation, "nation", "n_nationkey", "OF", "region", "n_regionkey")).union(edge(t.supplier, "nation", "s_nationkey", "SELLS", "supplier", "s_suppkey"))
    start = t.spark.createDataFrame([("customer1",), ("customer2",), ("customer3",)], "uid string")
    return graph.lineage(edges, [["IN", "OF"], ["IN", "SELLS"]], start)


@query("""WITH r AS (SELECT lower(regexp_replace(trim(event_type || '  ' || CAST(floor(value / 20) AS INTEGER)), '\\s+', ' ', 'g')) AS qkey, user_id AS sub, CAST(event_id % 3 AS VARCHAR) AS plan, event_id AS id FROM events),
          m AS (SELECT sub, qkey FROM (SELECT sub, qkey, row_number() OVER (PARTITION BY sub ORDER BY max(id) DESC, qkey) AS k FROM r GROUP BY 1, 2) WHERE k <= 4), w AS (SELECT r.* FROM r JOIN m USING (sub, qkey)),
          a AS (SELECT qkey, count(DISTINCT sub) AS callers, count(*) AS n, max(id) AS last FROM w GROUP BY 1 HAVING count(DISTINCT sub) >= 3), p AS (SELECT qkey, plan, count(DISTINCT sub) AS backers, max(id) AS at_id FROM w GROUP BY 1, 2)
          SELECT a.qkey, callers, n, last, arg_max(plan, (backers, at_id)) AS plan FROM a JOIN p ON a.qkey = p.qkey GROUP BY ALL ORDER BY callers DESC, last DESC, a.qkey LIMIT 20""".replace("\\\\s", "\\s"))
def g07_distill(t: Tables) -> DataFrame:
    log = t.events.select(F.concat("event_type", F.lit("  "), F.floor(F.col("value") / 20).cast("int").cast("string")).alias("question"), F.col("user_id").alias("sub"), (F.col("event_id") % 3).cast("string").alias("plan"), F.col("event_id").alias("id"))
    return graph.distil(log, 4, 3, 20)


@query("""WITH v AS (SELECT 'n' || n_nationkey AS uid FROM nation WHERE n_regionkey IN (1, 2)), u AS (SELECT 'q' || o_custkey AS by_, 'n' || s_nationkey AS thing FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2)
          SELECT uid FROM v UNION ALL SELECT by_ FROM u LEFT JOIN v ON thing = uid GROUP BY by_ HAVING count(*) = count(uid)""")
def g08_gate_all_used(t: Tables) -> DataFrame:
    """Each customer asks about the nations of all its suppliers."""
    kind = lambda df, id_, k, scope: df.select(id_.alias("uid"), F.lit(k).alias("kind"), F.array(scope).alias("scopes"), F.lit("").alias("text")).distinct()
    bought = t.orders.join(t.lineitem, F.expr("l_orderkey = o_orderkey")).join(t.supplier, F.expr("s_suppkey = l_suppkey"))
    edges = bought.select(F.concat(F.lit("q"), "o_custkey").alias("src"), F.lit("USED").alias("type"), F.concat(F.lit("n"), "s_nationkey").alias("dst")).distinct()
    nodes = kind(t.nation, F.concat(F.lit("n"), "n_nationkey"), "Metric", F.concat(F.lit("r"), "n_regionkey")).union(kind(edges, F.col("src"), "Question", F.lit("*")))
    return graph.gate(nodes, edges, ["r1", "r2"]).select("uid")


@query("SELECT 's' || s_suppkey AS node, CAST(3 AS BIGINT) AS depth FROM supplier UNION ALL SELECT 'n' || n_nationkey, 2 FROM nation UNION ALL SELECT 'r' || r_regionkey, 1 FROM region UNION ALL SELECT 'root', 0")
def g09_hierarchy(t: Tables) -> DataFrame:
    link = lambda df, a, ak, b, bk: df.select(F.concat(F.lit(a), F.col(ak)).alias("src"), F.concat(F.lit(b), F.col(bk)).alias("dst"))
    top = t.region.select(F.lit("root").alias("src"), F.concat(F.lit("r"), "r_regionkey").alias("dst"))
    return graph.descend(top.union(link(t.nation, "r", "n_regionkey", "n", "n_nationkey")).union(link(t.supplier, "n", "s_nationkey", "s", "s_suppkey")), "root", 3)


@query("SELECT 'node' AS what, 'nation' AS name, count(*) AS n FROM nation UNION ALL SELECT 'node', 'region', count(*) FROM region UNION ALL SELECT 'edge', 'OF', count(*) FROM nation")
def g10_counts(t: Tables) -> DataFrame:
    kind = lambda df, id_, k: df.select(F.concat(F.lit(k), id_).alias("uid"), F.lit(k).alias("kind"), F.array(F.lit("*")).alias("scopes"), F.lit("").alias("text"))
    nodes, edges = graph.build([kind(t.nation, "n_nationkey", "nation"), kind(t.region, "r_regionkey", "region")], [t.nation.select(F.concat(F.lit("nation"), "n_nationkey").alias("src"), F.lit("OF").alias("type"), F.concat(F.lit("region"), "n_regionkey").alias("dst"))])
    return graph.counts(nodes, edges)


@query("SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 40)")
def g11_dangling(t: Tables) -> DataFrame:
    """Edges from every sold part to its supplier, where large parts are missing among the nodes."""
    uid = lambda df, a, k: df.select(F.concat(F.lit(a), F.col(k)).alias("uid"))
    nodes = uid(t.part.filter("p_size < 40"), "p", "p_partkey").union(uid(t.supplier, "s", "s_suppkey"))
    edges = t.lineitem.select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.lit("SOLD_BY").alias("type"), F.concat(F.lit("s"), "l_suppkey").alias("dst")).distinct()
    return graph.dangling(nodes, edges).select("src", "dst")


@query("""WITH v AS (SELECT 'n' || n_nationkey AS uid FROM nation WHERE n_regionkey IN (1, 2)), u AS (SELECT 'q' || c_custkey // 3 AS by_, 'n' || c_nationkey AS thing FROM customer)
          SELECT uid FROM v UNION ALL SELECT by_ FROM u LEFT JOIN v ON thing = uid GROUP BY by_ HAVING count(*) = count(uid)""")
def g12_gate_all_customers(t: Tables) -> DataFrame:
    """The gate over USED edges of every customer; askers grow with the table."""
    kind = lambda df, id_, k, scope: df.select(id_.alias("uid"), F.lit(k).alias("kind"), F.array(scope).alias("scopes"), F.lit("").alias("text")).distinct()
    asked = F.concat(F.lit("q"), F.expr("c_custkey div 3"))
    nodes = kind(t.nation, F.concat(F.lit("n"), "n_nationkey"), "Metric", F.concat(F.lit("r"), "n_regionkey")).union(kind(t.customer, asked, "Question", F.lit("*")))
    edges = t.customer.select(asked.alias("src"), F.lit("USED").alias("type"), F.concat(F.lit("n"), "c_nationkey").alias("dst"))
    return graph.gate(nodes, edges, ["r1", "r2"]).select("uid")


@query(f"SELECT q AS question, item, score FROM (SELECT b.vec_id AS q, a.vec_id AS item, round({_COS}, 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND b.vec_id % 100 = 0) QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, item) <= 10")
def g13_cosine_topk_all(t: Tables) -> DataFrame:
    """Every vector whose id is divisible by 100 against all vectors."""
    items = t.embeddings.select(F.col("vec_id").alias("item"), "embedding")
    asked = t.embeddings.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("question"), "embedding")
    return graph.vector_top(items, asked, 10, "item", "question").select("question", "item", "score")


@query("""WITH m AS (SELECT 'p' || l_partkey AS metric, 's' || l_suppkey AS other, 'n' || s_nationkey AS source FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL), o AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY metric, source ORDER BY other) = 1)
          SELECT metric, other, source FROM o QUALIFY row_number() OVER (PARTITION BY metric ORDER BY source, other) <= 4""")
def g14_linked(t: Tables) -> DataFrame:
    """For each part, one supplier of each new nation, four at most."""
    links = t.lineitem.join(t.supplier, F.expr("s_suppkey = l_suppkey")).select(F.concat(F.lit("p"), "l_partkey").alias("metric"), F.concat(F.lit("s"), "l_suppkey").alias("other"), F.concat(F.lit("n"), "s_nationkey").alias("source")).distinct()
    return graph.linked(links).select("metric", "other", "source")


_KEPT = "k AS (SELECT uid, kind FROM (SELECT 'r' || r_regionkey AS uid, 'Metric' AS kind FROM region UNION ALL SELECT 'n' || n_nationkey, 'Table' FROM nation UNION ALL SELECT 's' || s_suppkey, 'Column' FROM supplier) ORDER BY CASE kind WHEN 'Metric' THEN 0 WHEN 'Table' THEN 1 ELSE 2 END, uid LIMIT 40)"


@query(f"WITH {_KEPT}, e AS (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier) SELECT src, dst FROM e WHERE src IN (SELECT uid FROM k) AND dst IN (SELECT uid FROM k)")
def g15_keep_important(t: Tables) -> DataFrame:
    """A picture of forty nodes at most, by kind and then id, with the edges between them."""
    node = lambda df, a, k, kind: df.select(F.concat(F.lit(a), F.col(k)).alias("uid"), F.lit(kind).alias("kind"))
    nodes = node(t.region, "r", "r_regionkey", "Metric").union(node(t.nation, "n", "n_nationkey", "Table")).union(node(t.supplier, "s", "s_suppkey", "Column"))
    edges = t.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.lit("IN").alias("type"), F.concat(F.lit("r"), "n_regionkey").alias("dst")).union(t.supplier.select(F.concat(F.lit("s"), "s_suppkey"), F.lit("IN"), F.concat(F.lit("n"), "s_nationkey")))
    return graph.keep_important(nodes, edges, {"Metric": 0, "Table": 1, "Column": 2}, 40)[1].select("src", "dst")
