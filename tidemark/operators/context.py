"""The context of a question: a graph derived from what the engine declares, and one pack of what a caller may see of it.

The graph's metadata is small (a row a table, column, metric or term) and is declared on the driver; nodes and edges are DataFrames, and
everything after is joins and rankings over them, gated before anything is ranked.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.errors import Refused
from tidemark.operators import graph
from tidemark.plans.metrics import Metric
from tidemark.plans.security import ROW_SCOPES, Claims
from tidemark.session import cut
from tidemark.sources.endpoints import Endpoint

# The least schema version that can be read, tokens of a pack, the parts of a pack in the order in which they lose items, the
# edges that a path of joins goes along, and how many paths and examples a pack holds.
SCHEMA_VERSION, BUDGET = 1, 3000
DROP_ORDER = ["examples", "columns", "join_paths", "metric_links", "concepts", "terms", "metrics"]
PATH_EDGES = ["COMPUTED_FROM", "BACKED_BY", "HAS_COLUMN", "REFERENCES", "SAME_KEY_AS"]
MAX_PATHS, MAX_EXAMPLES = 3, 3
NODES = "uid string, kind string, source string, name string, text string, scopes array<string>, origin string"
EDGES = "src string, type string, dst string"


@dataclass(frozen=True)
class Term:
    """A word of the business, the nodes that it defines, and the wider word."""

    name: str
    definition: str
    synonyms: tuple[str, ...] = ()
    defines: tuple[str, ...] = ()
    broader: str = ""


@dataclass(frozen=True)
class Concept:
    """A thing of the business: what holds it, what identifies it, and how it relates to others (relation, concept)."""

    name: str
    description: str
    implemented_by: tuple[str, ...] = ()
    identified_by: tuple[str, ...] = ()
    related: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Knowledge:
    terms: tuple[Term, ...] = ()
    concepts: tuple[Concept, ...] = ()
    same_keys: Mapping[str, tuple[str, ...]] | None = None  # group to column uids


def derive(spark: SparkSession, schemas: Mapping[str, Mapping[str, T.StructType]], metrics: Mapping[str, Metric], endpoints: Mapping[str, Mapping[str, Endpoint]], knowledge: Knowledge, personas: Mapping[str, Claims]) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of all that is declared: sources, tables, columns, endpoints with their fields, metrics with their dimensions, words and
    things of the business, roles. An edge without both ends is refused."""
    nodes: dict[str, tuple] = {}
    edges: set[tuple[str, str, str]] = set()

    def node(uid: str, kind: str, source: str, name: str, text: str, scopes: list[str]) -> str:
        nodes[uid] = (uid, kind, source, name, text, sorted(scopes), "declared")
        return uid

    for source, tables in schemas.items():
        node(f"source:{source}", "Source", source, source, source, [source])
        for table, schema in tables.items():
            scopes = [source, f"{source}.{table}"]
            edges.add((f"source:{source}", "HAS_TABLE", node(f"table:{source}.{table}", "Table", source, table, table.replace("_", " "), scopes)))
            for f in schema:
                column = node(f"column:{source}.{table}.{f.name}", "Column", source, f.name, f"{f.name} {table}".replace("_", " "), scopes)
                edges.add((f"table:{source}.{table}", "HAS_COLUMN", column))
                if "references" in f.metadata:
                    edges.add((column, "REFERENCES", f"column:{source}.{f.metadata['references']}"))
    for source, paths in endpoints.items():
        for path, e in paths.items():
            scopes = [source, f"{source}.{e.table}"]
            at = node(f"endpoint:{source}{path}", "Endpoint", source, path, path.replace("/", " ").replace("-", " ").strip(), scopes)
            edges |= {(f"source:{source}", "HAS_ENDPOINT", at), (at, "BACKED_BY", f"table:{source}.{e.table}")}
            for column in e.columns or (schemas[source][e.table].names if not e.group else e.group):
                field = node(f"field:{source}{path}.{column}", "Field", source, column, column.replace("_", " "), scopes)
                edges.add((at, "RETURNS", field))
                if column in schemas[source][e.table].names:
                    edges.add((field, "MAPS_TO", f"column:{source}.{e.table}.{column}"))
    for m in metrics.values():
        at = node(f"metric:{m.id}", "Metric", m.source, m.id, f"{m.id} {' '.join(m.dimensions)}".replace("_", " "), [m.source, *(f"{m.source}.{t}" for t in m.tables)] if len(m.tables) == 1 else [m.source])
        edges |= {(at, "COMPUTED_FROM", f"table:{m.source}.{t}") for t in m.tables}
        for d, expression in m.dimensions.items():
            dimension = node(f"dimension:{m.id}.{d}", "Dimension", m.source, d, d.replace("_", " "), [m.source])
            edges.add((at, "HAS_DIMENSION", dimension))
            edges |= {(dimension, "ON_COLUMN", c) for t in m.tables if (c := f"column:{m.source}.{t}.{expression}") in nodes}
    for t in knowledge.terms:
        at = node(f"term:{t.name}", "BusinessTerm", "", t.name, " ".join((t.name, *t.synonyms, t.definition)), ["*"])
        edges |= {(at, "DEFINES", x) for x in t.defines} | ({(at, "BROADER", f"term:{t.broader}")} if t.broader else set())
    for c in knowledge.concepts:
        at = node(f"concept:{c.name}", "Concept", "", c.name, f"{c.name} {c.description}", ["*"])
        edges |= {(at, "IMPLEMENTED_BY", x) for x in c.implemented_by} | {(at, "IDENTIFIED_BY", x) for x in c.identified_by} | {(at, relation, f"concept:{other}") for relation, other in c.related}
    for columns in (knowledge.same_keys or {}).values():
        edges |= {(a, "SAME_KEY_AS", b) for a in columns for b in columns if a < b}
    for name, claims in personas.items():
        at = node(f"role:{name}", "Role", "", name, name, [f"role:{name}"])
        for uid, (_, kind, source, table, *_) in list(nodes.items()):
            if kind == "Table" and claims.can(source, table) or kind == "Metric" and all(claims.can(source, t) for t in metrics[table].tables):
                edges.add((at, "CAN_READ", uid))
    made = spark.createDataFrame([*nodes.values()], NODES).withColumn("version", F.lit(SCHEMA_VERSION)), spark.createDataFrame(sorted(edges), EDGES)
    joined = joinable(*made)
    made = made[0], made[1].unionByName(joined)
    if (lost := graph.dangling(*made).limit(3).collect()):
        raise ValueError(f"edges without both ends: {[tuple(r) for r in lost]}")
    return made


def joinable(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """JOINABLE_ON between metrics of different sources that have dimensions on columns of one same-key group; the smaller metric first."""
    step = lambda t, a, b: edges.filter(F.col("type") == t).select(F.col("src").alias(a), F.col("dst").alias(b))
    source = nodes.filter("kind = 'Metric'").select(F.col("uid").alias("metric"), "source")
    on = step("HAS_DIMENSION", "metric", "dimension").join(step("ON_COLUMN", "dimension", "column"), "dimension").join(source, "metric").select("metric", "source", "column")
    same = step("SAME_KEY_AS", "column", "other")
    same = same.union(same.select("other", "column"))
    far = on.join(same, "column").select("metric", "source", F.col("other").alias("column"))
    a, b = far.alias("a"), on.alias("b")
    met = a.join(b, F.expr("a.column = b.column and a.source <> b.source and a.metric < b.metric"))
    back = a.join(b, F.expr("a.column = b.column and a.source <> b.source and a.metric > b.metric"))
    pairs = met.select("a.metric", F.col("b.metric").alias("dst")).union(back.select("b.metric", F.col("a.metric")))
    return pairs.toDF("src", "dst").distinct().select("src", F.lit("JOINABLE_ON").alias("type"), "dst")


def load_catalog(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(uid, name, source, roles) of each metric; a graph of an older schema is refused, and so is one without a version."""
    version = nodes.agg(F.min("version")).first()[0] if "version" in nodes.columns else None
    if version is None or version < SCHEMA_VERSION:
        raise Refused("old_graph", f"the graph's schema is version {version}, not {SCHEMA_VERSION}")
    return nodes.filter("kind = 'Metric'").select("uid", "name", "source").join(graph.roles_of(nodes, edges), "uid")


def ranked_hits(seen: DataFrame, question: str, vectors: DataFrame | None, asked: DataFrame | None) -> DataFrame:
    """(uid, kind, rank): of each kind that has a top, the best by words and, where there are vectors (uid, embedding), by these; fused."""
    own = seen.filter(F.col("kind").isin(*graph.TOP))
    terms = [w for w in dict.fromkeys("".join(c if c.isalnum() or c == "_" else " " for c in question.lower()).split()) if len(w) > 1][:64]
    kinds = own.select("uid", "kind")
    rankings = []
    if terms:
        rankings.append(graph.ranked(graph.bm25(own, terms, "uid", "text").join(kinds, "uid"), "uid", 1000, ["kind"]))
    if vectors is not None and asked is not None:
        tops = {k: min(max(25 * n, 100), 1000) for k, n in graph.TOP.items()}  # more than are kept, for the fusion
        rankings.append(graph.vector_top(vectors.join(kinds, "uid"), asked, 100, "uid", "question", kind="kind", tops=tops).select("uid", "rank"))
    if not rankings:
        return kinds.limit(0).withColumn("rank", F.lit(0).cast("long"))
    fused = graph.fuse(rankings, "uid").join(kinds, "uid")
    bound = F.create_map(*(x for k, n in graph.TOP.items() for x in (F.lit(k), F.lit(n))))
    best = fused.withColumn("rank", F.row_number().over(Window.partitionBy("kind").orderBy(F.col("score").desc(), "uid")).cast("long"))
    return best.filter(F.col("rank") <= F.try_element_at(bound, F.col("kind"))).select("uid", "kind", "rank")


def _reached(hits: DataFrame, kind: str, chains: list[list[tuple[str, bool]]], edges: DataFrame) -> DataFrame:
    """(uid, rank): hits of a kind, and what chains of edges (type, forwards?) lead to from any hit, each at its best hit's rank."""
    found = [hits.filter(F.col("kind") == kind).select("uid", "rank")]
    for chain in chains:
        at = hits.select("uid", "rank")
        for type_, forwards in chain:
            here, there = ("src", "dst") if forwards else ("dst", "src")
            step = edges.filter(F.col("type") == type_).select(F.col(here).alias("uid"), F.col(there).alias("next"))
            at = at.join(step, "uid").select(F.col("next").alias("uid"), "rank")
        found.append(at)
    return reduce(DataFrame.union, found).groupBy("uid").agg(F.min("rank").alias("rank"))


def _listed(*columns: str) -> Column:
    return F.array_sort(F.collect_set(F.struct(*columns) if len(columns) > 1 else F.col(columns[0])))


def path_pairs(metrics: DataFrame, targets: DataFrame, most: int = MAX_PATHS) -> DataFrame:
    """(metric, target): pairs of different sources, one for each metric and target table, in order of rank.

    metrics: uid, source, rank. targets: uid, source, table, rank.
    """
    m, t = metrics.select(F.col("uid").alias("metric"), F.col("source").alias("own"), F.col("rank").alias("first")), targets.select(F.col("uid").alias("target"), "source", "table", F.col("rank").alias("second"))
    pairs = m.join(t, F.expr("source <> '' and source <> own"))  # a few of each: both sides are tops
    one = Window.partitionBy("metric", "table").orderBy("second", "target")
    return pairs.withColumn("k", F.row_number().over(one)).filter("k = 1").orderBy("first", "metric", "second", "target").limit(most).select("metric", "target")


def pack(nodes: DataFrame, edges: DataFrame, scopes: list[str], question: str, metrics_only: bool = False, vectors: DataFrame | None = None, asked: DataFrame | None = None, budget: int = BUDGET) -> dict[str, list]:
    """What a caller should know to answer a question: metrics, terms, concepts, columns, examples, paths of joins, links between metrics; within
    a budget of tokens. Nothing that the gate hides is ranked, walked through or shown."""
    seen = cut(graph.gate(nodes.filter("kind <> 'Role'"), edges, scopes, metrics_only))
    ids = seen.select("uid")
    own = cut(edges.join(ids, edges.src == ids.uid, "left_semi").join(ids, edges.dst == ids.uid, "left_semi"))
    hits = cut(ranked_hits(seen, question, vectors, asked))
    top = graph.TOP["Metric"]
    to_metric = [[("DEFINES", True)], [("USED", True)], [("IMPLEMENTED_BY", True), ("COMPUTED_FROM", False)], [("HAS_COLUMN", False), ("COMPUTED_FROM", False)]]
    found = _reached(hits, "Metric", to_metric, own).join(seen.filter("kind = 'Metric'"), "uid")
    metrics = cut(found.orderBy("rank", "uid").limit(top).select("uid", "name", "source", "rank"))
    linked = own.filter("type = 'JOINABLE_ON'")
    linked = linked.select(F.col("src").alias("metric"), F.col("dst").alias("other")).union(linked.select("dst", "src"))
    names = seen.select(F.col("uid").alias("other"), F.col("source").alias("source"), F.col("name").alias("other_name"))
    links = metrics.select(F.col("uid").alias("metric"), "name", F.col("source").alias("own"), "rank").join(linked, "metric").join(names, "other").join(metrics.select("source"), "source", "left_anti")
    one = links.withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy("rank", "other"))).filter("k = 1")  # a metric for each new source
    links = one.orderBy("rank", "source", "other").limit(4).select("name", "other", "other_name", "source")
    terms = _reached(hits, "BusinessTerm", [[("BROADER", True)], [("DEFINES", False)]], own).join(seen.filter("kind = 'BusinessTerm'"), "uid").orderBy("rank", "uid").limit(2 * graph.TOP["BusinessTerm"])
    concepts = cut(_reached(hits, "Concept", [[("IMPLEMENTED_BY", False)]], own).join(seen.filter("kind = 'Concept'"), "uid").orderBy("rank", "uid").limit(2 * graph.TOP["Concept"]))
    step = lambda t, a, b: own.filter(F.col("type") == t).select(F.col("src").alias(a), F.col("dst").alias(b))
    held = concepts.join(step("IMPLEMENTED_BY", "uid", "at"), "uid").select("uid", "name", "text", "rank", "at")
    columns = _reached(hits, "Column", [], own).join(seen.filter("kind = 'Column'"), "uid").join(step("HAS_COLUMN", "table", "uid"), "uid")
    tables = columns.groupBy("table").agg(F.min("rank").alias("rank"), _listed("name").alias("columns")).orderBy("rank", "table").limit(graph.TOP["Column"])
    examples = _reached(hits, "Question", [], own).join(seen.filter("kind = 'Question'"), "uid")
    examples = examples.orderBy((F.col("origin") == "history").cast("int"), "rank", "uid").limit(MAX_EXAMPLES)  # seeds before history

    paths = []
    if not metrics_only:
        targets = columns.select("uid", "source", "table", "rank").union(held.filter("at like 'table:%'").join(seen.select(F.col("uid").alias("at"), "source"), "at").select(F.col("at"), "source", F.col("at"), "rank"))
        pairs = [(r.metric, r.target) for r in path_pairs(metrics, targets).collect()]  # three at most
        if pairs:
            uids = lambda k: edges.sparkSession.createDataFrame(sorted({(p[k],) for p in pairs}), "uid string")
            walk = graph.shortest_paths(own.filter(F.col("type").isin(*PATH_EDGES)), uids(0), uids(1)).collect()
            way = {(r.start, r.goal): r for r in walk}
            paths = [{"from": a, "to": b, "hops": way[a, b].hops, "path": list(way[a, b].path)} for a, b in pairs if (a, b) in way]
    extra = [{"id": r.other_name, "source": r.source} for r in links.collect()]
    made = {
        "metrics": [{"id": r.name, "source": r.source} for r in metrics.orderBy("rank", "uid").collect()] + extra,
        "terms": [{"term": r.name, "text": r.text} for r in terms.collect()],
        "concepts": [{"concept": r.name, "text": r.text, "implemented_by": list(r.at)} for r in held.groupBy("name", "text", "rank").agg(_listed("at").alias("at")).orderBy("rank", "name").collect()],
        "columns": [{"table": r.table, "columns": list(r.columns)} for r in tables.collect()],
        "examples": [{"question": r.text} for r in examples.collect()],
        "join_paths": paths,
        "metric_links": [{"a": r.name, "b": r.other_name} for r in links.collect()],
    }
    kept = graph.trim_pack({k: v for k, v in made.items() if v}, budget, DROP_ORDER)
    ids_left = {m["id"] for m in kept.get("metrics", [])}
    kept["metric_links"] = [x for x in kept.get("metric_links", []) if x["a"] in ids_left and x["b"] in ids_left]
    return {k: v for k, v in kept.items() if v}


def tokens(made: dict) -> float:
    """A pack's size, four characters a token."""
    return len(json.dumps(made, default=str)) / 4


def scopes_of(claims: Claims) -> list[str]:
    """What a caller's claims open: sources and single tables with a row dimension that grants nothing are left out."""
    out = []
    for scope in sorted(claims.scopes):
        source, _, table = scope.partition(".")
        dimension = ROW_SCOPES.get(source, {}).get(table) if table else None
        if dimension is None or claims.allowed(dimension):
            out.append(scope)
    return out
