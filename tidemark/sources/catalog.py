"""Table catalogs as Spark schemas: keys, references and masks are metadata of the fields, so that they travel with every DataFrame.

A table is declared by hand with Spark's own type names. Writes check rows against the declaration; graphs are written whole, version beside
version, and a version counts from the moment it is complete.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.security import MASKED, PII, Claims

#: Older versions of a graph that stay beside the current one.
KEPT = 1


def declared(columns: str, key: str = "", references: Mapping[str, str] | None = None, masked: str = "") -> T.StructType:
    """columns: Spark DDL, as `id string not null, day date`. key and masked: names with spaces between. references: column to `table.column`. A session must exist."""
    plain = T.StructType.fromDDL(columns)
    keys, targets, hidden = key.split(), dict(references or {}), masked.split()
    if missing := {*keys, *targets, *hidden} - {*plain.names}:
        raise ValueError(f"the table has no columns {sorted(missing)}")

    def marked(f: T.StructField) -> T.StructField:
        marks = {"key": keys.index(f.name)} if f.name in keys else {}
        marks |= {"references": targets[f.name]} if f.name in targets else {}
        marks |= {"masked": True} if f.name in hidden else {}
        return T.StructField(f.name, f.dataType, f.nullable, marks)

    return T.StructType([marked(f) for f in plain])


def key_of(schema: T.StructType) -> list[str]:
    return [f.name for f in sorted((f for f in schema if "key" in f.metadata), key=lambda f: f.metadata["key"])]


def references_of(schema: T.StructType) -> dict[str, str]:
    return {f.name: f.metadata["references"] for f in schema if "references" in f.metadata}


def describe(source: str, schemas: Mapping[str, T.StructType], claims: Claims) -> list[dict]:
    """A row a table that the caller can read, with its columns as this caller sees them."""
    seen = []
    for name in sorted(t for t in schemas if claims.can(source, t)):
        always = MASKED.get((source, name), {})
        columns = [{"name": f.name, "type": f.dataType.simpleString(), "masked": PII not in claims.scopes and (f.metadata.get("masked", False) or f.name in always)} for f in schemas[name]]
        seen.append({"table": name, "columns": columns, "primary_key": key_of(schemas[name]), "references": references_of(schemas[name])})
    return seen


def graph_parts(source: str, schemas: Mapping[str, T.StructType], spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """A source's tables and columns as nodes (uid, kind, scopes, text) and edges (src, type, dst) of the context graph."""
    nodes, edges = [(f"source:{source}", "Source", [source], source)], []
    for name, schema in schemas.items():
        table, scopes = f"table:{source}.{name}", [source, f"{source}.{name}"]
        nodes.append((table, "Table", scopes, name))
        edges.append((f"source:{source}", "HAS_TABLE", table))
        for f in schema:
            column = f"column:{source}.{name}.{f.name}"
            nodes.append((column, "Column", scopes, f.name))
            edges.append((table, "HAS_COLUMN", column))
            if "references" in f.metadata:
                edges.append((column, "REFERENCES", f"column:{source}.{f.metadata['references']}"))
    return spark.createDataFrame(nodes, "uid string, kind string, scopes array<string>, text string"), spark.createDataFrame(edges, "src string, type string, dst string")


def write_tables(folder: str, schemas: Mapping[str, T.StructType], tables: Mapping[str, DataFrame]) -> dict[str, int]:
    """Bulk load: each table whole, its columns by name and under their declared types; a repeated or null key is refused before the write."""
    written = {}
    for name, df in tables.items():
        schema = schemas[name]
        if {*df.columns} != {*schema.names}:
            raise ValueError(f"{name}: columns {sorted(df.columns)} for {sorted(schema.names)}")
        typed = df.select(*(F.col(f.name).cast(f.dataType).alias(f.name, metadata=f.metadata) for f in schema))
        if key := key_of(schema):
            clash = typed.groupBy(*key).count().filter(F.greatest(*(F.col(k).isNull().cast("int") for k in key), F.lit(0)).cast("boolean") | (F.col("count") > 1))
            if not clash.isEmpty():
                raise ValueError(f"{name}: a key {key} is null or repeated")
        typed.write.mode("overwrite").parquet(f"{folder}/{name}")
        written[name] = df.sparkSession.read.parquet(f"{folder}/{name}").count()
    return written


def rows_of(spark: SparkSession, schema: T.StructType, rows: Iterable[Mapping[str, object]]) -> DataFrame:
    """Generated rows, each a mapping of all columns."""
    made = []
    for r in rows:
        if {*r} != {*schema.names}:
            raise ValueError(f"a row has {sorted(r)}, the table {sorted(schema.names)}")
        made.append(tuple(r[n] for n in schema.names))
    return spark.createDataFrame(made, schema)


# ---- versions ----


def _store(spark: SparkSession, folder: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Complete versions, oldest first: those whose write has left its success mark."""
    fs, at = _store(spark, folder)
    if not fs.exists(at):
        return []
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return sorted(int(n.partition("=")[2]) for n in names if n.startswith("version=") and fs.exists(path(f"{folder}/{n}/_SUCCESS")))


def swap_version(df: DataFrame, folder: str, version: int, kept: int = KEPT) -> DataFrame:
    """Write a version beside the others; it is current once complete, so a failed write changes nothing. Older ones than `kept` before it go."""
    spark = df.sparkSession
    df.withColumn("version", F.lit(version)).write.mode("overwrite").parquet(f"{folder}/version={version}")
    fs, _ = _store(spark, folder)
    for old in versions(spark, folder)[: -1 - kept]:
        fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/version={old}"), True)
    return current_version(spark, folder)


def current_version(spark: SparkSession, folder: str) -> DataFrame:
    """The highest complete version."""
    found = versions(spark, folder)
    if not found:
        raise FileNotFoundError(f"no complete version in {folder}")
    return spark.read.parquet(f"{folder}/version={found[-1]}")
