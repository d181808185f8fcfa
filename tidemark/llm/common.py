"""What the corpus operators share: shared-folder tables, ASCII rules, and Arrow helpers."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from pathlib import Path

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROOT = str(Path(__file__).resolve().parents[2])
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_OPEN: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one input table; only Spark's readers touch the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def importable(spark: SparkSession) -> None:
    """Let Python workers started from now on import this package from where the driver did."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, as spark.checkpoint.dir names it; a temporary one where it is unset on a local master (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not (named := spark.sparkContext.getCheckpointDir()):
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("on a cluster, name a folder that all executors share in spark.checkpoint.dir")
            spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='tidemark-shared-')}")
            named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/tidemark-{tag}-{uuid.uuid4().hex}"
    _OPEN.append((spark, path))
    return path


def settle(spark: SparkSession, df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Cut lineage: write df to the shared folder and read it again."""
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete settled tables that nothing reads any more, on whatever store holds them."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        _OPEN[:] = [x for x in _OPEN if x[1] != path]


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of a settled table."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The store that holds a path, for files that tasks write and read themselves."""
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


@atexit.register
def _sweep() -> None:
    for spark, path in list(_OPEN):
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended first
            return


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; Spark's lower() would fold other letters too."""
    return F.translate(text, UPPER, LOWER)


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row, however often body names it."""
    return F.transform(F.array(value), body)[0]


#: Keys that more rows share than this, and than a 100,000th of all rows, are looked up by broadcast.
OFTEN = 1000


def lookup(rows: DataFrame, table: DataFrame, key: str, often: int = OFTEN) -> DataFrame:
    """rows left-joined with table, which has one row a key. rows is settled: it is read more than once.

    Keys of very many rows are counted first. There are fewer than 100,000 of them, or one for every `often` rows if that is less, so their
    rows of the table are broadcast, and no shuffled key is left with more than its share.
    """
    spark = rows.sparkSession
    bound = max(often, rows.count() // 100_000)
    hot, path = settle(spark, rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > bound).select(key, F.lit(True).alias("_hot")), "often")
    if not hot.limit(1).count():
        remove(spark, path)
        return rows.join(table, key, "left")
    marked = rows.join(F.broadcast(hot), key, "left")
    few = table.join(F.broadcast(hot.select(key)), key, "left_semi")
    many = marked.filter("_hot").drop("_hot").join(F.broadcast(few), key, "left")
    return many.unionByName(marked.filter("_hot is null").drop("_hot").join(table, key, "left"))


def small_batches(spark: SparkSession, rows: int = 1000, megabytes: int = 32) -> None:
    """Bound what one Arrow batch holds, so that long texts don't add up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", megabytes << 20)


def narrow(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """(doc_id, text) only: other columns, whatever their names, can't clash with an operator's own. carry: all but the text as one struct, rest."""
    rest = [F.struct(*(docs[c] for c in docs.columns if c != text_col)).alias("rest")] if carry else []
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"), *rest)


def rows_of(ddl: str, plain: DataFrame) -> T.StructType:
    """A schema, with the carried struct at its end where there is one."""
    made = T.StructType.fromDDL(ddl)
    return made.add("rest", plain.schema["rest"].dataType) if "rest" in plain.columns else made


def unpacked(found: DataFrame, docs: DataFrame, text_col: str = "text", text: str = "text") -> DataFrame:
    """The columns of docs again, in their order, with `text` as their text."""
    return found.select(*(F.col(text).alias(c) if c == text_col else F.col("rest")[c].alias(c) for c in docs.columns))


def prepare(spark: SparkSession) -> None:
    importable(spark)
    small_batches(spark)


#: UTF-8 bytes with A-Z folded.
BYTES_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def give_back() -> None:
    """Return what a task freed to the machine: worker processes live on beside the next operators' tasks."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps its own account
        pass


#: Bytes that a worker may grow by, over all its tasks, before it gives back what is free.
LEFT = 32 << 20
_LEAST: list[int] = []


def resident() -> int:
    """Bytes of this process in memory, 0 where that isn't known."""
    try:
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")
    except (OSError, ValueError, AttributeError):
        return 0


def returning(run):
    """An Arrow map that gives its memory back at a task's end, unless the worker is about as small as it ever was."""

    def wrapped(batches):
        _LEAST[:] = [min(resident(), *_LEAST)] if _LEAST else [resident()]
        try:
            yield from run(batches)
        finally:
            if not _LEAST[0] or resident() > _LEAST[0] + LEFT:
                give_back()

    return wrapped
