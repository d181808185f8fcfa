"""Line deduplication with two Bloom filters.

1. Hashes of line keys, 8 bytes each and at most two of one key from a task's chunk, are dealt by hash to segments, as many as the bytes of
   all texts need for a segment to hold SEGMENT lines at most or so. For each segment a task holds two Bloom filters: a hash goes to the
   once-seen filter, and, if that already has it, to the twice-seen filter. Only the twice-seen filters go on, as a broadcast whose size is
   bounded (TWICE_MB in all, whatever the input; a fuller filter passes more lines to step 2, never fewer).
2. Only lines that the twice-seen filter knows are shuffled, as the 128-bit digest of the key, one row for each key and document: digests are
   grouped, counted, and the document that keeps its lines is chosen. What a filter passed wrongly falls out here.
3. Confirmed keys go back to the documents: by broadcast if their checked size is under CONFIRMED_MB, else by a join on key and document.

A document is a row, so that repeated rows count each, and each keeps its lines if its id is the largest. A null id sorts below every other.
Null or empty text is one empty line. Lines are kept whole and in order. An empty table gives none; a very long text is handled whole, by one
task; other columns don't meddle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import BYTES_LOWER, lookup, narrow, prepare, remove, returning, rows_of, settle

#: Bounds: all twice-seen filters together; confirmed keys to broadcast, ENTRY bytes each as a worker's dictionary holds them; lines of a segment
#: and bits of its once-seen filter; hashes that a task packs at once.
TWICE_MB, CONFIRMED_MB, ENTRY, SEGMENT, ONCE_BITS, PROBES, CHUNK = 64, 64, 200, 4_000_000, 26, 4, 1_000_000
SPACE = b" \t\n\x0b\x0c\r"


def long_enough(key: bytes, least: int) -> bool:
    """At least so many code points; UTF-8 has a byte or more for each."""
    return len(key) >= least and (len(key) >= 4 * least or key.isascii() or len(key.decode()) >= least)


def keys_of(raw: bytes, least: int) -> list[bytes]:
    """The key of each line (no ASCII white space at its ends, A-Z folded); empty for those too short to count."""
    return [k if long_enough(k, least) else b"" for k in [x.strip(SPACE) for x in raw.translate(BYTES_LOWER).split(b"\n")]]


def raw_texts(batch: pa.RecordBatch) -> list[bytes]:
    return [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]


def hashes(keys: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))


def probes(h: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Bit numbers of each hash, PROBES of them, by double hashing."""
    a, b = h * np.uint64(0x9E3779B97F4A7C15), (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) | np.uint64(1)
    for k in range(PROBES):
        yield (a + b * np.uint64(k)) >> np.uint64(64 - bits)


class Bloom:
    def __init__(self, bits: int, data: np.ndarray | None = None):
        self.bits, self.data = bits, np.zeros(1 << max(0, bits - 3), np.uint8) if data is None else data

    def add(self, h: np.ndarray) -> None:
        for at in probes(h, self.bits):
            np.bitwise_or.at(self.data, at >> np.uint64(3), (1 << (at & np.uint64(7))).astype(np.uint8))

    def has(self, h: np.ndarray) -> np.ndarray:
        found = np.ones(len(h), bool)
        for at in probes(h, self.bits):
            found &= (self.data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return found


class Twice:
    """The twice-seen filters of all segments in one array: `bits` of each as a power of two (0: none), from bit `start` on."""

    def __init__(self, segments: int, found: list[tuple[int, int, bytes]]):
        self.bits, self.start = np.zeros(segments, np.uint64), np.zeros(segments, np.uint64)
        at = 0
        for segment, bits, data in found:
            self.bits[segment], self.start[segment] = bits, at * 8
            at += len(data)
        self.data = np.frombuffer(b"".join(data for *_, data in found), np.uint8)

    def has(self, h: np.ndarray) -> np.ndarray:
        to = (h % np.uint64(len(self.bits))).astype(np.int64)
        found = self.bits[to] > 0
        own, to = h[found], to[found]
        a, b = own * np.uint64(0x9E3779B97F4A7C15), (own ^ (own >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) | np.uint64(1)
        here = np.ones(len(own), bool)
        for k in range(PROBES):
            at = ((a + b * np.uint64(k)) >> (np.uint64(64) - self.bits[to])) + self.start[to]
            here &= (self.data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        found[found] = here
        return found


def twice_filters(plain: DataFrame, least: int, segments: int) -> Twice:
    room = max(10, int(np.log2((TWICE_MB << 23) / segments)))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def packed() -> pa.RecordBatch:
            unique, count = np.unique(np.concatenate(held), return_counts=True)
            unique = np.concatenate([unique, unique[count > 1]])  # two of a key are as good as more
            to = (unique % np.uint64(segments)).astype(np.int32)
            order = np.argsort(to, kind="stable")
            full, first = np.unique(to[order], return_index=True)
            unique, ends = unique[order], [*first[1:].tolist(), len(unique)]
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([unique[i:j].tobytes() for i, j in zip(first.tolist(), ends, strict=True)], pa.binary())], names=["segment", "packed"])

        for batch in batches:
            own = hashes([k for t in raw_texts(batch) for k in {*keys_of(t, least)} if k])
            held.append(own)
            n += len(own)
            if n >= CHUNK:
                yield packed()
                held, n = [], 0
        if n:
            yield packed()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A segment at a time."""
        now, once, again = None, Bloom(10), []

        def row() -> Iterator[pa.RecordBatch]:
            if again:
                unique = np.unique(np.concatenate(again))
                b = Bloom(min(room, max(10, 4 + int(np.ceil(np.log2(len(unique) + 1))))))
                b.add(unique)
                yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([b.bits], pa.int32()), pa.array([b.data.tobytes()], pa.binary())], names=["segment", "bits", "data"])

        for batch in batches:
            for segment, packed in zip(batch.column("segment").to_pylist(), batch.column("packed").to_pylist(), strict=True):
                if segment != now:
                    yield from row()
                    now, once, again = segment, Bloom(ONCE_BITS), []
                h = np.frombuffer(packed, np.uint64)
                repeat = np.ones(len(h), bool)
                repeat[np.unique(h, return_index=True)[1]] = False
                seen = once.has(h) | repeat
                once.add(h)
                if seen.any():
                    again.append(np.unique(h[seen]))
        yield from row()

    dealt = plain.select("text").mapInArrow(returning(emit), "segment int, packed binary").repartition(segments, "segment").sortWithinPartitions("segment")
    found = dealt.mapInArrow(returning(build), "segment int, bits int, data binary").toLocalIterator()
    return Twice(segments, [(r.segment, r.bits, bytes(r.data)) for r in found])


def line_dedup(docs: DataFrame, least: int = 20, documents: int = 3, outputs: tuple[str, ...] = ("n_lines", "n_dropped", "kept"), segments: int | None = None, confirmed_mb: float = CONFIRMED_MB, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept (and rest, if carried): lines whose key has `least` code points or more and stands in `documents` rows or more go, except from the rows with the largest id that holds it."""
    spark = docs.sparkSession
    prepare(spark)
    plain = narrow(docs, id_col, text_col, carry)
    kind = plain.schema["doc_id"].dataType.simpleString()
    if segments is None:  # a key that counts takes `least` bytes and a line end at least
        most = (plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // (least + 1)
        segments = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-most // SEGMENT))
    twice = spark.sparkContext.broadcast(twice_filters(plain, least, segments))
    digest = xxhash.xxh3_128_digest

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, keys = [], []
            for k, text in enumerate(raw_texts(batch)):
                own = [x for x in {*keys_of(text, least)} if x]
                keys += own
                rows += [k] * len(own)
            found = np.flatnonzero(twice.value.has(hashes(keys)))
            place = pa.array(np.array(rows, np.int64)[found])
            yield pa.RecordBatch.from_arrays([pa.array([digest(keys[k]) for k in found], pa.binary()), *(batch.column(c).take(place) for c in batch.schema.names if c != "text")], names=["digest", *(c for c in batch.schema.names if c != "text")])

    pairs = plain.select("doc_id", "text").mapInArrow(returning(suspects), f"digest binary, doc_id {kind}")
    grouped = pairs.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper")).filter(F.col("n") >= documents)
    confirmed, path = settle(spark, grouped.select("digest", "keeper"), "line-keys")

    def rows(batch: pa.RecordBatch, texts: list[bytes], keys: list[list[bytes]], drops: list) -> pa.RecordBatch:
        """drops: for each row, the keys that lose their lines."""
        n, gone, kept = [], [], []
        for text, own, drop in zip(texts, keys, drops, strict=True):
            n.append(len(own))
            if not drop:
                gone.append(0)
                kept.append(text)
                continue
            left = [line for line, key in zip(text.split(b"\n"), own, strict=True) if key not in drop]
            gone.append(len(own) - len(left))
            kept.append(b"\n".join(left))
        made = {"n_lines": pa.array(n, pa.int64()), "n_dropped": pa.array(gone, pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string())}
        more = ["rest"] if carry else []
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(made[k] for k in outputs), *(batch.column(k) for k in more)], names=["doc_id", *outputs, *more])

    schema = rows_of(f"doc_id {kind}, " + ", ".join(f"{k} {'string' if k == 'kept' else 'long'}" for k in outputs), plain)
    if confirmed.count() * ENTRY <= confirmed_mb * (1 << 20):
        keeper = spark.sparkContext.broadcast({bytes(r.digest): r.keeper for r in confirmed.toLocalIterator()})
        remove(spark, path)

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = keeper.value
            for batch in batches:
                texts, ids = raw_texts(batch), batch.column("doc_id").to_pylist()
                keys = [keys_of(t, least) for t in texts]
                own = [*{k for x in keys for k in x if k}]
                known = [own[k] for k in np.flatnonzero(twice.value.has(hashes(own)))]
                goes = {k: table[d] for k in known if (d := digest(k)) in table}
                yield rows(batch, texts, keys, [{k for k in x if k in goes and goes[k] != i} for x, i in zip(keys, ids, strict=True)])

        return plain.mapInArrow(returning(apply), schema)

    # rows are known by id and text, so that none gathers more than its own lines' keys, also where ids repeat or are null
    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([*map(digest, raw_texts(batch))], pa.binary())], names=[*batch.schema.names, "row"])

    whole = plain.mapInArrow(returning(named), T.StructType([*plain.schema.fields, T.StructField("row", T.BinaryType())]))
    spots, _ = settle(spark, whole.select("doc_id", "row", "text").mapInArrow(returning(suspects), f"digest binary, doc_id {kind}, row binary"), "line-spots")
    gone = lookup(spots, confirmed.withColumn("confirmed", F.lit(True)), "digest").filter(F.col("confirmed") & ~F.col("doc_id").eqNullSafe(F.col("keeper")))
    drops = gone.groupBy(F.col("doc_id").alias("drop_id"), F.col("row").alias("drop_row")).agg(F.collect_set("digest").alias("drops"))
    joined = whole.join(drops, (F.col("row") == F.col("drop_row")) & F.col("doc_id").eqNullSafe(F.col("drop_id")), "left").select(*plain.columns, "drops")

    def apply_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, goes = raw_texts(batch), [{*x} if x else () for x in batch.column("drops").to_pylist()]
            keys = [keys_of(t, least) for t in texts]
            yield rows(batch, texts, keys, [{k for k in x if k and digest(k) in g} if g else () for x, g in zip(keys, goes, strict=True)])

    return joined.mapInArrow(returning(apply_joined), schema)


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The contract's digest columns."""
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


SQL = """
WITH l AS (SELECT doc_id, u.line, u.n FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), LATERAL (SELECT unnest(ls) AS line, generate_subscripts(ls, 1) AS n) u),
k AS (SELECT doc_id, n, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.doc_id, k.n, k.line, c.key IS NULL OR c.keeper = k.doc_id AS stays FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT stays) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE stays), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
