"""WARC archives: deduplicating writer, and a reader that trusts no magic bytes by themselves.

Writing. Payload digests pick, by a narrow grouping, the record that holds a payload; later equals become revisits that name it. Each task
streams its records, one gzip member each, to archives of up to ARCHIVE_MB in the shared folder; a name is used only once, so a task run
again leaves nothing half written in the list of archives, which is the tasks' own output.

Reading. An archive is read in blocks. Each task looks at every gzip magic in its block, magics inside payloads included, and emits for each
candidate record its successor: the offset where the member ends, if the member inflates and starts as a WARC record. Within a block the
chains are followed at once, so that a candidate's successor is the first offset beyond the block. Pointer jumping then doubles successors
from each archive's start until nothing new is reached: log2(blocks) joins over narrow rows. Only records on a reached chain are parsed.

Null payloads are empty ones. Rows whose id is the smallest of their payload are responses, repeated rows too. Payloads under `least` bytes
are always responses. An archive that breaks off gives the records before the break. A row without an id is a record under `null`, and a
revisit if a row with an id has its payload. A very long payload is one record, in memory once a task. An empty table gives no archive and no record; other columns are
not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import lookup, opened, prepare, scratch_path, settle

#: Bytes of an archive before the next begins, and of a block that one row of the reader's task list covers.
ARCHIVE_MB, BLOCK_MB = 64, 4
MAGIC = b"\x1f\x8b\x08"
SCHEMA = "page_id string, record_type string, payload_digest string, payload_bytes long, refers_to string, payload binary"


def record(page_id: str, uri: str, payload: bytes | None, size: int, digest: str, refers: str | None) -> bytes:
    """One member. Line ends and letters beyond ASCII in head values are escaped."""
    safe = lambda x: x.encode("unicode_escape").decode()
    kind = "response" if refers is None else "revisit"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:x-page:{safe(page_id)}>", f"WARC-Target-URI: {safe(uri)}", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {size}"]
    if refers is not None:
        head += [f"WARC-Refers-To: <urn:x-page:{safe(refers)}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    body = payload if refers is None else b""
    head += ["Content-Type: text/html", f"Content-Length: {len(body)}"]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + squeeze.flush()


def parsed(data: bytes) -> tuple | None:
    head, found, rest = data.partition(b"\r\n\r\n")
    if not found or not head.startswith(b"WARC/"):
        return None
    field = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    plain = lambda x: x.removeprefix("<urn:x-page:").removesuffix(">").encode().decode("unicode_escape")
    n = int(field["Content-Length"])
    refers = field.get("WARC-Refers-To")
    return plain(field["WARC-Record-ID"]), field["WARC-Type"], field["WARC-Payload-Digest"].removeprefix("sha256:"), int(field["WARC-Payload-Length"]), refers and plain(refers), rest[:n]


def choose(pages: DataFrame, least: int) -> DataFrame:
    """page_id, uri, html, size, digest, holder (null: this row is a response). Only ids and digests are grouped; payloads move once."""
    size, digest = F.octet_length("html").cast("long"), F.sha2("html", 256)
    narrow, _ = settle(pages.sparkSession, pages.select("page_id", digest.alias("digest"), size.alias("size")).filter(F.col("size") >= least).drop("size"), "digests")
    holders = narrow.groupBy("digest").agg(F.min("page_id").alias("holder"), F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).select("digest", "holder")
    holders = holders.withColumn("held", F.lit(True))
    later = lookup(narrow, holders, "digest").filter(F.col("held") & ~F.col("page_id").eqNullSafe(F.col("holder"))).select(F.col("page_id").alias("later_id"), F.col("digest").alias("later_digest"), "holder").dropDuplicates(["later_id", "later_digest"])
    full = pages.select("page_id", "uri", "html", size.alias("size"), digest.alias("digest"))
    return full.join(later, F.col("page_id").eqNullSafe(F.col("later_id")) & (F.col("digest") == F.col("later_digest")), "left").select("page_id", "uri", "html", "size", "digest", "holder")


def write_warc(pages: DataFrame, folder: str, least: int = 100, id_col: str = "page_id", html_col: str = "html", url_col: str = "url", archive_mb: float = ARCHIVE_MB) -> DataFrame:
    """Write archives into the folder (any store that pyarrow opens); returns a settled table of (archive, bytes, records)."""
    spark = pages.sparkSession
    prepare(spark)
    plain = pages.select(pages[id_col].alias("page_id"), pages[url_col].cast("string").alias("uri"), F.coalesce(pages[html_col].cast("string"), F.lit("")).alias("html"))
    fs, at = opened(folder)
    fs.create_dir(at, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        fs, at = opened(folder)
        out, name, size, n = None, "", 0, 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size], pa.int64()), pa.array([n], pa.int64())], names=["archive", "bytes", "records"])

        for batch in batches:
            for page, uri, html, length, digest, holder in zip(*(batch.column(c).to_pylist() for c in ("page_id", "uri", "html", "size", "digest", "holder")), strict=True):
                if out is None:
                    name, size, n = f"part-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{at}/{name}", compression=None)
                data = record("null" if page is None else str(page), uri or "", html.encode(), length, digest, None if holder is None else str(holder))
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= archive_mb * (1 << 20):
                    out.close()
                    out = None
                    yield row()
        if out is not None:
            out.close()
            yield row()

    listed = choose(plain, least).mapInArrow(write, "archive string, bytes long, records long")
    listed.write.parquet(f"{folder.rstrip('/')}/archives.parquet")
    return spark.read.schema(listed.schema).parquet(f"{folder.rstrip('/')}/archives.parquet")


class Window:
    """Random reads of one archive, a few MB at a time."""

    def __init__(self, fs: pafs.FileSystem, path: str, size: int):
        self.file, self.size, self.start, self.data = fs.open_input_file(path), size, 0, b""

    def read(self, at: int, n: int) -> bytes:
        if not (self.start <= at and at + n <= self.start + len(self.data)):
            self.start, self.data = at, self.file.read_at(min(max(n, 1 << 20), self.size - at), at)
        return self.data[at - self.start : at - self.start + n]

    def member(self, at: int, keep: bool) -> tuple[int, bytes] | None:
        """Where the member at this offset ends, and what it holds if kept; None if it isn't a whole WARC record."""
        inflate, first, kept, pos = zlib.decompressobj(31), b"", [], at
        try:
            while not inflate.eof:
                part = self.read(pos, min(1 << 16, self.size - pos))
                if not part:
                    return None
                pos += len(part)
                data = inflate.decompress(part)
                if len(first) < 5:
                    first += data[:5]
                    if not b"WARC/".startswith(first[:5]):
                        return None
                if keep:
                    kept.append(data)
        except zlib.error:
            return None
        return pos - len(inflate.unused_data), b"".join(kept)


def candidates(window: Window, start: int, end: int) -> dict[int, int]:
    """Candidate record to successor, for the gzip magics that begin in [start, end)."""
    out, base = {}, start
    while base < end:
        n = min(1 << 20, end - base)
        data = window.file.read_at(min(n + 2, window.size - base), base)
        k = data.find(MAGIC)
        while 0 <= k < n:
            if (got := window.member(base + k, False)) is not None:
                out[base + k] = got[0]
            k = data.find(MAGIC, k + 1)
        base += n
    return out


def read_warc(archives: DataFrame, folder: str, block_mb: float = BLOCK_MB) -> DataFrame:
    """Records of the listed archives: SCHEMA. archives: (archive, bytes)."""
    spark = archives.sparkSession
    prepare(spark)
    step = int(block_mb * (1 << 20))
    blocks = archives.filter("bytes > 0").select("archive", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), ((F.col("bytes") - 1) / step).cast("long"))).alias("block"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = blocks.repartition(parts, "archive", "block")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = opened(folder)
        for batch in batches:
            for archive, size, block in zip(*(batch.column(c).to_pylist() for c in ("archive", "bytes", "block")), strict=True):
                end = min(size, (block + 1) * step)
                chain = candidates(Window(fs, f"{at}/{archive}", size), block * step, end)
                for a in sorted(chain, reverse=True):  # successors are larger, so theirs are known
                    chain[a] = chain.get(chain[a], chain[a]) if chain[a] < end else chain[a]
                n = len(chain)
                yield pa.RecordBatch.from_arrays([pa.array([archive] * n, pa.string()), pa.array([*chain], pa.int64()), pa.array([*chain.values()], pa.int64())], names=["archive", "at", "to"])

    path = scratch_path(spark, "warc-links")
    schema = "archive string, at long, to long"
    blocks.mapInArrow(emit, schema).write.parquet(f"{path}/jump0")
    jumps = spark.read.schema(schema).parquet(f"{path}/jump0")
    reached = archives.filter("bytes > 0").select("archive", F.lit(0).cast("long").alias("at"))
    known, turn = -1, 0
    while True:  # reached doubles in length along each chain
        more = reached.join(jumps, ["archive", "at"]).select("archive", F.col("to").alias("at"))
        reached = reached.unionByName(more).dropDuplicates(["archive", "at"])
        turn += 1
        reached.write.parquet(f"{path}/reached{turn}")
        reached = spark.read.schema("archive string, at long").parquet(f"{path}/reached{turn}")
        if (n := reached.count()) == known:
            break
        known = n
        then = jumps.select("archive", F.col("at").alias("to"), F.col("to").alias("then"))
        jumps.join(then, ["archive", "to"]).select("archive", "at", F.col("then").alias("to")).write.parquet(f"{path}/jump{turn}")
        jumps = spark.read.schema(schema).parquet(f"{path}/jump{turn}")
    starts = reached.join(archives.select("archive", "bytes"), "archive").withColumn("block", (F.col("at") / step).cast("long")).filter(F.col("at") < F.col("bytes")).repartition(parts, "archive", "block")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = opened(folder)
        for batch in batches:
            for archive, size, block, at in zip(*(batch.column(c).to_pylist() for c in ("archive", "bytes", "block", "at")), strict=True):
                window, end, rows, held = Window(fs, f"{root}/{archive}", size), min(size, (block + 1) * step), [], 0
                while at < end and (got := window.member(at, True)) is not None:
                    at = got[0]
                    if (row := parsed(got[1])) is not None:
                        rows.append(row)
                        held += len(row[5])
                    if held > 8 << 20 or at >= end:
                        yield as_batch(rows)
                        rows, held = [], 0
                if rows:
                    yield as_batch(rows)

    return starts.select("archive", "bytes", "block", "at").mapInArrow(parse, SCHEMA)


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    names = ["page_id", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)


def query(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write all pages, read the archives back; a response's digest and size are taken from the payload that was read."""
    folder = scratch_path(spark, "warc")
    kind = pages.schema["page_id"].dataType.simpleString()
    read = read_warc(write_warc(pages, folder), folder)
    own = F.col("record_type") == "response"
    return read.select(
        F.expr(f"try_cast(page_id as {kind})").alias("page_id"), F.when(own, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(own, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", F.expr(f"try_cast(refers_to as {kind})").alias("refers_to"),
    )


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS holder FROM d GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND holder <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND holder <> page_id THEN holder END AS refers_to
FROM d JOIN f USING (payload_digest)
"""
