"""Benchmark decontamination through an FM-index of each training shard.

A shard is as many consecutive documents of a task as give SHARD words. Words that no benchmark item has can't be part of a match: each
run of them, and each document's end, is one unique terminator, so that the shard's text is words of the benchmark's vocabulary between
terminators. Its suffixes are sorted by prefix doubling, the Burrows-Wheeler transform goes into a wavelet matrix (one bit vector a bit of
the symbol, with counted blocks), and all phrases are searched backwards at once: a step is two rank queries for each phrase whose range
isn't empty yet. Occurrences are located by walking to sampled suffix positions (the first word of each run and every STEP-th after it).
Spans of occurrences merge into removal spans.

A phrase is a window of `window` consecutive item words; an item with fewer, but not none, is one phrase. Null or empty texts have no
words. Item ids count once, however often they repeat; items without an id hit words, but aren't listed. Repeated documents each give a row.
A very long text is a shard by itself. Other columns, whatever their names, don't meddle; an empty table gives none.

The benchmark goes to the workers in blocks of flat arrays, measured in bytes as built (BLOCK_MB each). One block is one map over the scan,
with no shuffle. Of more blocks each is a pass that writes the hits alone (digest of the text, spans, items), which then are joined to the
documents by that digest; texts are never written again.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import LOWER, UPPER, narrow, prepare, remove, returning, rows_of, settle, size_of

#: Words of a shard, steps between samples, MB of a worker that a block of phrases takes, MB of hits that are broadcast.
SHARD, STEP, BLOCK_MB, HITS_MB = 1_000_000, 8, 32, 64
#: What a word takes in a worker's vocabulary besides its bytes, and a window in the arrays.
ENTRY, WINDOW_BYTES = 150, 16
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans(UPPER, LOWER)
#: Bytes of UTF-8: A-Z folded, word bytes kept, any other a space.
BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(BYTES).split()


class Phrases:
    """The windows of a block of items as places in one array of word numbers, each window once, with the items that have it.

    start, length: where a phrase stands in `words`. owner[first[p] : first[p + 1]]: the items of phrase p, as places in `names`.
    """

    def __init__(self, window: int):
        self.window, self.vocabulary, self.names, self.size = window, {}, [], 0
        self.parts: list[np.ndarray] = []

    def add(self, item: object, text: str | None) -> None:
        found, known = words_of(text), len(self.vocabulary)
        ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in found], np.int32)
        if len(ids):
            self.names.append(None if item is None else str(item))
            self.parts.append(ids)
            self.size += 4 * len(ids) + WINDOW_BYTES * max(1, len(ids) - self.window + 1)
            self.size += sum(ENTRY + len(w) for w in {*found} if self.vocabulary[w] > known)

    def close(self) -> Phrases:
        """Fix the arrays; nothing is added after."""
        sizes = np.array([len(p) for p in self.parts], np.int64)
        self.words = np.concatenate([*self.parts, np.zeros(0, np.int32)]).astype(np.int32)
        begins, self.parts = np.cumsum(sizes) - sizes, []
        windows = np.maximum(1, sizes - self.window + 1)
        owner = np.repeat(np.arange(len(sizes)), windows).astype(np.int32)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        start, length = begins[owner] + within, np.minimum(sizes, self.window)[owner]
        # equal windows stand together: rows of words, zeros after the end of short ones
        rows = np.zeros((len(owner), self.window), np.int32)
        for k in range(self.window):
            own = length > k
            rows[own, k] = self.words[start[own] + k]
        _, lead, same = np.unique(rows.view([("", np.int32)] * self.window).ravel(), return_index=True, return_inverse=True)
        pairs = np.unique(same.astype(np.int64) << 32 | owner)
        self.owner = (pairs & 0xFFFFFFFF).astype(np.int32)
        self.first = np.searchsorted(pairs >> 32, np.arange(len(lead) + 1)).astype(np.int32)
        self.start, self.length = start[lead].astype(np.int32), length[lead].astype(np.int16)
        return self

    def last(self, which: np.ndarray, back: int) -> np.ndarray:
        """The word `back` places before the end of each phrase, 0 where it is shorter."""
        at = self.start[which].astype(np.int64) + self.length[which] - 1 - back
        return np.where(self.length[which] > back, self.words[np.maximum(at, 0)], 0).astype(np.int64)


class Bits:
    """A bit vector with rank."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        block = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block] + np.bitwise_count(self.words[block] & mask)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class Wavelet:
    """A wavelet matrix: level by level, the highest bit of all symbols first, zeros before ones."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels: list[tuple[int, Bits, int]] = []
        for shift in range(bits - 1, -1, -1):
            one = (symbols >> shift & 1).astype(bool)
            self.levels.append((shift, Bits(one), int(len(one) - one.sum())))
            symbols = np.concatenate([symbols[~one], symbols[one]])
        at = np.flatnonzero(np.diff(symbols, prepend=-1))
        self.first = np.zeros(1 << bits, np.int64)  # where a symbol's own stretch starts on the last level
        self.first[symbols[at]] = at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        for shift, bits, zeros in self.levels:
            ones = bits.rank(at)
            at = np.where(symbol >> shift & 1, zeros + ones, at - ones)
        return at - self.first[symbol]

    def step(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and how often it stands before it."""
        symbol = np.zeros(len(at), np.int64)
        for shift, bits, zeros in self.levels:
            one, ones = bits.get(at), bits.rank(at)
            symbol |= one.astype(np.int64) << shift
            at = np.where(one, zeros + ones, at - ones)
        return symbol, at - self.first[symbol]


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffixes in order; 0 is a terminator, each smaller than any word and than later terminators. The last symbol is one."""
    n, stop = len(symbols), symbols == 0
    stops = int(stop.sum())
    rank = np.where(stop, np.cumsum(stop) - 1, symbols + stops).astype(np.int64)
    follow = np.append(rank[1:], 0)
    order = np.argsort(rank << 32 | follow, kind="stable")
    step, part, keys = 2, order, (rank << 32 | follow)[order]
    place = np.arange(n)  # where the part's suffixes stand in the order
    rank = np.empty(n, np.int64)
    while True:
        new = np.diff(keys, prepend=-1) != 0
        rank[part] = place[np.maximum.accumulate(np.where(new, np.arange(len(part)), 0))]
        alone = new & np.append(new[1:], True)
        part, place = part[~alone], place[~alone]
        if not len(part):
            return order
        keys = rank[part] << 32 | rank[np.minimum(part + step, n - 1)]
        by = np.argsort(keys, kind="stable")
        part, keys = part[by], keys[by]
        order[place] = part
        step *= 2


class Index:
    """The FM-index of one shard."""

    def __init__(self, symbols: np.ndarray, words: int):
        order = suffix_order(symbols)
        bits = max(1, int(words).bit_length())
        self.wavelet = Wavelet(symbols[order - 1], bits)
        self.start = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=words + 1))])[: words + 2]
        stop = np.flatnonzero(symbols == 0)
        run = np.zeros(len(symbols), np.int64)
        run[stop[stop + 1 < len(symbols)] + 1] = stop[stop + 1 < len(symbols)] + 1
        inside = np.arange(len(symbols)) - np.maximum.accumulate(run)
        sampled = (inside % STEP == 0)[order]
        self.sampled, self.samples = Bits(sampled), order[sampled]

    def search(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """Phrase and position of each occurrence."""
        n = len(phrases.start)
        live = np.arange(n)
        end = phrases.last(live, 0)
        low, high = self.start[end], self.start[end + 1]
        for back in range(1, phrases.window):
            live = live[(low < high)[live]]
            c = phrases.last(live, back)
            more = live[c > 0]
            c = c[c > 0]
            if len(more):
                both = self.wavelet.rank(np.concatenate([c, c]), np.concatenate([low[more], high[more]]))
                low[more], high[more] = self.start[c] + both[: len(more)], self.start[c] + both[len(more) :]
        count = np.maximum(high - low, 0)
        phrase = np.repeat(np.arange(n), count)
        row = np.arange(len(phrase)) - np.repeat(np.cumsum(count) - count, count) + low[phrase]
        return phrase, self.locate(row)

    def locate(self, row: np.ndarray) -> np.ndarray:
        at, walked, todo, row = np.zeros(len(row), np.int64), 0, np.arange(len(row)), row.copy()
        while len(todo):
            done = self.sampled.get(row)
            at[todo[done]] = self.samples[self.sampled.rank(row[done])] + walked
            todo, row = todo[~done], row[~done]
            if len(todo):
                symbol, before = self.wavelet.step(row)
                row = self.start[symbol] + before
                walked += 1
        return at


def numbered(text: str | None, phrases: Phrases) -> np.ndarray:
    """The text's words as the vocabulary's numbers, 0 for any other: 4 bytes a word are kept, not the words."""
    get = phrases.vocabulary.get
    return np.fromiter((get(w, 0) for w in words_of(text)), np.int32)


def search_shard(texts: list[np.ndarray], phrases: Phrases) -> tuple[list[list[tuple[int, int]]], list[set[str]]]:
    """For each document its hit words as merged [start, end) word spans, and the items found."""
    parts, of, where = [], [], []
    for k, words in enumerate(texts):
        ids = np.append(words, np.int32(0))
        keep = (ids > 0) | np.append(True, ids[:-1] > 0)
        keep[-1] = True
        at = np.flatnonzero(keep)
        parts.append(ids[at])
        of.append(np.full(len(at), k))
        where.append(at)
    symbols, of, where = np.concatenate(parts).astype(np.int64), np.concatenate(of), np.concatenate(where)
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[set[str]] = [set() for _ in texts]
    if not symbols.any() or not len(phrases.start):
        return spans, items
    phrase, at = Index(symbols, len(phrases.vocabulary)).search(phrases)
    change = np.zeros(len(symbols) + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + phrases.length[phrase].astype(np.int64), -1)
    hit = np.cumsum(change)[:-1] > 0
    edge = np.flatnonzero(np.diff(hit, prepend=False, append=False))
    for a, b in zip(edge[::2], edge[1::2], strict=True):
        spans[of[a]].append((int(where[a]), int(where[a]) + int(b - a)))
    for k, p in set(zip(of[at].tolist(), phrase.tolist(), strict=True)):
        items[k].update(name for o in phrases.owner[phrases.first[p] : phrases.first[p + 1]] if (name := phrases.names[o]) is not None)
    return spans, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def char_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word spans as code-point spans of the text."""
    at = [m.span() for m in WORD.finditer(text.translate(FOLD))]
    return [(at[a][0], at[b - 1][1]) for a, b in spans]


SPANS = "array<struct<a:int,b:int>>"
SCHEMA = f"n_words long, n_hit long, words {SPANS}, spans {SPANS}, items array<string>"
PAIRS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def as_pairs(spans: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"a": a, "b": b} for a, b in s] for s in spans], PAIRS)


def digest_of(text: str | None) -> bytes:
    return xxhash.xxh3_128_digest((text or "").encode())


def searched(batches: Iterator[pa.RecordBatch], phrases: Phrases, shard: int) -> Iterator[tuple[pa.RecordBatch, list[int], list, list]]:
    """Each batch with its texts' numbers of words, hit spans and items, a shard at a time."""
    waiting, texts, n = [], [], 0

    def flush() -> Iterator[tuple]:
        spans, items = search_shard(texts, phrases)
        at = 0
        for batch in waiting:
            own = slice(at, at := at + batch.num_rows)
            yield batch, [len(t) for t in texts[own]], spans[own], items[own]

    for batch in batches:
        own = [numbered(t, phrases) for t in batch.column("text").to_pylist()]
        waiting.append(batch)
        texts += own
        n += sum(map(len, own))
        if n >= shard:
            yield from flush()
            waiting, texts, n = [], [], 0
    if waiting:
        yield from flush()


def result(batch: pa.RecordBatch, n_words: list[int], spans: list, items: list, more: list[str]) -> pa.RecordBatch:
    texts = batch.column("text")
    chars = [char_spans(texts[k].as_py(), s) if s else [] for k, s in enumerate(spans)]
    made = [pa.array(n_words, pa.int64()), pa.array([sum(b - a for a, b in s) for s in spans], pa.int64()), as_pairs(spans), as_pairs(chars), pa.array([sorted(i) for i in items], pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), texts, *made, *(batch.column(k) for k in more)], names=["doc_id", "text", "n_words", "n_hit", "words", "spans", "items", *more])


def blocks_of(benchmark: DataFrame, window: int, block_mb: float) -> Iterator[Phrases]:
    """benchmark: i (item), t (text). At least one block, each of block_mb or one item."""
    block = Phrases(window)
    for row in benchmark.toLocalIterator():
        if block.size > block_mb * (1 << 20):
            yield block.close()
            block = Phrases(window)
        block.add(row.i, row.t)
    yield block.close()


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, block_mb: float = BLOCK_MB, shard: int = SHARD, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", carry: bool = False, hits_mb: float = HITS_MB) -> DataFrame:
    """doc_id, text, n_words, n_hit, words and spans (merged removal spans, of words and of code points), items (found, as sorted strings), rest (if carried)."""
    spark = docs.sparkSession
    prepare(spark)
    plain = narrow(docs, id_col, text_col, carry)
    more = ["rest"] if carry else []
    schema = rows_of(f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, text string, {SCHEMA}", plain)
    blocks = blocks_of(benchmark.select(benchmark[item_col].alias("i"), benchmark[item_text_col].cast("string").alias("t")), window, block_mb)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        sent = spark.sparkContext.broadcast(first)

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, n_words, spans, items in searched(batches, sent.value, shard):
                yield result(batch, n_words, spans, items, more)

        return plain.mapInArrow(returning(whole), schema)

    hits, paths = None, []
    for block in itertools.chain([first, second], blocks):
        own, path = settle(spark, block_hits(plain, block, shard), "hits")
        hits = own if hits is None else hits.union(own)
        paths.append(path)
    hits = hits.groupBy("digest").agg(F.flatten(F.collect_set("words")).alias("words"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    hits, path = settle(spark, hits, "hits")
    remove(spark, *paths)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            made = pa.array([len(words_of(t)) for t in texts], pa.int64()), pa.array([digest_of(t) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "n_words", "digest"])

    counted = plain.mapInArrow(returning(keyed), T.StructType([*plain.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("digest", T.BinaryType())]))
    few = size_of(spark, path) <= hits_mb * (1 << 20)
    joined = counted.join(F.broadcast(hits) if few else hits, "digest", "left").select("doc_id", "text", "n_words", "words", "items", *more)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [merged([(x["a"], x["b"]) for x in s or ()]) for s in batch.column("words").to_pylist()]
            yield result(batch, batch.column("n_words").to_pylist(), spans, [i or () for i in batch.column("items").to_pylist()], more)

    return joined.mapInArrow(returning(merge), schema)


def block_hits(plain: DataFrame, block: Phrases, shard: int) -> DataFrame:
    """(digest, words, items) of the texts that a block of phrases hits; a task gives equal texts once, mostly."""
    sent = plain.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch, _, spans, items in searched(batches, sent.value, shard):
            found = [(digest_of(batch.column("text")[k].as_py()), k) for k, s in enumerate(spans) if s]
            own = [(d, k) for d, k in found if d not in seen and not seen.add(d)]
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in own], pa.binary()), as_pairs([spans[k] for _, k in own]), pa.array([sorted(items[k]) for _, k in own], pa.list_(pa.string()))], names=["digest", "words", "items"])
            seen = seen if len(seen) < 200_000 else set()

    return plain.select("text").mapInArrow(returning(run), f"digest binary, words {SPANS}, items array<string>")


def judged(found: DataFrame) -> DataFrame:
    """The contract's columns: contaminated if hit words are a twentieth of all or more."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def query(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return judged(decontaminate(docs, benchmark))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[k : k + least(len(w), 13) - 1], ' ') AS phrase FROM b, LATERAL (SELECT unnest(generate_series(1, greatest(len(w) - 12, 1))) AS k) WHERE len(w) > 0),
s AS (SELECT DISTINCT n FROM p),
g AS (SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS phrase FROM d, s, LATERAL (SELECT unnest(generate_series(1, len(w) - n + 1)) AS k) WHERE len(w) >= n),
h AS (SELECT g.doc_id, g.k, g.n, p.item_id FROM g JOIN p ON g.n = p.n AND g.phrase = p.phrase),
x AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(generate_series(k, k + n - 1)) AS pos FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN x USING (doc_id) LEFT JOIN i USING (doc_id)
"""
