"""Exact n-gram Jaccard self-join with signature trees.

1. Every text becomes a set of hashes of its distinct word shingles, 48 bits each; equal sets are one from here on. A task writes its sets to
   chunk files in the shared folder, so that texts are read once and a lost executor costs no more than its own tasks.
2. Each chunk asks in how many sets its shingles are: the questions are dealt by shingle, 4 bytes each, counted, and answered with a level a
   shingle (0: one set's own; else by the logarithm of the count). Nothing is broadcast, and counts are exact up to 48 bits at every size.
3. Blocks. Two sets that link share a shingle among the first |s| - ceil(0.8 |s|) + 1 of either in any one order of shingles (here rare ones
   first, by level), and their sizes differ by a quarter at most. Sets that share such a shingle in near size classes get a chain of candidate
   edges (not all pairs): within a task first, so that a shingle which a third of all rows have moves once a chunk and size class, then over
   all chunks. The components of these edges are blocks; no link leaves a block.
4. A block of more than SETS sets or BLOCK shingles is dealt to chunks by hash, twice with different salts, and each chunk is searched by
   itself; near copies are mostly one component after that. Sets outside their block's largest component are then compared with all others
   of near size classes, chunk by chunk, so that no pair is left out but those that are known to be in one component.
5. In a chunk, or a pair of chunks, sets ordered by minima of their hashes are the leaves of a signature tree. A node holds the OR of its
   sets' bitmaps and the range of their sizes. Two nodes are compared only if some pair below them may overlap enough: by their sizes, and by
   the bits they share. Nodes that already are wholly in one component are passed over. What is left is compared exactly.
6. The edges of each search's spanning forest, with the members of each equal set, give every document its component.

Links: 100 * |intersection| >= 80 * |union|. Null texts and texts without words are empty sets, which link with nothing, not even with each
other. A null id takes part as itself and never is a component's id unless all ids there are null. Repeated rows each give a row. A very long
text is one set, in memory once a task. An empty table gives none. Other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import BYTES_LOWER, lookup, narrow, opened, prepare, remove, returning, scratch_path, settle
from tidemark.llm.components import components

#: Words of a shingle; the threshold as numerator and denominator.
WORDS, UP, DOWN = 5, 4, 5
#: Shingles of a chunk file; questions that one counting task holds; sets and shingles of a block's chunk; rows to broadcast (64 bytes each).
CHUNK, ASKED, SETS, BLOCK, SENT = 2_000_000, 16_000_000, 256, 1_000_000, 100_000
MEMO = 150_000
LEAF = 16


class Hashes(dict):
    """Memo of word hashes."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_MEMO = Hashes()
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX[3]
    h = (h ^ (h >> np.uint64(29))) * _MIX[4]
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's n-word shingles; of the whole sequence if it is shorter; none without words."""
    words = (text or "").encode().translate(BYTES_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.array([*map(_MEMO.__getitem__, words)], np.uint64)
    if len(h) < n:
        return np.array([xxhash.xxh3_64_intdigest(h.tobytes(), seed=1)], np.uint64)
    total = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        total = mixed(total * _MIX[k % 3] + h[k : k + len(total)])
    return np.unique(total)


def digest_of(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def node_of(digest: bytes, at: int) -> int:
    """A set's number among edges, from eight bytes of its digest, so that a row needs no id to take part; a clash is found in blocked()."""
    return int.from_bytes(digest[at : at + 8], "little", signed=True)


#: Size classes, whose bounds lie a factor of the root of 5/4 apart: sets of classes more than two apart can't link.
STEP = float(np.log(DOWN / UP) / 2)


def size_class(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log(np.maximum(n, 1)) / STEP + 1e-9).astype(np.int64)


def prefix_length(n: int) -> int:
    return n - (UP * n + DOWN - 1) // DOWN + 1


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the edges: (node, smallest node)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = np.minimum(new, new[new])
        new = new[new][label]
        if (new == label).all():
            break
        label = new
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def chained(key: np.ndarray, cls: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidate edges between neighbours of one key, in order of size class, where classes are two apart at most."""
    order = np.lexsort((node, cls, key))
    key, cls, node = key[order], cls[order], node[order]
    near = (key[1:] == key[:-1]) & (cls[1:] - cls[:-1] <= 2) & (node[1:] != node[:-1])
    return node[1:][near], node[:-1][near]


def packed(*columns: np.ndarray) -> list[bytes]:
    return [np.ascontiguousarray(c).tobytes() for c in columns]


def part_of(key: np.ndarray, parts: int) -> np.ndarray:
    return (key % np.uint64(parts)).astype(np.int32)


def short(key: np.ndarray) -> np.ndarray:
    """32 bits besides the part: two shingles that share them only add a candidate, or pass for frequent."""
    return (key >> np.uint64(16)).astype(np.uint32)


def split_by(to: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parts that have rows, cuts)"""
    order = np.argsort(to, kind="stable")
    cuts = np.searchsorted(to[order], np.arange(parts + 1))
    return order, np.flatnonzero(np.diff(cuts)), cuts


# ---- chunk files ----


def write_chunk(folder: str, nodes: list[int], sets: list[np.ndarray]) -> str:
    """Nodes, sizes, and the upper six bytes of each hash."""
    fs, at = opened(folder)
    name = f"{uuid.uuid4().hex}.chunk"
    with fs.open_output_stream(f"{at}/{name}", compression=None) as out:
        out.write(np.array([len(nodes)], np.int64).tobytes())
        out.write(np.array(nodes, np.int64).tobytes())
        out.write(np.array([len(s) for s in sets], np.int64).tobytes())
        out.write(np.concatenate(sets).astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes())
    return name


def read_chunk(folder: str, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, sizes, keys of 48 bits, set after set)"""
    fs, at = opened(folder)
    with fs.open_input_file(f"{at}/{name}") as f:
        data = f.read()
    k = int(np.frombuffer(data, np.int64, 1)[0])
    nodes, sizes = np.frombuffer(data, np.int64, k, 8), np.frombuffer(data, np.int64, k, 8 + 8 * k)
    wide = np.zeros((int(sizes.sum()), 8), np.uint8)
    wide[:, :6] = np.frombuffer(data, np.uint8, offset=8 + 16 * k).reshape(-1, 6)
    return nodes, sizes, wide.view("<u8").ravel().astype(np.uint64)


def questions(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A chunk's different keys in the order in which they are asked (by part, those in one set of the chunk before others): keys, counts,
    parts that have any, cuts, and for each element of `keys` its place among them."""
    unique, place, count = np.unique(keys, return_inverse=True, return_counts=True)
    order = np.lexsort((count > 1, part_of(unique, parts)))
    at = np.empty(len(unique), np.int64)
    at[order] = np.arange(len(unique))
    unique, count = unique[order], count[order]
    cuts = np.searchsorted(part_of(unique, parts), np.arange(parts + 1))
    return unique, count, np.flatnonzero(np.diff(cuts)), cuts, at[place]


def spelled(plain: DataFrame, folder: str, byte: int) -> DataFrame:
    """Settled: a row (doc_id, n_shingles, digest, node) for each document; (chunk, n_shingles) for each chunk file."""
    names = ["doc_id", "n_shingles", "digest", "node", "chunk"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, nodes, held, n = set(), [], [], 0

        def chunk() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([n], pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.array([write_chunk(folder, nodes, held)])], names=names)

        for batch in batches:
            sets = [shingles(t) for t in batch.column("text").to_pylist()]
            digests = [digest_of(s) if len(s) else b"" for s in sets]
            numbers = [node_of(d, byte) if d else None for d in digests]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(numbers, pa.int64()), pa.nulls(len(sets), pa.string())], names=names)
            for s, d, node in zip(sets, digests, numbers, strict=True):
                if d and d not in seen:
                    seen.add(d)
                    nodes.append(node)
                    held.append(s)
                    n += len(s)
                    if n >= CHUNK:
                        yield chunk()
                        seen, nodes, held, n = set(), [], [], 0
        if held:
            yield chunk()
        _MEMO.clear()

    return settle(plain.sparkSession, plain.mapInArrow(returning(run), "doc_id long, n_shingles long, digest binary, node long, chunk string"), "sets")


def answered(chunks: DataFrame, folder: str, parts: int) -> DataFrame:
    """(chunk, part, levels): for each question of a chunk, in its order, how frequent the shingle is over all sets."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("chunk").to_pylist():
                keys, count, full, cuts, _ = questions(read_chunk(folder, name)[2], parts)
                key, count = short(keys), np.minimum(count, 65535).astype(np.uint16)
                own = [(key[i:j], count[i:j]) for i, j in zip(cuts[full], cuts[full + 1], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(full), pa.string()), pa.array(full, pa.int32()), pa.array([k.tobytes() for k, _ in own], pa.binary()), pa.array([c[c > 1].tobytes() for _, c in own], pa.binary())], names=["chunk", "part", "keys", "counts"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A part at a time: it holds a share of all shingles that is set by the number of parts."""
        now, names, keys, counts = None, [], [], []

        def rows() -> Iterator[pa.RecordBatch]:
            sizes = np.array([len(k) // 4 for k in keys])
            unique, place = np.unique(np.frombuffer(b"".join(keys), np.uint32), return_inverse=True)
            total = np.bincount(place, minlength=len(unique))
            start = 0
            for size, c in zip(sizes, counts, strict=True):
                more = np.frombuffer(c, np.uint16)
                np.add.at(total, place[start + size - len(more) : start + size], more.astype(np.int64) - 1)
                start += size
            level = np.where(total < 2, 0, 1 + np.floor(4 * np.log2(np.maximum(total, 1)))).astype(np.uint8)[place]
            ends = np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([now] * len(names), pa.int32()), pa.array([level[e - s : e].tobytes() for s, e in zip(sizes, ends, strict=True)], pa.binary())], names=["chunk", "part", "levels"])

        for batch in batches:
            for name, part, k, c in zip(*(batch.column(x).to_pylist() for x in ("chunk", "part", "keys", "counts")), strict=True):
                if part != now:
                    if names:
                        yield from rows()
                    now, names, keys, counts = part, [], [], []
                names.append(name)
                keys.append(k)
                counts.append(c)
        if names:
            yield from rows()

    asked = chunks.select("chunk").mapInArrow(returning(ask), "chunk string, part int, keys binary, counts binary").repartition(parts, "part").sortWithinPartitions("part")
    return asked.mapInArrow(returning(answer), "chunk string, part int, levels binary")


def candidate_edges(chunks: DataFrame, folder: str, parts: int) -> tuple[DataFrame, str]:
    """(a, b): edges between nodes whose components hold all links between different sets; and the settled table that they are read from."""
    spark = chunks.sparkSession
    names = ["part", "x", "y", "z", "nodes"]

    def edge_rows(part: list[int], blobs: list[list[bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *(pa.array([b[c] for b in blobs], pa.binary()) for c in range(4))], names=names)

    def prefixes(name: str, levels: list[bytes]) -> Iterator[pa.RecordBatch]:
        node_of_set, sizes, whole = read_chunk(folder, name)
        level = np.frombuffer(b"".join(levels), np.uint8)[questions(whole, parts)[4]]
        place = (mixed(whole) >> np.uint64(8)) | level.astype(np.uint64) << np.uint64(56)  # rare ones first, hashes otherwise
        keys, of, start = [], [], 0
        for k, size in enumerate(sizes.tolist()):
            at, p = slice(start, start + size), prefix_length(size)
            start += size
            first = np.argpartition(place[at], p - 1)[:p] if p < size else np.arange(size)
            first = first[level[at][first] > 0]  # what no other set has can't lead to one
            keys.append(whole[at][first])
            of.append(np.full(len(first), k))
        key, of = np.concatenate(keys), np.concatenate(of)
        if not len(key):
            return
        cls, node = size_class(sizes)[of], node_of_set[of]
        order = np.lexsort((node, cls, key))
        key, cls, node = key[order], cls[order], node[order]
        first = np.append(True, (key[1:] != key[:-1]) | (cls[1:] != cls[:-1]))
        lead = node[np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))]
        a, b = forest(node[~first], lead[~first])
        if len(a):
            yield edge_rows([-1], [[*packed(a, b), b"", b""]])
        key, cls, node = key[first], cls[first].astype(np.int16), node[first]
        order, full, cuts = split_by(part_of(key, parts), parts)
        blobs = []
        for i, j in zip(cuts[full], cuts[full + 1], strict=True):
            own = order[i:j]
            nodes, at = np.unique(node[own], return_inverse=True)
            blobs.append(packed(short(key[own]), at.astype(np.uint32), cls[own], nodes))
        yield edge_rows(full.tolist(), blobs)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, levels = None, []
        for batch in batches:
            for name, level in zip(batch.column("chunk").to_pylist(), batch.column("levels").to_pylist(), strict=True):
                if name != now:
                    if now is not None:
                        yield from prefixes(now, levels)
                    now, levels = name, []
                levels.append(level)
        if now is not None:
            yield from prefixes(now, levels)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A part at a time: a row for each chunk, shingle and size class."""
        now, key, cls, node = None, [], [], []

        def edges() -> Iterator[pa.RecordBatch]:
            a, b = forest(*chained(np.concatenate(key), np.concatenate(cls), np.concatenate(node)))
            for k in range(0, len(a), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(a[k : k + 100_000]), pa.array(b[k : k + 100_000])], names=["a", "b"])

        for batch in batches:
            for part, x, y, z, nodes in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if part != now:
                    if key:
                        yield from edges()
                    now, key, cls, node = part, [], [], []
                key.append(np.frombuffer(x, np.uint32))
                node.append(np.frombuffer(nodes, np.int64)[np.frombuffer(y, np.uint32)])
                cls.append(np.frombuffer(z, np.int16))
        if key:
            yield from edges()

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(a, np.int64)), pa.array(np.frombuffer(b, np.int64))], names=["a", "b"])

    told = answered(chunks, folder, parts).repartition(parts, "chunk").sortWithinPartitions("chunk", "part").select("chunk", "levels")
    made, made_path = settle(spark, told.mapInArrow(returning(emit), "part int, x binary, y binary, z binary, nodes binary"), "prefixes")
    far = made.filter("part >= 0").repartition(parts, "part").sortWithinPartitions("part").mapInArrow(returning(join), "a long, b long")
    near = made.filter("part = -1").select("x", "y").mapInArrow(returning(unpack), "a long, b long")
    return far.union(near), made_path


# ---- signature trees ----


class Tree:
    """A signature tree: level 0 has a node for each LEAF sets, each level above half as many."""

    def __init__(self, sets: list[np.ndarray], bits: int):
        self.sizes = np.array([len(s) for s in sets])
        self.maps = np.zeros((len(sets), (1 << bits) // 64), np.uint64)
        for k, s in enumerate(sets):
            own = np.zeros(1 << bits, np.uint8)
            own[(mixed(s) >> np.uint64(64 - bits)).astype(np.int64)] = 1
            self.maps[k] = np.packbits(own, bitorder="little").view(np.uint64)
        excess = self.sizes - np.bitwise_count(self.maps).sum(axis=1, dtype=np.int64)
        at = np.arange(0, len(sets), LEAF)
        self.levels = [(np.bitwise_or.reduceat(self.maps, at), np.minimum.reduceat(self.sizes, at), np.maximum.reduceat(self.sizes, at), np.maximum.reduceat(excess, at))]
        while len(self.levels[-1][1]) > 1:
            maps, low, high, more = self.levels[-1]
            at = np.arange(0, len(low), 2)
            self.levels.append((np.bitwise_or.reduceat(maps, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(more, at)))

    def span(self, level: int, k: int) -> slice:
        return slice(k * LEAF << level, min(len(self.sizes), (k + 1) * LEAF << level))


def may_link(x: Tree, i: int, y: Tree, j: int, level: tuple[int, int]) -> bool:
    """Can any set under one node overlap enough with any under the other?"""
    xm, xl, xh, xe = (c[i] for c in x.levels[level[0]])
    ym, yl, yh, ye = (c[j] for c in y.levels[level[1]])
    if DOWN * xh < UP * yl or DOWN * yh < UP * xl:
        return False
    # a set's shingles lie in its bits; those in bits that the other node has too are at most so many, and the excess of shingles over bits
    most = int(np.bitwise_count(xm & ym).sum()) + min(int(xe), int(ye))
    return (UP + DOWN) * min(most, int(xh), int(yh)) >= UP * (int(xl) + int(yl))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = np.concatenate([a, b])
    both.sort()
    inter = int((both[1:] == both[:-1]).sum())
    return 100 * inter >= 80 * (len(a) + len(b) - inter)


class Components:
    """Sets joined one by one, by halved paths; a component is known by its smallest member."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def of(self, k: int) -> int:
        up = self.up
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return int(k)

    def join(self, i: int, j: int) -> None:
        a, b = self.of(i), self.of(j)
        self.up[max(a, b)] = min(a, b)

    def all(self, some: np.ndarray | None = None) -> np.ndarray:
        at = self.up if some is None else self.up[some]
        while (self.up[at] != at).any():
            at = self.up[at]
        return at


def traverse(sets: list[np.ndarray], cut: int | None = None, known: list | None = None) -> np.ndarray:
    """A component number for each set. cut: only pairs of one set before it and one from it on are compared. known: sets with equal values
    are in one component already."""
    n = len(sets)
    comp = Components(n)
    first: dict = {}
    for k, value in enumerate(known or []):
        comp.join(k, first.setdefault(value, k))
    if n == 2:
        if comp.of(1) and linked(sets[0], sets[1]):
            comp.join(0, 1)
        return comp.all()
    bits = int(np.clip(np.ceil(np.log2(4 * np.median([len(s) for s in sets]) + 1)), 8, 13))
    minima = np.array([(int(s[0]), int(mixed(s).min())) for s in sets], np.uint64)
    groups = [np.arange(n)] if cut is None else [np.arange(cut), np.arange(cut, n)]
    groups = [g[np.lexsort((minima[g, 1], minima[g, 0]))] for g in groups]
    trees = [Tree([sets[k] for k in g], bits) for g in groups]
    x, y = trees[0], trees[-1]
    gx, gy = groups[0], groups[-1]
    same = x is y

    def pairs(i: int, j: int) -> None:
        si, sj = x.span(0, i), y.span(0, j)
        a, b = gx[si], gy[sj]
        na, nb = x.sizes[si][:, None], y.sizes[sj][None, :]
        ma, mb = x.maps[si], y.maps[sj]
        both = np.bitwise_count(ma[:, None, :] & mb[None, :, :]).sum(axis=2, dtype=np.int64)
        most = np.minimum(na - (np.bitwise_count(ma).sum(axis=1, dtype=np.int64)[:, None] - both), nb - (np.bitwise_count(mb).sum(axis=1, dtype=np.int64)[None, :] - both))
        ok = (DOWN * np.minimum(na, nb) >= UP * np.maximum(na, nb)) & ((UP + DOWN) * most >= UP * (na + nb)) & (comp.all(a)[:, None] != comp.all(b)[None, :])
        if same and i == j:
            ok &= np.arange(len(a))[:, None] < np.arange(len(b))[None, :]
        for p, q in zip(*np.nonzero(ok), strict=True):
            if comp.of(a[p]) != comp.of(b[q]) and linked(sets[a[p]], sets[b[q]]):
                comp.join(a[p], b[q])

    todo = [(len(x.levels) - 1, 0, len(y.levels) - 1, 0)]
    while todo:
        lx, i, ly, j = todo.pop()
        own = same and lx == ly and i == j
        if not own:
            ca, cb = comp.all(gx[x.span(lx, i)]), comp.all(gy[y.span(ly, j)])
            if ca[0] == cb[0] and (ca == ca[0]).all() and (cb == cb[0]).all() or not may_link(x, i, y, j, (lx, ly)):
                continue
        if lx == 0 and ly == 0:
            pairs(i, j)
            continue
        below_x = [(lx - 1, k) for k in (2 * i, 2 * i + 1) if lx and k < len(x.levels[lx - 1][1])] if lx >= ly or own else [(lx, i)]
        below_y = [(ly - 1, k) for k in (2 * j, 2 * j + 1) if ly and k < len(y.levels[ly - 1][1])] if ly >= lx or own else [(ly, j)]
        new = [(*p, *q) for p in below_x for q in below_y if not own or p[1] <= q[1]]
        new.sort(key=lambda t: t[1] == t[3] and t[0] == t[2])  # popped from the end: a node's own halves first, so that what is near links early
        todo += new
    return comp.all()


# ---- blocks ----


def with_digests(plain: DataFrame, once: bool = False) -> DataFrame:
    """plain with the digest of each text's set, empty where it has no words; once: repeats of a set within a task are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            sets = [shingles(t) for t in batch.column("text").to_pylist()]
            digests = [digest_of(s) if len(s) else b"" for s in sets]
            out = pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.binary())], names=[*batch.schema.names, "digest"])
            if once:
                new = [k for k, d in enumerate(digests) if d not in seen and not seen.add(d)]
                out = out.take(pa.array(new, pa.int64()))
                seen = seen if len(seen) < 200_000 else set()
            yield out
        _MEMO.clear()

    return plain.mapInArrow(returning(run), T.StructType([*plain.schema.fields, T.StructField("digest", T.BinaryType())]))


def blocked(plain: DataFrame, least: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame, list[str]] | None:
    """roots: (node, root) of each node in a block but the roots themselves. Settled: (digest, block, carrier, n) of each set in a block; (block, carrier, n, hashes) of the same sets. None where two sets have one node."""
    spark = plain.sparkSession
    blocks = roots.union(roots.select(F.col("root"), F.col("root")).distinct()).toDF("node", "block")
    sets, sets_path = settle(spark, blocks.join(least, "node").select("block", "digest", F.col("node").alias("carrier"), F.col("n_shingles").alias("n"), F.col("least").alias("place")), "sets")
    if sets.groupBy("carrier").count().filter("count > 1").limit(1).count():
        return None
    sent = F.broadcast if sets.count() <= SENT else lambda df: df
    columns = ["block", "carrier", "digest", "text"]
    texts = plain.join(sent(sets.filter("place is not null")), F.col("doc_id") == F.col("place")).select(*columns)
    unnamed = sets.filter("place is null")
    if unnamed.limit(1).count():  # sets of rows without an id
        texts = texts.union(with_digests(plain.filter("doc_id is null"), once=True).select("digest", "text").join(sent(unnamed), "digest").select(*columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t) for t in batch.column("text").to_pylist()]
            own = [k for k, (s, d) in enumerate(zip(found, batch.column("digest").to_pylist(), strict=True)) if digest_of(s) == d]  # else another row of the same id
            rows = batch.select(["block", "carrier"]).take(pa.array(own, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([len(found[k]) for k in own], pa.int64()), pa.array([found[k].tobytes() for k in own], pa.binary())], names=["block", "carrier", "n", "hashes"])
        _MEMO.clear()

    held, held_path = settle(spark, texts.mapInArrow(returning(run), "block long, carrier long, n long, hashes binary"), "hashes")
    return sets, held, [sets_path, held_path]


def searched(tasks: DataFrame, parts: int) -> tuple[DataFrame, str]:
    """Settled (turn, a, b): the links of a spanning forest of each task. tasks: turn, u, v (the two chunks), side (0 or 1), carrier, known,
    hashes; a task of one chunk compares all its sets, another only sets of different chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes, sets, sides, known = None, [], [], [], []

        def links() -> Iterator[pa.RecordBatch]:
            turn, u, v = now
            whole = u == v
            if len(sets) < 2 or not whole and sides[0] == sides[-1]:
                return
            comp = traverse(sets, None if whole else sides.index(1), known)
            ids, own = np.array(nodes), np.flatnonzero(comp != np.arange(len(comp)))
            if len(own):
                yield pa.RecordBatch.from_arrays([pa.array([turn] * len(own), pa.int32()), pa.array(ids[own], pa.int64()), pa.array(ids[comp[own]], pa.int64())], names=["turn", "a", "b"])

        for batch in batches:
            for turn, u, v, side, carrier, root, hashes in zip(*(batch.column(c).to_pylist() for c in ("turn", "u", "v", "side", "carrier", "known", "hashes")), strict=True):
                if (turn, u, v) != now:
                    if now:
                        yield from links()
                    now, nodes, sets, sides, known = (turn, u, v), [], [], [], []
                if nodes and nodes[-1] == carrier and sides[-1] == side:  # a repeated row
                    continue
                nodes.append(carrier)
                sets.append(np.frombuffer(hashes, np.uint64))
                sides.append(side)
                known.append(root)
        if now:
            yield from links()

    dealt = tasks.select("turn", "u", "v", "side", "carrier", "known", "hashes").repartition(parts, "turn", "u", "v").sortWithinPartitions("turn", "u", "v", "side", "carrier")
    return settle(tasks.sparkSession, dealt.mapInArrow(returning(run), "turn int, a long, b long"), "links")


def cuts_of(sets: DataFrame, *by: str) -> DataFrame:
    """(by..., chunks): how many chunks a group's sets fill."""
    return sets.groupBy(*by).agg(F.greatest(F.ceil(F.count(F.lit(1)) / SETS), F.ceil(F.sum("n") / BLOCK), F.lit(1)).cast("int").alias("chunks"))


def block_links(sets: DataFrame, held: DataFrame, parts: int) -> tuple[DataFrame, list[str]]:
    """(node, root) of the links between the sets of each block, and the settled tables it reads."""
    spark = held.sparkSession
    chunks, path = settle(spark, cuts_of(sets, "block"), "chunks")
    paths = [path]
    at = lambda salt, n: F.pmod(F.xxhash64("carrier", salt), n).cast("string")
    # a block of one chunk has one turn, a larger one two, by different salts
    turns = F.explode(F.when(F.col("chunks") > 1, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    tasks = held.join(chunks, "block").withColumn("turn", turns).withColumn("u", F.concat_ws(":", "block", at(F.col("turn"), F.col("chunks"))))
    links, path = searched(tasks.withColumns({"v": F.col("u"), "side": F.lit(0), "known": F.col("carrier")}), parts)
    paths.append(path)
    first, second = (links.filter(F.col("turn") == k).select("a", "b") for k in (1, 2))
    if not chunks.filter("chunks > 1").limit(1).count():
        return first.toDF("node", "root"), paths
    # what isn't known to be in its block's largest component is compared with everything else there of near size
    members = labelled(sets.join(chunks.filter("chunks > 1"), "block").select("block", "carrier", "n"), first, second)
    members, path = settle(spark, members, "labelled")
    paths.append(path)
    main = members.groupBy("block", "known").count().groupBy("block").agg(F.max_by("known", F.struct("count", "known")).alias("main"))
    members = members.join(main, "block").select("block", "carrier", "n", "known", (F.col("known") != F.col("main")).cast("int").alias("apart"), size_class_of(F.col("n")).alias("cls"))
    units = cuts_of(members, "block", "apart", "cls")
    named = F.concat_ws(":", "block", "apart", "cls", at(F.lit(3), F.col("chunks"))).alias("unit")
    members, path = settle(spark, members.join(units, ["block", "apart", "cls"]).select("block", "carrier", "known", "apart", "cls", named), "members")
    paths.append(path)
    units = members.select("block", "apart", "cls", "unit").distinct()
    a, b = units.filter("apart = 1").select("block", F.col("cls").alias("cls_u"), F.col("unit").alias("u")), units.select("block", "apart", F.col("cls").alias("cls_v"), F.col("unit").alias("v"))
    meet = a.join(b, "block").filter("abs(cls_u - cls_v) <= 2 and (apart = 0 or u <= v)").select("u", "v")
    sides = meet.select("u", "v", F.lit(0).alias("side"), F.col("u").alias("unit")).union(meet.filter("u <> v").select("u", "v", F.lit(1), F.col("v")))
    tasks = sides.join(members, "unit").select(F.lit(3).alias("turn"), "u", "v", "side", "carrier", "known").join(held.select("carrier", "hashes"), "carrier")
    third, path = searched(tasks, parts)
    paths.append(path)
    return components(links.select("a", "b").union(third.select("a", "b"))), paths


def labelled(members: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """members with `known`: sets with one label are in one component; sets of one component may still have different labels.

    A set's label is the least that reaches it by its root in the first search, that root's in the second, and the first's again.
    """
    x, y = (links.select(F.col("a").alias("carrier"), F.col("b").alias(name)) for links, name in ((first, "x"), (second, "y")))
    rooted = members.join(x, "carrier", "left").join(y, "carrier", "left").select("block", "carrier", "n", F.coalesce("x", "carrier").alias("x"), F.coalesce("y", "carrier").alias("y"))
    least_of_y = rooted.groupBy("y").agg(F.min("x").alias("low"))
    lower = rooted.join(least_of_y, "y")
    least_of_x = lower.groupBy("x").agg(F.min("low").alias("known"))
    return lower.join(least_of_x, "x").select("block", "carrier", "n", "known")


def size_class_of(n: Column) -> Column:
    return F.floor(F.ln(F.greatest(n, F.lit(1))) / STEP + 1e-9).cast("int")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id (a long), n_shingles, digest of the set, component_id, group (a number of the component, never null where there are words): one row per row of docs."""
    spark = docs.sparkSession
    prepare(spark)
    plain = narrow(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    for byte in (0, 8):
        folder = scratch_path(spark, "chunks")
        fs, at = opened(folder)
        fs.create_dir(at, recursive=True)
        made, made_path = spelled(plain, folder, byte)
        info, chunks = made.filter("chunk is null").select("doc_id", "n_shingles", "digest", "node"), made.filter("chunk is not null").select("chunk", "n_shingles")
        total = chunks.agg(F.sum("n_shingles")).first()[0] or 0
        edges, edges_path = candidate_edges(chunks, folder, max(parts, -(-total // ASKED)))
        blocks = components(edges)
        remove(spark, folder, edges_path)
        least, least_path = settle(spark, info.filter("n_shingles > 0").groupBy("digest", "n_shingles", "node").agg(F.min("doc_id").alias("least")), "least")
        if (found := blocked(plain, least, blocks)) is not None:
            break
        remove(spark, made_path, least_path)
    else:
        raise ValueError("digests of different sets share eight bytes in both halves")
    sets, held, paths = found
    roots, more = block_links(sets, held, parts)
    # a component of sets is known by its smallest carrier; sets without a link are components of their own
    root_of = sets.join(roots.withColumnRenamed("node", "carrier"), "carrier", "left").select("digest", F.coalesce("root", "carrier").alias("root"))
    least = least.join(root_of, "digest", "left")
    alone = least.filter("root is null").select("digest", F.col("least").alias("component_id"), F.col("node").alias("group"))
    joined = least.filter("root is not null")
    joined = joined.join(joined.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("digest", "component_id", F.col("root").alias("group"))
    table, _ = settle(spark, alone.union(joined), "components")
    remove(spark, *paths, *more, least_path)
    found = lookup(info, table, "digest")
    return found.select("doc_id", "n_shingles", "digest", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "group")


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return jaccard_join(docs).select("doc_id", "n_shingles", "component_id")


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + least(len(w), 5) - 1], ' ') AS sh FROM w, LATERAL (SELECT unnest(generate_series(1, greatest(len(w) - 4, 1))) AS k) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM i JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
u AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, u.y FROM r JOIN u ON r.reached = u.x)
SELECT w.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.reached) AS component_id FROM w LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY w.doc_id
"""
