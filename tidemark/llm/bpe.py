"""Byte-level BPE: exact linear-time encoding by backtracking, decoding by an offset table.

Encoding. Text is cut at the added tokens, then at the tokenizer's pre-token pattern. A piece is encoded left to right: an
Aho-Corasick pass finds the longest token at every byte; a token may follow the last one only if the pair-compatibility table says
that merging the two texts from their bytes would leave exactly these two tokens. A dead end marks its position and backs up one
token, so each position is left at most once and the time is linear. Two adjacent tokens being compatible everywhere is what makes
the result equal to merging in rank order. Pieces repeat, so each worker keeps a bounded memo of what a piece gave.

Decoding. One byte string holds every token's bytes; a table has each id's offset and length; a text is one gather.

Nulls and empty texts give no tokens. Any length of text is processed whole; repeated rows give repeated results, whatever their ids. An
empty table gives none; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import narrow, prepare, returning

#: The byte-level pre-token pattern (public), and white space beyond ASCII.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WIDE_SPACE = r"\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Entries of a worker's memos before they start anew, and the longest piece that they keep.
MEMO, MEMO_CHARS = 300_000, 64

FIELDS = {"n_tokens": "long", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}
ARROW = {"long": pa.int64(), "array<int>": pa.list_(pa.int32()), "string": pa.string()}


def byte_letters() -> dict[str, int]:
    """The public byte-level alphabet: printable bytes stand for themselves, others follow from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class Vocabulary:
    """A byte-level BPE vocabulary read from tokenizer JSON; inside, a token's number is its merge rank plus 256."""

    def __init__(self, data: bytes):
        import ahocorasick

        spec = json.loads(data)
        pre = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or pre["type"] != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("not a plain byte-level BPE tokenizer")
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        name = {b: c for c, b in letters.items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        number = {name[b]: b for b in range(256)}
        self.halves: list[tuple[int, int]] = [(b, b) for b in range(256)]
        self.joined: dict[tuple[int, int], int] = {}
        texts = [bytes([b]) for b in range(256)]
        self.outer = [vocab.get(name[b], -1) for b in range(256)]
        for left, right in merges:
            made = len(texts)
            if left + right in number:
                raise ValueError("two merges make one token")
            pair = number[left], number[right]
            number[left + right] = made
            self.joined[pair] = made
            self.halves.append(pair)
            texts.append(texts[pair[0]] + texts[pair[1]])
            self.outer.append(vocab[left + right])
        self.sizes = [len(t) for t in texts]
        by_text = {t: k for k, t in enumerate(texts)}
        self.shorter = [next((by_text[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in by_text), -1) for t in texts]
        self.automaton = ahocorasick.Automaton()
        for k, t in enumerate(texts):
            self.automaton.add_word(t.decode("latin-1"), (len(t) - 1, k))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        whole = {i: "".join(t) for t, i in vocab.items()}
        size = max([*whole, *self.added.values()]) + 1
        blobs = [bytes(letters[c] for c in whole[i]) if i in whole else b"" for i in range(size)]
        for text, i in self.added.items():
            blobs[i] = bytes(letters[c] for c in text) if all(c in letters for c in text) else text.encode()
        self.length = np.array([len(b) for b in blobs], np.int64)
        self.offset = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.blob = np.frombuffer(b"".join(blobs), np.uint8)

    def compatible(self, left: int, right: int) -> bool:
        """Would merging these two tokens' bytes in rank order end in exactly these two tokens?

        Undo the younger of the two tokens at the seam, step by step. If at some step the two tokens at the seam have a merge that comes
        before the one last undone, then merging would have crossed the seam there.
        """
        if (known := self.pairs.get((left, right))) is not None:
            return known
        a, b, before, ok = left, right, len(self.halves), True
        while True:
            made = self.joined.get((a, b))
            if made is not None and made < before:
                ok = False
                break
            if a < 256 and b < 256:
                break
            if a > b:  # equal tokens: the left one was made first
                before, a = a, self.halves[a][1]
            else:
                before, b = b + 1, self.halves[b][0]
        if len(self.pairs) >= MEMO:
            self.pairs.clear()
        self.pairs[left, right] = ok
        return ok

    def longest(self, data: bytes) -> list[int]:
        """The longest token that starts at each byte."""
        best = [-1] * len(data)
        for end, (back, token) in self.automaton.iter(data.decode("latin-1")):
            best[end - back] = token  # matches come in order of their ends, so a start's last is its longest
        return best

    def piece(self, data: bytes) -> list[int]:
        """Internal numbers of one pre-token."""
        n = len(data)
        if not n:
            return []
        best = self.longest(data)
        if self.sizes[best[0]] == n and (n == 1 or self._reached(best[0])):
            return [best[0]]
        dead, out, at = bytearray(n + 1), [], 0
        token = best[0]
        while True:
            last = out[-1] if out else -1
            while token >= 0:
                end = at + self.sizes[token]
                if not dead[end] and (last < 0 or self.compatible(last, token)):
                    break
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                if at == n:
                    return out
                token = best[at]
            else:
                dead[at] = 1
                token = out.pop()
                at -= self.sizes[token]

    @lru_cache(maxsize=100_000)  # noqa: B019  a worker has one vocabulary
    def _reached(self, token: int) -> bool:
        """Merging the token's own bytes ends in the token: so for both halves, and no earlier merge crosses their seam."""
        a, b = self.halves[token]
        if token < 256:
            return True
        return self._reached(a) and self._reached(b) and self._seam(a, b, token)

    def _seam(self, a: int, b: int, made: int) -> bool:
        """No merge across the seam of a and b comes before made."""
        before = len(self.halves)
        while True:
            found = self.joined.get((a, b))
            if found is not None and found < before and found != made:
                return False
            if a < 256 and b < 256:
                return True
            if a > b:
                before, a = a, self.halves[a][1]
            else:
                before, b = b + 1, self.halves[b][0]

    def decode(self, ids: np.ndarray) -> bytes:
        out = []
        for k in range(0, len(ids), 65536):
            part = ids[k : k + 65536]
            n, o = self.length[part], self.offset[part]
            ends = np.cumsum(n)
            at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(o - (ends - n), n)
            out.append(self.blob[at].tobytes())
        return b"".join(out)


class Memo(dict):
    """Two generations: when the young one is full it becomes the old one, and what is asked for again moves back."""

    def __init__(self):
        super().__init__()
        self.old: dict = {}
        self.limit = MEMO

    def forget(self) -> None:
        """At a task's end, the old generation: worker processes live on through other operators' tasks."""
        self.old = {}

    def __missing__(self, key: str) -> tuple[str, bytes]:
        made = self.old.get(key) or self.make(key)
        if len(key) <= MEMO_CHARS:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = made
        return made


class Pieces(Memo):
    """A pre-token to its ids as text and as packed int32."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary
        self.names = [str(i) for i in vocabulary.outer]
        self.packs = [struct.pack("=i", i) for i in vocabulary.outer]

    def make(self, piece: str) -> tuple[str, bytes]:
        tokens = self.vocabulary.piece(piece.encode())
        return ",".join([self.names[t] for t in tokens]), b"".join([self.packs[t] for t in tokens])


class Units(Memo):
    """White space with what follows it, to its ids likewise.

    A unit is cut at ASCII white space only, before it. No pre-token crosses such a cut and none looks past it, unless white space beyond
    ASCII stands at the cut; texts with that are one unit.
    """

    def __init__(self, vocabulary: Vocabulary):
        import regex

        super().__init__()
        self.pieces, self.split = Pieces(vocabulary), regex.compile(PATTERN)

    def make(self, unit: str) -> tuple[str, bytes]:
        if unit.isascii() and (unit[1:] if unit[0] == " " else unit).isalpha():
            return self.pieces[unit]  # a word is one pre-token
        found = self.split.findall(unit)
        if len(found) == 1:
            return self.pieces[unit]
        got = [self.pieces[p] for p in found]
        return ",".join([x[0] for x in got]), b"".join([x[1] for x in got])


UNIT, WIDE = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+"), re.compile(f"[{WIDE_SPACE}]")
_LOADED: dict[str, tuple[Vocabulary, Units]] = {}


def load(data: bytes) -> tuple[Vocabulary, Units]:
    key = hashlib.sha256(data).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        v = Vocabulary(data)
        _LOADED[key] = v, Units(v)
    return _LOADED[key]


def encode(text: str, v: Vocabulary, units: Units) -> tuple[str, np.ndarray]:
    """Ids joined by commas, and as an array."""
    names, packed = [], []
    for k, part in enumerate(v.cut.split(text) if v.cut else [text]):
        if k % 2:
            names.append(str(v.added[part]))
            packed.append(np.int32(v.added[part]).tobytes())
        elif part:
            found = [part] if not part.isascii() and WIDE.search(part) else UNIT.findall(part)
            got = [*zip(*map(units.__getitem__, found), strict=True)]
            names += got[0]
            packed += got[1]
    return ",".join(names), np.frombuffer(b"".join(packed), np.int32)


def bpe(docs: DataFrame, tokenizer: str, outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded"), id_col: str = "doc_id", text_col: str = "text", memo: int = MEMO, keep_memo: bool = True) -> DataFrame:
    """One row per row of docs: doc_id and the named outputs (FIELDS).

    memo: entries of each generation of a worker's memos. keep_memo: else the old generation goes at a task's end, for an application in which
    workers go on to other operators.

    tokenizer: path of a byte-level BPE tokenizer JSON that the driver can read; its bytes (a file of a few MB at most, checked) go to the
    workers. A plain map over the scan: no shuffle, and a lost executor's tasks are simply run again.
    """
    spark = docs.sparkSession
    prepare(spark)
    with open(tokenizer, "rb") as f:
        data = f.read()
    if len(data) > 64 << 20:
        raise ValueError("the tokenizer file is larger than 64 MB")
    sent = spark.sparkContext.broadcast(data)
    plain = narrow(docs, id_col, text_col)
    kind = plain.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, units = load(sent.value)
        units.limit = units.pieces.limit = memo
        for batch in batches:
            made: dict[str, list] = {k: [] for k in outputs}
            for text in batch.column("text").to_pylist():
                names, ids = encode(text or "", vocabulary, units)
                back = vocabulary.decode(ids) if "decoded" in made or "decoded_sha256" in made else b""
                for k, rows in made.items():
                    if k == "n_tokens":
                        rows.append(len(ids))
                    elif k == "ids":
                        rows.append(ids)
                    elif k == "ids_sha256":
                        rows.append(hashlib.sha256(names.encode()).hexdigest())
                    else:
                        text_back = back.decode("utf-8", "replace")
                        rows.append(text_back if k == "decoded" else hashlib.sha256(text_back.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(made[k], ARROW[FIELDS[k]]) for k in outputs)], names=["doc_id", *outputs])
        if not keep_memo:
            units.forget()
            units.pieces.forget()
            vocabulary.pairs.clear()

    return plain.mapInArrow(returning(run), f"doc_id {kind}, " + ", ".join(f"{k} {FIELDS[k]}" for k in outputs))


def query(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    """The contract's digest columns."""
    return bpe(docs, tokenizer, ("n_tokens", "ids_sha256", "decoded_sha256"))
