"""Token counts through a digest cache.

A text's key is the SHA-256 of its normalised content; a tokenizer's version is the SHA-256 of its file. The cache is a Parquet table
(version, digest, n_tokens). Texts whose key the cache lacks are reduced to one copy a digest (combined before the shuffle, so a text
that a third of all rows share moves once a task), encoded, and appended; then every row looks its count up by digest, the digests of very
many rows by broadcast. An append is one Spark write of new files. Where a store can't rename at once, a reader may see part of them: it then
encodes again what it misses. Should two runs append the same digest, both hold the same count and the reader keeps one.

Normalising may only drop what can't change a count: runs of ASCII white space become one space if the tokenizer's own normaliser does
so; otherwise the content is taken as it is. Null counts as the empty text: 0 bytes, 0 tokens. Repeated ids give repeated rows. An empty
table gives none. A very long text is encoded whole, by one task. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import lookup, narrow, prepare, returning, scratch_path, settle

#: Entries of a worker's memo of chunk counts before it starts anew, and the longest chunk that it keeps.
MEMO, MEMO_BYTES = 500_000, 96
#: A pre-tokenizer whose pieces never hold white space.
SPACELESS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def drops_space(data: bytes, name: str) -> bool:
    """Does the tokenizer turn white-space runs into one space and leave spaces out of its pieces?"""
    if not name.endswith(".json"):
        return False
    spec = json.loads(data)
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    added = "".join(x["content"] for x in spec["added_tokens"])
    plain = not any(x[k] for x in spec["added_tokens"] for k in ("lstrip", "rstrip", "single_word", "normalized"))
    return plain and not any(c.isspace() for c in added) and any(s.get("type") == "Replace" and s.get("pattern") == {"Regex": "\\s+"} and s.get("content") == " " for s in steps) and bool(splits) and splits[0].get("pattern") == {"Regex": SPACELESS} and splits[0].get("behavior") == "Removed"


class Counter:
    """Counts tokens as the tokenizer's own library gives them."""

    def __init__(self, data: bytes, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.by_chunk, self.memo = drops_space(data, name), {}
        if name.endswith(".model"):
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_proto=data)
            self.many = lambda texts: [len(x) for x in self.model.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            self.model = Tokenizer.from_buffer(data)
            self.model.no_truncation()
            self.model.no_padding()
            self.many = lambda texts: [len(x.ids) for x in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def counts(self, texts: list[str]) -> list[int]:
        """Where no piece can hold white space, a text's count is the sum of its chunks' counts, and chunks repeat."""
        if not self.by_chunk:
            return self.many(texts)
        split = [t.encode().split() for t in texts]
        memo = self.memo
        new = list({c for chunks in split for c in chunks if c not in memo})
        if len(memo) + len(new) > MEMO:
            memo.clear()
            new = list({c for chunks in split for c in chunks})
        own = dict(zip(new, self.many([c.decode() for c in new]), strict=True)) if new else {}
        memo.update((c, n) for c, n in own.items() if len(c) <= MEMO_BYTES)
        look = lambda c: memo[c] if c in memo else own[c]
        return [sum(map(memo.__getitem__, chunks)) if all(len(c) <= MEMO_BYTES for c in chunks) else sum(map(look, chunks)) for chunks in split]


_LOADED: dict[str, Counter] = {}


def load(data: bytes, name: str) -> Counter:
    key = hashlib.sha256(data).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Counter(data, name)
    return _LOADED[key]


def digest(text: Column, collapse: bool) -> Column:
    return F.unhex(F.sha2(F.regexp_replace(text, "[ \\t-\\r]+", " ") if collapse else text, 256))


def token_counts(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit), one row per row of docs.

    cache: folder of the cache table, kept between calls and shared by all executors; None takes a fresh one in the shared folder.
    """
    spark = docs.sparkSession
    prepare(spark)
    with open(tokenizer, "rb") as f:
        data = f.read()
    if len(data) > 64 << 20:
        raise ValueError("the tokenizer file is larger than 64 MB")
    name, version, collapse = os.path.basename(tokenizer), hashlib.sha256(data).hexdigest(), drops_space(data, tokenizer)
    sent, cache = spark.sparkContext.broadcast(data), cache or scratch_path(spark, "token-cache")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    old = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    schema = "version string, digest binary, n_tokens long"

    def stored() -> DataFrame:
        return spark.read.schema(schema).parquet(cache).filter(F.col("version") == version)

    plain = narrow(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    misses = plain.select(digest(F.col("text"), collapse).alias("digest"), "text")
    if old:
        misses = misses.join(stored().select("digest"), "digest", "left_anti")
    misses = misses.dropDuplicates(["digest"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = load(sent.value, name)
        for batch in batches:
            n = counter.counts(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([version] * len(n), pa.string()), batch.column("digest"), pa.array(n, pa.int64())], names=["version", "digest", "n_tokens"])

    misses.mapInArrow(returning(run), schema).write.mode("append").parquet(cache)
    known = stored().groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    # settled before the cache is read: a row a document, with the digest alone
    keyed, _ = settle(spark, plain.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), digest(F.col("text"), collapse).alias("digest")), "digests")
    return lookup(keyed, known, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
