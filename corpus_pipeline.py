"""The corpus pipeline: language ID, line dedup, n-gram Jaccard join, benchmark decontamination, BPE encoding and decoding.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; each result is written as Parquet and read again as the
next one's docs. Every stage but the last returns the columns of documents. Texts that are null or have no letter go in the first stage. Rows
without an id take part as rows; repeated rows of one id and text count as copies. Empty tables pass through; other columns, whatever their
names, are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, jaccard_join, language_id, line_dedup
from tidemark.llm.common import narrow, remove, settle, table, unpacked
from tidemark.llm.queries import tokenizer

#: Ids to broadcast, 8 bytes each; more are joined by a shuffle.
LOSERS = 2_000_000


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language can be told (no text, no letter) go. Where no label could be learned, only those without a letter go."""
    model = language_id.fit(docs)
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    found = language_id.identify(docs, model, carry=True)
    return unpacked(found.filter("lang_pred <> 'und'"), docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents or more hold stay in one of them; n_chars follows the text. Documents left without lines stay, empty."""
    kept = unpacked(line_dedup.line_dedup(docs, outputs=("kept",), carry=True), docs, text="kept")
    return kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked texts stays, the one with the smallest id; of equal ids, or where no row has one, the one with the
    smallest digest. Documents without words stay."""
    found, _ = settle(spark, jaccard_join.jaccard_join(docs), "groups")
    worded = found.filter("n_shingles > 0")
    unclear = worded.filter("doc_id is null").limit(1).count() or found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").limit(1).count()
    if not unclear:
        losers = found.filter("doc_id <> component_id").select(F.col("doc_id").alias("loser"))
        few = losers.count() <= LOSERS
        return docs.join(F.broadcast(losers) if few else losers, docs["doc_id"] == F.col("loser"), "left_anti")
    # an id doesn't tell which text is meant: rows are known by id and digest
    best = worded.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest")).alias("best"))
    best = best.select(F.col("best.doc_id").alias("best_id"), F.col("best.digest").alias("best_digest"))
    rows = jaccard_join.with_digests(narrow(docs, carry=True))
    same = (F.col("digest") == F.col("best_digest")) & F.col("doc_id").cast("long").eqNullSafe(F.col("best_id"))
    kept = rows.filter("length(digest) > 0").join(best, same, "left_semi").dropDuplicates(["doc_id", "digest"])
    return unpacked(kept.union(rows.filter("length(digest) = 0")), docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words a twentieth or more lies in benchmark passages go."""
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), carry=True)
    return unpacked(found.filter("not (n_hit > 0 and 20 * n_hit >= n_words)"), docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and a digest of what the ids decode to."""
    return bpe.bpe(docs, tokenizer("byte_bpe_50k.json"), ("n_tokens", "ids", "decoded_sha256"), memo=250_000, keep_memo=False)


STAGES = [("language ID", languages), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontaminated), ("BPE encoding and decoding", tokens)]

#: SQL can't express learned languages or merges; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is settled in the shared folder, until the next one is."""
    docs, path = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        made, new = settle(spark, stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if path is not None:
            remove(spark, path)
        docs, path = made, new
    return STAGES[-1][1](spark, docs, sf_dir)
