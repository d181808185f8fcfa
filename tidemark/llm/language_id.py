"""Language identification by hierarchical discrimination.

Features are hashed byte trigrams of the whole text (A-Z folded, other ASCII that isn't a letter read as space), as shares of all trigrams.
First one linear support vector machine for each language family picks the family; then linear machines for each pair of its languages vote,
ties broken by the sum of margins. The score is the product of the two decisions' logistic confidences.

Fitting takes a bounded, documented sample: at most SAMPLE rows of each label, chosen by a hash of id and text over the whole table, never
more than ROWS in all; of more than ROWS labels the most frequent are learned. Equal rows count once. Features are counted on the executors.
Every row is predicted, from its whole text, each repeated row alike, whatever its id. Labels outside FAMILIES are a family each. Null text
and text without a letter are `und` with score 0; so is everything where no label could be learned. An empty table gives none; other columns
don't meddle.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import narrow, prepare, returning, rows_of

#: Language families of common ISO 639-1 codes.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "is", "af"], "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl"], "slavic": ["ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"],
    "uralic": ["fi", "et", "hu"], "turkic": ["tr", "az", "kk"], "indic": ["hi", "bn", "ur", "mr", "ne"], "semitic": ["ar", "he"],
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}
#: Bits of the feature hash; the sample's bounds; passes and cost of fitting; slope from margin to confidence.
BITS, SAMPLE, ROWS, PASSES, COST, SLOPE = 13, 300, 2400, 12, 10.0, 3.0
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def features(text: str) -> np.ndarray:
    """Counts of hashed trigrams."""
    b = np.frombuffer(b" " + text.encode().translate(LETTERS) + b" ", np.uint8).astype(np.uint32)
    code = b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)
    code = (code * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    code = code[(b[:-2] != 32) | (b[1:-1] != 32) | (b[2:] != 32)]
    return np.bincount(code, minlength=1 << BITS).astype(np.float32)


def shares(counts: np.ndarray) -> np.ndarray:
    x = np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))
    return x.astype(np.float32)  # square roots of shares have length 1


def fit_machine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A linear SVM by dual coordinate ascent; y is 1 or -1. The last weight is the bias. Rows of the rarer side weigh more."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    limit = COST * len(y) / 2 / np.where(y > 0, (y > 0).sum(), (y < 0).sum()).astype(np.float64)
    weight, alpha, length = np.zeros(x.shape[1]), np.zeros(len(y)), (x * x).sum(axis=1)
    order = np.random.default_rng(11)
    for _ in range(PASSES):
        for k in order.permutation(len(y)):
            new = min(max(alpha[k] + (1 - y[k] * (x[k] @ weight)) / length[k], 0.0), limit[k])
            if new != alpha[k]:
                weight += (new - alpha[k]) * y[k] * x[k]
                alpha[k] = new
    return weight.astype(np.float32)


class Model:
    """Families and their machines (one against the rest), then pairs of each family's languages."""

    def __init__(self, x: np.ndarray, labels: list[str]):
        self.languages = sorted(set(labels))
        self.family = {code: FAMILY.get(code, f"own {code}") for code in self.languages}
        self.families = sorted(set(self.family.values()))
        lang = np.array(labels)
        of = np.array([self.family[c] for c in labels])
        self.first = [fit_machine(x, np.where(of == f, 1, -1)) for f in self.families] if len(self.families) > 1 else []
        self.pairs = {}
        for f in self.families:
            for a, b in combinations([c for c in self.languages if self.family[c] == f], 2):
                own = (lang == a) | (lang == b)
                self.pairs[a, b] = fit_machine(x[own], np.where(lang[own] == a, 1, -1))

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        x = np.hstack([x, np.ones((len(x), 1), np.float32)])
        sure = lambda margin: 1 / (1 + np.exp(-SLOPE * np.clip(margin, -20, 20)))
        margin = x @ np.array(self.first).T if self.first else np.zeros((len(x), 1))
        best = margin.argmax(axis=1)
        score = sure(margin.max(axis=1)) if self.first else np.ones(len(x))
        names = np.full(len(x), "", object)
        for k, f in enumerate(self.families):
            rows, own = np.flatnonzero(best == k), [c for c in self.languages if self.family[c] == f]
            if len(own) == 1:
                names[rows] = own[0]
                continue
            votes, sums = np.zeros((len(rows), len(own))), np.zeros((len(rows), len(own)))
            for i, j in combinations(range(len(own)), 2):
                m = x[rows] @ self.pairs[own[i], own[j]]
                votes[:, i] += m > 0
                votes[:, j] += m <= 0
                sums[:, i] += m
                sums[:, j] -= m
            won = (votes + 1e-3 * np.tanh(sums)).argmax(axis=1)
            names[rows] = np.array(own, object)[won]
            score[rows] *= sure(sums[np.arange(len(rows)), won] / (len(own) - 1))
        return names.tolist(), score


def held_out(doc_id: Column) -> Column:
    """The contract's fold: crc32 of the id as text, modulo 5, is 0. A null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model | None:
    """Learn from text and label of rows outside the fold, at most `sample` of a label."""
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    space = 1 << 30
    rows = rows.filter("lang <> 'und'").withColumn("pick", F.pmod(F.xxhash64("doc_id", "text", F.lit(17)), F.lit(space)))
    labels = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("pick").alias("different")).orderBy(F.col("n").desc(), "lang").limit(ROWS)
    counts = {r.lang: max(1, int(r.different * 0.8)) for r in labels.collect()}  # the estimate is off by a few hundredths
    if not counts:
        return None
    per = max(1, min(sample, ROWS // len(counts)))
    most = F.create_map([x for c, n in sorted(counts.items()) for x in (F.lit(c), F.lit(min(space, int(space * (per + 4 * per**0.5 + 8) / n) + 1)))])
    picked = rows.filter(F.col("pick") < F.try_element_at(most, F.col("lang"))).groupBy("lang", "pick").agg(F.first("text").alias("text"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("pick"))
    picked = picked.withColumn("k", first).filter(F.col("k") <= per).drop("k")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts as the features that a text has and how often: a few KB a row go to the driver."""
        for batch in batches:
            counts = [features(t) for t in batch.column("text").to_pylist()]
            at = [np.flatnonzero(c).astype(np.uint16) for c in counts]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("pick"), pa.array([a.tobytes() for a in at], pa.binary()), pa.array([c[a].tobytes() for c, a in zip(counts, at, strict=True)], pa.binary())], names=["lang", "pick", "at", "n"])

    took: dict[str, list] = {}
    for r in picked.mapInArrow(returning(count), "lang string, pick long, at binary, n binary").toLocalIterator():
        own = np.zeros(1 << BITS, np.float32)
        own[np.frombuffer(r.at, np.uint16)] = np.frombuffer(r.n, np.float32)
        took.setdefault(r.lang, []).append((r.pick, own))
    x, labels = [], []
    for code in sorted(took):
        own = sorted(took[code], key=lambda p: p[0])[:per]
        x += [c for _, c in own]
        labels += [code] * len(own)
    return Model(shares(np.array(x)), labels) if x else None


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """doc_id, lang_pred, score, one row per row of docs; carry: text and rest too."""
    spark = docs.sparkSession
    prepare(spark)
    sent = spark.sparkContext.broadcast(model)
    plain = narrow(docs, id_col, text_col, carry)
    kind = plain.schema["doc_id"].dataType.simpleString()
    also = ["text", "rest"] if carry else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        letter, model = regex.compile(r"\p{L}"), sent.value
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                texts = batch.column("text").to_pylist()
                names, score = ["und"] * len(texts), np.zeros(len(texts))
                own = [k for k, t in enumerate(texts) if t and letter.search(t)] if model else []
                if own:
                    found, sure = model.predict(shares(np.array([features(texts[k]) for k in own])))
                    for k, name in zip(own, found, strict=True):
                        names[k] = name
                    score[own] = sure
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(score, pa.float64()), *(batch.column(c) for c in also)], names=["doc_id", "lang_pred", "score", *also])

    return plain.mapInArrow(returning(run), rows_of(f"doc_id {kind}, lang_pred string, score double" + (", text string" if carry else ""), plain))


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return identify(docs, fit(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
