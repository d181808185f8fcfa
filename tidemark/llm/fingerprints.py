"""Document fingerprints by one-permutation MinHash, in DataFrame functions alone.

Each distinct five-word shingle of a text (A-Z folded, words cut at ASCII white space; the whole sequence where it is shorter) is hashed
once. The hash's top bits choose one of 256 bins; a bin keeps its smallest hash. An empty bin copies the bin that its own universal hash
sequence reaches first (optimal densification): a dozen probes, then, for what those miss, the full bin whose hash with this bin is least,
which is the first of a random order of all bins. Of each bin the low 8 bits are stored, as two hex digits in 512. Two fingerprints agree in
a bin by chance once in 256, so that likeness = (share of equal bins - 1/256) / (1 - 1/256), held to 0..1.

Texts without words have the empty fingerprint; two such are alike by 1, such a text and any other by 0. Null is the empty text. Repeated
rows each get a row. A row's next document is the next in order of id, null ids first, and the first after the last; rows of one id stand in
order of a hash of their texts, then of the texts. Many rows of one id, or without one, are dealt over several ranges by that hash; rows
equal in both are alike in all that is returned, and stay together. An empty table gives none; other columns are not read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, let

BINS, PROBES, WORDS = 256, 12, 5
SPACE = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    trimmed = F.btrim(ascii_lower(text), F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\t-\\r]+"))


def shingle_hashes(text: Column, n: int = WORDS) -> Column:
    """A hash for each shingle, repeats included; none without words."""

    def hashed(w: Column) -> Column:
        count = F.size(w) - (n - 1)
        many = F.transform(F.arrays_zip(*(F.slice(w, F.lit(k + 1), F.greatest(count, F.lit(0))) for k in range(n))), lambda x: F.xxhash64(x))
        one = F.array(F.xxhash64(F.size(w), *[F.coalesce(F.get(w, F.lit(k)), F.lit(0)) for k in range(n - 1)]))
        return F.when(count > 0, many).when(F.size(w) > 0, one).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(words(text), lambda x: F.xxhash64(x)), hashed)


def bin_of(h: Column) -> Column:
    return F.shiftrightunsigned(h, 56).cast("int")


def low(h: Column) -> Column:
    """The stored bits, as 0 to 255."""
    return h.bitwiseAND(F.lit(255)).cast("int")


def probed(j: int, t: int) -> int:
    """Where bin j looks at its t-th probe, if it is empty: a fixed universal hash."""
    return hashlib.blake2b(f"{j},{t}".encode(), digest_size=2).digest()[0]


def constants(values: list) -> Column:
    return F.array(*map(F.lit, values))


def slots(text: Column) -> Column:
    """array<int>: each bin's low bits, 0 to 255; empty without words."""
    bins = F.sequence(F.lit(0), F.lit(BINS - 1))

    def least(s: Column) -> Column:
        """The first hash of each bin: where the top bits differ from those of the hash before."""
        before = F.concat(F.array(F.bitwise_not(F.get(s, F.lit(0)))), F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0))))
        return F.array_compact(F.zip_with(s, before, lambda x, y: F.when(F.shiftrightunsigned(x.bitwiseXOR(y), 56) != 0, x)))

    def densify(raw: Column, firsts: Column) -> Column:
        def value(j: Column) -> Column:
            rest = low(F.array_min(F.transform(firsts, lambda x: F.xxhash64(bin_of(x), j).bitwiseAND(F.lit(-256)).bitwiseOR(x.bitwiseAND(F.lit(255))))))
            probes = (F.get(raw, F.get(constants([probed(k, t) for k in range(BINS)]), j)) for t in range(PROBES))
            return F.coalesce(F.get(raw, j), *probes, rest)

        return F.transform(bins, value)

    def placed(firsts: Column) -> Column:
        # sorted as signed numbers, the bins come from 128 up and then from 0; with none empty, that gives each place
        lows = F.transform(firsts, low)
        full = F.concat(F.slice(lows, BINS // 2 + 1, BINS // 2), F.slice(lows, 1, BINS // 2))
        held = F.map_from_arrays(F.transform(firsts, bin_of), lows)
        raw = let(held, lambda m: F.transform(bins, lambda j: F.try_element_at(m, j)))
        return F.when(F.size(firsts) == BINS, full).when(F.size(firsts) == 0, F.array().cast("array<int>")).otherwise(let(raw, lambda r: densify(r, firsts)))

    return let(F.sort_array(shingle_hashes(text)), lambda s: F.when(F.size(s) == 0, F.array().cast("array<int>")).otherwise(let(least(s), placed)))


def packed(slots_: Column) -> Column:
    """The fingerprint: two hex digits a bin."""
    table = constants([f"{v:02x}" for v in range(256)])
    return F.array_join(F.transform(slots_, lambda v: F.get(table, v)), "")


def likeness(a: Column, b: Column) -> Column:
    same = F.size(F.array_compact(F.zip_with(a, b, lambda x, y: F.when(x == y, 1))))
    chance = 1 / BINS
    estimate = (same.cast("double") / BINS - chance) / (1 - chance)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.when(F.size(a) == F.size(b), F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), estimate)))


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its fingerprint; a map over the scan."""
    return docs.select(docs[id_col].alias("doc_id"), packed(slots(F.coalesce(docs[text_col].cast("string"), F.lit("")))).alias("fingerprint"))


def with_next(rows: DataFrame, columns: list[str], key: str = "key", ties: str = "text", ranges: int | None = None) -> DataFrame:
    """Each row with next_<c> of the row that follows in order of (key, hash of ties, ties), the first following the last.

    Rows are dealt once, to ranges of the key cut at its quantiles; a key that fills several ranges is dealt over them in order of the hash.
    The first rows of a range also go, as guests, to the range before, so that no order over all rows in one task is needed. key: a long
    without nulls; ties: a string without nulls.
    """
    spark = rows.sparkSession
    ranges = ranges or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.withColumn("tie", F.xxhash64(ties))
    cuts = sorted(rows.agg(F.percentile_approx(key, [k / ranges for k in range(1, ranges)], 100_000)).first()[0] or []) if ranges > 1 else []
    bounds = constants(cuts).cast("array<bigint>")
    below, equal = F.size(F.filter(bounds, lambda b: b < F.col(key))), F.size(F.filter(bounds, lambda b: b == F.col(key)))
    share = F.floor((F.col("tie") / F.lit(2.0**64) + 0.5) * equal)
    at = (below + F.greatest(F.lit(0), F.least(share, equal - 1))).cast("int") if cuts else F.lit(0)
    firsts = sorted((r[0], r[1][0], r[1][1]) for r in rows.select(at.alias("range"), key, "tie").groupBy("range").agg(F.min(F.struct(key, "tie"))).collect())  # a row for each range
    guests = [(first, tie, firsts[k - 1][0]) for k, (_, first, tie) in enumerate(firsts)]
    listed = spark.createDataFrame(guests, "guest_key long, guest_tie long, guest_range int")
    both = rows.withColumn("range", at).join(F.broadcast(listed), (F.col(key) == F.col("guest_key")) & (F.col("tie") == F.col("guest_tie")), "left")
    places = F.array_compact(F.array(F.struct(F.col("range").alias("r"), F.lit(0).alias("g")), F.when(F.col("guest_range").isNotNull(), F.struct(F.col("guest_range").alias("r"), F.lit(1).alias("g")))))
    dealt = both.select(*rows.columns, F.explode(places).alias("place")).select(*rows.columns, "place.r", "place.g")
    order = Window.partitionBy("r").orderBy("g", key, "tie", ties)
    return dealt.select(*rows.columns, "g", *(F.lead(c).over(order).alias(f"next_{c}") for c in columns)).filter("g = 0").drop("g", "tie")


def compare(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and likenesses; see query()."""
    rows = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)).cast("long")))
    # cuts and range firsts are taken from the ids and texts alone; slots are computed once, before the rows are dealt, and move as small numbers
    paired = with_next(rows.withColumn("slots", slots(F.col("text")).cast("array<smallint>")), ["text", "slots"])
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = paired.select("doc_id", n.cast("long").alias("n_chars"), "slots", "next_slots", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)).alias("edited"))
    both = edited.select("doc_id", "n_chars", "slots", "next_slots", F.sha2("edited", 256).alias("edited_sha256"), slots(F.col("edited")).cast("array<smallint>").alias("edited_slots"))
    return both.select(
        "doc_id", "n_chars", "edited_sha256", packed(F.col("slots")).alias("fingerprint"), packed(F.col("edited_slots")).alias("edited_fingerprint"),
        likeness(F.col("slots"), F.col("edited_slots")).alias("near_edited"), likeness(F.col("slots"), F.col("next_slots")).alias("near_next"),
    )


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return compare(docs)
