"""Defined results of the corpus operators on nulls, repeats, ties, clashing columns and odd tables."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
from test_corpus_operators import SCHEMA, brute_lines, prose  # noqa: E402

from tidemark.llm import bpe, language_id, line_dedup, token_counts, url_filters, warc  # noqa: E402

CLASH = ["key", "n", "digest", "row", "drops", "keeper", "range", "side", "low", "pick", "k", "lang_pred", "score", "count", "size", "holder", "held", "uri", "page_id", "n_bytes", "_n", "_hot"]


def clashing(df, own):
    return df.withColumns({c: F.lit("x") for c in CLASH if c not in own})


def test_bpe_repeats_and_nulls(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    df = spark.createDataFrame([(1, "same text"), (1, "same text"), (None, "same text"), (None, None)], SCHEMA)
    got = sorted(map(tuple, bpe.query(spark, clashing(df, df.columns), path).collect()), key=str)
    assert len(got) == 4 and len({x[1:] for x in got if x[1]}) == 1 and [x[1] for x in got].count(0) == 1


def test_language_id_repeats_nulls_and_many_labels(spark):
    r = random.Random(4)
    parts = {"en": "the ing and tion sh wh er ly", "de": "sch ung der keit ein ß ä und"}
    text = lambda c: " ".join("".join(r.choice(parts[c].split()) for _ in range(3)) for _ in range(25))
    made = [(None if k % 2 else k, text(c), c) for k, c in enumerate(["en", "de"] * 60)] + [(7, "und the ing", None)] * 3
    df = spark.createDataFrame(made, "doc_id long, text string, lang string")
    got = language_id.query(spark, clashing(df, df.columns)).collect()
    assert len(got) == len(made) and len({(x.lang_pred, x.score, x.held_out) for x in got if x.doc_id == 7}) == 1
    assert not any(x.held_out for x in got if x.doc_id is None)
    model = language_id.fit(df, sample=5)
    assert model.languages == ["de", "en"]
    copies = df.filter("doc_id is null").limit(1).crossJoin(spark.range(4000)).select("doc_id", "text", "lang")
    assert language_id.fit(copies) is not None  # one row a copy group comes to the driver
    many = spark.range(30).select(F.col("id").alias("doc_id"), F.concat(F.lit("text of "), "id").alias("text"), F.concat(F.lit("l"), "id").alias("lang"))
    assert len(language_id.fit(many).languages) >= 20


@pytest.mark.parametrize("confirmed_mb", [64, 0])
def test_line_dedup_repeats_and_nulls(spark, confirmed_mb):
    r = random.Random(6)
    line = prose(r, 12)
    made = [(1, line), (1, line), (2, f"{line}\nother"), (None, line), (None, f"a\n{line}"), (None, None), (9, ""), (3, f"{line}\n{line.upper()} ")]
    df = spark.createDataFrame(made, SCHEMA).repartition(3)
    found = line_dedup.line_dedup(clashing(df, df.columns), confirmed_mb=confirmed_mb, segments=3)
    got = sorted(((x.doc_id, x.n_lines, x.n_dropped, x.kept) for x in found.collect()), key=str)
    # six rows hold the line; those of the largest id keep it, every time it stands there
    want = [(1, 1, 1, ""), (1, 1, 1, ""), (2, 2, 1, "other"), (None, 1, 1, ""), (None, 2, 1, "a"), (None, 1, 0, ""), (9, 1, 0, ""), (3, 2, 0, f"{line}\n{line.upper()} ")]
    assert got == sorted(want, key=str)


def test_line_dedup_many_segments(spark):
    r = random.Random(2)
    shared = [prose(r, 8) for _ in range(40)]
    texts = [(k, "\n".join([prose(r, 8) for _ in range(5)] + r.sample(shared, 3))) for k in range(80)]
    df = spark.createDataFrame(texts, SCHEMA).repartition(6)
    for segments in (1, 37):
        found = line_dedup.line_dedup(df, segments=segments).withColumn("h", F.sha2("kept", 256))
        assert {x.doc_id: (x.n_lines, x.n_dropped, x.h) for x in found.collect()} == brute_lines(texts)


def test_warc_clashing_columns_and_null_ids(spark):
    big = "<p>" + "x" * 200
    df = spark.createDataFrame([(None, "u", big), (None, "u", big), (4, None, big), (3, "u", big), (None, "u", "y" * 150), (None, "u", "y" * 150)], "page_id long, url string, html string")
    got = sorted(map(tuple, warc.query(spark, clashing(df, df.columns)).collect()), key=str)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    x, y = (203, sha(big)), (150, sha("y" * 150))
    assert got == sorted([(None, *x, "revisit", 3), (None, *x, "revisit", 3), (4, *x, "revisit", 3), (3, *x, "response", None), (None, *y, "response", None), (None, *y, "response", None)], key=str)


def test_url_rules_ties_case_and_clashes(spark):
    urls = ["http://a.com/x/y", "http://b.A.com/x", "http://c.com/", None, "http://deep.io/" + "p/" * 50]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = [("allow", "a.com", "/x"), ("block", "A.com", "/x"), ("allow", "a.com", "/x/y"), (None, "c.com", "/"), ("block", None, "/"), ("block", "c.com", None)] + [("block" if k % 2 else "allow", "deep.io", "/" + "p/" * k) for k in range(40)]
    for ranges in (1, 5):
        got = {x.page_id: (x.rule, x.verdict) for x in url_filters.url_filter(clashing(df, df.columns), rules, ranges=ranges).collect()}
        assert got == {0: ("a.com/x/y", "allow"), 1: ("a.com/x", "block"), 2: (None, "allow"), 3: (None, "allow"), 4: ("deep.io/" + "p/" * 39, "block")}
    table = spark.createDataFrame(rules, "verdict string, host string, path string").withColumn("key", F.lit("clash"))
    assert {x.page_id: x.verdict for x in url_filters.url_filter(df, table).collect()}[1] == "block"


def test_url_rules_of_one_host_are_asked_by_length():
    held = url_filters.Open("com.a.")
    for k in range(20_000):
        held.add(f"/{k:05d}", f"a.com/{k:05d}", "block")
    held.add("", "a.com", "allow")
    assert len(held.lengths) == 2 and held.best("/00017/x") == ("a.com/00017", "block") and held.best("/zz") == ("a.com", "allow")


def test_token_counts_of_a_frequent_text(spark, monkeypatch):
    from tidemark.llm import common

    monkeypatch.setattr(common, "OFTEN", 5)
    monkeypatch.setattr(common.lookup, "__defaults__", (5,))
    path = public_tokenizers.path("word_bpe_49k.json")
    made = [(k, "the same words" if k % 3 else f"words {k}") for k in range(90)] + [(None, None)] * 20
    df = spark.createDataFrame(made, SCHEMA).repartition(4)
    got = token_counts.token_counts(clashing(df, df.columns), path).collect()
    assert len(got) == len(made) and {x.n_tokens for x in got if x.doc_id is None} == {0}
    assert len({x.n_tokens for x in got if x.doc_id is not None and x.doc_id % 3}) == 1


def test_entry_without_the_corpus_part(monkeypatch):
    """What can't be imported is left out; the other queries stay."""
    import sys

    import __spark_entry__ as entry

    whole = len(entry.queries())
    monkeypatch.setitem(sys.modules, "tidemark.llm.queries", None)
    left = entry.queries()
    assert whole - len(left) == 11 and not any(k.startswith("op") for k in left) and not any(k.startswith("op") for k in entry.oracle_sql())
