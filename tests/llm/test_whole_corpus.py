"""Corpus operators do the whole job where ids and labels are unusual."""

import random

import pytest
from test_corpus_operators import SCHEMA, prose

from tidemark.llm import jaccard_join


def chain(r):
    """Three texts: the first and the last are linked only through the second."""
    w = prose(r, 100, 5000).split()
    return [" ".join(w[a : a + 88]) for a in (0, 6, 12)]


def test_jaccard_join_links_through_rows_without_id(spark):
    r = random.Random(8)
    (a, b, c), (d, e, f), other = chain(r), chain(r), prose(r, 60, 5000)
    assert not jaccard_join.linked(jaccard_join.shingles(a), jaccard_join.shingles(c))
    made = [(11, a), (None, b), (12, c), (None, d), (None, e), (None, f), (13, other), (None, None)]
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.query(spark, spark.createDataFrame(made, SCHEMA).repartition(3)).collect()}
    assert got == {(11, 84, 11), (None, 84, 11), (12, 84, 11), (None, 84, None), (13, 56, 13), (None, 0, None)}
    groups = [r.group for r in jaccard_join.jaccard_join(spark.createDataFrame(made[3:6], SCHEMA)).collect()]
    assert len({*groups}) == 1 and groups[0] is not None


def test_pipeline_without_labels_keeps_texts_with_letters(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.createDataFrame([(1, "plain words", None), (2, "12 34", None), (3, None, "en"), (4, "\u0434\u0430", None)], "doc_id long, text string, lang string")
    kept = pipeline.languages(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 4]


def test_pipeline_decides_by_id_and_text(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(9)
    a, b, c, (d, e, f) = prose(r, 60, 5000), prose(r, 60, 5000), prose(r, 60, 5000), chain(r)
    made = [(7, a), (7, b), (7, b), (3, a), (8, ""), (8, None), (9, c), (None, c), (None, d), (None, e), (None, f)]
    docs = spark.createDataFrame(made, "doc_id long, text string").repartition(3)
    kept = pipeline.near_duplicates(spark, docs, "")
    got = [tuple(r) for r in kept.collect()]
    assert kept.columns == docs.columns
    assert sorted((x for x in got if x[0] is not None), key=str) == sorted([(3, a), (7, b), (8, ""), (8, None), (9, c)], key=str)
    assert len([t for k, t in got if k is None and t in (d, e, f)]) == 1 and len(got) == 6


def test_decontaminate_in_many_blocks(spark):
    import pickle
    import sys

    from test_corpus_operators import brute_contaminated

    from tidemark.llm import decontaminate

    r = random.Random(17)
    texts = [(k, prose(r, 60, 3000)) for k in range(40)]
    items = [(k, " ".join(texts[k][1].split()[5:30])) for k in range(20)] + [(100 + k, prose(r, 30, 3000)) for k in range(60)] + [(None, texts[3][1]), (200, "w1 w2"), (200, "w1 w2")]
    made = [(k, t) for k, t in texts] + [(7, texts[7][1]), (None, texts[8][1]), (50, None)]
    docs, bench = spark.createDataFrame(made, SCHEMA).repartition(3), spark.createDataFrame(items, "item_id long, text string")
    named = bench.select(bench.item_id.alias("i"), bench.text.alias("t"))
    blocks = list(decontaminate.blocks_of(named, 13, 0.06))
    assert len(blocks) > 3
    for b in blocks:  # what is sent and what a worker holds stay near the stated bytes
        words = sum(sys.getsizeof(w) + 100 for w in b.vocabulary)
        arrays = sum(x.nbytes for x in (b.words, b.start, b.length, b.first, b.owner))
        assert len(pickle.dumps(b)) < 2 * b.size and words + arrays < 1.5 * b.size
    want = brute_contaminated([(k, t) for k, t in enumerate(t for _, t in made)], [(i, t) for i, t in items if i is not None])
    hit = brute_contaminated([(k, t) for k, t in enumerate(t for _, t in made)], items)
    for hits_mb in (64, 0):
        found = decontaminate.decontaminate(docs, bench, block_mb=0.06, hits_mb=hits_mb)
        got = sorted(((x.doc_id, x.n_words, x.n_hit, x.n_items, x.items_sha256) for x in decontaminate.judged(found).collect()), key=str)
        assert got == sorted(((k, hit[n][0], hit[n][1], *want[n][2:4]) for n, (k, _) in enumerate(made)), key=str)
    carried = decontaminate.decontaminate(docs.selectExpr("*", "doc_id as words", "1 as n_words"), bench, block_mb=0.06, carry=True)
    assert carried.filter("rest.n_words = 1 and rest.words <=> doc_id").count() == len(made)


def test_jaccard_join_cuts_large_blocks(spark, monkeypatch):
    from test_corpus_operators import brute_components, near_copies, rows

    monkeypatch.setattr(jaccard_join, "SETS", 6)
    monkeypatch.setattr(jaccard_join, "CHUNK", 3000)
    r = random.Random(5)
    base = prose(r, 80, 5000).split()
    group = []
    for k in range(60):  # one large group: most are linked, some only through others, some not at all
        own = list(base)
        for _ in range(k % 10):
            own[r.randrange(80)] = f"y{r.randrange(9999)}"
        group.append((k, " ".join(own)))
    texts = group + near_copies(7) + [(5000 + k, group[k][1]) for k in range(8)]
    got = {k: (x.n_shingles, x.component_id) for k, x in rows(jaccard_join.query(spark, spark.createDataFrame(texts, SCHEMA).repartition(5))).items()}
    assert got == brute_components(texts)


def test_lookup_of_frequent_keys(spark):
    from pyspark.sql import functions as F

    from tidemark.llm.common import lookup

    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("key"))
    table = spark.range(0, 3000, 2).select(F.col("id").alias("key"), (F.col("id") * 10).alias("v"))
    got = {r.id: r.v for r in lookup(rows, table, "key", often=100).collect()}
    assert got == {k: (0 if k % 3 == 0 else k * 10 if k % 2 == 0 else None) for k in range(3000)}


def test_next_documents_where_one_id_fills_many_ranges(spark):
    from pyspark.sql import functions as F

    from tidemark.llm import fingerprints

    r = random.Random(2)
    made = [(5 if k % 3 else 5 + k, prose(r, 3, 50)) for k in range(240)] + [(5, "w1 w1 w1")] * 3
    df = spark.createDataFrame(made, "key long, text string").repartition(4)
    tie = {x.text: x.t for x in df.select("text", F.xxhash64("text").alias("t")).collect()}
    order = sorted((k, tie[t], t) for k, t in made)
    want = sorted((a[0], a[2], b[2]) for a, b in zip(order, [*order[1:], order[0]], strict=True))
    for ranges in (1, 4, 9):
        found = fingerprints.with_next(df, ["text"], ranges=ranges)
        assert sorted(map(tuple, found.select("key", "text", "next_text").collect())) == want
    whole = fingerprints.query(spark, df.select(F.when(F.col("key") > 5, F.col("key")).alias("doc_id"), "text"))
    assert whole.count() == len(made) and whole.filter("near_next between 0 and 1").count() == len(made)
