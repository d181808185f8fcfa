"""The pipeline on small documents: each stage's decisions, what it keeps, and its edges."""

import random

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from test_corpus_operators import brute_components, brute_contaminated, corpus, near_copies, prose  # noqa: E402

import __spark_entry__  # noqa: E402

NAMES = ["language ID", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "BPE encoding and decoding"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    r = random.Random(12)
    texts = corpus() + near_copies(4)
    items = [(k, prose(r, 30)) for k in range(4)]
    texts += [(5000, items[1][1]), (5001, prose(r, 900) + " " + items[2][1]), (None, "no id here at all"), (5002, None), (7000, "same id, two rows of it, alike"), (7000, "same id, two rows of it, alike")]
    made = [(k, t, "en", "src", len(t or "")) for k, t in texts]
    spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def read(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_stages(spark, folder):
    assert [name for name, _ in corpus_pipeline.STAGES] == NAMES
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    one = corpus_pipeline.languages(spark, docs, folder)
    assert one.columns == columns
    assert read(one) == sorted(((k, t) for k, t in read(docs) if t and any(c.isalpha() for c in t)), key=str)
    two = corpus_pipeline.lines(spark, one, folder).cache()
    assert two.columns == columns and two.count() == one.count()
    assert two.filter("n_chars <> char_length(text)").count() == 0
    three = corpus_pipeline.near_duplicates(spark, two, folder).cache()
    assert three.columns == columns
    texts = {r.doc_id: r.text for r in two.filter("doc_id is not null").collect()}
    groups = brute_components(sorted(texts.items()))
    assert [r.doc_id for r in three.filter("doc_id is not null").orderBy("doc_id").collect()] == sorted(k for k, (_, c) in groups.items() if k == c)
    assert three.filter("doc_id is null").count() == 1
    four = corpus_pipeline.decontaminated(spark, three, folder)
    assert four.columns == columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    bad = {k for k, v in brute_contaminated([(k, t) for k, t in read(three)], items).items() if v[4]}
    assert 5000 in bad and 5001 not in bad
    assert read(four) == [(k, t) for k, t in read(three) if k not in bad]
    assert read(four.select(*columns)) and four.filter(F.col("source") != "src").count() == 0
    five = corpus_pipeline.tokens(spark, four, folder)
    assert five.count() == four.count()


def test_run_is_registered(spark, folder):
    got = __spark_entry__.queries()["pipeline"](spark, folder)
    assert {"doc_id", "n_tokens", "ids"} <= {*got.columns} and got.count() > 50


def test_empty(spark, folder):
    none = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, folder)
        assert none.count() == 0
