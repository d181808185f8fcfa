"""Personal data: a span that only a dropped span overlaps is kept."""

from types import SimpleNamespace

from pyspark.sql import functions as F
from test_corpus_operators import SCHEMA, rows

from tidemark.llm import pii


def test_pii_takes_what_only_a_dropped_span_overlaps(spark, monkeypatch):
    at = {"email": (0, 10, 0.99), "ip": (8, 20, 0.98), "card": (18, 30, 0.97), "phone": (25, 28, 0.96)}
    monkeypatch.setattr(pii, "candidates", lambda text, kind, base: F.array(F.struct(F.lit(at[kind][0]).alias("s"), F.lit(pii.KINDS.index(kind)).alias("k"), F.lit(at[kind][1]).alias("e"), F.struct(F.lit(at[kind][2]).alias("p")).alias("f"))))
    trees = SimpleNamespace(threshold=[0.5] * 4, column=lambda f: f["p"])
    found = pii.spans(spark.createDataFrame([(1, "x" * 40)], SCHEMA), trees=trees)
    assert [tuple(a) for a in rows(found)[1].added] == [(0, 0, 10), (18, 2, 30)]
    assert rows(pii.redacted(found))[1].text == "[EMAIL]" + "x" * 8 + "[CARD]" + "x" * 10


def test_pii_recall_on_lines_that_no_rule_made(spark):
    from pii_lines import CLEAN, FOUND

    df = spark.createDataFrame([(k, x[0]) for k, x in enumerate(FOUND + CLEAN)], SCHEMA).repartition(3)
    got = rows(pii.spans(df))
    caught, seen = dict.fromkeys(pii.KINDS, 0), dict.fromkeys(pii.KINDS, 0)
    for k, (line, kind, text) in enumerate(FOUND):
        s = line.index(text)
        seen[kind] += 1
        caught[kind] += any(pii.KINDS[x.k] == kind and x.s <= s + 1 and x.e >= s + len(text) - 1 for x in [*got[k].base, *got[k].added])
    print({kind: f"{caught[kind]} of {n}" for kind, n in seen.items()})
    assert sum(caught.values()) >= 0.9 * len(FOUND) and all(caught[kind] >= 0.8 * n for kind, n in seen.items())
    false = [k for k in range(len(FOUND), len(FOUND) + len(CLEAN)) if got[k].added]
    assert len(false) <= 0.02 * len(CLEAN)


def test_pii_takes_the_best_of_each_run(spark):
    """chosen() against a plain greedy selection; many runs, long and short."""
    import random

    r = random.Random(3)
    made = []
    for k in range(6):
        at, spans = 0, []
        for _ in range([0, 1, 2, 40, 700, 1500][k]):
            at += r.choice([0, 1, 3, 9, 40])
            spans.append((r.choice([0.5, 0.6, 0.7, 0.8, 0.9]), at, r.randrange(4), at + r.randint(5, 20)))
        made.append((k, spans))
    df = spark.createDataFrame(made, "k int, sure array<struct<p:double,s:int,k:int,e:int>>")
    got = {x.k: [tuple(s) for s in x.c] for x in df.select("k", pii.chosen(F.col("sure")).alias("c")).collect()}
    for k, spans in made:
        want = []
        for _, s, kind, e in sorted((-p, s, kind, e) for p, s, kind, e in spans):
            if not any(s < b and a < e for a, _, b in want):
                want.append((s, kind, e))
        assert got[k] == sorted(want)


def test_pii_many_spans_in_one_text(spark):
    log = "\n".join(f"10.0.{k % 256}.{k % 251} user{k}@mail.example.com call (555) 123-4{k % 1000:03d}" for k in range(3000))
    got = rows(pii.query(spark, spark.createDataFrame([(1, log), (1, log), (None, None)], SCHEMA)))
    assert (got[1].n_ip, got[1].n_email) == (3000, 3000) and got[1].n_added >= 2900
    assert got[None].n_added == 0
