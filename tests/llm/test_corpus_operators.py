"""Each corpus operator against a brute-force version, and on nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import bisect
import hashlib
import random
import re
import unicodedata

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tidemark.llm import bpe, components, decontaminate, fingerprints, jaccard_join, language_id, line_dedup, pii, token_counts, url_filters, warc  # noqa: E402

SCHEMA = "doc_id long, text string"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def prose(r, n, vocab=400):
    return " ".join(f"w{r.randrange(vocab)}" for _ in range(n))


def corpus(seed=3):
    """Copies, near copies, shared lines, junk, nulls and empties."""
    r = random.Random(seed)
    shared = [prose(r, 30) for _ in range(3)]
    out = []
    for k in range(60):
        lines = [prose(r, r.randint(3, 60)) for _ in range(r.randint(1, 5))]
        if k % 3 == 0:
            lines.insert(r.randrange(len(lines)), f"  {shared[k % 9 // 3].upper()}\t")
        out.append("\n".join(lines))
    out += [out[0], out[0], out[1].replace("w1 ", "w2 ", 1), " ".join(out[5].split()[:-1]), None, "", "   \t\n ", "é", "one two", "ONE two", "x" * 5000, "a " * 20000, "\n" * 50, "日本語 のテキスト " * 3, "\x01\x02 a@b.co \x01"]
    return list(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5).cache()


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- 1 ----


def brute_contaminated(texts, items, window=13):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall((t or "").translate({65 + k: 97 + k for k in range(26)}))
    out = {}
    for k, t in texts:
        w, hit, found = split(t), set(), set()
        for i, item in items:
            x = split(item)
            n = min(window, len(x))
            windows = {tuple(x[a : a + n]) for a in range(len(x) - n + 1)} if n else set()
            for a in range(len(w) - n + 1 if n else 0):
                if tuple(w[a : a + n]) in windows:
                    hit |= {*range(a, a + n)}
                    found.add(str(i))
        out[k] = len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w)
    return out


@pytest.mark.parametrize(("block_mb", "shard"), [(16, 2_000_000), (0.0005, 300)])
def test_decontaminate(spark, docs, block_mb, shard):
    texts = corpus()
    r = random.Random(9)
    items = [(10, " ".join(texts[5][1].split()[2:40])), (9, "Two W1, w2!"), (8, None), (7, "..."), (6, texts[7][1].upper()), (5, "a a a a a a a a a a a a a a"), (4, "ONE-two"), (3, prose(r, 40)), (2, "日本語")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = rows(decontaminate.judged(decontaminate.decontaminate(docs, bench, block_mb=block_mb, shard=shard)))
    want = brute_contaminated(texts, items)
    assert {k: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for k, r in got.items()} == want
    spans = rows(decontaminate.decontaminate(docs, bench))[5]
    assert [spans.text[s.a : s.b].split()[0] for s in spans.spans][0] == texts[5][1].split()[2]


def test_decontaminate_edges(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(r.n_hit == 0 and not r.contaminated for r in decontaminate.query(spark, docs, none).collect())
    assert decontaminate.query(spark, empty(spark), none).count() == 0


# ---- 2 ----


def library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe(spark, docs):
    t, path = library("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.json")
    extra = [(100, "a<|endoftext|>b <|endoftext|>"), (101, "  x\u00a0  y\u3000 z \x1c q"), (102, "it's we'll I'M 12 345\r\n\r\n  end  "), (103, "ab" * 3000)]
    all_ = docs.union(spark.createDataFrame(extra, SCHEMA))
    got = rows(bpe.query(spark, all_, path))
    for k, text in corpus() + extra:
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert (got[k].n_tokens, got[k].ids_sha256, got[k].decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False)))
    full = rows(bpe.bpe(all_, path))
    assert full[102].decoded == extra[2][1]
    assert list(full[100].ids) == t.encode(extra[0][1], add_special_tokens=False).ids
    assert bpe.query(spark, empty(spark), path).count() == 0


def test_bpe_pieces_at_random():
    t = library("byte_bpe_50k.json")
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        v, u = bpe.load(f.read())
    r = random.Random(1)
    letters = [*"abcdehinorst  \t\n.,'12é日\u00a0\u2003\x85\x1f", "<|endoftext|>", "ing", "tion", " the"]
    for _ in range(3000):
        text = "".join(r.choice(letters) for _ in range(r.randint(0, 40)))
        assert bpe.encode(text, v, u)[1].tolist() == t.encode(text, add_special_tokens=False).ids


# ---- 3 ----


def brute_components(texts):
    low = {65 + k: 97 + k for k in range(26)}
    sets = {}
    for k, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets[k] = {tuple(w[a : a + 5]) for a in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    label = {k: k for k in sets}
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = sorted((label[a], label[b]), reverse=True)
                label = {k: new if v == old else v for k, v in label.items()}
    return {k: (len(sets[k]), label[k]) for k in ids}


def near_copies(seed, n=120):
    """Families of texts that differ by some words, at and around the threshold, in chains."""
    r = random.Random(seed)
    out, base = [], None
    for k in range(n):
        if k % 12 == 0:
            base = prose(r, r.randint(6, 90), 5000).split()
        own = list(base)
        for _ in range(r.randint(0, max(1, len(own) // 40))):
            own[r.randrange(len(own))] = f"z{r.randrange(9999)}"
        if r.random() < 0.3:
            base = own
        out.append((k + 1000, " ".join(own[: len(own) - r.randint(0, 3)])))
    return out


@pytest.mark.parametrize("block", [None, 400])
def test_jaccard_join(spark, docs, block, monkeypatch):
    if block:
        monkeypatch.setattr(jaccard_join, "BLOCK", block)
    texts = corpus() + near_copies(4)
    df = docs.union(spark.createDataFrame(near_copies(4), SCHEMA)).repartition(6)
    got = {k: (r.n_shingles, r.component_id) for k, r in rows(jaccard_join.query(spark, df)).items()}
    assert got == brute_components(texts)


def test_traverse_is_exhaustive():
    r = random.Random(2)
    for seed in range(4):
        texts = near_copies(seed, 150) if seed else [(k, prose(r, 40, 60)) for k in range(60)]
        sets = [jaccard_join.shingles(t) for _, t in texts]
        found = jaccard_join.traverse(sets)
        want = brute_components(list(enumerate(t for _, t in texts)))
        assert [int(x) for x in found] == [want[k][1] for k in range(len(texts))]


def test_jaccard_join_edges(spark):
    assert jaccard_join.query(spark, empty(spark)).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (7, None)], SCHEMA)
    got = sorted(map(tuple, jaccard_join.query(spark, df).collect()), key=str)
    assert got == sorted([(None, 2, 5), (5, 2, 5), (5, 2, 5), (7, 0, 7)], key=str)


def test_components(spark):
    r = random.Random(8)
    edges = [(k, k + 1) for k in range(200, 260)] + [(r.randrange(100), r.randrange(100)) for _ in range(60)]
    label = {}
    for a, b in edges:
        x, y = label.setdefault(a, {a}), label.setdefault(b, {b})
        if x is not y:
            x |= y
            for k in y:
                label[k] = x
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: min(s) for k, s in label.items() if k != min(s)}


# ---- 4 ----


def test_language_id(spark):
    r = random.Random(6)
    parts = {"en": "the ing and tion sh wh er ly", "de": "sch ung der keit ein ß ä und", "fr": "eau que les oi ç tre ou è", "es": "ción que los ñ ll ado ez ía"}
    made = [(k, " ".join("".join(r.choice(parts[c].split()) for _ in range(3)) for _ in range(25)), c) for k, c in enumerate(r.choice([*parts]) for _ in range(300))]
    df = spark.createDataFrame([*made, (900, None, "en"), (901, "12 34 !", "de"), (902, "", None), (903, "ß" * 50000, None)], "doc_id long, text string, lang string")
    got = rows(language_id.query(spark, df))
    import zlib

    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in got.items())
    held = [k for k, *_ in made if got[k].held_out]
    assert sum(got[k].lang_pred == made[k][2] for k in held) >= 0.95 * len(held)
    assert [got[k].lang_pred for k in (900, 901, 902)] == ["und"] * 3
    assert got[903].lang_pred in parts and all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in language_id.query(spark, df.withColumn("lang", df.lang.substr(9, 1)).replace("", None, "lang")).collect()} == {"und"}
    assert language_id.query(spark, df.limit(0)).count() == 0


# ---- 5 ----


def brute_lines(texts, least=20, documents=3):
    strip, low = " \t\n\x0b\x0c\r", {65 + k: 97 + k for k in range(26)}
    key = lambda x: x.strip(strip).translate(low)
    held = {}
    for k, t in texts:
        for x in {key(line) for line in (t or "").split("\n")}:
            if len(x) >= least:
                held.setdefault(x, []).append(k)
    goes = {x: max(ks) for x, ks in held.items() if len(ks) >= documents}
    out = {}
    for k, t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if goes.get(key(x), k) == k]
        out[k] = len(lines), len(lines) - len(kept), sha("\n".join(kept))
    return out


@pytest.mark.parametrize("confirmed_mb", [64, 0])
def test_line_dedup(spark, docs, confirmed_mb):
    from pyspark.sql import functions as F

    got = rows(line_dedup.line_dedup(docs, confirmed_mb=confirmed_mb).withColumn("h", F.sha2("kept", 256)))
    assert {k: (r.n_lines, r.n_dropped, r.h) for k, r in got.items()} == brute_lines(corpus())
    assert line_dedup.query(spark, empty(spark)).count() == 0


# ---- 6 ----


def pages(spark):
    big = "<p>" + "x" * 300
    made = [(4, "http://a.net/1", big), (2, "http://a.net/2", big), (9, None, big), (1, "u\r\nWARC/1.1", "short"), (3, "é", "short"), (5, "x", None), (6, "x", "WARC/1.1\r\n\r\n" * 30), (7, "x", "é" * 60), (7, "x", "é" * 60), (8, "x", "é" * 60)]
    return made, spark.createDataFrame(made, "page_id long, url string, html string")


def test_warc(spark):
    made, df = pages(spark)
    got = sorted(map(tuple, warc.query(spark, df).collect()), key=str)
    first = {}
    for k, _, h in made:
        first[h or ""] = min(k, first.get(h or "", k))
    want = []
    for k, _, h in made:
        data = (h or "").encode()
        later = len(data) >= 100 and first[h or ""] != k
        want.append((k, len(data), hashlib.sha256(data).hexdigest(), "revisit" if later else "response", first[h or ""] if later else None))
    assert got == sorted(want, key=str)
    assert warc.query(spark, df.limit(0)).count() == 0


def test_warc_rejects_magic_in_payloads(spark, tmp_path):
    import zlib

    inner = warc.record("666", "inside", b"never a record of its own", 25, "0" * 64, None)
    squeeze = zlib.compressobj(0, zlib.DEFLATED, 31)  # stored, so that the inner member stands in the file as it is
    body = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:2>\r\nWARC-Payload-Digest: sha256:1\r\nWARC-Payload-Length: %d\r\nContent-Length: %d\r\n\r\n" % (len(inner), len(inner))
    outer = squeeze.compress(body + inner + b"\r\n\r\n") + squeeze.flush()
    data = warc.record("1", "u", b"a" * 500, 500, "2" * 64, None) + outer + warc.record("3", "u", b"b", 1, "3" * 64, None) + b"\x1f\x8b\x08broken"
    assert data.count(warc.MAGIC) > 4
    (tmp_path / "x.warc.gz").write_bytes(data)
    listed = spark.createDataFrame([("x.warc.gz", len(data), 3)], "archive string, bytes long, records long")
    for block_mb in (4, 0.0001):
        got = {r.page_id: bytes(r.payload) for r in warc.read_warc(listed, f"file://{tmp_path}", block_mb=block_mb).collect()}
        assert got == {"1": b"a" * 500, "2": inner, "3": b"b"}


# ---- 7 ----


def test_url_filters(spark):
    urls = ["http://net/", "https://A.Example.NET/en/x?q#f", "http://example.net/de/", "http://notnet/", "http://x.example.com/de/1", "http://example.com/de", "http://a.org/fr/", "http://org/fr/x", "net/", None, "", "://net/a", "http://example.net", "http://example.net?x=/en/", "x://a://net/", "http://a..net/", "http://example.net:80/en/", "http://bexample.com/de/"]
    r = random.Random(5)
    urls += [f"http://{'.'.join(r.choice('ab') for _ in range(r.randint(1, 4)))}/{r.choice(['', 'p/', 'p/q', 'r'])}" for _ in range(200)] + ["http://hot.net/same"] * 300
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    more = [("block", "a.b", "/"), ("allow", "b", "/p"), ("block", "b", "/p/q"), ("allow", "a.a", ""), ("block", "b.a.a", "/r")]
    for rules in (url_filters.RULES, url_filters.RULES + more):
        for ranges in (1, 7):
            got = {r.page_id: r for r in url_filters.url_filter(df, rules, ranges=ranges).collect()}
            for k, url in enumerate(urls):
                _, mark, rest = (url or "").partition("://")
                host = re.split("[/?#]", rest)[0]
                path = re.split("[?#]", rest[len(host) :])[0] if mark else ""
                host = host.translate({65 + k: 97 + k for k in range(26)}) if mark else ""
                fit = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
                best = max(fit) if fit else (0, 0, None, "allow")
                assert (got[k].host, got[k].path, got[k].rule, got[k].verdict) == (host, path, best[2], best[3]), url
    assert url_filters.query(spark, df.limit(0)).count() == 0


# ---- 8 ----


def test_fingerprints(spark, docs):
    texts = [(k, t or "") for k, t in corpus()]
    got = rows(fingerprints.query(spark, docs))
    plain = rows(fingerprints.fingerprint(docs))
    low = {65 + k: 97 + k for k in range(26)}

    def sets(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(low))
        return {tuple(w[a : a + 5]) for a in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    errors = []
    for i, (k, t) in enumerate(texts):
        after = texts[(i + 1) % len(texts)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert got[k].n_chars == len(t) and got[k].edited_sha256 == sha(edited) and got[k].fingerprint == plain[k].fingerprint
        assert len(got[k].fingerprint) == (512 if sets(t) else 0)
        errors += [abs(got[k].near_edited - like(sets(t), sets(edited))), abs(got[k].near_next - like(sets(t), sets(after)))]
        assert t != edited or got[k].fingerprint == got[k].edited_fingerprint
    assert max(errors) < 0.2 and sum(errors) / len(errors) < 0.03
    assert got[0].fingerprint == got[60].fingerprint != got[1].fingerprint
    assert fingerprints.query(spark, empty(spark)).count() == 0
    one = fingerprints.query(spark, spark.createDataFrame([(None, "a b c d e f g")], SCHEMA)).first()
    assert (one.near_next, one.n_chars) == (1.0, 13)


def test_with_next_over_many_ranges(spark):
    from pyspark.sql import functions as F

    r = random.Random(1)
    ids = r.sample(range(10000), 300)
    df = spark.createDataFrame([(k, str(k)) for k in ids], "key long, text string").repartition(7)
    order = sorted(ids)
    for ranges in (1, 2, 13):
        got = {r.key: r.next_text for r in fingerprints.with_next(df, ["text"], ranges=ranges).collect()}
        assert got == {k: str(order[(bisect.bisect(order, k)) % len(order)]) for k in ids}
    assert fingerprints.with_next(df.filter(F.col("key") < 0), ["text"], ranges=3).count() == 0


# ---- 9 ----


def brute_spans(text):
    kinds = ["email", "ip", "card", "phone"]
    pattern = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def ok(kind, m):
        d = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        if kind == "card":
            return 12 <= len(d) <= 19 and sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0
        return kind == "email" or 9 <= len(d) <= 15

    found = [(m.start(), kinds.index(k), m.end(), k) for k in kinds for m in re.finditer(pattern[k], text or "") if ok(k, m.group())]
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(found)]


def test_pii_base(spark):
    r = random.Random(4)
    letters = [*"ab1234567890.-@+ ()_%é😀\x01\x02", "4111111111111111", "a@b.co", "1.2.3.4", "+1 (555) 555-1234", "..", "@b.c.d", "255.255.255.255"]
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(400)]
    texts += [None, "", "a" * 60000, "a." * 20000 + "@b", "x@" + "a." * 20000, "1 " * 30000, "+1" + "2" * 30000, "9" * 30000, "1.1.1.1 " * 700, "mail a@b.c_d@e.f x", "4111 1111 1111 1111 and 4111-1111-1111-1112", "999.1.1.1 01.002.3.4"]
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(4)
    got = rows(pii.query(spark, df))
    for k, t in enumerate(texts):
        want = brute_spans(t)
        assert got[k].base_sha256 == sha(",".join(want)), t
        assert [got[k].n_email, got[k].n_ip, got[k].n_card, got[k].n_phone] == [sum(x.startswith(f"{kind}:") for x in want) for kind in pii.KINDS]
        assert {*want} <= {*filter(None, got[k].spans.split(","))}


def test_pii_adds_loose_forms_and_leaves_prose(spark):
    loose = ["mail jane.12 at example dot com now", "call (555) 123-4567 today", "host 10[.]0[.]0[.]1 is up", "card 4111.1111.1111.1111 ok"]
    clean = ["version 1.2.3 of 2024-01-02 10.30", "meet at noon.Then go", "order 1234567890123456 shipped", "look at that dot com", "price 1,234,567.00 total"]
    got = rows(pii.spans(spark.createDataFrame(list(enumerate(loose + clean)), SCHEMA)))
    assert [len(got[k].added) for k in range(len(loose))] == [1] * len(loose)
    assert [len(got[k].added) + len(got[k].base) for k in range(len(loose), len(loose) + len(clean))] == [0] * len(clean)
    text = rows(pii.redacted(pii.spans(spark.createDataFrame([(1, "a a@b.co b +1 555 555 1234."), (2, "none")], SCHEMA))))
    assert (text[1].text, text[2].text) == ("a [EMAIL] b [PHONE].", "none")
    assert pii.query(spark, empty(spark)).count() == 0


# ---- 10 ----


def test_token_counts(spark, docs, tmp_path):
    t, path = library("word_bpe_49k.json"), public_tokenizers.path("word_bpe_49k.json")
    extra = [(200, "A<|endoftext|>b<|STARTOFTEXT|> <|startoftext|>"), (201, "x\u00a0 y\u3000ΣΑΣ e\u0301 it's"), (202, "one  two\n\n three"), (203, "one two three"), (204, unicodedata.normalize("NFD", "é à"))]
    all_ = docs.union(spark.createDataFrame(extra, SCHEMA))
    cache = f"file://{tmp_path}/cache"
    for _ in range(2):
        got = rows(token_counts.token_counts(all_, path, cache))
        for k, text in corpus() + extra:
            n = len(t.encode(text or "", add_special_tokens=False).ids)
            assert (got[k].n_bytes, got[k].n_tokens, got[k].over_limit) == (len((text or "").encode()), n, n > 2048)
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count()  # the second call appended nothing
    model = public_tokenizers.path("piece_bpe_32k.model")
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    got = rows(token_counts.token_counts(all_, model))
    assert all(got[k].n_tokens == len(sp.encode(text or "")) for k, text in corpus() + extra)
    assert token_counts.token_counts(empty(spark), path).count() == 0


def test_clashing_columns(spark, docs):
    from pyspark.sql import functions as F

    names = ["key", "n", "digest", "range", "slots", "part", "keys", "block", "a", "b", "items", "spans", "lang_pred", "drops", "component_id"]
    wide = docs.withColumns({c: F.lit("x") for c in names}).limit(20)
    bench = spark.createDataFrame([(1, "w1 w2", 3)], "item_id long, text string, doc_id long")
    for df in (line_dedup.query(spark, wide), decontaminate.query(spark, wide, bench), jaccard_join.query(spark, wide), fingerprints.query(spark, wide), pii.query(spark, wide), bpe.query(spark, wide, public_tokenizers.path("byte_bpe_50k.json")), token_counts.token_counts(wide, public_tokenizers.path("word_bpe_49k.json"))):
        assert df.count() == 20 and df.columns[0] == "doc_id"
