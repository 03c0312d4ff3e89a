"""Ranked search, vector codes and URL filters against plain versions, and on odd tables."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import tests.llm.helpers as h
from siftfield.llm import lexical_search, url_filter, vector_codes

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranked(docs, items, k=10):
    tf = [Counter(TERM.findall(h.lower(t))) for _, t in docs]
    held = [c for c in tf if c]
    n_docs, n_words = len(held), sum(sum(c.values()) for c in held)
    df = Counter(t for c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for (d, _), c in zip(docs, tf):
            m = 25 + 75 * sum(c.values()) * n_docs // n_words
            parts = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in TERM.findall(h.lower(text)) if t in c]
            scores.append((-sum(parts), d is None, d or 0))
        out += [(item, r + 1, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(s for s in scores if s[0] < 0)[:k])]
    return Counter(out)


ITEMS = [(1, "some words and MORE words; again and again"), (2, None), (3, ""), (4, "..."), (5, "nowhere-to-be-found"), (6, "word ünïcödé 漢字"), (1, "some words and MORE words; again and again"), (None, "one two three"), (7, "mit License under the license"), (8, "a b a b a")]


@pytest.mark.parametrize("chars, docs_at_once", [(4_000_000, 2000), (40, 3)])
def test_search_equals_plain_scores(spark, monkeypatch, chars, docs_at_once):
    monkeypatch.setattr(lexical_search, "BLOCK_CHARS", chars)
    monkeypatch.setattr(lexical_search, "DOCS", docs_at_once)
    rows = h.ODD + [(20 + i, f"words and again {i % 3} one word") for i in range(30)] + [(None, "some words")] * 3
    docs = h.odd(spark, rows).withColumns({"rank": F.lit("own"), "item_id": F.lit("own")}).repartition(4)
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string").withColumn("doc_id", F.lit(0))
    got = lexical_search.search(docs, items, k=5)
    assert Counter(map(tuple, got.select("item_id", "rank", "id", "score").collect())) == ranked(rows, ITEMS, 5)


def test_search_of_empty_tables_and_very_long_texts(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert lexical_search.search(docs, items).count() == 0
    assert lexical_search.search(h.odd(spark), items.limit(0)).count() == 0
    rows = [(1, "rare " + "common words " * 200_000), (2, "common " * 10), (3, "rare")]
    asked = [(1, "rare common"), (2, "common " * 50_000)]
    got = lexical_search.search(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(asked, "item_id bigint, text string"))
    assert Counter(map(tuple, got.select("item_id", "rank", "id", "score").collect())) == ranked(rows, asked)


def test_graph_gives_back_the_items_with_fewer_additions():
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{min(199, int(x))}" for x in rng.zipf(1.4, 60)).encode() for _ in range(80)]
    plan = lexical_search.Plan(texts)
    whole = [Counter({i: 1}) for i in range(len(plan.vocabulary))]
    for a, b in plan.made:
        assert max(a, b) < len(whole)
        whole.append(whole[a] + whole[b])
    for text, summands in zip(texts, plan.items):
        assert sum((whole[s] for s in summands), Counter()) == Counter(plan.vocabulary[t] for t in lexical_search.terms(text))
    shared, plain = plan.additions()
    assert shared < 0.6 * plain


def plain_nearest(x, entries):
    d = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)
    return d.argmin(axis=1), d.min(axis=1)


@pytest.mark.parametrize("n, dims, spread", [(256, 16, 300), (256, 5, 3), (1, 4, 50), (70, 3, 10**6)])
def test_slices_find_the_nearest_entry(n, dims, spread):
    rng = np.random.default_rng(n + dims)
    entries, x = rng.integers(-spread, spread, (n, dims)), rng.integers(-2 * spread, 2 * spread, (3000, dims))
    x[:n] = entries  # ties at distance 0 too
    x[-1], x[-2] = vector_codes.MOST, -vector_codes.MOST
    for got, want in zip(vector_codes.Slices(entries).nearest(x), plain_nearest(x, entries)):
        assert (got == want).all()


def test_slices_read_a_part_of_clustered_entries():
    rng = np.random.default_rng(0)
    centres = rng.integers(-5000, 5000, (32, 16))
    entries = (centres[:, None] + rng.integers(-60, 60, (32, 8, 16))).reshape(256, 16)
    x = centres[rng.integers(0, 32, 4000)] + rng.integers(-60, 60, (4000, 16))
    s = vector_codes.Slices(entries)
    assert (s.nearest(x)[0] == plain_nearest(x, entries)[0]).all()
    assert len(s.within(x, np.sqrt(s.nearest(x)[1]).astype(np.int64) + 1)[0]) < 0.05 * 4000 * 256


def plain_codes(rows):
    """(id, vector, label), whole ones of one length -> id, code, error, sum by label, and the codebooks."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    v = np.floor(1024 * np.array([np.float32(r[1]) for r in rows], np.float64)).astype(np.int64)
    parts = v.reshape(len(v), 4, -1)
    books = [parts[:256, p].copy() for p in range(4)]
    for _ in range(4):
        for p in range(4):
            at = plain_nearest(parts[:, p], books[p])[0]
            for e in set(at.tolist()):
                books[p][e] = parts[at == e, p].sum(axis=0) // (at == e).sum()
    found = [plain_nearest(parts[:, p], books[p]) for p in range(4)]
    error = sum(f[1] for f in found)
    by_label = Counter()
    for r, e in zip(rows, error.tolist()):
        by_label[r[2]] += e
    codes = ["".join(f"{int(f[0][i]):02x}" for f in found) for i in range(len(v))]
    return Counter((r[0], c, e, by_label[r[2]]) for r, c, e in zip(rows, codes, error.tolist())), np.array(books)


@pytest.mark.parametrize("n", [900, 40])
def test_codes_equal_plain_rounds(spark, n):
    rng = np.random.default_rng(n)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(size=8)], None if i % 5 == 0 else int(i % 3)) for i in rng.permutation(n)]
    rows += [(None, rows[0][1], 1), (None, rows[1][1], None), rows[2], rows[2], (rows[3][0], rows[4][1], 2)]
    broken = [(5000, None, 1), (5001, [0.1] * 7 + [None], 1), (5002, [float("nan")] * 8, 1), (5003, [float("inf")] + [0.0] * 7, 1), (-9, [float("-inf")] * 8, None)]
    df = spark.createDataFrame(rows + broken, "vec_id bigint, embedding array<float>, label int").withColumns({"id": F.lit("own"), "code": F.lit("own"), "vector": F.lit("own")}).repartition(3)
    codes, books = vector_codes.compress(df, label_col="label")
    want, want_books = plain_codes(rows)
    assert Counter(map(tuple, vector_codes.with_label_errors(codes).select("id", "code", "error", "label_error").collect())) == want
    assert (books == want_books).all()


def test_codes_of_odd_vectors(spark):
    kind = "vec_id bigint, embedding array<float>, label int"
    assert vector_codes.with_label_errors(vector_codes.compress(spark.createDataFrame([], kind), label_col="label")[0]).count() == 0
    rows = [(1, [1e30] * 8, 1), (2, [-1e30] * 8, 1), (3, [], 1), (4, [1.0] * 5, None), (5, [1.0] * 5 + [0.0] * 3, None)]
    codes, books = vector_codes.compress(spark.createDataFrame(rows, kind), label_col="label")
    got = {r.id: r for r in codes.collect()}
    assert books.shape == (4, 5, 2) and len(got) == 5 and got[4].code == got[5].code and all(r.error == 0 for r in got.values())


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
URLS = [
    (1, "http://a.Example.ORG/es/5?x=1", "a.example.org", "/es/5", "example.org/es/", "block"), (2, "http://example.org", "example.org", "", None, None), (3, "https://notexample.org/es/1#t", "notexample.org", "/es/1", "org/", "allow"),
    (4, "x://org/a", "org", "/a", "org/", "allow"), (5, "http://borg/a", "borg", "/a", None, None), (6, "http://a.com/fr/", "a.com", "/fr/", "com/fr/", "allow"), (7, "http://a.com/FR/", "a.com", "/FR/", None, None), (8, None, "", "", None, None),
    (9, "no scheme.org/", "", "", None, None), (10, "http://ünï.org/ü\n://x", "ünï.org", "/ü\n://x", "org/", "allow"), (None, "http://b.com/de/1", "b.com", "/de/1", "com/de/", "block"), (11, "http://a.example.org/en/12", "a.example.org", "/en/12", "example.org/en/1", "block"),
    (1, "http://a.Example.ORG/es/5?x=1", "a.example.org", "/es/5", "example.org/es/", "block"), (12, "", "", "", None, None), (13, "http://" + "long/😀" * 60_000, "long", "/😀" + "long/😀" * 59_999, None, None),
]


@pytest.mark.parametrize("joined", [False, True])
def test_rules_fit_hosts_and_paths(spark, joined):
    df = spark.createDataFrame([u[:2] for u in URLS], "page_id bigint, url string").withColumns({"host": F.lit(1), "rule": F.lit(1), "verdict": F.lit(1), "w": F.lit(1)})
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string") if joined else RULES
    got = url_filter.judge(df, rules, keep=("page_id",)).collect()
    assert Counter((r.page_id, r.host, r.path, r.rule, r.verdict if r.rule else None) for r in got) == Counter((u[0], *u[2:]) for u in URLS)
    assert all(r.verdict in ("allow", "block") and (r.score is None) == (r.rule is not None) for r in got)


def test_urls_without_rules_or_rows(spark):
    df = spark.createDataFrame([u[:2] for u in URLS], "page_id bigint, url string")
    assert url_filter.judge(df.limit(0), RULES, keep=("page_id",)).count() == 0
    assert {r.verdict for r in url_filter.judge(df, []).collect()} == {"allow"}


def test_unknown_urls_go_the_way_of_those_they_resemble(spark):
    rng = np.random.default_rng(3)
    name = lambda parts: "".join(rng.choice(parts, 3))
    good, bad = ["lib", "uni", "news", "doc", "art"], ["casi", "pill", "xxx", "win", "bet"]
    rows = [(i, f"http://{name(bad if i % 2 else good)}.{'net' if i < 600 else 'bad' if i % 2 else 'good'}/{i}") for i in range(2400)]
    df = spark.createDataFrame(rows, "page_id bigint, url string")
    got = url_filter.judge(df, [("good", "/", "allow"), ("bad", "/", "block")], keep=("page_id",)).filter("rule is null").collect()
    assert len(got) == 600 and sum((r.verdict == "block") == bool(r.page_id % 2) for r in got) >= 585
