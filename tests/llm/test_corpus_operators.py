"""Operators that compare or count over the whole corpus."""

import gc
import gzip
import hashlib
import io
import math
import tracemalloc
import weakref
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import tests.llm.helpers as h
from siftfield.llm import bpe, common, gru_lm, jaccard_join, minhash, mixing, suffix_dedup, warc
from siftfield.llm.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def docs(small):
    return duckdb.sql(f"SELECT doc_id, text FROM '{small}/documents.parquet'").fetchall()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(name, spark, small, tmp_path):
    QUERIES[name](spark, small).write.parquet(str(tmp_path / "out"))
    db = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    db.sql(f"CREATE TABLE want AS {ORACLE_SQL[name]}")
    db.sql(f"CREATE TABLE raw AS SELECT * FROM read_parquet('{tmp_path}/out/*.parquet')")
    columns = ", ".join(sorted(r[0] for r in db.sql("DESCRIBE want").fetchall()))
    for a, b in (("raw", "want"), ("want", "raw")):
        assert db.sql(f"SELECT {columns} FROM {a} EXCEPT ALL SELECT {columns} FROM {b}").fetchall() == []


def near_copies():
    base = " ".join(f"w{i}" for i in range(120)).split()
    rows = [(i, " ".join(base[:k] + [f"e{i}"] + base[k + 1 :])) for i, k in enumerate(range(0, 116, 4))]
    rows += [(100 + i, " ".join(base[: 100 + i])) for i in range(20)] + [(200, " ".join(base)), (201, " ".join(base).upper()), (202, None), (203, "")]
    return rows + [(300 + i, f"only two{i % 2}") for i in range(4)] + [(None, " ".join(base)), (7, " ".join(base[:40]))]


@pytest.mark.parametrize("hot, small_", [(4096, 400_000), (4, 0)])
def test_join_equals_all_pairs(spark, hot, small_):
    rows = near_copies()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("node", F.lit("clash")).repartition(3)
    got = Counter(map(tuple, jaccard_join.similar_groups(df, hot=hot, small=small_).collect()))
    assert got == Counter((d, n, c) for (d, _), (n, c) in zip(rows, h.components(rows)))


def test_hot_shingles_cost_pairs_in_proportion(spark, monkeypatch):
    seen = []
    plain = jaccard_join.verified

    def counted(pairs, *rest):
        seen.append(pairs.count())
        return plain(pairs, *rest)

    monkeypatch.setattr(jaccard_join, "verified", counted)
    base = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join([*base[:k], f"e{i}", *base[k + 1 :]])) for i, k in enumerate(np.random.default_rng(3).integers(150, 390, 1200).tolist())]
    rows += [(5000 + i, " ".join([*base[:40], *(f"f{i}x{k}" for k in range(40))])) for i in range(60)]  # share its words, but not enough
    got = {r.doc_id: r.component_id for r in jaccard_join.similar_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), hot=100).collect()}
    assert got == {d: 0 if d < 5000 else d for d, _ in rows}  # any two of the first differ in six shingles of about 404
    assert sum(seen) < 5000


def test_parts_of_a_hot_shingle_meet(spark):
    rng = np.random.default_rng(4)
    rows = [(7, n, 100, g, k, 70, 30 + (g == 1) * 10) for k, (n, g) in enumerate(zip(range(100), [*[0] * 60, *rng.integers(1, 6, 40).tolist()]))]
    rows = [(t, node, n, g, 100, 0, 40) for t, node, n, g, *_ in rows]
    df = spark.createDataFrame(rows, "token bigint, node bigint, n bigint, group bigint, k bigint, main bigint, others bigint").withColumns({"place": F.lit(0).cast("long"), "before": F.lit(None).cast("binary"), "map": F.lit(None).cast("binary")})
    cells = {}
    for r in jaccard_join.across(df, 20).collect():
        cells.setdefault(r.cell, []).append((r.node, r.left, r.group))
    met = Counter(frozenset((a, b)) for x in cells.values() for a, la, ga in x for b, lb, gb in x if a < b and ga != gb and (la != lb or la < 0))
    group = {node: g for _, node, _, g, *_ in rows}
    assert set(met) == {frozenset((a, b)) for a in group for b in group if a < b and group[a] != group[b]} and set(met.values()) == {1}
    assert max(map(len, cells.values())) <= 45


def test_words_with_one_polynomial_hash_are_told_apart(spark):
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"{word} x y"), (2, f"{other} x y"), (3, f"{word} x y z"), (4, f"{'c' * 300} {'d' * 8}"), (5, f"{'c' * 301} {'d' * 8}")]
    got = {r.doc_id: r.component_id for r in jaccard_join.similar_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i: i for i in range(1, 6)}


def test_join_edges(spark):
    got = Counter(map(tuple, jaccard_join.similar_groups(h.odd(spark)).collect()))
    assert got == Counter((d, n, c) for (d, _), (n, c) in zip(h.ODD, h.components(h.ODD)))
    assert jaccard_join.similar_groups(h.odd(spark).limit(0)).count() == 0


def test_minhash_near_duplicates(spark):
    rows = near_copies()
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r.doc_id, r.n_shingles): r.component_id for r in minhash.near_duplicates(df).collect()}
    want = {(d, n): c for (d, _), (n, c) in zip(rows, h.components(rows, 5, 80))}
    assert got == want


def test_fingerprints(spark, small, docs):
    got = {r.doc_id: r for r in QUERIES["op8_fingerprint"](spark, small).collect()}
    edits = h.edited(docs)
    off = []
    for d, t in docs:
        assert (got[d].n_chars, got[d].edited_sha256) == (len(t), hashlib.sha256(edits[d].encode()).hexdigest())
        a, b = (h.shingles(x, 5) for x in (t, edits[d]))
        if len(a) > 50:
            off.append(abs(got[d].near_edited - len({tuple(x) for x in a} & b) / len(a | b)))
    assert np.mean(off) < 0.08
    same = minhash.fingerprint_with_edits(spark.createDataFrame([(i, "one two three four five six") for i in range(3000)], "doc_id bigint, text string")).select("doc_id", "fingerprint", "near_next").collect()
    assert len(same) == 3000 and len({r.fingerprint for r in same}) == 1 and {r.near_next for r in same} == {1.0}


def test_fingerprint_edges(spark):
    rows = h.ODD
    out = minhash.fingerprint_with_edits(h.odd(spark).select("doc_id", "text")).collect()
    assert Counter(r.doc_id for r in out) == Counter(d for d, _ in rows)
    ordered = sorted(((d if d is not None else 1 << 62, t or "") for d, t in rows))
    want = Counter(t[: len(t) - len(t) // 4] + n[: len(t) // 4] for (_, t), (_, n) in zip(ordered, ordered[1:] + ordered[:1]))
    assert Counter(r.edited for r in out) == want
    alone = minhash.fingerprint_with_edits(spark.createDataFrame([(1, "abcd efgh")], "doc_id bigint, text string")).first()
    assert alone.edited == "abcd efab" or alone.edited == "abcd ef" + "ab"
    assert minhash.fingerprint_with_edits(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


@pytest.mark.parametrize("bucket, small_, hot", [(20_000_000, 400_000, 20_000), (20_000, 0, 3), (20_000, 0, 0)])
def test_removal_equals_brute_force(spark, docs, bucket, small_, hot):
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.summary(suffix_dedup.remove_repeats(df, bucket_bytes=bucket, small=small_, hot=hot)).collect()}
    assert got == {d: x for (d, _), x in zip(docs, h.repeats(docs))}


def test_removal_edges(spark):
    passage = "ä passage of more than fifty bytes that stands in several documents of this test — ünd ends"
    rows = h.ODD + [(20, "before " + passage + " after"), (21, passage), (22, passage[3:] + passage), (23, "z" * 49), (24, "z" * 49), (25, "z" * 50), (26, "z" * 51), (27, "ab" * 300), (28, "ba" * 300), (None, passage), (29, passage[:60] * 3)]
    got = Counter(map(tuple, suffix_dedup.summary(suffix_dedup.remove_repeats(h.odd(spark, rows))).collect()))
    assert got == Counter((d, *x) for (d, _), x in zip(rows, h.repeats(rows)))
    kept = suffix_dedup.remove_repeats(h.odd(spark, rows), keep=("source", "n_chars"), as_text=True)
    assert kept.filter("doc_id = 1").first().rest.n_chars == len(h.ODD[0][1])
    assert suffix_dedup.remove_repeats(h.odd(spark).limit(0)).count() == 0


def test_groups_do_not_grow_with_a_shared_passage():
    rng = np.random.default_rng(9)
    line = b"a footer of more than fifty bytes that every document of the block ends with, in all its years"
    texts = [bytes(rng.integers(97, 123, 400, np.uint8)) + line + bytes(rng.integers(97, 123, 40, np.uint8)) for _ in range(300)]
    ords, flat = np.arange(300) + 1000, np.frombuffer(b"".join(texts), np.uint8)
    found = suffix_dedup.anchors(texts)
    asked, known = suffix_dedup.known_here(found, ords)
    short = lambda f: Counter((f["hash"] >> np.uint64(16)).tolist())
    assert max(short(found).values()) >= 300 and set(short(asked).values()) == {1} and set(short(known)) == {h for h, n in short(found).items() if n > 1}
    hashes, base = suffix_dedup.prefix_hashes(flat), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    hot = np.sort(np.array([h for h, n in short(found).items() if n > 2], np.uint64))
    runs = suffix_dedup.run_by_run(found, hot, hashes, base)
    assert runs["high"].sum() - runs["low"].sum() + len(runs["low"]) == found["high"].sum() - found["low"].sum() + len(found["low"])
    left = {k: v[~suffix_dedup.settled_here(runs, ords, flat, hashes, base)] for k, v in runs.items()}
    assert max(Counter(left["hash"].tolist()).values()) <= 2  # what a bucket hears of any run


def test_long_texts_are_cut_in_pieces(monkeypatch):
    rng = np.random.default_rng(5)
    texts = [bytes(rng.integers(97, 101, n, np.uint8)) for n in (0, 49, 50, 51, 997, 4000)]
    whole = suffix_dedup.anchors(texts)
    monkeypatch.setattr(suffix_dedup, "CUT", 300)
    cut = suffix_dedup.anchors(texts)
    runs = lambda f: {(d, r, p, int(x)) for d, p, x, a, b in zip(f["doc"], f["place"], f["hash"], f["low"], f["high"]) for r in range(a, b + 1)}
    assert runs(whole) == runs(cut) and len(runs(whole)) == sum(max(0, len(t) - 49) for t in texts)


def test_suffix_sort_sorts():
    rng = np.random.default_rng(6)
    raw = rng.integers(97, 99, 3000, np.uint8)
    places, segment = np.sort(rng.choice(2900, 500, replace=False)), np.sort(rng.integers(0, 9, 500))
    order = suffix_dedup.Suffixes(raw).sort(places, segment)
    text = raw.tobytes()
    got = [(s, text[p : p + 50]) for s, p in zip(segment[order], places[order])]
    assert got == sorted(got) and sorted(order.tolist()) == list(range(500))


def test_mix(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [None, "a", "b", "c", "big"][min(4, int(rng.integers(0, 9)))], int(rng.integers(0, 200))) for i in range(4000)] + [(9000, "one", 50_000), (9001, "zero", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, size bigint")
    want = h.mixed(rows)
    runs = [{r.doc_id: r for r in mixing.mix(df.repartition(k)).collect()} for k in (1, 7)]
    assert {k: tuple(v) for k, v in runs[0].items()} == {k: tuple(v) for k, v in runs[1].items()}
    for d, (source_size, target, taken) in want.items():
        r = runs[0][d]
        assert (r.source_size, r.taken) == (source_size, taken) and math.isclose(r.target, target, rel_tol=1e-9) and r.taken <= 3 * r.size


def test_mix_edges(spark):
    empty = spark.createDataFrame([], "doc_id bigint, source string, size bigint")
    assert mixing.mix(empty).count() == 0
    none = mixing.mix(spark.createDataFrame([(1, "a", 0), (2, None, None), (None, "a", 0)], empty.schema)).collect()
    assert len(none) == 3 and {r.taken for r in none} == {0}
    twice = mixing.mix(spark.createDataFrame([(1, "a", 5), (1, "a", 5), (None, None, 7)], empty.schema)).collect()
    assert len(twice) == 3 and sum(r.taken for r in twice) <= 17
    out = mixing.mixed_documents(h.odd(spark))
    assert out.columns == h.odd(spark).columns
    assert max(Counter((r.doc_id, r.text) for r in out.collect()).values()) <= 3 * 2  # the repeated row counts twice


def test_language_model(spark, small, docs):
    got = {r.doc_id: r for r in QUERIES["op9_gru_lm"](spark, small).collect()}
    tokens = {d: [*h.WORD.findall(h.lower(t)), None] for d, t in docs}
    c = Counter(x for d, ts in tokens.items() if h.crc(d, 10) for x in ts)
    n, v = sum(c.values()), len(c)
    for d, ts in tokens.items():
        r, base = got[d], sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in ts)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (h.crc(d, 10) == 0, len(ts), sum(c[x] > 0 for x in ts), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_language_model_edges(spark, monkeypatch):
    monkeypatch.setattr(gru_lm, "TABLE", 3)  # nearly all words go by the join
    docs = h.odd(spark).select("doc_id", F.lit(False).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    out = gru_lm.score_texts(docs, docs).collect()
    tokens = [[*h.WORD.findall(h.lower(t)), None] for _, t in h.ODD]
    c = Counter(x for ts in tokens for x in ts)
    n, v = sum(c.values()), len(c)
    want = sorted(round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in ts), 6) for ts in tokens)
    assert sorted(round(r.base_score, 6) for r in out) == want and all(r.n_known == r.n_tokens for r in out)
    untrained = gru_lm.score_texts(docs, docs.limit(0)).collect()
    assert {r.train_tokens for r in untrained} == {0} and all(r.base_score == pytest.approx(0) for r in untrained)
    assert gru_lm.score_texts(docs.limit(0), docs).count() == 0


def tiny_counts():
    return gru_lm.Counts(100, 8, 10, [b"a", b"b", b"c", b"d", b"e"], [20, 15, 10, 9, 8], np.empty(0, np.uint64), np.empty(0, np.int64), 0)


def test_network_probabilities_add_up():
    net = gru_lm.Network.start(tiny_counts())
    gru_lm.train_on(net, [np.array([0, 2, 3, 4, 5, 6])] * 5, gru_lm.Adam(net, 0.05))
    state = np.random.default_rng(0).uniform(-1, 1, (1, net.h)).astype(np.float32)
    total = sum(float(np.exp(net.log_p(state, np.array([k]))[0][0])) for k in range(net.m))
    assert total == pytest.approx(1, abs=1e-4)
    long, short = np.arange(5000) % 5, np.array([1, 2])
    together = gru_lm.score_docs(net, [long, short, np.empty(0, np.int64)])
    alone = [gru_lm.score_docs(net, [x])[0] for x in (long, short, np.empty(0, np.int64))]
    assert np.allclose(together, alone, rtol=1e-4)  # the state runs through a document and not into the next
    net.views["ww"][:] *= 1e3  # logits far beyond what exp bears are shifted
    assert np.isfinite(gru_lm.score_docs(net, [short])).all()


def test_gradients_equal_differences():
    words = 40  # several classes
    counts = gru_lm.Counts(3000, words + 2, 10, [b"%d" % i for i in range(words)], list(range(60, 60 - words, -1)), np.empty(0, np.uint64), np.empty(0, np.int64), 0)
    net = gru_lm.Network.start(counts, hidden=5, kind=np.float64)
    rng = np.random.default_rng(1)
    net.flat += rng.normal(0, 0.2, len(net.flat))
    docs = [rng.integers(0, net.m, n) for n in (3, 9, 0, 14)]
    x, y, _, fresh, real = next(gru_lm.windows(docs, 12, lanes=2))
    h = rng.uniform(-1, 1, (2, 5))

    def loss():
        states = net.states(x, fresh, h)
        return -net.log_p(states[real], y[real])[0].mean()

    grad = net.empty()
    rows, _ = net.gradients(x, y, fresh, real, h, grad)
    assert len(net.bounds) > 3 and set(rows) == set(x[real])
    for name, view in net.views.items():
        for at in rng.integers(0, view.size, 60):
            flat, kept = view.reshape(-1), view.reshape(-1)[at]
            if name == "x" and at // view.shape[1] not in rows:
                continue
            flat[at] = kept + 1e-5
            up = loss()
            flat[at] = kept - 1e-5
            down = loss()
            flat[at] = kept
            assert grad.views[name].reshape(-1)[at] == pytest.approx((up - down) / 2e-5, rel=1e-4, abs=1e-8)


def test_windows_hold_every_word_once():
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 9, n) for n in (0, 1, 50, 333, 7, 7)]
    for steps, full, cut, lanes in ((16, 0, 0, 4), (16, 64, 0, 4), (5, 0, 20, 3), (16, 0, 64, 512)):
        seen, starts = Counter(), 0
        for x, y, number, fresh, real in gru_lm.windows(docs, steps, full, cut, lanes):
            seen.update(zip(number[real].tolist(), x[real].tolist(), y[real].tolist()))
            starts += int(fresh[real].sum())
            assert x.shape[1] <= lanes
        want = Counter((d, a, b) for d, t in enumerate(docs) for a, b in zip([gru_lm.END, *t.tolist()], [*t.tolist(), gru_lm.END]))
        assert seen == want and starts == sum(-(-(len(t) + 1) // cut) if cut else 1 for t in docs)
    assert list(gru_lm.windows([], 4)) == []


def test_training_does_not_depend_on_files(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", F.lit(False).alias("held_out"))
    runs = [{r.doc_id: r.score for r in gru_lm.score_texts(d, d).collect()} for d in (docs.coalesce(1), docs.repartition(7))]
    assert runs[0].keys() == runs[1].keys() and all(runs[1][k] == pytest.approx(v, rel=1e-4) for k, v in runs[0].items())


def test_warm_start_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(gru_lm, "WARM_DOCS", 5)
    rows = [(k % 9, i, np.array([k % 9], np.int32).tobytes()) for i, k in enumerate(range(900))]
    drawn = gru_lm.warm_texts(spark.createDataFrame(rows, "text_key bigint, key bigint, ids binary")).collect()
    assert sorted(r.key for r in drawn) == [0, 1, 2, 3, 4] and {r.shard for r in drawn} == {0}


def test_archives(spark, tmp_path):
    rows = [(3, "http://a/3", "same"), (1, "http://a/1", "same"), (2, "http://b/2", None), (4, None, ""), (5, "http://b/5", "big" * 40000), (None, "http://n", "same"), (None, "http://m", "alone"), (1, "http://a/1", "same"), (6, "http://c\r\nX: y", "ünï")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("payload", F.lit("clash")).repartition(3)
    path = f"file://{tmp_path}/w"
    warc.write_archives(warc.as_records(pages), path)
    back = warc.read_archives(spark, path, verify=True)
    got = {(r.record_id, r.record_type, r.refers_to, r.payload_bytes) for r in back.collect()}
    assert got == {
        ("urn:page:1", "response", None, 4), ("urn:page:3", "revisit", "urn:page:1", 4), ("urn:page:null", "revisit", "urn:page:1", 4), ("urn:page:2", "response", None, 0),
        ("urn:page:4", "revisit", "urn:page:2", 0), ("urn:page:5", "response", None, 120000), ("urn:page:null", "response", None, 5), ("urn:page:6", "response", None, 5),
    }
    assert back.count() == len(rows)
    assert bytes(back.filter("record_id = 'urn:page:5'").first().payload) == b"big" * 40000
    wanted = back.filter(F.col("record_type") == "revisit").filter(F.col("target_uri").startswith("http://a"))
    assert [r.record_id for r in wanted.collect()] == ["urn:page:3"] and wanted.count() == 1
    big = warc.as_records(pages, min_bytes=5).filter("record_type = 'revisit'")
    assert big.count() == 0
    assert warc.as_records(pages.limit(0)).count() == 0


def test_unwanted_payloads_are_not_decoded(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/1", "x" * 3_000_000), (2, "http://a/2", "x" * 3_000_000), (3, "http://b/3", "small")], "page_id bigint, url string, html string").coalesce(1)
    warc.write_archives(warc.as_records(pages), f"file://{tmp_path}/w")
    own = b"".join(p.read_bytes() for p in sorted((tmp_path / "w").rglob("*.warc.gz")))
    heads = [f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:x:{kind}>\r\nContent-Length: {n}\r\n\r\n".encode() + b"y" * n + b"\r\n\r\n" for kind, n in (("resource", 5_000_000), ("revisit", 3))]
    for data, dropped in ((own, 0), (b"".join(map(gzip.compress, heads)), 5_000_000)):
        for chunk in (1 << 20, 700):
            seen, file = Counter(), io.BytesIO(data)
            file.read = (lambda read: lambda n: read(min(n, chunk)))(file.read)
            got = [names["warc-type"] for names, _ in warc.records(file, lambda names: names.get("warc-type") == "revisit", False, seen)]
            assert got == ["revisit"] and seen["kept"] < 20_000 and dropped <= seen["dropped"] + 8192 <= dropped + 16384
            seen = Counter()
            whole = [len(block) for _, block in warc.records(io.BytesIO(data), lambda names: True, True, seen)]
            assert max(whole) >= 3_000_000 and seen["kept"] > 3_000_000 and not seen["dropped"]


def test_bands_recall(spark, small, docs):
    rows = {(r.doc_id): r.component_id for r in QUERIES["near_documents"](spark, small).collect()}
    want = {d: c for (d, _), (_, c) in zip(docs, h.components(docs, 5, 80))}
    linked = [d for d, c in want.items() if d != c]
    assert linked and sum(rows[d] == want[d] for d in linked) >= 0.9 * len(linked)
    assert all(rows[d] == d for d, c in want.items() if list(want.values()).count(c) == 1)
    assert minhash.near_duplicates(h.odd(spark).limit(0)).count() == 0
    got = Counter((r.doc_id, r.n_shingles) for r in minhash.near_duplicates(h.odd(spark)).collect())
    assert got == Counter((d, n) for (d, _), (n, _) in zip(h.ODD, h.components(h.ODD, 5, 80)))


def test_fingerprints_are_plain_minima(docs):
    from siftfield.llm.common import mix64, word_hashes

    texts = [t for _, t in docs[:40]] + ["", "one", "one two three four five six"]
    signs = minhash.signatures([t.encode() for t in texts])
    a, b = (x.tolist() for x in minhash.functions())
    for t, row in zip(texts, signs):
        ws = h.WORD.findall(t)
        runs = [ws[i : i + 5] for i in range(len(ws) - 4)] if len(ws) >= 5 else [ws] if ws else []
        hashes = []
        for run in runs:
            total = 0
            for k, w in enumerate(run):
                total = int(mix64(np.array([(total + int(word_hashes([w.encode()])[0][0]) + k + 1) % (1 << 64)], np.uint64))[0])
            hashes.append(total)
        assert row.tolist() == [min((((x * m + p) % (1 << 64)) >> 32 for x in hashes), default=0xFFFFFFFF) for m, p in zip(a, b)]


def test_foreign_archives(spark, tmp_path):
    one = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:x:1>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    two = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x:2>\r\nWARC-Target-URI: http://z\r\nContent-Length: 70000\r\n\r\n" + b"y" * 70000 + b"\r\n\r\n"
    (tmp_path / "plain.warc").write_bytes(one + two + one)
    (tmp_path / "packed.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(two))
    rows = warc.read_archives(spark, str(tmp_path)).collect()
    assert Counter((r.record_id, r.payload_bytes) for r in rows) == Counter({("urn:x:1", 5): 3, ("urn:x:2", 70000): 2})
    assert warc.read_archives(spark, str(tmp_path), payload=False).filter("record_type = 'resource'").count() == 2


def test_parity_maps_never_overstate():
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 63, 9000, np.uint64)
    sets = [np.concatenate((base[: n - k], rng.integers(0, 1 << 63, k, np.uint64))) for n in (20, 500, 520, 1000, 1100, 4000, 4200, 9000) for k in (0, 5, 90) if k < n]
    maps = jaccard_join.ParityMaps([jaccard_join.parity(s).tobytes() for s in sets])
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    real = np.array([len(np.setxor1d(sets[i], sets[j])) for i, j in zip(a, b)])
    told = maps.differ(a, b)
    assert (told <= real).all() and (told[real == 0] == 0).all()
    near = (real > 0) & (real <= 100) & (np.minimum(maps.size[a], maps.size[b]) >= 16)
    assert told[near].sum() > 0.8 * real[near].sum()  # and says nearly all of a small difference


def test_vocabulary_follows_the_training_tokens(spark):
    texts = [" ".join(f"w{(k * 7 + i) % 6000}" for i in range(40)) for k in range(600)]
    train = spark.createDataFrame([(t,) for t in texts], "text string")
    counts, _ = gru_lm.gather_counts(train)
    c = Counter(x for t in texts for x in t.split())
    assert sum(counts.of_vocabulary) >= 0.8 * sum(c.values()) > sum(k for _, k in c.most_common(2000))
    assert [c[w.decode()] for w in counts.vocabulary] == counts.of_vocabulary == sorted(c.values(), reverse=True)[: len(counts.vocabulary)]
    assert counts.ends == len(texts)
    few, _ = gru_lm.gather_counts(spark.createDataFrame([(t,) for t in texts[:3]], "text string"))
    assert len(few.vocabulary) == few.v - 1 == len({x for t in texts[:3] for x in t.split()})  # small tables: all words


def test_texts_under_one_id_are_told_apart_whole(spark):
    """Null ids and one id with many texts: nothing of one text goes for another's sake, whatever short hashes say."""
    df = spark.range(200_000).select(F.concat(F.lit("text "), F.col("id"), F.lit(" of many "), F.repeat(F.md5(F.col("id").cast("string")), F.lit(3))).alias("text"))
    pair = df.select("text", F.hash(F.sha2("text", 256)).alias("h")).groupBy("h").agg(F.collect_list("text").alias("t")).filter("size(t) > 1").orderBy("h").limit(1).first().t
    rows = [(1, "prefix here. " + pair[0]), (None, pair[0]), (None, pair[1]), (9, pair[1] + " and so on " * 9), (9, pair[0] + "."), (2, "prefix here. " + "x" * 80)]
    made = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = Counter(tuple(r)[1:] for r in suffix_dedup.summary(suffix_dedup.remove_repeats(made)).collect())
    assert got == Counter(h.repeats(rows))


def test_many_null_ids_are_removed_like_others(spark):
    rng = np.random.default_rng(5)
    shared = ["".join(rng.choice(list("abcdefgh "), 70)) for _ in range(40)]
    rows = [(None if i % 3 else i, "".join(rng.choice(list("abcdefgh "), 40)) + shared[int(rng.integers(40))] + str(i)) for i in range(5000)]
    got = Counter(tuple(r)[1:] for r in suffix_dedup.summary(suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4))).collect())
    assert got == Counter(h.repeats(rows))


@pytest.mark.parametrize("small_", [400_000, 0])
def test_null_and_repeated_ids_cost_no_more_than_others(spark, monkeypatch, small_):
    """Pairs of near copies under null ids and under one id: texts are found by id and text, each once."""
    base = [" ".join(f"p{i}w{j}" for j in range(60)) for i in range(300)]
    rows = [(None if i % 2 else 7, base[i] + tail) for i in range(300) for tail in ("", " more")] + [(i, base[i] + " last") for i in range(0, 300, 3)]
    plain = jaccard_join.from_texts

    def counted(docs, wanted, *rest):
        met = docs.withColumn("text_key", F.xxhash64("text")).join(wanted, ["doc_id", "text_key"]).count()
        assert met == wanted.count()
        return plain(docs, wanted, *rest)

    monkeypatch.setattr(jaccard_join, "from_texts", counted)
    monkeypatch.setattr(minhash, "from_texts", counted)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    want = Counter((d, n, c) for (d, _), (n, c) in zip(rows, h.components(rows)))
    assert Counter(map(tuple, jaccard_join.similar_groups(df, small=small_).collect())) == want
    found = minhash.near_duplicates(df, width=3, percent=90, small=small_)
    assert Counter(map(tuple, found.collect())) == want


def test_removal_takes_little_memory_beside_its_texts():
    """Finding anchors and hashing a block takes a bounded number of arrays of the block's size."""
    rng = np.random.default_rng(12)
    texts = [bytes(rng.integers(97, 123, n, np.uint8)) for n in (1_900_000, *[5000] * 20)]
    common._powers.clear()
    tracemalloc.start()
    found = suffix_dedup.anchors(texts)
    hashes = common.prefix_hashes(np.frombuffer(b"".join(texts), np.uint8))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found["doc"]) > 100_000 and len(hashes) == 2_000_001
    assert peak < 75e6


def test_sorting_a_bucket_takes_little_memory():
    """Suffixes are sorted in slices; the plain result doesn't depend on their size."""
    rng = np.random.default_rng(13)
    n = 24_000
    unit = rng.integers(97, 123, (n // 2, 64)).astype(np.uint8)
    raw = np.concatenate([np.concatenate((x, x ^ np.array([1] + [0] * 63, np.uint8))) for x in unit])
    members = {"ord": np.arange(n), "hash": np.repeat(np.arange(n // 2), 2).astype(np.uint64), "low": np.zeros(n, np.int64), "extra": np.full(n, 14), "offset": np.full(n, 30), "start": np.arange(n) * 64}
    common._powers.clear()
    tracemalloc.start()
    got = suffix_dedup.earlier_runs(members, raw)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6
    want = suffix_dedup.earlier_runs(members, raw, slice_bytes=1 << 30)
    assert sorted(zip(*(x.tolist() for x in got))) == sorted(zip(*(x.tolist() for x in want))) and len(got[0]) == 14 * n // 2


def test_sums_and_orders_of_the_network_are_the_plain_ones():
    rng = np.random.default_rng(14)
    for most in (70, 200_000):
        x = rng.integers(0, most, 5000)
        x[:900] = 3
        order = gru_lm.by_value(x, most)
        assert (order == np.argsort(x, kind="stable")).all()
        rows = rng.normal(size=(len(x), 7))
        starts = np.flatnonzero(np.diff(x[order], prepend=-1))
        assert np.allclose(gru_lm.sums_of_runs(rows, order, starts), np.add.reduceat(rows[order], starts, axis=0))


def test_an_update_needs_no_memory_of_the_size_of_the_network():
    """Weights are updated in pieces, with the same result as all at once."""
    counts = gru_lm.Counts(400_000, 40_001, 10, [b"%d" % k for k in range(40_000)], [9] * 40_000, np.empty(0, np.uint64), np.empty(0, np.int64), 0)
    nets, rng = [gru_lm.Network.start(counts) for _ in range(2)], np.random.default_rng(15)
    grads, rows = [rng.normal(size=len(nets[0].flat)).astype(np.float32) for _ in range(2)], np.arange(0, 40_000, 7)
    for net, near in zip(nets, (gru_lm.NEAR, 1 << 30)):
        adam = gru_lm.Adam(net, 0.01)
        assert adam.room.nbytes < 1e6 or near != gru_lm.NEAR
        if near != gru_lm.NEAR:
            adam.room = np.empty_like(net.flat)
        for g in grads:
            adam.grad.flat[:] = g
            with pytest.MonkeyPatch.context() as m:
                m.setattr(gru_lm, "NEAR", near)
                adam.step(rows)
    assert (nets[0].flat == nets[1].flat).all()


def test_workers_forget_what_other_operators_remember():
    """A worker that has encoded texts doesn't hold the vocabulary and its words beside the tasks of the other stages."""
    words = bpe.loaded(public_tokenizers.path("word_bpe_49k.json"))
    words.encode("one two three")
    words = weakref.ref(words)
    common.powers(1 << 21)
    assert list(common.tidied(iter)(iter([1, 2]))) == [1, 2]
    gc.collect()
    assert words() is None and not bpe.loaded.cache_info().currsize and not common._powers


def test_powers_are_those_of_the_base():
    up, down = common.powers(3_000_000)
    assert len(up) == len(down) == 3_000_000 and int(up[2_999_999]) == pow(int(common.BASE), 2_999_999, 1 << 64)
    with np.errstate(over="ignore"):
        assert (up * down == 1).all() and (common.powers(70_000)[0] == up[:70_000]).all()
    common.powers(10)
    assert max(common._powers) <= common.KEPT_POWERS  # those of one huge text don't stay


def test_bands_and_maps_come_of_one_pass(spark, monkeypatch):
    """Sets are made once for all texts, and again for the pairs that are verified; no words are counted for bands."""
    rows = [(i, " ".join(f"p{i // 2}w{j}" for j in range(80)) + (" more" if i % 2 else "")) for i in range(40)] + [(99, None), (None, "")]
    df, calls, plain = spark.createDataFrame(rows, "doc_id bigint, text string"), [], jaccard_join.from_texts

    def called(docs, wanted, made, schema, small):
        calls.append(schema)
        return plain(docs, wanted, made, schema, small)

    for module in (jaccard_join, minhash):
        monkeypatch.setattr(module, "from_texts", called)
    monkeypatch.setattr(jaccard_join, "word_counts", lambda docs: calls.append("words") or np.zeros(jaccard_join.COUNTERS, np.int64))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df).collect()}
    assert got == {d: x for (d, _), x in zip(rows, h.components(rows, 5, 80))}
    assert calls and all("hashes" in x for x in calls)  # sets of pairs alone
    calls.clear()
    jaccard_join.similar_groups(df).count()
    assert calls[0] == "words" and all("hashes" in x for x in calls[1:])


def test_places_of_different_shingles_that_agree(monkeypatch):
    """Shingles in one place of the common order are sorted by hash, and repeats go."""
    monkeypatch.setattr(jaccard_join, "mix64", lambda x: x * np.uint64(0))
    words = [b"a b c a b c a b c d", b"", b"x", b"one two three four one two three"]
    sets = jaccard_join.shingle_sets(words, np.zeros(jaccard_join.COUNTERS, np.uint64), 3)
    assert [len(s) for s in sets] == [len(h.shingles(w.decode())) for w in words]
    assert all(len(np.unique(s)) == len(s) for s in sets)


@pytest.mark.parametrize("copies", [(), (0, 1)])
def test_large_sets_that_share_one_shingle_are_told_apart_by_maps(spark, monkeypatch, copies):
    """Sets of thousands of shingles are sent for pairs that may be similar alone, also where maps go folded with the entries."""
    rng, plain, sent = np.random.default_rng(21), jaccard_join.from_texts, set()
    texts = [[*"pqrst", *(f"w{k}" for k in rng.integers(0, 2000, 6000))] for _ in range(12)]
    texts += [[f"x{i}" if i % 60 == 30 else w for i, w in enumerate(texts[k])] for k in copies]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]

    def noted(docs, wanted, *rest):
        sent.update(r.doc_id for r in wanted.collect())
        return plain(docs, wanted, *rest)

    monkeypatch.setattr(jaccard_join, "from_texts", noted)
    got = {r.doc_id: r.component_id for r in jaccard_join.similar_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), width=5, percent=80).collect()}
    assert got == {i: c for (i, _), (_, c) in zip(rows, h.components(rows, 5, 80))} == {**{i: i for i in range(12)}, **{12 + k: k for k in copies}}
    assert sent == {i for k in copies for i in (k, 12 + k)}


def test_maps_of_entries_are_bounded_and_tell_no_more_than_whole_ones():
    rng = np.random.default_rng(22)
    sets = [rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (300, 5000, 5000, 40_000, 2_500_000)]
    whole = [jaccard_join.parity(s).tobytes() for s in sets]
    assert [8 * len(x) for x in whole] == jaccard_join.map_bits(np.array([len(s) for s in sets])).tolist() == [512, 4096, 4096, 32_768, 1 << 17]
    for entries in (1, 200, 1000):
        short = [jaccard_join.entry_map(x, len(s), entries) for x, s in zip(whole, sets)]
        assert all(8 * len(x) <= jaccard_join.MAP_FREE or len(x) * entries <= jaccard_join.MAP_SHARE * len(s) for x, s in zip(short, sets))
        assert (short == whole) == (entries == 1)
        a, b = np.array([0, 1, 1, 3]), np.array([1, 2, 3, 4])
        told, real = (jaccard_join.ParityMaps(x).differ(a, b) for x in (short, whole))
        assert (told <= real).all() and (real <= [len(sets[i]) + len(sets[j]) for i, j in zip(a, b)]).all()
