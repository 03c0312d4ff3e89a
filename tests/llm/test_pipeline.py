"""The corpus pipeline, stage by stage, against plain versions on the smallest table."""

import hashlib
from collections import Counter

import pytest

import tests.llm.helpers as h

corpus_pipeline = pytest.importorskip("corpus_pipeline")
public_tokenizers = pytest.importorskip("public_tokenizers")


def test_stages(spark, small):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    got = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, small), "test-stage")
        got[name] = docs.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    quality, join, suffix, mix, ids = (got[name] for name, _ in corpus_pipeline.STAGES)
    failed = {i for i, r in rows.items() if (b := h.base_counts(r.text))[0] < 10 or 100 * b[4] > 20 * b[0]}
    assert not failed & {r.doc_id for r in quality} and len(quality) >= 0.99 * (len(rows) - len(failed))
    pairs = [(r.doc_id, r.text) for r in quality]
    assert Counter(r.doc_id for r in join) == Counter({c for _, c in h.components(pairs, corpus_pipeline.WIDTH, corpus_pipeline.PERCENT)})
    assert (corpus_pipeline.WIDTH, corpus_pipeline.PERCENT) == (5, 80)
    pairs = [(r.doc_id, r.text) for r in join]
    want = {d: x for (d, _), x in zip(pairs, h.repeats(pairs))}
    for r in suffix:
        size, removed, _, digest = want[r.doc_id]
        assert r.n_chars == len(r.text) and (removed or hashlib.sha256(r.text.encode()).hexdigest() == digest)
    assert {d for d, x in want.items() if x[0] > x[1]} >= {r.doc_id for r in suffix} >= {d for d, x in want.items() if not x[1]}
    sizes = [(r.doc_id, r.source, len(h.WORD.findall(r.text))) for r in suffix]
    taken = h.mixed(sizes)
    copies = Counter(r.doc_id for r in mix)
    assert all(copies[d] * n == taken[d][2] for d, _, n in sizes)
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    text = {r.doc_id: r.text for r in suffix}
    assert Counter((r.doc_id, r.n_tokens) for r in ids) == Counter((r.doc_id, len(lib.encode(text[r.doc_id], add_special_tokens=False).ids)) for r in mix)


def test_run_survives_empty_and_odd_tables(spark, tmp_path):
    prose = "The river was high after the rain and the bridge had to be closed until the water went down again in the evening."
    rows = [*h.ODD, (20, prose), (None, prose), (21, prose + " " + prose[:40]), (22, "The council met on Tuesday and agreed that the old mill should be repaired before the winter, if the money could be found.")]
    h.odd(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} >= {20, 22} and all(r.n_tokens > 0 for r in out)
    assert len({r.ids_sha256 for r in out if r.doc_id is None}) == 1  # the text without an id; the copy of 20 without one went
    assert max(Counter(r.doc_id for r in out).values()) <= 3
    h.odd(spark).limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_near_copies_of_the_stage(spark):
    words = [f"w{i}" for i in range(200)]
    near = [*words[:60], "x", *words[61:]]  # five-word similarity 0.95; each further change takes off 0.05
    scattered = ["x" if i in (30, 90, 150) else w for i, w in enumerate(words)]
    block = [*words[:100], *[f"y{i}" for i in range(15)], *words[115:]]
    far = ["x" if i % 25 == 9 else w for i, w in enumerate(words)]
    texts = [(1, words), (2, near), (3, scattered), (4, block), (5, far)]
    rows = [(d, " ".join(t), "en", "a", 1) for d, t in texts]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    plain = [(d, t) for d, t, *_ in rows]
    assert {c for _, c in h.components(plain, 5, 80)} == {1, 5} and {c for _, c in h.components(plain)} == {1, 4, 5}
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == {1, 5}


def test_one_of_each_group_whatever_the_ids(spark):
    words = [f"w{i}" for i in range(100)]
    near = lambda k: " ".join([*words[:k], "x", *words[k + 1 :]])
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(None, near(10)), (None, near(50)), (None, " ".join(words)), (None, other), (3, other + " more"), (3, near(70) + " of another kind"), (4, None), (4, ""), (4, " "), (None, ""), (5, "one two"), (5, "one two")]
    rows = [(d, t, "en", "a", 1) for d, t in rows]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert sorted(t for d, t in out if t and t.strip() and d is None) == [] and Counter(d for d, t in out if not t or not t.strip()) == {4: 3, None: 1}
    assert sorted((d, t) for d, t in out if t and t.strip()) == sorted([(3, other + " more"), (3, near(70) + " of another kind"), (5, "one two")])
    nulls = spark.createDataFrame([r for r in rows if r[0] is None], docs.schema)
    out = [t for _, t, *_ in corpus_pipeline.near_duplicates(spark, nulls, "").collect()]
    assert len(out) == 3 and {other, ""} < set(out)


def test_near_copies_of_the_small_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = Counter(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, small).collect())
    assert got == Counter({c for _, c in h.components([(r.doc_id, r.text) for r in docs.collect()], 5, 80)})
