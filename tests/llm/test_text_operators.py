"""Operators that look at each text on its own."""

import math
import random
import re
import tracemalloc
from collections import Counter

import duckdb
import pytest

import tests.llm.helpers as h
from siftfield.llm import bpe, langid, license_scan, quality
from siftfield.llm.queries import QUERIES

public_tokenizers = pytest.importorskip("public_tokenizers")
WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
BOTH = [public_tokenizers.path(x) for x in quality.VOCABULARIES]


@pytest.fixture(scope="module")
def docs(small):
    return duckdb.sql(f"SELECT doc_id, text, lang FROM '{small}/documents.parquet'").fetchall()


def test_bpe_equals_the_library(spark, small, docs):
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(WORDS), bpe.Bpe(WORDS, cache=500)
    random.seed(1)
    letters = list("aAbBßéÉ'sStT́ \n\t\x1c\x85 ΑΣσİıǅ01²½٣中文ひ!?<|>{}") + ["<|endoftext|>", "<|startoftext|>", "'ll", "é", "ẛ̣", "😀", "힣", "the", "tion", " ", " ", "﻿"]
    texts = [t for _, t, _ in docs] + ["".join(random.choices(letters, k=random.randint(0, 40))) for _ in range(3000)] + ["abcdefgh" * 300, "a" * 201, "", " "]
    for text, ids in zip(texts, [x for i in range(0, len(texts), 97) for x in own.encode_all(texts[i : i + 97])]):
        want = lib.encode(text, add_special_tokens=False)
        assert ids.tolist() == want.ids
        assert own.decode(ids) == lib.decode(want.ids, skip_special_tokens=False)


def test_bpe_of_every_code_point():
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(WORDS), bpe.Bpe(WORDS)
    codes = [c for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    for form in ("{}", "a{}", "{}1b"):
        texts = [form.format(chr(c)) for c in codes]
        want = [x.ids for x in lib.encode_batch(texts, add_special_tokens=False)]
        got = own.encode_all(texts)
        assert [hex(c) for c, a, b in zip(codes, got, want) if a.tolist() != b] == []


def test_texts_beyond_a_block(spark):
    """Texts of more than a block (1 MB), with the same result as if they were cut by hand."""
    from tokenizers import Tokenizer

    random.seed(11)
    some = [" ".join(random.choices(["river", "Fluß", "été", "bridge42", "under the MIT license.", "#", "\n"], k=60)) for _ in range(40)]
    long = "\n".join(random.choices(some, k=7000))
    assert len(long.encode()) > 2_500_000
    rows = [(1, "first", "en"), (2, long, "en"), (3, "x" * 1_200_000, "en"), (4, "last under the mit license", "en")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r.doc_id: r for r in license_scan.report(license_scan.scan_licenses(df)).collect()}
    assert all((got[i].n_words, got[i].n_base, got[i].first_word, got[i].last_word, got[i].base_labels) == base_of(t) for i, t, _ in rows)
    lib = Tokenizer.from_file(WORDS)
    ids = {r.doc_id: r.n for r in bpe.encode_texts(df, WORDS).selectExpr("doc_id", "size(ids) AS n").collect()}
    assert ids == {i: len(lib.encode(t, add_special_tokens=False).ids) for i, t, _ in rows}
    judged = {r.doc_id: r for r in quality.verdicts(quality.judge(df, PIECES)).collect()}
    assert all((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == h.base_counts(t) for i, t, _ in rows for r in [judged[i]])


def test_bpe_query_and_edges(spark, small, docs):
    import hashlib

    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(WORDS)
    got = {r.doc_id: r for r in QUERIES["op10_bpe"](spark, small).collect()}
    for i, t, _ in docs:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    out = bpe.encode_texts(h.odd(spark), WORDS)
    rows = out.collect()
    assert len(rows) == len(h.ODD) and {r.kept for r in rows} == {"own"}
    assert [r.ids for r in rows if r.doc_id in (2, 3)] == [[], []]
    assert bpe.encode_texts(h.odd(spark).limit(0), WORDS).count() == 0


PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}


def base_of(text):
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", h.lower(text))
    found = [(i, label) for label, p in PHRASES.items() for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in found]
    return len(ws), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def test_license_scan(spark, small, docs):
    got = {r.doc_id: r for r in QUERIES["op2_license_scan"](spark, small).collect()}
    for i, t, _ in docs:
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_of(t)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    odd = license_scan.report(license_scan.scan_licenses(h.odd(spark))).collect()
    for r in odd:
        texts = [t for d, t in h.ODD if d == r.doc_id]
        assert any((r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_of(t) for t in texts)
    assert next(r.labels for r in odd if r.doc_id == 11) == "apache-2,cc-by-nc,mit"
    notice = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software; All rights reserved. Licensed under the GNU General Public License version 3"
    texts = [(1, notice), (2, "permission was free and granted to obtain software"), (3, "cc by cc by nc by nc cc by nc")]
    rows = {r.doc_id: r for r in license_scan.report(license_scan.scan_licenses(spark.createDataFrame(texts, "doc_id bigint, text string"))).collect()}
    assert rows[1].labels == "gpl,mit,reserved" and rows[1].base_labels == "" and rows[2].labels == "" and rows[3].n_base == 2
    assert license_scan.scan_licenses(h.odd(spark).limit(0)).count() == 0


def plain_finds(index, words):
    """Every template held against every start, without postings or counters."""
    out, passages = [], {}
    for t, ws in enumerate(index.words):
        rare = sorted(range(len(ws)), key=lambda p: (-index.idf[ws[p]], p))[: license_scan.RARE]
        base = t < len(index.templates) and index.templates[t].base
        for start in range(-len(ws), len(words) + 1):
            same = [0 <= start + p < len(words) and words[start + p] == w for p, w in enumerate(ws)]
            share = sum(index.idf[w] for w, x in zip(ws, same) if x) / index.weight[t]
            if base:
                out += [(index.templates[t].label, start, len(ws), 1.0, True)] if all(same) else []
            elif sum(same[p] for p in rare) >= min(2, len(ws)) and share >= license_scan.ENOUGH:
                if index.of[t] >= 0:
                    passages.setdefault(index.of[t], {}).setdefault(t, (start, share))
                elif all(any(words[i : i + len(k)] == k for i in range(max(0, start - license_scan.SLACK), min(len(words), start + len(ws) + license_scan.SLACK) - len(k) + 1)) for k in index.keys[t]):
                    out.append((index.templates[t].label, start, len(ws), round(share, 9), False))
    for k, own in passages.items():
        label, licence, _ = index.licences[k]
        share = sum(index.weight[t] * x for t, (_, x) in own.items()) / sum(index.idf[w] for w in licence)
        if share >= license_scan.WHOLE and all(p in b" " + b" ".join(words) + b" " for p in index.phrases[k]):
            low, high = max(0, min(s for s, _ in own.values())), min(len(words), max(s + len(index.words[t]) for t, (s, _) in own.items()))
            out.append((label, low, high - low, round(share, 9), False))
    return sorted(out, key=str)


def test_license_finds_equal_plain_ones():
    index = license_scan.Index([*license_scan.BASE, *license_scan.TEMPLATES], license_scan.whole_texts()[:3])
    rng = random.Random(5)
    told = [license_scan.words_of(x.words.encode()) for x in license_scan.TEMPLATES]
    whole = index.licences[0][1]
    texts = [[], [b"later"] * 40, [w if rng.random() > 0.1 else b"other" for w in whole], whole[7:] + whole]
    for _ in range(6):
        words = [w for ws in rng.sample(told, 5) for w in ([b"x"] * rng.randrange(3) + [w for w in ws if rng.random() > 0.04])]
        texts.append(words + [b"cc", b"by"] * 2 + [b"nc"])
    for words in texts:
        assert sorted(((f.label, f.start, f.n_words, round(f.share, 9), f.base) for f in index.scan(words)), key=str) == plain_finds(index, words)


@pytest.mark.parametrize("some", [[b"later"], [b"later", b"version", b"of", b"the"]])
def test_license_scan_of_a_text_of_one_posted_word(some):
    index = license_scan.Index([*license_scan.BASE, *license_scan.TEMPLATES], license_scan.whole_texts())
    assert b"later" in index.postings
    words = some * (10_000_000 // len(b" ".join(some) + b" "))
    tracemalloc.start()
    finds = index.scan(words)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert finds == [] and peak < 20 * 10_000_000


def test_planted_licences_are_found():
    """Whole texts with every twentieth word changed, one word in two hundred dropped, between other words."""
    index = license_scan.Index([*license_scan.BASE, *license_scan.TEMPLATES], license_scan.whole_texts())
    random.seed(5)
    prose = "the river was high after the rain and no person could use the bridge or any part of it".split()
    planted = []
    for label, words, _ in license_scan.whole_texts():
        for _ in range(3):
            edited = [f"x{k}".encode() if random.random() < 0.05 else w for k, w in enumerate(words) if random.random() > 0.005]
            planted.append((label, [w.encode() for w in random.choices(prose, k=200)] + edited + [w.encode() for w in random.choices(prose, k=50)]))
    hits = [label in {f.label for f in index.scan(words)} for label, words in planted]
    assert sum(hits) >= 0.9 * len(hits), sum(hits) / len(hits)
    assert not index.scan([w.encode() for w in random.choices(prose, k=5000)])
    two = [w for _, words, _ in license_scan.whole_texts()[:2] for w in words]  # one file, two licences
    assert {"mit", "isc"} <= {f.label for f in index.scan(two)}
    assert all(phrase in b" " + b" ".join(words) + b" " for (_, words, _), phrases in zip(index.licences, index.phrases) for phrase in phrases)


def test_quality_rules(spark, small, docs):
    got = {r.doc_id: r for r in QUERIES["op4_quality"](spark, small).collect()}
    good = 0
    for i, t, _ in docs:
        r, want = got[i], h.base_counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)
        good += r.kept == (not r.base_failed)
    assert good >= 0.99 * len(docs)  # prose stays


def test_quality_bands_and_edges(spark):
    random.seed(3)
    odd_letters = " ".join("".join(chr(random.randrange(0x12000, 0x12300)) for _ in range(6)) for _ in range(40))
    digits = " ".join(f"{random.getrandbits(64):016x}" for _ in range(40))
    same = "tick " * 3 + " ".join(f"tock{i}" for i in range(4))
    prose = "The river was high after the rain and the bridge had to be closed until the water went down again in the evening."
    rows = [(1, odd_letters, "en"), (2, digits, "en"), (3, prose, "en"), (4, prose, None), (5, odd_letters, None), (6, same, "en"), (7, None, "xx"), (8, "", None)]
    out = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), PIECES).collect()}
    assert not out[1].base_failed and not out[1].kept and out[1].byte_share > 0.5
    assert not out[2].kept and out[3].kept and out[4].kept and out[4].band == "latin" and out[5].band == "other"
    assert out[6].base_failed and out[7].n_words == 0 and out[8].base_failed
    odd = quality.judge(h.odd(spark), PIECES)
    for r in odd.collect():
        texts = [t for d, t in h.ODD if d == r.doc_id]
        assert any((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == h.base_counts(t) for t in texts)
    assert quality.judge(h.odd(spark).limit(0), PIECES).count() == 0
    blank = quality.measure([("\u00a0" * 3_000_000 + "x").encode(), b"a b"], quality.Vocabulary(BOTH))
    assert blank["n_words"].tolist() == [1, 2] and blank["n_tokens_2"].tolist()[1] == 2
    vocab = quality.Vocabulary(PIECES, most=3)  # a cache that is emptied all the time
    again = quality.measure([prose.encode(), b"", odd_letters.encode()], vocab)
    assert again["n_words"].tolist() == [len(prose.split()), 0, 40] and again["chars_per_token"][0] == out[3].chars_per_token


def plain_measures(text, encode, is_byte):
    """Characters per token, byte share, entropy and tokens, word by word of the definition."""
    words = [w.decode("utf-8") for w in text.encode().split()]
    ids = [i for w in words for i in encode(w)]
    n = max(len(ids), 1)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(ids).values())
    return sum(map(len, words)) / n, sum(map(is_byte, ids)) / n, entropy, len(ids)


def spoilt(text):
    """Letters lost by a wrong encoding: what a code page takes back to UTF-8 gets shorter by them."""
    for page in quality.CODE_PAGES if not text.isascii() else ():
        try:
            return max(text.count("\ufffd"), len(text) - len(text.encode(page).decode("utf-8")))
        except UnicodeError:
            pass
    return text.count("\ufffd")


def test_quality_verdicts_equal_plain_ones(spark, docs):
    import base64

    import sentencepiece
    import tiktoken

    pieces = sentencepiece.SentencePieceProcessor(model_file=BOTH[0])
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BOTH[1], "rb"))}
    pairs = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    tools = [
        ("", "pieces", pieces.encode, pieces.is_byte),
        ("_2", "bytes", lambda w: pairs.encode_ordinary(" " + w), lambda i: "\ufffd" in pairs.decode_single_token_bytes(i).decode("utf-8", "replace") and pairs.decode_single_token_bytes(i) != b"\xef\xbf\xbd"),
    ]
    random.seed(8)
    made = [" ".join("".join(random.choices(alphabet, k=random.randint(1, 9))) for _ in range(n)) for alphabet in ("abcdefgh", "αβγδε", "дом река", "漢字文語", "0123456789", "!?#*", "éüñ", "Ã©x") for n in (9, 30, 200)]
    rows = [*docs, *((-1 - i, t, g) for i, t in enumerate(made) for g in [random.choice(["en", "fr", "xx", None])]), (-100, "a\x00b " * 20, "en"), (-101, "x\u00a0" * 500 + " \u00a0\u00a0 x" * 30, None)]
    seen = set()
    for r in quality.verdicts(quality.judge(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), BOTH)).collect():
        _, text, lang = next(x for x in rows if x[0] == r.doc_id)
        name = lang if lang in quality.LANGUAGE_BANDS else quality.script(text.encode())
        good = r.band == name and 50 * spoilt(text) <= r.n_words
        for end, kind, encode, is_byte in tools:
            chars, share, entropy, n = plain_measures(text, encode, is_byte)
            assert [r["chars_per_token" + end], r["byte_share" + end], r["token_entropy" + end]] == pytest.approx([chars, share, entropy], abs=1e-9)
            band = quality.BANDS[kind][name]
            good &= band.chars_low <= chars <= band.chars_high and share <= band.bytes_high and entropy >= min(band.entropy_low, quality.SHORT * math.log2(max(n, 1)))
        assert r.kept == (good and not r.base_failed), (text[:50], r)
        seen.add((r.kept, r.band))
    assert {k for k, _ in seen} == {True, False} and len({b for _, b in seen}) >= 7


def test_language_of_held_out_texts(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op7_langid"](spark, sf).collect()
    truth = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{sf}/documents.parquet'").fetchall())
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (h.crc(r.doc_id, 5) == 0) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held) > 0


def plain_decision(model, text):
    """Family by the largest of its machines, then votes of all pairs within it, word by word of the definition."""
    grams = {}
    raw = b" " + text.encode().lower() + b" "
    for i in range(len(raw) - 1):
        two = (raw[i] * 257 + raw[i + 1]) % (1 << 32)
        keys = [(two * 0x9E3779B1 % (1 << 32)) >> 21]
        if i + 2 < len(raw):
            keys.append(((two * 65599 + raw[i + 2]) % (1 << 32) * 0x85EBCA6B % (1 << 32)) >> 21)
        for k in keys:
            grams[k] = grams.get(k, 0) + 1
    size = sum(grams.values()) ** 0.5
    margin = [sum((n**0.5) / size * float(model.weights[k, c]) for k, n in grams.items()) + float(model.weights[-1, c]) for c in range(model.weights.shape[1])]
    family = max(range(len(model.names)), key=lambda c: margin[c]) if len(model.names) > 1 else 0
    votes, sure = {}, {}
    own = model.families[model.names[family]]
    for i, a in enumerate(own):
        for b in own[i + 1 :]:
            p = 1 / (1 + 2.718281828459045 ** (-4 * max(-30, min(30, margin[model.pairs[a, b]]))))
            votes[a if p >= 0.5 else b] = votes.get(a if p >= 0.5 else b, 0) + 1
            sure[a], sure[b] = sure.get(a, 0) + p, sure.get(b, 0) + 1 - p
    return max(own, key=lambda x: (votes.get(x, 0), sure.get(x, 0)))


def test_language_by_plain_decision(spark, docs):
    from pyspark.sql import functions as F

    words = {"en": "the and house of with street", "de": "der und haus mit straße nicht", "nl": "het en huis van met straat", "sv": "och huset med gatan inte det", "fr": "les et maison avec rue dans", "es": "los y casa con calle en", "it": "gli e casa con via nella", "ru": "и дом на улице не все", "pl": "i dom na ulicy nie wszystko"}
    random.seed(6)
    say = lambda lang: " ".join(random.choices(words[lang].split(), k=12))
    rows = [(100 * k + i, say(lang), lang) for k, lang in enumerate(words) for i in range(30)]
    model = langid.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), F.col("doc_id"))
    assert len(model.families["germanic"]) == 4 and len(model.families["romance"]) == 3 and len(model.pairs) == 6 + 3 + 1
    asked = [(lang, say(lang)) for lang in words for _ in range(8)] + [(None, t) for _, t, _ in docs[:60]] + [(None, "x"), (None, "zzz qqq")]
    got, scores = model.predict([t.encode() for _, t in asked])
    assert got == [plain_decision(model, t) for _, t in asked] and all(0 <= x <= 1 for x in scores)
    assert sum(g == lang for g, (lang, _) in zip(got, asked) if lang) >= 0.95 * 72


def test_language_edges(spark):
    from pyspark.sql import functions as F

    rows = [(i, f"the cat and the dog {i} were in the house", "en") for i in range(9)] + [(20 + i, f"der hund und die katze {i} sind im haus", "de") for i in range(9)] + [(40 + i, f"собака и кошка {i} в доме", "ru") for i in range(9)]
    train = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.train(train, F.col("doc_id"))
    out = {(r.doc_id, r.text): r for r in langid.identify(h.odd(spark), model).collect()}
    assert len(out) == len({(d, t) for d, t in h.ODD}) and {r.kept for r in out.values()} == {"own"}
    assert out[2, None].lang_pred == "und" and out[3, ""].lang_pred == "und" and out[4, " \n\t "].score == 0
    asked = spark.createDataFrame([(1, "the house and the dog"), (2, "die katze und das haus"), (3, "кошка в доме"), (4, "1234 !?")], "doc_id bigint, text string")
    assert [r.lang_pred for r in langid.identify(asked, model).orderBy("doc_id").collect()] == ["en", "de", "ru", "und"]
    nothing = langid.train(train.limit(0), F.col("doc_id"))
    assert {r.lang_pred for r in langid.identify(asked, nothing).collect()} == {"und"}
    single = langid.train(train.filter("lang = 'en'"), F.col("doc_id"))
    assert {r.lang_pred for r in langid.identify(asked.filter("doc_id < 4"), single).collect()} == {"en"}


@pytest.mark.parametrize("paths", [PIECES, BOTH])
def test_quality_rejects_junk_and_keeps_prose(spark, paths):
    import base64

    random.seed(5)
    sf = "/root/testdata/sf0.01"
    prose = duckdb.sql(f"SELECT text, lang FROM '{sf}/documents.parquet' WHERE lang IN ('en', 'de', 'fr', 'es')").fetchall()
    letters, marks = "abcdefghijklmnopqrstuvwxyz", "!@#$%^&*()_+-=[]{};:,./?"
    some = lambda make, n=60: [" ".join(make() for _ in range(n)) for _ in range(20)]
    junk = [("base64", t, g) for t in some(lambda: base64.b64encode(random.randbytes(48)).decode()) for g in ("en", "de", "fr", "es", None)]
    junk += [("hex", t, g) for t in some(lambda: random.randbytes(8).hex()) for g in ("en", "de", "fr", "es", None)]
    junk += [("soup", t, g) for t in some(lambda: "".join(random.choices(marks, k=6))) for g in ("en", "de", "fr", "es", None)]
    junk += [("letters", t, g) for t in some(lambda: "".join(random.choices(letters, k=8)), 200) for g in ("en", "de", "fr", "es")]
    accented = [(t, g) for t, g in prose if g in ("de", "fr", "es") and 10 * sum(x > "\x7f" for x in t) > len(t.split()) > 30]
    junk += [(page, t.encode().decode(page), g) for t, g in accented[:60] for page in ("latin-1", "cp437")]
    junk += [("lost", t.encode("latin-1", "replace").decode("utf-8", "replace"), g) for t, g in accented[:60]]
    rows = [(i, "prose", t, g) for i, (t, g) in enumerate(prose)] + [(-1 - i, k, t, g) for i, (k, t, g) in enumerate(junk)]
    out = quality.judge(spark.createDataFrame(rows, "doc_id bigint, kind string, text string, lang string"), paths).filter("not base_failed").collect()
    kept = {k: [r.kept for r in out if r.kind == k] for k in {r.kind for r in out}}
    assert len(accented) >= 60 and set(kept) == {"prose", "base64", "hex", "soup", "letters", "latin-1", "cp437", "lost"}
    assert sum(kept.pop("prose")) >= 0.99 * sum(r.kind == "prose" for r in out)
    assert {k: sum(v) for k, v in kept.items()} == dict.fromkeys(kept, 0)
