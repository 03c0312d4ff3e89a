"""Plain versions of the operators, for small tables."""

import hashlib
import re
import zlib
from collections import Counter
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    (1, "The same words again and again, in one sentence that is long enough to be cut by fifty bytes."), (2, None), (3, ""), (4, " \n\t "), (None, "no id at all but some words to look at in here"),
    (5, "The same words again and again, in one sentence that is long enough to be cut by fifty bytes."), (6, "ünïcödé — 漢字 😀 word"), (7, "a"), (8, "a b"), (9, "x" * 5000), (9, "x" * 5000), (10, "one two three four " * 60),
    (11, "MIT License. Under the MIT License, cc by nc; Apache License, Version 2.0"),
]


def odd(spark, rows=ODD, kind="doc_id bigint, text string"):
    """Nulls, empty texts, one endless word, repeated rows, ties, and columns that clash with results."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, kind)
    return df.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long"), "kept": F.lit("own"), "score": F.lit("own"), "spans": F.lit(1), "node": F.lit(2)})


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, width=3):
    ws = WORD.findall(lower(text))
    return {tuple(ws[i : i + width]) for i in range(len(ws) - width + 1)} if len(ws) >= width else ({tuple(ws)} if ws else set())


def components(docs, width=3, percent=90):
    """Index -> (size, smallest id reached) by all pairs."""
    sets = [shingles(t, width) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(docs)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            root[find(j)] = find(i)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(len(sets[i]), least.get(find(i))) for i in range(len(docs))]


def repeats(docs, length=50):
    """For each row: size, removed bytes, spans, digest of the rest."""
    last = 1 << 63
    raw = [((d if d is not None else last), (t or "").encode()) for d, t in docs]
    first = {}
    for d, b in raw:
        for p in range(len(b) - length + 1):
            key = b[p : p + length]
            first[key] = min(d, first.get(key, d))
    out = []
    for d, b in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < d:
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def base_counts(text):
    text = text or ""
    ws = WORD.findall(text)
    seen = Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
    hit = set()
    for i in range(len(ws) - 4):
        if seen[tuple(ws[i : i + 5])] > 1:
            hit.update(range(i, i + 5))
    known, dup = set(), 0
    for x in text.split("\n"):
        if WORD.search(x):
            dup += x in known
            known.add(x)
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def mixed(rows, weights=(5, 2, 1), cap=3):
    """(doc_id, source, size) -> doc_id -> (source_size, target, taken), by resharing until none is above."""
    total = sum(s for _, _, s in rows)
    sizes = {}
    for _, source, size in rows:
        sizes[source] = sizes.get(source, 0) + size
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), total
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > cap * sizes[s]}
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = cap * sizes[s]
        left -= sum(cap * sizes[s] for s in over)
        free -= over
    copies = []
    for s in names:
        sent = 0
        for d, _, size in sorted((r for r in rows if r[1] == s), key=lambda r: (hashlib.md5(str(r[0]).encode()).hexdigest(), r[0], r[2])):
            sent += size
            if size and target[s]:
                copies += [((e * sizes[s] + sent) / target[s], names.index(s), hashlib.md5(str(d).encode()).hexdigest(), d, size) for e in range(cap)]
    taken, run = Counter(), 0
    for _, _, _, d, size in sorted(copies):
        if run + size > total:
            break
        run += size
        taken[d] += size
    return {d: (sizes[s], target[s], taken[d]) for d, s, _ in rows}


def crc(doc_id, mod):
    return zlib.crc32(str(doc_id).encode()) % mod


def edited(docs):
    """doc_id -> the text whose last quarter comes from the next document's beginning."""
    rows = sorted(docs)
    out = {}
    for (d, t), (_, n) in zip(rows, rows[1:] + rows[:1]):
        k = len(t) // 4
        out[d] = t[: len(t) - k] + n[:k]
    return out
