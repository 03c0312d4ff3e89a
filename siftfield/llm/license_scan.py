"""License scans with a positional index of rare words.

Templates are whole licence texts (the files in ``licences``, named by their SPDX ids), cut into passages of
PASSAGE words, and short notices.  Each passage and notice is posted under its RARE words with the
highest inverse document frequency, with the places at which they stand.  Of a text, the words that have
postings are looked up, those with the highest frequency rank first; each place of one is taken for the start that
the template would have there, and starts on which two of a template's rare words agree (or its only
one) are verified word for word.

A notice counts where words of ENOUGH of its weight stand in their places and its mandatory key phrases near
them.  A licence counts where passages of WHOLE of its weight stand in the text, and its key phrases anywhere.
Phrases that are templates of their own, with the whole phrase mandatory, make the base labels; each is looked
up by its rarest word at every place.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftfield.llm.common import blocks, utf8

#: Bytes that belong to words: digits, letters (capitals A to Z in lower case) and all but ASCII.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Template(NamedTuple):
    label: str
    words: str  #: telling words of the licence, in order
    keys: tuple[str, ...]  #: phrases that have to stand in the text near their places
    base: bool = False  #: the phrase itself is the evidence


#: Phrases and labels of the base.
BASE = [
    Template("mit", "under the mit license", ("under the mit license",), True),
    Template("apache-2", "apache license version 2", ("apache license version 2",), True),
    Template("cc-by-nc", "cc by nc", ("cc by nc",), True),
]
#: Common notices and opening lines of licences.
TEMPLATES = [
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("permission is hereby granted free of charge",)),
    Template("mit", "the software is provided as is without warranty of any kind express or implied", ("software is provided as is without warranty",)),
    Template("mit", "licensed under the terms of the mit license", ("mit license",)),
    Template("apache-2", "licensed under the apache license version 2 0", ("apache license version 2",)),
    Template("apache-2", "you may not use this file except in compliance with the license", ("except in compliance with the license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use in source and binary forms",)),
    Template("gpl", "licensed under the gnu general public license version", ("gnu general public license",)),
    Template("gpl", "under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license",)),
    Template("lgpl", "under the terms of the gnu lesser general public license", ("gnu lesser general public license",)),
    Template("agpl", "under the terms of the gnu affero general public license", ("gnu affero general public license",)),
    Template("mpl-2", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose", ("permission to use copy modify and",)),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    Template("cc-by-sa", "licensed under a creative commons attribution sharealike license", ("creative commons attribution sharealike",)),
    Template("cc-by-nc", "licensed under a creative commons attribution noncommercial license", ("creative commons attribution noncommercial",)),
    Template("cc0", "to the public domain under cc0 1 0 universal", ("public domain", "cc0")),
    Template("reserved", "all rights reserved", ("all rights reserved",)),
]
#: Of whole texts: the label, and the phrases that have to stand in a text. Names are those of the files.
WHOLE_TEXTS = {
    "MIT": ("mit", ("permission is hereby granted",)), "ISC": ("isc", ("permission to use copy modify",)), "BSD-3-Clause": ("bsd", ("redistribution and use in source and binary forms",)),
    "Apache-2.0": ("apache-2", ("terms and conditions for use reproduction and distribution",)), "MPL-2.0": ("mpl-2", ("mozilla public license",)), "CC0-1.0": ("cc0", ("cc0",)), "Artistic-1.0": ("artistic", ("artistic license",)),
    "GPL-2.0": ("gpl", ("gnu general public license",)), "GPL-3.0": ("gpl", ("gnu general public license",)), "LGPL-2.1": ("lgpl", ("lesser general public license",)), "LGPL-3.0": ("lgpl", ("lesser general public license",)), "GFDL-1.3": ("gfdl", ("gnu free documentation license",)),
}
#: Words of a passage, and rare words under which a template is posted; shares of weight that a template's start, and a
#: whole licence, needs; words by which a key phrase may stand off.
PASSAGE, RARE, ENOUGH, WHOLE, SLACK = 24, 5, 0.7, 0.5, 2


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


def whole_texts(folder: str = str(Path(__file__).parent / "licences")) -> list[tuple[str, list[bytes], tuple[str, ...]]]:
    """Label, words and key phrases of each whole licence text."""
    return [(label, words_of((Path(folder) / f"{name}.txt").read_bytes()), keys) for name, (label, keys) in WHOLE_TEXTS.items()]


class Find(NamedTuple):
    label: str
    start: int
    n_words: int
    share: float
    base: bool


def agreed(starts: list[np.ndarray], least: int) -> list[int]:
    """Starts that at least so many of the lists have (each list has one at most once), in order."""
    every = np.sort(np.concatenate(starts))
    ends = every[least - 1 :]
    return np.unique(ends[ends == every[: len(ends)]]).tolist()


class Index:
    """Word -> (template, place) for the rare words of each template; passages of whole licences are templates."""

    def __init__(self, templates: Sequence[Template], licences: Sequence[tuple[str, list[bytes], tuple[str, ...]]] = ()):
        self.templates, self.licences = list(templates), list(licences)
        self.words = [words_of(t.words.encode()) for t in templates]
        self.keys = [[words_of(k.encode()) for k in t.keys] for t in templates]
        self.of = [-1] * len(templates)  # the licence of each passage
        for k, (_, words, _) in enumerate(self.licences):
            cuts = [words[i : i + PASSAGE] for i in range(0, len(words), PASSAGE)]
            self.words += cuts
            self.of += [k] * len(cuts)
        df = Counter(w for ws in self.words for w in set(ws))
        self.idf = {w: math.log((1 + len(self.words)) / n) for w, n in df.items()}
        self.weight = [sum(self.idf[w] for w in ws) for ws in self.words]
        self.whole = [sum(x for x, of in zip(self.weight, self.of) if of == k) for k in range(len(self.licences))]
        self.phrases = [[b" " + b" ".join(words_of(p.encode())) + b" " for p in keys] for _, _, keys in self.licences]
        self.base: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.least: list[int] = []  # rare words that have to agree
        for t, ws in enumerate(self.words):
            places = sorted(range(len(ws)), key=lambda p: (-self.idf[ws[p]], p))
            if t < len(templates) and templates[t].base:
                self.base[ws[places[0]]].append((t, places[0]))
                self.least.append(0)
                continue
            for place in places[:RARE]:
                self.postings[ws[place]].append((t, place))
            self.least.append(min(2, len(places)))
        self.base, self.postings = dict(self.base), dict(self.postings)

    def scan(self, words: list[bytes]) -> list[Find]:
        """Verified finds, by place.

        Starts are gathered for one template at a time, and only where enough of its rare words stand in the text at all,
        so memory is in proportion to the text however many templates share a word.
        """
        postings, base, n = self.postings, self.base, len(words)
        at: dict[bytes, array] = {}
        for i, w in enumerate(words):
            if w in postings or w in base:
                at.setdefault(w, array("q")).append(i)
        found = []
        for w, places in at.items():
            for t, place in base.get(w, ()):
                ws = self.words[t]
                found += [Find(self.templates[t].label, i - place, len(ws), 1.0, True) for i in places if i >= place and words[i - place : i - place + len(ws)] == ws]
        told: dict[int, list[tuple[bytes, int]]] = defaultdict(list)
        for w in sorted(at, key=lambda w: (-self.idf[w], w)):
            for t, place in postings.get(w, ()):
                told[t].append((w, place))
        passages: dict[int, dict[int, tuple[int, float]]] = defaultdict(dict)
        for t, start in ((t, start) for t in sorted(told) if len(told[t]) >= self.least[t] for start in agreed([np.frombuffer(at[w], np.int64) - place for w, place in told[t]], self.least[t])):
            ws = self.words[t]
            there = words[max(start, 0) : max(start + len(ws), 0)]
            share = sum(self.idf[a] for a, b in zip(ws[max(-start, 0) :], there) if a == b) / self.weight[t]
            if share < ENOUGH:
                continue
            if self.of[t] >= 0:
                old = passages[self.of[t]].get(t)
                passages[self.of[t]][t] = min(old, (start, share)) if old else (start, share)
            elif all(self.near(words, key, start, len(ws)) for key in self.keys[t]):
                found.append(Find(self.templates[t].label, start, len(ws), share, False))
        text = b""
        for k, own in passages.items():
            share = sum(self.weight[t] * x for t, (_, x) in own.items()) / self.whole[k]
            if share >= WHOLE:
                text = text or b" " + b" ".join(words) + b" "
                if all(p in text for p in self.phrases[k]):
                    low, high = min(s for s, _ in own.values()), max(s + len(self.words[t]) for t, (s, _) in own.items())
                    found.append(Find(self.licences[k][0], max(low, 0), min(high, n) - max(low, 0), share, False))
        return sorted(found, key=lambda f: (f.start, f.label, f.n_words))

    def near(self, words: list[bytes], key: list[bytes], start: int, length: int) -> bool:
        """Whether a key phrase stands within the template's span, give or take a few words."""
        low, high = max(0, start - SLACK), min(len(words), start + length + SLACK)
        return any(words[i : i + len(key)] == key for i in range(low, high - len(key) + 1))


FIELDS = {
    "n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint", "base_labels": "array<string>",
    "labels": "array<string>", "score": "double", "finds": "array<struct<label:string,start:bigint,n_words:int,share:double,base:boolean>>",
}


def scan_licenses(df: DataFrame, text_col: str = "text", base: Sequence[Template] = tuple(BASE), templates: Sequence[Template] = tuple(TEMPLATES), licences: Sequence[tuple[str, list[bytes], tuple[str, ...]]] | None = None) -> DataFrame:
    """Add what every text says about its licence, with each find (label, start word, words, share).

    ``licences``: label, words and key phrases of whole texts; without them, those of the files.
    Words are runs of ASCII letters (A to Z in lower case), digits and other than ASCII characters.
    A null text counts as empty: no words, no finds, score 0.  Overlapping and repeated phrases all
    count.  Rows are independent; other columns stay, columns with a result's name are replaced.
    """
    df = df.drop(*(c for c in FIELDS if c != text_col))
    kept, held = df.columns, whole_texts() if licences is None else list(licences)
    finds_type = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("n_words", pa.int32()), ("share", pa.float64()), ("base", pa.bool_())]))
    types = [pa.int64()] * 4 + [pa.list_(pa.string())] * 2 + [pa.float64(), finds_type]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index([*base, *templates], held)
        for batch in batches:
            for part in blocks(batch, text_col, 1_000_000):
                rows = []
                for text in utf8(part.column(part.schema.get_field_index(text_col))):
                    words = words_of(text)
                    finds = index.scan(words)
                    own = [f.start for f in finds if f.base]
                    labels = [sorted({f.label for f in finds if f.base or not only}) for only in (True, False)]
                    rows.append((len(words), len(own), own[0] if own else None, own[-1] if own else None, *labels, max([0.0, *(f.share for f in finds)]), [f._asdict() for f in finds]))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*kept, *FIELDS])

    return df.mapInArrow(run, ", ".join([*(f"`{n}` {t}" for n, t in df.dtypes), *(f"`{n}` {t}" for n, t in FIELDS.items())]))


def report(scanned: DataFrame) -> DataFrame:
    return scanned.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), F.least("score", F.lit(1.0)).alias("score"))
