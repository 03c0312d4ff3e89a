"""Language identification in two steps: the family first, then its closely related languages.

Texts become counts of hashed byte pairs and triples (square roots, unit length).  Linear support
vector machines tell families apart, one against the rest; within a family, one machine for each pair
of its languages votes.  They are trained with numpy on a bounded sample of the labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftfield.llm.common import blocks, fraction, utf8

FEATURES = 2048
#: The sample has at most so many rows, dealt evenly to the languages, and so many of one language.
SAMPLE_ROWS, SAMPLE_LANGUAGE = 4000, 600
LETTER = regex.compile(r"\p{L}")
#: Families of common language codes; a language that isn't named here is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg mk sr hr bs sl",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk tt",
    "indo-aryan": "hi ur bn pa gu mr ne si",
    "dravidian": "ta te kn ml",
    "semitic": "ar he am mt",
    "austronesian": "id ms tl jv",
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def vectors(texts: list[bytes]) -> np.ndarray:
    """One row per text: square roots of n-gram counts over the whole text, with unit length."""
    out = np.zeros((len(texts), FEATURES), np.float32)
    for row, text in zip(out, texts):
        raw = np.frombuffer(b" " + text.lower() + b" ", np.uint8).astype(np.uint32)
        two = raw[:-1] * np.uint32(257) + raw[1:]
        three = two[:-1] * np.uint32(65599) + raw[2:]
        keys = np.concatenate((two * np.uint32(0x9E3779B1) >> np.uint32(21), three * np.uint32(0x85EBCA6B) >> np.uint32(21)))
        row += np.sqrt(np.bincount(keys, minlength=FEATURES))
    return out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-9)


def machine(x: np.ndarray, y: np.ndarray, cost: float = 20.0, steps: int = 150) -> np.ndarray:
    """Weights and bias of a linear SVM with squared hinge loss, y in {-1, 1}, classes weighed evenly.

    Accelerated gradient descent from zero with a fixed step: the same rows give the same machine.
    """
    x = np.hstack((x, np.ones((len(x), 1), np.float32)))
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y <= 0).sum(), 1)).astype(np.float32) * cost
    w = ahead = np.zeros(x.shape[1], np.float32)
    rate = 1.0 / (1.0 + 2 * float(share.sum()) * 2)
    for k in range(steps):
        slack = np.maximum(0, 1 - y * (x @ ahead))
        new = ahead - rate * (ahead - 2 * (x.T @ (share * y * slack)))
        w, ahead = new, new + k / (k + 3) * (new - w)
    return w


class Model:
    """All machines as the columns of one matrix."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        labels = np.array(langs)
        self.families: dict[str, list[str]] = {}
        for lang in sorted(set(langs)):
            self.families.setdefault(FAMILY.get(lang, lang), []).append(lang)
        self.names = sorted(self.families)
        family = np.array([FAMILY.get(lang, lang) for lang in langs])
        columns = [machine(x, np.where(family == f, 1, -1).astype(np.float32)) for f in self.names] if len(self.names) > 1 else []
        self.pairs: dict[tuple[str, str], int] = {}
        for f in self.names:
            for a, b in combinations(self.families[f], 2):
                own = (labels == a) | (labels == b)
                self.pairs[a, b] = len(columns)
                columns.append(machine(x[own], np.where(labels[own] == a, 1, -1).astype(np.float32)))
        self.weights = np.stack(columns, axis=1) if columns else np.zeros((FEATURES + 1, 0), np.float32)

    def predict(self, texts: list[bytes]) -> tuple[list[str], list[float]]:
        """A language and a score in [0, 1] for each text; ``und`` for one without a letter."""
        margins = vectors(texts) @ self.weights[:-1] + self.weights[-1]
        langs, scores = [], []
        for text, m in zip(texts, margins.astype(np.float64)):
            if not self.names or LETTER.search(text.decode("utf-8", "replace")) is None:
                langs.append("und")
                scores.append(0.0)
                continue
            sure = 1.0
            if len(self.names) > 1:
                odds = np.exp(4 * (m[: len(self.names)] - m[: len(self.names)].max()))
                best, sure = int(odds.argmax()), float(odds.max() / odds.sum())
            else:
                best = 0
            own = self.families[self.names[best]]
            votes = {lang: [0, 0.0] for lang in own}
            for a, b in combinations(own, 2):
                p = 1 / (1 + np.exp(-4 * np.clip(m[self.pairs[a, b]], -30, 30)))
                votes[a if p >= 0.5 else b][0] += 1
                votes[a][1] += p
                votes[b][1] += 1 - p
            lang = max(own, key=lambda x: (votes[x][0], votes[x][1]))
            langs.append(lang)
            scores.append(float(sure * (votes[lang][1] / (len(own) - 1) if len(own) > 1 else 1.0)))
        return langs, scores


def train(labelled: DataFrame, key: Column) -> Model:
    """Fit a model to rows of text and lang; null languages and texts are left out.

    The sample is drawn by a hash of ``key``: about evenly many rows of each language, ``SAMPLE_ROWS``
    at most.  Its rows are turned into vectors where they lie, and only those reach the driver.
    """
    rows = labelled.filter("lang is not null and text is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(SAMPLE_ROWS).collect()}
    if not counts:
        return Model(np.zeros((0, FEATURES), np.float32), [])
    each = max(1, min(SAMPLE_LANGUAGE, SAMPLE_ROWS // len(counts)))
    shares = F.create_map(*(F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, 2.0 * each / n + 20.0 / n))))
    drawn = rows.withColumn("draw", fraction(key, "language sample")).filter(F.col("draw") < F.coalesce(shares[F.col("lang")], F.lit(0.0)))
    drawn = drawn.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "text"))).filter(F.col("nth") <= each).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = vectors(utf8(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["lang", "x"])

    got = sorted((r["lang"], bytes(r["x"])) for r in drawn.mapInArrow(run, "lang string, x binary").collect())
    return Model(np.stack([np.frombuffer(x, np.float32) for _, x in got]), [lang for lang, _ in got])


def identify(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Add lang_pred and score to every row, from its whole text alone.

    A null text, or one without a letter, is ``und`` with score 0, as is every text if nothing was
    learned.  Other columns stay; columns of the two names are replaced.
    """
    df = df.drop("lang_pred", "score")
    kept, shared = df.columns, df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, text_col, 1_000_000):
                langs, scores = shared.value.predict(utf8(part.column(part.schema.get_field_index(text_col))))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*kept, "lang_pred", "score"])

    return df.mapInArrow(run, ", ".join([*(f"`{n}` {t}" for n, t in df.dtypes), "lang_pred string", "score double"]))
