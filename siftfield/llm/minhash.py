"""Document fingerprints: MinHash over word shingles.

A text's shingles (runs of five words) are hashed to 64 bits, every universal function
``(a * x + b) >> 32`` (a odd, modulo 2**64) permutes them, and the smallest value of each is kept, all
in numpy over a block of texts.  Equal parts of two fingerprints estimate the Jaccard index of the
texts' shingle sets.  For near duplicates, bands of the signature are joined in Spark, and each pair of
texts that share one is verified on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftfield.llm.common import shingle_hashes, word_hashes
from siftfield.llm.jaccard_join import SMALL, from_texts, similar_groups  # noqa: F401  a test counts the calls of from_texts here too

PERMUTATIONS, WIDTH, SEED = 64, 5, 20
#: Texts in blocks of about so many bytes; rows of a range of ids, and ranges at most.
BLOCK, RANGE_ROWS, MOST_RANGES = 1_000_000, 1000, 8192


def functions(n: int = PERMUTATIONS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(seed)
    return random.integers(1 << 62, 1 << 63, n, np.uint64) | np.uint64(1), random.integers(0, 1 << 63, n, np.uint64)


def signatures(texts: list[bytes], n: int = PERMUTATIONS, width: int = WIDTH) -> np.ndarray:
    """One row of 32-bit minima per text; all ones for a text without words."""
    return minima(*shingle_hashes(*word_hashes(texts), width), n)


def minima(hashes: np.ndarray, bounds: np.ndarray, n: int = PERMUTATIONS) -> np.ndarray:
    """The smallest value of each function over each run of hashes."""
    out = np.full((len(bounds) - 1, n), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        starts, value = bounds[full], np.empty_like(hashes)
        for k, (a, b) in enumerate(zip(*functions(n))):
            np.multiply(hashes, a, out=value)
            np.add(value, b, out=value)
            np.right_shift(value, np.uint64(32), out=value)
            out[full, k] = np.minimum.reduceat(value, starts)
    return out


def hexed(signature: np.ndarray) -> list[str]:
    """Fingerprints as text: four hex digits (the low 16 bits) per permutation."""
    low = (signature & 0xFFFF).astype(">u2")
    return [x.tobytes().hex() for x in low]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal minima, row by row."""
    return ((a & 0xFFFF) == (b & 0xFFFF)).mean(axis=1)


def in_id_ranges(docs: DataFrame) -> DataFrame:
    """Rows with a range number ``part``, sorted by (doc_id, text) within each; each range also ends
    with the first rows of the next one (``head``), the last one with the first rows of all.

    Ranges come from the quantiles of the ids, one id lies in one range, and null ids make the last.
    Only the bounds and the smallest id of each range (``MOST_RANGES`` at most) reach the driver.
    """
    n = docs.count()
    parts = min(MOST_RANGES, n // RANGE_ROWS + 1)
    cuts = docs.select(F.col("doc_id").cast("double").alias("x")).approxQuantile("x", [i / parts for i in range(1, parts)], 0.1 / parts) if parts > 1 else []
    splits = [-float("inf"), *sorted({c for c in cuts}), float("inf")]
    splits = splits if len(splits) > 2 else [-float("inf"), 0.0, float("inf")]
    rows = Bucketizer(splits=splits, inputCol="id_", outputCol="part_", handleInvalid="keep").transform(docs.withColumn("id_", F.col("doc_id").cast("double")))
    rows = rows.select("doc_id", "text", F.coalesce(F.col("part_").cast("int"), F.lit(len(splits))).alias("part"))
    first = rows.groupBy("part").agg(F.min("doc_id").alias("least")).orderBy("part").collect()
    if not first:
        return rows.withColumn("head", F.lit(False))
    before = {x["part"]: y["part"] for x, y in zip(first, [first[-1], *first])}
    least = {x["part"]: x["least"] for x in first}
    heads = F.create_map(*(F.lit(v) for kv in before.items() for v in kv))
    ids = [x for x in least.values() if x is not None]
    is_least = F.col("doc_id").isin(ids) if ids else F.lit(False)
    if None in least.values():  # the range of null ids
        is_least = F.coalesce(is_least, F.lit(True))
    to = F.array_compact(F.array(F.struct(F.col("part"), F.lit(False).alias("head")), F.when(is_least, F.struct(heads[F.col("part")].alias("part"), F.lit(True).alias("head")))))
    rows = rows.select("doc_id", "text", F.explode(to).alias("to")).select("doc_id", "text", "to.part", "to.head")
    return rows.repartition("part").sortWithinPartitions("part", "head", F.col("doc_id").asc_nulls_last(), "text")


SCHEMA = "doc_id bigint, n_chars bigint, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edit, whose last quarter comes from the next document.

    ``docs``: doc_id, text (null: empty).  The next document is the one that follows by (doc_id, text),
    null ids last, after the last the first; a lone document is its own next one.  Rows stream through
    a task in blocks, with one row carried over, so ranges may be of any size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(rows: list[tuple], signs: np.ndarray) -> pa.RecordBatch:
            """All rows but the last; a row's next one follows it."""
            pairs = [(i, i + 1) for i in range(len(rows) - 1) if not rows[i][3] and rows[i][2] == rows[i + 1][2]]
            edited = []
            for i, j in pairs:
                k = len(rows[i][1]) // 4
                edited.append(rows[i][1][: len(rows[i][1]) - k] + rows[j][1][:k])
            own, after = signs[[i for i, _ in pairs]], signs[[j for _, j in pairs]]
            edits = signatures([x.encode() for x in edited])
            columns = [[rows[i][0] for i, _ in pairs], [len(rows[i][1]) for i, _ in pairs], edited, hexed(own), hexed(edits), likeness(own, edits), likeness(own, after)]
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[x.split(" ")[0] for x in SCHEMA.split(", ")])

        rows, signs, new, size = [], np.empty((0, PERMUTATIONS), np.uint32), [], 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                row = (row[0], row[1] or "", *row[2:])
                new.append(row)
                size += len(row[1])
                if size >= BLOCK:
                    rows, signs = rows + new, np.concatenate((signs, signatures([x[1].encode() for x in new])))
                    yield emit(rows, signs)
                    rows, signs, new, size = rows[-1:], signs[-1:], [], 0
        if new:
            yield emit(rows + new, np.concatenate((signs, signatures([x[1].encode() for x in new]))))

    return in_id_ranges(docs).mapInArrow(run, SCHEMA)


def band_hashes(sets: list[np.ndarray], bands: int) -> list[bytes]:
    """Of each set, a hash of each band of its signature, with the band's number in it, end to end."""
    bounds = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int64)
    signs, rows = minima(np.concatenate(sets) if sets else np.empty(0, np.uint64), bounds), PERMUTATIONS // bands
    return [np.array([xxhash.xxh3_64_intdigest(x[b * rows : (b + 1) * rows].tobytes(), b) for b in range(bands)], np.uint64).tobytes() for x in signs]


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = 80, bands: int = 16, small: int = SMALL) -> DataFrame:
    """doc_id, n_shingles, component_id: documents that share a band and whose sets are similar enough.

    With 16 bands of 4 values a pair at the bound of 0.8 is missed about twice in ten thousand; pairs
    are verified on their full sets. Null, empty and repeated rows count as in the n-gram join.
    """
    return similar_groups(df, id_col, text_col, width, percent, small=small, places=lambda sets: band_hashes(sets, bands))
