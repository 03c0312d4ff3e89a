"""An inverted-file index: vectors stored by cell, and searches that read the cells they need.

Cells are learned by k-means (directions only, as similarity is the cosine) on a sample of at most SAMPLE vectors, drawn by
a hash of their ids; every vector is then stored in its nearest cell's partition.  A cell's record says how
far, as an angle, its farthest vector is from the centre.

A search is exact by default.  Each query first reads its nearest cells; by the triangle inequality of angles, its k-th best
similarity then tells which other cells may hold a better one, and those are read in a second round.  With ``probes`` it
reads that many nearest cells and no more, which is quicker and may miss some; measure what (``recall``).  Queries go to the tasks
in blocks, each once; which of a block's queries want a cell is a mask of bits, so what is sent doesn't grow with the cells they want.

Defined results: null vectors, vectors without length and those of another width than the centres have similarity 0 to all
queries; they are stored in cell -1, which an exact search reads where a query has fewer than k better ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftfield.operators.vectors import BLOCK, asked_rows, best_of_pairs, block_groups, in_blocks, ranked, stacked, unit
from siftfield.sources.scratch import scratch_table

SAMPLE, MOST_CELLS, ROUNDS = 20_000, 4096, 10
#: Angles are compared with this much to spare.
SPARE = 1e-6


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each unit vector the centre most like it, and how like; by blocks of vectors."""
    at, likeness = np.zeros(len(x), np.int64), np.zeros(len(x))
    for i in range(0, len(x), BLOCK):
        near = x[i : i + BLOCK] @ centres.T
        at[i : i + BLOCK] = near.argmax(1)
        likeness[i : i + BLOCK] = near.max(1)
    return at, likeness


def centres_of(sample: np.ndarray, cells: int, seed: int = 0) -> np.ndarray:
    """Unit centres of at most ``cells`` cells (k-means by cosine); the first ones are drawn far apart."""
    x = unit(sample)
    x = x[(x * x).sum(1) > 0]
    if not len(x):
        return np.zeros((0, sample.shape[1]))
    rng = np.random.default_rng(seed)
    chosen, near = [int(rng.integers(len(x)))], np.full(len(x), -np.inf)
    while len(chosen) < min(cells, len(x)):
        near = np.maximum(near, x @ x[chosen[-1]])
        away = np.maximum(1 - near, 0)
        if away.sum() <= 1e-9:
            break
        chosen.append(int(rng.choice(len(x), p=away / away.sum())))
    centres = x[chosen]
    for _ in range(ROUNDS):
        at = nearest_centre(x, centres)[0]
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        moved = unit(sums)
        used = (moved * moved).sum(1) > 0
        centres = np.where(used[:, None], moved, centres)
    return centres


def build(vectors: DataFrame, path: str, id_col: str = "id", vector_col: str = "embedding", cells: int | None = None, sample: int = SAMPLE) -> None:
    """Store the index under ``path``: ``vectors``, partitioned by cell (large cells in several files), their ``kinds``, and
    ``cells`` (cell, n, reach, centre).  ``cells``: about the square root of the number of vectors where it isn't given."""
    spark = vectors.sparkSession
    n = vectors.count()
    cells = cells or min(MOST_CELLS, max(1, round(math.sqrt(n))))
    drawn = vectors.filter(F.col(vector_col).isNotNull()).orderBy(F.xxhash64(id_col), id_col).limit(sample).select(vector_col).toArrow()[vector_col].combine_chunks()
    widths = [len(v) for v in drawn.to_pylist()]
    width = max(set(widths), key=widths.count) if widths else 0
    learned = stacked(pa.array([v for v in drawn.to_pylist() if len(v) == width], drawn.type), width)
    shared = spark.sparkContext.broadcast(centres_of(learned, cells))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        for batch in batches:
            found = batch.column(1).to_pylist()
            fits = np.array([v is not None and len(v) == centres.shape[1] and None not in v for v in found], bool)
            x = unit(np.array([v for v, ok in zip(found, fits) if ok], np.float64).reshape(int(fits.sum()), -1))
            cell, angle = np.full(len(found), -1, np.int64), np.zeros(len(found))
            if len(centres) and len(x):
                at, near = nearest_centre(x, centres)
                real = (x * x).sum(1) > 0
                cell[fits] = np.where(real, at, -1)
                angle[fits] = np.where(real, np.arccos(np.clip(near, -1, 1)), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell), pa.array(angle)], names=[id_col, vector_col, "cell", "angle"])

    kinds = dict(vectors.dtypes)
    placed = vectors.select(id_col, vector_col).mapInArrow(place, f"{id_col} {kinds[id_col]}, {vector_col} {kinds[vector_col]}, cell long, angle double")
    placed.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/vectors")
    spark.createDataFrame([(f"{id_col} {kinds[id_col]}, {vector_col} {kinds[vector_col]}, angle double, cell long",)], "kinds string").write.json(f"{path}/kinds")
    facts = stored_vectors(spark, path).groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("reach"))
    names = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(shared.value)], "cell long, centre array<double>")
    facts.join(F.broadcast(names), "cell", "left").write.parquet(f"{path}/cells")


def stored_vectors(spark: SparkSession, path: str) -> DataFrame:
    """All vectors of an index with their cells; a filter on ``cell`` reads only those folders."""
    return spark.read.schema(spark.read.schema("kinds string").json(f"{path}/kinds").first()[0]).parquet(f"{path}/vectors")


def search(spark: SparkSession, path: str, queries: DataFrame, k: int | str, id_col: str = "id", vector_col: str = "embedding", query_id: str = "qid", probes: int | None = None, first: int = 4, digits: int | None = None) -> DataFrame:
    """qid, id, similarity, rank by cosine, ties by the smaller id; all of the k best without ``probes``.

    Query ids have to differ, as a query's finds from both rounds meet by id.
    """
    stored = stored_vectors(spark, path)
    kinds = dict(queries.dtypes)[query_id], dict(stored.dtypes)[id_col]
    rows = spark.read.parquet(f"{path}/cells").collect()  # a row for each cell: MOST_CELLS at most
    cells = [r for r in sorted(rows, key=lambda r: r.cell) if r.cell >= 0]
    centres = np.array([r.centre for r in cells], np.float64).reshape(len(cells), -1 if cells else 0)
    numbers, reach = np.array([r.cell for r in cells], np.int64), np.array([r.reach for r in cells])
    asked = asked_rows(queries, k, query_id, vector_col)

    def angles(x: np.ndarray) -> np.ndarray:
        """Of each query to each centre; null and odd queries are like all cells alike."""
        if x.shape[1] != centres.shape[1]:
            return np.zeros((len(x), len(centres)))
        x = unit(x)
        out = np.arccos(np.clip(x @ centres.T, -1, 1))
        out[(x * x).sum(1) == 0] = 0
        return out

    def nearest(apart: np.ndarray, n: int) -> np.ndarray:
        """Which of all cells are a query's n nearest."""
        out = np.zeros(apart.shape, bool)
        np.put_along_axis(out, np.argsort(apart, axis=1, kind="stable")[:, :n], True, axis=1)
        return out

    def found_in(blocks: DataFrame, choose) -> DataFrame:
        """The best of the cells that queries want; ``choose`` (angles, bounds): whether each query wants each cell, and cell -1."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, ids, raw, bounds in zip(*(c.to_pylist() for c in batch.columns)):
                    wanted, rest = choose(angles(np.frombuffer(raw).reshape(len(ids), -1 if raw else 0)), bounds)
                    masks = np.packbits(np.column_stack((wanted, rest)), axis=0)  # one column for each cell
                    at = np.flatnonzero(masks.any(0))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), block, np.int64)), pa.array(np.append(numbers, -1)[at]), pa.array([masks[:, i].tobytes() for i in at], pa.binary())], names=["q_block", "cell", "q_mask"])

        wants = scratch_table(blocks.select("q_block", "q_ids", "q_flat", "q_bounds").mapInArrow(run, "q_block long, cell long, q_mask binary"), "wanted")
        out = []
        for group in block_groups(blocks):
            some = wants.filter(F.col("q_block").isin(group))
            read = sorted(r[0] for r in some.select("cell").distinct().collect())
            v = in_blocks(stored.filter(F.col("cell").isin(read)).withColumn("k_", F.lit(0)), id_col, vector_col, "v", "cell")
            pairs = v.join(F.broadcast(some.withColumnRenamed("q_block", "of_block")), F.col("v_cell") == F.col("cell"))
            pairs = pairs.join(F.broadcast(blocks.filter(F.col("q_block").isin(group))), F.col("of_block") == F.col("q_block"))
            out.append(best_of_pairs(pairs, query_id, kinds[0], id_col, kinds[1], "cosine", digits))
        none = spark.createDataFrame([], f"{query_id} {kinds[0]}, k_ int, {id_col} {kinds[1]}, similarity double")
        return reduce(DataFrame.unionByName, out) if out else none

    def packed(rows: DataFrame, name: str) -> DataFrame:
        return scratch_table(in_blocks(rows.repartition(parts), query_id, vector_col, "q", bound="least_"), name)

    parts = max(1, -(-asked.count() // BLOCK))
    n = first if probes is None else probes
    blocks = packed(asked.withColumn("least_", F.lit(None).cast("double")), "queries")
    some = found_in(blocks, lambda apart, bounds: (nearest(apart, n), np.zeros(len(apart), bool)))
    if probes is not None:
        return ranked(some, query_id, id_col)
    some = scratch_table(some, "first-cells")
    found = ranked(some, query_id, id_col).groupBy(query_id).agg(F.count("*").alias("found_"), F.min("similarity").alias("least_"))
    bounds = asked.join(found, query_id, "left").select(query_id, vector_col, "k_", F.when(F.col("found_") >= F.col("k_"), F.col("least_")).alias("least_"))
    loose = 0.0 if digits is None else 10.0**-digits

    def others(apart: np.ndarray, bounds: list) -> tuple[np.ndarray, np.ndarray]:
        """Cells beyond the first ones that may hold something as similar as the k-th found (all where fewer were found)."""
        least = np.array([-1.0 if x is None else x - loose for x in bounds])
        odd = (apart == 0).all(1)  # similarity 0 to all
        may = np.where(odd[:, None], least[:, None] <= 0, apart - reach[None] <= np.arccos(np.clip(least, -1, 1))[:, None] + SPARE)
        return may & ~nearest(apart, first), least <= 0

    more = found_in(packed(bounds, "bounds"), others)
    return ranked(some.unionByName(more), query_id, id_col)


def recall(found: DataFrame, exact: DataFrame, query_id: str = "qid", id_col: str = "id") -> float:
    """The share of the exact finds that are among the others."""
    both = exact.select(query_id, id_col).join(found.select(query_id, id_col, F.lit(1).alias("hit")), [query_id, id_col], "left")
    return float(both.agg(F.count("hit") / F.greatest(F.count("*"), F.lit(1))).first()[0])
