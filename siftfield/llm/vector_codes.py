"""Product codes of vectors: each part of a vector is named by its nearest entry in a small codebook.

Nearest entries are found by slicing and intersecting bit masks.  For each dimension the codebook's coordinates
are sorted, and for each place in that order a mask says which entries stand before it.  A radius around
a vector's coordinate is a range of places, hence two masks and their difference; the differences of all dimensions,
intersected as 64-bit words, are the entries within the radius in every dimension.  The first radius is small
(about NEAR entries of the codebook itself are that close) and doubles where nothing is found; the best entry
found bounds the distance of the nearest one, so a second slice with that bound holds it for certain.
Distances of the candidates are summed a few dimensions at a time, and whatever exceeds the bound is left.

Rounds of learning are passes over the vectors: tasks add up their parts in numpy, an aggregate adds up the tasks,
and only the codebooks (ENTRIES for each part) are on the driver and in the tasks.

Components are ``floor(1024 * x)``, kept within +-2**27 (so no distance leaves 64 bits).  Defined results: vectors
that are null or hold a null or a non-finite component go; shorter ones are padded with zeros up to the longest,
rounded up to a multiple of PARTS; a codebook of fewer than ENTRIES vectors has as many entries as there are; of
equal ids the vectors are ordered by their components, null ids come last, repeated rows count and stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftfield.llm.common import spread, written

PARTS, ENTRIES, ROUNDS = 4, 256, 4
SCALE, MOST = 1024, 1 << 27
#: Vectors that are searched together; dimensions that are added to a distance at once.
BLOCK, SLICE = 2048, 4
#: Entries that the first radius is meant to hold.
NEAR = 8
#: Labels whose sums may go to every task.
SMALL = 100_000


def whole(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~odd, F.lit(False))


def components(column: pa.Array, dims: int) -> np.ndarray:
    """A batch's vectors (none null) as rows of ``dims`` integers, shorter ones padded with zeros."""
    sizes = np.diff(np.asarray(column.offsets)).astype(np.int64)
    values = np.floor(SCALE * np.asarray(column.flatten(), np.float64))
    values = np.clip(values, -MOST, MOST).astype(np.int64)
    if (sizes == dims).all():
        return values.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


class Slices:
    """One part's codebook (entries by dimensions), ready for searching."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        n, dims = entries.shape
        self.words = -(-n // 64)
        self.order = np.sort(entries, axis=0).T.copy()  # by dimension: coordinates in order
        bits = np.zeros((n, self.words), np.uint64)
        bits[np.arange(n), np.arange(n) // 64] = np.uint64(1) << (np.arange(n) % 64).astype(np.uint64)
        self.masks = np.zeros((dims, n + 1, self.words), np.uint64)  # by dimension and place: entries before it
        for j in range(dims):
            self.masks[j, 1:] = np.bitwise_or.accumulate(bits[np.argsort(entries[:, j], kind="stable")], axis=0)
        apart = np.abs(entries[:, None, :] - entries[None, :, :]).max(axis=2)
        self.radius = int(np.median(np.sort(apart, axis=1)[:, min(NEAR, n - 1)])) + 1

    def within(self, x: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row, entry), in order, whose coordinates differ by at most the row's radius in each dimension."""
        found = None
        for j, order in enumerate(self.order):
            low, high = np.searchsorted(order, x[:, j] - radius, "left"), np.searchsorted(order, x[:, j] + radius, "right")
            part = self.masks[j, high] ^ self.masks[j, low]
            found = part if found is None else found & part
        flags = np.unpackbits(found.astype("<u8").view(np.uint8), axis=1, bitorder="little")
        return np.nonzero(flags)

    def best(self, x: np.ndarray, rows: np.ndarray, entries: np.ndarray, bound: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the pairs, for each row among them: the row, its nearest entry (ties: the lower) and the squared distance.

        Pairs beyond a row's ``bound`` are left before their distance is complete; the nearest entry never is."""
        total = np.zeros(len(rows), np.int64)
        for j in range(0, x.shape[1], SLICE):
            apart = x[rows, j : j + SLICE] - self.entries[entries, j : j + SLICE]
            total += np.einsum("ij,ij->i", apart, apart)
            if bound is not None:
                ok = total <= bound[rows]
                rows, entries, total = rows[ok], entries[ok], total[ok]
        starts = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1]))) if len(rows) else np.zeros(0, np.int64)
        least = np.minimum.reduceat(total, starts) if len(rows) else total
        size = np.diff(np.concatenate((starts, [len(rows)])))
        hit = np.flatnonzero(total == np.repeat(least, size))  # entries ascend within a row: the first is the lowest
        first = hit[np.concatenate(([True], rows[hit][1:] != rows[hit][:-1]))] if len(hit) else hit
        return rows[first], entries[first], total[first]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of every row, and its squared distance."""
        n = len(x)
        entry, bound = np.zeros(n, np.int64), np.full(n, -1, np.int64)
        radius, left = self.radius, np.arange(n)
        while len(left):
            rows, entry[left[rows]], bound[left[rows]] = self.best(x[left], *self.within(x[left], np.full(len(left), radius)), None)
            left, radius = np.delete(left, rows), 2 * radius
            if radius > 4 * MOST and len(left):  # farther than any coordinate: whatever there is
                radius = 8 * MOST
        reach = np.sqrt(bound.astype(np.float64)).astype(np.int64) + 1
        # where the first radius covered the bound, the best found is the nearest already
        todo = np.flatnonzero(reach > self.radius)
        if len(todo):
            rows, best, least = self.best(x[todo], *self.within(x[todo], reach[todo]), bound[todo])
            entry[todo[rows]], bound[todo[rows]] = best, least
        return entry, bound


def batches_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, BLOCK):
        yield batch.slice(at, BLOCK)


def by_parts(x: np.ndarray, books: np.ndarray) -> list[np.ndarray]:
    width = books.shape[2]
    return [x[:, p * width : (p + 1) * width] for p in range(PARTS)]


def first_books(vectors: DataFrame, dims: int) -> np.ndarray:
    """Parts by entries by dimensions: of the ENTRIES smallest ids."""
    rows = vectors.orderBy(F.col("id").asc_nulls_last(), "vector").limit(ENTRIES).select("vector").toArrow()["vector"].combine_chunks()
    return components(rows, dims).reshape(len(rows), PARTS, dims // PARTS).transpose(1, 0, 2).copy()


def next_books(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: entries become the rounded-down means of the parts they are nearest to; unused ones stay."""
    parts, n, width = books.shape
    names = [f"s{i}" for i in range(width)]

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices, sums, counts = [Slices(b) for b in books], np.zeros((parts * n, width), np.int64), np.zeros(parts * n, np.int64)
        for whole_batch in batches:
            for batch in batches_of(whole_batch):
                for p, x in enumerate(by_parts(components(batch.column(0), parts * width), books)):
                    at = p * n + slices[p].nearest(x)[0]
                    order = np.argsort(at, kind="stable")
                    starts = np.flatnonzero(np.concatenate(([True], np.diff(at[order]) > 0)))
                    sums[at[order][starts]] += np.add.reduceat(x[order], starts, axis=0)
                    counts += np.bincount(at, minlength=parts * n)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used]), *(pa.array(sums[used, i]) for i in range(width))], ["at", "n", *names])

    added = vectors.select("vector").mapInArrow(add_up, "at long, n long, " + ", ".join(f"{c} long" for c in names))
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    out = books.reshape(parts * n, width).copy()
    for row in added.groupBy("at").agg(exact("n"), *map(exact, names)).collect():  # a row for each entry at most
        out[row.at] = [int(row[c]) // int(row.n) for c in names]
    return out.reshape(parts, n, width)


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = None) -> tuple[DataFrame, np.ndarray]:
    """id, label, code (two hex digits for each part) and error (squared distance, all parts) of every whole
    vector, and the codebooks (parts by entries by dimensions)."""
    label = F.col(label_col) if label_col else F.lit(None).cast("int")
    kept = vectors.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), F.col(vector_col).alias("vector")).filter(whole(F.col("vector")))
    longest = kept.agg(F.max(F.size("vector"))).first()[0]
    dims = PARTS * max(1, -(-(longest or 0) // PARTS))
    books = first_books(kept, dims)
    for _ in range(ROUNDS if longest is not None else 0):
        books = next_books(kept, books)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = [Slices(b) for b in books if len(b)]
        for whole_batch in batches:
            for batch in batches_of(whole_batch):
                x = by_parts(components(batch.column("vector"), dims), books)
                entries, errors = zip(*(s.nearest(v) for s, v in zip(slices, x)))
                codes = np.stack(entries, axis=1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array([bytes(c).hex() for c in codes], pa.string()), pa.array(sum(errors))], ["id", "label", "code", "error"])

    kind = kept.schema["label"].dataType.simpleString()
    return kept.mapInArrow(encode, f"id long, label {kind}, code string, error long"), books


def with_label_errors(codes: DataFrame) -> DataFrame:
    """Adds label_error, the errors of equal labels (null ones together) added up; null beyond 64 bits."""
    codes = written(codes, "vector-codes")
    sums = codes.groupBy(F.col("label").alias("_label")).agg(F.expr("try_sum(error)").alias("label_error"))
    small = sums.count() <= SMALL
    return (codes if small else spread(codes)).join(F.broadcast(sums) if small else sums, F.col("label").eqNullSafe(F.col("_label")), "left").drop("_label")
