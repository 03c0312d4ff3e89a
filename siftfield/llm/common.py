"""Small helpers that the operators share."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path for one run under ``spark.checkpoint.dir``, the folder all executors share.

    Where that setting is missing, a folder of the warehouse serves on one machine (a local master); on a
    cluster it might be local to each machine, so there it's an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir") + "/_shared"
    return f"{base.rstrip('/')}/{name}-{uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write a table to the shared folder and read it again."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out evenly before a join, so that the join gets an exchange of its own on both
    sides and the adaptive planner may split a hot key."""
    return df.hint("rebalance")


def text_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator on texts reads; null texts become empty."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def fraction(key: Column, name: str) -> Column:
    """A reproducible number in [0, 1) from a key."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(name), key), 11) / F.lit(float(1 << 53))).cast("double")


def blocks(batch: pa.RecordBatch, column: str, limit: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Cut an Arrow batch into runs of rows whose text takes about ``limit`` bytes, one row at least."""
    i = batch.schema.get_field_index(column)
    col = batch.column(i)
    if batch.num_rows == 0:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0)).astype(np.int64)
    start, total = 0, 0
    for k, n in enumerate(sizes):
        if k > start and total + n > limit:
            yield batch.slice(start, k - start)
            start, total = k, 0
        total += n
    yield batch.slice(start)


def utf8(column: pa.Array) -> list[bytes]:
    """Values of a string column as bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads the bits of 64-bit integers (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


#: An odd multiplier for polynomial hashes modulo 2**64, and its inverse.
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
UNBASE = np.uint64(pow(int(BASE), -1, 1 << 64))
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Powers are kept for the largest text so far, up to so many bytes.
KEPT_POWERS = 9 << 18
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n."""
    size = 1 << max(16, (n - 1).bit_length()) if n < 1 << 20 else -(-n // (1 << 18)) << 18
    held = max(_powers, default=0)
    if held < size or held > max(size, KEPT_POWERS):
        _powers.clear()
        held = size
        with np.errstate(over="ignore"):
            _powers[size] = np.full(size, BASE), np.full(size, UNBASE)
            for x in _powers[size]:
                x[0] = 1
                np.multiply.accumulate(x, out=x)
    up, down = _powers[held]
    return up[:n], down[:n]


def prefix_hashes(raw: np.ndarray) -> np.ndarray:
    """P[i]: the polynomial hash of the first i bytes, so that any substring's hash takes one subtraction."""
    out = np.zeros(len(raw) + 1, np.uint64)
    own = out[1:]  # in place: texts of some MB take eight times their size once
    own[:] = raw
    own += np.uint64(1)
    own *= powers(len(raw))[0]
    np.cumsum(own, out=own)
    return out


#: Longer words are hashed by xxh3, one by one.
LONG_WORD = 256


def word_hashes(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, end to end, and the bounds of each text's words.

    A word's bytes go through the mixer eight at a time, all words together; unlike a polynomial this has
    no algebra by which families of words meet.
    """
    joined = b"\n".join(texts) + b"\n" + bytes(8)
    joined = joined.lower() if lower else joined  # bytes: A to Z only
    raw = np.frombuffer(joined, np.uint8)[:-8]
    gap = np.concatenate(([True], BLANK[raw]))
    starts = np.flatnonzero(gap[:-1] & ~gap[1:])
    ends = np.flatnonzero(~gap[:-1] & gap[1:])
    ends = ends if len(ends) == len(starts) else ends[-len(starts) :]
    size = ends - starts
    eight = np.ndarray((len(joined) - 7,), "<u8", joined, strides=(1,))  # eight bytes from each place on
    found = mix64(size.astype(np.uint64) + np.uint64(0x243F6A8885A308D3))
    live, at = np.arange(len(starts)), 0
    while len(live) and at < LONG_WORD:
        left = size[live] - at
        whole = eight[starts[live] + at]
        part = whole & ((np.uint64(1) << (8 * np.minimum(left, 7)).astype(np.uint64)) - np.uint64(1))
        found[live] = mix64((found[live] ^ np.where(left >= 8, whole, part)) + np.uint64(0x9E3779B97F4A7C15))
        live, at = live[left > 8], at + 8
    for k in live.tolist():
        found[k] = xxhash.xxh3_64_intdigest(joined[starts[k] : ends[k]], int(size[k]))
    where = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)))
    return found, np.searchsorted(starts, where)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words within each text (a shorter text with words: of all its
    words), end to end and with repeats, and the bounds of each text's shingles."""
    n = np.diff(bounds)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    out = np.concatenate(([0], np.cumsum(count)))
    first = np.arange(out[-1]) - np.repeat(out[:-1], count) + np.repeat(bounds[:-1], count)
    total = np.zeros(len(first), np.uint64)
    left = np.repeat(np.minimum(n, width), count)
    for k in range(width):
        ok = k < left
        total = np.where(ok, mix64(total + words[np.where(ok, first + k, 0)] + np.uint64(k + 1)), total) if len(words) else total
    return total, out


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minima of all runs of ``width`` neighbours."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    rows = -(-len(x) // width)
    padded = np.full(rows * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    grid = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


#: What operators remember in a Python worker from task to task: functions that drop it.
REMEMBERED: list[Callable[[], object]] = [_powers.clear]


def trimmed() -> None:
    """Hand back to the system what this Python worker has freed."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library can't tell
        ctypes.CDLL(None).malloc_trim(0)


def released() -> None:
    """Hand back what earlier tasks of this Python worker have freed, or remember for others of their kind; else it
    stays with the worker, which Spark uses for all stages, and adds to what the next one needs."""
    for drop in REMEMBERED:
        drop()
    trimmed()


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, with memory handed back before and after each task."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        yield from run(batches)
        released()

    return whole


def modest_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Hand texts to Python in batches of some MB; a smaller setting of the session stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(name, str(rows))
