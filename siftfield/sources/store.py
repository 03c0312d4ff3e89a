"""The chunk store (appended by collection, or in buckets with manifests) and the embedding cache (a log of deltas)."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote
from uuid import uuid4

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

#: Buckets of a new store.
BUCKETS = 64
#: Collections of a batch up to which the store is read by collection.
MOST_COLLECTIONS = 1000
#: New rows up to which the files' filters are asked.
FILTERED = 100_000
#: Rows of a file beyond which its chunks are numbered by ranges.
HOT_FILE = 1_000_000


def with_ids(chunks: DataFrame, file: str, order: Sequence[str], hot: int = HOT_FILE, parts: int = 64) -> DataFrame:
    """Add ``id``: ``chunk_{i}_{file}``, i from 0 in the file's order (nulls first; rows of a null file get a null id).

    Where a file has more than ``hot`` rows (by a count), such files are numbered in two levels: up to ``parts`` of a file's own keys,
    those with the least hashes, cut it into ranges, rows are numbered within a range, and what earlier ranges hold is added.
    Cuts are a function of the rows, so a task that runs again finds the same ones; equal keys fall into one range.
    """
    if (chunks.groupBy(file).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) <= hot:
        return chunks.withColumn("id", _chunk_id(F.row_number().over(Window.partitionBy(file).orderBy(*order)) - 1, file))
    keys = chunks.select(F.col(file).alias("file_"), F.struct(*order).alias("at_"))
    large = keys.groupBy("file_").agg(F.count("*").alias("n_")).filter(F.col("n_") > hot).select(F.col("file_").alias("large_"))
    asked = keys.join(large, F.col("file_").eqNullSafe(F.col("large_")), "left_semi").distinct()
    few = asked.withColumn("rank_", F.row_number().over(Window.partitionBy("file_").orderBy(F.xxhash64("at_"), "at_"))).filter(F.col("rank_") <= parts)
    cuts = few.groupBy("file_").agg(F.sort_array(F.collect_list("at_")).alias("cuts_"))

    def ranged(rows: DataFrame) -> DataFrame:
        at = F.struct(*order)
        met = rows.join(cuts, F.col(file).eqNullSafe(F.col("file_")), "left").drop("file_")
        return met.withColumn("range_", F.coalesce(F.size(F.filter("cuts_", lambda c: c <= at)), F.lit(0))).drop("cuts_")

    sizes = ranged(chunks.select(file, *(c for c in order if c != file))).groupBy(F.col(file).alias("file_"), F.col("range_").alias("of_")).agg(F.count("*").alias("n_"))
    earlier = F.sum("n_").over(Window.partitionBy("file_").orderBy("of_").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.withColumn("before_", F.coalesce(earlier, F.lit(0))).drop("n_")
    rows = ranged(chunks).withColumn("i_", F.row_number().over(Window.partitionBy(file, "range_").orderBy(*order)) - 1)
    rows = rows.join(sizes, F.col(file).eqNullSafe(F.col("file_")) & (F.col("range_") == F.col("of_")), "left")
    return rows.withColumn("id", _chunk_id(F.col("i_") + F.col("before_"), file)).select(*(c for c in chunks.columns if c != "id"), "id")


def _chunk_id(i: Column, file: str) -> Column:
    return F.concat(F.lit("chunk_"), i.cast("string"), F.lit("_"), F.col(file))


def unseen(chunks: DataFrame, stored: DataFrame, id_col: str = "id") -> DataFrame:
    return chunks.join(stored.select(id_col), id_col, "left_anti")


def append(chunks: DataFrame, path: str, filtered: int = FILTERED) -> None:
    """Append rows that the store (partitioned by collection) doesn't have yet; only the collections of the new
    rows are read (ids tell chunks apart within a collection), and for up to ``filtered`` new rows only files that may hold one of them."""
    spark = chunks.sparkSession
    try:
        stored = spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        stored = None
    new = chunks
    if stored is not None:
        names = [r[0] for r in chunks.select("collection").distinct().limit(MOST_COLLECTIONS + 1).collect()]
        if len(names) <= MOST_COLLECTIONS and None not in names:
            if chunks.select("id").limit(filtered + 1).count() <= filtered:
                stored = files_that_may_hold(chunks, stored, path)
            stored = stored.filter(F.col("collection").isin(names))
        new = chunks.join(stored.select("id", "collection"), ["id", "collection"], "left_anti")
    new.dropDuplicates(["id", "collection"]).write.mode("append").partitionBy("collection").parquet(path)


FILTERS = "file string, collection string, cells int, cell int, bits binary"
#: Ids that share a cell of a file's filter (32,768 bits, two for each id).
IDS_A_CELL = 2000


def files_that_may_hold(chunks: DataFrame, stored: DataFrame, path: str) -> DataFrame:
    """The rows of those files of the store whose filter has an id of the chunks.

    Each file has a Bloom filter of its ids, in cells, in the folder ``<path>-ids``. Files without one (written by the last batch,
    or by a writer that died before it made them) get it here, so no id is missed. Filters say yes to about one foreign id in seventy.
    """
    spark, beside = chunks.sparkSession, f"{path.rstrip('/')}-ids"
    read = lambda names: spark.read.option("basePath", path).schema(stored.schema).parquet(*names)
    try:
        held = {r[0] for r in spark.read.schema(FILTERS).parquet(beside).select("file").distinct().collect()}  # names, as the listing of the store has them
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        held = set()
    listed = stored.inputFiles()
    missing = [unquote(f) for f in listed if unquote(f) not in {unquote(h) for h in held}]
    if missing:
        rows = read(missing).select(F.col("_metadata.file_path").alias("file"), F.col("collection").cast("string").alias("collection"), F.xxhash64("id").alias("h_"))
        cells = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.col("n") / IDS_A_CELL, F.lit(1.0))))).cast("int").alias("cells")
        rows = rows.join(rows.groupBy("file").agg(F.count("*").alias("n")).select("file", cells), "file")
        bits = rows.select("file", "collection", "cells", _cell(F.col("cells")).alias("cell"), F.explode(F.array(*_bits())).alias("bit"))
        bits.groupBy("file", "collection", "cells", "cell").agg(F.bitmap_construct_agg("bit").alias("bits")).write.mode("append").parquet(beside)
    filters = spark.read.schema(FILTERS).parquet(beside)
    sizes = [r[0] for r in filters.select("cells").distinct().collect()]  # powers of two
    asked = chunks.select(F.col("collection").cast("string").alias("collection"), F.xxhash64("id").alias("h_"), F.explode(F.array(*(F.lit(n) for n in sizes)).cast("array<int>")).alias("cells"))
    asked = asked.withColumn("cell", _cell(F.col("cells")))
    has = lambda bit: F.getbit(F.conv(F.hex(F.substring(F.col("bits"), F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int"), bit.bitwiseAND(F.lit(7)).cast("int")) == 1
    one, two = _bits()
    names = [r[0] for r in asked.join(filters, ["collection", "cells", "cell"]).filter(has(one) & has(two)).select("file").distinct().collect()]
    return read([unquote(n) for n in names]) if names else stored.limit(0)


def _cell(cells: Column) -> Column:
    return F.pmod(F.col("h_"), cells).cast("int")


def _bits() -> tuple[Column, Column]:
    """Two places of a hash in a cell."""
    return tuple(F.shiftrightunsigned("h_", n).bitwiseAND(F.lit(32767)) for n in (20, 40))


def last_wins(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """One row per key, the one that comes last."""
    return rows.groupBy(F.col(key).alias("key_")).agg(F.max_by(F.struct(*rows.columns), order).alias("x_")).select("x_.*")


def upsert(new: DataFrame, path: str, key: str, buckets: int = BUCKETS, order: Column | None = None) -> int:
    """Put rows into a bucketed store, over those with equal keys, and return the version that has them.

    The store is ``data/version=v/bucket=b`` and, for each version, a manifest that names the version in which each
    bucket was written last.  Only buckets that new rows fall into are read and written again; files of the others
    keep their names, and readers of an older version lose nothing.  Among the new rows of a key the one that comes last by
    ``order`` counts (one of them where it isn't given); null keys are one key.

    A version's manifest is one file, which the file system lets one writer create; another writer that began from
    the same version gets an error and may start over.  Its files stay unread, as do those of a writer that dies.
    """
    spark = new.sparkSession
    last = newest(spark, path)
    held = manifest(spark, path, last)
    buckets = len(held) or buckets  # set when the store is made
    rows = new.withColumns({"bucket": F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"), "seq_": F.struct(F.lit(1).alias("round"), (order if order is not None else F.lit(0)).alias("at"))})
    touched = [r[0] for r in rows.select("bucket").distinct().collect()]  # a row for each bucket at most
    version = last + 1
    if held:
        old = stored_buckets(spark, path, {b: held[b] for b in touched}, new.schema)
        if old is not None:
            none = F.lit(None).cast(rows.schema["seq_"].dataType["at"].dataType)
            rows = rows.unionByName(old.select(*new.columns, "bucket", F.struct(F.lit(0).alias("round"), none.alias("at")).alias("seq_")))
    files = f"{path}/data/version={version}-{uuid4().hex[:8]}"
    last_wins(rows, key, F.col("seq_")).drop("seq_").hint("rebalance", "bucket").write.partitionBy("bucket").parquet(files)
    now = {b: None for b in range(buckets)} | held | {b: files.rsplit("/", 1)[1] for b in touched}
    _create(spark, f"{path}/manifest/version={version}/buckets.json", "".join(json.dumps({"bucket": b, "folder": f}) + "\n" for b, f in sorted(now.items())))
    return version


def stored(spark: SparkSession, path: str, schema: StructType, version: int | None = None) -> DataFrame:
    """The rows of a bucketed store, of its newest version or an older one."""
    found = stored_buckets(spark, path, manifest(spark, path, newest(spark, path) if version is None else version), schema)
    return spark.createDataFrame([], schema) if found is None else found.select(*schema.names)


def stored_buckets(spark: SparkSession, path: str, held: dict[int, str | None], schema: StructType) -> DataFrame | None:
    """Rows of some buckets, each from the folder that has it, with the column ``bucket``; None where none was written."""
    parts: dict[str, list[int]] = {}
    for b, folder in held.items():
        if folder is not None:
            parts.setdefault(folder, []).append(b)
    kinds = StructType([*schema.fields, StructField("bucket", IntegerType())])
    frames = [spark.read.schema(kinds).parquet(f"{path}/data/{folder}").filter(F.col("bucket").isin(own)) for folder, own in sorted(parts.items())]
    return reduce(DataFrame.unionByName, frames) if frames else None


def manifest(spark: SparkSession, path: str, version: int) -> dict[int, str | None]:
    """Bucket -> the folder under ``data`` that has it (None: nothing yet); empty for a store that isn't there."""
    return {r.bucket: r.folder for r in spark.read.schema("bucket int, folder string").json(f"{path}/manifest/version={version}").collect()} if version else {}


def newest(spark: SparkSession, path: str) -> int:
    """The highest version with a manifest; 0 where there's none."""
    return _last_version(spark, f"{path}/manifest", "json") or 0


def _create(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file that mustn't be there yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    try:
        out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, False)
    except Py4JJavaError as e:
        raise FileExistsError(f"another writer has made {path}") from e
    out.write(bytearray(text.encode()))
    out.close()


def collection_counts(store: DataFrame) -> DataFrame:
    return store.groupBy("collection").agg(F.count("*").alias("n"))


CACHE = "text_md5 string, embedding array<float>"


def save_cache(cache: DataFrame, path: str) -> None:
    """Add to the stored cache the keys that it doesn't have yet, as a delta of its own; only stored keys are read."""
    spark = cache.sparkSession
    last = _last_version(spark, path) or 0
    new = cache.select("text_md5", "embedding").dropDuplicates(["text_md5"])
    if last:
        new = new.join(load_cache(spark, path).select("text_md5"), "text_md5", "left_anti")
    new.write.mode("append").parquet(f"{path}/version={last + 1}/whole=0")  # a delta without rows may be there


def load_cache(spark: SparkSession, path: str) -> DataFrame:
    """The last whole version and the deltas after it; an empty cache where there's none.

    Deltas of writers that didn't see each other may have a key in common: the older one counts.
    """
    if not _last_version(spark, path):
        return spark.createDataFrame([], CACHE)
    rows = spark.read.schema(f"{CACHE}, version int, whole int").parquet(path)
    base = spark.read.schema("version int, whole int").parquet(path).filter("whole = 1").agg(F.max("version")).first()[0] or 0
    rows = rows.filter(F.col("version") >= base)
    return rows.groupBy("text_md5").agg(F.min_by("embedding", "version").alias("embedding"))


def compact_cache(spark: SparkSession, path: str) -> None:
    """Write the cache as one whole version, after which older deltas aren't read any more (nor deleted)."""
    last = _last_version(spark, path)
    if last:
        load_cache(spark, path).write.mode("append").parquet(f"{path}/version={last + 1}/whole=1")


def _last_version(spark: SparkSession, path: str, kind: str = "parquet") -> int | None:
    """The highest ``version=`` folder below a path that has rows."""
    try:
        return spark.read.schema("version int").format(kind).load(path).agg(F.max("version")).first()[0]
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def ingest_summary(runs: DataFrame, group: Sequence[str], ok: Column, error: Column, longest: int = 200) -> DataFrame:
    """total, ok, failed, success_pct (one decimal), error (the last by its text, cut) of ingestion runs."""
    total, good = F.count("*"), F.count_if(ok)
    return runs.groupBy(*group).agg(total.alias("total"), good.alias("ok"), (total - good).alias("failed"), F.round(100.0 * good / total, 1).alias("success_pct"), F.max(F.when(~ok, F.substring(error, 1, longest))).alias("error"))
