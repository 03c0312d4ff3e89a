"""Tables of one run in the folder that all executors share."""

from __future__ import annotations

import re
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh path under ``spark.checkpoint.dir``; on a local master without it, under the warehouse.

    On a cluster a missing setting is an error, as any other folder may be local to each machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{name}-{uuid4().hex}"


def scratch_table(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to such a folder and read again: what comes after doesn't compute them twice."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Hand rows to Python in batches of about ``size`` bytes at most, however wide they are; a smaller setting of the session stays.

    It has to hold while a lazy plan runs, so it stays set."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(-?\d+)\s*([kmgt]?)b?", spark.conf.get(name).strip().lower()).groups()
    now = int(number) << 10 * " kmgt".index(unit or " ")
    if now <= 0 or now > size:
        spark.conf.set(name, str(size))
