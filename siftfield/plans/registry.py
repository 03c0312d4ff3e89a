"""Every query over the driver's tables, by name, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; without SQL it's one that SQL can't express, which tests compare with brute force."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def dealt_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows are dealt to all cores, for work that takes long for its bytes: a small file is one task otherwise."""
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return table(spark, sf_dir, name).repartition(n)


from siftfield.plans import conversations, lines, records, search, store, texts  # noqa: E402, F401  they register their queries

FLAGSHIP = QUERIES["numbered_context"]
