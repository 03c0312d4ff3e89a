"""Logs of model calls: what answered a request, and how the router does."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_success(requests: DataFrame, attempts: DataFrame, key: str, failure: str = "Servicio no disponible") -> DataFrame:
    """key, model, content, attempts: the successful attempt with the lowest priority, else a failure text."""
    ok = F.min_by(F.when(F.col("success"), F.struct("model", "content")), F.when(F.col("success"), F.col("priority")))
    best = attempts.groupBy(key).agg(ok.alias("x"), F.count("*").alias("attempts"))
    return requests.select(key).join(best, key, "left").select(key, "x.model", F.coalesce("x.content", F.lit(failure)).alias("content"), F.coalesce("attempts", F.lit(0)).alias("attempts"))


def router_stats(calls: DataFrame, primary: str) -> DataFrame:
    """One row: total, primary_ok, fallback_ok, failures, success_pct, fallback_pct, by_model, last_error.

    calls: model, success, error, ts, order (a unique tie-break for equal times).
    """
    ok = F.col("success")
    by_model = calls.groupBy("model").agg(F.count("*").alias("n"))
    models = by_model.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("model", "n")))).alias("by_model"))
    total, first, other = F.count("*"), F.count_if(ok & (F.col("model") == primary)), F.count_if(ok & (F.col("model") != primary))
    pct = lambda n: F.when(total > 0, F.round(100.0 * n / total, 1)).otherwise(0.0)
    row = calls.agg(
        total.alias("total"), first.alias("primary_ok"), other.alias("fallback_ok"), F.count_if(~ok).alias("failures"), pct(first + other).alias("success_pct"), pct(other).alias("fallback_pct"),
        F.max_by("error", F.when(F.col("error").isNotNull(), F.struct("ts", "order"))).alias("last_error"),
    )
    return row.join(models)
