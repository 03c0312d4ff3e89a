"""How relevant whole files are: evidence, rule ladders with reasons, reviews, statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftfield.functions.text import any_of, contains_any

PRIORITIES = ("HIGH", "MEDIUM", "LOW", "SKIP")
KNOWN_TYPES = ("Herbicida", "Fungicida", "Insecticida", "Desecante")


def chunk_evidence(chunks: DataFrame, key: str, crop: Sequence[str], dose: Sequence[str]) -> DataFrame:
    """key, tier, evidence: table rows naming the crop (complete, else an excerpt), text lines naming it
    with a dose, and other table rows with an amount."""
    text = F.col("text")
    named, is_row = contains_any(text, crop), F.col("type") == "table_row"
    has_dose = F.coalesce(any_of(F.lower(text).rlike(p) for p in dose), F.lit(False))
    value = lambda label: F.trim(F.regexp_extract(text, rf"(?is)^.*{label}:\s*([^\n|]+)", 1))  # noqa: E731  of the last such line
    complete = F.concat_ws(" ", F.concat_ws(" | ", value("cultivo"), value("dosis")), value("unidad"))
    rows = chunks.select(key, "type", "text", named.alias("named"), has_dose.alias("has_dose"), is_row.alias("is_row"), complete.alias("complete"), (value("dosis") != "").alias("whole"))
    tables = rows.filter("is_row and named and (whole or has_dose)").select(key, F.lit("table_crop").alias("tier"), F.when(F.col("whole"), F.col("complete")).otherwise(F.substring("text", 1, 150)).alias("evidence"))
    others = rows.filter("is_row and not named and has_dose").select(key, F.lit("table_other").alias("tier"), F.substring("text", 1, 100).alias("evidence"))
    lines = rows.filter("not is_row and named").select(key, F.explode(F.split("text", "\n")).alias("line"))
    line_dose = F.coalesce(any_of(F.lower(F.col("line")).rlike(p) for p in dose), F.lit(False))
    texts = lines.filter(line_dose).select(key, F.when(contains_any(F.col("line"), crop), "text_crop").otherwise("text_dose").alias("tier"), F.trim("line").alias("evidence"))
    return tables.unionByName(texts).unionByName(others)


def evidence_kind(tag: Column, crop: str, overlap: bool = False) -> Column:
    """direct or context, of a tag such as ``LENTEJA - …`` or ``CONTEXTO LENTEJA - …``.

    ``overlap``: tags of the context count as direct, as they hold the direct tag's text too.
    """
    direct, context = tag.contains(f"{crop} -"), tag.contains(f"CONTEXTO {crop}")
    return F.when(direct if overlap else direct & ~context, "direct").when(context, "context")


def priority(
    processed: Column, named: Column, table_rows: Column, direct: Column, context: Column, ingredient: Column, related: Column, product_type: Column, chunks: Column,
) -> tuple[Column, Column, Column]:
    """(priority, recommendation, reasons) by the first rule that holds."""
    known = ingredient.isNotNull() & (ingredient != "")
    tables, typed = table_rows > 0, product_type.isin(*KNOWN_TYPES)
    related_crops = F.size(related) > 0
    level = (
        F.when(processed, "SKIP")
        .when(named & tables & (direct > 0), "HIGH")
        .when(named & tables, "MEDIUM")
        .when(named & (direct + context > 0), F.when(direct > 0, "MEDIUM").otherwise("LOW"))
        .when(named, "LOW")
        .when(related_crops & known & typed, "MEDIUM")
        .when(related_crops, "LOW")
        .when(chunks < 5, "SKIP")
        .otherwise("LOW")
    )
    reasons = F.array_compact(F.array(
        F.when(processed, "already processed"),
        F.when(~processed & named, "crop named"),
        F.when(~processed & named & tables, F.concat(table_rows.cast("string"), F.lit(" table rows"))),
        F.when(~processed & named & ~tables, "no tables"),
        F.when(~processed & named & (direct > 0), F.concat(direct.cast("string"), F.lit(" direct doses"))),
        F.when(~processed & named & (direct == 0) & (context > 0), F.concat(context.cast("string"), F.lit(" doses in context"))),
        F.when(~processed & ~named & related_crops, F.concat(F.lit("related crops: "), F.array_join(related, ", "))),
        F.when(~processed & ~named & ~related_crops, "no crop named"),
        F.when(~processed & (named | related_crops) & known, F.concat(F.lit("ingredient "), ingredient)),
        F.when(~processed & ~named & related_crops & known & typed, F.concat(F.lit("type "), product_type)),
        F.when(~processed & ~named & ~related_crops & (chunks < 5), "little content"),
    ))
    advice = (
        F.when(processed, "processed before")
        .when(named & tables & (direct > 0), F.when(known, "process: doses for the crop, all known").otherwise("process: doses for the crop, ingredient to be checked"))
        .when(named & tables & (context > 0), F.when(known, "process: doses near the crop, ingredient known").otherwise("process: doses near the crop, ingredient to be checked"))
        .when(named & tables, "process: crop named, no doses for it")
        .when(named & (direct + context > 0), "process: doses for the crop, no tables")
        .when(named, "evaluate: crop named, little else")
        .when(related_crops & known & typed, "process if wanted: related crops, ingredient known")
        .when(related_crops & known, "evaluate by hand: related crops, type unknown")
        .when(related_crops, "evaluate by hand: related crops, ingredient unknown")
        .when(chunks < 5, "leave: nothing relevant")
        .otherwise("evaluate by hand: nothing named, whole document")
    )
    return level, advice, reasons


def evaluations(files: DataFrame, key: str, per_file: Sequence[DataFrame], counts: Sequence[str]) -> DataFrame:
    """One row per file: aggregates joined from the left, missing counts as 0."""
    out = files
    for part in per_file:
        out = out.join(part, key, "left")
    return out.fillna(0, list(counts))


def priority_counts(rated: DataFrame) -> DataFrame:
    """position, priority, n in fixed order, 0 where there is none."""
    order = rated.sparkSession.createDataFrame([(i, p) for i, p in enumerate(PRIORITIES)], "position int, priority string")
    return F.broadcast(order).join(rated.groupBy("priority").agg(F.count("*").alias("n")), "priority", "left").select("position", "priority", F.coalesce("n", F.lit(0)).alias("n"))


def first_rows(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    """The first n rows of each key, with ``rank_`` from 1.

    As only ranks up to n are asked for, every task drops what is beyond them before the shuffle and a key's rows meet
    as n per task (a group limit in the plan); ties are settled by ``order`` alone, so it should end with something unique.
    """
    return rows.withColumn("rank_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank_") <= n)


def evidence_counts(evidence: DataFrame, key: str, tag: str, order: str, text: str, samples: int = 3) -> DataFrame:
    """key, tag, n, samples (the first few, in order; null texts aren't listed; null keys and tags are groups of their own).

    Rows are counted with map-side partials, and of each group only its first few meet in a task.
    """
    counts = evidence.groupBy(key, tag).agg(F.count("*").alias("n"))
    few = first_rows(evidence.select(key, tag, F.col(order).alias("order_"), F.col(text).alias("text_")), [key, tag], ["order_", "text_"], samples)
    listed = F.array_compact(F.transform(F.sort_array(F.collect_list(F.struct("rank_", "text_"))), lambda x: x["text_"]))
    few = few.groupBy(F.col(key).alias("key_"), F.col(tag).alias("tag_")).agg(listed.alias("samples"))
    return counts.join(few, F.col(key).eqNullSafe(F.col("key_")) & F.col(tag).eqNullSafe(F.col("tag_")), "left").select(key, tag, "n", "samples")


def chunk_stats(chunks: DataFrame, group: str, score: str, flags: dict[str, Column]) -> DataFrame:
    s = F.col(score)
    return chunks.groupBy(group).agg(F.count("*").alias("n"), F.avg(s).alias("avg_score"), F.max(s).alias("max_score"), F.min(s).alias("min_score"), *(F.count_if(c).alias(n) for n, c in flags.items()))


def extraction_detail(chunks: DataFrame, key: str, names: str, weeds: str, has_dose: Column, score: str, id_col: str, top: int = 3) -> DataFrame:
    """key, names and weeds (distinct, sorted), dose_chunks, top (ids of the best chunks).

    Sets and counts are taken with map-side partials; the best chunks are ranked within parts of a key first.
    """
    unique = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    facts = chunks.groupBy(key).agg(unique(names).alias("names"), unique(weeds).alias("weeds"), F.count_if(has_dose).alias("dose_chunks"))
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score_"), "id_"))
    rows = chunks.select(key, F.col(score).alias("score_"), F.col(id_col).alias("id_")).withColumn("part_", F.pmod(F.xxhash64("id_"), F.lit(64)))
    best = rows.withColumn("r_", rank(key, "part_")).filter(F.col("r_") <= top).withColumn("r_", rank(key)).filter(F.col("r_") <= top)
    best = best.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("r_", "id_"))), lambda x: x["id_"]).alias("top"))
    on = F.col("f.key_").eqNullSafe(F.col("b.key_"))
    joined = facts.withColumnRenamed(key, "key_").alias("f").join(best.withColumnRenamed(key, "key_").alias("b"), on, "left")
    return joined.select(F.col("f.key_").alias(key), "names", "weeds", "dose_chunks", "top")


def approval_stats(decided: DataFrame, group: Sequence[str], approved: Column, is_table: Column) -> DataFrame:
    n, ok = F.count("*"), F.count_if(approved)
    return decided.groupBy(*group).agg(n.alias("n"), ok.alias("approved"), (n - ok).alias("rejected"), F.count_if(is_table).alias("tables"), F.count_if(is_table & approved).alias("tables_approved"), F.when(n > 0, F.round(100.0 * ok / n, 1)).alias("approval_pct"))


def reviewed(chunks: DataFrame, decisions: DataFrame, key: str, mode: str = "tables_only", is_table: Column | None = None) -> DataFrame:
    """Add ``decision``: the reviewer's, where there is one, else what the mode says (approve, reject,
    or text approved and tables left open)."""
    auto = {"approve": F.lit("approved"), "reject": F.lit("rejected"), "tables_only": F.when(is_table, "pending").otherwise("approved") if is_table is not None else F.lit("approved")}[mode]
    return chunks.join(decisions.select(key, F.col("decision").alias("own_")), key, "left").withColumn("decision", F.coalesce("own_", auto)).drop("own_")
