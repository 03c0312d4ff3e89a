"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

Every source gets a target: its weight's part of all words, held to ``cap`` times what the source has,
the excess shared again by weight.  The documents of a source queue up in a shuffled order (by the MD5
of their id), and a document's virtual finish time is the number of words its source has sent by its
end, divided by the target; after its last document a source starts over, up to ``cap`` times.  All
sources' documents are then ranged by finish time, and the mix ends where it has as many words as
all the documents together.

Running totals are taken in levels, so no source and no time has to fit into one task: totals of
ranges first, then of short ranges, then rows within a range.  Only three rows reach the driver: the ranges in
which the mix ends, and the last document in them.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftfield.llm.common import WORD, written

WEIGHTS, CAP = (5, 2, 1), 3
#: Rows that a range should hold, and a number of sources that is sure to be small enough to broadcast.
RANGE_ROWS, FEW_SOURCES = 2048, 10_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(rows: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, rank (from 0, by code point, null last), source_size, target.

    Sources by growing cap / weight: those that come first are capped, as long as their cap is no more
    than their part of what is left; the others share the rest by weight.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    s = sizes.withColumn("rank", rank).withColumn("weight", weight.cast("long")).withColumn("limit", cap * F.col("source_size"))
    every, before = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), Window.orderBy(F.col("limit") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({"left": F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0)), "of": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))})
    s = s.withColumn("level", F.col("left") / F.col("of")).withColumn("capped", F.col("limit") <= F.col("weight") * F.col("level"))
    level = F.min_by(F.when(~F.col("capped"), F.col("level")), F.when(~F.col("capped"), F.col("limit") / F.col("weight"))).over(every)
    return s.select("source", "rank", "source_size", F.when(F.col("capped"), F.col("limit").cast("double")).otherwise(F.col("weight") * level).alias("target"))


def mix(sized: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Add source_size, target, copies (how often the mix holds the row) and taken to rows of doc_id, source, size.

    Rows are told apart by doc_id; where ids repeat, their order is that of source and size, and equal
    rows may swap results among themselves.  Null ids count as an id of their own, null sources as one
    source that comes last.  Rows without words are never taken; without any words nothing is.
    """
    rows = written(sized.select("doc_id", "source", F.coalesce(F.col("size"), F.lit(0)).cast("long").alias("size")), "mix-sizes")
    facts = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("total")).first()
    n, total = facts["n"], facts["total"]
    digits = max(1, ceil(log(max(n, 1) / RANGE_ROWS, 16))) if n > RANGE_ROWS else 1
    sources = written(source_targets(rows, weights, cap), "mix-sources")
    if sources.count() <= FEW_SOURCES:
        sources = F.broadcast(sources)
    s = sources.alias("s")
    rows = rows.alias("r").join(s, F.col("r.source").eqNullSafe(F.col("s.source"))).select("r.*", "rank", "source_size", "target")
    rows = rows.withColumn("key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    rows = rows.withColumn("part", F.substring("key", 1, digits))

    parts = rows.groupBy("rank", "part").agg(F.sum("size").alias("part_size"))
    earlier = Window.partitionBy("rank").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("rank", "part", F.coalesce(F.sum("part_size").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("rank", "part").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    queued = rows.withColumn("sent", F.sum("size").over(within)).join(parts, ["rank", "part"]).withColumn("sent", F.col("before") + F.col("sent")).drop("before", "part")
    queued = written(queued, "mix-queued")

    # the finish times of a document's copies, and the ranges they fall in
    finish = lambda e: (e * F.col("source_size") + F.col("sent")) / F.nullif(F.col("target"), F.lit(0.0))
    steps = max(64, ceil(n / RANGE_ROWS))
    step = lambda t: F.floor(F.least(t, F.lit(float(cap + 1))) * steps)
    real = queued.filter("size > 0 and target > 0")
    copies = real.select("rank", "key", "doc_id", "size", F.explode(F.transform(F.sequence(F.lit(0), F.lit(cap - 1)), finish)).alias("finish"))
    by_step = copies.groupBy(step(F.col("finish")).alias("step")).agg(F.sum("size").alias("words"))
    # wide steps first, then the steps of the one in which the mix ends, so that no window holds more than the root of their number
    wide = F.floor(F.col("step") / F.lit(ceil((cap + 2) * steps) ** 0.5)).cast("long")
    by_wide = by_step.groupBy(wide.alias("wide")).agg(F.sum("words").alias("words"))
    passing = lambda rows, by, sent: rows.withColumn("until", F.lit(sent) + F.sum("words").over(Window.orderBy(by))).filter(F.col("until") > total).agg(F.min_by(F.struct(by, (F.col("until") - F.col("words")).alias("before")), by).alias("at")).first()["at"]
    around = passing(by_wide, "wide", 0)
    ends = around and passing(by_step.filter(wide == around["wide"]), "step", around["before"])
    if ends is None:
        taken_copies = F.when((F.col("size") > 0) & (F.col("target") > 0), F.lit(cap)).otherwise(0)
    else:
        at = F.struct("finish", "rank", "key", F.coalesce("doc_id", F.lit(-(1 << 62))).alias("doc_id"))
        near = copies.filter(step(F.col("finish")) == ends["step"]).withColumn("at", at)
        near = near.withColumn("until", ends["before"] + F.sum("size").over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
        last = near.filter(F.col("until") <= total).agg(F.max("at").alias("at")).first()["at"]
        least = F.lit(-(1 << 62))  # where an id is null

        def done(t: Column) -> Column:
            before = step(t) < ends["step"]
            if last is None:
                return before
            place = {"finish": (t, "double"), "rank": (F.col("rank"), "int"), "key": (F.col("key"), "string"), "doc_id": (F.coalesce("doc_id", least), "long")}
            bound = F.struct(*(F.lit(last[k]).cast(kind).alias(k) for k, (_, kind) in place.items()))
            return before | ((step(t) == ends["step"]) & (F.struct(*(x.cast(kind).alias(k) for k, (x, kind) in place.items())) <= bound))

        times = [F.when((F.col("size") > 0) & (F.col("target") > 0) & done(finish(F.lit(e))), 1).otherwise(0) for e in range(cap)]
        taken_copies = sum(times[1:], times[0])
    out = queued.withColumn("copies", taken_copies.cast("int"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))



def mixed_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents of the mix, a row for each copy that it takes; all columns stay as they are."""
    names = docs.columns
    number = lambda *by: F.row_number().over(Window.partitionBy("doc_id").orderBy(*by))
    sized = docs.select("doc_id", "source", n_words(F.col(text_col)).alias("size"))
    copies = mix(sized).filter("copies > 0").withColumn("n", number("source", "size", "copies")).select(F.col("doc_id").alias("id_"), F.col("n").alias("n_"), "copies")
    own = docs.withColumn("n_", number("source", n_words(F.col(text_col)), text_col))
    out = own.alias("d").join(copies.alias("c"), F.col("d.doc_id").eqNullSafe(F.col("c.id_")) & (F.col("d.n_") == F.col("c.n_")))
    return out.select(*(F.col(f"d.`{c}`") for c in names), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_")).drop("copy_")
