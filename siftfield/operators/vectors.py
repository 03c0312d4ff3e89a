"""Exact vector retrieval in batches, ranking, re-ranking, numbered contexts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftfield.functions.text import contains_any, fixed, joined, words
from siftfield.operators.lexicon import from_sources, mentions
from siftfield.sources.scratch import bounded_batches, scratch_table

#: Vectors and queries in a block; queries that may go to every task.
BLOCK, MOST_QUERIES = 1024, 10_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is null or has no length."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def l2_similarity(a: Column, b: Column) -> Column:
    """1 less the squared distance."""
    d = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return 1.0 - F.aggregate(d, F.lit(0.0), lambda s, x: s + x)


def or_zeros(embedding: Column, dim: int) -> Column:
    return F.coalesce(embedding, F.array_repeat(F.lit(0.0).cast("float"), dim))


def top_k(vectors: DataFrame, query: Sequence[float], k: int, id_col: str = "id", vector_col: str = "embedding", metric: str = "cosine") -> DataFrame:
    """id, similarity, rank of the k vectors closest to one query; ties by the larger id."""
    q = F.array(*(F.lit(float(x)) for x in query))
    score = cosine(F.col(vector_col), q) if metric == "cosine" else l2_similarity(F.col(vector_col), q)
    top = vectors.select(id_col, score.alias("similarity")).orderBy(F.desc("similarity"), F.desc(id_col)).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("similarity"), F.desc(id_col))))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; rows without length stay zero."""
    size = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def stacked(column: pa.Array, width: int) -> np.ndarray:
    """Vectors of one width as rows of doubles; null is zeros."""
    return np.array([v if v is not None else [0.0] * width for v in column.to_pylist()], np.float64).reshape(len(column), width)


def in_blocks(rows: DataFrame, id_col: str, vector_col: str, name: str, cell: str | None = None, bound: str | None = None) -> DataFrame:
    """Rows of up to BLOCK vectors of one width: a number, ids and limits as arrays, the vectors as one binary of doubles
    (null: zeros); with ``cell``, of one cell each; with ``bound``, that column as another array.  Numbers come from the task
    and the block's place in it, so none comes twice."""
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = np.asarray(pc.fill_null(pc.list_value_length(batch.column(1)), -1))
            widths, cells = np.where(sizes < 0, sizes.max(), sizes).clip(0), np.asarray(batch.column(3))
            order = np.lexsort((widths, cells))
            batch, widths, cells = batch.take(pa.array(order)), widths[order], cells[order]
            ends = [*(np.flatnonzero((np.diff(cells) != 0) | (np.diff(widths) != 0)) + 1).tolist(), len(cells)]
            for low, high in zip([0, *ends], ends):
                for i in range(low, high, BLOCK):
                    part = batch.slice(i, min(BLOCK, high - i))
                    ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                    limits = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(2).cast(pa.int32()))
                    columns = [pa.array([task << 32 | made]), ids, limits, pa.array([stacked(part.column(1), int(widths[i])).tobytes()], pa.binary()), part.column(3)[:1]]
                    names = [f"{name}_block", f"{name}_ids", f"{name}_limits", f"{name}_flat", f"{name}_cell"]
                    if bound:
                        columns.append(pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(4)))
                        names.append(f"{name}_bounds")
                    yield pa.RecordBatch.from_arrays(columns, names=names)
                    made += 1

    bounds = [F.col(bound).cast("double").alias("bound_")] if bound else []
    found = rows.select(id_col, vector_col, "k_", (F.col(cell) if cell else F.lit(0)).cast("long").alias("cell_"), *bounds)
    return found.mapInArrow(run, f"{name}_block long, {name}_ids array<{kinds[id_col]}>, {name}_limits array<int>, {name}_flat binary, {name}_cell long" + (f", {name}_bounds array<double>" if bound else ""))


def best_of_pairs(pairs: DataFrame, query_id: str, query_kind: str, id_col: str, id_kind: str, metric: str, digits: int | None) -> DataFrame:
    """qid, k_, id, similarity of the best vectors that each query meets in a task, from pairs of blocks.

    Where pairs have ``q_mask``, its bits name the queries of the block that meet the vectors.
    """
    masked = "q_mask" in pairs.columns
    bounded_batches(pairs.sparkSession)  # a pair may take a MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list] = {}  # by block of queries: ids, limits, and of each query the best scores and ids
        types: dict[int, pa.DataType] = {}
        for batch in batches:
            types = types or {0: batch.column(1).type.value_type, 3: batch.column(4).type.value_type}
            for block, names, limits, q_raw, ids, v_raw, *mask in (tuple(c[i].as_py() for c in batch.columns) for i in range(batch.num_rows)):
                m, x = (np.frombuffer(raw).reshape(n, len(raw) // (8 * n)) for raw, n in ((q_raw, len(names)), (v_raw, len(ids))))
                chosen = np.flatnonzero(np.unpackbits(np.frombuffer(mask[0], np.uint8), count=len(m))) if masked else np.arange(len(m))
                m = m[chosen] if masked else m
                if m.shape[1] != x.shape[1]:  # of other widths: as far as can be
                    scores = np.full((len(m), len(x)), 0.0 if metric == "cosine" else -np.inf)
                elif metric == "cosine":
                    scores = unit(m) @ unit(x).T
                else:
                    scores = 1 - ((m * m).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * m @ x.T)
                if digits is not None:
                    scores = np.round(scores, digits)
                ids = np.array(ids, object if isinstance(ids[0], str) else None)
                held = best.setdefault(block, [names, limits, [np.empty(0)] * len(names), [ids[:0]] * len(names)])
                most = max(limits, default=0)
                for row, j in zip(scores, chosen.tolist()):
                    n = limits[j]
                    if len(row) > 4 * most > 0:  # ties with the n-th stay in
                        row_at = np.flatnonzero(row >= np.partition(row, len(row) - n)[len(row) - n]) if n else np.empty(0, np.int64)
                    else:
                        row_at = np.arange(len(row))
                    s, i = np.concatenate((held[2][j], row[row_at])), np.concatenate((held[3][j], ids[row_at]))
                    order = np.lexsort((i, -s))[:n]
                    held[2][j], held[3][j] = s[order], i[order]
        for names, limits, scores, found in best.values():
            times = [len(s) for s in scores]
            columns = [np.repeat(np.array(names, object), times).tolist(), np.repeat(np.array(limits), times), np.concatenate(found).tolist(), np.concatenate(scores)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (types[0], pa.int32(), types[3], pa.float64()))], names=[query_id, "k_", id_col, "similarity"])

    return pairs.select("q_block", "q_ids", "q_limits", "q_flat", "v_ids", "v_flat", *(["q_mask"] if masked else [])).mapInArrow(run, f"{query_id} {query_kind}, k_ int, {id_col} {id_kind}, similarity double")


def ranked(near: DataFrame, query_id: str, id_col: str) -> DataFrame:
    """The first k_ rows of each query by similarity, ties by the smaller id."""
    rank = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("similarity"), id_col))
    return near.withColumn("rank", rank).filter(F.col("rank") <= F.col("k_")).drop("k_")


def asked_rows(queries: DataFrame, k: int | str, query_id: str, vector_col: str) -> DataFrame:
    return queries.select(query_id, vector_col, (F.col(k) if isinstance(k, str) else F.lit(k)).cast("int").alias("k_"))


def block_groups(blocks: DataFrame) -> list[list[int]]:
    """Numbers of blocks of queries, in groups of about MOST_QUERIES queries; there is one number for about BLOCK queries."""
    numbers = sorted(r[0] for r in blocks.select("q_block").collect())
    size = max(1, MOST_QUERIES // BLOCK)
    return [numbers[i : i + size] for i in range(0, len(numbers), size)]


def batch_top_k(vectors: DataFrame, queries: DataFrame, k: int | str, id_col: str = "id", vector_col: str = "embedding", query_id: str = "qid", metric: str = "cosine", digits: int | None = None) -> DataFrame:
    """qid, id, similarity, rank for many queries (qid, embedding and, where k names a column, that), by all vectors.

    Blocks of queries meet blocks of vectors in numpy.  A task keeps the best k of each of its queries as it
    goes, so k rows per task and query are shuffled; ties by the smaller id.  Up to ``MOST_QUERIES`` queries
    (by a count) go to every task, packed; more of them are packed into a table first and taken in groups of that size, each
    with a pass over the vectors, so neither a task nor a broadcast holds more.
    """
    asked = asked_rows(queries, k, query_id, vector_col)
    v = in_blocks(vectors.withColumn("k_", F.lit(0)), id_col, vector_col, "v")
    kinds = dict(queries.dtypes)[query_id], dict(vectors.dtypes)[id_col]
    n = asked.count()
    blocks = in_blocks(asked.repartition(max(1, -(-n // BLOCK))), query_id, vector_col, "q")
    groups = [blocks]
    if n > MOST_QUERIES:
        blocks = scratch_table(blocks, "queries")
        groups = [blocks.filter(F.col("q_block").isin(numbers)) for numbers in block_groups(blocks)]
    found = [best_of_pairs(v.crossJoin(F.broadcast(q)), query_id, kinds[0], id_col, kinds[1], metric, digits) for q in groups]
    return ranked(reduce(DataFrame.unionByName, found), query_id, id_col)


def union_of_queries(hits: DataFrame, order: str, key: Column, most: int = 25, request: Sequence[str] = ()) -> DataFrame:
    """Hits of several queries in their order, the first of each key, ``most`` at most; of each request where columns
    of ``request`` tell requests apart.

    The first ones are an aggregate with partial results in the tasks, and so is the limit: tasks pass on no more than
    ``most`` rows of a request.
    """
    first = F.min_by(F.struct(*hits.columns), F.struct(order, "rank"))
    once = hits.groupBy(*request, key.alias("key_")).agg(first.alias("x_")).select("x_.*")
    if not request:
        return once.orderBy(order, "rank").limit(most)
    place = F.row_number().over(Window.partitionBy(*request).orderBy(order, "rank"))
    return once.withColumn("place_", place).filter(F.col("place_") <= most).drop("place_")


def enriched(query: Column, specific: Sequence[str], prefix: str) -> Column:
    """A specific question gets the crop in front; a general one stays."""
    return F.when(contains_any(query, specific), F.concat(F.lit(prefix + " "), query)).otherwise(query)


def term_overlap(query: Column, text: Column) -> Column:
    """Share of the query's distinct words that the text has."""
    asked, has = F.array_distinct(words(F.lower(query))), F.array_distinct(words(F.lower(text)))
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, has)) / F.size(asked)).otherwise(0.0)


def rerank(hits: DataFrame, k: int, score: Column | None = None, query_id: str = "qid") -> DataFrame:
    """Keep the k best of each query by a pair score (rerank_score, rerank_rank); without one the first k."""
    if score is None:
        return hits.filter(F.col("rank") <= k).withColumns({"rerank_score": F.lit(None).cast("double"), "rerank_rank": F.col("rank")})
    rows = hits.withColumn("rerank_score", score)
    rank = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("rerank_score"), "rank"))
    return rows.withColumn("rerank_rank", rank).filter(F.col("rerank_rank") <= k)


def search_and_filter(vectors: DataFrame, queries: DataFrame, texts: DataFrame, k: int, rerank_k: int, weed: Sequence[str] = (), sources: Sequence[str] = (), digits: int | None = None) -> DataFrame:
    """Search, then filter, then re-rank: filters run after the top-k, which is doubled where the hits
    have to mention a weed."""
    hits = batch_top_k(vectors, queries, 2 * k if weed else k, digits=digits).join(texts, "id")
    if weed:
        hits = mentions(hits, "text", weed)
    if sources:
        hits = from_sources(hits, "source", sources)
    hits = hits.join(queries.select("qid", "query"), "qid")
    return rerank(hits, rerank_k, term_overlap(F.col("query"), F.col("text")))


def hashed_vectors(texts: pd.Series, dim: int) -> list[list[float]]:
    """The shipped embedder: signed word counts by hash, with unit length; no network needed."""
    import zlib

    out = []
    for text in texts:
        v = np.zeros(dim, np.float32)
        for w in (text or "").lower().split():
            h = zlib.crc32(w.encode())
            v[h % dim] += 1 if h & 0x80000000 else -1
        size = float(np.sqrt((v * v).sum()))
        out.append((v / size if size else v).tolist())
    return out


def word_marks(words: Sequence[str]) -> Callable[[pd.Series, int], list]:
    """An embedder with a dimension for each word: 1 where the text, in lower case, holds it."""
    return lambda texts, dim: [[float(w in (x or "").lower()) for w in words[:dim]] for x in texts]


def embed_unseen(texts: DataFrame, cache: DataFrame, text_col: str, dim: int = 64, longest: int | None = None, embedder: Callable[[pd.Series, int], list] = hashed_vectors) -> tuple[DataFrame, DataFrame]:
    """(misses, cache): the distinct texts that the cache lacks, and the cache with their vectors.

    Texts are keyed by MD5, so a failed one can't shift the others.  ``longest``: only so many characters go to
    the embedder, for services that cut their input (such as at 8,000).
    """
    bounded_batches(texts.sparkSession)
    keyed = texts.select(F.md5(text_col).alias("text_md5"), (F.substring(text_col, 1, longest) if longest else F.col(text_col)).alias("text")).filter("text_md5 is not null").dropDuplicates(["text_md5"])
    misses = keyed.join(cache.select("text_md5"), "text_md5", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"text_md5": b["text_md5"], "embedding": embedder(b["text"], dim)})

    made = misses.mapInPandas(run, "text_md5 string, embedding array<float>")
    return misses, cache.select("text_md5", "embedding").unionByName(made)


def numbered_context(hits: DataFrame, group: str, rank: str, file: Column, text: Column, rule: str = "\n---\n") -> DataFrame:
    """group, context: ``[i] [FUENTE: file]`` and the text of each hit in order, between rules."""
    item = F.concat(F.lit("["), F.col(rank).cast("string"), F.lit("] [FUENTE: "), file, F.lit("]\n"), text)
    return hits.groupBy(group).agg(F.collect_list(F.struct(F.col(rank).alias("r"), item.alias("item"))).alias("x")).select(group, joined(F.col("x"), "item", rule).alias("context"))


def source_map(hits: DataFrame, group: str, rank: str, fields: dict[str, Column]) -> DataFrame:
    """group, sources: reference number -> facts about the hit."""
    entry = F.struct(F.col(rank).alias("key"), F.struct(*(c.alias(n) for n, c in fields.items())).alias("value"))
    return hits.groupBy(group).agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("sources"))


def reference_list(hits: DataFrame, group: str, rank: str, file: Column, similarity: Column) -> DataFrame:
    line = F.format_string("[%d] %s (%s%%)", F.col(rank), file, fixed(similarity * 100, 2))
    return hits.groupBy(group).agg(F.collect_list(F.struct(F.col(rank).alias("r"), line.alias("line"))).alias("x")).select(group, joined(F.col("x"), "line", "\n").alias("references"))


def result_listing(hits: DataFrame, group: str, rank: str, name: Column, similarity: Column, text: Column) -> DataFrame:
    """Numbered blocks with the relevance in percent, for a prompt."""
    block = F.format_string("%d. %s (relevancia %s%%)\n%s", F.col(rank), name, fixed(similarity * 100, 1), text)
    return hits.groupBy(group).agg(F.collect_list(F.struct(F.col(rank).alias("r"), block.alias("block"))).alias("x")).select(group, joined(F.col("x"), "block", "\n\n").alias("listing"))
