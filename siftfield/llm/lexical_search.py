"""Ranked lexical search of many items at once: what items share is added up once for each document.

A document's score for an item is a sum over the item's terms, so items are sums that have parts in common.
Sharing is mined among the items of a block: of its COMPARED most common summands, the two that stand together in the
most items become a node of their own, which takes their place there, and so on until no two stand together twice.  The nodes
form a graph without cycles from terms up to items; in each block of documents every node's accumulator (a score for
each document) is made once from two others, and items add up what is left of them.

Documents are read once for a block of items: their terms' counts, as far as items ask for them, are written
with their lengths.  Document frequencies are added up from that table with partial sums in the tasks, and so are the best
documents, as every task keeps the ``k`` best of an item; these are reduced in two steps.  Items are taken in
blocks of about BLOCK_CHARS characters, dealt by hash, so what the driver and the tasks hold of them is bounded by
that and the longest item.

Weights and scores are integers of 64 bits.  Defined results: null and empty texts have no terms and are never
found; an item without terms, or whose terms no document has, has no rows; repeated documents take
a rank each; null document ids come last among equal scores; repeated items each give their rows.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from siftfield.llm.common import blocks, utf8, written

BLOCK_CHARS = 4_000_000
#: 64-bit numbers in all accumulators of a block of documents (8 bytes each), and the most documents in one.
NUMBERS, DOCS = 4_000_000, 2000
#: The most common summands of a block, among which pairs are mined; the rest is added by each item itself.
COMPARED = 1000
#: Parts in which an item's best documents are reduced first.
SALTS = 32

#: Bytes of terms in lower case; all others are spaces.
FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() else 32 for b in range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))


def terms(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and digits and of anything beyond ASCII, A to Z in lower case."""
    return text.translate(FOLD).split()


class Plan:
    """The graph by which the items of a block are added up.

    ``vocabulary``: term -> node.  ``made``: (left, right) of the nodes after the terms, each of earlier ones.
    ``items``: for each item, its summands (nodes, repeats included)."""

    def __init__(self, texts: list[bytes]):
        counts = [Counter(terms(t)) for t in texts]
        self.vocabulary = {t: i for i, t in enumerate(sorted(set().union(*counts)))}
        self.made: list[tuple[int, int]] = []
        # a term that an item has n times is n summands: (node, 1) to (node, n), as others may have fewer
        held: dict[tuple[int, int], int] = {}  # summand -> its items, a bit for each
        for i, c in enumerate(counts):
            for t, n in c.items():
                for j in range(n):
                    s = self.vocabulary[t], j
                    held[s] = held.get(s, 0) | 1 << i
        common = sorted((s for s, m in held.items() if m.bit_count() > 1), key=lambda s: (-held[s].bit_count(), s))[:COMPARED]
        taken = set(common)
        nodes, masks = [s[0] for s in common], [held[s] for s in common]
        self._merge(nodes, masks)
        self.items: list[list[int]] = [[] for _ in texts]
        for node, mask in [*zip(nodes, masks), *((s[0], m) for s, m in held.items() if s not in taken)]:
            while mask:
                i = (mask & -mask).bit_length() - 1
                self.items[i].append(node)
                mask &= mask - 1
        for x in self.items:
            x.sort()

    def _merge(self, nodes: list[int], masks: list[int]) -> None:
        """Greedily: the pair of summands in the most items becomes a node there.  Both lists are changed in place."""
        queue = [(-n, a, b) for a, b in combinations(range(len(nodes)), 2) if (n := (masks[a] & masks[b]).bit_count()) > 1]
        heapq.heapify(queue)
        while queue:
            n, a, b = heapq.heappop(queue)
            both = masks[a] & masks[b]
            if both.bit_count() != -n:  # items have lost one of them meanwhile
                if both.bit_count() > 1:
                    heapq.heappush(queue, (-both.bit_count(), a, b))
                continue
            masks[a], masks[b] = masks[a] & ~both, masks[b] & ~both
            nodes.append(len(self.vocabulary) + len(self.made))
            masks.append(both)
            self.made.append((nodes[a], nodes[b]))
            for c in range(len(nodes) - 1):
                if (n := (masks[c] & both).bit_count()) > 1:
                    heapq.heappush(queue, (-n, c, len(nodes) - 1))

    def additions(self) -> tuple[int, int]:
        """Additions for one document with the graph, and without it."""
        n, own = len(self.vocabulary), 0
        size = [1] * n
        for a, b in self.made:
            size.append(size[a] + size[b])
        for x in self.items:
            own += sum(size[s] for s in x) - 1 if x else 0
        return len(self.made) + sum(max(0, len(x) - 1) for x in self.items), own


def postings(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """id, n (terms with repeats), terms and counts (of those in the vocabulary) of each document with a term."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole, "text"):
                ids, found = batch.column("id").to_pylist(), [terms(t) for t in utf8(batch.column("text"))]
                rows = [(i, len(f), Counter(map(vocabulary.get, f))) for i, f in zip(ids, found) if f]
                lists = [sorted((t, n) for t, n in c.items() if t is not None) for _, _, c in rows]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([[t for t, _ in x] for x in lists], pa.list_(pa.int32())), pa.array([[n for _, n in x] for x in lists], pa.list_(pa.int64()))],
                    ["id", "n", "terms", "counts"],
                )

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(read, "id long, n long, terms array<int>, counts array<long>")


def frequencies(posted: DataFrame, n_terms: int) -> np.ndarray:
    """In how many documents each term stands; the driver gets a row for each term at most."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            total += np.bincount(np.asarray(batch.column(0).flatten()), minlength=n_terms)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["term", "df"])

    out = np.zeros(n_terms, np.int64)
    found = posted.select("terms").mapInArrow(add_up, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toPandas()
    out[found["term"].to_numpy(np.int64)] = found["df"].to_numpy(np.int64)
    return out


def best_documents(posted: DataFrame, plan: Plan, weights: np.ndarray, n_docs: int, n_words: int, k: int) -> DataFrame:
    """item (its place in the block), id and score of the best documents of every task."""
    vocabulary_size, made, items = len(weights), plan.made, plan.items
    last = [-1] * (vocabulary_size + len(made))  # when a node is needed for the last time: then its accumulator goes
    for at, (a, b) in enumerate(made):
        last[a] = last[b] = at
    for x in items:
        for s in x:
            last[s] = len(made)
    ends: dict[int, list[int]] = {}
    for node, at in enumerate(last):
        if at < len(made):
            ends.setdefault(at, []).append(node)
    size = max(1, min(DOCS, NUMBERS // max(1, len(last))))

    def accumulate(batch: pa.RecordBatch) -> dict[int, np.ndarray]:
        """The accumulators of nodes that items need, for the documents of a batch; absent where no document has a part."""
        lists, n = batch.column("terms"), np.asarray(batch.column("n"))
        doc = np.repeat(np.arange(len(n)), np.diff(np.asarray(lists.offsets)))
        term, count = np.asarray(lists.flatten()), np.asarray(batch.column("counts").flatten())
        m = 100 - 75 + (75 * n * n_docs) // n_words
        part = weights[term] * ((1_000_000_000 * count) // (1000 * count + 8 * m[doc]))
        order = np.argsort(term, kind="stable")
        starts = np.flatnonzero(np.concatenate(([True], np.diff(term[order]) > 0))) if len(order) else []
        out: dict[int, np.ndarray] = {}
        for lo, hi in zip(starts, [*starts[1:], len(order)]):
            own = order[lo:hi]
            out[int(term[own[0]])] = acc = np.zeros(len(n), np.int64)
            acc[doc[own]] = part[own]
        for at, (a, b) in enumerate(made):
            x, y = out.get(a), out.get(b)
            if x is not None or y is not None:
                out[vocabulary_size + at] = y if x is None else x if y is None else x + y
            for gone in ends.get(at, ()):
                out.pop(gone, None)
        return out

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)) for _ in items]
        for whole in batches:
            for begin in range(0, whole.num_rows, size):
                batch = whole.slice(begin, size)
                if not batch.num_rows:
                    continue
                nodes = accumulate(batch)
                null = np.asarray(batch.column("id").is_null())
                ids = np.asarray(batch.column("id").fill_null(0))
                for i, summands in enumerate(items):
                    parts = [nodes[s] for s in summands if s in nodes]
                    if not parts:
                        continue
                    total = parts[0].copy() if len(parts) > 1 else parts[0]
                    for p in parts[1:]:
                        total += p
                    least = kept[i][0][-1] if len(kept[i][0]) == k else 1
                    hit = np.flatnonzero(total >= least)
                    if len(hit) > 4 * k:  # those below the k-th score of the block can't be among the best
                        hit = hit[total[hit] >= np.partition(total[hit], len(hit) - k)[len(hit) - k]]
                    if len(hit):
                        s, d, z = (np.concatenate(x) for x in zip(kept[i], (total[hit], ids[hit], null[hit])))
                        order = np.lexsort((d, z, -s))[:k]
                        kept[i] = s[order], d[order], z[order]
        sizes = [len(x[0]) for x in kept]
        found = [np.concatenate(x) for x in zip(*kept)] if kept else [np.zeros(0, np.int64)] * 3
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(items)), sizes)), pa.array(found[1], mask=found[2].astype(bool)), pa.array(found[0])], ["item", "id", "score"])

    return posted.mapInArrow(score, "item long, id long, score long")


def reduced(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each item with their rank, in two steps."""
    order = [F.desc("score"), F.col("id").asc_nulls_last()]
    salted = found.withColumn("salt", F.pmod(F.xxhash64("id", "score"), F.lit(SALTS)))
    some = salted.withColumn("r", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).filter(F.col("r") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k).select("item", "rank", "id", "score")


def search_block(docs: DataFrame, items: list[Row], k: int, id_col: str, text_col: str) -> DataFrame | None:
    """item_id, rank, id, score for the items (item_id, text) of one block."""
    spark = docs.sparkSession
    plan = Plan([(x.text or "").encode() for x in items])
    posted = written(postings(docs, plan.vocabulary, id_col, text_col), "postings")
    n_docs, n_words = posted.agg(F.count("*"), F.sum("n")).first()
    if not n_docs or not plan.vocabulary:
        return None
    df = frequencies(posted, len(plan.vocabulary))
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    ranked = reduced(best_documents(posted.filter(F.size("terms") > 0), plan, weights, n_docs, n_words, k), k)
    names = spark.createDataFrame([(i, x.item_id) for i, x in enumerate(items)], "item long, item_id long")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank (from 1), id and score of the ``k`` documents that rank highest for each item.

    Documents are read once for each block of items."""
    asked = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).filter(F.coalesce(F.length("text"), F.lit(0)) > 0)
    chars = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    n_blocks = -(-chars // BLOCK_CHARS)
    out = docs.sparkSession.createDataFrame([], "item_id long, rank int, id long, score long")
    for b in range(n_blocks):
        rows = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == b).collect()
        found = search_block(docs, sorted(rows, key=lambda r: (r.item_id is None, r.item_id or 0, r.text)), k, id_col, text_col) if rows else None
        out = out if found is None else out.unionByName(found)
    return out
