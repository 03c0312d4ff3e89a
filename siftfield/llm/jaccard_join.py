"""N-gram Jaccard join: groups of documents whose sets of word shingles overlap almost wholly.

1. Words are counted in a table of fixed size over all documents; a shingle's rarity is that of its
   words.  This order is the same for all documents, so any two sets agree on which shingles are rare.
2. Documents with equal sets are one node from here on.  A node's prefix is its rarest shingles, as
   many as a partner may miss plus one: two sets that are similar enough share a prefix shingle.
3. Nodes meet at each shared prefix shingle.  A pair is looked at where its first common shingle is,
   and goes on if the length filter, the positional filter (what can follow is enough) and the suffix
   filter pass; the last bounds from below in how many shingles the sets differ, from parity maps.  A map
   grows with its set, or large sets would pass whatever they hold; where a large node has too many entries
   to take its map along to each, they take it folded, and its pairs are looked at again by the whole maps.
4. Pairs that go on are verified once on the full sets.  First each node only meets its closest
   partner; then only pairs across the components found so far are looked at, all of them.  So a
   group of n near copies costs about n pairs and not n * n, and no link between groups is lost.

A shingle with more than ``HOT`` nodes is dealt out in parts, which meet within themselves.  They are dealt
anew ``MIXES`` times, each node meeting its closest partner of another component, which joins the parts of
a cluster.  In the end the nodes of a shingle's largest component needn't meet each other; they, in parts,
meet all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftfield.llm.common import blocks, mix64, shingle_hashes, spread, text_rows, tidied, utf8, word_hashes, written
from siftfield.llm.components import components

WIDTH, PERCENT = 3, 90
#: Counters for words; bits of a parity map; nodes of a shingle that meet in one task; rows to broadcast at most.
COUNTERS, MAP_LEAST, MAP_MOST, HOT, SMALL = 1 << 18, 512, 1 << 17, 4096, 400_000
#: Bits of a map that any entry takes along; bytes for each shingle up to which a node's entries take more in all.
MAP_FREE, MAP_SHARE = 2048, 16
#: Neighbours that an entry is compared with before it has to meet a partner in full.
LOOK = 128
#: Earlier shared shingles that go with an entry; a pair that shares one of them was met there. With more
#: of them unseen a pair may be met again, and is still verified once.
SEEN = 24
#: Times that the nodes of hot shingles are dealt anew; pairs whose sets are compared in one block, about; bytes of sets in a batch.
MIXES, BLOCK, BATCH = 2, 64, 8_000_000
SHARDS = 64
NULL_ID = -(1 << 63)


def word_counts(docs: DataFrame) -> np.ndarray:
    """How often words of each hash value occur; every task adds up its own table first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for part in blocks(batch, "text"):
                words, _ = word_hashes(utf8(part.column(0)), lower=True)
                total += np.bincount((words & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        pieces = total.astype(np.int64).reshape(SHARDS, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(SHARDS), pa.int32()), pa.array([x.tobytes() for x in pieces], pa.binary())], names=["shard", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for shard, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[shard] = sums.get(shard, 0) + np.frombuffer(counts, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["shard", "counts"])

    schema = "shard int, counts binary"
    out = np.zeros((SHARDS, COUNTERS // SHARDS), np.int64)
    for row in docs.select("text").mapInArrow(tidied(count), schema).repartition("shard").mapInArrow(tidied(add), schema).collect():
        out[row["shard"]] += np.frombuffer(row["counts"], np.int64)
    return out.reshape(-1)


def rarity(counts: np.ndarray) -> np.ndarray:
    """A small integer for each word, larger for more frequent ones."""
    return (256 * np.log2(counts + 1)).astype(np.uint64)


def shingle_sets(texts: list[bytes], rank: np.ndarray, width: int) -> list[np.ndarray]:
    """Of each text, its distinct shingles as rows of two integers: place in the common order, hash."""
    words, at = word_hashes(texts, lower=True)
    hashes, bounds = shingle_hashes(words, at, width)
    weight = np.concatenate((np.zeros(1, np.uint64), np.cumsum(rank[(words & np.uint64(COUNTERS - 1)).astype(np.int64)])))
    n = np.diff(at)
    count = np.diff(bounds)
    first = np.arange(bounds[-1]) - np.repeat(bounds[:-1], count) + np.repeat(at[:-1], count)
    last = first + np.repeat(np.minimum(n, width), count)
    place = ((weight[last] - weight[first]) << np.uint64(44)) | (mix64(hashes) >> np.uint64(20))
    out = []
    for i in range(len(texts)):
        h, p = hashes[bounds[i] : bounds[i + 1]], place[bounds[i] : bounds[i + 1]]
        order = np.argsort(p)
        p, h = p[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        if (new[1:] & (p[1:] == p[:-1])).any():  # different shingles at one place
            h, where = np.unique(h, return_index=True)
            h = h[np.lexsort((h, p[where]))]
        else:
            h = h[new]
        out.append(h)
    return out


def digest_of(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(np.sort(hashes).tobytes())


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def map_bits(n: np.ndarray) -> np.ndarray:
    """Bits of the whole maps of sets of n shingles."""
    return np.clip(1 << np.frexp(np.maximum(n // 2, 1))[1].astype(np.int64), MAP_LEAST, MAP_MOST)


def entry_map(raw: bytes, n: int, entries: int) -> bytes:
    """The map that goes with each of a node's entries, folded until all of them take MAP_SHARE * n bytes at most."""
    x = np.frombuffer(raw, np.uint64)
    while 64 * len(x) > MAP_FREE and 8 * len(x) * entries > MAP_SHARE * n:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x.tobytes()


def parity(hashes: np.ndarray) -> np.ndarray:
    """A map of bits, about half as many as shingles; sets that differ in d shingles have maps that differ in
    d bits at most. Folding a map (one half over the other) gives the map of half the size."""
    bits = int(map_bits(np.array([len(hashes)]))[0])
    odd = np.bincount((hashes >> np.uint64(30)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


class ParityMaps:
    """Maps of several sizes, compared at the smaller size of each pair."""

    def __init__(self, raw: list[bytes]):
        self.raw = [np.frombuffer(x, np.uint64) for x in raw]
        self.size = np.array([len(x) for x in self.raw])
        self.at: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def folded(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The maps of this size, and where that of each set is (of those that have as many bits)."""
        if size not in self.at:
            which = np.flatnonzero(self.size >= size)
            out, place = np.zeros((len(which), size), np.uint64), np.zeros(len(self.raw), np.int64)
            place[which] = np.arange(len(which))
            for row, i in zip(out, which.tolist()):
                row[:] = np.bitwise_xor.reduce(self.raw[i].reshape(-1, size), axis=0)
            self.at[size] = out, place
        return self.at[size]

    def differ(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out, size = np.empty(len(a), np.int64), np.minimum(self.size[a], self.size[b])
        for s in np.unique(size).tolist():
            which, (maps, place) = np.flatnonzero(size == s), self.folded(s)
            step = max(1, 3_200_000 // s)  # of pairs, whose maps take some 25 MB a side
            for k in range(0, len(which), step):
                w = which[k : k + step]
                out[w] = np.bitwise_count(maps[place[a[w]]] ^ maps[place[b[w]]]).sum(axis=1, dtype=np.int64)
        return out


def described(docs: DataFrame, shared, width: int, percent: int, places=None) -> DataFrame:
    """doc_id, text_key, n_shingles, digest of the set, the places where it may meet partners, and its parity map.

    Places are 64-bit hashes: those of the prefix, rarest first, or what ``places`` makes of a block's sets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text", 1_000_000):
                sets = shingle_sets(utf8(part.column(1)), shared.value, width)
                digests = [digest_of(s) for s in sets]
                prefixes = places(sets) if places else [s[: prefix_size(len(s), percent)].tobytes() for s in sets]
                maps = [parity(s).tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(x, pa.binary()) for x in (digests, prefixes, maps))], names=["doc_id", "text_key", "n_shingles", "digest", "prefix", "map"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(tidied(run), "doc_id bigint, text_key bigint, n_shingles bigint, digest binary, prefix binary, map binary")


def shared_tokens(nodes: DataFrame, percent: int) -> DataFrame:
    """token, node, n, place: the prefix shingles at which a node may meet a partner.

    One pass over the entries, range-sorted by shingle and size, so that a frequent shingle may lie in
    several tasks.  An entry goes on if another entry of the shingle passes the length filter and the
    positional filter with it; in runs of more than LOOK entries, and of the shingles at a task's ends, all do.
    """

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefixes = batch.column(2).to_pylist()
            times = np.array([len(p) // 8 for p in prefixes], np.int64)
            place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            what = (np.repeat(batch.column(1).to_numpy(), times) << 32) | place
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(prefixes), np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), times)), pa.array(what)], names=["token", "node", "what"])

    def meeting(token: np.ndarray, what: np.ndarray) -> np.ndarray:
        keep = np.zeros(len(token), bool)
        n, place = what >> 32, what & 0xFFFFFFFF
        here = np.arange(len(token))
        for lag in range(1, LOOK + 1):
            here = here[here + lag < len(token)]
            here = here[token[here] == token[here + lag]]
            if not len(here):
                break
            a, b = here, here + lag
            need = -(-percent * (n[a] + n[b]) // (100 + percent))
            ok = (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])) & (np.minimum(n[a] - place[a], n[b] - place[b]) >= need)
            ok |= lag == LOOK
            keep[a[ok]] = True
            keep[b[ok]] = True
        if len(here):  # long runs: all of their entries
            starts = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
            size = np.diff(np.concatenate((starts, [len(token)])))
            keep |= np.repeat(size > LOOK, size)
        return keep

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.empty(0, np.int64)] * 3
        edge: int | None = None  # the first shingle of the task, or one whose entries have gone on so far

        def out(rows: list[np.ndarray], last: bool = False) -> pa.RecordBatch:
            keep = meeting(rows[0], rows[2]) | (rows[0] == edge)
            if last:
                keep |= rows[0] == rows[0][-1]
            return pa.RecordBatch.from_arrays([pa.array(rows[0][keep]), pa.array(rows[1][keep]), pa.array(rows[2][keep] >> 32), pa.array(rows[2][keep] & 0xFFFFFFFF)], names=["token", "node", "n", "place"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held = [np.concatenate((h, c.to_numpy())) for h, c in zip(held, batch.columns)]
            edge = int(held[0][0]) if edge is None else edge
            cut = int(np.searchsorted(held[0], held[0][-1]))
            if cut:
                yield out([h[:cut] for h in held])
                held = [h[cut:] for h in held]
            elif len(held[0]) > 1_000_000:  # one shingle of very many nodes: its entries go on as they come
                yield out(held, last=True)
                edge, held = int(held[0][-1]), [h[:0] for h in held]
        if len(held[0]):
            yield out(held, last=True)

    schema = "token bigint, node bigint, what bigint"
    rows = nodes.select("node", "n", "prefix").mapInArrow(tidied(entries), schema).repartitionByRange("token", "what").sortWithinPartitions("token", "what")
    found = rows.mapInArrow(tidied(repeated), "token bigint, node bigint, n bigint, place bigint")
    return found


def common_places(nodes: DataFrame) -> DataFrame:
    """token, node, n, place (0): the places that a node has in common with another one."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(2).to_pylist()
            times = np.array([len(p) // 8 for p in found], np.int64)
            node, n = (np.repeat(batch.column(i).to_numpy(), times) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(found), np.int64)), pa.array(node), pa.array(n), pa.array(np.zeros(len(n), np.int64))], names=["token", "node", "n", "place"])

    made = nodes.select("node", "n", "prefix").mapInArrow(tidied(entries), "token bigint, node bigint, n bigint, place bigint").distinct()
    twice = made.groupBy("token").agg(F.count("*").alias("k")).filter("k > 1").select("token")
    return made.join(spread(twice), "token", "left_semi")


def from_texts(docs: DataFrame, wanted: DataFrame, made, schema: str, small: int) -> DataFrame:
    """Compute something from the texts of the wanted rows (doc_id, text_key, digest and more), which are few or many.

    Rows are found by id and text, so that one id (or none) may have any number of texts.
    ``made`` turns the rows' sets and the other columns of ``wanted`` into batches of ``schema``.
    """
    others = [c for c in wanted.columns if c not in ("doc_id", "text_key", "digest")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text", 1_000_000):
                sets, keep, last = [], [], (None, None)
                for text, digest in zip(utf8(part.column(0)), part.column(1).to_pylist()):
                    if text != last[0]:
                        last = (text, made.sets([text])[0])
                    keep.append(digest_of(last[1]) == digest)
                    sets.append(last[1])
                which = np.flatnonzero(keep)
                yield from made([sets[i] for i in which], [c.take(pa.array(which)) for c in part.columns[2:]])

    wanted = F.broadcast(wanted) if wanted.count() <= small else wanted
    return docs.withColumn("text_key", F.xxhash64("text")).join(wanted, ["doc_id", "text_key"]).select("text", "digest", *others).mapInArrow(tidied(run), schema)


class BlockSets:
    """The full set of a node, once for each block that it has to come to, in batches of bounded size."""

    def __init__(self, rank, width: int):
        self.rank, self.width = rank, width

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        return shingle_sets(texts, self.rank.value, self.width)

    def __call__(self, sets: list[np.ndarray], columns: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.binary()))], names=["block", "role", "node", "hashes"])

        for s, node, blocks_ in zip(sets, *(c.to_pylist() for c in columns)):
            raw = np.sort(s).tobytes()
            for b in blocks_:
                rows.append((b["block"], b["role"], node, raw))
                size += len(raw) + 20
                if size > BATCH:
                    yield out()
                    rows, size = [], 0
        if rows:
            yield out()


def candidates(meet: DataFrame, percent: int, closest: bool) -> DataFrame:
    """a, b, coarse: pairs of nodes of different groups that pass the filters; coarse where a map was folded.

    ``meet``: cell, n, node, group, left (side of a cell of two sides, else -1), place (of the shingle in
    the set), before (the node's shared shingles before it), map.  ``closest``: of each node only the
    partner, among those that come before it by size, whose parity map is closest; otherwise all pairs,
    each (but for what SEEN says) at its first common shingle.
    """

    def pairs(rows: dict[str, np.ndarray], before: list[np.ndarray], raw: list[bytes]) -> tuple[np.ndarray, ...]:
        order = np.lexsort((rows["node"], rows["n"]))
        n, node, group, place, left = (rows[k][order] for k in ("n", "node", "group", "place", "left"))
        maps, before = ParityMaps([raw[i] for i in order]), [before[i] for i in order]
        whole = map_bits(n) // 64
        found: list[tuple[np.ndarray, ...]] = []
        step = max(1, 500_000 // len(n))
        for low in range(0, len(n), step):
            high = min(low + step, len(n))
            start = np.searchsorted(100 * n, percent * n[low])  # length filter: what is too short for all of these
            a, b = np.meshgrid(np.arange(low, high), np.arange(start, high), indexing="ij")
            a, b = a.ravel(), b.ravel()
            need = -(-percent * (n[a] + n[b]) // (100 + percent))
            ok = (b < a) & (100 * n[b] >= percent * n[a]) & (np.minimum(n[a] - place[a], n[b] - place[b]) >= need) & (node[a] != node[b])
            ok &= ((left[a] != left[b]) | (left[a] < 0)) & (group[a] != group[b])
            a, b, need = a[ok], b[ok], need[ok]
            differ = maps.differ(a, b)
            ok = differ <= n[a] + n[b] - 2 * need  # suffix filter
            a, b, differ = a[ok], b[ok], differ[ok]
            if closest and len(a):
                pick = np.lexsort((b, differ, a))
                a, b, differ = a[pick], b[pick], differ[pick]
                head = np.concatenate(([True], a[1:] != a[:-1]))
                a, b, differ = a[head], b[head], differ[head]
            if not closest:  # at the first common shingle only
                own = np.array([not len(np.intersect1d(before[i], before[j], assume_unique=True)) for i, j in zip(a, b)], bool)
                a, b, differ = a[own], b[own], differ[own]
            found.append((node[a], node[b], differ, np.minimum(maps.size[a], maps.size[b]) < np.minimum(whole[a], whole[b])))
        return tuple(np.concatenate(x) for x in zip(*found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            cells = rows.column("cell").to_numpy()
            cuts = [0, *(np.flatnonzero(cells[1:] != cells[:-1]) + 1).tolist(), len(cells)]
            arrays = {k: rows.column(k).to_numpy().astype(np.int64) for k in ("n", "node", "group", "place", "left")}
            maps = rows.column("map").to_pylist()
            before = [np.frombuffer(x or b"", np.int64) for x in rows.column("before").to_pylist()]
            for i, j in zip(cuts, cuts[1:]):
                if j - i > 1:
                    found = pairs({k: v[i:j] for k, v in arrays.items()}, before[i:j], maps[i:j])
                    if len(found[0]):
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["a", "b", "differ", "coarse"])

        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            cells = held.column("cell").to_numpy()
            cut = int(np.searchsorted(cells, cells[-1]))
            if cut:
                yield from emit(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield from emit(held)

    columns = ["cell", "n", "node", "group", "left", "place", "before", "map"]
    out = meet.select(*columns).repartition("cell").sortWithinPartitions("cell").mapInArrow(tidied(run), "a bigint, b bigint, differ bigint, coarse boolean")
    if closest:
        return out.groupBy("a").agg(F.min(F.struct("differ", "b", "coarse")).alias("x")).select("a", "x.b", "x.coarse")
    return out.select("a", "b", "coarse").distinct()


CELL = ["cell", "n", "node", "group", "left", "place", "before", "map"]


def dealt(entries: DataFrame, hot: int, salt: int) -> DataFrame:
    """The cells where each node looks for its closest partner: a shingle's nodes (k of them), or one part of them."""
    part = F.pmod(F.xxhash64("node", F.lit(salt)), F.ceil(F.col("k") / F.lit(hot / 2)))
    return entries.withColumn("cell", F.when(F.col("k") > hot, F.xxhash64("token", part)).otherwise(F.xxhash64("token"))).withColumn("left", F.lit(-1)).select(*CELL)


def across(entries: DataFrame, hot: int) -> DataFrame:
    """The cells where all nodes of a shingle meet that are in different groups (``main``: the shingle's largest
    group, k - others of its k nodes).

    If they are many, both the main nodes and the others are dealt in parts; each part of the main nodes
    meets each part of the others, as do the parts of the others with each other.
    """
    many = lambda n: F.greatest(F.ceil(n / F.lit(hot / 2)), F.lit(1)).cast("long")
    rows = entries.withColumns({"minor": F.col("group") != F.col("main"), "mains": many(F.col("k") - F.col("others")), "minors": many(F.col("others"))})
    part = F.pmod(F.xxhash64("node"), F.when(F.col("minor"), F.col("minors")).otherwise(F.col("mains")))
    rows = rows.withColumn("part", part)
    # (kind of cell, one part, the other part, side)
    cell = lambda kind, a, b, left: F.struct(F.lit(kind).alias("kind"), a.cast("long").alias("a"), b.cast("long").alias("b"), left.cast("long").alias("left"))
    zero = F.lit(0).cast("long")
    to_minors = F.transform(F.sequence(zero, F.col("minors") - 1), lambda j: cell(0, F.col("part"), j, zero))
    to_mains = F.transform(F.sequence(zero, F.col("mains") - 1), lambda i: cell(0, i, F.col("part"), F.lit(1)))
    own = F.transform(F.sequence(zero, F.col("minors") - 1), lambda j: cell(1, F.least("part", j), F.greatest("part", j), F.when(j == F.col("part"), F.lit(-1)).otherwise(F.col("part"))))
    whole = F.array(cell(2, zero, zero, F.lit(-1)))
    rows = rows.withColumn("to", F.explode(F.when(F.col("k") <= hot, whole).when(F.col("minor"), F.concat(to_mains, own)).otherwise(to_minors)))
    return rows.withColumn("cell", F.xxhash64("token", "to.kind", "to.a", "to.b")).withColumn("left", F.col("to.left")).select(*CELL)


def told_apart(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs that pass the suffix filter by the whole maps of their nodes; a map takes a sixtieth of a set or so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = np.arange(batch.num_rows)
            n = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            differ = ParityMaps([*batch.column(4).to_pylist(), *batch.column(5).to_pylist()]).differ(k, k + len(k))
            ok = pa.array(differ <= n - 2 * -(-percent * n // (100 + percent)))
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(ok) for i in (0, 1)], names=["a", "b"])

    maps = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("map").alias(f"map_{x}"))
    rows = pairs.select("a", "b").join(maps("a"), "a").join(maps("b"), "b")
    return rows.select("a", "b", "n_a", "n_b", "map_a", "map_b").mapInArrow(tidied(run), "a bigint, b bigint")


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, rank, width: int, percent: int, small: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, counted on the full sets of their texts.

    Of a pair the node with more pairs is the hub.  A hub's pairs are dealt in blocks of about ``BLOCK``;
    the hub's set comes to a block once, and so does that of each partner.
    """
    pairs = written(pairs, "pairs")
    if pairs.filter("coarse").limit(1).count():
        pairs = written(pairs.filter("not coarse").select("a", "b").unionByName(told_apart(pairs.filter("coarse"), nodes, percent)), "pairs-left")
    degree = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("k"))
    rows = pairs.join(spread(degree.select(F.col("node").alias("a"), F.col("k").alias("of_a"))), "a").join(spread(degree.select(F.col("node").alias("b"), F.col("k").alias("of_b"))), "b")
    first = (F.col("of_a") > F.col("of_b")) | ((F.col("of_a") == F.col("of_b")) & (F.col("a") < F.col("b")))
    hub, other = F.when(first, F.col("a")).otherwise(F.col("b")), F.when(first, F.col("b")).otherwise(F.col("a"))
    rows = rows.select(hub.alias("hub"), other.alias("other"), F.greatest("of_a", "of_b").alias("k"))
    rows = rows.withColumn("block", F.xxhash64("hub", F.pmod(F.xxhash64("other"), F.ceil(F.col("k") / BLOCK))))
    sides = rows.select(F.col("hub").alias("node"), "block", F.lit(0).alias("role")).unionByName(rows.select(F.col("other").alias("node"), "block", F.lit(1).alias("role"))).distinct()
    lists = sides.join(spread(degree), "node").groupBy("node", F.pmod(F.xxhash64("block"), F.ceil(F.col("k") / BLOCK)).alias("part")).agg(F.collect_list(F.struct("block", "role")).alias("blocks"))
    wanted = written(lists.join(nodes.select("node", "doc_id", "text_key", "digest"), "node").select("doc_id", "text_key", "digest", "node", "blocks"), "block-lists")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = at = last = None
        for batch in batches:
            out = []
            for b, role, node, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if (b, role, node) == last:
                    continue  # a row that stands there twice
                last = (b, role, node)
                own = np.frombuffer(raw, np.int64)
                if b != block:
                    block, at, hub_set = b, node, own
                    continue
                both = len(np.intersect1d(hub_set, own, assume_unique=True))
                if 100 * both >= percent * (len(hub_set) + len(own) - both):
                    out.append((at, node))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["a", "b"])

    sets = from_texts(docs, wanted, BlockSets(rank, width), "block bigint, role int, node bigint, hashes binary", small)
    return sets.repartition("block").sortWithinPartitions("block", "role", "node").mapInArrow(tidied(run), "a bigint, b bigint")


def similar_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT, hot: int = HOT, small: int = SMALL, places=None, with_keys: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id of every row.

    Two documents link when 100 * intersection >= percent * union of their distinct shingles
    (``width`` words, A to Z in lower case; fewer words make one shingle).  Null and empty texts have
    no shingles and link with nothing.  component_id is the smallest id that links reach, null ids aside
    (null where no other id is reached).  Rows that share an id are documents of their own; equal
    texts give equal components.

    ``with_keys`` adds text_key (xxhash64 of the text) and component, which names a component whatever
    its ids (null without shingles).  ``places`` may name other places to meet than rare shingles: of a block's
    sets, 64-bit hashes end to end for each. Then no words are counted; pairs are verified in any case.
    """
    docs = text_rows(df, id_col, text_col).withColumn("doc_id", F.coalesce("doc_id", F.lit(NULL_ID)))
    shared = docs.sparkSession.sparkContext.broadcast(np.zeros(COUNTERS, np.uint64) if places else rarity(word_counts(docs)))
    rows = written(described(docs, shared, width, percent, places), "shingles")
    own = F.when(F.col("doc_id") != NULL_ID, F.col("doc_id"))
    nodes = rows.filter("n_shingles > 0").groupBy("digest").agg(F.min(F.struct("doc_id", "text_key", "n_shingles", "prefix", "map")).alias("x"), F.min(own).alias("least"))
    nodes = nodes.select(F.monotonically_increasing_id().alias("node"), "digest", "least", F.col("x.doc_id").alias("doc_id"), F.col("x.text_key").alias("text_key"), F.col("x.n_shingles").alias("n"), F.col("x.prefix").alias("prefix"), F.col("x.map").alias("map"))
    nodes = written(nodes, "nodes")  # the numbers of nodes are drawn once
    once = docs  # one row for each id and text
    if rows.groupBy("doc_id", "digest").count().filter("count > 1").limit(1).count():
        once = docs.dropDuplicates(["doc_id", "text"])
    tokens = written(common_places(nodes) if places else shared_tokens(nodes, percent), "tokens")
    maps = nodes.select("node", "map")

    def in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, found, parities in zip(*(c.to_pylist() for c in batch.columns)):
                found = sorted(found, key=lambda x: (x["place"], x["token"]))
                tokens = np.array([x["token"] for x in found], np.int64)
                columns = [pa.array(tokens), pa.array([node] * len(found), pa.int64()), *(pa.array([x[k] for x in found], pa.int64()) for k in ("n", "place"))]
                before = [tokens[: min(k, SEEN)].tobytes() for k in range(len(found))]
                parities = entry_map(parities, found[0]["n"], len(found))
                yield pa.RecordBatch.from_arrays([*columns, pa.array(before, pa.binary()), pa.array([parities] * len(found), pa.binary())], names=["token", "node", "n", "place", "before", "map"])

    mine = tokens.groupBy("node").agg(F.collect_list(F.struct("token", "n", "place")).alias("found"))  # no more than a prefix
    entries = mine.join(maps, "node").mapInArrow(tidied(in_order), "token bigint, node bigint, n bigint, place bigint, before binary, map binary")
    entries = written(entries, "entries")

    nodes = nodes.select("node", "doc_id", "text_key", "digest", "least", "n", "map")
    check = lambda pairs: verified(pairs, nodes, once, shared, width, percent, small)
    alone = entries.withColumns({"group": F.col("node"), "before": F.lit(None).cast("binary")})
    sizes = entries.groupBy("token").agg(F.count("*").alias("k")).filter(F.col("k") > hot)
    any_hot = sizes.limit(1).count() > 0
    sized = alone.join(spread(sizes), "token", "left") if any_hot else alone.withColumn("k", F.lit(0).cast("long"))
    links = written(check(candidates(dealt(sized.withColumn("k", F.coalesce("k", F.lit(0))), hot, 0), percent, True)), "links-0")
    roots = components(links)

    def mixed() -> DataFrame:
        """Entries of the shingles whose nodes are in several groups, with the facts of the shingle."""
        grouped = entries.join(roots, "node", "left").withColumn("group", F.coalesce("root", "node")).drop("root")
        per_group = grouped.groupBy("token", "group").agg(F.count("*").alias("c"))
        facts = per_group.groupBy("token").agg(F.sum("c").alias("k"), F.max(F.struct("c", "group")).alias("most"), F.count("*").alias("groups"))
        facts = facts.filter("groups > 1").select("token", "k", F.col("most.group").alias("main"), (F.col("k") - F.col("most.c")).alias("others"))
        return grouped.join(spread(facts), "token")

    for salt in range(1, MIXES + 1) if any_hot else ():
        again = mixed().filter(F.col("k") > hot).withColumn("before", F.lit(None).cast("binary"))
        links = written(links.unionByName(check(candidates(dealt(again, hot, salt), percent, True))), f"links-{salt}")
        roots = components(links)
    last = check(candidates(across(mixed(), hot), percent, False))
    roots = components(links.unionByName(last))

    labelled = nodes.select("node", "digest", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    label = labelled.filter("least is not null").groupBy("root").agg(F.min("least").alias("component_id"))
    labelled = labelled.join(spread(label), "root", "left").select("digest", "component_id", F.col("root").alias("component"))
    out = rows.join(spread(labelled), "digest", "left")
    keys = ["text_key", "component"] if with_keys else []
    return out.select(own.alias("doc_id"), "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(own).alias("component_id"), *keys)
