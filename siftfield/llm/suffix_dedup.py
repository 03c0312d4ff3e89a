"""Suffix-array dedup: remove what earlier documents already say, byte for byte.

A byte goes if it lies in a run of ``length`` bytes (50) that also starts in a document with a smaller
id.  Suffixes of all documents meet at sampled places, chosen by content alone, so that equal runs of 50
bytes hold the same place:

1. Of the byte 20-grams in each run of 50 bytes, the one with the smallest hash is its anchor (about
   one place in 16).  Anchors are dealt to buckets by hash, and those that a single document has are dropped.
2. The other anchors are dealt out again with their context, the bytes of all runs that they anchor.
3. In a bucket, contexts that agree as a whole are one class.  The suffixes of the classes that share
   an anchor are sorted by mergesort; two suffixes are compared by a binary search for their common
   extension over polynomial prefix hashes, so a comparison takes log2(50) steps.  Neighbours with 50
   bytes in common by hash are verified byte by byte, and the smallest id of equal runs stays.
4. The runs that go return to their documents, where they are joined into maximal spans and cut out.

Exact copies take a short way: all but the smallest id of equal texts are removed as a whole.

No group grows with the documents that share a passage.  In steps 1 and 2 each block of texts first
decides what it can: an anchor that several of its documents have is known to be repeated, and of equal
contexts all but the smallest id go at once; a bucket hears of the rest, one entry for each block.  Around
a passage contexts differ from document to document, so anchors of more than ``HOT`` documents (the
``SMALL`` most frequent at most) are dealt by the bytes of each run in place of the anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftfield.llm.common import blocks, mix64, powers, prefix_hashes, released, sliding_min, spread, tidied, trimmed, utf8, written

LENGTH, GRAM = 50, 20
#: Texts longer than CUT are looked at in pieces; bytes of text per bucket, and per group of documents
#: whose finds are put together; ids to broadcast at most.
CUT, BUCKET_BYTES, GROUP_BYTES, SMALL = 1_000_000, 16_000_000, 64_000_000, 400_000
#: Bytes whose anchors are found, or whose suffixes are sorted, at once (some twenty arrays of eight times the size); parts of a bucket that are sorted one by one.
PIECE, PARTS = 1 << 18, 8
#: Documents of an anchor beyond which its runs are dealt one by one; the bit of an entry that stands for a whole block.
HOT, WHOLE = 20_000, 1 << 31
LAST_ID = (1 << 63) - 1
#: Texts under one id are told apart by the first 16 bytes of their SHA-256.
TAG = np.dtype("V16")


def anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """doc, place, hash of each anchor, and low and high: the first and last run of bytes it stands for.

    A run's anchor depends on nothing but the run.  Long texts are cut into pieces that overlap by
    ``length - 1``, so each run lies in one piece; an anchor may then come once for each piece.
    """
    found: list[tuple[np.ndarray, ...]] = []
    cut = min(CUT, PIECE)
    pieces = [(d, s, t[s : s + cut + length - 1]) for d, t in enumerate(texts) for s in range(0, max(len(t) - length + 1, 0), cut)]
    held, size = [], 0
    for i, piece in enumerate(pieces):
        held.append(piece)
        size += len(piece[2])
        if size < cut and i + 1 < len(pieces):
            continue
        raw = np.frombuffer(b"".join(p[2] for p in held), np.uint8)
        ends = np.cumsum([len(p[2]) for p in held])
        prefix, n = prefix_hashes(raw), len(raw) - gram + 1
        hashes = mix64((prefix[gram:] - prefix[:-gram]) * powers(len(raw))[1][:n])
        keys = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
        least = sliding_min(keys, length - gram + 1)
        run = np.arange(len(least))
        owner = np.searchsorted(ends, run, "right")
        real = run + length <= ends[owner]
        run, owner, place = run[real], owner[real], (least[real] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        last = np.concatenate((first[1:], [len(place)])) - 1
        shift = np.array([p[1] for p in held])[owner[first]] - np.concatenate(([0], ends[:-1]))[owner[first]]
        docs = np.array([p[0] for p in held])[owner[first]]
        found.append((docs, place[first] + shift, hashes[place[first]], run[first] + shift, run[last] + shift))
        held, size = [], 0
    names = ("doc", "place", "hash", "low", "high")
    if not found:
        return {k: np.empty(0, np.uint64 if k == "hash" else np.int64) for k in names}
    return dict(zip(names, (np.concatenate(x) for x in zip(*found))))


def runs_of(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of runs of equal values, and the run that each value is in."""
    new = np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])) if len(sorted_keys) else np.empty(0, bool)
    return np.flatnonzero(new), np.cumsum(new) - 1


def packed(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Consecutive runs of a flat array as binary values."""
    offsets = np.concatenate(([0], np.cumsum(sizes))) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values).view(np.uint8))])


def by_bucket(found: dict[str, np.ndarray], buckets: int) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Anchors in order of bucket and document, the buckets, and their sizes."""
    bucket = (found["hash"] % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    starts, _ = runs_of(bucket[order])
    return {k: v[order] for k, v in found.items()}, bucket[order][starts], np.diff(np.concatenate((starts, [len(order)])))


def by_part(found: dict[str, np.ndarray], ids: np.ndarray, groups: int) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Rows in order of their document's group and document, the groups as buckets below zero, and their sizes."""
    part = (mix64(ids[found["doc"]].astype(np.uint64)) % np.uint64(groups)).astype(np.int64)
    order = np.lexsort((found["doc"], part))
    starts, _ = runs_of(part[order])
    return {k: v[order] for k, v in found.items()}, -1 - part[order][starts], np.diff(np.concatenate((starts, [len(order)])))


ANCHORS = "bucket bigint, ids binary, counts binary, hashes binary, places binary"
CONTEXTS = "bucket bigint, ids binary, tags binary, counts binary, hashes binary, lows binary, spans binary, bytes binary"


def owners(doc: np.ndarray, ids: np.ndarray, at: np.ndarray) -> tuple[list[bytes], list[bytes], list[np.ndarray]]:
    """Of each slice of anchors: the ids of its documents, how many anchors each has, and the documents."""
    own = [runs_of(doc[i:j]) for i, j in zip(at, at[1:])]
    docs = [doc[i:j][starts] for (starts, _), i, j in zip(own, at, at[1:])]
    counts = [np.diff(np.concatenate((starts, [j - i]))).astype(np.uint32).tobytes() for (starts, _), i, j in zip(own, at, at[1:])]
    return [ids[x].tobytes() for x in docs], counts, docs


def known_here(found: dict[str, np.ndarray], ids: np.ndarray) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """What a block of texts has to ask, and what it knows: places of anchors that documents with different
    ids of it have. For each of these anchors one entry is asked with, its place telling the number of documents."""
    order = np.argsort(found["hash"] >> np.uint64(16), kind="stable")
    rows = {k: v[order] for k, v in found.items()}
    starts, group = runs_of(rows["hash"] >> np.uint64(16))
    if not len(starts):
        return found, found
    own = ids[rows["doc"]]
    least, most = np.minimum.reduceat(own, starts), np.maximum.reduceat(own, starts)
    several = least != most
    known = {k: v[several[group]] for k, v in rows.items()}
    entry = starts[several]
    size = np.diff(np.concatenate((starts, [len(own)])))[several]
    asked = {k: np.concatenate((v[~several[group]], v[entry])) for k, v in rows.items()}
    asked["place"][len(asked["place"]) - len(entry) :] = WHOLE | np.minimum(size, WHOLE - 1)
    by = np.argsort(asked["doc"], kind="stable")
    return {k: v[by] for k, v in asked.items()}, known


def anchor_rows(reps: DataFrame, buckets: int, groups: int) -> DataFrame:
    """Anchors of each block of texts, one row per bucket: ids of the documents, how many anchors each
    has in the bucket, and the anchors (48 bits of hash, place) end to end; below zero, by group of
    documents, the places that the block itself knows to be repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text", CUT):
                ords = part.column(0).to_numpy()
                asked, known = known_here(anchors(utf8(part.column(1))), ords)
                for found, bucket, sizes in (by_bucket(asked, buckets), by_part(known, ords, groups)):
                    if not len(bucket):
                        continue
                    at = np.concatenate(([0], np.cumsum(sizes)))
                    ids, counts, _ = owners(found["doc"], ords, at)
                    planes = found["hash"].view(np.uint16).reshape(-1, 4)[:, 1:]
                    hashes = [np.ascontiguousarray(planes[i:j].T).tobytes() if b >= 0 else b"" for b, i, j in zip(bucket, at, at[1:])]
                    places = [np.ascontiguousarray(found["place"][i:j].astype(np.uint32).view(np.uint16).reshape(-1, 2).T).tobytes() for i, j in zip(at, at[1:])]
                    yield pa.RecordBatch.from_arrays([pa.array(bucket), *(pa.array(x, pa.binary()) for x in (ids, counts, hashes, places))], names=["bucket", "ids", "counts", "hashes", "places"])

    return reps.select("key", "text").mapInArrow(tidied(run), ANCHORS)


def grouped(ids: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of rows by group of documents and document, the groups, and their sizes."""
    group = (mix64(ids.astype(np.uint64)) % np.uint64(groups)).astype(np.int64)
    order = np.lexsort((ids, group))
    starts, _ = runs_of(group[order])
    return order, group[order][starts], np.diff(np.concatenate((starts, [len(order)])))


def repeated_anchors(rows: DataFrame, groups: int, hot: int) -> DataFrame:
    """key, places: of each document, the places of the anchors that another document has too; where key is
    null, places are the anchors (48 bits of hash above 16 of their frequency's logarithm) of more than ``hot`` documents.

    A bucket sends one row to each group of documents, which puts them together by document.
    """
    kinds = pa.schema([("part", pa.int64()), ("ids", pa.binary()), ("places", pa.binary())])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        bucket, hashes, ids, places = key[0].as_py(), [], [], []
        for own, counts, h, p in zip(*(table.column(c).to_pylist() for c in ("ids", "counts", "hashes", "places"))):
            if bucket >= 0:
                planes = np.frombuffer(h, np.uint16).reshape(3, -1).astype(np.uint64)
                hashes.append(planes[0] | (planes[1] << np.uint64(16)) | (planes[2] << np.uint64(32)))
            ids.append(np.repeat(np.frombuffer(own, np.int64), np.frombuffer(counts, np.uint32)))
            low, high = np.frombuffer(p, np.uint16).reshape(2, -1).astype(np.uint32)
            places.append(low | (high << np.uint32(16)))
        ids, places = np.concatenate(ids), np.concatenate(places)
        if bucket < 0:
            return pa.table({"part": [-1 - bucket], "ids": [ids.tobytes()], "places": [places.tobytes()]}, schema=kinds)
        hashes = np.concatenate(hashes)
        keep, frequent = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
        for x in range(PARTS):
            order = np.flatnonzero(hashes % np.uint64(PARTS) == x)
            order = order[np.argsort(hashes[order])]
            if not len(order):
                continue
            own, at = ids[order], places[order]
            starts, group = runs_of(hashes[order])
            whole = at >= WHOLE
            times = np.add.reduceat(np.where(whole, at.astype(np.int64) - WHOLE, 1), starts)
            again = (np.minimum.reduceat(own, starts) != np.maximum.reduceat(own, starts)) | (np.add.reduceat(whole.astype(np.int64), starts) > 0)
            keep.append(order[again[group] & ~whole])
            many = np.flatnonzero(times > hot)
            frequent.append((hashes[order[starts[many]]] << np.uint64(16)) | (1024 * np.log2(times[many])).astype(np.uint64))
        keep, many = np.concatenate(keep), np.concatenate(frequent)
        order_, part, sizes = grouped(ids[keep], groups)
        keep = keep[order_]
        part = np.concatenate((part, [-1 - bucket] if len(many) else []))
        packs = [packed(ids[keep], sizes), packed(places[keep], sizes)]
        if len(many):
            packs = [pa.concat_arrays([packs[0], pa.array([b""], pa.binary())]), pa.concat_arrays([packs[1], pa.array([many.tobytes()], pa.binary())])]
        return pa.table({"part": part.astype(np.int64), "ids": packs[0], "places": packs[1]}, schema=kinds)

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        kinds = pa.schema([("key", pa.int64()), ("places", pa.binary())])
        if key[0].as_py() < 0:
            return pa.table({"key": [None] * table.num_rows, "places": table.column("places")}, schema=kinds)
        ids, places = np.frombuffer(b"".join(table.column("ids").to_pylist()), np.int64), np.frombuffer(b"".join(table.column("places").to_pylist()), np.uint32)
        order = np.argsort(ids, kind="stable")
        starts, _ = runs_of(ids[order])
        return pa.table({"key": ids[order][starts], "places": packed(places[order], np.diff(np.concatenate((starts, [len(order)]))))}, schema=kinds)

    return rows.groupBy("bucket").applyInArrow(run, "part bigint, ids binary, places binary").groupBy("part").applyInArrow(merge, "key bigint, places binary")


def hot_anchors(places: DataFrame, most: int) -> np.ndarray:
    """The most frequent of the hot anchors (48 bits of hash), ``most`` at most, sorted."""

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array((x >> np.uint64(16)).view(np.int64)), pa.array((x & np.uint64(0xFFFF)).astype(np.int64))], names=["hash", "times"])

    rows = places.filter("key is null").select("places").mapInArrow(tidied(flat), "hash bigint, times bigint").orderBy(F.desc("times"), "hash").limit(most).toArrow()
    return np.sort(rows.column("hash").to_numpy().view(np.uint64))


def run_by_run(found: dict[str, np.ndarray], hot: np.ndarray, hashes: np.ndarray, base: np.ndarray) -> dict[str, np.ndarray]:
    """Turn the contexts of hot anchors into their single runs, each with the hash of its own bytes.

    ``hashes``: polynomial prefix hashes of all texts end to end; ``base``: where each text begins.
    """
    short = found["hash"] >> np.uint64(16)
    at = np.minimum(np.searchsorted(hot, short), max(len(hot) - 1, 0))
    is_hot = hot[at] == short if len(hot) else np.zeros(len(short), bool)
    rows = {k: v[is_hot] for k, v in found.items()}
    times = rows["high"] - rows["low"] + 1
    one = {k: np.repeat(v, times) for k, v in rows.items()}
    low = one["low"] + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    start = base[one["doc"]] + low
    one.update(low=low, high=low, place=low, hash=mix64((hashes[start + LENGTH] - hashes[start]) * powers(len(hashes))[1][start] if len(start) else np.empty(0, np.uint64)))
    out = {k: np.concatenate((v[~is_hot], one[k])) for k, v in found.items()}
    order = np.argsort(out["doc"], kind="stable")
    return {k: v[order] for k, v in out.items()}


def settled_here(found: dict[str, np.ndarray], ids: np.ndarray, raw: np.ndarray, hashes: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Whether a document of the block with a smaller id has the whole context too, byte for byte."""
    start, size = base[found["doc"]] + found["low"], found["high"] - found["low"] + LENGTH
    if not len(start):
        return np.empty(0, bool)
    whole = (hashes[start + size] - hashes[start]) * powers(len(hashes))[1][start]
    key = mix64(mix64(whole + (found["place"] - found["low"]).astype(np.uint64)) + size.astype(np.uint64)) ^ found["hash"]
    own = ids[found["doc"]]
    order = np.lexsort((own, key))
    starts, group = runs_of(key[order])
    head = order[starts[group]]
    same = equal_bytes(raw, start[order], start[head], np.minimum(size[order], size[head])) & (size[order] == size[head])
    out = np.empty(len(order), bool)
    out[order] = same & (own[order] > own[head])
    return out


def context_rows(texts: DataFrame, buckets: int, groups: int, hot: np.ndarray) -> DataFrame:
    """Contexts of the anchors at given places (ord, tag, text, places), one row per block and bucket; below
    zero, by group of documents, the spans that a block can tell to go (their ends in ``hashes``)."""
    shared = texts.sparkSession.sparkContext.broadcast(hot)
    names = [x.split(" ")[0] for x in CONTEXTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text", 2 * CUT):
                ords, tags, raw = part.column(0).to_numpy(), np.frombuffer(b"".join(part.column(1).to_pylist()), TAG), utf8(part.column(2))
                found = anchors(raw)
                trimmed()  # its arrays' memory, before the hashes of the whole block take theirs
                wanted = np.concatenate([np.frombuffer(x, np.uint32).astype(np.int64) | (d << 40) for d, x in enumerate(part.column(3).to_pylist())])
                keep = np.isin(found["place"] | (found["doc"] << 40), wanted)
                flat = np.frombuffer(b"".join(raw), np.uint8)
                hashes, base = prefix_hashes(flat), np.concatenate(([0], np.cumsum([len(x) for x in raw])))
                found = run_by_run({k: v[keep] for k, v in found.items()}, shared.value, hashes, base)
                gone = settled_here(found, ords, flat, hashes, base)
                owner, low, high = joined(found["doc"][gone], found["low"][gone], found["high"][gone] + LENGTH)
                spans, bucket, sizes = by_part({"doc": owner, "low": low, "high": high}, ords, groups)
                rows, types = [], [pa.int64(), *[pa.binary()] * 7]
                at = np.concatenate(([0], np.cumsum(sizes)))
                ids, counts, docs = owners(spans["doc"], ords, at) if len(bucket) else ([], [], [])
                for k, (b, i, j) in enumerate(zip(bucket, at, at[1:])):
                    rows.append((b, ids[k], tags[docs[k]].tobytes(), counts[k], spans["high"][i:j].astype(np.uint32).tobytes(), spans["low"][i:j].astype(np.uint32).tobytes(), b"", b""))
                found, bucket, sizes = by_bucket({k: v[~gone] for k, v in found.items()}, buckets)
                at = np.concatenate(([0], np.cumsum(sizes)))
                ids, counts, docs = owners(found["doc"], ords, at) if len(bucket) else ([], [], [])
                for k, (b, i, j) in enumerate(zip(bucket, at, at[1:])):
                    doc, low, high = found["doc"][i:j], found["low"][i:j], found["high"][i:j]
                    spans = np.stack((high - low, found["place"][i:j] - low)).astype(np.uint8)
                    text = b"".join([raw[d][s : e + LENGTH] for d, s, e in zip(doc.tolist(), low.tolist(), high.tolist())])
                    rows.append((b, ids[k], tags[docs[k]].tobytes(), counts[k], found["hash"][i:j].tobytes(), low.astype(np.uint32).tobytes(), spans.tobytes(), text))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    # all columns go in, so that the exchange of the texts is the one that the cutting uses again
    return texts.select("ord", "tag", "text", "places", "rest").mapInArrow(tidied(run), CONTEXTS)


class Suffixes:
    """Suffixes of one text, compared by the polynomial hashes of its prefixes."""

    def __init__(self, raw: np.ndarray, length: int = LENGTH):
        self.raw, self.length = raw, length
        self.prefix, self.down = prefix_hashes(raw), powers(len(raw) + 1)[1]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes that two suffixes have in common, ``length`` at most, by binary search."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), self.length, np.int64)
        down_a, down_b, at_a, at_b = self.down[a], self.down[b], self.prefix[a], self.prefix[b]
        while (open_ := low < high).any():
            middle = (low + high + 1) >> 1
            equal = (self.prefix[a + middle] - at_a) * down_a == (self.prefix[b + middle] - at_b) * down_b
            low, high = np.where(open_ & equal, middle, low), np.where(open_ & ~equal, middle - 1, high)
        return low

    def less(self, a: np.ndarray, b: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        n = self.common(a, b)
        whole = n >= self.length
        at = np.minimum(n, self.length - 1)
        return np.where(whole, or_equal, self.raw[a + at] < self.raw[b + at])

    def sort(self, places: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """The order that sorts suffixes within each segment (segments come sorted): a stable
        bottom-up mergesort of all segments at once.

        In each round every suffix finds its rank in the neighbouring run by binary search; with its
        rank in its own run that's its place in the merged one.
        """
        n = len(places)
        order = np.arange(n)
        starts, group = runs_of(segment)
        ends = np.concatenate((starts[1:], [n]))
        base, size = starts[group], (ends - starts)[group]
        local, width = np.arange(n) - base, 1
        biggest = int(size.max()) if n else 0
        while width < biggest:
            live = np.flatnonzero(size > width)  # segments that have more than one run
            own = local[live] // width
            other = own ^ 1
            low = np.minimum(other * width, size[live])
            high = np.minimum(low + width, size[live])
            first, right = low.copy(), (own & 1).astype(bool)
            here, root = places[order[live]], base[live]
            while (busy := np.flatnonzero(low < high)).size:
                middle = (low[busy] + high[busy]) >> 1
                there = places[order[root[busy] + middle]]
                before = self.less(there, here[busy], right[busy])  # equals of the left run come first
                low[busy], high[busy] = np.where(before, middle + 1, low[busy]), np.where(before, high[busy], middle)
            to = root + np.minimum(own, other) * width + (local[live] - own * width) + (low - first)
            new = order.copy()
            new[to] = order[live]
            order, width = new, 2 * width
        return order


def equal_bytes(raw: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the runs at a and b, of the given sizes, agree byte by byte."""
    out = np.ones(len(a), bool)
    for size in np.unique(sizes):
        view = np.lib.stride_tricks.sliding_window_view(raw, int(size))
        which = np.flatnonzero(sizes == size)
        for k in range(0, len(which), 20_000):
            w = which[k : k + 20_000]
            out[w] = (view[a[w]] == view[b[w]]).all(axis=1)
    return out


def earlier_runs(members: dict[str, np.ndarray], raw: np.ndarray, slice_bytes: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """member, first byte, end (in its document): what members of a bucket have to give up.

    members: ord, hash, low, extra (runs beyond the first), offset (of the anchor), start (in raw).
    """
    size = members["extra"] + LENGTH
    whole = np.empty(len(size), np.uint64)
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(members["start"] // slice_bytes)) + 1, [len(size)]))
    for i, j in zip(cuts, cuts[1:]):  # hashes of whole contexts
        if j > i:
            a, b = int(members["start"][i]), int(members["start"][j - 1] + size[j - 1])
            prefix, at = prefix_hashes(raw[a:b]), members["start"][i:j] - a
            whole[i:j] = (prefix[at + size[i:j]] - prefix[at]) * powers(b - a)[1][at]
    key = mix64(mix64(whole + members["offset"].astype(np.uint64)) + members["extra"].astype(np.uint64))
    order = np.lexsort((members["ord"], key, members["hash"]))
    h, c = members["hash"][order], key[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])))
    head = order[np.flatnonzero(new)[np.cumsum(new) - 1]]  # smallest id of each one's class
    same = equal_bytes(raw, members["start"][order], members["start"][head], size[order])
    same &= size[order] == size[head]
    gone = order[same & (members["ord"][order] > members["ord"][head])]
    out = [(gone, members["low"][gone], members["low"][gone] + size[gone])]

    # of each class the smallest id, with all its places; classes of one anchor stand together
    reps = order[~same | (members["ord"][order] == members["ord"][head])]
    starts, group = runs_of(members["hash"][reps])
    count = np.diff(np.concatenate((starts, [len(reps)])))
    reps = reps[count[group] > 1]
    starts, group = runs_of(members["hash"][reps])
    weight = np.cumsum(size[reps])
    first = np.concatenate(([0], weight))[starts] // slice_bytes
    for piece in np.unique(first):  # whole groups, about slice_bytes of text at a time
        own = reps[(first == piece)[group]]
        sizes, text = size[own], []
        for m in own:
            text.append(raw[members["start"][m] : members["start"][m] + size[m]])
        text = np.concatenate(text)
        at = np.cumsum(sizes) - sizes
        runs = members["extra"][own] + 1
        which = np.repeat(np.arange(len(own)), runs)
        step = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
        offset = members["offset"][own][which] - step
        _, anchor = runs_of(members["hash"][own])
        segment = anchor[which] * 256 + offset
        by = np.argsort(segment, kind="stable")
        which, step, segment = which[by], step[by], segment[by]
        places = at[which] + step
        suffixes = Suffixes(text)
        order = suffixes.sort(places, segment)
        which, step, places = which[order], step[order], places[order]
        if len(places) < 2:
            continue
        a, b = places[:-1], places[1:]
        equal = (segment[1:] == segment[:-1]) & (suffixes.common(a, b) >= LENGTH)
        check = np.flatnonzero(equal)
        equal[check] = equal_bytes(text, a[check], b[check], np.full(len(check), LENGTH))
        ids = members["ord"][own][which]
        heads, run = runs_of(np.concatenate(([0], np.cumsum(~equal))))
        gone = np.flatnonzero(ids > np.minimum.reduceat(ids, heads)[run])
        m, p = own[which[gone]], members["low"][own[which[gone]]] + step[gone]
        out.append((m, p, p + LENGTH))
    return tuple(np.concatenate(x) for x in zip(*out))


def joined(owner: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each owner, those that overlap or touch made one."""
    order = np.lexsort((low, owner))
    owner, low, high = owner[order], low[order], high[order]
    if not len(owner):
        return owner, low, high
    starts, group = runs_of(owner)
    wide = int(high.max()) + 1
    reach = np.maximum.accumulate(high + group * wide)
    new = np.concatenate(([True], (low[1:] + group[1:] * wide > reach[:-1]) | (owner[1:] != owner[:-1])))
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(owner)])) - 1
    return owner[first], low[first], reach[last] - group[last] * wide


def cuts_of_buckets(rows: DataFrame, groups: int) -> DataFrame:
    """ord, tag, cuts (pairs of 32-bit places, joined) that the buckets' suffix sorts find."""
    kinds = pa.schema([("part", pa.int64()), *((k, pa.binary()) for k in ("ids", "tags", "lows", "highs"))])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        if (bucket := key[0].as_py()) < 0:
            columns: dict[str, list[bytes]] = {k: [] for k in ("ids", "tags", "lows", "highs")}
            for own, tags, counts, high, low in zip(*(table.column(c).to_pylist() for c in ("ids", "tags", "counts", "hashes", "lows"))):
                counts = np.frombuffer(counts, np.uint32)
                for k, v in (("ids", np.repeat(np.frombuffer(own, np.int64), counts).tobytes()), ("tags", np.repeat(np.frombuffer(tags, TAG), counts).tobytes()), ("lows", low), ("highs", high)):
                    columns[k].append(v)
            return pa.table({"part": [-1 - bucket], **{k: [b"".join(v)] for k, v in columns.items()}}, schema=kinds)
        released()
        parts: dict[str, list[np.ndarray]] = {k: [] for k in ("ord", "tag", "hash", "low", "extra", "offset")}
        text = b"".join(table.column("bytes").to_pylist())
        for own, tags, counts, h, low, spans in zip(*(table.column(c).to_pylist() for c in ("ids", "tags", "counts", "hashes", "lows", "spans"))):
            counts = np.frombuffer(counts, np.uint32)
            extra, offset = np.frombuffer(spans, np.uint8).reshape(2, -1).astype(np.int64)
            for k, v in (("ord", np.repeat(np.frombuffer(own, np.int64), counts)), ("tag", np.repeat(np.frombuffer(tags, TAG), counts)), ("hash", np.frombuffer(h, np.uint64)), ("low", np.frombuffer(low, np.uint32).astype(np.int64)), ("extra", extra), ("offset", offset)):
                parts[k].append(v)
        members = {k: np.concatenate(v) for k, v in parts.items()}
        del parts
        size = members["extra"] + LENGTH
        members["start"] = np.cumsum(size) - size
        member, low, high = earlier_runs(members, np.frombuffer(text, np.uint8))
        owner, low, high = joined(member, low, high)
        order, group, sizes = grouped(members["ord"][owner], groups)
        owner, low, high = owner[order], low[order].astype(np.uint32), high[order].astype(np.uint32)
        return pa.table({"part": group, "ids": packed(members["ord"][owner], sizes), "tags": packed(members["tag"][owner], sizes), "lows": packed(low, sizes), "highs": packed(high, sizes)}, schema=kinds)

    def merge(table: pa.Table) -> pa.Table:
        ids, tags, lows, highs = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("ids", np.int64), ("tags", TAG), ("lows", np.uint32), ("highs", np.uint32)))
        halves = tags.view(np.uint64).reshape(-1, 2)
        order = np.lexsort((halves[:, 1], halves[:, 0], ids))
        ids, tags, halves = ids[order], tags[order], halves[order]
        new = np.concatenate(([True], (ids[1:] != ids[:-1]) | (halves[1:] != halves[:-1]).any(axis=1)))
        owner, low, high = joined(np.cumsum(new) - 1, lows[order].astype(np.int64), highs[order].astype(np.int64))
        starts, _ = runs_of(owner)
        pairs = np.stack((low, high), axis=1).astype(np.uint32).reshape(-1)
        sizes = 2 * np.diff(np.concatenate((starts, [len(owner)])))
        return pa.table({"ord": ids[new], "tag": packed(tags[new], np.ones(int(new.sum()), np.int64)), "cuts": packed(pairs, sizes)}, schema=pa.schema([("ord", pa.int64()), ("tag", pa.binary()), ("cuts", pa.binary())]))

    made = rows.groupBy("bucket").applyInArrow(run, "part bigint, ids binary, tags binary, lows binary, highs binary")
    return made.groupBy("part").applyInArrow(merge, "ord bigint, tag binary, cuts binary")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, small: int = SMALL, keep: tuple[str, ...] = (), as_text: bool = False, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, spans (array of start and end, in bytes), kept (binary) of every row, and the
    columns named in ``keep``, as they were, in one struct ``rest`` (null if none are named).

    ``as_text``: kept is a string, without what is left of characters that were cut in two.

    Null texts are empty.  Null ids come after all others, and rows with one id don't remove from each
    other, so repeats under one id stay.  Texts under 50 bytes are left alone.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    sha = F.unhex(F.sha2(text, 256))
    plain = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("ord"), F.substring(sha, 1, TAG.itemsize).alias("tag"), text.alias("text"), (F.struct(*keep) if keep else F.lit(None).cast("string")).alias("rest"))
    own = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("ord"), sha.alias("sha"), F.octet_length(text).cast("long").alias("n_bytes")).withColumn("tag", F.substring("sha", 1, TAG.itemsize))
    facts = written(own.filter(F.col("n_bytes") >= LENGTH), "facts")
    total = int(facts.agg(F.sum("n_bytes")).first()[0] or 0)
    buckets, groups = max(1, total // bucket_bytes), max(1, total // GROUP_BYTES)
    repeated = facts.groupBy("ord").agg(F.count("*").alias("n"), (F.min("tag") != F.max("tag")).alias("several")).filter("n > 1")
    twice, several, least = repeated.agg(F.count("*"), F.count_if("several"), F.min(F.when(F.col("several"), F.col("ord")))).first()

    def keyed(rows: DataFrame) -> DataFrame:
        """Adds what rows are joined by: the id, or where that has several texts, a hash of both, so that one id with
        very many texts isn't one key.  Rows whose hashes meet by chance are still told apart by tag."""
        hashed = F.xxhash64("ord", "tag")
        if not several or least == LAST_ID:
            return rows.withColumn("key", F.when(F.col("ord") == LAST_ID, hashed).otherwise(F.col("ord")) if several else F.col("ord"))
        mixed = repeated.filter("several").select("ord", F.lit(True).alias("_mixed"))
        marked = F.broadcast(mixed) if several <= small else mixed
        return (rows if several <= small else spread(rows)).join(marked, "ord", "left").withColumn("key", F.when(F.col("_mixed"), hashed).otherwise(F.col("ord"))).drop("_mixed")

    docs = keyed(plain)
    first = facts.groupBy("sha").agg(F.min("ord").alias("first"), F.count("*").alias("n")).filter("n > 1").select("sha", "first")
    copies = written(facts.join(spread(first), "sha").filter("ord > first").select("ord", "tag", "n_bytes").distinct(), "copies")
    ids = copies.select("ord", "tag")
    reps = docs.filter(F.octet_length("text") >= LENGTH).join(F.broadcast(ids) if ids.count() <= small else ids, ["ord", "tag"], "left_anti")

    if twice:  # rows that stand there twice
        reps = reps.dropDuplicates(["ord", "tag"])
    places = written(repeated_anchors(anchor_rows(reps, buckets, groups), groups, hot), "places")
    frequent = hot_anchors(places, SMALL)
    found = cuts_of_buckets(context_rows(docs.join(places.filter("key is not null"), "key"), buckets, groups, frequent), groups)

    def all_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column(2).to_numpy()
            pairs = np.stack((np.zeros(len(n), np.int64), n), axis=1).astype(np.uint32).reshape(-1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), packed(pairs, np.full(len(n), 2))], names=["ord", "tag", "cuts"])

    found = found.unionByName(copies.select("ord", "tag", "n_bytes").mapInArrow(tidied(all_of), "ord bigint, tag binary, cuts binary"))
    cuts = keyed(found).groupBy("key").agg(F.collect_list(F.struct("tag", "cuts")).alias("cuts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text", CUT):
                kept, spans, sizes = [], [], []
                for tag, raw, found in zip(part.column(1).to_pylist(), utf8(part.column(2)), part.column(3).to_pylist()):
                    pairs = np.frombuffer(b"".join(x["cuts"] for x in found or () if x["tag"] == tag), np.uint32).astype(np.int64).reshape(-1, 2)
                    _, low, high = joined(np.zeros(len(pairs), np.int64), pairs[:, 0], pairs[:, 1])
                    spans.append([{"start": a, "end": b} for a, b in zip(low.tolist(), high.tolist())])
                    edges = [0, *(x for ab in zip(low.tolist(), high.tolist()) for x in ab), len(raw)]
                    kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])))
                    sizes.append(len(raw))
                types = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                left = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(spans, types), left, part.column(4)], names=["doc_id", "n_bytes", "spans", "kept", "rest"])

    kinds = f"doc_id bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept {'string' if as_text else 'binary'}, rest {docs.schema['rest'].dataType.simpleString()}"
    out = docs.join(cuts, "key", "left").select("ord", "tag", "text", "cuts", "rest").mapInArrow(tidied(run), kinds)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != LAST_ID, F.col("doc_id")))


def summary(removed: DataFrame) -> DataFrame:
    count = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return removed.select("doc_id", "n_bytes", count.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
