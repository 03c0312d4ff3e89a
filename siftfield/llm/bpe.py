"""BPE encoding and decoding with a contiguous rank array.

A short word is held as two flat lists: its parts (ids, in order of their boundaries) and the rank
of every adjacent pair.  The smallest rank is looked up, its boundary deleted and the two
neighbouring ranks refreshed, until no adjacent pair has a rank.  Words of one length go through these
steps together, as the rows of two arrays.  Words beyond ``LONG`` symbols take a heap with the same
order (rank, then place), so that one endless word costs n log n.

Texts are split on white space first; what a piece turns into is remembered per worker in two
generations of bounded dictionaries, so memory doesn't grow with the vocabulary of the corpus.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftfield.llm.common import REMEMBERED, blocks, trimmed

LONG = 200
NO_RANK = 1 << 60
#: White space of Unicode; str.split() also cuts at the four separators U+001C to U+001F.
SPACE = regex.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
SEPARATORS = regex.compile("[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = [b for b in range(256) if b not in set(plain)]
    out = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(odd)}
    return [out[b] for b in range(256)]


def pieces(text: str) -> list[str]:
    """Runs without white space."""
    return text.split() if SEPARATORS.search(text) is None else [x for x in SPACE.split(text) if x]


class Bpe:
    """One vocabulary with merges in rank order, as a ``tokenizers`` JSON file holds it."""

    def __init__(self, path: str, cache: int = 250_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        if model["type"] != "BPE" or model.get("unk_token") or model.get("continuing_subword_prefix") or spec.get("decoder") or spec.get("post_processor"):
            raise ValueError("only byte-level BPE with word ends, without decoder, is supported")
        end = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        steps = spec["pre_tokenizer"]["pretokenizers"]
        self.split = regex.compile(steps[0]["pattern"]["Regex"])
        letters = byte_letters()
        #: What the library takes to normalise and split; its Unicode tables are others than Python's.
        self.spec = json.dumps({**spec, "added_tokens": [], "model": {"type": "BPE", "vocab": {}, "merges": []}})
        self.bytes_of = {c: b for b, c in enumerate(letters)}
        self.inner, self.last = [vocab[c] for c in letters], [vocab[c + end] for c in letters]
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        keys = np.array([a << 32 | b for a, b in self.ranks], np.int64)
        order = np.argsort(keys)
        #: Sorted pairs, their ranks, and what each rank makes: the same table for whole arrays of pairs.
        self.pairs = np.append(keys[order], np.iinfo(np.int64).max)
        self.pair_rank = np.append(np.array([r for r, _ in self.ranks.values()], np.int64)[order], NO_RANK)
        self.made = np.zeros(len(model["merges"]), np.int64)
        for rank, new in self.ranks.values():
            self.made[rank] = new
        self.most = cache
        self.inner_ids, self.last_ids = np.array(self.inner, np.int64), np.array(self.last, np.int64)
        self.fresh: dict[str, bytes] = {x: np.int32(i).tobytes() for x, i in self.special.items()}
        self.aged: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def merge(self, parts: list[int]) -> list[int]:
        """Merge adjacent parts of one word by rank, leftmost first among equals."""
        if len(parts) > LONG:
            return self.merge_long(parts)
        ranks = self.ranks
        at = [ranks.get(p, (NO_RANK, 0))[0] for p in zip(parts, parts[1:])]
        while at:
            low = min(at)
            if low == NO_RANK:
                break
            i = at.index(low)
            parts[i] = ranks[parts[i], parts[i + 1]][1]
            del parts[i + 1], at[i]
            if i:
                at[i - 1] = ranks.get((parts[i - 1], parts[i]), (NO_RANK, 0))[0]
            if i < len(at):
                at[i] = ranks.get((parts[i], parts[i + 1]), (NO_RANK, 0))[0]
        return parts

    def merge_long(self, parts: list[int]) -> list[int]:
        n, ranks = len(parts), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r[0], i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get((parts[i], parts[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], parts[j] = ranks[a, b][1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if r := ranks.get((parts[i], parts[k])):
                    heapq.heappush(heap, (r[0], i, parts[i], parts[k]))
            if (h := before[i]) >= 0 and (r := ranks.get((parts[h], parts[i]))):
                heapq.heappush(heap, (r[0], h, parts[h], parts[i]))
        return [p for p in parts if p >= 0]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        at = np.searchsorted(self.pairs, keys)
        return np.where(self.pairs[at] == keys, self.pair_rank[at], NO_RANK)

    def merge_rows(self, words: list[bytes]) -> list[bytes]:
        """:meth:`merge` for many words of one length at once: a row holds a word's parts."""
        n, width = len(words), len(words[0])
        raw = np.frombuffer(b"".join(words), np.uint8).reshape(n, width)
        parts = np.append(self.inner_ids[raw[:, :-1]], self.last_ids[raw[:, -1:]], axis=1)
        out = np.full((n, width), -1, np.int32)
        rows, at = np.arange(n), self.rank(parts[:, :-1], parts[:, 1:])
        while at.shape[1]:
            spot = at.argmin(axis=1)
            low = at[np.arange(len(rows)), spot]
            live = low < NO_RANK
            if not live.all():  # words without a pair left are done
                out[rows[~live], : parts.shape[1]] = parts[~live]
                rows, parts, at, spot, low = rows[live], parts[live], at[live], spot[live], low[live]
                if not len(rows):
                    break
            here = np.arange(len(rows))
            parts[here, spot] = self.made[low]
            keep = np.ones(parts.shape, bool)
            keep[here, spot + 1] = False
            parts = parts[keep].reshape(len(rows), -1)
            keep = np.ones(at.shape, bool)
            keep[here, spot] = False
            at = at[keep].reshape(len(rows), -1)
            for side in (spot - 1, spot):
                ok = (side >= 0) & (side < at.shape[1])
                r, c = here[ok], side[ok]
                at[r, c] = self.rank(parts[r, c], parts[r, c + 1])
        if len(rows):
            out[rows, : parts.shape[1]] = parts
        real = out >= 0
        ends, flat = (4 * np.cumsum(real.sum(axis=1))).tolist(), out[real].tobytes()
        return [flat[i:j] for i, j in zip([0, *ends], ends)]

    def merge_words(self, words: list[str]) -> dict[str, bytes]:
        """The ids of distinct words, as 32-bit integers."""
        by_length: dict[int, list[tuple[str, bytes]]] = {}
        for w in words:
            raw = w.encode("utf-8", "surrogatepass")
            by_length.setdefault(len(raw), []).append((w, raw))
        out = {}
        for width, group in by_length.items():
            names, raws = zip(*group)
            if len(group) < 8 or width > LONG:
                merged = [np.array(self.merge([*(self.inner[b] for b in raw[:-1]), self.last[raw[-1]]]), np.int32).tobytes() for raw in raws]
            else:
                merged = [x for i in range(0, len(raws), 4096) for x in self.merge_rows(raws[i : i + 4096])]
            out.update(zip(names, merged))
        return out

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.spec)

    def words_by_library(self, piece: str) -> list[str]:
        """The words of a piece with code points that Python's Unicode doesn't know: classes, case and
        composition are then those of the library's tables."""
        lib = self.library
        found = lib.pre_tokenizer.pre_tokenize_str(lib.normalizer.normalize_str(piece))
        return [bytes(map(self.bytes_of.__getitem__, w)).decode("utf-8") for w, _ in found]

    def learn(self, pieces: set[str]) -> None:
        """Remember the ids of new runs without white space."""
        cut = {}
        for p in pieces:
            if p.isascii() and p.isalpha():
                cut[p] = (p.lower(),)
                continue
            if not p.isascii() and any(unicodedata.category(c) == "Cn" for c in p):
                cut[p] = self.words_by_library(p)
                continue
            norm = p if p.isascii() else unicodedata.normalize("NFC", p)
            cut[p] = self.split.findall(norm.lower() if norm.isascii() else "".join(map(str.lower, norm)))
        words = self.words
        new = {w for ws in cut.values() for w in ws if w not in words}
        if len(words) + len(new) > self.most:
            self.words = words = {}
            new = {w for ws in cut.values() for w in ws}
        words.update(self.merge_words(list(new)))
        for p, ws in cut.items():
            self.fresh[p] = b"".join([words[w] for w in ws])

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of whole texts; special tokens that stand in a text keep their own ids."""
        cut: list[list[str]] = []
        for text in texts:
            if self.specials is None or "<" not in text or self.specials.search(text) is None:
                cut.append(pieces(text))
            else:
                cut.append([p for x in self.specials.split(text) for p in ([x] if x in self.special else pieces(x))])
        if len(self.fresh) > self.most:
            self.aged, self.fresh = self.fresh, {x: np.int32(i).tobytes() for x, i in self.special.items()}
        fresh, aged, new = self.fresh, self.aged, set()
        for p in {p for ps in cut for p in ps if p not in fresh}:
            if (ids := aged.get(p)) is None:
                new.add(p)
            else:
                fresh[p] = ids
        self.learn(new)
        get = self.fresh.__getitem__
        return [np.frombuffer(b"".join(map(get, ps)), np.int32) for ps in cut]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids: np.ndarray) -> str:
        """Without a decoder in the file, tokens joined by a space."""
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def loaded(path: str) -> Bpe:
    return Bpe(path)


REMEMBERED.append(loaded.cache_clear)  # some 200 MB of words on a large corpus, for tasks of this operator alone


def encode_texts(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """Add the ids of every text (array of int) and the text decoded from them.

    ``path`` names a vocabulary file that every executor can open.  Null texts count as empty and
    give an empty array and an empty string.  All other columns stay; columns of the two new names
    are replaced.  Rows are independent, so repeated rows give repeated results; there's no shuffle.
    """
    df = df.drop(ids_col, decoded_col)
    kept = df.columns
    fields = [f"`{n}` {t}" for n, t in df.dtypes] + [f"`{ids_col}` array<int>", f"`{decoded_col}` string"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trimmed()
        bpe = loaded(path)
        for batch in batches:
            for part in blocks(batch, text_col, 1_000_000):
                texts = part.column(part.schema.get_field_index(text_col)).to_pylist()
                ids = bpe.encode_all([t or "" for t in texts])
                offsets = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))
                decoded = pa.array([bpe.decode(x) for x in ids], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(offsets), flat), decoded], names=[*kept, ids_col, decoded_col])

    return df.mapInArrow(run, ", ".join(fields))


def digests(encoded: DataFrame, ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """Count and fingerprint what :func:`encode_texts` made."""
    return encoded.select(
        "doc_id",
        F.size(ids_col).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col(ids_col), " "), 256).alias("ids_sha256"),
        F.sha2(F.col(decoded_col), 256).alias("decoded_sha256"),
    )
