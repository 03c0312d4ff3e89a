"""Language-model scoring with a gated recurrent network in numpy.

The network reads a text word by word and predicts the next one: a group of classes, a class of the
group and the word within its class, each by softmax.  It is trained by backpropagation truncated to windows of STEPS words,
with the state carried from window to window, for SEGMENT words; in scoring the state is carried through
the whole document, whatever its length.  Many documents run side by side, in lanes; a lane starts from a zero
state where a document begins.

The vocabulary is the most frequent training words, as many as cover a share COVERAGE of the training
tokens, so it grows with the data; other words are one symbol, and which word it is has its probability
from the training counts.  Counts cover all training documents.

Texts are turned into ids once.  After a warm start on WARM_DOCS different texts at most, training
documents are dealt by hash to shards of about SHARD_TOKENS words; a network learns from each shard, and
the networks are averaged by the words behind them, in ROUNDS rounds over disjoint parts of the
documents.  Shards depend on the documents alone, so neither files nor the cluster change the result
beyond rounding.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftfield.llm.common import blocks, spread, utf8, word_hashes, written

#: Share of the training tokens that the vocabulary covers at least, and its least number of words.
COVERAGE, VOCABULARY = 0.8, 2000
HIDDEN, STEPS, LANES = 16, 16, 512
#: Words with their counts that every task holds, at most; documents of the warm start, at most.
TABLE, WARM_DOCS, WARM_ROUNDS = 1 << 19, 1500, 3
#: Words of a shard, about, and rounds of averaging; words that a task keeps in memory at once, at most.
SHARD_TOKENS, ROUNDS, HELD = 1_000_000, 2, 3_000_000
#: In training the state is carried over so many words of a document at most; words of a window in scoring, about.
SEGMENT, FULL = 2048, 1 << 15
#: Weights in a piece of a network on its way to the average, and rows of a block of logits.
PIECE, ROWS = 1 << 16, 2048
#: Weights of which an update makes all its passes before it goes on (they stay in a core's cache), and terms of a sum that are added step by step.
NEAR, FEW = 1 << 14, 8
#: Symbols: a word that isn't in the vocabulary, the end, then the vocabulary by frequency.
OTHER, END, FIRST = 0, 1, 2


@dataclass
class Counts:
    """What the training documents hold: all words and ends (n), distinct ones (v), and frequent words."""

    n: int
    v: int
    ends: int
    vocabulary: list[bytes]
    of_vocabulary: list[int]
    hashes: np.ndarray  #: of frequent words, sorted
    counts: np.ndarray
    floor: int  #: words with fewer occurrences are looked up by a join

    @property
    def other_n(self) -> int:
        return self.n - self.ends - sum(self.of_vocabulary)

    @property
    def other_v(self) -> int:
        return self.v - len(self.vocabulary) - (self.ends > 0)


def counted(train: DataFrame) -> DataFrame:
    """word, c over rows of text, the number of texts under a null word; each task adds up its own words
    first, in bounded memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        texts = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8", "replace") for w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "c"])

        for batch in batches:
            for part in blocks(batch, "text"):
                for text in utf8(part.column(0)):
                    seen.update(text.lower().split())
                texts += part.num_rows
                if len(seen) > 300_000:
                    yield out()
                    seen.clear()
        if seen:
            yield out()
        if texts:
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([texts], pa.int64())], names=["word", "c"])

    return train.select("text").mapInArrow(run, "word string, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def gather_counts(train: DataFrame) -> tuple[Counts, DataFrame]:
    """The totals and frequent words, and the table of all counts."""
    everything = written(counted(train), "word-counts")
    table = everything.filter("word is not null")
    step = F.floor(F.log2("c") * 8).cast("int")
    by_step = {r["s"]: (r["k"], r["c"]) for r in table.groupBy(step.alias("s")).agg(F.count("*").alias("k"), F.sum("c").alias("c")).collect()}
    ends = int(everything.filter("word is null").agg(F.sum("c")).first()[0] or 0)
    n, v = sum(c for _, c in by_step.values()) + ends, sum(k for k, _ in by_step.values()) + (ends > 0)
    low, held = max(by_step, default=0) + 1, 0
    for s in sorted(by_step, reverse=True):
        if held + by_step[s][0] > TABLE:
            break
        low, held = s, held + by_step[s][0]
    floor = next(c for c in range(1 << 62) if c and int(np.floor(np.log2(c) * 8)) >= low) if low < 8 * 20 else int(2 ** (low / 8))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, _ = word_hashes([b"\n".join(utf8(batch.column(0)))])
            yield pa.RecordBatch.from_arrays([pa.array([hashes.tobytes()], pa.binary()), pa.array([batch.column(1).to_numpy().astype(np.int64).tobytes()], pa.binary())], names=["h", "c"])

    rows = table.filter(F.col("c") >= floor).select("word", "c").mapInArrow(hashed, "h binary, c binary").collect()
    hashes = np.concatenate([np.frombuffer(r["h"], np.uint64) for r in rows]) if rows else np.empty(0, np.uint64)
    counts = np.concatenate([np.frombuffer(r["c"], np.int64) for r in rows]) if rows else np.empty(0, np.int64)
    order = np.argsort(hashes)
    least, covered, words = max(by_step, default=0) + 1, 0, 0
    for s in sorted(by_step, reverse=True):
        if covered >= COVERAGE * (n - ends) and words >= VOCABULARY:
            break
        least, covered, words = s, covered + by_step[s][1], words + by_step[s][0]
    top = sorted(table.filter(step >= least).collect(), key=lambda r: (-r["c"], r["word"].encode()))
    taken = np.searchsorted(np.cumsum([r["c"] for r in top]), COVERAGE * (n - ends)) + 1
    top = top[: max(int(taken), VOCABULARY)]
    return Counts(n, v, ends, [r["word"].encode() for r in top], [r["c"] for r in top], hashes[order], counts[order], floor), table


def class_bounds(symbols: int) -> np.ndarray:
    """Where classes begin in the symbols by frequency, and the end.

    A class that begins at rank a takes sqrt(a * ln(symbols)) of them, 8 at least: where frequency falls
    with rank, this makes the classes and the words within a token's class about equally many.
    """
    out = [0]
    while out[-1] < symbols:
        out.append(min(symbols, out[-1] + max(8, int(np.sqrt(out[-1] * np.log(symbols))))))
    return np.array(out)


def by_value(x: np.ndarray, most: int) -> np.ndarray:
    """The order that sorts integers from 0 to ``most``, equals as they come: by 16 bits at a time, which numpy does by radix."""
    order = np.argsort(x.astype(np.uint16), kind="stable")
    return order if most < 1 << 16 else order[np.argsort((x[order] >> 16).astype(np.uint16), kind="stable")]


def sums_of_runs(rows: np.ndarray, order: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The sum of each run of ``rows[order]``; runs begin at ``starts``.  Short runs, which are most, go term by term, all runs together."""
    count = np.diff(np.append(starts, len(order)))
    out = rows[order[starts]]
    for k in range(1, FEW):
        live = np.flatnonzero(count > k)
        out[live] += rows[order[starts[live] + k]]
    for i in np.flatnonzero(count > FEW).tolist():
        out[i] += rows[order[starts[i] + FEW : starts[i] + count[i]]].sum(axis=0)
    return out


class Network:
    """Weights of the network, as one flat vector with views on it.

    Output weights end in a bias; they meet states that end in a one.
    """

    def __init__(self, n_words: int, hidden: int = HIDDEN, kind: type = np.float32):
        self.m, self.h, self.kind = n_words + FIRST, hidden, kind
        self.bounds = class_bounds(self.m)
        self.c = len(self.bounds) - 1
        self.of = np.repeat(np.arange(self.c), np.diff(self.bounds))
        self.g = int(np.sqrt(self.c))
        self.groups = np.linspace(0, self.c, self.g + 1).astype(np.int64)
        self.group_of = np.repeat(np.arange(self.g), np.diff(self.groups))
        shapes = {"x": (self.m, 3 * hidden), "u": (hidden, 3 * hidden), "wg": (self.g, hidden + 1), "wc": (self.c, hidden + 1), "ww": (self.m, hidden + 1)}
        self.flat = np.zeros(sum(int(np.prod(s)) for s in shapes.values()), kind)
        self.views, at = {}, 0
        for k, shape in shapes.items():
            size = int(np.prod(shape))
            self.views[k] = self.flat[at : at + size].reshape(shape)
            at += size
        self.room: np.ndarray = np.empty(0, kind)

    @classmethod
    def start(cls, counts: Counts, seed: int = 9, hidden: int = HIDDEN, kind: type = np.float32) -> Network:
        """Random recurrent weights; the output begins with the words' frequencies."""
        net, random = cls(len(counts.vocabulary), hidden, kind), np.random.default_rng(seed)
        net.views["x"][:] = random.normal(0, 0.3, net.views["x"].shape)
        net.views["u"][:] = random.normal(0, 0.3, net.views["u"].shape)
        p = np.array([counts.other_n, counts.ends, *counts.of_vocabulary], float) + 0.5
        of_class = np.add.reduceat(p, net.bounds[:-1])
        of_group = np.add.reduceat(of_class, net.groups[:-1])
        net.views["wg"][:, -1] = np.log(of_group / p.sum())
        net.views["wc"][:, -1] = np.log(of_class / of_group[net.group_of])
        net.views["ww"][:, -1] = np.log(p / of_class[net.of])
        return net

    def empty(self) -> Network:
        return Network(self.m - FIRST, self.h, self.kind)

    def copy(self) -> Network:
        out = self.empty()
        out.flat[:] = self.flat
        return out

    def __getstate__(self) -> dict:
        return {"m": self.m, "h": self.h, "kind": self.kind, "flat": self.flat}

    def __setstate__(self, state: dict) -> None:
        self.__init__(state["m"] - FIRST, state["h"], state["kind"])
        self.flat[:] = state["flat"]

    def block(self, rows: int, columns: int) -> np.ndarray:
        """Scratch memory that is used again; fresh pages for each block of logits cost more than the logits."""
        if len(self.room) < rows * columns:
            self.room = np.empty(rows * columns, self.kind)
        return self.room[: rows * columns].reshape(rows, columns)

    def states(self, x: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """The state after each word of a window (words by lanes), from the state before it."""
        n, u, lanes = self.h, self.views["u"], x.shape[1]
        out, read = np.empty((*x.shape, n), self.kind), self.views["x"][x]
        if keep is not None:
            keep.update({k: np.empty((*x.shape, w * n), self.kind) for k, w in (("before", 1), ("gates", 2), ("new", 1), ("from_h", 1))})
        b, gates, new = np.empty((lanes, 3 * n), self.kind), np.empty((lanes, 2 * n), self.kind), np.empty((lanes, n), self.kind)
        begins = fresh.any(axis=1)
        for t in range(len(x)):
            if begins[t]:
                h = np.where(fresh[t][:, None], self.kind(0), h)
            np.matmul(h, u, out=b)
            np.add(read[t, :, : 2 * n], b[:, : 2 * n], out=gates)
            np.negative(gates, out=gates)
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            np.multiply(gates[:, n:], b[:, 2 * n :], out=new)
            new += read[t, :, 2 * n :]
            np.tanh(new, out=new)
            if keep is not None:
                keep["before"][t], keep["gates"][t], keep["new"][t], keep["from_h"][t] = h, gates, new, b[:, 2 * n :]
            h = np.subtract(h, new, out=out[t])
            h *= gates[:, :n]
            h += new
        return out

    def log_p(self, states: np.ndarray, y: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log probability of each target after its state; with ``grads``, sets the output weights'
        gradients of the mean loss there and returns that of the states."""
        n, h, one = len(y), self.h, self.kind(1)
        # states lie between -1 and 1, so the longest row of weights bounds all logits; small ones need no shift before exp
        shift = max(np.einsum("ij,ij->i", w, w).max() for w in (self.views["wg"], self.views["wc"], self.views["ww"])) * (h + 1) > 60**2
        order = by_value(self.of[y], self.c)  # by class, and so by group
        word = y[order]
        which = self.of[word]
        group = self.group_of[which]
        s = np.ones((n, h + 1), self.kind)
        s[:, :h] = states[order]
        lp = np.zeros(n, self.kind)
        back = np.zeros((n, h), self.kind) if grads is not None else None
        rows, ones = np.arange(min(n, ROWS)), np.ones(self.m, self.kind)
        for name, bounds, cell, chosen in (("wg", np.array([0, self.g]), np.zeros(n, np.int64), group), ("wc", self.groups, group, which), ("ww", self.bounds, which, word)):
            at = chosen - bounds[cell]
            cuts, ends = np.searchsorted(cell, np.arange(len(bounds))).tolist(), bounds.tolist()
            for c in range(len(ends) - 1):
                of_cell = slice(ends[c], ends[c + 1])
                w, size = self.views[name][of_cell], ends[c + 1] - ends[c]
                one_block = 0 < cuts[c + 1] - cuts[c] <= ROWS
                if grads is not None and not one_block:
                    grads[name][of_cell] = 0
                for i in range(cuts[c], cuts[c + 1], ROWS):
                    j = min(i + ROWS, cuts[c + 1])
                    logits = np.matmul(s[i:j], w.T, out=self.block(j - i, size))
                    if shift:
                        logits -= logits.max(axis=1, keepdims=True)
                    hit = logits[rows[: j - i], at[i:j]]
                    np.exp(logits, out=logits)
                    total = logits @ ones[:size]
                    lp[i:j] += hit - np.log(total)
                    if grads is not None:
                        logits[rows[: j - i], at[i:j]] -= total
                        scale = (one / (total * self.kind(n)))[:, None]
                        if one_block:
                            np.matmul(logits.T, s[i:j] * scale, out=grads[name][of_cell])
                        else:
                            grads[name][of_cell] += logits.T @ (s[i:j] * scale)
                        d = logits @ w[:, :h]
                        d *= scale
                        back[i:j] += d
        out = np.empty(n, self.kind)
        out[order] = lp
        if grads is None:
            return out, None
        d = np.empty((n, h), self.kind)
        d[order] = back
        return out, d

    def gradients(self, x: np.ndarray, y: np.ndarray, fresh: np.ndarray, real: np.ndarray, h: np.ndarray, grad: Network) -> tuple[np.ndarray, np.ndarray]:
        """Put the gradient of a window's mean loss into ``grad`` (input weights: only of the words that are
        read); returns those words, and the state to carry on."""
        kept: dict = {}
        states = self.states(x, fresh, h, kept)
        g, n, u = grad.views, self.h, self.views["u"].T
        whole = bool(real.all())
        back = np.zeros_like(states)
        if whole:
            back = self.log_p(states.reshape(-1, n), y.reshape(-1), g)[1].reshape(states.shape)
        else:
            _, back[real] = self.log_p(states[real], y[real], g)
        into = np.empty((*x.shape, 3 * n), self.kind)
        d_b = np.empty_like(into)
        later, begins = np.zeros_like(states[0]), fresh.any(axis=1)
        z, r = kept["gates"][..., :n], kept["gates"][..., n:]
        for t in range(len(x) - 1, -1, -1):
            d, new, z_, r_ = back[t], kept["new"][t], z[t], r[t]
            d += later
            # what the chain rule needs of the step beside the gradient that comes back to its state
            rest = 1 - z_
            by_new = rest * (1 - new * new)
            np.multiply(d, by_new, out=into[t, :, 2 * n :])
            by_new *= kept["from_h"][t]
            by_new *= r_
            by_new *= 1 - r_
            np.multiply(d, by_new, out=into[t, :, n : 2 * n])
            rest *= z_
            rest *= kept["before"][t] - new
            np.multiply(d, rest, out=into[t, :, :n])
            d_b[t, :, : 2 * n] = into[t, :, : 2 * n]
            np.multiply(into[t, :, 2 * n :], r_, out=d_b[t, :, 2 * n :])
            np.matmul(d_b[t], u, out=later)
            d *= z_
            later += d
            if begins[t]:
                later[fresh[t]] = 0
        np.matmul(kept["before"].reshape(-1, n).T, d_b.reshape(-1, 3 * n), out=g["u"])
        words, flat = (x.reshape(-1), into.reshape(-1, 3 * n)) if whole else (x[real], into[real])
        order = by_value(words, self.m)
        words = words[order]
        starts = np.flatnonzero(np.concatenate(([True], words[1:] != words[:-1])))
        rows = words[starts]
        g["x"][rows] = sums_of_runs(flat, order, starts)
        return rows, states[-1].copy()


class Adam:
    def __init__(self, net: Network, rate: float):
        self.net, self.rate, self.t = net, rate, 0
        self.m, self.v, self.grad = np.zeros_like(net.flat), np.zeros_like(net.flat), net.empty()
        self.room = np.empty(NEAR, net.kind)

    def step(self, rows: np.ndarray) -> None:
        """Take a step by ``grad``; input weights are looked at for the words that were read only."""
        self.t += 1
        grad, n = self.grad, self.grad.views["x"].size
        read, rest = grad.views["x"][rows], grad.flat[n:]
        size = float(np.sqrt(np.vdot(read, read) + np.vdot(rest, rest)))
        if size > 1:
            read *= self.net.kind(1 / size)
            rest *= self.net.kind(1 / size)
        first, second, x = self.m[:n].reshape(grad.m, -1), self.v[:n].reshape(grad.m, -1), self.net.views["x"]
        m, v = first[rows], second[rows]
        x[rows] -= self.change(read, m, v, np.empty_like(read))
        first[rows], second[rows] = m, v
        for i in range(n, len(grad.flat), NEAR):
            part = slice(i, min(i + NEAR, len(grad.flat)))
            self.net.flat[part] -= self.change(grad.flat[part], self.m[part], self.v[part], self.room[: part.stop - i])

    def change(self, grad: np.ndarray, m: np.ndarray, v: np.ndarray, room: np.ndarray) -> np.ndarray:
        """What to take off the weights; updates the means m and v in place, as it does ``grad``."""
        kind = self.net.kind
        m *= kind(0.9)
        np.multiply(grad, kind(0.1), out=room)
        m += room
        v *= kind(0.995)
        np.multiply(grad, grad, out=grad)
        grad *= kind(0.005)
        v += grad
        np.sqrt(v, out=room)
        room += kind(1e-6 * np.sqrt(1 - 0.995**self.t))
        np.divide(m, room, out=room)
        room *= kind(self.rate / (1 - 0.9**self.t) * np.sqrt(1 - 0.995**self.t))
        return room


def windows(docs: list[np.ndarray], steps: int, full: int = 0, cut: int = 0, lanes: int = LANES) -> Iterator[tuple[np.ndarray, ...]]:
    """Documents (ids of their words) dealt to lanes of about equal length, window by window: inputs,
    targets, document numbers, where a state begins, and what is real; the longest lanes come first, and
    lanes that have ended fall away.

    A window has ``steps`` words of each lane, or more if it holds fewer than ``full`` in all (no matter in
    scoring, as the state is carried).  ``cut``: documents are dealt in pieces of so many words.
    """
    if not docs:
        return
    sizes = np.array([len(d) + 1 for d in docs])
    ends = np.cumsum(sizes)
    begins = ends - sizes
    y, x = np.full(ends[-1], END, np.int64), np.full(ends[-1], END, np.int64)
    inner = np.ones(len(y), bool)
    inner[ends - 1] = False
    y[inner] = np.concatenate(docs)
    x[1:] = y[:-1]  # the end of one document is the beginning of the next
    pieces = -(-sizes // cut) if cut else np.ones(len(docs), np.int64)
    doc = np.repeat(np.arange(len(docs)), pieces)
    low = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * cut
    low, size = begins[doc] + low, np.minimum(sizes[doc] - low, cut or sizes.max())
    heap = [(0, k) for k in range(min(lanes, len(doc)))]
    own: list[list[int]] = [[] for _ in heap]
    for d in np.lexsort((low, -size)).tolist():
        load, k = heapq.heappop(heap)
        own[k].append(d)
        heapq.heappush(heap, (load + int(size[d]), k))
    length = np.array([size[ds].sum() for ds in own])
    by = np.argsort(-length, kind="stable")
    length, order = length[by], np.concatenate([own[k] for k in by]).astype(np.int64)
    start = np.cumsum(length) - length
    place = np.arange(length.sum()) + np.repeat(low[order] - (np.cumsum(size[order]) - size[order]), size[order])
    fresh = np.zeros(len(y), bool)
    fresh[low] = True
    number = np.repeat(np.arange(len(docs)), sizes)
    t = 0
    while t < int(length[0]):
        live = int(np.searchsorted(-length, -t))
        to = min(t + max(steps, full // live), int(length[0]))
        at = np.arange(t, to)[:, None]
        real = at < length[None, :live]
        here = place[np.minimum(start[None, :live] + at, (start + length - 1)[None, :live])]
        yield x[here], y[here], number[here], fresh[here], real
        t = to


def train_on(net: Network, docs: list[np.ndarray], adam: Adam) -> None:
    h = None
    for x, y, _, fresh, real in windows(docs, STEPS, cut=SEGMENT):
        h = np.zeros((x.shape[1], net.h), net.kind) if h is None else h[: x.shape[1]]
        rows, h = net.gradients(x, y, fresh, real, h, adam.grad)
        adam.step(rows)


def score_docs(net: Network, docs: list[np.ndarray]) -> np.ndarray:
    """Natural log probability of each whole document, its end included."""
    out, h = np.zeros(len(docs)), None
    for x, y, number, fresh, real in windows(docs, STEPS, full=FULL):
        h = np.zeros((x.shape[1], net.h), net.kind) if h is None else h[: x.shape[1]]
        states = net.states(x, fresh, h)
        h = states[-1].copy()
        lp, _ = net.log_p(states[real], y[real])
        out += np.bincount(number[real], lp.astype(np.float64), len(docs))
    return out


CODED = "doc_id bigint, held_out boolean, key bigint, text_key bigint, n_tokens bigint, n_known bigint, base double, outside double, others bigint, ids binary, words array<string>, times array<bigint>"


def coded(docs: DataFrame, counts: Counts) -> DataFrame:
    """Every text as ids, and what the counts that every task holds say of it.

    Per row: key (of id and text) and text_key, tokens with the end, known ones, the sum of log counts
    (base), that of words outside the vocabulary (outside) and their number (others); words and times:
    those that only the table of all counts can tell.
    """
    shared = docs.sparkSession.sparkContext.broadcast((counts, {w: i + FIRST for i, w in enumerate(counts.vocabulary)}))
    names = [x.split(" ")[0] for x in CODED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, known = shared.value
        end_log = float(np.log10(counts.ends + 0.1))
        for batch in batches:
            for part in blocks(batch, "text"):
                texts = utf8(part.column(2))
                words = [t.lower().split() for t in texts]
                flat, n = list(chain.from_iterable(words)), len(texts)
                names_ = {w: i for i, w in enumerate(dict.fromkeys(flat))}
                codes = np.fromiter(map(names_.__getitem__, flat), np.int64, len(flat))
                lengths = np.array([len(ws) for ws in words], np.int64)
                distinct = list(names_)
                hashes, _ = word_hashes([b"\n".join(distinct)])
                at = np.minimum(np.searchsorted(counts.hashes, hashes), max(len(counts.hashes) - 1, 0))
                c = np.where(counts.hashes[at] == hashes, counts.counts[at], 0) if len(counts.hashes) else np.zeros(len(hashes), np.int64)
                frequent, logs = c > 0, np.where(c > 0, np.log10(c + 0.1), 0.0)
                place = np.fromiter((known.get(w, OTHER) for w in distinct), np.int32, len(distinct))
                ids, doc = place[codes], np.repeat(np.arange(n), lengths)
                beyond = ids == OTHER
                own = np.flatnonzero(~frequent[codes])
                pairs, times = np.unique(doc[own] * (len(distinct) + 1) + codes[own], return_counts=True)
                rare = [distinct[k].decode("utf-8", "replace") for k in (pairs % (len(distinct) + 1)).tolist()]
                lists = pa.array(np.searchsorted(pairs, np.arange(n + 1) * (len(distinct) + 1)).astype(np.int32))
                known_, base, outside, others = (np.bincount(doc, w, n) for w in (frequent[codes], logs[codes], np.where(beyond, logs[codes], 0.0), beyond))
                raw, bounds = ids.tobytes(), 4 * np.concatenate(([0], np.cumsum(lengths)))
                columns = [
                    *(part.column(i) for i in (0, 1, 3, 4)), pa.array(lengths + 1), pa.array(known_.astype(np.int64) + (counts.ends > 0)), pa.array(base + end_log), pa.array(outside), pa.array(others.astype(np.int64)),
                    pa.array([raw[i:j] for i, j in zip(bounds.tolist(), bounds[1:].tolist())], pa.binary()), pa.ListArray.from_arrays(lists, pa.array(rare, pa.string())), pa.ListArray.from_arrays(lists, pa.array(times.astype(np.int64))),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    sha = F.sha2("text", 256)
    return docs.select("doc_id", "held_out", "text", F.xxhash64("doc_id", sha).alias("key"), F.xxhash64(sha).alias("text_key")).mapInArrow(run, CODED)


def averaged(net: Network, rows: DataFrame, rate: float, shards: int, rounds: int = 1) -> Network:
    """Learn from each shard of the rows (shard, key, ids), beginning with ``net``, and average by words.

    A task takes its shards one by one and sends one network, the mean of theirs.
    """
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, shard, first, held, size = shared.value, None, 0, [], 0
        total, weight, words = np.zeros(len(start.flat)), 0, 0
        own: Network | None = None

        def learn() -> None:
            for _ in range(rounds):
                train_on(own, held, adam)
            held.clear()

        for batch in batches:
            for s, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if s != shard:
                    if own is not None:
                        learn()
                        total += own.flat.astype(np.float64) * words
                        weight += words
                    first = s if shard is None else first
                    own, shard, size, words = start.copy(), s, 0, 0
                    adam = Adam(own, rate)
                held.append(np.frombuffer(raw, np.int32))
                size, words = size + len(held[-1]) + 1, words + len(held[-1]) + 1
                if size > HELD:
                    learn()
                    size = 0
        if own is not None:
            learn()
            total += own.flat.astype(np.float64) * words
            weight += words
            pieces = np.array_split((total / weight).astype(np.float32), -(-len(total) // PIECE))
            k = len(pieces)
            yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array([first] * k, pa.int64()), pa.array([p.tobytes() for p in pieces], pa.binary()), pa.array([float(weight)] * k)], names=["piece", "source", "values", "weight"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for piece, _, values, weight in zip(*(c.to_pylist() for c in batch.columns)):
                old = sums.setdefault(piece, [0.0, 0.0])
                sums[piece] = [old[0] + weight * np.frombuffer(values, np.float32).astype(np.float64), old[1] + weight]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([(x / w).astype(np.float32).tobytes() for x, w in sums.values()], pa.binary())], names=["piece", "values"])

    tasks = min(shards, 4 * spark.sparkContext.defaultParallelism)
    made = rows.repartition(tasks, "shard").sortWithinPartitions("shard", "key").select("shard", "ids").mapInArrow(run, "piece int, source bigint, values binary, weight double")
    pieces = made.repartition("piece").sortWithinPartitions("piece", "source").mapInArrow(add, "piece int, values binary").collect()
    out = net.copy()
    if pieces:
        out.flat[:] = np.concatenate([np.frombuffer(r["values"], np.float32) for r in sorted(pieces, key=lambda r: r["piece"])])
    return out


def warm_texts(train: DataFrame) -> DataFrame:
    """WARM_DOCS different texts at most, drawn by hash, as one shard."""
    least = train.select("text_key").distinct().orderBy("text_key").limit(WARM_DOCS)
    drawn = train.join(F.broadcast(least), "text_key", "left_semi").groupBy("text_key").agg(F.first("ids").alias("ids"))  # equal texts have equal ids
    return drawn.select(F.lit(0).cast("long").alias("shard"), F.col("text_key").alias("key"), "ids")


def score_texts(docs: DataFrame, train: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs``
    (doc_id, held_out, text), learning from the texts of ``train``, which is ``docs`` or some of its rows
    (all that aren't held out), or none.

    Null texts are empty: one token, the end.  Without any training text every score has but the
    smoothing to go by.  Rows that are equal get equal scores up to rounding.
    """
    counts, table = gather_counts(train)
    rows = written(coded(docs.select("doc_id", "held_out", F.coalesce("text", F.lit("")).alias("text")), counts), "coded")
    net = Network.start(counts)
    if counts.ends:
        learn = rows.filter("not held_out")
        net = averaged(net, warm_texts(learn), 0.01, 1, WARM_ROUNDS)
        shards = max(1, counts.n // (ROUNDS * SHARD_TOKENS))
        for k in range(ROUNDS):
            part = learn.filter(F.pmod(F.xxhash64(F.lit("round"), "key"), F.lit(ROUNDS)) == k)
            net = averaged(net, part.select(F.pmod("key", F.lit(shards)).alias("shard"), "key", "ids"), 0.003, shards)
    shared = docs.sparkSession.sparkContext.broadcast(net)
    kept = ["doc_id", "held_out", "key", "n_tokens", "n_known", "base", "outside", "others"]
    kinds = dict(rows.dtypes)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            ids = [np.frombuffer(x, np.int32) for b in held for x in b.column(len(kept)).to_pylist()]
            lp = score_docs(shared.value, ids) / np.log(10)
            columns = [pa.concat_arrays([b.column(i) for b in held]) for i in range(len(kept))]
            return pa.RecordBatch.from_arrays([*columns, pa.array(lp)], names=[*kept, "lp"])

        for batch in batches:
            held.append(batch)
            size += batch.column(len(kept)).nbytes // 4
            if size > HELD:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    scored = rows.select(*kept, "ids").mapInArrow(score, ", ".join(f"{c} {kinds[c]}" for c in kept) + ", lp double")
    rare = rows.select("key", F.explode(F.arrays_zip("words", "times")).alias("x")).select("key", "x.words", "x.times")
    once = rare.groupBy("key", F.col("words").alias("word")).agg(F.max("times").alias("times"))  # rows that stand there twice
    found = once.join(spread(table.filter(F.col("c") < counts.floor)), "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    logs = found.groupBy("key").agg(F.sum(F.col("times") * F.log10(F.col("c") + 0.1)).alias("log"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("seen"))
    all_log = float(np.log10(counts.n + 0.1 * (counts.v + 1)))
    other_log = float(np.log10(counts.other_n + 0.1 * (counts.other_v + 1)))
    log, seen = F.coalesce("log", F.lit(0.0)), F.coalesce("seen", F.lit(0))
    return scored.join(logs, "key", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + seen).alias("n_known"), F.lit(counts.n).cast("long").alias("train_tokens"),
        (F.col("base") + log - F.col("n_tokens") * F.lit(all_log)).alias("base_score"), (F.col("lp") + F.col("outside") + log - F.col("others") * F.lit(other_log)).alias("score"),
    )
