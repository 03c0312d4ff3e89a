"""Quality rules: plain counts of a text, and the fertility of public tokenisers on it.

Every word is encoded on its own with each vocabulary: SentencePiece ones that fall back to bytes, and
byte-level ones, whose byte tokens are those with part of a character.  By each a text is then
described by characters per token, the share of byte tokens and the entropy of its tokens in bits.
Each language, or else each script, has a band for the three; texts outside one are rejected, and so are
texts whose letters were read in a wrong encoding.  Prose in a language that the vocabulary knows
lies inside; key dumps, encoded binaries and text in a wrong encoding have short tokens, many
byte tokens, or both, and endless repetition has hardly any entropy.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftfield.llm.common import blocks, mix64, tidied, utf8

#: Public vocabularies that the query and the pipeline measure with: SentencePiece with byte fallback, and bytes of many languages.
VOCABULARIES = ("piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken")
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5


class Band(NamedTuple):
    """What a text of one language or script must keep to."""

    chars_low: float  #: fewest code points of words per token
    chars_high: float  #: most code points of words per token
    bytes_high: float  #: largest share of byte-fallback tokens
    entropy_low: float  #: smallest entropy in bits; SHORT of the most possible is enough for short texts


#: By language code, the lower bounds of characters just under the measured spread of prose; a language that isn't named here is judged by the script of most of its letters.
LANGUAGE_BANDS = {
    "en": Band(1.70, 8.0, 0.10, 4.0),
    "de": Band(1.70, 8.0, 0.10, 4.0),
    "fr": Band(1.66, 8.0, 0.10, 4.0),
    "es": Band(1.65, 8.0, 0.10, 4.0),
}
SCRIPT_BANDS = {
    "latin": Band(1.3, 10.0, 0.15, 3.8),
    "cyrillic": Band(1.0, 10.0, 0.30, 3.8),
    "greek": Band(0.6, 10.0, 0.50, 3.5),
    "hebrew": Band(0.5, 10.0, 0.60, 3.5),
    "arabic": Band(0.5, 10.0, 0.60, 3.5),
    "devanagari": Band(0.3, 10.0, 0.95, 3.0),
    "thai": Band(0.3, 10.0, 0.95, 3.0),
    "hangul": Band(0.3, 10.0, 0.95, 3.0),
    "cjk": Band(0.3, 10.0, 0.95, 3.0),
    "other": Band(0.2, 10.0, 1.00, 2.5),
    "none": Band(1.3, 10.0, 0.15, 3.8),  #: no letters at all
}
#: The same for a byte-level vocabulary of many languages, in which a byte token is part of a character.
BYTE_LANGUAGE_BANDS = {
    "en": Band(1.55, 8.0, 0.10, 4.0),
    "de": Band(1.55, 8.0, 0.10, 4.0),
    "fr": Band(1.50, 8.0, 0.10, 4.0),
    "es": Band(1.50, 8.0, 0.10, 4.0),
}
BYTE_SCRIPT_BANDS = {
    "latin": Band(1.2, 10.0, 0.15, 3.8),
    "cyrillic": Band(1.0, 10.0, 0.30, 3.8),
    "greek": Band(0.8, 10.0, 0.50, 3.5),
    "hebrew": Band(0.5, 10.0, 0.60, 3.5),
    "arabic": Band(0.5, 10.0, 0.60, 3.5),
    "devanagari": Band(0.3, 10.0, 0.95, 3.0),
    "thai": Band(0.3, 10.0, 0.95, 3.0),
    "hangul": Band(0.3, 10.0, 0.95, 3.0),
    "cjk": Band(0.3, 10.0, 0.95, 3.0),
    "other": Band(0.15, 10.0, 1.00, 2.5),
    "none": Band(1.2, 10.0, 0.15, 3.8),
}
#: By kind of vocabulary, the bands of languages and of scripts.
BANDS = {"pieces": {**SCRIPT_BANDS, **LANGUAGE_BANDS}, "bytes": {**BYTE_SCRIPT_BANDS, **BYTE_LANGUAGE_BANDS}}
#: One-byte code pages as which UTF-8 is read by mistake, and words of a text to a letter that is wrong by it.
CODE_PAGES, WRONG = ("cp1252", "latin-1", "cp1251", "cp437"), 50
#: A text with few tokens needs this share of the entropy that they could have.
SHORT = 0.4
#: First code point of each range, and the script of its letters; "" for what has no letters of a script.
RANGES = [
    (0x0000, ""), (0x0041, "latin"), (0x005B, ""), (0x0061, "latin"), (0x007B, ""), (0x00C0, "latin"), (0x0250, "other"),
    (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "other"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0780, "other"),
    (0x0900, "devanagari"), (0x0980, "other"), (0x0E00, "thai"), (0x0E80, "other"), (0x1100, "hangul"), (0x1200, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, ""), (0x2C00, "other"), (0x2E80, "cjk"), (0x3000, ""), (0x3040, "cjk"),
    (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "cjk"), (0xFB00, "other"), (0xFE30, ""), (0xFF66, "cjk"),
    (0xFFF0, ""), (0x10000, "other"), (0x1F000, ""), (0x20000, "cjk"),
]
SCRIPTS = sorted({s for _, s in RANGES})
STARTS = np.array([a for a, _ in RANGES])
SCRIPT_OF = np.array([SCRIPTS.index(s) for _, s in RANGES])


def script(text: bytes) -> str:
    """The script of most letters of a text; "none" without letters."""
    points = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    seen = np.bincount(SCRIPT_OF[np.searchsorted(STARTS, points, "right") - 1], minlength=len(SCRIPTS))
    seen[SCRIPTS.index("")] = 0
    return SCRIPTS[int(seen.argmax())] if seen.any() else "none"


#: How a byte-level vocabulary cuts a word with a space before it: its own pattern without the look ahead behind white space, which
#: overflows on endless runs of Unicode blanks.  Words that begin with such blanks are cut behind them; all others as by its own.
PIECES_OF_WORDS = r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"


class SentencePieces:
    """A SentencePiece model; its byte tokens are those that it falls back to."""

    kind = "pieces"

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.size)])

    def encode(self, words: list[str]) -> list[list[int]]:
        return self.model.encode(words, num_threads=1) if words else []


class BytePairs:
    """A file of ranks of a byte-level vocabulary; its byte tokens are those that hold part of a character only."""

    kind = "bytes"

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.model = tiktoken.Encoding("own", pat_str=PIECES_OF_WORDS, mergeable_ranks=ranks, special_tokens={})
        self.size = max(ranks.values()) + 1
        self.is_byte = np.zeros(self.size, bool)
        for token, rank in ranks.items():
            try:
                token.decode()
            except UnicodeDecodeError:
                self.is_byte[rank] = True

    def encode(self, words: list[str]) -> list[list[int]]:
        encode = self.model.encode_ordinary
        return [encode(" " + w) for w in words]


class Vocabulary:
    """Encodes words by one or several vocabularies, remembering a bounded number of words and of their bytes."""

    def __init__(self, paths: str | Sequence[str], most: int = 200_000, most_bytes: int = 4_000_000):
        paths = [paths] if isinstance(paths, str) else paths
        self.tools = [BytePairs(p) if p.endswith(".tiktoken") else SentencePieces(p) for p in paths]
        self.most, self.most_bytes = most, most_bytes
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.n_bytes = 0
        self.ids = [np.zeros(0, np.int32) for _ in self.tools]
        self.bounds = [np.zeros(1, np.int64) for _ in self.tools]

    def encode(self, words: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each vocabulary, the ids of distinct words, end to end, and how many each has."""
        new = [w for w in words if w not in self.known]
        size = sum(map(len, new))
        if self.known and (len(self.known) + len(new) > self.most or self.n_bytes + size > self.most_bytes):
            self.forget()
            new, size = words, sum(map(len, words))
        self.n_bytes += size
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        texts = [w.decode("utf-8", "replace") for w in new]
        out = []
        for k, tool in enumerate(self.tools):
            found = tool.encode(texts)
            n = np.fromiter(map(len, found), np.int64, len(found))
            self.ids[k] = np.concatenate((self.ids[k], np.fromiter(chain.from_iterable(found), np.int32, int(n.sum()))))
            self.bounds[k] = np.concatenate((self.bounds[k], self.bounds[k][-1] + np.cumsum(n)))
            first, take = self.bounds[k][at], self.bounds[k][at + 1] - self.bounds[k][at]
            out.append((self.ids[k][runs(first, take)], take))
        return out


@lru_cache(maxsize=2)
def vocabulary(paths: tuple[str, ...]) -> Vocabulary:
    return Vocabulary(paths)


def runs(first: np.ndarray, take: np.ndarray) -> np.ndarray:
    """The numbers from each ``first`` on, as many as ``take`` says."""
    return np.arange(take.sum()) + np.repeat(first - (np.cumsum(take) - take), take)


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of runs of ``values`` between neighbouring ``bounds``; runs may be empty."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[bounds[1:]] - total[bounds[:-1]]


def repeated(codes: np.ndarray, doc: np.ndarray, n_codes: int, window: int = WINDOW) -> np.ndarray:
    """Which words lie in a window of words that the same text holds twice or more."""
    n = len(codes) - window + 1
    hit = np.zeros(len(codes) + 1, np.int64)
    if n > 0:
        inside = np.flatnonzero(doc[:n] == doc[window - 1 :])
        if window == 5 and n_codes < 1 << 21 and doc[-1] < 1 << 21:
            c = [codes[inside + k] for k in range(5)]
            keys = [(c[0] << 42) | (c[1] << 21) | c[2], (doc[inside] << 42) | (c[3] << 21) | c[4]]
        else:
            keys = [codes[inside + k] for k in range(window)] + [doc[inside]]
        mixed = np.zeros(len(inside), np.uint64)
        for k in keys:
            mixed = mix64(mixed + k.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(mixed)
        near = mixed[order][1:] == mixed[order][:-1]
        equal = near.copy()
        for k in keys:
            equal &= k[order][1:] == k[order][:-1]
        if (equal != near).any():  # two windows with one hash: sort by the windows themselves
            order = np.lexsort(keys)
            equal = np.logical_and.reduce([k[order][1:] == k[order][:-1] for k in keys])
        twice = np.zeros(len(inside), bool)
        twice[order[1:][equal]] = True
        twice[order[:-1][equal]] = True
        at = inside[twice]
        hit[at] += 1
        hit[at + window] -= 1
    return np.cumsum(hit)[:-1] > 0


def dup_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    if b"\n" not in text:
        return 0
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def wrong_letters(text: bytes) -> int:
    """Letters that a wrong encoding has spoilt: replacement characters, or those that become UTF-8 again as bytes of a code page."""
    if text.isascii():
        return 0
    whole, lost = text.decode("utf-8", "replace"), text.count(b"\xef\xbf\xbd")
    for page in CODE_PAGES:
        try:
            return max(lost, len(whole) - len(whole.encode(page).decode("utf-8")))
        except UnicodeError:
            continue
    return lost


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MEASURES = ("chars_per_token", "byte_share", "token_entropy")
SIZE = "n_tokens"


def named(measure: str, k: int) -> str:
    """The column of a measure by the vocabulary with number ``k``: the first has the plain name, then _2 and so on."""
    return measure if k == 0 else f"{measure}_{k + 1}"


def measure(texts: list[bytes], vocab: Vocabulary) -> dict[str, np.ndarray]:
    """The plain counts, and what each vocabulary measures of each text."""
    words = [x.split() for x in texts]  # bytes are split on ASCII white space only
    n_words = np.fromiter(map(len, words), np.int64, len(words))
    bounds = np.concatenate(([0], np.cumsum(n_words)))
    flat = [w for ws in words for w in ws]
    distinct = {w: i for i, w in enumerate(dict.fromkeys(flat))}
    codes = np.fromiter(map(distinct.__getitem__, flat), np.int64, len(flat))
    doc = np.repeat(np.arange(len(texts)), n_words)
    names = list(distinct)
    lengths = np.fromiter(map(len, names), np.int64, len(names))
    raw = np.frombuffer(b"".join(names), np.uint8)
    chars = sums((raw & 0xC0) != 0x80, np.concatenate(([0], np.cumsum(lengths))))
    word_chars = sums(chars[codes], bounds)
    out = {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": np.array([len(x) - len(x.translate(None, SYMBOLS)) for x in texts], np.int64),
        "n_dup_lines": np.array([dup_lines(x) for x in texts], np.int64),
        "n_repeat_words": sums(repeated(codes, doc, len(names)), bounds),
    }
    for k, (tool, (ids, n_ids)) in enumerate(zip(vocab.tools, vocab.encode(names))):
        starts = np.concatenate(([0], np.cumsum(n_ids)))
        take = n_ids[codes]
        tokens = sums(take, bounds)
        keys = np.sort(np.repeat(doc, take) * tool.size + ids[runs(starts[codes], take)])
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        times = np.diff(np.concatenate((first, [len(keys)]))) if len(keys) else first
        loss = np.bincount(keys[first] // tool.size, times * np.log2(np.maximum(times, 1)), len(texts))
        some = np.maximum(tokens, 1)
        out |= {
            named("chars_per_token", k): word_chars / some,
            named("byte_share", k): sums(sums(tool.is_byte[ids], starts)[codes], bounds) / some,
            named("token_entropy", k): np.maximum(np.log2(some) - loss / some, 0.0),
            named(SIZE, k): tokens,
        }
    return out


def within(band: Band, chars_per_token: float, byte_share: float, token_entropy: float, n_tokens: int) -> bool:
    least = min(band.entropy_low, SHORT * math.log2(max(n_tokens, 1)))
    return band.chars_low <= chars_per_token <= band.chars_high and byte_share <= band.bytes_high and token_entropy >= least


def judge(
    df: DataFrame,
    paths: str | Sequence[str],
    text_col: str = "text",
    lang_col: str | None = "lang",
    bands: Mapping[str, Mapping[str, Band]] = BANDS,
) -> DataFrame:
    """Add counts, measures by each vocabulary, the band's name, ``base_failed`` and ``kept`` to every row.

    ``paths`` are SentencePiece models and files of byte-level ranks (``.tiktoken``); a text is kept if it
    lies in the bands of all of them.  Measures by the second vocabulary have names that end in _2.
    A null text counts as empty and fails the plain rules.  A null or unlisted language falls back to
    the script.  Rows are judged one by one, so repeated rows get equal verdicts and nothing is
    shuffled.  Columns that bear the name of a result are replaced.
    """
    paths = (paths,) if isinstance(paths, str) else tuple(paths)
    measures = [named(m, k) for k in range(len(paths)) for m in MEASURES]
    added = {**dict.fromkeys(COUNTS, "bigint"), **dict.fromkeys(measures, "double"), "band": "string", "base_failed": "boolean", "kept": "boolean"}
    df = df.drop(*(c for c in added if c not in (text_col, lang_col)))
    kept = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = Vocabulary(paths)  # of this task (it loads in 0.15 s), so that a worker that goes on to other stages doesn't hold it
        languages = {x for kind in bands.values() for x in kind} - set(SCRIPT_BANDS)
        for batch in batches:
            for part in blocks(batch, text_col, 2_000_000):
                texts = utf8(part.column(part.schema.get_field_index(text_col)))
                langs = part.column(part.schema.get_field_index(lang_col)).to_pylist() if lang_col else [None] * len(texts)
                m = measure(texts, vocab)
                names = [x if x in languages else script(t) for x, t in zip(langs, texts)]
                failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
                good = [WRONG * wrong_letters(t) <= n for t, n in zip(texts, m["n_words"].tolist())]
                for k, tool in enumerate(vocab.tools):
                    own = bands[tool.kind]
                    rows = zip(*(m[named(x, k)].tolist() for x in (*MEASURES, SIZE)))
                    good = [g and within(own[n], *row) for g, n, row in zip(good, names, rows)]
                out = [pa.array(m[k], pa.int64()) for k in COUNTS] + [pa.array(m[k], pa.float64()) for k in measures]
                out += [pa.array(names, pa.string()), pa.array(failed), pa.array(~failed & np.array(good, bool))]
                yield pa.RecordBatch.from_arrays([*part.columns, *out], names=[*kept, *added])

    return df.mapInArrow(tidied(run), ", ".join([*(f"`{n}` {t}" for n, t in df.dtypes), *(f"`{n}` {t}" for n, t in added.items())]))


def verdicts(judged: DataFrame) -> DataFrame:
    measures = [c for c in judged.columns if c.startswith(MEASURES)]
    return judged.select(F.col("doc_id").cast("long").alias("doc_id"), *COUNTS, *measures, "band", "base_failed", "kept")
