"""Text columns: ordered lexicons, whole words, counts, titles."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable, Sequence
from functools import lru_cache, reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: An ordered lexicon: a key and the variants by which a text names it.
Lexicon = Sequence[tuple[str, Sequence[str]]]

#: White space in all scripts and the separators of ASCII, for the inside of a character class.
SPACES = r"\x09-\x0D\x1C-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


@lru_cache(maxsize=1)
def accents() -> tuple[str, str]:
    """Characters with marks and what is left of them, in one string each; marks alone, at the end, have nothing left.

    By Unicode's canonical decompositions; a character that leaves several others stays as it is.
    """
    letters, plain, marks = [], [], []
    for code in range(0x80, 0x30000):
        c = chr(code)
        if unicodedata.category(c) in ("Mn", "Mc", "Me"):
            marks.append(c)
            continue
        base = unicodedata.normalize("NFC", "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) not in ("Mn", "Mc", "Me")))
        if base != c and len(base) == 1:
            letters.append(c)
            plain.append(base)
    return "".join(letters + marks), "".join(plain)


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(or_, conditions, F.lit(False))


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(and_, conditions, F.lit(True))


def contains_any(text: Column, words: Iterable[str]) -> Column:
    """Whether the text, in lower case, holds one of the words anywhere (not only as a whole word)."""
    low = F.lower(text)
    return F.coalesce(any_of(low.contains(w.lower()) for w in words), F.lit(False))


def matches_any(text: Column, patterns: Iterable[str]) -> Column:
    return F.coalesce(any_of(text.rlike(p) for p in patterns), F.lit(False))


def first_match(text: Column, lexicon: Lexicon, default: str | None = None) -> Column:
    """The first key, in the lexicon's order, of which a variant occurs."""
    return F.coalesce(*(F.when(contains_any(text, variants), key) for key, variants in lexicon), F.lit(default))


def all_matches(text: Column, lexicon: Lexicon) -> Column:
    """All keys that occur, sorted."""
    return F.array_sort(F.array_compact(F.array(*(F.when(contains_any(text, variants), key) for key, variants in lexicon))))


def list_matches(text: Column, words: Sequence[str], sep: str = ", ") -> Column:
    """The words that occur, in the list's order, in title case and joined."""
    return F.concat_ws(sep, *(F.when(contains_any(text, [w]), F.initcap(F.lit(w))) for w in words))


def whole_word(text: Column, word: str) -> Column:
    return text.rlike(rf"(?iuU)\b\Q{word}\E\b")


def two_pass_match(text: Column, lexicon: Lexicon, suppressed: Sequence[tuple[str, str]] = ()) -> Column:
    """The first key named by a whole word, else the first whose variant occurs at all.

    ``suppressed``: pairs of a variant and a word in whose presence that variant doesn't count.
    """
    hushed = dict(suppressed)

    def hit(variant: str, test: Column) -> Column:
        return test & ~contains_any(text, [hushed[variant]]) if variant in hushed else test

    whole = [F.when(any_of(hit(v, whole_word(text, v)) for v in vs), k) for k, vs in lexicon]
    loose = [F.when(any_of(hit(v, contains_any(text, [v])) for v in vs), k) for k, vs in lexicon]
    return F.coalesce(*whole, *loose)


def gated_match(text: Column, gate: Sequence[str], lexicon: Lexicon) -> Column:
    """:func:`first_match`, where a word of the gate occurs."""
    return F.when(contains_any(text, gate), first_match(text, lexicon))


def captured(text: Column, patterns: Sequence[str], stop_words: Sequence[str] = ()) -> Column:
    """The first capture of the ordered patterns that isn't a stop word, in title case."""
    found = []
    for p in patterns:
        value = F.trim(F.regexp_extract(text, p, 1))
        found.append(F.when((value != "") & ~F.lower(value).isin(list(stop_words)), F.initcap(value)))
    return F.coalesce(*found)


def words(text: Column) -> Column:
    """Words of a text; a blank text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def count_of(text: Column, term: str) -> Column:
    """How often a term occurs, without overlaps."""
    return ((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(term), F.lit("")))) / len(term.encode())).cast("int")


def count_all(text: Column, terms: Sequence[str]) -> Column:
    """The occurrences of all terms together, each counted without overlaps of its own."""
    return once(text, lambda x: sum((count_of(x, t) for t in terms), F.lit(0)))


def fold_accents(text: Column) -> Column:
    """The text without accents and other marks, in any script."""
    return F.translate(text, *accents())


def fixed(number: Column, digits: int) -> Column:
    """A number with so many decimals, rounded by its exact value, ties to even, as Python and C do (Java's ``%f`` rounds
    the shortest decimal form, half up)."""
    return F.call_function("format_number", number.cast("double"), F.lit("0." + "0" * digits))


def joined(rows: Column, field: str, sep: str) -> Column:
    """One field of an array of structs, sorted by the struct, joined."""
    return F.array_join(F.transform(F.sort_array(rows), lambda x: x[field]), sep)
