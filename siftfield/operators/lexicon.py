"""Lexicon matching against tables, and the filters built on it."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from siftfield.functions.text import all_of, any_of, contains_any, words

#: Rows of a term list that may go to every task; characters of a gram by which longer lists are joined.
SMALL_LEXICON, GRAM = 100_000, 4
#: Counters of the table that tells how common grams are.
COUNTERS = 1 << 18


def small(table: DataFrame, most: int = SMALL_LEXICON) -> DataFrame:
    """A table with a broadcast hint, if it is known to be short."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def occurring(df: DataFrame, key_cols: Sequence[str], text: Column, terms: DataFrame, term_col: str) -> DataFrame:
    """key_cols and the columns of ``terms``: a row for each term that occurs in a row's text (not null, not empty).

    Up to SMALL_LEXICON terms go to every task, as one automaton that reads each text once.  Longer lists meet
    the texts in a join: each term stands under the rarest of its grams of up to GRAM characters, by the number of texts
    that have it, and where a text has that gram the whole term is looked for.  So terms are never compared with all
    texts, a common beginning gathers nothing, and a gram that very many texts have is split by the adaptive planner.
    """
    terms = terms.filter(F.length(term_col) > 0)
    rows = terms.select(term_col).distinct().limit(SMALL_LEXICON + 1).collect()
    keyed = df.select(*key_cols, text.alias("text_"))
    if len(rows) <= SMALL_LEXICON:
        shared = df.sparkSession.sparkContext.broadcast([r[0] for r in rows])

        @F.pandas_udf(ArrayType(StringType()))
        def found(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            import ahocorasick

            machine = ahocorasick.Automaton()
            for term in shared.value:
                machine.add_word(term, term)
            if shared.value:
                machine.make_automaton()
            for batch in texts:
                yield pd.Series([sorted({x for _, x in machine.iter(t)}) if t and shared.value else [] for t in batch], dtype=object)

        hits = keyed.select(*key_cols, F.explode(found("text_")).alias(term_col))
        return hits.join(small(terms), term_col)
    sizes = [r[0] for r in terms.select(F.least(F.length(term_col), F.lit(GRAM)).alias("n")).distinct().collect()]
    placed = posted(terms, term_col, gram_counts(keyed, "text_", sizes))
    met = keyed.select(*key_cols, F.explode(grams_of(F.col("text_"), sizes)).alias("gram_")).hint("rebalance").join(placed, "gram_").drop("gram_")
    on = [keyed[c].eqNullSafe(met[c]) for c in key_cols]
    return met.join(keyed, on).filter(F.contains("text_", F.col(term_col))).select(*(met[c] for c in met.columns))


def grams_of(text: Column, sizes: Sequence[int]) -> Column:
    """The different grams of these sizes in a text."""
    of_size = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, n))
    return F.array_distinct(F.flatten(F.array(*map(of_size, sizes))))


def counter(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(COUNTERS)).cast("int")


def gram_counts(texts: DataFrame, text_col: str, sizes: Sequence[int]) -> DataFrame:
    """counter_, texts_: in how many texts the grams of each of COUNTERS counters stand (a gram may share one), so the
    table has a fixed size."""
    return texts.select(F.explode(grams_of(F.col(text_col), sizes)).alias("g")).groupBy(counter(F.col("g")).alias("counter_")).agg(F.count("*").alias("texts_"))


def posted(terms: DataFrame, term_col: str, counts: DataFrame) -> DataFrame:
    """The terms with ``gram_``, the gram of each that the fewest texts have; a hash decides among equals, so that terms
    with a common part are dealt over their other grams."""
    size = F.least(F.length(term_col), F.lit(GRAM))
    every = F.transform(F.sequence(F.lit(1), F.length(term_col) - size + 1), lambda i: F.substring(F.col(term_col), i, size))
    rows = terms.select(term_col).distinct().select(term_col, F.explode(F.array_distinct(every)).alias("g"))
    rare = rows.withColumn("counter_", counter(F.col("g"))).join(F.broadcast(counts), "counter_", "left")
    rarest = rare.groupBy(term_col).agg(F.min(F.struct(F.coalesce("texts_", F.lit(0)).alias("n"), F.xxhash64("g", term_col).alias("by"), F.col("g"))).alias("x"))
    return terms.join(rarest.select(term_col, F.col("x.g").alias("gram_")), term_col)


def first_match_table(df: DataFrame, text_col: str, lexicon: DataFrame, key_cols: Sequence[str], default: str | None = None) -> DataFrame:
    """Add ``match``: the key with the lowest ``ord`` of which a variant occurs (lexicon: ord, key, variant)."""
    terms = lexicon.select("ord", F.col("key").alias("key_"), F.lower("variant").alias("variant_"))
    hits = occurring(df, key_cols, F.lower(F.col(text_col)), terms, "variant_").groupBy(*key_cols).agg(F.min_by("key_", "ord").alias("match"))
    return df.join(hits, list(key_cols), "left").withColumn("match", F.coalesce("match", F.lit(default)))


def mentions(df: DataFrame, text_col: str, variants: Sequence[str]) -> DataFrame:
    """Hits whose text mentions any variant; meant to run after a top-k, as it changes what is in it."""
    return df.filter(contains_any(F.col(text_col), variants))


def from_sources(df: DataFrame, file_col: str, variants: Sequence[str]) -> DataFrame:
    """Strict: hits whose file name holds a variant, none if there is none."""
    return df.filter(contains_any(F.col(file_col), variants))


def valid_name(
    name: Column, stop_words: Sequence[str] = (), units: Sequence[str] = ("kg", "ml", "lt", "gr", "cc"), formulations: Sequence[str] = ("wp", "ec", "sc", "sl", "wg", "se", "ew"),
    max_words: int = 4, phrases: Sequence[str] = (), short: int = 5,
) -> Column:
    """Whether a text may be a product's name: long enough, not all stop words, no digit or unit first,
    short names only with a formulation code, at most two groups of digits and ``max_words`` words."""
    low = F.lower(F.trim(name))
    parts = words(low)
    checks = [
        F.length(low) >= 3,
        ~F.forall(parts, lambda w: w.isin(list(stop_words))) if stop_words else F.lit(True),
        ~low.rlike(r"^\d"),
        ~low.rlike(rf"^({'|'.join(units)})\b"),
        (F.length(low) >= short) | any_of(low.contains(f) for f in formulations),
        F.regexp_count(low, F.lit(r"\d+")) <= 2,
        F.size(parts) <= max_words,
        ~contains_any(low, phrases),
    ]
    return F.coalesce(all_of(checks), F.lit(False))


def unprocessed(df: DataFrame, name_col: str, processed: DataFrame, product_col: str) -> DataFrame:
    """Files whose name holds none of the processed products (null names and products hold none)."""
    known = processed.select(F.lower(product_col).alias("product_")).filter("product_ <> ''").distinct()
    names = df.select(F.lower(F.col(name_col)).alias("name_")).filter("name_ is not null").distinct()
    done = occurring(names, ["name_"], F.col("name_"), known, "product_").select("name_").distinct()
    return df.join(done, F.lower(F.col(name_col)) == F.col("name_"), "left_anti")


def allowed(df: DataFrame, key: str, allow: DataFrame) -> DataFrame:
    """Rows whose key is in the list; an empty list allows all."""
    return df if allow.isEmpty() else df.join(small(allow.select(key).distinct()), key, "left_semi")


def long_enough(df: DataFrame, text_col: str, least: int = 50) -> DataFrame:
    return df.filter(F.length(F.trim(F.col(text_col))) > least)


def candidates(df: DataFrame, priorities: Sequence[str] = ("HIGH", "MEDIUM")) -> DataFrame:
    return df.filter(F.col("priority").isin(list(priorities)))


def without_own_replies(df: DataFrame, text_col: str, marks: Sequence[str]) -> DataFrame:
    """Drop messages that are earlier replies of the system, told by their marks."""
    return df.filter(~contains_any(F.col(text_col), marks))
