"""Chunking of documents, and what a chunk is worth."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftfield.functions.text import count_all, n_words, once
from siftfield.lexicons import RELEVANT_TERMS
from siftfield.operators.extract import structured_lines
from siftfield.operators.lines import lines_of, settled, with_descriptions, with_general_info, with_keywords, with_section
from siftfield.sources.scratch import bounded_batches

SIZE, OVERLAP, SHORTEST = 500, 100, 50
SECTION_TYPES = [
    ("dosage", r"dosis|dosificaci[oó]n"), ("application", r"aplicaci[oó]n|instrucciones"), ("waiting_period", r"carencia"), ("limits", r"m[aá]ximo.*aplicaciones"),
    ("interval", r"intervalo"), ("precautions", r"precauciones|advertencias"), ("composition", r"composici[oó]n"),
]


def word_windows(text: str | None, size: int, share: float, tail: int) -> list[str]:
    """Runs of a text's words, joined: a run closes when its words, each with a space, reach ``size``; a share of its
    words opens the next one.  What is left at the end is a run if it's longer than ``tail``."""
    words, out, start, length = (text or "").split(), [], 0, 0
    for end, word in enumerate(words, 1):
        length += len(word) + 1
        if length >= size:
            out.append(" ".join(words[start:end]))
            start = end - int((end - start) * share)
            length = sum(len(w) + 1 for w in words[start:end])
    left = " ".join(words[start:])
    return [*out, left] if start < len(words) and len(left) > tail else out


def windows_of(df: DataFrame, name: str, text: Column, size: int, share: Column, tail: Column) -> DataFrame:
    """Adds an array of the text's :func:`word_windows`; none of a null text.

    Rows go to Python in Arrow batches of bounded size: a fold over words on the JVM copies its state at every word.
    """
    bounded_batches(df.sparkSession)

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series, shares: pd.Series, tails: pd.Series) -> pd.Series:
        return pd.Series([word_windows(x, size, s, n) for x, s, n in zip(texts, shares, tails)], texts.index, object)

    return df.withColumn(name, cut(text, share.cast("double"), tail.cast("int")))


def word_chunks(df: DataFrame, keys: Sequence[str], text_col: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """keys, chunk_index (from 0), text: overlapping runs of words."""
    rows = windows_of(df.select(*keys, F.col(text_col).alias("text_")), "cut_", F.col("text_"), size, F.lit(overlap / size), F.lit(SHORTEST))
    return rows.select(*keys, F.posexplode("cut_").alias("chunk_index", "text"))


def chunk_id(source: Column, index: Column, text: Column) -> Column:
    return F.concat(F.lit("chunk_"), F.substring(F.md5(F.concat_ws("_", source, index.cast("string"), F.substring(text, 1, 100))), 1, 12))


def sub_chunk_id(index: Column, sub: Column, text: Column) -> Column:
    return F.concat_ws("_", F.lit("chunk"), index.cast("string"), sub.cast("string"), F.substring(F.md5(F.substring(text, 1, 100)), 1, 8))


def section_type(text: Column, types: Sequence[tuple[str, str]] = tuple(SECTION_TYPES), default: str = "general") -> Column:
    return once(F.lower(text), lambda low: F.coalesce(*(F.when(low.rlike(p), k) for k, p in types), F.lit(default)))


def relevance(text: Column, terms: Sequence[str] = tuple(RELEVANT_TERMS)) -> Column:
    """Twice the terms' number per word, 1 at most; 0 for a text without words."""
    n = n_words(text)
    return F.when(n > 0, F.least(2.0 * count_all(F.lower(text), terms) / n, F.lit(1.0))).otherwise(0.0)


def content_quality(text: Column, indicators: Sequence[str]) -> Column:
    """0.3 of the printable share, 0.4 of the share of real words, 0.03 for each indicator (0.4 at most)."""
    n = n_words(text)
    printable = F.length(F.regexp_replace(text, r"[\x00-\x08\x0E-\x1B\x7F]", "")) / F.length(text)
    real = F.regexp_count(text, F.lit(r"(?<!\S)(?=\S*[A-Za-z])\S{2,}")) / n
    score = once(F.lower(text), lambda low: F.least(sum((F.when(low.rlike(p), 0.03).otherwise(0.0) for p in indicators), F.lit(0.0)), F.lit(0.4)))
    return F.when(n > 0, F.least(printable * 0.3 + real * 0.4 + score, F.lit(1.0))).otherwise(0.0)


def semantic_chunks(df: DataFrame, key: str, text_col: str, headings: Sequence[str], size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """key, chunk_index, sub_index, section_type, text, chunk_id, relevance.

    A text is cut before its headings; pieces under 50 characters go, those beyond 1.5 sizes are cut by
    words.  With two pieces or fewer the whole text is cut by words.
    """
    pattern = rf"(?iu)(?:\n\s*)(?=(?:{'|'.join(headings)}).{{0,120}}:?)"
    rows = settled(df.select(key, F.col(text_col).alias("text_")), pieces=F.split("text_", pattern))
    piece = lambda i, x, whole: F.struct(i.cast("int").alias("at"), x.alias("piece"), whole.alias("whole"))
    parts = F.filter(F.transform("pieces", lambda x, i: piece(i, F.trim(x, F.lit(" \n\t\r")), F.lit(False))), lambda p: F.length(p["piece"]) >= SHORTEST)
    rows = rows.select(key, F.inline(F.when(F.size("pieces") <= 2, F.array(piece(F.lit(0), F.col("text_"), F.lit(True)))).otherwise(parts)))
    long = ~F.col("whole") & (F.length("piece") > 1.5 * size)
    by_words = F.when(F.col("whole") | long, F.col("piece"))
    rows = settled(rows, section_type=F.when(F.col("whole"), "character_split").otherwise(section_type(F.col("piece"))), long=long)
    rows = windows_of(rows, "cut_", by_words, size, F.when(F.col("whole"), overlap / size).otherwise(0.2), F.when(F.col("whole"), SHORTEST).otherwise(0))
    rows = rows.select(key, "at", "whole", "long", "section_type", F.posexplode(F.when(F.col("whole") | F.col("long"), F.col("cut_")).otherwise(F.array("piece"))).alias("pos", "text"))
    rows = rows.select(key, F.when(F.col("whole"), F.col("pos")).otherwise(F.col("at")).alias("chunk_index"), F.when(F.col("long"), F.col("pos")).alias("sub_index"), "section_type", "text")
    ids = F.when(F.col("sub_index").isNull(), chunk_id(F.col(key).cast("string"), F.col("chunk_index"), F.col("text"))).otherwise(sub_chunk_id(F.col("chunk_index"), F.col("sub_index"), F.col("text")))
    return rows.withColumn("chunk_id", ids).withColumn("relevance", relevance(F.col("text")))


def best_candidate(df: DataFrame, keys: Sequence[str], order: str, quality: str, fallback: Column | None = None, enough: float = 0.6) -> DataFrame:
    """Of each document's extractions the best, the first on ties.

    Extractions for which ``fallback`` holds count only where no other reaches ``enough``.
    """
    every = F.struct(*df.columns)
    first = lambda keep: F.min_by(F.when(keep, every), F.when(keep, F.struct(-F.coalesce(F.col(quality), F.lit(-1.0)), F.col(order))))
    if fallback is None:
        return df.groupBy(*keys).agg(first(F.lit(True)).alias("x_")).select("x_.*")
    own = F.max(F.when(~fallback, F.col(quality)))
    found = df.groupBy(*keys).agg(own.alias("best_"), first(F.lit(True)).alias("any_"), first(~fallback).alias("own_"))
    return found.select(F.when(F.col("best_") >= enough, F.col("own_")).otherwise(F.col("any_")).alias("x_")).select("x_.*")


def comprehensive_chunks(df: DataFrame, key: str, text_col: str, name: str, headings: Sequence[str]) -> DataFrame:
    """key, content_category, text: general, composition, safety, commercial, descriptive and full document."""
    rows = settled(lines_of(df, key, text_col).withColumnRenamed("lines_", "whole_"), lines_=F.transform("whole_", lambda x: F.trim(x)))
    rows = with_general_info(rows, "general_info", [name], ["composición", "cultivo", "dosis"])
    rows = with_section(rows, "composition", ["composición"], ["lote", "fecha", "autorización"])
    rows = with_section(rows, "safety", ["precauciones", "advertencias", "no aplicar", "peligro"], ["fabricado", "importa", "autorización"], keep_heading=True)
    rows = with_keywords(rows, "commercial", ["fabricado", "importa", "distribuye", "autorización"])
    rows = with_descriptions(rows, "descriptive", headings)
    kinds = ("general_info", "composition", "safety", "commercial", "descriptive")
    chunk = lambda kind, text: F.struct(F.lit(kind).alias("content_category"), text.alias("text"))
    found = F.array(*(chunk(k, F.array_join(F.col(k)["line"], "\n")) for k in kinds), chunk("full_document", F.array_join("whole_", "\n")))
    rows = rows.select(key, F.inline(found))
    return rows.filter("trim(text) <> ''").select(key, "content_category", "text")


def structured_chunks(pages: DataFrame, tables: DataFrame, keys: Sequence[str], text_col: str, crop_pattern: str, fewest: int = 2) -> DataFrame:
    """keys, content_category, text: what the long lines of pages with fewer than ``fewest`` tables say of doses.

    tables: a row per extracted table, with the same keys.
    """
    enough = tables.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") >= fewest)
    few = pages.join(enough, list(keys), "left_anti")
    lines = few.select(*keys, F.posexplode(F.split(text_col, "\n", -1)).alias("pos", "line"))
    found = structured_lines(lines, crop_pattern)
    amount = F.concat_ws(" - ", F.col("dose_low").cast("string"), F.col("dose_high").cast("string"))
    return found.select(*keys, F.lit("structured").alias("content_category"), F.concat(F.lit("Cultivo: "), F.col("crops"), F.lit(" | Dosis: "), amount, F.lit(" "), F.col("unit")).alias("text"))


def file_chunks(table_rows: DataFrame, chunks: DataFrame, key: str, product: Column, structured: DataFrame | None = None) -> DataFrame:
    """Table rows and text chunks of each file in one (and, if given, structured text), with the file's product."""
    out = table_rows.unionByName(chunks, allowMissingColumns=True)
    out = out if structured is None else out.unionByName(structured, allowMissingColumns=True)
    return out.withColumn("product", product)


def page_chunks(products: DataFrame, keys: Sequence[str], name_col: str, flags: dict[str, Column]) -> DataFrame:
    """Per page: product names (sorted), whether any has each flag, and 2.0 per product as its score."""
    found = products.groupBy(*keys).agg(F.array_sort(F.collect_set(name_col)).alias("products"), *(F.bool_or(c).alias(n) for n, c in flags.items()))
    return found.withColumn("content_score", F.size("products") * 2.0)


def stamped(chunks: DataFrame, size: Column) -> DataFrame:
    return chunks.withColumns({"file_size": size, "processed_at": F.current_timestamp()})
