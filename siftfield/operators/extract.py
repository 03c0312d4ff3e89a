"""Regex extraction into typed columns. Patterns are Java's; ``(?iu)`` folds accents in both cases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftfield.functions.text import Lexicon, contains_any, first_match
from siftfield.lexicons import DOSE_PATTERNS, FORMULATIONS, STAGES, UNITS

NUMBER = r"(\d+(?:[.,]\d+)?)"
BRAND = rf"(?U)\b(\p{{Lu}}[\p{{L}}\d]+(?:\s+\d+)?\s+(?:{'|'.join(FORMULATIONS)}))\b"
LABELLED = r"(?iu)(?:producto|nombre comercial)\s*:\s*([\p{L}\d]+(?: [\p{L}\d]+){0,2})"
INGREDIENT_PATTERNS = [r"(?iu)ingrediente activo\s*:?\s*([\p{L}-]+)\s+(\d+(?:[.,]\d+)?)\s*%", r"(?iu)([\p{L}-]{4,})\s+(\d+(?:[.,]\d+)?)\s*%\s*p/[pv]"]
RANGE = rf"(?iu){NUMBER}(?:\s*(?:-|–|a)\s*{NUMBER})?\s*(kg|lt?|g|cc|ml)\s*/\s*h[aá]"


def distinct_matches(text: Column, patterns: Sequence[str], group: int = 0) -> Column:
    """All matches of all patterns, the first of each kept in its place."""
    return F.array_distinct(F.flatten(F.array(*(F.regexp_extract_all(text, F.lit(p), F.lit(group)) for p in patterns))))


def first_capture(text: Column, patterns: Sequence[str], group: int = 0) -> Column:
    return F.coalesce(*(F.nullif(F.regexp_extract(text, p, group), F.lit("")) for p in patterns))


def name_from_filename(name: Column, known: Lexicon = ()) -> Column:
    """A known product's name, else the file name up to its first run of marks and digits, in capitals."""
    base = F.regexp_replace(name, r"(?i)^.*[/\\]|\.(pdf|txt|docx?|md|html?)$", "")
    cut = F.regexp_replace(base, r"[_\-\d]{4,}.*$", "")
    plain = F.upper(F.trim(F.regexp_replace(F.translate(cut, "_-", "  "), r"\s+", " ")))
    return F.coalesce(first_match(base, known), plain) if known else plain


def short_name(name: Column) -> Column:
    """The first word of a file's name, in capitals."""
    base = F.regexp_replace(name, r"(?i)\.(pdf|txt|docx?|md)$", "")
    return F.upper(F.split(F.trim(F.translate(base, "_-#", "   ")), r"\s+")[0])


def display_name(name: Column) -> Column:
    return F.initcap(F.translate(F.regexp_replace(name, r"(?i)\.pdf$", ""), "_-", "  "))


def product_names(text: Column, valid, patterns: Sequence[str] = (BRAND, LABELLED), file_name: Column | None = None) -> Column:
    """Valid names in order of first sight, in capitals; the file's own name comes first if it is new."""
    found = F.array_distinct(F.transform(F.filter(distinct_matches(text, patterns, 1), valid), lambda n: F.upper(F.trim(n))))
    if file_name is None:
        return found
    own = name_from_filename(file_name)
    return F.when(F.array_contains(found, own) | (own == ""), found).otherwise(F.concat(F.array(own), found))


def formulation(name: Column) -> Column:
    return F.upper(F.regexp_extract(name, rf"(?i)\b({'|'.join(FORMULATIONS)})\b", 1))


def active_ingredient(text: Column, patterns: Sequence[str] = tuple(INGREDIENT_PATTERNS)) -> Column:
    """``name number%`` of the first pattern that matches."""
    return F.coalesce(*(F.when(F.regexp_extract(text, p, 1) != "", F.concat(F.regexp_extract(text, p, 1), F.lit(" "), F.regexp_extract(text, p, 2), F.lit("%"))) for p in patterns))


def dose(text: Column, pattern: str = RANGE) -> Column:
    """struct(low, high, unit, display): the first amount per area; without upper bound high is null."""
    low, high, unit = (F.nullif(F.regexp_extract(text, pattern, k), F.lit("")) for k in (1, 2, 3))
    unit = F.when(F.lower(unit).isin("l", "lt"), "L/ha").when(unit.isNotNull(), F.concat(F.lower(unit), F.lit("/ha")))
    display = F.when(low.isNotNull(), F.concat_ws(" ", F.concat_ws("-", low, high), unit))
    return F.struct(F.translate(low, ",", ".").cast("double").alias("low"), F.translate(high, ",", ".").cast("double").alias("high"), unit.alias("unit"), display.alias("display"))


def dose_text(text: Column, style: str = "dash", pattern: str = RANGE) -> Column:
    """struct(range, unit) in the forms that different crops' records have.

    dash: ``low-high``, and ``low-`` without an upper bound; bare: without one, low alone and no unit;
    spaced: ``low - high``, or low alone, and always the unit.
    """
    d, (low, high) = dose(text, pattern), (F.nullif(F.regexp_extract(text, pattern, k), F.lit("")) for k in (1, 2))
    both = {"dash": F.concat(low, F.lit("-"), F.coalesce(high, F.lit(""))), "bare": F.concat_ws("-", low, high), "spaced": F.concat_ws(" - ", low, high)}[style]
    unit = F.when(high.isNull(), "").otherwise(d["unit"]) if style == "bare" else d["unit"]
    return F.struct(F.when(low.isNotNull(), both).alias("range"), F.when(low.isNotNull(), unit).alias("unit"))


def unit_in(text: Column, units: Sequence[str] = tuple(UNITS)) -> Column:
    return F.coalesce(*(F.when(F.contains(F.lower(text), F.lit(u.lower())), u) for u in units))


def timing(text: Column) -> Column:
    return first_capture(text, [r"(?iu)(?:aplicar|aplicación)\s+(?:en|desde|durante)\s+[^.\n]{3,60}", r"(?iu)(?:pre|post)-?\s?emergencia"])


def precautions(text: Column) -> Column:
    return distinct_matches(text, [r"(?iu)(?:no aplicar|evitar)[^.\n]{3,120}", r"(?iu)período de carencia[^.\n]{0,80}"])


def targets(text: Column, patterns: Sequence[str]) -> Column:
    return distinct_matches(F.lower(text), patterns)


def crops(text: Column, patterns: Sequence[str]) -> Column:
    return distinct_matches(F.lower(text), patterns)


def water_volume(text: Column) -> Column:
    return first_capture(text, [r"(?iu)\d+(?:\s*-\s*\d+)?\s*(?:l|lt|litros)\s+de\s+agua(?:\s*(?:/|por)\s*h(?:a|ectárea))?"])


def stage(text: Column) -> Column:
    """The crop's stage; "pre" stands before "post" in the list and so wins."""
    return first_match(text, STAGES, "no especificada")


def relevant_crops(text: Column, pattern: str) -> Column:
    """Distinct matches in title case, sorted and joined."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.initcap(x)))), ", ")


def product_records(docs: DataFrame, key: str, text_col: str, valid, crop_patterns: Sequence[str], target_patterns: Sequence[str]) -> DataFrame:
    """One row per document and product name; what the text says holds for all its names."""
    text = F.col(text_col)
    fields = {
        "active_ingredient": active_ingredient(text), "dose": dose(text), "targets": targets(text, target_patterns), "crops": crops(text, crop_patterns),
        "timing": timing(text), "precautions": precautions(text), "water_volume": water_volume(text), "stage": stage(text),
    }
    rows = docs.select(key, F.explode(product_names(text, valid)).alias("product"), *(c.alias(n) for n, c in fields.items()))
    return rows.withColumn("formulation", formulation(F.col("product")))


def structured_lines(lines: DataFrame, crop_pattern: str, shortest: int = 100) -> DataFrame:
    """Long lines with a relevant crop and an amount: crops, low and high (points for commas), L/ha."""
    line = F.col("line")
    rows = lines.filter(F.length(F.trim("line")) >= shortest).withColumn("crops", relevant_crops(line, crop_pattern)).withColumn("d", dose(line))
    return rows.filter((F.col("crops") != "") & F.col("d.low").isNotNull()).select(*lines.columns, "crops", F.col("d.low").alias("dose_low"), F.coalesce("d.high", "d.low").alias("dose_high"), F.coalesce("d.unit", F.lit("L/ha")).alias("unit"))


def history_question(content: Column) -> Column:
    """The first user turn of a tagged chat history, where the content is a task prompt."""
    return F.when(content.startswith("### Task:"), F.nullif(F.regexp_extract(content, r"(?s)<chat_history>.*?USER:\s*(.*?)\s*(?:ASSISTANT:|</chat_history>)", 1), F.lit("")))


def has_dose(text: Column, patterns: Sequence[str] = tuple(DOSE_PATTERNS)) -> Column:
    return contains_any(text, ["dosis"]) | F.coalesce(F.lit(False), *(text.rlike(p) for p in patterns))
