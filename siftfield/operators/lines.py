"""Operators on the lines of a text, within the row that holds it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftfield.functions.text import all_of, any_of, contains_any, joined, matches_any

#: Marks of a line that belongs to a table, case-sensitive. Fixed values.
TABLE_MARKS = ("|", "CULTIVO", "DOSIS", "MALEZAS", "OBSERVACIONES", "kg/ha", "l/ha", "g/ha", "L/há", "kg/há", "g/há")


def explode_lines(df: DataFrame, key: str, text_col: str) -> DataFrame:
    """key, line_no (from 1), line."""
    return df.select(key, F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("pos", "line")).select(key, (F.col("pos") + 1).alias("line_no"), "line")


def mention_lines(lines: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """Each line that any pattern matches, once."""
    return lines.filter(matches_any(F.col("line"), patterns)).withColumn("mention", F.concat(F.lit("Línea "), F.col("line_no").cast("string"), F.lit(": "), F.trim("line")))


def direct_evidence(lines: DataFrame, crop: str, patterns: Sequence[str], once_per_line: bool = True) -> DataFrame:
    """Lines that name the crop and match a dose pattern: once, or once for each pattern."""
    named = lines.filter(F.col("line").rlike(crop))
    if once_per_line:
        return named.filter(matches_any(F.col("line"), patterns)).withColumn("pattern", F.lit(None).cast("int"))
    hits = F.array_compact(F.array(*(F.when(F.col("line").rlike(p), F.lit(i)) for i, p in enumerate(patterns))))
    return named.withColumn("pattern", F.explode(hits))


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once per row.

    They come out of a generator, so that the optimizer doesn't write them into the lambdas that use them,
    where they would be computed again for each line.
    """
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def lines_of(df: DataFrame, key: str, text_col: str, trimmed: bool = False) -> DataFrame:
    """key, lines_: a document's lines in one array; the operators below work on it without a shuffle."""
    lines = F.split("text_", "\n", -1)
    return settled(df.select(key, F.col(text_col).alias("text_")), lines_=F.transform(lines, lambda x: F.trim(x)) if trimmed else lines).drop("text_")


def numbered(keep) -> Column:
    """The lines (line_no from 1, line) for which ``keep`` (line, place from 0) holds."""
    rows = F.transform("lines_", lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("line")))
    return F.filter(rows, lambda r: keep(r["line"], r["line_no"] - 1))


def context_evidence(df: DataFrame, key: str, text_col: str, crop: str, patterns: Sequence[str], radius: int = 3) -> DataFrame:
    """key, line_no, line: dose lines that don't name the crop, with the crop named at most ``radius`` lines away."""
    rows = settled(lines_of(df, key, text_col), named_=F.transform("lines_", lambda x: x.rlike(crop)))
    at = lambda i: F.coalesce(F.get("named_", i), F.lit(False))
    near = lambda i: any_of(at(i + k) for k in range(-radius, radius + 1) if k)
    return rows.select(key, F.inline(numbered(lambda x, i: ~at(i) & near(i) & matches_any(x, patterns))))


def heading_dose(df: DataFrame, key: str, text_col: str, crop: str, patterns: Sequence[str], units: Sequence[str], longest: int = 50, ahead: int = 4, back: int = 2, first_character: bool = False) -> DataFrame:
    """key, line_no, dose, unit: the first short line naming the crop with a number in the next lines.

    The number is the first pattern's in the nearest line (the whole match); the unit comes from the
    lines around.  ``first_character`` keeps but that of a match without a range, as one of the crops has it.
    """
    found = lambda x: F.coalesce(*(F.nullif(F.regexp_extract(x, p, 0), F.lit("")) for p in patterns))
    rows = settled(lines_of(df, key, text_col), doses_=F.transform("lines_", found))
    dose = lambda i: F.coalesce(*(F.get("doses_", i + k) for k in range(1, ahead + 1)))
    around = lambda i: F.lower(F.concat_ws(" ", *(F.get("lines_", i + k) for k in range(-back, ahead + 1))))
    heads = settled(rows, head_=F.get(numbered(lambda x, i: x.rlike(crop) & (F.length(F.trim(x)) < longest) & dose(i).isNotNull()), F.lit(0))).filter("head_ is not null")
    i = F.col("head_.line_no") - 1
    number = F.when(dose(i).rlike(r"\d\s*-\s*\d"), dose(i)).otherwise(F.substring(dose(i), 1, 1)) if first_character else dose(i)
    unit = F.coalesce(*(F.when(F.contains(around(i), F.lit(u.lower())), F.lit(u)) for u in units), F.lit(""))
    return heads.select(key, "head_.line_no", number.alias("dose"), unit.alias("unit"))


def with_heading_dose(products: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Write the dose under a crop's heading (:func:`heading_dose`) over that of all products of the document."""
    rows = products.join(found.select(key, F.col("dose").alias("dose_"), F.col("unit").alias("unit_")), key, "left")
    return rows.withColumns({"dose": F.coalesce("dose_", "dose"), "unit": F.coalesce(F.nullif("unit_", F.lit("")), "unit")}).drop("dose_", "unit_")


def table_like(line: Column, marks: Sequence[str] = TABLE_MARKS) -> Column:
    return any_of(line.contains(m) for m in marks)


def with_section(df: DataFrame, out: str, start: Sequence[str], stop: Sequence[str] = (), marks: Sequence[str] = TABLE_MARKS, keep_heading: bool = False, longest: int | None = None) -> DataFrame:
    """Add ``out``, the lines (line_no, line) after the first heading up to a stop word or a table-like line, to
    rows with trimmed lines_."""
    ends = lambda x: (x != "") & (table_like(x, marks) | contains_any(x, stop) | (F.length(x) > longest if longest else F.lit(False)))
    rows = settled(df, begins_=F.transform("lines_", lambda x: contains_any(x, start)))
    rows = settled(rows, from_=F.array_position("begins_", True).cast("int"))
    last = F.get(numbered(lambda x, i: (i >= F.col("from_")) & ~F.get("begins_", i) & ends(x)), F.lit(0))["line_no"]
    rows = settled(rows, to_=F.when(F.col("from_") > 0, last))
    inside = numbered(lambda x, i: (F.col("from_") > 0) & (i + 1 >= F.col("from_")) & (F.col("to_").isNull() | (i + 1 < F.col("to_"))) & (x != "") & (F.lit(True) if keep_heading else ~F.get("begins_", i)))
    return settled(rows, **{out: inside}).drop("begins_", "from_", "to_")


def capture_section(df: DataFrame, key: str, text_col: str, start: Sequence[str], stop: Sequence[str] = (), marks: Sequence[str] = TABLE_MARKS, keep_heading: bool = False, longest: int | None = None) -> DataFrame:
    """key, line_no, line: the lines after the first heading up to a stop word or a table-like line.

    Blank lines are skipped; further headings don't end the section and are left out unless kept.
    """
    return with_section(lines_of(df, key, text_col, True), "found_", start, stop, marks, keep_heading, longest).select(key, F.inline("found_"))


def with_descriptions(df: DataFrame, out: str, headings: Sequence[str], marks: Sequence[str] = TABLE_MARKS, shortest: int = 10) -> DataFrame:
    """Add ``out``, what :func:`descriptive_lines` gives, to rows with trimmed lines_.

    Lines become a string of one letter each (heading, table, note, blank); a note counts where it follows a heading,
    with nothing but notes, headings and blanks between.
    """
    kind = lambda x: F.when(x == "", "B").when(contains_any(x, headings), "H").when(table_like(x, marks), "T").otherwise("N")
    marked = F.regexp_replace(F.array_join(F.transform("lines_", kind), ""), r"(?!^)\G[NB]|(?<=H)[NB]", "o")
    text = F.transform("lines_", kind)
    rows = settled(df, on_=F.split(marked, ""), kind_=text)
    wanted = numbered(lambda x, i: (F.get("kind_", i) == "H") | ((F.get("kind_", i) == "N") & (F.get("on_", i) == "o") & (F.length(x) > shortest)))
    line = lambda r: F.when(F.get("kind_", r["line_no"] - 1) == "H", F.concat(F.lit("=== "), F.upper(r["line"]), F.lit(" ==="))).otherwise(r["line"])
    return settled(rows, **{out: F.transform(wanted, lambda r: F.struct(r["line_no"].alias("line_no"), line(r).alias("line")))}).drop("on_", "kind_")


def descriptive_lines(df: DataFrame, key: str, text_col: str, headings: Sequence[str], marks: Sequence[str] = TABLE_MARKS, shortest: int = 10) -> DataFrame:
    """key, line_no, line: headings, in capitals between rules, and the longer lines under them; a table-like line
    suspends the capture until the next heading."""
    return with_descriptions(lines_of(df, key, text_col, True), "found_", headings, marks, shortest).select(key, F.inline("found_"))


def gathered(lines: DataFrame, key: str, sep: str = "\n") -> DataFrame:
    """key, text: lines that have been taken apart, of each document in order, joined."""
    return lines.groupBy(key).agg(F.collect_list(F.struct("line_no", "line")).alias("x")).select(key, joined(F.col("x"), "line", sep).alias("text"))


def with_keywords(df: DataFrame, out: str, keywords: Sequence[str]) -> DataFrame:
    return settled(df, **{out: numbered(lambda x, i: contains_any(x, keywords))})


def keyword_lines(df: DataFrame, key: str, text_col: str, keywords: Sequence[str], sep: str = "\n") -> DataFrame:
    """key, text: the lines that hold a keyword, trimmed and joined, of documents that have some."""
    rows = with_keywords(lines_of(df, key, text_col, True), "found_", keywords)
    return rows.filter(F.size("found_") > 0).select(key, F.array_join("found_.line", sep).alias("text"))


def with_general_info(df: DataFrame, out: str, names: Sequence[str], stop: Sequence[str] = (), marks: Sequence[str] = TABLE_MARKS, ahead: int = 9, shortest: int = 20) -> DataFrame:
    """Add ``out``, what :func:`general_info` gives, to rows with trimmed lines_."""
    hit = lambda x: all_of(contains_any(x, [n]) for n in names)
    rows = settled(df, from_=F.array_position(F.transform("lines_", hit), True).cast("int"))
    later = numbered(lambda x, i: (F.col("from_") > 0) & (i >= F.col("from_")) & (i < F.col("from_") + ahead) & (F.length(x) > shortest) & ~table_like(x, marks))
    rows = settled(rows, later_=later)
    rows = settled(rows, to_=F.get(F.filter("later_", lambda r: contains_any(r["line"], stop)), F.lit(0))["line_no"] if stop else F.lit(None).cast("int"))
    first = F.struct(F.col("from_").alias("line_no"), F.get("lines_", F.col("from_") - 1).alias("line"))
    found = F.concat(F.array(first), F.filter("later_", lambda r: F.col("to_").isNull() | (r["line_no"] < F.col("to_"))))
    none = F.array().cast("array<struct<line_no:int,line:string>>")
    return settled(rows, **{out: F.when(F.col("from_") > 0, found).otherwise(none)}).drop("from_", "later_", "to_")


def general_info(df: DataFrame, key: str, text_col: str, names: Sequence[str], stop: Sequence[str] = (), marks: Sequence[str] = TABLE_MARKS, ahead: int = 9, shortest: int = 20) -> DataFrame:
    """key, line_no, line: the first line with all the names, and the longer of the next lines, up to one with a stop word."""
    return with_general_info(lines_of(df, key, text_col, True), "found_", names, stop, marks, ahead, shortest).select(key, F.inline("found_"))


def assemble_pages(pages: DataFrame, key: str, page_col: str, text_col: str, title: str = "PÁGINA") -> DataFrame:
    """key, text: pages in order, each under a marker with its number."""
    row = F.struct(F.col(page_col).alias("page"), F.concat(F.lit(f"\n=== {title} "), F.col(page_col).cast("string"), F.lit(" ===\n"), F.coalesce(text_col, F.lit(""))).alias("text"))
    return pages.groupBy(key).agg(F.collect_list(row).alias("x")).select(key, joined(F.col("x"), "text", "").alias("text"))


def split_pages(docs: DataFrame, key: str, text_col: str, title: str = "PÁGINA", strict_reference: bool = False) -> DataFrame:
    """key, page_number, text: the pages of an assembled text, blank ones left out.

    The number is that of the marker; ``strict_reference`` counts pieces instead, where the blank piece
    before the first marker takes number 1.
    """
    marker = rf"=== {title} (\d+) ==="
    pieces = docs.select(key, F.posexplode(F.split(F.col(text_col), rf"(?==== {title} \d+ ===)")).alias("pos", "piece"))
    number = F.regexp_extract("piece", marker, 1)
    body = F.trim(F.regexp_replace("piece", marker, ""), F.lit(" \n\t\r"))
    rows = pieces.select(key, "pos", F.when(number != "", number.cast("int")).alias("page"), body.alias("text"))
    page = F.col("pos") + 1 if strict_reference else F.coalesce(F.col("page"), F.lit(0))
    return rows.filter("text <> ''").select(key, page.cast("int").alias("page_number"), "text")
