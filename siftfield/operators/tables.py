"""Operators on extracted tables: arrays of rows of nullable cells, the header first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftfield.functions.text import Lexicon, all_matches, contains_any, list_matches
from siftfield.operators.extract import RANGE

DOSE_WORDS = ["dosis", "cultivo", "maleza", "plaga", "kg/ha", "l/ha", "g/ha", "cc/ha", "aplicación", "época", "observaciones"]


def filled(cell: Column) -> Column:
    return cell.isNotNull() & (F.trim(cell) != "")


def column_of(headers: Column, keywords: Sequence[str]) -> Column:
    """Place (from 0) of the first header that holds a keyword, else -1."""
    return (F.array_position(F.transform(headers, lambda h: contains_any(h, keywords)), True) - 1).cast("int")


def cell_at(row: Column, place: Column) -> Column:
    return F.when(place >= 0, F.get(row, place))


def table_rows(df: DataFrame, keys: Sequence[str], cells_col: str) -> DataFrame:
    """keys, row_no (from 1), headers, row: the data rows that aren't empty, of tables with two rows or more."""
    cells = F.col(cells_col)
    body = F.slice(cells, F.lit(2), F.greatest(F.size(cells) - 1, F.lit(0)))
    rows = df.filter(F.size(cells) >= 2).select(*keys, cells[0].alias("headers"), F.posexplode(body).alias("pos", "row"))
    return rows.filter(F.exists("row", filled)).select(*keys, (F.col("pos") + 1).alias("row_no"), "headers", "row")


def labelled_cells(headers: Column, row: Column, sep: str = ": ") -> Column:
    """``header: value`` of every filled cell."""
    pairs = F.zip_with(F.transform(row, lambda c: F.when(filled(c), F.trim(c))), headers, lambda c, h: F.when(c.isNotNull() & filled(h), F.concat(F.trim(h), F.lit(sep), c)))
    return F.array_compact(pairs)


def unit_of_header(header: Column) -> Column:
    """g/100, then kg/ha, then L/ha, then g/ha: the order matters, as kg/ha holds g/ha."""
    low = F.lower(header)
    return F.when(low.contains("g/100"), "g/100 L").when(low.contains("kg/ha"), "kg/ha").when(low.contains("l/ha"), "L/ha").when(low.contains("g/ha"), "g/ha")


def described_rows(rows: DataFrame, weeds: Sequence[str]) -> DataFrame:
    """Add crops, targets, dose, unit, flags and a text for each table row."""
    cell = lambda *words: F.trim(cell_at(F.col("row"), column_of(F.col("headers"), words)))
    dose_at = column_of(F.col("headers"), ["dosis", "dose"])
    flat = F.concat_ws(" ", "row")
    crop_list = F.filter(F.transform(F.split(F.coalesce(cell("cultivo", "crop"), F.lit("")), r"[,\n]"), lambda x: F.trim(x)), lambda x: x != "")
    out = rows.withColumns({
        "crops": F.array_join(crop_list, ", "),
        "targets": F.coalesce(F.nullif(list_matches(flat, weeds), F.lit("")), cell("maleza", "plaga", "target"), F.lit("")),
        "dose": F.coalesce(cell("dosis", "dose"), F.lit("")),
        "unit": F.coalesce(unit_of_header(cell_at(F.col("headers"), dose_at)), unit_of_header(flat), F.lit("")),
    })
    out = out.withColumns({"has_dose": F.col("dose") != "", "has_crop": F.col("crops") != "", "has_target": F.col("targets") != ""})
    line = lambda title, c: F.when(F.col(c) != "", F.concat(F.lit(f"{title}: "), F.col(c)))
    return out.withColumn("text", F.concat_ws("\n", line("Cultivo", "crops"), line("Objetivo", "targets"), line("Dosis", "dose"), line("Unidad", "unit"), F.array_join(labelled_cells(F.col("headers"), F.col("row")), " | ")))


def without_repeats(df: DataFrame, cells_col: str, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the first of tables with one signature: rows, columns, first three headers cut at 10 characters."""
    cells = F.col(cells_col)
    head = F.transform(F.slice(cells[0], 1, 3), lambda h: F.substring(F.coalesce(h, F.lit("")), 1, 10))
    signature = F.concat_ws("_", F.size(cells).cast("string"), F.size(cells[0]).cast("string"), F.array_join(head, "_"))
    first = F.row_number().over(Window.partitionBy(*group, "signature").orderBy(*order))
    return df.withColumn("signature", signature).withColumn("first_", first).filter("first_ = 1").drop("first_")


def is_dose_table(text: Column, words: Sequence[str] = tuple(DOSE_WORDS), least: int = 2) -> Column:
    return F.size(F.array_compact(F.array(*(F.when(contains_any(text, [w]), w) for w in words)))) >= least


def interpreted(headers: Column, row: Column) -> Column:
    """``Dosis: … | Cultivo: … | Maleza: …`` of the cells whose header names one of them."""
    named = lambda title, words: F.when(filled(cell_at(row, column_of(headers, words))), F.concat(F.lit(f"{title}: "), F.trim(cell_at(row, column_of(headers, words)))))
    return F.concat_ws(" | ", named("Dosis", ["dosis"]), named("Cultivo", ["cultivo"]), named("Maleza", ["maleza"]))


def dose_cells(df: DataFrame, keys: Sequence[str], cells_col: str, crops: Lexicon = (), weeds: Lexicon = ()) -> DataFrame:
    """keys, dose, row_no, col_no (from 0, the header is row 0): amounts in cells, each place once; and the
    crops and weeds that the table names (sorted, joined)."""
    whole = F.array_join(F.flatten(F.col(cells_col)), " ")
    named = lambda lex: F.array_join(all_matches(F.coalesce(whole, F.lit("")), lex), ", ") if lex else F.lit("")
    rows = df.select(*keys, named(crops).alias("crops"), named(weeds).alias("weeds"), F.posexplode(cells_col).alias("row_no", "row"))
    rows = rows.select(*keys, "crops", "weeds", "row_no", F.posexplode("row").alias("col_no", "cell"))
    amounts = F.array_distinct(F.regexp_extract_all(F.coalesce("cell", F.lit("")), F.lit(RANGE), F.lit(0)))
    return rows.select(*keys, "row_no", "col_no", F.explode(amounts).alias("dose"), "crops", "weeds").dropDuplicates([*keys, "row_no", "col_no", "dose"])
