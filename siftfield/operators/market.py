"""Listings of products and web results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftfield.functions.text import Lexicon, contains_any, first_match, joined

SITES = [("MLA", ["argentina"]), ("MLB", ["brasil", "brazil"]), ("MLM", ["méxico", "mexico"]), ("MCO", ["colombia"]), ("MPE", ["perú", "peru"]), ("MLC", ["chile"])]
COMMERCIAL = ["precio", "comprar", "tienda", "oferta", "venta", "shop"]
FAMILIES = [("herbicida", "agroquímico malezas"), ("fungicida", "agroquímico hongos"), ("insecticida", "agroquímico plagas"), ("semilla", "semillas certificadas"), ("fertilizante", "nutrición de cultivos")]


def site_of(query: Column, sites: Lexicon = tuple(SITES), default: str = "MLC") -> Column:
    return first_match(query, sites, default)


def price_text(price: Column) -> Column:
    """No decimals, dots for thousands; nothing or zero is to be asked for."""
    return F.when(price.isNull() | (price == 0), "consultar").otherwise(F.concat(F.lit("$"), F.translate(F.format_number(price, 0), ",", ".")))


def condition_class(condition: Column) -> Column:
    low = F.lower(condition)
    return F.when(low == "new", "nuevo").when(low == "used", "usado").otherwise("otro")


def top_listing(df: DataFrame, group: Sequence[str], order: Sequence[Column], most: int = 10) -> DataFrame:
    """The first rows of each group with their position, the group's total and how many are left out."""
    ranked = df.withColumns({"position": F.row_number().over(Window.partitionBy(*group).orderBy(*order)), "total": F.count("*").over(Window.partitionBy(*group))})
    return ranked.filter(F.col("position") <= most).withColumn("more", F.greatest(F.col("total") - most, F.lit(0)))


def expanded(query: Column, families: Sequence[tuple[str, str]] = tuple(FAMILIES), always: str = "chile") -> Column:
    """Add the words of the first product family that the query names."""
    extra = F.coalesce(*(F.when(contains_any(query, [w]), F.lit(more)) for w, more in families), F.lit("agrícola"))
    return F.concat_ws(" ", query, extra, F.lit(always))


def commercial(columns: Sequence[Column], words: Sequence[str] = tuple(COMMERCIAL)) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | contains_any(c, words)
    return out


def commercial_first(df: DataFrame, flag: str, rank: str, most: int = 8) -> DataFrame:
    """Commercial results first, else in their order; ``position`` from 1, and how many are commercial."""
    top = df.orderBy(F.desc(flag), rank).limit(most)
    every = Window.partitionBy(F.lit(1))
    return top.withColumns({"position": F.row_number().over(Window.orderBy(F.desc(flag), rank)), "n_commercial": F.count_if(F.col(flag)).over(every)})


def two_sections(df: DataFrame, flag: str, position: str, title: Column, link: Column) -> DataFrame:
    """section, listing: numbered lines under two headings, the numbers going on."""
    line = F.format_string("%d. %s - %s", F.col(position), title, link)
    section = F.when(F.col(flag), "Productos y precios").otherwise("Información")
    rows = df.select(section.alias("section"), F.col(position).alias("p"), line.alias("line"))
    return rows.groupBy("section").agg(F.collect_list(F.struct("p", "line")).alias("x")).select("section", joined(F.col("x"), "line", "\n").alias("listing"))
