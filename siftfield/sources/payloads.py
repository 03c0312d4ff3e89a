"""JSON results of services as typed rows, and knowledge as dimension tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAILY = "timelines struct<daily: array<struct<time: string, `values`: struct<temperatureMin: double, temperatureMax: double, temperatureAvg: double, humidityAvg: double, windSpeedAvg: double, precipitationProbabilityAvg: double>>>>"
REALTIME = "data struct<`values`: struct<temperature: double, temperatureApparent: double, humidity: double, windSpeed: double, precipitationType: int>>"
PRODUCTS = "paging struct<total: bigint>, results array<struct<title: string, price: double, currency_id: string, condition: string, shipping: struct<free_shipping: boolean>, permalink: string>>"
PAGES = "items array<struct<title: string, snippet: string, link: string, displayLink: string>>"


def daily_forecast(df: DataFrame, key: str, payload: str, days: Column) -> DataFrame:
    """key, day (from 0), time and values of the first days."""
    rows = df.select(key, F.from_json(payload, DAILY)["timelines"]["daily"].alias("d"), days.alias("n"))
    return rows.select(key, F.posexplode(F.slice("d", F.lit(1), F.greatest("n", F.lit(0)))).alias("day", "x")).select(key, "day", "x.time", "x.values.*")


def realtime(df: DataFrame, key: str, payload: str) -> DataFrame:
    """key and current values; the apparent temperature is the real one where it's missing."""
    rows = df.select(key, F.from_json(payload, REALTIME)["data"]["values"].alias("v")).select(key, "v.*")
    return rows.withColumn("temperatureApparent", F.coalesce("temperatureApparent", "temperature"))


def product_results(df: DataFrame, key: str, payload: str) -> DataFrame:
    """key, total, rank (from 1), title, price, currency, condition, free_shipping, link."""
    rows = df.select(key, F.from_json(payload, PRODUCTS).alias("j")).select(key, F.col("j.paging.total").alias("total"), F.posexplode("j.results").alias("pos", "r"))
    return rows.select(key, "total", (F.col("pos") + 1).alias("rank"), "r.title", "r.price", F.col("r.currency_id").alias("currency"), "r.condition", F.coalesce("r.shipping.free_shipping", F.lit(False)).alias("free_shipping"), F.col("r.permalink").alias("link"))


def web_results(df: DataFrame, key: str, payload: str) -> DataFrame:
    rows = df.select(key, F.posexplode(F.from_json(payload, PAGES)["items"]).alias("pos", "r"))
    return rows.select(key, (F.col("pos") + 1).alias("rank"), "r.title", "r.snippet", "r.link", "r.displayLink")


def dimension(spark: SparkSession, knowledge: dict[str, dict[str, dict[str, str]]], kind: str) -> DataFrame:
    """crop, name, attribute, text, low, high: one kind of a nested knowledge base, numbers parsed from
    texts such as ``15-20°C``."""
    rows = [(crop, name, a, t) for crop, kinds in knowledge.items() for name, facts in kinds.get(kind, {}).items() for a, t in (facts.items() if isinstance(facts, dict) else [("text", facts)])]
    return with_bounds(spark.createDataFrame(rows, "crop string, name string, attribute string, text string"))


def with_bounds(df: DataFrame) -> DataFrame:
    """Add low and high, the numbers of texts such as ``15-20°C`` (one number is both)."""
    number = lambda k: F.expr(f"try_cast(nullif(regexp_extract(text, '(-?[0-9]+(?:[.][0-9]+)?)(?:\\\\s*-\\\\s*([0-9]+(?:[.][0-9]+)?))?', {k}), '') AS DOUBLE)")
    return df.withColumns({"low": number(1), "high": F.coalesce(number(2), number(1))})


def gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """ord, alias, place, lat, lon from a CSV of ord, alias, place, coords (``lat,lon``)."""
    return with_coordinates(spark.read.schema("ord int, alias string, place string, coords string").option("header", "true").csv(path))


def with_coordinates(rows: DataFrame) -> DataFrame:
    """lat and lon in place of coords (``lat,lon``); null where they aren't numbers."""
    number = lambda k: F.expr(f"try_cast(trim(split(coords, ',')[{k}]) AS DOUBLE)")
    return rows.withColumns({"lat": number(0), "lon": number(1)}).drop("coords")
