"""Weather questions, forecasts and what they mean in the field."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftfield.functions.text import contains_any, fold_accents
from siftfield.operators.lexicon import SMALL_LEXICON, occurring, small

WEATHER_WORDS = ["clima", "tiempo", "temperatura", "lluvia", "pronóstico", "pronostico", "viento", "helada", "weather"]
WEEKDAYS = "lunes|martes|mi[eé]rcoles|jueves|viernes|s[aá]bado|domingo"
DAY_NAMES = ("Dom", "Lun", "Mar", "Mié", "Jue", "Vie", "Sáb")
#: Crop, largest wind in km/h, lowest and highest temperature for spraying. Fixed values.
THRESHOLDS = [("lentil", 10.0, 5.0, 30.0), ("wheat", 10.0, 5.0, 30.0), ("rice", 10.0, 17.0, 35.0), ("bean", 10.0, 15.0, 32.0), ("general", 15.0, 5.0, 25.0)]


def weather_period(text: Column) -> Column:
    """struct(is_weather, period, days): today, tomorrow (2), the next N (7 at most), a week (7), a
    weekday (3), in that order; else the current day."""
    low = F.lower(text)
    n = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(low, r"(?:pr[oó]xim[oa]s?\s+)?(\d{1,2})\s+d[ií]as", 1), F.lit("")), F.lit("99")).cast("int"), F.lit(0))
    x = lambda period, days: F.struct(F.lit(period).alias("period"), F.lit(days).cast("int").alias("days"))
    found = (
        F.when(low.rlike(r"\b(hoy|actual|ahora)\b"), x("current", 1))
        .when(low.contains("mañana"), x("forecast", 2))
        .when(n > 0, F.struct(F.lit("forecast").alias("period"), F.least(n, F.lit(7)).alias("days")))
        .when(low.contains("semana"), x("forecast", 7))
        .when(low.rlike(WEEKDAYS), x("forecast", 3))
        .otherwise(x("current", 1))
    )
    return F.struct(contains_any(text, WEATHER_WORDS).alias("is_weather"), found["period"].alias("period"), found["days"].alias("days"))


#: Words before a place's name.
PLACE_PATTERNS = [r"(?iu)(?:clima|temperatura|pronóstico|tiempo)?\s*\b(?:en|de|para)\s+([\p{L}\s,]+)", r"(?iu)próximos?\s+\d+\s+días?\s+(?:en|de)\s+([\p{L}\s,]+)"]


def located(df: DataFrame, key: str, text_col: str, gazetteer: DataFrame, default: str = "Santiago", match: str = "first", patterns: Sequence[str] = tuple(PLACE_PATTERNS)) -> DataFrame:
    """Add ``place``: of the aliases (ord, alias, place) that occur, accents aside, the first in order or
    the longest (match); else the one that equals what a preposition pattern captures; else the default.

    With match="named" the name after a preposition comes first.
    """
    folded = fold_accents(F.lower(F.col(text_col)))
    names = gazetteer.select("ord", F.trim(fold_accents(F.lower("alias"))).alias("alias_"), "place")
    order = F.struct(-F.length("alias_"), "ord") if match == "longest" else F.col("ord")
    hits = occurring(df, [key], folded, names, "alias_").groupBy(key).agg(F.min_by("place", order).alias("held_"))
    captures = F.array_compact(F.array(*(F.nullif(F.trim(F.regexp_extract(F.col(text_col), p, 1)), F.lit("")) for p in patterns)))
    said = df.select(key, F.posexplode(F.transform(captures, lambda x: fold_accents(F.lower(x)))).alias("pos_", "alias_"))
    named = said.join(small(names), "alias_").groupBy(key).agg(F.min_by("place", F.struct("pos_", "ord")).alias("named_"))
    place = F.coalesce("named_", "held_") if match == "named" else F.coalesce("held_", "named_")
    return df.join(hits, key, "left").join(named, key, "left").withColumn("place", F.coalesce(place, F.lit(default))).drop("held_", "named_")


def region_of(df: DataFrame, place_col: str, regions: DataFrame, default: str = "no identificada") -> DataFrame:
    """Add ``region`` by an equi-join with place, region."""
    table = small(regions.select(F.col("place").alias(place_col), "region"))
    return df.join(table, place_col, "left").withColumn("region", F.coalesce("region", F.lit(default)))


def precipitation(code: Column) -> Column:
    return F.when(code == 0, "sin precipitación").when(code == 1, "lluvia").when(code == 2, "nieve").when(code == 3, "lluvia helada").when(code == 4, "granizo").otherwise("desconocida")


def rain_class(probability: Column) -> Column:
    """Text or number in percent; what isn't a number is unknown."""
    p = F.try_to_number(probability.cast("string"), F.lit("999999.999999")).cast("double")
    return F.when(p.isNull(), "unknown").when(p > 70, "high").when(p > 30, "medium").otherwise("low")


#: Upper bounds of the thermal bands, in degrees. Fixed values.
BANDS = [(0, "freezing"), (5, "very cold"), (10, "cold"), (15, "cool"), (20, "mild"), (25, "warm"), (30, "hot"), (35, "very hot")]


def thermal_band(temperature: Column) -> Column:
    out = F.when(temperature.isNull(), F.lit(None).cast("string"))
    for bound, name in BANDS:
        out = out.when(temperature < bound, name)
    return out.otherwise("extreme")


def day_label(time: Column, today: Column) -> Column:
    """HOY, MAÑANA, else the weekday, and dd/mm."""
    day = F.to_date(time)
    gap = F.datediff(day, today)
    name = F.element_at(F.array(*(F.lit(d) for d in DAY_NAMES)), F.dayofweek(day))
    return F.concat(F.when(gap == 0, "HOY").when(gap == 1, "MAÑANA").otherwise(name), F.lit(" "), F.date_format(day, "dd/MM"))


def iso_day(text: Column) -> Column:
    """The day of an ISO time; where it can't be parsed, of its first ten characters."""
    return F.coalesce(F.to_date(F.try_to_timestamp(text)), F.to_date(F.try_to_timestamp(F.substring(text, 1, 10))))


def feels_like(temperature: Column, apparent: Column) -> Column:
    return F.when(apparent.isNotNull() & (apparent != temperature), F.format_string("Sensación térmica: %.1f°C", apparent))


def spray_advice(rain: Column, wind: Column, low: Column, high: Column, limits: dict[str, Column]) -> Column:
    """no (rain), drift (wind), wait (temperature), else go."""
    return F.when(rain, "no").when(wind > limits["wind_max"], "drift").when((low < limits["temp_low"]) | (high > limits["temp_high"]), "wait").otherwise("go")


def worst_advice(df: DataFrame, keys: Sequence[str], advice: str) -> DataFrame:
    """The worst advice of each group: no, drift, wait, go."""
    order = F.when(F.col(advice) == "no", 0).when(F.col(advice) == "drift", 1).when(F.col(advice) == "wait", 2).otherwise(3)
    return df.groupBy(*keys).agg(F.min_by(advice, order).alias("advice"), F.count("*").alias("n"))


def stage_risk(df: DataFrame, crop_col: str, days_col: str, temp_col: str, stages: DataFrame, most: int = SMALL_LEXICON) -> DataFrame:
    """Match days after sowing to a stage's window (crop, stage, day_from, day_to, temp_critical) and
    tell whether the temperature falls below what is critical for it.

    A row stands once for each window its day falls into, bounds included, or once with nulls (null days or crops too). Up to ``most``
    stages (by a count) go to every task; of more, each day that occurs meets the windows of its ranges (``windows_of``).
    """
    table = stages.select(F.col("crop").alias("crop_"), "stage", "day_from", "day_to", "temp_critical")
    if stages.limit(most + 1).count() <= most:
        on = (F.col(crop_col) == F.col("crop_")) & F.col(days_col).between(F.col("day_from"), F.col("day_to"))
        joined = df.join(F.broadcast(table), on, "left").drop("crop_")
    else:
        points = df.select(F.col(crop_col).alias("crop_"), F.col(days_col).alias("day_")).dropna().distinct()
        found = windows_of(points, table, "crop_", "day_", "day_from", "day_to")
        joined = df.join(found, (F.col(crop_col) == F.col("crop_")) & (F.col(days_col) == F.col("day_")), "left").drop("crop_", "day_")
    risk = F.when(F.col(temp_col) < F.col("temp_critical"), "risk").otherwise("ok")
    return joined.withColumn("risk", F.when(F.col("stage").isNotNull(), risk))


def windows_of(points: DataFrame, windows: DataFrame, key: str, at: str, low: str, high: str) -> DataFrame:
    """Pairs of points (key, at) and windows (key, low to high) that hold them, by an equi-join on ranges.

    A window of at most 2^n days stands in the one or two ranges of 2^n days that it touches; a point looks into its range of each
    such width that occurs (64 at most). So rows grow by a bounded factor whatever the lengths of windows, and a point meets only windows
    near it, not all of its key.
    """
    day = lambda c: F.floor(c).cast("bigint")
    held = windows.filter(F.col(low) <= F.col(high)).withColumn("width_", F.length(F.bin(day(high) - day(low))))
    widths = sorted(r[0] for r in held.select("width_").distinct().collect())
    cell = lambda c, width: F.call_function("shiftright", c, width)
    held = held.withColumn("range_", F.explode(F.array_distinct(F.array(cell(day(low), F.col("width_")), cell(day(high), F.col("width_"))))))
    asked = points.withColumn("width_", F.explode(F.array(*(F.lit(w) for w in widths)).cast("array<int>")))
    asked = asked.withColumn("range_", cell(day(at), F.col("width_")))
    met = asked.join(held, [key, "width_", "range_"]).filter(F.col(at).between(F.col(low), F.col(high)))
    return met.drop("width_", "range_")
