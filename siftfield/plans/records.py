"""Queries on labels, tables of labels, files, payloads, requests and streams.

The driver's tables have no words of the domain, so label texts, tables and payloads are put together from
their columns; the SQL says what has to come out, from the same columns.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from siftfield.lexicons import CROPS, DOSE_PATTERNS, UNITS
from siftfield.operators import chunk, convo, extract, lexicon, lines, score, tables, vectors, weather
from siftfield.plans.registry import dealt_table, query, table
from siftfield.plans.search import FOUND, found
from siftfield.sources import files, payloads, store
from siftfield.sources.scratch import scratch_dir
from siftfield.streaming import jobs

K, S = lambda: F.col("p_partkey"), lambda: F.col("p_size")
VALID = lambda name: lexicon.valid_name(name)  # noqa: E731  of one argument, as a lambda of columns has to be
TEXT = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts))


def labels(spark, d):
    """p_partkey, p_size, text: a label for each part."""
    timing = F.when(K() % 4 == 0, "pre-emergencia").when(K() % 4 == 1, "post emergencia").otherwise("otoño")
    dose = F.when(K() % 3 == 0, TEXT(S(), " L/ha")).when(K() % 3 == 1, "sin datos").otherwise(TEXT("0,", S(), " - ", S() + 1, ",5 kg/ha"))
    text = F.concat_ws(
        "\n", TEXT("Producto: ALFA", K() % 7), TEXT("MARCA", S(), " SC y MARCA", S(), " SC"), TEXT("Nombre comercial: BETA", K() % 3), TEXT("Ingrediente activo: glifosato ", S(), ",5 %"),
        F.when(K() % 2 == 0, "LENTEJA y trigo").otherwise("Otros cultivos"), dose, TEXT("Aplicar en ", timing), TEXT("No aplicar con viento ", S()), TEXT(S(), " - ", S() + 100, " litros de agua por hectárea"),
    )
    return dealt_table(spark, d, "part").select(K(), S(), text.alias("text"))


@query("label_fields", """
SELECT p_partkey, 'glifosato ' || p_size || ',5%' AS ingredient,
  CASE k3 WHEN 0 THEN p_size WHEN 2 THEN ('0.' || p_size)::DOUBLE END AS low, CASE k3 WHEN 2 THEN p_size + 1.5::DOUBLE END AS high,
  CASE k3 WHEN 0 THEN p_size || ' L/ha' WHEN 2 THEN '0,' || p_size || '-' || p_size + 1 || ',5 kg/ha' END AS display, CASE k3 WHEN 0 THEN 'L/ha' WHEN 2 THEN 'kg/ha' END AS unit, CASE k3 WHEN 0 THEN 'L/ha' WHEN 2 THEN 'kg/ha' END AS named_unit,
  'Aplicar en ' || t AS timing, 'No aplicar con viento ' || p_size AS precautions, CASE WHEN p_partkey % 2 = 0 THEN 'lenteja,trigo' ELSE '' END AS crops,
  p_size || ' - ' || p_size + 100 || ' litros de agua por hectárea' AS water, CASE p_partkey % 4 WHEN 0 THEN 'preemergencia' WHEN 1 THEN 'postemergencia' ELSE 'no especificada' END AS stage
FROM (SELECT *, p_partkey % 3 AS k3, CASE p_partkey % 4 WHEN 0 THEN 'pre-emergencia' WHEN 1 THEN 'post emergencia' ELSE 'otoño' END AS t FROM part)""")
def label_fields(spark, d):
    x = F.col("text")
    rows = labels(spark, d).select(
        "p_partkey", extract.active_ingredient(x).alias("ingredient"), extract.dose(x).alias("d"), extract.unit_in(x).alias("named_unit"), extract.timing(x).alias("timing"), F.array_join(extract.precautions(x), "|").alias("precautions"),
        F.array_join(extract.crops(x, ["lentejas?", "trigo"]), ",").alias("crops"), extract.water_volume(x).alias("water"), extract.stage(x).alias("stage"),
    )
    return rows.select("*", "d.low", "d.high", "d.display", "d.unit").drop("d")


@query("dose_styles", """
SELECT p_partkey, CASE k WHEN 0 THEN p_size || '-' WHEN 2 THEN r || '-' || h END AS dash, CASE k WHEN 0 THEN p_size::VARCHAR WHEN 2 THEN r || '-' || h END AS bare, CASE k WHEN 0 THEN '' WHEN 2 THEN 'kg/ha' END AS bare_unit,
  CASE k WHEN 0 THEN p_size::VARCHAR WHEN 2 THEN r || ' - ' || h END AS spaced FROM (SELECT p_partkey, p_size, p_partkey % 3 AS k, '0,' || p_size AS r, p_size + 1 || ',5' AS h FROM part)""")
def dose_styles(spark, d):
    form = lambda s: extract.dose_text(F.col("text"), s)
    return labels(spark, d).select("p_partkey", form("dash")["range"].alias("dash"), form("bare")["range"].alias("bare"), form("bare")["unit"].alias("bare_unit"), form("spaced")["range"].alias("spaced"))


@query("label_names", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'MARCA' || p_size || ',' ELSE '' END || 'MARCA' || p_size || ' SC,ALFA' || p_partkey % 7 || ',BETA' || p_partkey % 3 AS names FROM part")
def label_names(spark, d):
    name = F.when(K() % 2 == 0, TEXT("/in/Marca", S(), ".pdf")).otherwise(TEXT("alfa", K() % 7, ".pdf"))
    return labels(spark, d).select("p_partkey", F.array_join(extract.product_names(F.col("text"), VALID, file_name=name), ",").alias("names"))


NAMES = "unnest(['MARCA' || p_size || ' SC', 'ALFA' || p_partkey % 7, 'BETA' || p_partkey % 3])"


@query("label_records", f"SELECT p_partkey, product, CASE WHEN contains(product, ' SC') THEN 'SC' ELSE '' END AS formulation, 'glifosato ' || p_size || ',5%' AS active_ingredient, CASE p_partkey % 4 WHEN 0 THEN 'preemergencia' WHEN 1 THEN 'postemergencia' ELSE 'no especificada' END AS stage, CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 0 END AS n_crops FROM (SELECT p_partkey, p_size, {NAMES} AS product FROM part)")
def label_records(spark, d):
    rows = extract.product_records(labels(spark, d), "p_partkey", "text", VALID, ["lentejas?", "trigo"], ["ballica"])
    return rows.select("p_partkey", "product", "formulation", "active_ingredient", "stage", F.size("crops").alias("n_crops"))


@query("heading_doses", f"SELECT p_partkey, product, CASE WHEN p_partkey % 6 = 2 THEN '0,' || p_size || ' - ' || p_size + 1 || ',5' ELSE 'own' END AS dose, CASE WHEN p_partkey % 6 = 2 THEN 'kg/ha' ELSE 'none' END AS unit FROM (SELECT p_partkey, p_size, {NAMES} AS product FROM part)")
def heading_doses(spark, d):
    docs = labels(spark, d)
    dose = lines.heading_dose(docs, "p_partkey", "text", "(?i)lenteja", [r"\d+,\d+\s*-\s*\d+,\d+", r"\d+,\d+"], UNITS)
    rows = extract.product_records(docs, "p_partkey", "text", VALID, ["x"], ["x"]).select("p_partkey", "product", F.lit("own").alias("dose"), F.lit("none").alias("unit"))
    return lines.with_heading_dose(rows, dose, "p_partkey").select("p_partkey", "product", "dose", "unit")


@query("structured_lines", "SELECT p_partkey, 'Lenteja, Trigo' AS crops, p_size::DOUBLE AS dose_low, p_size + 1.5::DOUBLE AS dose_high, 'L/ha' AS unit FROM part WHERE p_partkey % 3 = 0")
def structured_lines(spark, d):
    line = F.when(K() % 3 == 0, TEXT("Trigo y lenteja: ", S(), " - ", S() + 1, ",5 L/ha ", F.repeat(F.lit("hoja "), 20))).when(K() % 3 == 1, TEXT("Lenteja ", S(), " L/ha")).otherwise(F.repeat(F.lit("sin cultivo 2 L/ha "), 9))
    return extract.structured_lines(table(spark, d, "part").select("p_partkey", line.alias("line")), "(?i)lenteja|trigo").drop("line")


BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query("history_question", f"SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN nullif(trim(text, {BLANKS}), '') END AS question FROM conversations")
def history_question(spark, d):
    task = F.when(F.col("turn") % 2 == 0, TEXT("### Task: answer\n<chat_history>\nUSER: ", F.col("text"), "\nASSISTANT: x\nUSER: later</chat_history>")).otherwise(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", extract.history_question(task).alias("question"))


@query("table_files", "SELECT name, true AS has_size FROM (VALUES " + ", ".join(f"('{t}')" for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()) + ") v(name)")
def table_files(spark, d):
    found = files.scan_files(spark, d, ["parquet", "pdf"])
    name = F.regexp_extract("path", r"/([a-z]+)\.parquet(?:/[^/]*)?$", 1)
    return found.groupBy(name.alias("name")).agg((F.sum("size_mb") > 0).alias("has_size"))


def requests(spark, d):
    some = lambda **f: F.struct(*(c.alias(n) for n, c in f.items()))
    payload = F.struct(
        F.array(some(name=TEXT("p", K(), ".pdf"), size=S())).alias("files"), some(files=F.array(some(name=F.lit("x.exe"), path=TEXT("/x", K())))).alias("body"),
        F.when(K() % 2 == 0, F.array(some(name=TEXT("n", K(), ".DOCX"), data=F.lit("AA==")))).alias("attachments"), F.when(K() % 5 == 0, F.array(some(name=F.lit("empty.md"), size=F.lit(0)))).alias("documents"),
        F.when(K() % 3 == 0, some(path=TEXT("/in/", K(), ".md"), content=F.lit("texto"))).alias("file"),
    )
    return files.attachments(table(spark, d, "part").select("p_partkey", F.to_json(payload).alias("payload")), "p_partkey", F.col("payload"))


ATTACHED = """(SELECT p_partkey, row_number() OVER (PARTITION BY p_partkey ORDER BY place) - 1 AS ord, place, name, path, data, content, size FROM (
  SELECT p_partkey, 0 AS place, 'p' || p_partkey || '.pdf' AS name, NULL AS path, NULL AS data, NULL AS content, p_size AS size FROM part
  UNION ALL SELECT p_partkey, 1, 'x.exe', '/x' || p_partkey, NULL, NULL, NULL FROM part
  UNION ALL SELECT p_partkey, 2, 'n' || p_partkey || '.DOCX', NULL, 'AA==', NULL, NULL FROM part WHERE p_partkey % 2 = 0
  UNION ALL SELECT p_partkey, 3, 'empty.md', NULL, NULL, NULL, 0 FROM part WHERE p_partkey % 5 = 0
  UNION ALL SELECT p_partkey, 4, NULL, '/in/' || p_partkey || '.md', NULL, 'texto', NULL FROM part WHERE p_partkey % 3 = 0))"""


@query("request_attachments", f"SELECT p_partkey, ord::INT AS ord, name, path, place IN (0, 2, 4) AND (place <> 0 OR size > 0) AS valid FROM {ATTACHED}")
def request_attachments(spark, d):
    valid = files.is_valid(*(F.col(c) for c in ("name", "path", "data", "content", "size")))
    return requests(spark, d).select("p_partkey", "ord", "name", "path", valid.alias("valid"))


@query("file_records", f"SELECT coalesce(name, 'unknown') AS name, coalesce(path, '') AS path, coalesce(data, '') AS data, coalesce(content, '') AS content, coalesce(size, 0)::BIGINT AS size, '' AS id, '' AS url, '' AS type, '' AS mime_type FROM {ATTACHED}")
def file_records(spark, d):
    return files.normalised_file(requests(spark, d))


@query("decoded_texts", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'inline ' || c_name ELSE c_name || ' ñandú' END AS text FROM customer")
def decoded_texts(spark, d):
    key, name = F.col("c_custkey"), F.concat("c_name", F.lit(" ñandú"))
    raw = F.when(key % 2 == 0, F.encode(name, "UTF-8")).otherwise(F.encode(name, "ISO-8859-1"))
    return table(spark, d, "customer").select("c_custkey", files.decoded(F.when(key % 5 == 0, F.concat(F.lit("inline "), "c_name")).otherwise(""), raw).alias("text"))


@query("daily_forecasts", "SELECT c_custkey, day::INT AS day, '2024-01-0' || day + 1 AS time, c_acctbal + day AS temperatureMin, c_acctbal + day + 9 AS temperatureMax, 50.0::DOUBLE AS humidityAvg FROM (SELECT *, unnest(range(least(c_custkey % 5, 3))) AS day FROM customer)")
def daily_forecasts(spark, d):
    low = F.col("c_acctbal")
    day = lambda i: F.struct(TEXT("2024-01-0", i + 1).alias("time"), F.struct((low + i).alias("temperatureMin"), (low + i + 9).alias("temperatureMax"), F.lit(50.0).alias("humidityAvg")).alias("values"))
    rows = table(spark, d, "customer").select("c_custkey", F.to_json(F.struct(F.struct(F.array(*(day(F.lit(i)) for i in range(3))).alias("daily")).alias("timelines"))).alias("payload"))
    return payloads.daily_forecast(rows, "c_custkey", "payload", (F.col("c_custkey") % 5).cast("int")).select("c_custkey", "day", "time", "temperatureMin", "temperatureMax", "humidityAvg")


@query("realtime_weather", "SELECT event_id, value AS temperature, CASE WHEN event_id % 2 = 0 THEN value - 1 ELSE value END AS temperatureApparent, (user_id % 6)::INT AS precipitationType FROM events")
def realtime_weather(spark, d):
    values = F.struct(F.col("value").alias("temperature"), F.when(F.col("event_id") % 2 == 0, F.col("value") - 1).alias("temperatureApparent"), (F.col("user_id") % 6).alias("precipitationType"))
    rows = table(spark, d, "events").select("event_id", F.to_json(F.struct(F.struct(values.alias("values")).alias("data"))).alias("payload"))
    return payloads.realtime(rows, "event_id", "payload").select("event_id", "temperature", "temperatureApparent", "precipitationType")


@query("product_results", "SELECT p_brand, n AS total, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey)::INT AS rank, p_name AS title, p_retailprice AS price, p_size % 2 = 0 AS free_shipping, lower(p_type) AS condition FROM (SELECT *, count(*) OVER (PARTITION BY p_brand) AS n FROM part)")
def product_results(spark, d):
    one = F.struct("p_partkey", F.col("p_name").alias("title"), F.col("p_retailprice").alias("price"), F.lower("p_type").alias("condition"), F.when(S() % 2 == 0, F.struct(F.lit(True).alias("free_shipping"))).alias("shipping"))
    rows = table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(one)).alias("r"))
    rows = rows.select("p_brand", F.to_json(F.struct(F.struct(F.col("n").alias("total")).alias("paging"), F.col("r").alias("results"))).alias("payload"))
    return payloads.product_results(rows, "p_brand", "payload").select("p_brand", "total", "rank", "title", "price", "free_shipping", "condition")


@query("web_results", "SELECT page_id, r::INT AS rank, 't' || r AS title, url AS link FROM pages, (VALUES (1), (2)) v(r)")
def web_results(spark, d):
    item = lambda i: F.struct(F.lit(f"t{i}").alias("title"), F.col("url").alias("link"), F.lit("s").alias("snippet"))
    rows = table(spark, d, "pages").select("page_id", F.to_json(F.struct(F.array(item(1), item(2)).alias("items"))).alias("payload"))
    return payloads.web_results(rows, "page_id", "payload").select("page_id", "rank", "title", "link")


@query("knowledge_bounds", "SELECT n_name, CASE WHEN n_nationkey % 3 < 2 THEN n_nationkey::DOUBLE END AS low, CASE n_nationkey % 3 WHEN 0 THEN n_nationkey + 5.5::DOUBLE WHEN 1 THEN n_nationkey::DOUBLE END AS high FROM nation")
def knowledge_bounds(spark, d):
    key = F.col("n_nationkey")
    text = F.when(key % 3 == 0, TEXT(key, "-", key + 5, ".5°C")).when(key % 3 == 1, TEXT("desde ", key, " dias")).otherwise("seca")
    return payloads.with_bounds(table(spark, d, "nation").select("n_name", text.alias("text"))).select("n_name", "low", "high")


@query("place_coordinates", "SELECT c_custkey, c_acctbal AS lat, CASE WHEN c_custkey % 7 <> 0 THEN -c_custkey::DOUBLE END AS lon FROM customer")
def place_coordinates(spark, d):
    key = F.col("c_custkey")
    rows = table(spark, d, "customer").select("c_custkey", F.concat(F.format_string("%.2f, ", "c_acctbal"), F.when(key % 7 == 0, "x").otherwise((-key).cast("string"))).alias("coords"))
    return payloads.with_coordinates(rows)


@query("cache_round_trip", "SELECT DISTINCT md5(text) AS text_md5, contains(lower(text), 'the')::INT::VARCHAR AS vector FROM documents")
def cache_round_trip(spark, d):
    docs, path = table(spark, d, "documents"), scratch_dir(spark, "cache")
    for part in (docs.filter("doc_id % 2 = 0"), docs):  # the second round reads what the first one saved
        _, cache = vectors.embed_unseen(part, store.load_cache(spark, path), "text", 1, embedder=vectors.word_marks(["the"]))
        store.save_cache(cache, path)
    return store.load_cache(spark, path).select("text_md5", F.col("embedding")[0].cast("int").cast("string").alias("vector"))


def label_tables(spark, d):
    """n_regionkey, cells: a table for each region, with a row for each nation."""
    key = F.col("n_nationkey")
    row = F.struct("n_nationkey", F.array(TEXT(F.col("n_name"), ", trigo"), F.when(key % 3 > 0, TEXT(key, ",5 kg/ha")), F.when(key % 2 == 0, "ballica ").otherwise("")).alias("cells"))
    rows = table(spark, d, "nation").groupBy("n_regionkey").agg(F.transform(F.sort_array(F.collect_list(row)), lambda r: r["cells"]).alias("rows"))
    return rows.select("n_regionkey", F.concat(F.array(F.array(F.lit("Cultivo"), F.lit("Dosis (kg/ha)"), F.lit("Malezas"))), F.col("rows")).alias("cells"))


ROWS = "(SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS row_no, CASE WHEN n_nationkey % 3 > 0 THEN n_nationkey || ',5 kg/ha' END AS dose, CASE WHEN n_nationkey % 2 = 0 THEN 'ballica' END AS weed FROM nation)"


@query("table_columns", "SELECT n_regionkey, 1 AS dose_at, -1 AS none_at, 2 AS weed_at FROM (SELECT DISTINCT n_regionkey FROM nation)")
def table_columns(spark, d):
    at = lambda *words: tables.column_of(F.col("cells")[0], words)
    return label_tables(spark, d).select("n_regionkey", at("dosis", "dose").alias("dose_at"), at("unidad").alias("none_at"), at("plaga", "maleza").alias("weed_at"))


@query("table_records", f"SELECT n_regionkey, row_no::INT AS row_no, n_name || ', trigo' AS crops, CASE WHEN weed IS NULL THEN '' ELSE 'Ballica' END AS targets, coalesce(dose, '') AS dose, 'kg/ha' AS unit, dose IS NOT NULL AS has_dose, weed IS NOT NULL AS has_target, concat_ws(' | ', 'Dosis: ' || dose, 'Cultivo: ' || n_name || ', trigo', 'Maleza: ' || weed) AS told FROM {ROWS}")
def table_records(spark, d):
    rows = tables.described_rows(tables.table_rows(label_tables(spark, d), ["n_regionkey"], "cells"), ["ballica"])
    return rows.select("n_regionkey", "row_no", "crops", "targets", "dose", "unit", "has_dose", "has_target", tables.interpreted(F.col("headers"), F.col("row")).alias("told"))


@query("table_cell_doses", f"SELECT n_regionkey, row_no::INT AS row_no, 1 AS col_no, dose, 'lenteja' AS crops, 'ballica' AS weeds FROM {ROWS} WHERE dose IS NOT NULL")
def table_cell_doses(spark, d):
    rows = label_tables(spark, d).withColumn("cells", F.concat("cells", F.array(F.array(F.lit("Lenteja"), F.lit(""), F.lit("ballica")))))
    return tables.dose_cells(rows, ["n_regionkey"], "cells", CROPS[:1], [("ballica", ["ballica"])])


@query("comprehensive_chunks", """
SELECT p_partkey, kind, CASE kind WHEN 'general_info' THEN 'MARCA' || p_size || ' SC y MARCA' || p_size || ' SC' || chr(10) || 'Fabricado por ' || p_brand WHEN 'composition' THEN 'agua ' || p_size WHEN 'safety' THEN 'Precauciones' || chr(10) || 'guantes' WHEN 'commercial' THEN 'Fabricado por ' || p_brand
  WHEN 'descriptive' THEN '=== COMPOSICIÓN ===' || chr(10) || '=== PRECAUCIONES ===' || chr(10) || 'Fabricado por ' || p_brand ELSE 'MARCA' || p_size || ' SC y MARCA' || p_size || ' SC' || chr(10) || 'Composición' || chr(10) || ' agua ' || p_size || chr(10) || 'Lote 1' || chr(10) || 'Precauciones' || chr(10) || 'guantes' || chr(10) || 'Fabricado por ' || p_brand END AS text
FROM part, (VALUES ('general_info'), ('composition'), ('safety'), ('commercial'), ('descriptive'), ('full_document')) v(kind)""")
def comprehensive_chunks(spark, d):
    rows = dealt_table(spark, d, "part").select("p_partkey", F.concat_ws("\n", TEXT("MARCA", S(), " SC y MARCA", S(), " SC"), F.lit("Composición"), TEXT(" agua ", S()), F.lit("Lote 1"), F.lit("Precauciones"), F.lit("guantes"), TEXT("Fabricado por ", F.col("p_brand"))).alias("text"))
    out = chunk.comprehensive_chunks(rows, "p_partkey", "text", "marca", ["composición", "precauciones"])
    return out.select("p_partkey", F.col("content_category").alias("kind"), "text")


@query("file_chunks", f"""
WITH rows_ AS (SELECT n_regionkey, 'Cultivo: ' || n_name || ', trigo' || CASE WHEN dose IS NULL THEN '' ELSE ' | Dosis (kg/ha): ' || dose END || CASE WHEN weed IS NULL THEN '' ELSE ' | Malezas: ballica' END AS text FROM {ROWS})
SELECT n_regionkey, NULL AS content_category, text, 'REGION ' || n_regionkey AS product, 12 AS file_size FROM rows_
UNION ALL SELECT r_regionkey, 'full_document', r_name, 'REGION ' || r_regionkey, 12 FROM region
UNION ALL SELECT r_regionkey, 'structured', 'Cultivo: Trigo | Dosis: 2.0 - 3.5 L/ha', 'REGION ' || r_regionkey, 12 FROM region WHERE r_regionkey > 1""")
def file_chunks(spark, d):
    one = label_tables(spark, d)
    rows = tables.table_rows(one, ["n_regionkey"], "cells").select("n_regionkey", F.array_join(tables.labelled_cells(F.col("headers"), F.col("row")), " | ").alias("text"))
    regions = table(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    pages = regions.select("n_regionkey", F.concat(F.lit("Trigo: 2 - 3,5 L/ha "), F.repeat(F.lit("hoja "), 20)).alias("page"))
    twice = one.select("n_regionkey").unionByName(one.filter("n_regionkey < 2").select("n_regionkey"))  # two regions have two tables
    structured = chunk.structured_chunks(pages, twice, ["n_regionkey"], "page", "(?i)trigo")
    out = chunk.file_chunks(rows, regions.select("n_regionkey", F.lit("full_document").alias("content_category"), F.col("r_name").alias("text")), "n_regionkey", TEXT("REGION ", F.col("n_regionkey")), structured)
    return chunk.stamped(out, F.lit(12)).drop("processed_at").select("n_regionkey", "content_category", "text", "product", "file_size")


CASES = 8


@query("request_messages", f"SELECT conv_id, turn, CASE WHEN turn % {CASES} = 6 THEN NULL ELSE nullif(trim(text), '') END AS message FROM conversations")
def request_messages(spark, d):
    said, case = F.col("text"), F.col("turn") % CASES
    wrap = lambda c, *names: wrap(F.struct(c.alias(names[-1])), *names[:-1]) if names else c
    content = lambda: F.array(F.struct(F.lit("first").alias("content")), F.struct(said.alias("content")))
    payload = (
        F.when(case == 0, F.to_json(wrap(content(), "body", "messages"))).when(case == 1, F.to_json(wrap(content(), "messages"))).when(case == 2, F.to_json(wrap(said, "message"))).when(case == 3, F.to_json(wrap(said, "input")))
        .when(case == 4, F.to_json(F.struct(F.lit(5).alias("text"), F.struct(F.lit(1).alias("a"), wrap(said, "x", "prompt").alias("b")).alias("data")))).when(case == 5, F.to_json(F.struct(F.array(wrap(said, "y", "text")).alias("z"), wrap(F.lit("later"), "content").alias("a"))))
        .when(case == 6, F.to_json(wrap(said, "a", "b", "c", "d", "text"))).otherwise(F.to_json(F.struct(wrap(F.lit(" "), "text").alias("n"), wrap(said, "query").alias("m"))))
    )
    return table(spark, d, "conversations").select("conv_id", "turn", convo.user_message(payload).alias("message"))


@query("question_days", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN least(user_id % 20, 7) END::INT AS days FROM events")
def question_days(spark, d):
    case = F.col("event_id") % 4
    text = F.when(case == 0, "¿Llueve MAÑANA u hoy?").when(case == 1, "clima hoy").when(case == 2, TEXT("los próximos ", F.col("user_id") % 20, " días")).otherwise("en abril")
    return table(spark, d, "events").select("event_id", convo.days_in(text).alias("days"))


@query("reply_contents", "SELECT conv_id, turn, CASE turn % 4 WHEN 2 THEN '{\"a\":' || conv_id || '}' ELSE coalesce(text, '') END AS reply FROM conversations")
def reply_contents(spark, d):
    said, case = F.col("text"), F.col("turn") % 4
    payload = (
        F.when(case == 0, F.to_json(F.struct(F.array(F.struct(F.struct(said.alias("content")).alias("message"))).alias("choices"), F.lit("no").alias("reply")))).when(case == 1, F.to_json(F.struct(F.lit("no").alias("text"), said.alias("output"))))
        .when(case == 2, TEXT('{"a":', F.col("conv_id"), "}")).otherwise(said)
    )
    return table(spark, d, "conversations").select("conv_id", "turn", convo.reply_content(payload).alias("reply"))


@query("chosen_sources", """
WITH a AS (SELECT conv_id || ':' || turn // 4 AS request, text, ['expert', 'rag', 'prices', 'weather'][1 + turn % 4] AS source, [2, 1, 4, 3][1 + turn % 4] AS p FROM conversations WHERE length(trim(text)) > 50)
SELECT request, count(*) AS n, arg_min(source, p) AS source, md5(CASE WHEN count(*) = 1 THEN arg_min(text, p) || chr(10) || chr(10) || 'Fuente: ' || arg_min(source, p) ELSE string_agg('[' || source || '] ' || substr(text, 1, 800), chr(10) ORDER BY p) END) AS answer_md5 FROM a GROUP BY request""")
def chosen_sources(spark, d):
    source = F.element_at(F.array(*(F.lit(s) for s in ("expert", "rag", "prices", "weather"))), (F.col("turn") % 4 + 1).cast("int"))
    request = TEXT(F.col("conv_id"), ":", F.floor(F.col("turn") / 4))  # four turns are the answers to one request
    answers = table(spark, d, "conversations").select(request.alias("request"), source.alias("source"), "text")
    return convo.chosen_source(answers, "request").select("request", "n", "source", F.md5("answer").alias("answer_md5"))


@query("source_footers", "SELECT doc_id, CASE WHEN contains(text, 'License') AND lang = 'en' THEN 'Fuentes: docs + tiempo' WHEN contains(text, 'License') THEN 'Fuentes: docs' WHEN lang = 'en' THEN 'Fuentes: tiempo' END AS footer FROM documents")
def source_footers(spark, d):
    return table(spark, d, "documents").select("doc_id", convo.footer({"docs": F.col("text").contains("License"), "tiempo": F.col("lang") == "en"}).alias("footer"))


@query("reply_envelopes", "SELECT conv_id, turn, 'c' || conv_id AS id, text AS content, 2 * n AS prompt_tokens, n AS completion_tokens, 3 * n AS total_tokens FROM (SELECT *, len(regexp_extract_all(text, '\\S+'))::INT AS n FROM conversations)")
def reply_envelopes(spark, d):
    made = convo.envelope(TEXT("c", F.col("conv_id")), "m", F.col("text"), F.col("text"))
    back = F.from_json(made, "id string, choices array<struct<message: struct<role: string, content: string>>>, usage struct<prompt_tokens: int, completion_tokens: int, total_tokens: int>")
    return table(spark, d, "conversations").select("conv_id", "turn", back.alias("b")).select("conv_id", "turn", "b.id", F.col("b.choices")[0]["message"]["content"].alias("content"), "b.usage.*")


EVIDENCE = """
SELECT p_partkey, 'table_crop' AS tier, 'Lenteja | ' || p_size || ',0 kg/ha' AS evidence FROM part WHERE p_partkey % 4 = 0
UNION ALL SELECT p_partkey, 'table_other', 'DOSIS: ' || p_size || ' kg/ha en trigo' FROM part WHERE p_partkey % 4 = 1
UNION ALL SELECT p_partkey, 'text_crop', 'lenteja: ' || p_size || ' kg/ha' FROM part WHERE p_partkey % 4 = 2
UNION ALL SELECT p_partkey, 'text_dose', 'use ' || p_size || ' g/ha' FROM part WHERE p_partkey % 4 = 2"""


def evidence(spark, d):
    case = K() % 4
    kind = F.when(case < 2, "table_row").otherwise("text")
    text = F.when(case == 0, TEXT("CULTIVO: Lenteja\nDOSIS: ", S(), ",0\nUNIDAD: kg/ha")).when(case == 1, TEXT("DOSIS: ", S(), " kg/ha en trigo")).when(case == 2, TEXT(" lenteja: ", S(), " kg/ha\nuse ", S(), " g/ha\nnada")).otherwise(TEXT("trigo ", S(), " kg/ha"))
    return score.chunk_evidence(table(spark, d, "part").select("p_partkey", kind.alias("type"), text.alias("text")), "p_partkey", ["lenteja"], DOSE_PATTERNS)


@query("chunk_evidence", EVIDENCE)
def chunk_evidence(spark, d):
    return evidence(spark, d)


RATED = f"""(SELECT p_partkey, p_type = 'STANDARD' AS processed, p_partkey % 2 = 0 AS named, CASE WHEN p_partkey % 3 = 0 THEN p_size ELSE 0 END AS rows_, (SELECT count(*) FROM ({EVIDENCE}) e WHERE e.p_partkey = p.p_partkey) AS direct, (p_partkey % 5 = 0)::INT AS context,
  CASE WHEN p_partkey % 7 = 0 THEN 'glifosato' END AS ingredient, p_partkey % 5 < 2 AS related, CASE WHEN p_size < 25 THEN 'Herbicida' ELSE 'Otro' END AS kind, p_size AS chunks FROM part p)"""


def ratings(spark, d):
    parts = table(spark, d, "part")
    found = evidence(spark, d).groupBy("p_partkey").agg(F.count("*").alias("direct"))
    tables_ = parts.filter(K() % 3 == 0).select("p_partkey", S().alias("rows_"))
    rows = score.evaluations(parts, "p_partkey", [found, tables_], ["direct", "rows_"])
    related = F.when(K() % 5 < 2, F.array(F.lit("haba"))).otherwise(F.array().cast("array<string>"))
    level, advice, reasons = score.priority(F.col("p_type") == "STANDARD", K() % 2 == 0, F.col("rows_"), F.col("direct"), (K() % 5 == 0).cast("int"), F.when(K() % 7 == 0, "glifosato"), related, F.when(S() < 25, "Herbicida").otherwise("Otro"), S())
    return rows.select("p_partkey", "direct", "rows_", level.alias("priority"), advice.alias("recommendation"), F.array_join(reasons, "; ").alias("reasons"))


@query("file_evaluations", f"SELECT p_partkey, direct, rows_ FROM {RATED}")
def file_evaluations(spark, d):
    return ratings(spark, d).select("p_partkey", "direct", "rows_")


@query("recommendations", f"""SELECT p_partkey, CASE WHEN processed THEN 'SKIP' WHEN named AND rows_ > 0 AND direct > 0 THEN 'HIGH' WHEN named AND rows_ > 0 THEN 'MEDIUM' WHEN named AND direct > 0 THEN 'MEDIUM' WHEN named THEN 'LOW'
  WHEN related AND ingredient IS NOT NULL AND kind = 'Herbicida' THEN 'MEDIUM' WHEN related THEN 'LOW' WHEN chunks < 5 THEN 'SKIP' ELSE 'LOW' END AS priority,
  CASE WHEN processed THEN 'processed before' WHEN named AND rows_ > 0 AND direct > 0 THEN CASE WHEN ingredient IS NULL THEN 'process: doses for the crop, ingredient to be checked' ELSE 'process: doses for the crop, all known' END
  WHEN named AND rows_ > 0 AND context > 0 THEN CASE WHEN ingredient IS NULL THEN 'process: doses near the crop, ingredient to be checked' ELSE 'process: doses near the crop, ingredient known' END
  WHEN named AND rows_ > 0 THEN 'process: crop named, no doses for it' WHEN named AND direct + context > 0 THEN 'process: doses for the crop, no tables' WHEN named THEN 'evaluate: crop named, little else'
  WHEN related AND ingredient IS NOT NULL THEN CASE WHEN kind = 'Herbicida' THEN 'process if wanted: related crops, ingredient known' ELSE 'evaluate by hand: related crops, type unknown' END WHEN related THEN 'evaluate by hand: related crops, ingredient unknown'
  WHEN chunks < 5 THEN 'leave: nothing relevant' ELSE 'evaluate by hand: nothing named, whole document' END AS recommendation,
  CASE WHEN processed THEN 'already processed' ELSE concat_ws('; ', CASE WHEN named THEN 'crop named' END, CASE WHEN named AND rows_ > 0 THEN rows_ || ' table rows' WHEN named THEN 'no tables' END, CASE WHEN named AND direct > 0 THEN direct || ' direct doses' WHEN named AND context > 0 THEN context || ' doses in context' END,
    CASE WHEN NOT named AND related THEN 'related crops: haba' WHEN NOT named THEN 'no crop named' END, CASE WHEN (named OR related) AND ingredient IS NOT NULL THEN 'ingredient glifosato' END, CASE WHEN NOT named AND related AND ingredient IS NOT NULL AND kind = 'Herbicida' THEN 'type Herbicida' END,
    CASE WHEN NOT named AND NOT related AND chunks < 5 THEN 'little content' END) END AS reasons
FROM {RATED} WHERE NOT (named AND rows_ = 0 AND direct = 0 AND context > 0)""")
def recommendations(spark, d):
    rows = ratings(spark, d)
    return rows.filter(~((K() % 2 == 0) & (F.col("rows_") == 0) & (F.col("direct") == 0) & (K() % 5 == 0))).select("p_partkey", "priority", "recommendation", "reasons")


@query("candidate_files", f"SELECT p_partkey FROM {RATED} WHERE NOT processed AND ((named AND (rows_ > 0 OR direct > 0)) OR (NOT named AND related AND ingredient IS NOT NULL AND kind = 'Herbicida'))")
def candidate_files(spark, d):
    return lexicon.candidates(ratings(spark, d)).select("p_partkey")


@query("reference_lists", f"WITH {FOUND} SELECT qid, string_agg(format('[{{}}] {{}} ({{:.2f}}%)', rerank_rank, source, similarity * 100), chr(10) ORDER BY rerank_rank) AS refs, md5(string_agg(format('{{}}. {{}} (relevancia {{:.1f}}%)', rerank_rank, source, similarity * 100) || chr(10) || text, chr(10) || chr(10) ORDER BY rerank_rank)) AS listing_md5 FROM best GROUP BY qid")
def reference_lists(spark, d):
    rows = found(spark, d)
    refs = vectors.reference_list(rows, "qid", "rerank_rank", F.col("source"), F.col("similarity"))
    listing = vectors.result_listing(rows, "qid", "rerank_rank", F.col("source"), F.col("similarity"), F.col("text"))
    return refs.join(listing, "qid").select("qid", F.col("references").alias("refs"), F.md5("listing").alias("listing_md5"))


PERIODS = [("¿Clima HOY?", True, "current", 1), ("Lluvia mañana", True, "forecast", 2), ("temperatura de la semana", True, "forecast", 7), ("¿viento el sábado?", True, "forecast", 3), ("dosis de trigo", False, "current", 1)]


@query("weather_periods", "SELECT event_id, CASE WHEN c = 5 THEN true ELSE [" + ", ".join(str(p[1]).lower() for p in PERIODS) + "][1 + c] END AS is_weather, CASE WHEN c = 5 THEN CASE WHEN user_id % 20 = 0 THEN 'current' ELSE 'forecast' END ELSE [" + ", ".join(f"'{p[2]}'" for p in PERIODS) + "][1 + c] END AS period, CASE WHEN c = 5 THEN CASE WHEN user_id % 20 = 0 THEN 1 ELSE least(user_id % 20, 7) END ELSE [" + ", ".join(str(p[3]) for p in PERIODS) + "][1 + c] END::INT AS days FROM (SELECT *, event_id % 6 AS c FROM events)")
def weather_periods(spark, d):
    case = F.col("event_id") % 6
    text = F.when(case == 5, TEXT("pronóstico de ", F.col("user_id") % 20, " días")).otherwise(F.element_at(F.array(*(F.lit(p[0]) for p in PERIODS)), F.least(case + 1, F.lit(5)).cast("int")))
    return table(spark, d, "events").select("event_id", weather.weather_period(text).alias("w")).select("event_id", "w.*")


@query("located_questions", "SELECT c_custkey, coalesce(CASE WHEN c_nationkey < 20 THEN (SELECT arg_min('Región ' || n_nationkey, n_nationkey) FROM nation WHERE n_nationkey % 2 = 0 AND contains('nation_' || c_nationkey, lower(n_name))) END, 'Santiago') AS place FROM customer")
def located_questions(spark, d):
    names = table(spark, d, "nation").filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("ord"), F.regexp_replace("n_name", "A", "Á").alias("alias"), TEXT("Región ", F.col("n_nationkey")).alias("place"))
    asked = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_nationkey") < 20, TEXT("¿Clima en Natión_", F.col("c_nationkey"), "?")).otherwise("¿Clima?").alias("text"))
    return weather.located(asked, "c_custkey", "text", names).select("c_custkey", "place")


@query("apparent_temperature", "SELECT event_id, CASE WHEN event_id % 3 > 0 THEN 'Sensación térmica: ' || format('{:.1f}', (user_id % 40 + event_id % 3)::DOUBLE) || '°C' END AS line, (DATE '2024-01-01' + (user_id % 28)::INT) AS day FROM events")
def apparent_temperature(spark, d):
    base = (F.col("user_id") % 40).cast("double")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("user_id") % 28).cast("int")).cast("string")
    text = F.when(F.col("event_id") % 2 == 0, F.concat(day, F.lit("T06:00:00Z"))).otherwise(F.concat(day, F.lit(" no time")))
    return table(spark, d, "events").select("event_id", weather.feels_like(base, base + F.col("event_id") % 3).alias("line"), weather.iso_day(text).alias("day"))


def arriving(spark, d):
    """The conversations as a stream of files."""
    path = f"{d.rstrip('/')}/conversations.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path.removesuffix('t')}*")


def sunk(rows, spark, name):
    """Run a stream to its end into Parquet files, and read them."""
    path = scratch_dir(spark, name)
    rows.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/rows").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{path}/rows")


@query("stream_ingest", "SELECT 'chunk_' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) || '_' || conv_id AS id, conv_id, turn, 'c' || conv_id % 3 AS collection FROM conversations")
def stream_ingest(spark, d):
    path = scratch_dir(spark, "ingest")

    def chunker(df):
        return store.with_ids(df.withColumn("collection", F.concat(F.lit("c"), (F.col("conv_id") % 3).cast("string"))), "conv_id", ["turn"])

    for run in range(2):  # the second run finds all chunks stored
        jobs.ingest(arriving(spark, d), chunker, f"{path}/store", f"{path}/state{run}").awaitTermination()
    return spark.read.parquet(f"{path}/store").select("id", "conv_id", "turn", "collection")


@query("stream_memory", "SELECT conv_id, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS memory_md5 FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 12 GROUP BY conv_id")
def stream_memory(spark, d):
    path = scratch_dir(spark, "memory")

    def keep(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{path}/rows")

    rows = jobs.memory(arriving(spark, d))
    rows.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(f"{path}/rows").groupBy("conv_id").agg(F.max_by("memory", "batch").alias("memory"))
    return last.select("conv_id", F.md5("memory").alias("memory_md5"))


@query("stream_routing", "SELECT conv_id, turn, CASE WHEN contains(lower(text), ' der ') THEN 'wheat' WHEN contains(lower(text), ' les ') THEN 'rice' ELSE 'help' END AS route FROM conversations")
def stream_routing(spark, d):
    rows = jobs.routed(arriving(spark, d), {"route": convo.routed(F.col("text"), [("wheat", [" der "]), ("rice", [" les "])])})
    return sunk(rows.select("conv_id", "turn", "route"), spark, "routes")


@query("stream_frames", """
WITH w AS (SELECT conv_id, turn, list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') AS w FROM conversations), f AS (SELECT conv_id, turn, w, unnest(range(0, len(w), 3)) AS i FROM w WHERE len(w) > 0)
SELECT conv_id, turn, (i // 3)::INT AS frame, array_to_string(w[i + 1 : i + 3], ' ') || CASE WHEN i + 3 < len(w) THEN ' ' ELSE '' END AS text FROM f""")
def stream_frames(spark, d):
    return sunk(jobs.framed(arriving(spark, d), ["conv_id", "turn"], "text"), spark, "frames")
