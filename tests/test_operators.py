"""Goldens on small label fixtures for what the driver's tables have no words for."""

import base64
import json
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftfield.functions import text as t
from siftfield.lexicons import CROPS, DOSE_PATTERNS, HEADINGS, UNITS, WEEDS
from siftfield.operators import chunk, convo, extract, lexicon, lines, market, score, tables, vector_index, vectors, weather
from siftfield.plans.registry import QUERIES
from siftfield.sources import files, payloads, store
from siftfield.streaming import jobs

LABEL = """Producto: SELECTOR 480 SC
herbicida selectivo para lenteja y trigo, de amplio espectro en el campo
Composición
Metribuzina 48,0 % p/v
Coformulantes
Lote 123
LENTEJAS
Aplicar en preemergencia
0,5 - 1,0 kg/ha
Malezas: ballica y rábano
Precauciones
No aplicar con viento fuerte
| tabla | x |
Fabricado por Campo SA
100 - 200 litros de agua por hectárea"""


def one(spark, value, *columns):
    df = spark.createDataFrame([(value,)], "text string")
    row = df.select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()
    return row[0] if len(columns) == 1 else tuple(row)


def test_extraction(spark):
    x = F.col("text")
    assert one(spark, LABEL, extract.active_ingredient(x)) == "Metribuzina 48,0%"
    d = one(spark, LABEL, extract.dose(x))
    assert (d.low, d.high, d.unit, d.display) == (0.5, 1.0, "kg/ha", "0,5-1,0 kg/ha")
    single = one(spark, "use 2 L/ha", extract.dose(x))
    assert (single.low, single.high, single.unit) == (2.0, None, "L/ha")
    assert one(spark, "", extract.dose(x)).display is None
    assert one(spark, LABEL, extract.stage(x)) == "preemergencia"
    assert one(spark, LABEL, extract.water_volume(x)).startswith("100 - 200 litros de agua")
    assert one(spark, LABEL, extract.precautions(x)) == ["No aplicar con viento fuerte"]
    assert one(spark, LABEL, extract.unit_in(x)) == "kg/ha"
    assert one(spark, LABEL, extract.timing(x)).lower().startswith("aplicar en")
    assert one(spark, "Zorro_480-SC.pdf", extract.short_name(x), extract.display_name(x)) == ("ZORRO", "Zorro 480 Sc")
    assert one(spark, "/x/Aliado__2023-99.pdf", extract.name_from_filename(x)) == "ALIADO"
    valid = lambda n: lexicon.valid_name(n)
    assert one(spark, LABEL, extract.product_names(x, valid)) == ["SELECTOR 480 SC"]
    assert one(spark, "SELECTOR 480 SC", extract.formulation(x)) == "SC"
    tag = "### Task: x <chat_history>\nUSER: ¿dosis?\nASSISTANT: 2</chat_history>"
    assert one(spark, tag, extract.history_question(x)) == "¿dosis?"
    assert one(spark, "plain", extract.history_question(x)) is None


def test_product_records_and_lines(spark):
    docs = spark.createDataFrame([("f1", LABEL)], "file string, text string")
    row = extract.product_records(docs, "file", "text", lambda n: lexicon.valid_name(n), ["lentejas?", "trigo"], ["ballica", "rábano"]).first()
    assert (row["product"], row["crops"], row["targets"]) == ("SELECTOR 480 SC", ["lenteja", "lentejas", "trigo"], ["ballica", "rábano"])
    ls = lines.explode_lines(docs, "file", "text")
    assert ls.count() == 15
    dose = lines.heading_dose(docs, "file", "text", "(?i)lenteja", [r"\d+[.,]\d+\s*-\s*\d+[.,]\d+"], UNITS).first()
    assert (dose.dose, dose.unit) == ("0,5 - 1,0", "kg/ha")
    composition = lines.gathered(lines.capture_section(docs, "file", "text", ["composición"], ["lote"]), "file").first().text
    assert composition == "Metribuzina 48,0 % p/v\nCoformulantes"
    safety = lines.gathered(lines.capture_section(docs, "file", "text", ["precauciones"], ["fabricado"], keep_heading=True), "file").first().text
    assert safety == "Precauciones\nNo aplicar con viento fuerte"
    assert [r.line_no for r in lines.context_evidence(docs, "file", "text", "(?i)lenteja", DOSE_PATTERNS).collect()] == [9]
    kinds = {r.content_category for r in chunk.comprehensive_chunks(docs, "file", "text", "herbicida", HEADINGS).collect()}
    assert kinds == {"general_info", "composition", "safety", "commercial", "descriptive", "full_document"}
    long = "Lenteja y trigo: aplicar en cobertura total 0,5 - 1,5 kg/ha antes de que las malezas tengan tres hojas verdaderas en todo el campo."
    row = extract.structured_lines(spark.createDataFrame([(1, long), (2, "corta")], "line_no int, line string"), "(?i)lenteja|trigo").first()
    assert (row.crops, row.dose_low, row.dose_high, row.unit) == ("Lenteja, Trigo", 0.5, 1.5, "kg/ha")


def test_pages_round_trip(spark):
    pages = spark.createDataFrame([("a", 1, "uno"), ("a", 2, " "), ("a", 3, "tres"), ("b", 1, None)], "f string, p int, text string")
    whole = lines.assemble_pages(pages, "f", "p", "text")
    assert sorted(map(tuple, lines.split_pages(whole, "f", "text").collect())) == [("a", 1, "uno"), ("a", 3, "tres")]
    assert sorted(map(tuple, lines.split_pages(whole, "f", "text", strict_reference=True).collect()))[0] == ("a", 2, "uno")


def test_tables(spark):
    cells = [["Cultivo", "Dosis (kg/ha)", "Malezas"], ["Lenteja, Trigo", "0,5 kg/ha", "ballica"], [None, "", None], ["Arroz", None, "hualcacho"]]
    df = spark.createDataFrame([("f", 1, cells), ("f", 2, [["solo"]])], "file string, no int, cells array<array<string>>")
    rows = tables.table_rows(df, ["file", "no"], "cells")
    assert [r.row_no for r in rows.orderBy("row_no").collect()] == [1, 3]
    first = tables.described_rows(rows, [k for k, _ in WEEDS]).orderBy("row_no").first()
    assert (first.crops, first.targets, first.dose, first.unit, first.has_dose) == ("Lenteja, Trigo", "Ballica", "0,5 kg/ha", "kg/ha", True)
    assert "Cultivo: Lenteja, Trigo" in first.text
    assert rows.select(tables.interpreted(F.col("headers"), F.col("row")).alias("x")).first().x == "Dosis: 0,5 kg/ha | Cultivo: Lenteja, Trigo | Maleza: ballica"
    assert [(r.row_no, r.col_no, r.dose) for r in tables.dose_cells(df, ["file"], "cells").collect()] == [(1, 1, "0,5 kg/ha")]
    twice = df.unionByName(df.withColumn("no", F.col("no") + 10))
    assert tables.without_repeats(twice, "cells", ["file"], ["no"]).count() == 2
    merged = chunk.file_chunks(rows.select("file", F.lit("row").alias("text")), spark.createDataFrame([("f", "t", "full")], "file string, text string, content_category string"), "file", F.lit("P"))
    assert merged.count() == 3 and set(merged.columns) == {"file", "text", "content_category", "product"}


def test_evidence_and_ladder(spark):
    chunks = [("a", "table_row", "CULTIVO: Lenteja\nDOSIS: 1,0\nUNIDAD: kg/ha"), ("a", "text", "lenteja dosis 2 kg/ha\nsin nada"), ("a", "table_row", "DOSIS: 3 kg/ha en trigo")]
    df = spark.createDataFrame(chunks, "file string, type string, text string")
    got = {r.tier: r.evidence for r in score.chunk_evidence(df, "file", ["lenteja"], DOSE_PATTERNS).collect()}
    assert got["table_crop"] == "Lenteja | 1,0 kg/ha" and got["text_crop"].startswith("lenteja") and "table_other" in got
    tags = spark.createDataFrame([("LENTEJA - x",), ("CONTEXTO LENTEJA - y",)], "text string")
    assert [r[0] for r in tags.select(score.evidence_kind(F.col("text"), "LENTEJA")).collect()] == ["direct", "context"]
    assert [r[0] for r in tags.select(score.evidence_kind(F.col("text"), "LENTEJA", overlap=True)).collect()] == ["direct", "direct"]
    cases = [
        (True, True, 9, 1, 0, "i", [], "x", 9, "SKIP"), (False, True, 2, 1, 0, "", [], "x", 9, "HIGH"), (False, True, 2, 0, 1, "i", [], "x", 9, "MEDIUM"), (False, True, 2, 0, 0, "i", [], "x", 9, "MEDIUM"),
        (False, True, 0, 1, 0, "i", [], "x", 9, "MEDIUM"), (False, True, 0, 0, 3, "i", [], "x", 9, "LOW"), (False, False, 0, 0, 0, "i", ["haba"], "Herbicida", 9, "MEDIUM"),
        (False, False, 0, 0, 0, None, ["haba"], "Herbicida", 9, "LOW"), (False, False, 0, 0, 0, None, [], "x", 4, "SKIP"), (False, False, 0, 0, 0, None, [], "x", 5, "LOW"),
    ]
    df = spark.createDataFrame(cases, "p boolean, n boolean, r int, d int, c int, i string, rel array<string>, ty string, ch int, want string")
    level, advice, reasons = score.priority(*(F.col(c) for c in ("p", "n", "r", "d", "c", "i", "rel", "ty", "ch")))
    rows = df.select("want", level.alias("got"), advice.alias("advice"), reasons.alias("why")).collect()
    assert [r.got for r in rows] == [r.want for r in rows] and all(r.why and r.advice for r in rows)
    merged = score.evaluations(spark.createDataFrame([("a",), ("b",)], "file string"), "file", [df.limit(1).select(F.lit("a").alias("file"), "r")], ["r"])
    assert sorted(map(tuple, merged.collect())) == [("a", 9), ("b", 0)]


def test_requests(spark):
    cases = [({"body": {"messages": [{"content": "a"}, {"content": "b"}]}}, "b"), ({"messages": [{"content": " "}, {"content": "c"}]}, "c"), ({"message": "d"}, "d"), ({"data": {"text": "e"}}, "e"), ({"other": 1}, None), ({"z": {"n": 5, "y": [{"q": 1}, {"content": 7, "text": " f "}]}, "a": {"text": "late"}}, "f"), ({"a": {"b": {"c": {"d": {"text": "too deep"}}}}}, None), ({"a": [{"b": {"prompt": "g"}}]}, "g")]
    df = spark.createDataFrame([(json.dumps(x),) for x, _ in cases] + [("{broken",)], "text string")
    assert [r[0] for r in df.select(convo.user_message(F.col("text"))).collect()] == [w for _, w in cases] + [None]
    replies = [({"choices": [{"message": {"content": "x"}}]}, "x"), ({"output": "y"}, "y")]
    df = spark.createDataFrame([(json.dumps(x),) for x, _ in replies] + [("plain",)], "text string")
    assert [r[0] for r in df.select(convo.reply_content(F.col("text"))).collect()] == ["x", "y", "plain"]
    days = spark.createDataFrame([("¿llueve mañana?",), ("hoy",), ("los próximos 12 días",), ("nada",)], "text string")
    assert [r[0] for r in days.select(convo.days_in(F.col("text"))).collect()] == [2, 1, 7, None]
    answers = spark.createDataFrame([(1, "weather", "w" * 60), (1, "rag", "r" * 60), (2, "expert", "e" * 60), (2, "rag", "short")], "k int, source string, text string")
    got = {r.k: r for r in convo.chosen_source(answers, "k").collect()}
    assert (got[1].source, got[1].n, got[2].source) == ("rag", 2, "expert") and got[2].answer.endswith("Fuente: expert")
    assert one(spark, "x", convo.footer({"docs": F.lit(True), "tiempo": F.lit(False)})) == "Fuentes: docs"
    assert json.loads(one(spark, "a b", convo.envelope(F.lit("1"), "m", F.col("text"), F.col("text"))))["usage"] == {"prompt_tokens": 4, "completion_tokens": 2, "total_tokens": 6}


QUESTIONS = [
    ("¿Cómo estará el clima en Quirihue los próximos 3 días?", "forecast", 3, "Quirihue"), ("Temperatura mañana en Santiago", "forecast", 2, "Santiago"), ("Pronóstico de la semana en Punta Arenas", "forecast", 7, "Punta Arenas"),
    ("¿Qué temperatura hay en Valparaíso?", "current", 1, "Valparaíso"), ("Lluvia en Puerto Montt", "current", 1, "Puerto Montt"), ("Tiempo actual en Isla de Pascua", "current", 1, "Isla de Pascua"),
    ("Clima en Torres del Paine", "current", 1, "Paine"), ("Pronóstico de 5 días para Puerto Williams", "forecast", 5, "Puerto Williams"),
]


def test_weather_questions(spark):
    aliases = ["santiago", "paine", "quirihue", "punta arenas", "valparaíso", "puerto montt", "isla de pascua", "torres del paine", "puerto williams"]
    names = {"valparaíso": "Valparaíso", "isla de pascua": "Isla de Pascua", "torres del paine": "Torres del Paine"}
    table = spark.createDataFrame([(i, a, names.get(a, a.title())) for i, a in enumerate(aliases)], "ord int, alias string, place string")
    df = spark.createDataFrame([(i, q) for i, (q, *_) in enumerate(QUESTIONS)], "qid int, text string")
    rows = weather.located(df, "qid", "text", table).select("qid", "place", weather.weather_period(F.col("text")).alias("w")).orderBy("qid").collect()
    assert [(r.w.is_weather, r.w.period, r.w.days, r.place) for r in rows] == [(True, p, d, place) for _, p, d, place in QUESTIONS]
    longest = weather.located(df, "qid", "text", table, match="longest").filter("qid = 6").first()
    assert longest.place == "Torres del Paine"
    assert one(spark, "n/a", weather.rain_class(F.col("text"))) == "unknown"
    assert one(spark, "2024-05-01T10:00:00Z", weather.iso_day(F.col("text"))).isoformat() == "2024-05-01"
    assert one(spark, "x", weather.feels_like(F.lit(10.0), F.lit(8.0))) is not None and one(spark, "x", weather.feels_like(F.lit(10.0), F.lit(10.0))) is None


def test_payloads(spark):
    day = {"time": "2024-01-01T00:00:00Z", "values": {"temperatureMin": 1.0, "temperatureMax": 9.0, "temperatureAvg": 5.0, "humidityAvg": 60.0, "windSpeedAvg": 3.0, "precipitationProbabilityAvg": 10.0}}
    df = spark.createDataFrame([("p", json.dumps({"timelines": {"daily": [day] * 3}}))], "place string, payload string")
    assert payloads.daily_forecast(df, "place", "payload", F.lit(2)).count() == 2
    now = spark.createDataFrame([("p", json.dumps({"data": {"values": {"temperature": 7.5}}}))], "place string, payload string")
    assert payloads.realtime(now, "place", "payload").first().temperatureApparent == 7.5
    shop = spark.createDataFrame([(1, json.dumps({"paging": {"total": 9}, "results": [{"title": "a", "price": 1500.0, "condition": "new", "shipping": {"free_shipping": True}}]}))], "q int, payload string")
    row = payloads.product_results(shop, "q", "payload").first()
    assert (row.total, row["rank"], row.free_shipping) == (9, 1, True)
    web = spark.createDataFrame([(1, json.dumps({"items": [{"title": "t", "link": "l"}]}))], "q int, payload string")
    assert payloads.web_results(web, "q", "payload").first().title == "t"
    dim = payloads.dimension(spark, {"lentil": {"stages": {"siembra": {"temp": "15-20°C", "nota": "seca"}}}}, "stages")
    assert sorted((r.attribute, r.low, r.high) for r in dim.collect()) == [("nota", None, None), ("temp", 15.0, 20.0)]
    assert one(spark, "x", market.price_text(F.lit(1234567.0))) == "$1.234.567"


def test_files_and_store(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes("ñandú".encode())
    (tmp_path / "in" / "b.txt").write_bytes("ñandú".encode("latin-1"))
    found = files.scan_files(spark, str(tmp_path / "in"), "txt", content=True)
    assert {r[0] for r in found.select(files.decoded(F.lit(""), F.col("content"))).collect()} == {"ñandú"}
    assert one(spark, "data:text/plain;base64," + base64.b64encode(b"hi").decode(), files.inline_bytes(F.col("text"))) == bytearray(b"hi")
    request = json.dumps({"files": [{"name": "a.pdf", "size": 3}], "body": {"files": [{"name": "b.exe", "path": "/b.exe"}]}, "file": {"name": "c.md", "content": "x"}})
    got = files.attachments(spark.createDataFrame([(1, request)], "k int, p string"), "k", F.col("p"))
    assert [r.name for r in got.orderBy("ord").collect()] == ["a.pdf", "b.exe", "c.md"]
    valid = got.filter(files.is_valid(*(F.col(c) for c in ("name", "path", "data", "content", "size"))))
    assert sorted(r.name for r in files.normalised_file(valid).collect()) == ["a.pdf", "c.md"]
    chunks = spark.createDataFrame([("1", "c", "t"), ("2", "c", "u")], "id string, collection string, text string")
    for df in (chunks, chunks.unionByName(spark.createDataFrame([("3", "d", "v")], chunks.schema))):
        store.append(df, str(tmp_path / "store"))
    assert sorted(map(tuple, store.collection_counts(spark.read.parquet(str(tmp_path / "store"))).collect())) == [("c", 2), ("d", 1)]
    for df in (chunks, spark.createDataFrame([("2", "c", "new")], chunks.schema)):
        store.upsert(df, str(tmp_path / "v2"), "id")
    assert {r.id: r.text for r in store.stored(spark, str(tmp_path / "v2"), chunks.schema).collect()} == {"1": "t", "2": "new"}
    _, cache = vectors.embed_unseen(chunks, spark.createDataFrame([], "text_md5 string, embedding array<float>"), "text", dim=8)
    store.save_cache(cache, str(tmp_path / "cache"))
    misses, _ = vectors.embed_unseen(chunks, store.load_cache(spark, str(tmp_path / "cache")), "text", dim=8)
    assert misses.count() == 0
    more, cache = vectors.embed_unseen(chunks.withColumn("text", F.concat("text", "id")), store.load_cache(spark, str(tmp_path / "cache")), "text", dim=8)
    store.save_cache(cache, str(tmp_path / "cache"))  # read from the folder that it's written to
    assert more.count() == 2 and store.load_cache(spark, str(tmp_path / "cache")).count() == 4 and store.load_cache(spark, str(tmp_path / "none")).count() == 0


def test_long_term_lists_meet_by_grams(spark, monkeypatch):
    texts = [(1, "alpha beta"), (2, "Betamax"), (3, "ab"), (4, None), (5, ""), (6, "gamma alpha"), (6, "gamma alpha")]
    df = spark.createDataFrame(texts, "k int, text string")
    terms = spark.createDataFrame([("beta",), ("alpha beta",), ("ab",), ("a",), ("max",), ("",), (None,), ("zz",)], "term string")
    want = sorted((k, w) for k, x in texts for w in ("beta", "alpha beta", "ab", "a", "max", "zz") if x and w in x.lower())
    for most in (100_000, 2):
        monkeypatch.setattr(lexicon, "SMALL_LEXICON", most)
        found = lexicon.occurring(df.distinct(), ["k"], F.lower("text"), terms, "term").select("k", "term")
        assert sorted(map(tuple, found.distinct().collect())) == sorted(set(want))
    names = lexicon.unprocessed(df, "text", spark.createDataFrame([("BETA",), ("",)], "p string"), "p")
    assert sorted((r.k, r.text) for r in names.collect() if r.text) == [(3, "ab"), (6, "gamma alpha"), (6, "gamma alpha")] and names.count() == 5


def test_places_after_prepositions(spark):
    table = spark.createDataFrame([(0, "paine", "Paine"), (1, "Lota", "Lota"), (2, "torres del paine", "Torres del Paine")], "ord int, alias string, place string")
    df = spark.createDataFrame([(1, "clima en Torres del Paine"), (2, "¿Cómo está?"), (3, "tiempo para LÓTA"), (4, None)], "qid int, text string")
    got = {m: [r.place for r in weather.located(df, "qid", "text", table, match=m).orderBy("qid").collect()] for m in ("first", "named")}
    assert got == {"first": ["Paine", "Santiago", "Lota", "Santiago"], "named": ["Torres del Paine", "Santiago", "Lota", "Santiago"]}


@pytest.mark.parametrize("terms", [["tion", "the"], ["aa", "b"], ["a", "ab"], ["dosis", "plaga", "aplica"], []])
def test_counts_of_terms(spark, terms):
    texts = ["", "aaaa b abab", "the thetion plagaplica dosisdosis", "x" * 50, "tiontion th"]
    df = spark.createDataFrame([(x,) for x in texts], "text string")
    assert [r[0] for r in df.select(t.count_all(F.col("text"), terms)).collect()] == [sum(x.count(w) for w in terms) for x in texts]


def test_dose_styles(spark):
    texts = spark.createDataFrame([(0, "0,5 - 1,0 kg/ha"), (1, "2 L/ha"), (2, "nada")], "k int, text string")
    got = {s: [tuple(r.x) for r in texts.select("k", extract.dose_text(F.col("text"), s).alias("x")).orderBy("k").collect()] for s in ("dash", "bare", "spaced")}
    assert got == {"dash": [("0,5-1,0", "kg/ha"), ("2-", "L/ha"), (None, None)], "bare": [("0,5-1,0", "kg/ha"), ("2", ""), (None, None)], "spaced": [("0,5 - 1,0", "kg/ha"), ("2", "L/ha"), (None, None)]}


def test_vector_blocks(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(-3, 4, 6).astype(float).tolist()) for i in range(400)] + [(900, None)]
    df = spark.createDataFrame(rows, "id bigint, embedding array<float>").repartition(5)
    asked = [(f"q{i}", rows[i][1], i % 4) for i in range(40)]
    queries = spark.createDataFrame(asked, "qid string, embedding array<float>, k int")
    x = np.array([r or [0.0] * 6 for _, r in rows])
    for blocks_, most in ((1024, 10_000), (64, 10)):  # broadcast, and dealt out
        monkeypatch.setattr(vectors, "BLOCK", blocks_)
        monkeypatch.setattr(vectors, "MOST_QUERIES", most)
        got = sorted((r.qid, r["rank"], r.id) for r in vectors.batch_top_k(df, queries, "k", metric="l2").collect())
        want = []
        for name, q, k in asked:
            near = sorted((-(1 - ((x[j] - q) ** 2).sum()), rows[j][0]) for j in range(len(rows)))[:k]
            want += [(name, n + 1, i) for n, (_, i) in enumerate(near)]
        assert got == sorted(want)


def test_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 0.0]), (4, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "id bigint, embedding array<float>")
    top = vectors.top_k(df, [1.0, 0.0], 4).orderBy("rank").collect()
    assert [r.id for r in top] == [3, 1, 4, 2] and top[3].similarity == 0.0
    queries = spark.createDataFrame([(9, [1.0, 0.0], 1), (8, [0.0, 1.0], 2)], "qid bigint, embedding array<float>, k int")
    got = sorted((r.qid, r["rank"], r.id) for r in vectors.batch_top_k(df.repartition(3), queries, "k").collect())
    assert got == [(8, 1, 4), (8, 2, 1), (9, 1, 1)]
    hits = spark.createDataFrame([(1, 1, "f.pdf", "t", 0.5), (1, 2, "g.pdf", "u", 0.25)], "qid int, rank int, file string, text string, similarity double")
    assert vectors.reference_list(hits, "qid", "rank", F.col("file"), F.col("similarity")).first().references == "[1] f.pdf (50.00%)\n[2] g.pdf (25.00%)"
    assert vectors.result_listing(hits, "qid", "rank", F.col("file"), F.col("similarity"), F.col("text")).first().listing.startswith("1. f.pdf (relevancia 50.0%)\nt")
    assert vectors.rerank(hits, 1).count() == 1


def test_filter_runs_after_the_cut(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0])], "id bigint, embedding array<float>")
    texts = spark.createDataFrame([(1, "x", "s"), (2, "x", "s"), (3, "ballica", "s")], "id bigint, text string, source string")
    queries = spark.createDataFrame([(7, [1.0, 0.0], "ballica")], "qid bigint, embedding array<float>, query string")
    assert vectors.search_and_filter(df, queries, texts, 1, 5, weed=["ballica"]).count() == 0
    assert vectors.search_and_filter(df, queries, texts, 2, 5, weed=["ballica"]).count() == 1


def test_lexicon_edges(spark):
    df = spark.createDataFrame([(None,), ("",), ("TRIGO y Lenteja",)], "text string")
    assert [r[0] for r in df.select(t.first_match(F.col("text"), CROPS, "-")).collect()] == ["-", "-", "lenteja"]
    assert [r[0] for r in df.select(t.all_matches(F.col("text"), CROPS)).collect()] == [[], [], ["lenteja", "trigo"]]
    assert one(spark, "herbicida para trigo", t.two_pass_match(F.col("text"), [("HERB", ["herb"]), ("TR", ["trigo"])], [("herb", "herbicida")])) == "TR"
    assert one(spark, "clima en san carlos hoy", t.captured(F.col("text"), [r"en ([a-zñ]+ [a-zñ]+)"])) == "San Carlos"
    assert lexicon.allowed(df, "text", df.limit(0)).count() == 3


@settings(max_examples=60, deadline=None)
def plain_segments(text, limit):
    rest, out = text.strip(), []
    while len(rest) > limit:
        at = rest.rfind("\n", 0, limit)
        at = at if at >= int(limit * 0.6) else rest.rfind(" ", 0, limit)
        at = at if at >= int(limit * 0.6) else limit
        out += [rest[:at].strip()] if rest[:at].strip() else []
        rest = rest[at:].strip()
    return out + [rest] if rest or not out else out


def plain_windows(found, size, share, tail):
    out, now = [], []
    for word in found:
        now.append(word)
        if sum(len(w) + 1 for w in now) >= size:
            out.append(" ".join(now))
            now = now[len(now) - int(len(now) * share) :]
    return out + [" ".join(now)] if now and len(" ".join(now)) > tail else out


def odd_texts():
    rng = np.random.default_rng(7)
    made = ["".join(rng.choice(list("ab \n"), int(n), p=[0.4, 0.35, 0.2, 0.05])) for n in rng.integers(0, 400, 150)]
    return [*made, None, "", " \n ", "x" * 900, "ü\u2003é\x85漢字 😀\xa0word " * 40, "\x1c a \x1f", "one " * 30 + "y" * 200 + " two" * 30]


@pytest.mark.parametrize("limit", [7, 40, 150])
def test_segments_equal_plain_ones(spark, limit):
    rows = list(enumerate(odd_texts()))
    got = {}
    for r in convo.segments(spark.createDataFrame(rows, "id int, t string"), ["id"], "t", limit).collect():
        got.setdefault(r.id, []).append((r.part, r.parts, r.text))
    for i, t in rows:
        want = plain_segments(t or "", limit)
        assert sorted(got[i]) == [(k + 1, len(want), f"[{k + 1}/{len(want)}] {x}" if len(want) > 1 else x) for k, x in enumerate(want)]
        assert "".join("".join(want).split()) == "".join((t or "").split())


@pytest.mark.parametrize("size, overlap", [(40, 8), (25, 20), (500, 100)])
def test_chunks_equal_plain_ones(spark, size, overlap):
    rows = list(enumerate(odd_texts()))
    df = spark.createDataFrame(rows, "id int, t string")
    plan = chunk.word_chunks(df, ["id"], "t", size, overlap)
    got = sorted(map(tuple, plan.collect()))
    assert got == sorted((i, k, x) for i, t in rows for k, x in enumerate(plain_windows((t or "").split(), size, overlap / size, 50)))
    assert "Python" not in plan._jdf.queryExecution().toString()


def test_a_very_long_text_is_cut_in_one_pass(spark):
    text = "word and more\n" * 150_000  # 2 MB
    df = spark.createDataFrame([(1, text)], "id int, t string")
    assert chunk.word_chunks(df, ["id"], "t").count() == len(plain_windows(text.split(), 500, 0.2, 50))
    assert convo.segments(df, ["id"], "t").count() == len(plain_segments(text, 1500))


def test_terms_with_one_beginning_are_found_by_their_rarest_gram(spark, monkeypatch):
    """200,000 terms that begin alike: no gram gets more than a sliver of them, and finds are those of a plain search."""
    terms = spark.range(200_000).select(F.concat(F.lit("http://site.example/"), F.lpad(F.conv(F.abs(F.xxhash64("id")).cast("string"), 10, 36), 7, "0")).alias("term"))
    rows = [(i, f"see http://site.example/ and http://site.example/{x} or {x}") for i, x in enumerate(r.term[20:] for r in terms.limit(150).collect())] + [(900, None), (901, ""), (902, "http://site.example/" * 50)]
    texts = spark.createDataFrame(rows, "k int, t string").repartition(3)
    posted = lexicon.posted(terms, "term", lexicon.gram_counts(texts.select("t"), "t", [4])).groupBy("gram_").count()
    assert posted.agg(F.max("count")).first()[0] < 2_000  # a hundredth
    got = sorted((r.k, r.term) for r in lexicon.occurring(texts, ["k"], F.col("t"), terms, "term").collect())
    every = {r.term for r in terms.collect()}
    assert got == sorted({(k, x) for k, t in rows for x in (t or "").split() if x in every}) and len(got) == 150


def test_upsert_writes_touched_buckets_and_keeps_versions(spark, tmp_path, monkeypatch):
    path, kind = str(tmp_path / "store"), "k int, v string"
    rows = lambda *x: spark.createDataFrame(list(x), kind)
    files = lambda: {p.name for p in (tmp_path / "store").rglob("*.parquet")}
    schema = rows((1, "a")).schema
    assert store.stored(spark, path, schema).count() == 0
    assert store.upsert(rows(*((i, "old") for i in range(200)), (None, "no key")), path, "k", buckets=16) == 1
    before, held = files(), store.manifest(spark, path, 1)
    assert store.upsert(rows((3, "new"), (500, "new"), (3, "newer"), (None, "again")), path, "k", order=F.col("v")) == 2
    now = store.manifest(spark, path, 2)
    assert len(now) == 16 and before <= files() and sum(now[b] != held[b] for b in now) <= 3
    want = {i: "old" for i in range(200)} | {3: "newer", 500: "new", None: "again"}
    assert sorted(map(str, store.stored(spark, path, schema).collect())) == sorted(str(r) for r in rows(*want.items()).collect())
    assert store.stored(spark, path, schema, version=1).count() == 201
    monkeypatch.setattr(store, "newest", lambda *_: 1)  # a writer that hasn't seen version 2
    with pytest.raises(FileExistsError):
        store.upsert(rows((4, "late")), path, "k")
    monkeypatch.undo()
    assert {r.k: r.v for r in store.stored(spark, path, schema).collect()} == want


def test_cache_is_a_log_of_deltas(spark, tmp_path):
    path = str(tmp_path / "cache")
    made = lambda *keys: spark.createDataFrame([(k, [float(len(k))]) for k in keys], store.CACHE)
    for keys in (("a", "bb"), ("bb", "ccc", "ccc"), ("a",), ("a",)):
        store.save_cache(made(*keys), path)
    written = [sum(1 for _ in spark.read.parquet(str(p)).toLocalIterator()) for p in sorted((tmp_path / "cache").glob("version=*/whole=0"))]
    assert written == [2, 1, 0]  # new keys alone
    want = [("a", [1.0]), ("bb", [2.0]), ("ccc", [3.0])]
    assert sorted(map(tuple, store.load_cache(spark, path).collect())) == want
    store.compact_cache(spark, path)
    store.save_cache(made("a", "dddd"), path)
    assert sorted(map(tuple, store.load_cache(spark, path).collect())) == [*want, ("dddd", [4.0])]
    assert [p.name for p in sorted((tmp_path / "cache").glob("version=*/*"))][-2:] == ["whole=1", "whole=0"]


def test_blocks_of_queries_that_begin_alike_stay_apart(spark, monkeypatch):
    """Two blocks with the same first ids and vectors: each query has its own finds, above the bound of a group too."""
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(60)]
    queries = [(q, rng.normal(size=4).tolist(), 3) for q in range(30)]
    queries = queries + queries[:2] + [(100 + q, v, 3) for q, v, _ in queries]
    df, asked = spark.createDataFrame(rows, "id int, embedding array<double>"), spark.createDataFrame(queries, "qid int, embedding array<double>, k int").coalesce(1)
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = {q: np.argsort(-(x @ np.array(v)), kind="stable")[:3].tolist() for q, v, _ in queries}
    for most in (10_000, 40):
        monkeypatch.setattr(vectors, "BLOCK", 16)
        monkeypatch.setattr(vectors, "MOST_QUERIES", most)
        got = {}
        for r in vectors.batch_top_k(df.repartition(2), asked, "k").orderBy("qid", "rank").collect():
            got.setdefault(r.qid, []).append(r.id)
        assert {q: list(dict.fromkeys(ids)) for q, ids in got.items() if q > 1} == {q: ids for q, ids in want.items() if q > 1}
        assert set(got) == set(want)


def test_vector_index_reads_few_cells_and_is_exact_by_default(spark, tmp_path):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(60, 24))
    rows = [(i, (centres[i % 60] + 0.25 * rng.normal(size=24)).tolist()) for i in range(6000)] + [(7000, None), (7001, [0.0] * 24), (7002, [1.0]), (7003, [2.0] * 24)]
    df = spark.createDataFrame(rows, "id int, embedding array<double>")
    queries = df.filter("id % 50 = 0").select(F.col("id").alias("qid"), "embedding")
    path = str(tmp_path / "index")
    vector_index.build(df, path, cells=60)
    exact = vectors.batch_top_k(df, queries, 10, digits=9).cache()
    assert sorted(map(tuple, vector_index.search(spark, path, queries, 10, digits=9).collect())) == sorted(map(tuple, exact.collect()))
    real = queries.filter("qid < 7000")
    found = vector_index.search(spark, path, real, 10, probes=4)
    assert vector_index.recall(found, exact.filter("qid < 7000")) >= 0.9
    sizes = {r.cell: r.n for r in spark.read.parquet(f"{path}/cells").collect()}
    assert sum(sizes.values()) == len(rows) and sizes[-1] == 3
    assert 4 * max(sizes.values()) < len(rows) / 10 + 300 and sum(sorted(sizes.values())[-4:]) / len(rows) < 0.2
    one = vector_index.search(spark, path, real.limit(1), 10, probes=4)
    assert one.count() == 10
    empty = str(tmp_path / "empty")
    vector_index.build(df.limit(0), empty)
    assert vector_index.search(spark, empty, queries, 3).count() == 0


def test_percents_are_rounded_by_their_exact_values(spark):
    values = [0.1225, 0.1235, 0.12345, 0.00125, 0.01005, -0.00001, 1.0, None]
    hits = spark.createDataFrame([(i, 1, "f", x, "t") for i, x in enumerate(values)], "qid int, rank int, file string, s double, text string")
    refs = vectors.reference_list(hits, "qid", "rank", F.col("file"), F.col("s")).orderBy("qid").collect()
    assert [r.references for r in refs] == [f"[1] f ({x * 100:.2f}%)" if x is not None else "[1] f (null%)" for x in values]
    listing = vectors.result_listing(hits, "qid", "rank", F.col("file"), F.col("s"), F.col("text")).orderBy("qid").collect()
    assert [r.listing for r in listing] == [f"1. f (relevancia {x * 100:.1f}%)\nt" if x is not None else "1. f (relevancia null%)\nt" for x in values]


@pytest.mark.parametrize("name", ["label_fields", "comprehensive_chunks"])
def test_work_on_a_small_file_is_dealt_to_all_cores(spark, small, name):
    assert QUERIES[name](spark, small).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_words_are_cut_at_all_white_space(spark):
    text = " a\u3000bb\x1cccc\u2003dd\xa0e\n\nffff "
    assert chunk.word_windows(text, 6, 0.5, 2) == ["a bb ccc", "ccc dd", "dd e ffff", "ffff"]
    assert chunk.word_windows(text, 500, 0.2, 50) == [] and chunk.word_windows(None, 5, 0.2, 0) == []
    rows = chunk.windows_of(spark.createDataFrame([(text,), (None,)], "text string"), "cut", F.col("text"), 6, F.lit(0.5), F.lit(2))
    assert [r.cut for r in rows.collect()] == [["a bb ccc", "ccc dd", "dd e ffff", "ffff"], []]


def test_python_gets_batches_of_bounded_size(spark):
    name, sizes = "spark.sql.execution.arrow.maxBytesPerBatch", []
    before = spark.conf.get(name)
    try:
        for given in ("64m", "1k"):  # a smaller setting stays
            spark.conf.set(name, given)
            texts = spark.range(0, 40, 1, 1).select(F.concat(F.repeat(F.lit("x"), 1_000_000), F.col("id").cast("string")).alias("text"))
            empty = spark.createDataFrame([], "text_md5 string, embedding array<float>")
            _, cache = vectors.embed_unseen(texts, empty, "text", 1, embedder=lambda rows, dim: [[float(sum(map(len, rows)))]] * len(rows))
            sizes.append(max(r.embedding[0] for r in cache.collect()))
    finally:
        spark.conf.set(name, before)
    assert 4e6 < sizes[0] < 12e6 and sizes[1] < 2e6


def test_vector_index_sends_each_query_once_however_many_cells_it_wants(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(7)
    df = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(600)], "id int, embedding array<double>")
    queries = df.filter("id % 20 = 0").select(F.col("id").alias("qid"), "embedding")
    path, sent, pack = str(tmp_path / "index"), [], vector_index.in_blocks
    vector_index.build(df, path, cells=24)

    def counted(rows, id_col, vector_col, name, *rest, **more):
        sent.extend([rows.count()] if name == "q" else [])
        return pack(rows, id_col, vector_col, name, *rest, **more)

    monkeypatch.setattr(vector_index, "in_blocks", counted)
    monkeypatch.setattr(vectors, "BLOCK", 16)
    monkeypatch.setattr(vectors, "MOST_QUERIES", 16)  # two groups
    got = vector_index.search(spark, path, queries, 5, digits=9)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, vectors.batch_top_k(df, queries, 5, digits=9).collect()))
    assert sent == [30, 30]  # once in each round, though vectors without clusters want nearly all cells


def test_streams_equal_batches(spark, tmp_path, small):
    turns = spark.read.parquet(f"{small}/conversations.parquet")
    turns.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = jobs.memory(stream).writeStream.outputMode("update").format("memory").queryName("memory_out").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    seen = {}
    for r in spark.sql("SELECT * FROM memory_out").collect():
        seen.setdefault(r.conv_id, []).append(r.memory)
    want = {r.conv_id: r.memory for r in convo.rolling_memory(turns).collect()}
    assert set(seen) == set(want) and all(want[k] in v for k, v in seen.items())
    q = jobs.framed(stream, ["conv_id", "turn"], "text").writeStream.outputMode("append").format("memory").queryName("frames_out").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT count(*) FROM frames_out").first()[0] == convo.frames(turns, ["conv_id", "turn"], "text").count()
    route = {"route": convo.routed(F.col("text"), [("a", ["the"])])}
    q = jobs.routed(stream, route).writeStream.format("memory").queryName("routes_out").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT count(*) FROM routes_out WHERE route = 'a'").first()[0] == turns.withColumns(route).filter("route = 'a'").count()

    def chunker(df):
        return store.with_ids(df.select(F.col("conv_id").cast("string").alias("f"), "turn", "text"), "f", ["turn"]).withColumn("collection", F.lit("c"))

    for k in range(2):  # a second run over the same files adds nothing
        one_file = spark.readStream.schema(turns.schema).parquet(str(tmp_path / "in"))
        jobs.ingest(one_file, chunker, str(tmp_path / "chunks"), str(tmp_path / f"c4{k}")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "chunks")).count() == turns.count()


@pytest.mark.parametrize("parts", [1, 5])
def test_order_of_rows_does_not_matter(spark, small, parts):
    docs = spark.read.parquet(f"{small}/documents.parquet").repartition(parts)
    evidence = lambda x: sorted(map(tuple, lines.context_evidence(x, "doc_id", "text", "(?i)license", ["[0-9]+"]).select("doc_id", "line_no").collect()))
    assert evidence(docs) == evidence(docs.coalesce(1))


def test_accent_fold_of_whole_texts(spark, tmp_path):
    import hashlib
    import unicodedata

    from siftfield.plans.registry import QUERIES

    late = "x" * 400 + " ÁÀÂÄ ÉÈÊË ÍÌÎÏ ÓÒÔÖ ÚÙÛÜ Ñ Ç áàâä éèêë íìîï óòôö úùûü ñ ç ß 漢 ж"
    rows = [(1, late, "es"), (2, late, "de"), (3, "Müller à Ölçü", None), (4, None, "fr"), (5, "", "en"), (6, "ÊÈÇÂÀ", "fr"), (6, "ÊÈÇÂÀ", "fr")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))

    def plain(text):
        return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))

    want = sorted((i, x if x is None else hashlib.md5(plain(x).encode()).hexdigest()) for i, x, _ in rows)
    got = sorted((r.doc_id, r.folded) for r in QUERIES["accent_fold_whole"](spark, str(tmp_path)).collect())
    assert got == want and len({x for i, x in got if i in (1, 2)}) == 1


def memory_run(spark, tmp_path, **options):
    """Senders' newest memories after a run over what has arrived since the last one; the state is that of the path."""
    seen = {}

    def keep(batch, _):
        seen.update({r.conv_id: r.memory for r in batch.collect()})

    stream = spark.readStream.schema("conv_id bigint, turn int, role string, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.memory(stream, **options).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    return seen


def arrive(spark, tmp_path, rows):
    spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))


@pytest.fixture
def no_empty_batches(spark):
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def test_memory_survives_a_restart(spark, tmp_path):
    arrive(spark, tmp_path, [(1, k, "u", f"a{k}") for k in range(500)] + [(2, 1, "u", "b"), (None, 1, "u", "n"), (None, 2, None, "x")])
    assert memory_run(spark, tmp_path, last=3) == {1: "u: a497\nu: a498\nu: a499", 2: "u: b", None: "u: n"}
    arrive(spark, tmp_path, [(1, 498, "v", "late"), (1, None, "u", "no turn"), (2, 0, "u", "before"), (2, None, "u", "first")])
    assert memory_run(spark, tmp_path, last=3) == {1: "u: a498\nv: late\nu: a499", 2: "u: first\nu: before\nu: b"}  # senders without news aren't told
    assert memory_run(spark, tmp_path, last=3) == {}


def test_silent_senders_are_forgotten(spark, tmp_path, no_empty_batches):
    arrive(spark, tmp_path, [(1, 1, "u", "old"), (2, 1, "u", "old")])
    assert memory_run(spark, tmp_path, silent_ms=3_600_000) == {1: "u: old", 2: "u: old"}
    arrive(spark, tmp_path, [(1, 2, "u", "new")])
    assert memory_run(spark, tmp_path, silent_ms=3_600_000) == {1: "u: old\nu: new"}
    (tmp_path / "short").mkdir()
    arrive(spark, tmp_path / "short", [(1, 1, "u", "old"), (2, 1, "u", "old")])
    memory_run(spark, tmp_path / "short", silent_ms=1000)
    time.sleep(2)
    arrive(spark, tmp_path / "short", [(1, 2, "u", "new")])
    assert memory_run(spark, tmp_path / "short", silent_ms=1000) == {1: "u: new"}


def test_many_stages_meet_days_by_ranges(spark):
    rng = np.random.default_rng(3)
    stages = [("a", f"s{k}", int(x), int(x + w), 5.0) for k, (x, w) in enumerate(zip(rng.integers(-50, 400, 300), rng.choice([-1, 0, 1, 7, 30, 5000], 300)))]
    stages += [("b", "all", -(2**31), 2**31 - 1, 20.0), ("b", "none", 9, 3, 20.0), (None, "x", 0, 9, 1.0), ("a", "open", None, 9, 1.0), ("a", "s0", *stages[0][2:])]
    rows = [(i, str(rng.choice(["a", "b", "c"])), int(x), float(i % 12)) for i, x in enumerate(rng.integers(-60, 600, 200))] + [(900, "a", None, 1.0), (901, None, 3, 1.0), (900, "a", None, 1.0)]
    table = spark.createDataFrame(stages, "crop string, stage string, day_from int, day_to int, temp_critical double")
    df = spark.createDataFrame(rows, "id int, crop string, days int, temp double").withColumnRenamed("crop", "grown")
    few = weather.stage_risk(df, "grown", "days", "temp", table)
    many = weather.stage_risk(df, "grown", "days", "temp", table, most=10)
    want = []
    for i, crop, day, temp in rows:
        hits = [s for s in stages if crop is not None and day is not None and s[0] == crop and s[2] is not None and s[2] <= day <= s[3]]
        want += [(i, s[1], "risk" if temp < s[4] else "ok") for s in hits] or [(i, None, None)]
    told = lambda x: sorted(map(tuple, x.select("id", "stage", "risk").collect()), key=str)
    assert told(few) == told(many) == sorted(want, key=str) and few.columns == many.columns
    assert weather.stage_risk(df.limit(0), "grown", "days", "temp", table, most=0).count() == 0
    assert {r.stage for r in weather.stage_risk(df, "grown", "days", "temp", table.filter("stage = 'none'"), most=0).collect()} == {None}


def test_a_hundred_thousand_stages_of_one_crop(spark):
    """Every day has its own windows: no range of days gathers more than a few of them."""
    n = 100_000
    stages = spark.range(n).select(F.lit("a").alias("crop_"), F.col("id").alias("stage"), F.col("id").alias("day_from"), (F.col("id") + F.col("id") % 5).alias("day_to"), F.lit(1.0).alias("temp_critical"))
    points = spark.range(0, n, 7).select(F.lit("a").alias("crop_"), F.col("id").alias("day_"))
    met = weather.windows_of(points, stages, "crop_", "day_", "day_from", "day_to")
    assert met.count() == sum(1 for d in range(0, n, 7) for s in range(max(0, d - 4), d + 1) if s + s % 5 >= d)
    held = met.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert max(r["count"] for r in held) <= 2 * sorted(r["count"] for r in held)[len(held) // 2]


def test_samples_are_cut_before_the_shuffle(spark):
    rows = [("f", "t", k, f"x{k}") for k in range(2000)] + [("f", None, 2, None), ("f", None, 1, "y"), (None, "t", 1, "z"), (None, "t", 1, "z")]
    df = spark.createDataFrame(rows, "file string, tag string, no int, text string").repartition(3)
    out = score.evidence_counts(df, "file", "tag", "no", "text")
    assert {(r.file, r.tag): (r.n, r.samples) for r in out.collect()} == {("f", "t"): (2000, ["x0", "x1", "x2"]), ("f", None): (2, ["y"]), (None, "t"): (2, ["z", "z"])}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert score.evidence_counts(df.limit(0), "file", "tag", "no", "text").count() == 0


def test_ids_of_large_files_are_numbered_by_ranges(spark):
    rng = np.random.default_rng(5)
    rows = [("big", int(k), None if k % 50 == 0 else f"t{k % 7}", int(k)) for k in rng.permutation(3000)] + [("small", k, "t", k) for k in range(4)] + [(None, k, "t", k) for k in range(300)] + [("f_", 7, "t", 1)]
    df = spark.createDataFrame(rows, "file string, no bigint, text string, id bigint").repartition(3)
    for order in (["no"], ["text", "no"]):
        one, two = store.with_ids(df, "file", order), store.with_ids(df, "file", order, hot=100, parts=8)
        told = lambda x: sorted(map(tuple, x.select("file", "no", "text", "id").collect()), key=str)
        assert told(one) == told(two) and sorted(one.columns) == sorted(two.columns)
    ids = {r.no: r.id for r in two.filter("file = 'big'").collect()}
    assert sorted(ids.values(), key=lambda x: int(x.split("_")[1])) == [f"chunk_{k}_big" for k in range(3000)]
    assert store.with_ids(df.limit(0), "file", ["no"], hot=0).count() == 0
    twice = store.with_ids(df.unionByName(df), "file", ["no"], hot=100)  # equal keys: every number is there once all the same
    assert twice.filter("file = 'big'").select("id").distinct().count() == 6000


def test_a_replayed_batch_reads_few_files(spark, tmp_path, monkeypatch):
    path, read = str(tmp_path / "store"), []
    asked = store.files_that_may_hold
    monkeypatch.setattr(store, "files_that_may_hold", lambda *x: read.append(asked(*x)) or read[-1])
    batch = lambda k, n=50: spark.range(k * 1000, k * 1000 + n).select(F.concat(F.lit("chunk_"), "id", F.lit("_ñ")).alias("id"), F.lit("a b%").alias("collection"), F.lit(k).alias("k")).coalesce(1)
    for k in range(6):
        store.append(batch(k, 5000 if k == 3 else 50), path)
    assert spark.read.parquet(path).count() == 5 * 50 + 5000 - 2 * 50  # batches 4 and 5 are within batch 3
    read.clear()
    store.append(batch(1).unionByName(batch(1)), path)
    assert len(read[0].inputFiles()) <= 3 and len(spark.read.parquet(path).inputFiles()) >= 4
    assert spark.read.parquet(path).filter("k = 1").count() == 50
    store.append(batch(3, 5100), path)
    assert spark.read.parquet(path).groupBy("id").count().filter("count > 1").count() == 0 and spark.read.parquet(path).filter("k = 3").count() == 5100
    before = spark.read.parquet(path).count()
    store.append(batch(0), path, filtered=10)  # beyond the bound all files of the collection are read
    assert spark.read.parquet(path).count() == before
