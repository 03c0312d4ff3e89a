"""Queries on conversations, weather, listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftfield.functions import text as t
from siftfield.operators import convo, market, weather
from siftfield.plans.registry import query, table
from siftfield.plans.texts import sql_any, sql_first, sql_words

WEATHER, PRODUCT, GROWING = ["the", "le "], ["license", "die"], ["une", "los"]
PLACES = [("Eins", [" und "]), ("Deux", [" les "]), ("Three", [" of "])]
ROUTES = [("lentil", [" der ", " und "]), ("wheat", [" les "]), ("rice", [" que "])]


def turns(spark, d):
    return table(spark, d, "conversations")


@query("last_user_turn", "SELECT conv_id, arg_max(text, turn) AS last_user FROM conversations WHERE role = 'user' GROUP BY conv_id")
def last_user_turn(spark, d):
    return convo.last_user_turn(turns(spark, d))


BACK = "(SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations)"


@query("history_window", f"SELECT conv_id, turn, role FROM {BACK} WHERE back <= 8 AND role IN ('user', 'assistant')")
def history_window(spark, d):
    return convo.history(turns(spark, d)).select("conv_id", "turn", "role")


@query("before_last", f"SELECT conv_id, turn, substr(text, 1, 300) AS text FROM {BACK} WHERE back BETWEEN 2 AND 6")
def before_last(spark, d):
    return convo.before_last(turns(spark, d)).select("conv_id", "turn", "text")


@query("previous_turn_enrichment", """
SELECT conv_id, turn, concat_ws(' | ', previous, text) AS enriched FROM (
  SELECT conv_id, turn, role, text, substr(last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1, 150) AS previous
  FROM conversations) WHERE role = 'user'""")
def previous_turn_enrichment(spark, d):
    return convo.with_previous_question(turns(spark, d)).select("conv_id", "turn", "enriched")


@query("rolling_memory", f"SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS memory FROM {BACK} WHERE back <= 12 GROUP BY conv_id")
def rolling_memory(spark, d):
    return convo.rolling_memory(turns(spark, d))


#: What questions end with, by turn and conversation: a day, a number of days (held to seven), or nothing.
ENDINGS = "[' hoy', ' mañana', ' próximos ' || conv_id % 12 || ' días', ''][1 + (turn + conv_id) % 4]"


@query("intent_flags", f"""
SELECT conv_id, turn, w AS needs_weather, p OR g AS needs_rag, CASE WHEN g THEN 'growing' WHEN p THEN 'product' WHEN w THEN 'weather' ELSE 'general' END AS query_type, coalesce(place, 'Santiago') AS location,
  (CASE WHEN contains(q, 'mañana') THEN 2 WHEN contains(q, 'hoy') THEN 1 WHEN n <> '' THEN least(n::INT, 7) ELSE 3 END)::INT AS days
FROM (SELECT conv_id, turn, lower(q) AS q, regexp_extract(lower(q), 'pr[oó]ximos?\\s+(\\d{{1,3}})\\s+d[ií]as', 1) AS n, {sql_any('q', WEATHER)} AS w, {sql_any('q', PRODUCT)} AS p, {sql_any('q', GROWING)} AS g, {sql_first('q', PLACES)} AS place
  FROM (SELECT *, text || {ENDINGS} AS q FROM conversations WHERE role = 'user'))""")
def intent_flags(spark, d):
    ending = F.element_at(F.array(F.lit(" hoy"), F.lit(" mañana"), F.concat(F.lit(" próximos "), (F.col("conv_id") % 12).cast("string"), F.lit(" días")), F.lit("")), ((F.col("turn") + F.col("conv_id")) % 4 + 1).cast("int"))
    x = convo.intent(F.concat("text", ending), WEATHER, PRODUCT, GROWING, PLACES, default_place="Santiago", default_days=3)
    return turns(spark, d).filter("role = 'user'").select("conv_id", "turn", x.alias("x")).select("conv_id", "turn", "x.needs_weather", "x.needs_rag", "x.query_type", "x.location", "x.days")


@query("tool_routing", f"""
WITH q AS (SELECT u.conv_id, u.last_user AS q, h.text AS h FROM (SELECT conv_id, arg_max(text, turn) AS last_user FROM conversations WHERE role = 'user' GROUP BY conv_id) u
  LEFT JOIN (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text FROM {BACK} WHERE back BETWEEN 2 AND 6 GROUP BY conv_id) h USING (conv_id)),
f AS (SELECT conv_id, list_filter([CASE WHEN {sql_any("CASE WHEN contains(lower(q), 'license') THEN q ELSE concat_ws(' ', q, h) END", ['the', 'queux'])} THEN 'rag' END, CASE WHEN {sql_any('q', ['und', 'tion'])} THEN 'weather' END, CASE WHEN {sql_any('q', ['los'])} THEN 'prices' END], lambda x: x IS NOT NULL) AS l FROM q)
SELECT conv_id, array_to_string((CASE WHEN len(l) = 0 THEN ['rag', 'expert'] WHEN len(l) > 1 THEN list_append(l, 'expert') ELSE l END)[1:3], ',') AS tools FROM f""")
def tool_routing(spark, d):
    last = convo.last_user_turn(turns(spark, d))
    past = convo.before_last(turns(spark, d), longest=1 << 30).groupBy("conv_id").agg(t.joined(F.collect_list(F.struct("turn", "text")), "text", " ").alias("past"))
    rows = last.join(past, "conv_id", "left")
    found = convo.tools(F.col("last_user"), F.col("past"), ["license"], ["the", "queux"], [("weather", ["und", "tion"]), ("prices", ["los"])])
    return rows.select("conv_id", F.array_join(found, ",").alias("tools"))


@query("pipeline_routing", f"SELECT conv_id, turn, {sql_first('text', ROUTES, chr(39) + 'help' + chr(39))} AS route FROM conversations")
def pipeline_routing(spark, d):
    return turns(spark, d).select("conv_id", "turn", convo.routed(F.col("text"), ROUTES).alias("route"))


@query("token_usage", f"SELECT conv_id, turn, 2 * n AS prompt_tokens, n AS completion_tokens, 3 * n AS total_tokens FROM (SELECT conv_id, turn, len({sql_words('text')})::INT AS n FROM conversations)")
def token_usage(spark, d):
    return turns(spark, d).select("conv_id", "turn", convo.usage(F.col("text"), F.col("text")).alias("u")).select("conv_id", "turn", "u.*")


@query("word_frames", f"""
WITH w AS (SELECT conv_id, turn, {sql_words('text')} AS w FROM conversations), f AS (SELECT conv_id, turn, w, unnest(range(0, len(w), 3)) AS i FROM w WHERE len(w) > 0)
SELECT conv_id, turn, (i // 3)::INT AS frame, array_to_string(w[i + 1 : i + 3], ' ') || CASE WHEN i + 3 < len(w) THEN ' ' ELSE '' END AS text FROM f""")
def word_frames(spark, d):
    return convo.frames(turns(spark, d), ["conv_id", "turn"], "text")


@query("markdown_plain", r"""
SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\|.*\|', '', 'g'), '(?m)^-{3,}$', '', 'g'), '(?m)^#+\s*', '', 'g'), '(?m)^[\s\-*]+', '- ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9) || chr(13))) AS plain_md5
FROM documents""")
def markdown_plain(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(convo.plain_text(F.col("text"))).alias("plain_md5"))


@query("message_segments", r"""
WITH RECURSIVE cuts AS (
  SELECT doc_id, 0 AS k, NULL::VARCHAR AS piece, trim(coalesce(text, ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS rest FROM documents UNION ALL
  SELECT doc_id, k + 1, trim(substr(rest, 1, cut), chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), trim(substr(rest, cut + 1), chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') FROM (
    SELECT doc_id, k, rest, CASE WHEN length(rest) <= 1500 THEN length(rest) WHEN nl >= 900 THEN nl WHEN sp >= 900 THEN sp ELSE 1500 END AS cut FROM (
      SELECT *, 1500 - CASE WHEN strpos(back, chr(10)) = 0 THEN 1500 ELSE strpos(back, chr(10)) END AS nl, 1500 - CASE WHEN strpos(back, ' ') = 0 THEN 1500 ELSE strpos(back, ' ') END AS sp
      FROM (SELECT *, reverse(substr(rest, 1, 1500)) AS back FROM cuts WHERE length(rest) > 0 OR k = 0)))),
found AS (SELECT doc_id, k, piece, max(k) OVER (PARTITION BY doc_id) AS parts FROM cuts WHERE k > 0)
SELECT doc_id, k AS part, parts, CASE WHEN parts > 1 THEN '[' || k || '/' || parts || '] ' ELSE '' END || piece AS text FROM found""")
def message_segments(spark, d):
    return convo.segments(table(spark, d, "documents"), ["doc_id"], "text")


@query("role_normalisation", "SELECT conv_id, turn, CASE WHEN role IN ('system', 'user', 'assistant') THEN role ELSE 'user' END AS role FROM (SELECT conv_id, turn, text, CASE WHEN turn % 5 = 4 THEN 'tool' ELSE role END AS role FROM conversations) WHERE trim(coalesce(text, '')) <> ''")
def role_normalisation(spark, d):
    mixed = turns(spark, d).withColumn("role", F.when(F.col("turn") % 5 == 4, "tool").otherwise(F.col("role")))
    return convo.normalised(mixed).select("conv_id", "turn", "role")


@query("system_first", "SELECT conv_id, CASE WHEN bool_or(role = 'system') THEN count(*) ELSE count(*) + 1 END AS n_messages, CASE WHEN bool_or(role = 'system') THEN arg_min(role, turn) ELSE 'system' END AS first_role FROM conversations GROUP BY conv_id")
def system_first(spark, d):
    messages = turns(spark, d).groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("m"))
    rows = messages.select("conv_id", convo.with_system_first(F.col("m"), "Eres un asesor agrícola.").alias("m"))
    return rows.select("conv_id", F.size("m").cast("long").alias("n_messages"), F.col("m")[0]["role"].alias("first_role"))


@query("prompt_assembly", """
WITH h AS (SELECT conv_id, 1 + count(*) AS n_messages, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS past_md5 FROM conversations GROUP BY conv_id)
SELECT conv_id, n_messages, past_md5, md5('S' || chr(10) || chr(10) || CASE WHEN conv_id % 2 = 0 THEN 'W' || conv_id ELSE 'Sin datos del tiempo.' END || chr(10) || chr(10) || coalesce('D ' || text, 'Sin documentos.')) AS head_md5
FROM h LEFT JOIN (SELECT * FROM documents WHERE doc_id % 3 = 0) ON doc_id = conv_id""")
def prompt_assembly(spark, d):
    requests = turns(spark, d).select("conv_id").distinct()
    block = requests.filter("conv_id % 2 = 0").select("conv_id", F.concat(F.lit("W"), F.col("conv_id").cast("string")).alias("block"))
    context = table(spark, d, "documents").filter("doc_id % 3 = 0").select(F.col("doc_id").alias("conv_id"), F.concat(F.lit("D "), "text").alias("context"))
    rows = convo.prompts(requests, "conv_id", "S", block, context, turns(spark, d))
    past = F.array_join(F.transform(F.expr("slice(messages, 2, size(messages))"), lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")
    return rows.select("conv_id", F.size("messages").cast("long").alias("n_messages"), F.md5(past).alias("past_md5"), F.md5(F.col("messages")[0]["content"]).alias("head_md5"))


@query("accent_fold", "SELECT doc_id, md5(strip_accents(text)) AS folded, length(strip_accents(text)) AS n FROM documents")
def accent_fold(spark, d):
    folded = table(spark, d, "documents").select("doc_id", t.fold_accents(F.col("text")).alias("x"))
    return folded.select("doc_id", F.md5("x").alias("folded"), F.length("x").cast("long").alias("n"))


@query("accent_fold_whole", "SELECT doc_id, md5(strip_accents(text)) AS folded FROM documents")
def accent_fold_whole(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(t.fold_accents(F.col("text"))).alias("folded"))


@query("region_lookup", "SELECT c_custkey, coalesce(r_name, 'no identificada') AS region FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey % 5 <> 4 LEFT JOIN region ON r_regionkey = n_regionkey")
def region_lookup(spark, d):
    places = table(spark, d, "nation").filter("n_nationkey % 5 <> 4").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("place"), F.col("r_name").alias("region"))
    return weather.region_of(table(spark, d, "customer"), "c_nationkey", places).select("c_custkey", "region")


@query("rain_class", "SELECT event_id, CASE WHEN value > 70 THEN 'high' WHEN value > 30 THEN 'medium' ELSE 'low' END AS rain FROM events")
def rain_class(spark, d):
    return table(spark, d, "events").select("event_id", weather.rain_class(F.format_string("%.4f", "value")).alias("rain"))


@query("thermal_band", "SELECT event_id, CASE " + " ".join(f"WHEN v < {b} THEN '{n}'" for b, n in weather.BANDS) + " ELSE 'extreme' END AS band FROM (SELECT event_id, value / 5 - 10 AS v FROM events)")
def thermal_band(spark, d):
    return table(spark, d, "events").select("event_id", weather.thermal_band(F.col("value") / 5 - 10).alias("band"))


@query("precipitation_label", "SELECT event_id, CASE user_id % 6 WHEN 0 THEN 'sin precipitación' WHEN 1 THEN 'lluvia' WHEN 2 THEN 'nieve' WHEN 3 THEN 'lluvia helada' WHEN 4 THEN 'granizo' ELSE 'desconocida' END AS label FROM events")
def precipitation_label(spark, d):
    return table(spark, d, "events").select("event_id", weather.precipitation(F.col("user_id") % 6).alias("label"))


@query("day_labels", """SELECT event_id, CASE WHEN ts::DATE = DATE '2024-01-02' THEN 'HOY' WHEN ts::DATE = DATE '2024-01-03' THEN 'MAÑANA' ELSE ['Dom', 'Lun', 'Mar', 'Mié', 'Jue', 'Vie', 'Sáb'][1 + dayofweek(ts)] END || ' ' || strftime(ts, '%d/%m') AS label FROM events""")
def day_labels(spark, d):
    return table(spark, d, "events").select("event_id", weather.day_label(F.col("ts"), F.lit("2024-01-02").cast("date")).alias("label"))


@query("spray_advisory", """
WITH x AS (SELECT user_id, ts::DATE AS day, CASE WHEN event_type = 'error' THEN 'no' WHEN value / 20 > t.wind_max THEN 'drift' WHEN value / 10 < t.temp_low OR value / 10 > t.temp_high THEN 'wait' ELSE 'go' END AS advice
  FROM events JOIN (VALUES (0, 10.0, 5.0, 30.0), (1, 10.0, 17.0, 35.0), (2, 15.0, 5.0, 25.0)) t(k, wind_max, temp_low, temp_high) ON t.k = user_id % 3)
SELECT user_id, day, arg_min(advice, CASE advice WHEN 'no' THEN 0 WHEN 'drift' THEN 1 WHEN 'wait' THEN 2 ELSE 3 END) AS advice, count(*) AS n FROM x GROUP BY user_id, day""")
def spray_advisory(spark, d):
    limits = spark.createDataFrame([(0, 10.0, 5.0, 30.0), (1, 10.0, 17.0, 35.0), (2, 15.0, 5.0, 25.0)], "k int, wind_max double, temp_low double, temp_high double")
    rows = table(spark, d, "events").join(F.broadcast(limits), F.col("k") == F.col("user_id") % 3)
    advice = weather.spray_advice(F.col("event_type") == "error", F.col("value") / 20, F.col("value") / 10, F.col("value") / 10, {c: F.col(c) for c in ("wind_max", "temp_low", "temp_high")})
    return weather.worst_advice(rows.select("user_id", F.to_date("ts").alias("day"), advice.alias("advice")), ["user_id", "day"], "advice")


STAGES = [("O", "siembra", 0, 30, 250000.0), ("O", "floración", 31, 90, 150000.0), ("F", "siembra", 0, 60, 100000.0)]


@query("stage_risk_range_join", "SELECT o_orderkey, stage, CASE WHEN stage IS NOT NULL THEN CASE WHEN o_totalprice < c THEN 'risk' ELSE 'ok' END END AS risk FROM (SELECT *, date_diff('day', DATE '1998-07-01', o_orderdate::DATE) AS das FROM orders) LEFT JOIN (VALUES " + ", ".join(f"('{c}', '{s}', {a}, {b}, {x})" for c, s, a, b, x in STAGES) + ") v(crop, stage, a, b, c) ON o_orderstatus = crop AND das BETWEEN a AND b")
def stage_risk_range_join(spark, d):
    stages = spark.createDataFrame(STAGES, "crop string, stage string, day_from int, day_to int, temp_critical double")
    orders = table(spark, d, "orders").withColumn("das", F.datediff(F.to_date("o_orderdate"), F.lit("1998-07-01").cast("date")))
    return weather.stage_risk(orders, "o_orderstatus", "das", "o_totalprice", stages).select("o_orderkey", "stage", "risk")


@query("site_from_query", "SELECT n_nationkey, CASE WHEN contains(lower(n_name), '_1') THEN 'ONE' WHEN contains(lower(n_name), '_2') THEN 'TWO' ELSE 'MLC' END AS site FROM nation")
def site_from_query(spark, d):
    return table(spark, d, "nation").select("n_nationkey", market.site_of(F.col("n_name"), [("ONE", ["_1"]), ("TWO", ["_2"])]).alias("site"))


@query("price_text", "SELECT p_partkey, CASE WHEN p IS NULL OR p = 0 THEN 'consultar' ELSE '$' || replace(format('{:,}', round_even(p, 0)::BIGINT), ',', '.') END AS price FROM (SELECT p_partkey, CASE WHEN p_size = 1 THEN 0 WHEN p_size = 2 THEN NULL ELSE p_retailprice * 1000 END AS p FROM part)")
def price_text(spark, d):
    price = F.when(F.col("p_size") == 1, 0.0).when(F.col("p_size") == 2, F.lit(None).cast("double")).otherwise(F.col("p_retailprice") * 1000)
    return table(spark, d, "part").select("p_partkey", market.price_text(price).alias("price"))


@query("condition_class", "SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN 'nuevo' WHEN 'ECONOMY' THEN 'usado' ELSE 'otro' END AS condition FROM part")
def condition_class(spark, d):
    kind = F.when(F.col("p_type") == "PROMO", "New").when(F.col("p_type") == "ECONOMY", "used").otherwise(F.col("p_type"))
    return table(spark, d, "part").select("p_partkey", market.condition_class(kind).alias("condition"))


@query("top_n_listing", "SELECT p_brand, p_partkey, position, total, greatest(total - 10, 0) AS more FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS position, count(*) OVER (PARTITION BY p_brand) AS total FROM part) WHERE position <= 10")
def top_n_listing(spark, d):
    out = market.top_listing(table(spark, d, "part"), ["p_brand"], [F.col("p_retailprice"), F.col("p_partkey")])
    return out.select("p_brand", "p_partkey", F.col("position").cast("long").alias("position"), "total", "more")


@query("query_expansion", "SELECT conv_id, turn, text || ' ' || CASE WHEN contains(lower(text), 'the') THEN 'uno' WHEN contains(lower(text), 'und') THEN 'dos' ELSE 'agrícola' END || ' chile' AS query FROM conversations WHERE role = 'user'")
def query_expansion(spark, d):
    return turns(spark, d).filter("role = 'user'").select("conv_id", "turn", market.expanded(F.col("text"), [("the", "uno"), ("und", "dos")]).alias("query"))


FIRST8 = "(SELECT page_id, url, hit, row_number() OVER (ORDER BY hit DESC, page_id) AS position FROM (SELECT page_id, url, contains(lower(url), 'www') OR contains(lower(url), 'ref=') AS hit FROM pages) QUALIFY position <= 8)"


def ranked_pages(spark, d):
    pages = table(spark, d, "pages").withColumn("hit", market.commercial([F.col("url")], ["www", "ref="]))
    return market.commercial_first(pages, "hit", "page_id")


@query("commercial_first", f"SELECT page_id, position, count(*) FILTER (WHERE hit) OVER () AS n_commercial FROM {FIRST8}")
def commercial_first(spark, d):
    return ranked_pages(spark, d).select("page_id", F.col("position").cast("long").alias("position"), "n_commercial")


@query("two_section_listing", f"SELECT CASE WHEN hit THEN 'Productos y precios' ELSE 'Información' END AS section, string_agg(position || '. ' || page_id || ' - ' || url, chr(10) ORDER BY position) AS listing FROM {FIRST8} GROUP BY 1")
def two_section_listing(spark, d):
    return market.two_sections(ranked_pages(spark, d), "hit", "position", F.col("page_id").cast("string"), F.col("url"))
