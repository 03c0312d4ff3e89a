"""Queries on lexicons, extraction, tables and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftfield.functions import text as t
from siftfield.lexicons import RELEVANT_TERMS
from siftfield.operators import chunk, extract, lexicon, score, tables
from siftfield.plans.registry import dealt_table, query, table

WORDS = ["license", "haben", "queux"]
LANGUAGES = [("spanish", [" los ", " que "]), ("german", [" der ", " und "]), ("french", [" les ", " une "]), ("english", [" the ", " of "])]
TOPICS = [("law", ["license", "rights"]), ("keys", ["token", "password"]), ("article", ["the", "der", "la"]), ("link", ["http"])]


def sql_any(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), '{w}')" for w in words) + ")"


def sql_first(column: str, lex: list, default: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {sql_any(column, vs)} THEN '{k}'" for k, vs in lex) + f" ELSE {default} END"


def sql_words(column: str) -> str:
    return f"list_filter(string_split_regex({column}, '\\s+'), lambda w: w <> '')"


@query("lexicon_any", f"SELECT doc_id, {sql_any('text', WORDS)} AS hit FROM documents")
def lexicon_any(spark, d):
    return table(spark, d, "documents").select("doc_id", t.contains_any(F.col("text"), WORDS).alias("hit"))


@query("lexicon_first_match", f"SELECT doc_id, {sql_first('text', LANGUAGES, chr(39) + 'none' + chr(39))} AS key FROM documents")
def lexicon_first_match(spark, d):
    return table(spark, d, "documents").select("doc_id", t.first_match(F.col("text"), LANGUAGES, "none").alias("key"))


@query("lexicon_table_match", f"SELECT doc_id, {sql_first('text', TOPICS, chr(39) + 'other' + chr(39))} AS match FROM documents")
def lexicon_table_match(spark, d):
    terms = spark.createDataFrame([(i, k, v) for i, (k, vs) in enumerate(TOPICS) for v in vs], "ord int, key string, variant string")
    return lexicon.first_match_table(table(spark, d, "documents").select("doc_id", "text"), "text", terms, ["doc_id"], "other").select("doc_id", "match")


@query("lexicon_all_matches", "SELECT doc_id, array_to_string(list_sort(list_filter([" + ", ".join(f"CASE WHEN {sql_any('text', vs)} THEN '{k}' END" for k, vs in TOPICS) + "], lambda x: x IS NOT NULL)), ',') AS keys FROM documents")
def lexicon_all_matches(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(t.all_matches(F.col("text"), TOPICS), ",").alias("keys"))


@query("lexicon_list", "SELECT doc_id, concat_ws(', ', " + ", ".join(f"CASE WHEN contains(lower(text), '{w}') THEN '{w.title()}' END" for w in ("license", "rights", "token")) + ") AS found FROM documents")
def lexicon_list(spark, d):
    return table(spark, d, "documents").select("doc_id", t.list_matches(F.col("text"), ["license", "rights", "token"]).alias("found"))


NAMES = [("first", ["than", "ver"]), ("second", ["and", "une", "los"]), ("third", ["tion"])]
_whole = lambda w: f"regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_]){w}($|[^\\p{{L}}\\p{{M}}\\p{{N}}_])')"


@query("lexicon_two_pass", "SELECT doc_id, CASE " + " ".join(f"WHEN {' OR '.join(_whole(v) for v in vs)} THEN '{k}'" for k, vs in NAMES) + " " + " ".join(f"WHEN {sql_any('text', vs)} THEN '{k}'" for k, vs in NAMES) + " END AS key FROM documents")
def lexicon_two_pass(spark, d):
    return table(spark, d, "documents").select("doc_id", t.two_pass_match(F.col("text"), NAMES).alias("key"))


@query("lexicon_gated", f"SELECT doc_id, CASE WHEN {sql_any('text', ['license'])} THEN {sql_first('text', LANGUAGES)} END AS key FROM documents")
def lexicon_gated(spark, d):
    return table(spark, d, "documents").select("doc_id", t.gated_match(F.col("text"), ["license"], LANGUAGES).alias("key"))


@query("capture_after_word", "SELECT doc_id, nullif(upper(regexp_extract(text, 'under the ([A-Z]+)', 1)), '') AS what FROM documents")
def capture_after_word(spark, d):
    return table(spark, d, "documents").select("doc_id", F.upper(t.captured(F.col("text"), [r"under the ([A-Z]+)"])).alias("what"))


@query("source_filter", "SELECT doc_id, source FROM documents WHERE contains(lower(source), 'src1')")
def source_filter(spark, d):
    return lexicon.from_sources(table(spark, d, "documents"), "source", ["src1"]).select("doc_id", "source")


STOPS = ["red", "small", "large"]


@query("name_validity", f"""
SELECT p_partkey, length(n) >= 3 AND len(list_filter(w, lambda x: x NOT IN ('red', 'small', 'large'))) > 0 AND NOT regexp_matches(n, '^[0-9]')
  AND NOT regexp_matches(n, '^(kg|ml|lt|gr|cc)\\b') AND (length(n) >= 5 OR {' OR '.join(f"contains(n, '{x}')" for x in ('wp', 'ec', 'sc', 'sl', 'wg', 'se', 'ew'))})
  AND len(regexp_extract_all(n, '[0-9]+')) <= 2 AND len(w) <= 4 AND NOT contains(n, 'gear') AS valid
FROM (SELECT p_partkey, lower(trim(p_name)) AS n, {sql_words('lower(trim(p_name))')} AS w FROM part)""")
def name_validity(spark, d):
    return table(spark, d, "part").select("p_partkey", lexicon.valid_name(F.col("p_name"), STOPS, phrases=["gear"]).alias("valid"))


@query("processed_anti", "SELECT p_partkey, p_name FROM part WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT lower(split_part(p_name, ' ', 1)) AS w FROM part WHERE p_size = 11 AND p_type = 'PROMO') x WHERE contains(lower(part.p_name), x.w))")
def processed_anti(spark, d):
    part = table(spark, d, "part")
    done = part.filter("p_size = 11 and p_type = 'PROMO'").select(F.split("p_name", " ")[0].alias("product"))
    return lexicon.unprocessed(part, "p_name", done, "product").select("p_partkey", "p_name")


@query("allow_list_semi", "SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 250)")
def allow_list_semi(spark, d):
    events = table(spark, d, "events")
    return lexicon.allowed(events, "user_id", events.filter("event_type = 'purchase' and value > 250")).select("event_id", "user_id")


@query("minimum_content", "SELECT doc_id FROM documents WHERE length(trim(text)) > 50")
def minimum_content(spark, d):
    return lexicon.long_enough(table(spark, d, "documents"), "text").select("doc_id")


@query("loop_filter", "SELECT conv_id, turn FROM conversations WHERE NOT contains(lower(text), 'the thin') AND NOT contains(lower(text), 'license')")
def loop_filter(spark, d):
    return lexicon.without_own_replies(table(spark, d, "conversations"), "text", ["the thin", "license"]).select("conv_id", "turn")


@query("filename_product", """
SELECT page_id, upper(trim(regexp_replace(translate(regexp_replace(base, '[_\\-0-9]{4,}.*$', ''), '_-', '  '), '\\s+', ' ', 'g'))) AS name
FROM (SELECT page_id, regexp_replace(regexp_replace(url, '^.*[/\\\\]', ''), '(?i)\\.(pdf|txt|docx?|md|html?)$', '') AS base FROM pages)""")
def filename_product(spark, d):
    return table(spark, d, "pages").select("page_id", extract.name_from_filename(F.col("url")).alias("name"))


@query("short_name", "SELECT c_custkey, upper(split_part(translate(c_name, '_-#', '   '), ' ', 1)) AS name FROM customer")
def short_name(spark, d):
    return table(spark, d, "customer").select("c_custkey", extract.short_name(F.col("c_name")).alias("name"))


@query("display_name", "SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS name FROM part")
def display_name(spark, d):
    return table(spark, d, "part").select("p_partkey", extract.display_name(F.col("p_name")).alias("name"))


@query("distinct_targets", r"""
SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS found
FROM (SELECT doc_id, list_concat(regexp_extract_all(lower(text), '[a-z]+tion'), regexp_extract_all(lower(text), 'licen[a-z]+')) AS l FROM documents)""")
def distinct_targets(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(extract.targets(F.col("text"), ["[a-z]+tion", "licen[a-z]+"]), ",").alias("found"))


@query("relevant_terms", "SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '(?i)license|rights|version'), lambda w: upper(w[1]) || lower(w[2:])))), ', ') AS terms FROM documents")
def relevant_terms(spark, d):
    return table(spark, d, "documents").select("doc_id", extract.relevant_crops(F.col("text"), "(?i)license|rights|version").alias("terms"))


@query("table_row_explode", "SELECT n_regionkey AS table_id, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS row_no, 'key: ' || n_nationkey || ' | name: ' || n_name AS text FROM nation")
def table_row_explode(spark, d):
    row = F.struct("n_nationkey", F.array(F.col("n_nationkey").cast("string"), "n_name").alias("cells"))
    cells = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("table_id")).agg(F.transform(F.sort_array(F.collect_list(row)), lambda r: r["cells"]).alias("rows"))
    cells = cells.select("table_id", F.concat(F.array(F.array(F.lit("key"), F.lit("name"))), F.col("rows")).alias("cells"))
    rows = tables.table_rows(cells, ["table_id"], "cells")
    return rows.select("table_id", F.col("row_no").cast("long").alias("row_no"), F.array_join(tables.labelled_cells(F.col("headers"), F.col("row")), " | ").alias("text"))


@query("table_signature_dedupe", """
SELECT o_orderkey, signature FROM (
  SELECT o_orderkey, signature, row_number() OVER (PARTITION BY signature ORDER BY o_orderkey) AS r
  FROM (SELECT o_orderkey, '1_2_' || substr(o_orderpriority, 1, 10) || '_' || o_orderstatus AS signature FROM orders)) WHERE r = 1""")
def table_signature_dedupe(spark, d):
    cells = table(spark, d, "orders").select("o_orderkey", F.array(F.array("o_orderpriority", "o_orderstatus")).alias("cells"))
    return tables.without_repeats(cells, "cells", [], ["o_orderkey"]).select("o_orderkey", "signature")


@query("table_unit", "SELECT p_partkey, CASE WHEN contains(h, 'g/100') THEN 'g/100 L' WHEN contains(h, 'kg/ha') THEN 'kg/ha' WHEN contains(h, 'l/ha') THEN 'L/ha' WHEN contains(h, 'g/ha') THEN 'g/ha' END AS unit FROM (SELECT p_partkey, lower(CASE WHEN p_size < 10 THEN 'Dosis (kg/ha)' WHEN p_size < 20 THEN 'Dosis L/ha' WHEN p_size < 30 THEN 'g/ha' WHEN p_size < 40 THEN 'kg/ha o g/100' ELSE p_name END) AS h FROM part)")
def table_unit(spark, d):
    size = F.col("p_size")
    header = F.when(size < 10, "Dosis (kg/ha)").when(size < 20, "Dosis L/ha").when(size < 30, "g/ha").when(size < 40, "kg/ha o g/100").otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", tables.unit_of_header(header).alias("unit"))


@query("dose_table_test", "SELECT doc_id, " + " + ".join(f"contains(lower(text), '{w}')::INT" for w in ("license", "rights", "token", "version", "http")) + " >= 2 AS is_table FROM documents")
def dose_table_test(spark, d):
    return table(spark, d, "documents").select("doc_id", tables.is_dose_table(F.col("text"), ["license", "rights", "token", "version", "http"]).alias("is_table"))


@query("chunk_ids_md5", "SELECT doc_id, 'chunk_' || substr(md5(source || '_' || doc_id || '_' || substr(text, 1, 100)), 1, 12) AS chunk_id FROM documents")
def chunk_ids_md5(spark, d):
    return table(spark, d, "documents").select("doc_id", chunk.chunk_id(F.col("source"), F.col("doc_id"), F.col("text")).alias("chunk_id"))


TERMS = ["tion", "the", "une"]


@query("relevance_score", f"SELECT doc_id, round(CASE WHEN n > 0 THEN least(2.0::DOUBLE * k / n, 1.0) ELSE 0.0 END, 9) AS relevance FROM (SELECT doc_id, len({sql_words('text')}) AS n, " + " + ".join(f"(length(lower(text)) - length(replace(lower(text), '{w}', ''))) // {len(w)}" for w in TERMS) + " AS k FROM documents)")
def relevance_score(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(chunk.relevance(F.col("text"), TERMS), 9).alias("relevance"))


QUALITY_SQL = f"""
SELECT doc_id, round(CASE WHEN n = 0 OR length(text) = 0 THEN 0.0 ELSE least(0.3::DOUBLE * length(regexp_replace(text, '[\\x00-\\x08\\x0E-\\x1B\\x7F]', '', 'g')) / length(text)
  + 0.4::DOUBLE * len(list_filter(w, lambda x: length(x) > 1 AND regexp_matches(x, '[A-Za-z]'))) / n
  + least(0.03::DOUBLE * (regexp_matches(lower(text), 'licen[sc]e')::INT + regexp_matches(lower(text), 'tion')::INT), 0.4), 1.0) END, 9) AS quality
FROM (SELECT doc_id, text, {sql_words('text')} AS w, len({sql_words('text')}) AS n FROM documents)"""


@query("content_quality", QUALITY_SQL)
def content_quality(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(chunk.content_quality(F.col("text"), ["licen[sc]e", "tion"]), 9).alias("quality"))


@query("best_candidate", f"""
WITH q AS ({QUALITY_SQL}), c AS (SELECT source, lang, doc_id, quality, lang = 'fr' AS ocr FROM q JOIN documents USING (doc_id)),
g AS (SELECT *, max(CASE WHEN NOT ocr THEN quality END) OVER (PARTITION BY source, lang) AS best FROM c)
SELECT source, lang, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY quality DESC, doc_id) AS r FROM g WHERE NOT ocr OR best IS NULL OR best < 0.6) WHERE r = 1""")
def best_candidate(spark, d):
    docs = table(spark, d, "documents").withColumn("quality", F.round(chunk.content_quality(F.col("text"), ["licen[sc]e", "tion"]), 9))
    return chunk.best_candidate(docs, ["source", "lang"], "doc_id", "quality", F.col("lang") == "fr").select("source", "lang", "doc_id")


def windows_sql(source, size=500):
    """Tables after ``source`` (id, text, share, tail): cut_ (id, pos, text), by following the runs' ends."""
    return f"""
lists_ AS MATERIALIZED (SELECT id, share, tail, {sql_words('text')} AS ws FROM ({source})),
words_ AS (SELECT id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM lists_),
sums_ AS MATERIALIZED (SELECT id, i, length(w) + 1 AS n, sum(length(w) + 1) OVER (PARTITION BY id ORDER BY i)::BIGINT AS p FROM words_),
ends_ AS MATERIALIZED (SELECT a.id, a.i AS s, b.i AS e FROM (SELECT id, i, p - n + {size} AS target FROM sums_) a ASOF JOIN sums_ b ON a.id = b.id AND a.target <= b.p),
runs_ AS (
  SELECT id, s, e FROM ends_ WHERE s = 1 UNION ALL
  SELECT n.id, n.s, greatest(n.e, r.e + 1) FROM runs_ r JOIN lists_ l ON l.id = r.id JOIN ends_ n ON n.id = r.id AND n.s = r.e + 1 - floor((r.e + 1 - r.s) * l.share)::BIGINT WHERE r.e + 1 <= len(l.ws)),
last_ AS (SELECT l.id, coalesce(r.e + 1 - floor((r.e + 1 - r.s) * l.share)::BIGINT, 1) AS s FROM lists_ l LEFT JOIN (SELECT id, max(e) AS e, max(s) AS s FROM runs_ GROUP BY id) r ON r.id = l.id),
all_ AS (
  SELECT r.id, r.s, array_to_string(list_slice(l.ws, r.s::BIGINT, r.e::BIGINT), ' ') AS text FROM runs_ r JOIN lists_ l ON l.id = r.id UNION ALL
  SELECT id, s + 1e9::BIGINT, text FROM (SELECT l.id, t.s, l.tail, array_to_string(list_slice(l.ws, t.s::BIGINT, len(l.ws)), ' ') AS text FROM last_ t JOIN lists_ l ON l.id = t.id WHERE t.s <= len(l.ws)) WHERE length(text) > tail),
cut_ AS (SELECT id, (row_number() OVER (PARTITION BY id ORDER BY s) - 1)::INT AS pos, text FROM all_)"""


@query("word_chunks", f"WITH RECURSIVE {windows_sql('SELECT doc_id AS id, text, 0.2::DOUBLE AS share, 50 AS tail FROM documents')} SELECT id AS doc_id, pos AS chunk_index, text FROM cut_")
def word_chunks(spark, d):
    return chunk.word_chunks(table(spark, d, "documents"), ["doc_id"], "text")


SEMANTIC_SQL = f"""
WITH RECURSIVE pieces AS (SELECT doc_id, text, string_split(regexp_replace(text, '\\n\\s*(the|le|der|la)', chr(1) || '\\1', 'gi'), chr(1)) AS ps FROM documents),
parts AS MATERIALIZED (
  SELECT doc_id, 0 AS k, text AS piece, true AS whole FROM pieces WHERE len(ps) <= 2 UNION ALL
  SELECT doc_id, k, piece, false FROM (SELECT doc_id, generate_subscripts(ps, 1) - 1 AS k, trim(unnest(ps), ' ' || chr(10) || chr(9) || chr(13)) AS piece FROM pieces WHERE len(ps) > 2) WHERE length(piece) >= 50),
{windows_sql("SELECT {'d': doc_id, 'k': k} AS id, piece AS text, 0.2::DOUBLE AS share, CASE WHEN whole THEN 50 ELSE 0 END AS tail FROM parts WHERE whole OR length(piece) > 750")},
chunks AS (
  SELECT p.doc_id, CASE WHEN whole THEN c.pos ELSE p.k END AS chunk_index, CASE WHEN NOT whole THEN c.pos END AS sub_index, piece, whole, c.text FROM parts p JOIN cut_ c ON c.id = {{'d': p.doc_id, 'k': p.k}} UNION ALL
  SELECT doc_id, k, NULL, piece, whole, piece FROM parts WHERE NOT whole AND length(piece) <= 750)
SELECT doc_id, chunk_index::INT AS chunk_index, sub_index::INT AS sub_index, text,
  CASE WHEN whole THEN 'character_split' {" ".join(f"WHEN regexp_matches(lower(piece), '{p}') THEN '{name}'" for name, p in chunk.SECTION_TYPES)} ELSE 'general' END AS section_type,
  CASE WHEN sub_index IS NULL THEN 'chunk_' || substr(md5(doc_id || '_' || chunk_index || '_' || substr(text, 1, 100)), 1, 12) ELSE 'chunk_' || chunk_index || '_' || sub_index || '_' || substr(md5(substr(text, 1, 100)), 1, 8) END AS chunk_id,
  round(CASE WHEN len({sql_words('text')}) > 0 THEN least(2.0::DOUBLE * ({" + ".join(f"(length(lower(text)) - length(replace(lower(text), '{w}', ''))) // {len(w)}" for w in RELEVANT_TERMS)}) / len({sql_words('text')}), 1.0) ELSE 0.0 END, 9) AS relevance
FROM chunks"""


@query("semantic_chunks", SEMANTIC_SQL)
def semantic_chunks(spark, d):
    return chunk.semantic_chunks(dealt_table(spark, d, "documents"), "doc_id", "text", ["the", "le", "der", "la"]).withColumn("relevance", F.round("relevance", 9))


@query("section_type", "SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'license|rights') THEN 'law' WHEN regexp_matches(lower(text), 'token|password') THEN 'keys' ELSE 'general' END AS kind FROM documents")
def section_type(spark, d):
    return table(spark, d, "documents").select("doc_id", chunk.section_type(F.col("text"), [("law", "license|rights"), ("keys", "token|password")]).alias("kind"))


@query("page_chunk_products", "SELECT source, lang, array_to_string(list_sort(list(DISTINCT lang || length(text) % 7)), ',') AS products, bool_or(contains(text, 'License')) AS has_license, 2.0::DOUBLE * count(DISTINCT lang || length(text) % 7) AS content_score FROM documents GROUP BY source, lang")
def page_chunk_products(spark, d):
    docs = table(spark, d, "documents").withColumn("product", F.concat("lang", (F.length("text") % 7).cast("string")))
    out = chunk.page_chunks(docs, ["source", "lang"], "product", {"has_license": F.col("text").contains("License")})
    return out.withColumn("products", F.array_join("products", ","))


@query("priority_ladder", f"""
WITH f AS (SELECT doc_id, contains(lower(text), 'license') AS named, contains(lower(text), 'token') AS processed, len(string_split(text, chr(10))) - 1 AS rows_,
  (length(text) - length(replace(text, ' the ', ''))) // 5 AS direct, (length(text) - length(replace(text, ' of ', ''))) // 4 AS context,
  {sql_first('text', [('in', [' in ']), ('la', [' la '])])} AS ingredient,
  list_filter([CASE WHEN contains(lower(text), 'http') THEN 'http' END, CASE WHEN contains(lower(text), 'rights') THEN 'rights' END], lambda x: x IS NOT NULL) AS related,
  CASE WHEN lang = 'en' THEN 'Herbicida' ELSE 'Otro' END AS type_, n_chars // 500 AS chunks FROM documents)
SELECT doc_id, CASE WHEN processed THEN 'SKIP' WHEN named AND rows_ > 0 AND direct > 0 THEN 'HIGH' WHEN named AND rows_ > 0 THEN 'MEDIUM' WHEN named AND direct > 0 THEN 'MEDIUM'
  WHEN named THEN 'LOW' WHEN len(related) > 0 AND ingredient IS NOT NULL AND type_ = 'Herbicida' THEN 'MEDIUM' WHEN len(related) > 0 THEN 'LOW' WHEN chunks < 5 THEN 'SKIP' ELSE 'LOW' END AS priority
FROM f""")
def priority_ladder(spark, d):
    return rated(spark, d).select("doc_id", "priority")


def rated(spark, d):
    text = F.col("text")
    docs = table(spark, d, "documents")
    related = F.array_compact(F.array(*(F.when(t.contains_any(text, [w]), w) for w in ("http", "rights"))))
    level, advice, reasons = score.priority(
        t.contains_any(text, ["token"]), t.contains_any(text, ["license"]), F.size(F.split(text, "\n", -1)) - 1, t.count_of(text, " the "), t.count_of(text, " of "),
        t.first_match(text, [("in", [" in "]), ("la", [" la "])]), related, F.when(F.col("lang") == "en", "Herbicida").otherwise("Otro"), F.floor(F.col("n_chars") / 500),
    )
    return docs.select("doc_id", "source", level.alias("priority"), advice.alias("recommendation"), reasons.alias("reasons"))


@query("priority_counts", """
WITH p AS (""" + """SELECT doc_id, CASE WHEN contains(lower(text), 'token') THEN 'SKIP'
  WHEN contains(lower(text), 'license') AND contains(text, chr(10)) AND contains(text, ' the ') THEN 'HIGH'
  WHEN contains(lower(text), 'license') AND (contains(text, chr(10)) OR contains(text, ' the ')) THEN 'MEDIUM' WHEN contains(lower(text), 'license') THEN 'LOW'
  WHEN (contains(lower(text), 'http') OR contains(lower(text), 'rights')) AND (contains(lower(text), ' in ') OR contains(lower(text), ' la ')) AND lang = 'en' THEN 'MEDIUM'
  WHEN contains(lower(text), 'http') OR contains(lower(text), 'rights') THEN 'LOW' WHEN n_chars // 500 < 5 THEN 'SKIP' ELSE 'LOW' END AS priority FROM documents)
SELECT x.position, x.priority, count(p.doc_id) AS n FROM (VALUES (0, 'HIGH'), (1, 'MEDIUM'), (2, 'LOW'), (3, 'SKIP')) x(position, priority) LEFT JOIN p USING (priority) GROUP BY 1, 2""")
def priority_counts(spark, d):
    return score.priority_counts(rated(spark, d))


@query("chunk_stats", "SELECT lang, count(*) AS n, round(avg(n_chars), 6) AS avg_score, max(n_chars) AS max_score, min(n_chars) AS min_score, count(*) FILTER (WHERE contains(text, 'License')) AS with_license FROM documents GROUP BY lang")
def chunk_stats(spark, d):
    out = score.chunk_stats(table(spark, d, "documents"), "lang", "n_chars", {"with_license": F.col("text").contains("License")})
    return out.withColumn("avg_score", F.round("avg_score", 6))


@query("extraction_detail", """
SELECT source, array_to_string(list_sort(list(DISTINCT lang)), ',') AS names, count(*) FILTER (WHERE contains(text, 'License')) AS dose_chunks,
  array_to_string(list(doc_id ORDER BY n_chars DESC, doc_id)[1:3], ',') AS top FROM documents GROUP BY source""")
def extraction_detail(spark, d):
    docs = table(spark, d, "documents").withColumns({"names_": F.array("lang"), "weeds_": F.array(F.lit("x"))})
    out = score.extraction_detail(docs, "source", "names_", "weeds_", F.col("text").contains("License"), "n_chars", "doc_id")
    return out.select("source", F.array_join("names", ",").alias("names"), "dose_chunks", F.array_join("top", ",").alias("top"))


@query("approval_stats", "SELECT toxic, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS approved, count(*) - count(*) FILTER (WHERE quality = 1) AS rejected, count(*) FILTER (WHERE doc_id < 500) AS tables, count(*) FILTER (WHERE doc_id < 500 AND quality = 1) AS tables_approved, round(100.0::DOUBLE * count(*) FILTER (WHERE quality = 1) / count(*), 1) AS approval_pct FROM labels GROUP BY toxic")
def approval_stats(spark, d):
    return score.approval_stats(table(spark, d, "labels"), ["toxic"], F.col("quality") == 1, F.col("doc_id") < 500)


@query("review_decisions", "SELECT doc_id, coalesce(CASE WHEN l.quality = 1 THEN 'approved' WHEN l.quality = 0 THEN 'rejected' END, CASE WHEN contains(text, '|') THEN 'pending' ELSE 'approved' END) AS decision FROM documents LEFT JOIN labels l USING (doc_id)")
def review_decisions(spark, d):
    decisions = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "approved").otherwise("rejected").alias("decision"))
    return score.reviewed(table(spark, d, "documents"), decisions, "doc_id", "tables_only", F.col("text").contains("|")).select("doc_id", "decision")
