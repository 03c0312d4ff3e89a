"""Queries on the lines of texts and on pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftfield.operators import lines, score
from siftfield.plans.registry import query, table

LINES = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)"
CROP, DOSES = "(?i)license", ["[0-9]+", "(?i)version"]


def exploded(spark, d):
    return lines.explode_lines(table(spark, d, "documents"), "doc_id", "text")


@query("line_explode", f"WITH {LINES} SELECT doc_id, line_no, md5(line) AS line_md5 FROM lines")
def line_explode(spark, d):
    return exploded(spark, d).select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.md5("line").alias("line_md5"))


@query("mention_lines", f"WITH {LINES} SELECT doc_id, line_no, 'Línea ' || line_no || ': ' || trim(line) AS mention FROM lines WHERE regexp_matches(line, '(?i)license') OR regexp_matches(line, 'token')")
def mention_lines(spark, d):
    return lines.mention_lines(exploded(spark, d), ["(?i)license", "token"]).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "mention")


@query("direct_evidence_lines", f"WITH {LINES} SELECT doc_id, line_no FROM lines WHERE regexp_matches(line, '(?i)license') AND (regexp_matches(line, '[0-9]+') OR regexp_matches(line, '(?i)version'))")
def direct_evidence_lines(spark, d):
    return lines.direct_evidence(exploded(spark, d), CROP, DOSES).select("doc_id", F.col("line_no").cast("long").alias("line_no"))


@query("direct_evidence_per_pattern", f"WITH {LINES} SELECT doc_id, line_no, 0 AS pattern FROM lines WHERE regexp_matches(line, '(?i)license') AND regexp_matches(line, '[0-9]+') UNION ALL SELECT doc_id, line_no, 1 FROM lines WHERE regexp_matches(line, '(?i)license') AND regexp_matches(line, '(?i)version')")
def direct_evidence_per_pattern(spark, d):
    return lines.direct_evidence(exploded(spark, d), CROP, DOSES, once_per_line=False).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "pattern")


CONTEXT = f"WITH {LINES}, near AS (SELECT *, max(regexp_matches(line, '(?i)license')::INT) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS n FROM lines)"


@query("context_evidence_lines", CONTEXT + " SELECT doc_id, line_no FROM near WHERE n = 1 AND NOT regexp_matches(line, '(?i)license') AND (regexp_matches(line, '[0-9]+') OR regexp_matches(line, '(?i)version'))")
def context_evidence_lines(spark, d):
    return lines.context_evidence(table(spark, d, "documents"), "doc_id", "text", CROP, DOSES).select("doc_id", F.col("line_no").cast("long").alias("line_no"))


@query("evidence_counts", CONTEXT + """, e AS (SELECT doc_id, line_no, CASE WHEN regexp_matches(line, '(?i)license') THEN 'direct' ELSE 'context' END AS tag, line
  FROM near WHERE n = 1 AND (regexp_matches(line, '[0-9]+') OR regexp_matches(line, '(?i)version')))
SELECT doc_id, tag, count(*) AS n, array_to_string(list(md5(line) ORDER BY line_no)[1:3], ',') AS samples FROM e GROUP BY doc_id, tag""")
def evidence_counts(spark, d):
    rows = exploded(spark, d)
    direct = lines.direct_evidence(rows, CROP, DOSES).select("doc_id", "line_no", F.md5("line").alias("line"), F.lit("LICENSE - line").alias("tag"))
    context = lines.context_evidence(table(spark, d, "documents"), "doc_id", "text", CROP, DOSES).select("doc_id", "line_no", F.md5("line").alias("line"), F.lit("CONTEXTO LICENSE - line").alias("tag"))
    tagged = direct.unionByName(context).withColumn("tag", score.evidence_kind(F.col("tag"), "LICENSE"))
    return score.evidence_counts(tagged, "doc_id", "tag", "line_no", "line").withColumn("samples", F.array_join("samples", ","))


TABLE = "contains(l, '|')"
SECTION = f"""WITH {LINES}, t AS (SELECT doc_id, line_no, trim(line) AS l FROM lines), m AS (SELECT *, contains(lower(l), 'the') AS begins FROM t),
a AS (SELECT *, min(CASE WHEN begins THEN line_no END) OVER (PARTITION BY doc_id) AS from_, NOT begins AND l <> '' AND ({TABLE} OR contains(lower(l), 'license') OR contains(lower(l), 'token')) AS ends FROM m),
b AS (SELECT *, min(CASE WHEN ends AND line_no > from_ THEN line_no END) OVER (PARTITION BY doc_id) AS to_ FROM a)
SELECT doc_id, line_no FROM b WHERE line_no >= from_ AND (to_ IS NULL OR line_no < to_) AND l <> ''"""


@query("section_capture", SECTION + " AND NOT begins")
def section_capture(spark, d):
    return lines.capture_section(table(spark, d, "documents"), "doc_id", "text", ["the"], ["license", "token"], ["|"]).select("doc_id", F.col("line_no").cast("long").alias("line_no"))


@query("section_capture_with_heading", SECTION)
def section_capture_with_heading(spark, d):
    return lines.capture_section(table(spark, d, "documents"), "doc_id", "text", ["the"], ["license", "token"], ["|"], keep_heading=True).select("doc_id", F.col("line_no").cast("long").alias("line_no"))


@query("descriptive_lines", f"""WITH {LINES}, t AS (SELECT doc_id, line_no, trim(line) AS l FROM lines WHERE trim(line) <> ''), m AS (SELECT *, contains(lower(l), 'license') AS heading FROM t),
e AS (SELECT *, CASE WHEN heading THEN 1 WHEN contains(l, '|') THEN 0 END AS event FROM m),
r AS (SELECT *, last_value(event IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS on_ FROM e)
SELECT doc_id, line_no, md5(CASE WHEN heading THEN '=== ' || upper(l) || ' ===' ELSE l END) AS line FROM r WHERE heading OR (event IS NULL AND on_ = 1 AND length(l) > 10)""")
def descriptive_lines(spark, d):
    out = lines.descriptive_lines(table(spark, d, "documents"), "doc_id", "text", ["license"], ["|"])
    return out.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.md5("line").alias("line"))


@query("keyword_lines", f"WITH {LINES} SELECT doc_id, string_agg(trim(line), chr(10) ORDER BY line_no) AS text FROM lines WHERE contains(lower(line), 'license') OR contains(lower(line), 'rights') GROUP BY doc_id")
def keyword_lines(spark, d):
    return lines.keyword_lines(table(spark, d, "documents"), "doc_id", "text", ["license", "rights"])


@query("general_info_lines", f"""WITH {LINES}, t AS (SELECT doc_id, line_no, trim(line) AS l FROM lines),
f AS (SELECT *, min(CASE WHEN contains(lower(l), 'the') AND contains(lower(l), 'and') THEN line_no END) OVER (PARTITION BY doc_id) AS from_ FROM t),
g AS (SELECT *, line_no > from_ AND line_no <= from_ + 9 AND length(l) > 20 AND NOT {TABLE} AS later FROM f),
h AS (SELECT *, min(CASE WHEN later AND contains(lower(l), 'license') THEN line_no END) OVER (PARTITION BY doc_id) AS to_ FROM g)
SELECT doc_id, line_no FROM h WHERE line_no = from_ OR (later AND (to_ IS NULL OR line_no < to_))""")
def general_info_lines(spark, d):
    return lines.general_info(table(spark, d, "documents"), "doc_id", "text", ["the", "and"], ["license"], ["|"]).select("doc_id", F.col("line_no").cast("long").alias("line_no"))


@query("table_like_lines", f"WITH {LINES} SELECT doc_id, count(*) AS n FROM lines WHERE contains(line, '|') OR contains(line, 'DOSIS') OR contains(line, 'CULTIVO') GROUP BY doc_id")
def table_like_lines(spark, d):
    return exploded(spark, d).filter(lines.table_like(F.col("line"), ["|", "DOSIS", "CULTIVO"])).groupBy("doc_id").agg(F.count("*").alias("n"))


ASSEMBLED = "SELECT conv_id, string_agg(chr(10) || '=== PÁGINA ' || turn || ' ===' || chr(10) || coalesce(text, ''), '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id"


@query("page_assemble", f"SELECT conv_id, md5(text) AS text_md5, length(text) AS n FROM ({ASSEMBLED})")
def page_assemble(spark, d):
    out = lines.assemble_pages(table(spark, d, "conversations"), "conv_id", "turn", "text")
    return out.select("conv_id", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("n"))


@query("page_split", "SELECT conv_id, turn::INT AS page_number, md5(trim(text, ' ' || chr(10) || chr(9) || chr(13))) AS text_md5 FROM conversations WHERE trim(text, ' ' || chr(10) || chr(9) || chr(13)) <> ''")
def page_split(spark, d):
    whole = lines.assemble_pages(table(spark, d, "conversations"), "conv_id", "turn", "text")
    return lines.split_pages(whole, "conv_id", "text").select("conv_id", "page_number", F.md5("text").alias("text_md5"))
