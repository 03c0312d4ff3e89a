"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftfield.llm import bpe, gru_lm, jaccard_join, langid, lexical_search, license_scan, minhash, mixing, quality, suffix_dedup, url_filter, vector_codes, warc
from siftfield.llm.common import modest_batches, read_table, shared_dir, text_rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    modest_batches(spark)
    return read_table(spark, sf_dir, name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_rows(table(spark, sf_dir, "documents"))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "warc")
    warc.write_archives(warc.as_records(table(spark, sf_dir, "pages")), path)
    # of responses the payloads are decoded and compared with their digests; of revisits headers tell all, and what is
    # not a revisit is stepped over
    whole = warc.read_archives(spark, path, payload=False, verify=True).filter(F.col("record_type") == "response")
    again = warc.read_archives(spark, path, payload=False).filter(F.col("record_type") == "revisit")
    number = lambda c: F.expr(f"try_cast(substring({c}, 10) AS BIGINT)").alias({"record_id": "page_id"}.get(c, c))  # noqa: E731  after urn:page:
    return whole.unionByName(again).select(number("record_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.report(license_scan.scan_licenses(documents(spark, sf_dir)))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_groups(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality.verdicts(quality.judge(docs, [public_tokenizers.path(x) for x in quality.VOCABULARIES]))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.summary(suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")))


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", mixing.n_words(F.col("text")).alias("size"))
    return mixing.mix(sized).select("doc_id", "size", "source_size", "target", "taken")


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False)).alias("held_out")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", held_out)
    model = langid.train(docs.filter("not held_out"), F.col("doc_id"))
    return langid.identify(docs.select("doc_id", "held_out", "text"), model).drop("text")


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = minhash.fingerprint_with_edits(documents(spark, sf_dir))
    return made.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op9_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False)).alias("held_out")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), held_out)
    return gru_lm.score_texts(docs, docs.filter("not held_out"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(bpe.encode_texts(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")))


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical_search.search(table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), k=10)
    return found.select("item_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("doc_id"), "score")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vector_codes.compress(table(spark, sf_dir, "embeddings"), label_col="label")
    found = vector_codes.with_label_errors(codes)
    return found.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


#: Rules of the registered query: host, path, verdict.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read_table(spark, sf_dir, "pages"), URL_RULES, keep=("page_id",)).drop("score")


def near_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other half of the fingerprints' operator: documents that share a band, with their sets verified."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def _codes_sql() -> str:
    """Brute force over all entries; a round is three tables."""
    floor = "((s - ((s % n) + n) % n) // n)"
    sql = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v, row_number() OVER (ORDER BY vec_id, embedding) AS r FROM embeddings
  WHERE embedding IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false))), true)),
parts AS MATERIALIZED (
  SELECT r, p, list_slice(v, (p * len(v) // 4 + 1)::BIGINT, ((p + 1) * len(v) // 4)::BIGINT) AS x FROM kept, range(4) t(p)),
book0 AS MATERIALIZED (SELECT p, r - 1 AS e, x AS c FROM parts WHERE r <= 256)"""
    for k in range(5):
        sql += f""",
near{k} AS MATERIALIZED (
  SELECT r, p, min((d, e)) AS best FROM (
    SELECT a.r, a.p, b.e, list_sum(list_transform(list_zip(a.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM parts a JOIN book{k} b ON a.p = b.p)
  GROUP BY r, p)"""
        if k < 4:
            sql += f""",
book{k + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN (
    SELECT p, e, list({floor} ORDER BY i) AS c FROM (
      SELECT p, e, i, sum(y)::BIGINT AS s, count(*) AS n FROM (
        SELECT n.p, n.best[2] AS e, unnest(q.x) AS y, generate_subscripts(q.x, 1) AS i FROM near{k} n JOIN parts q ON q.r = n.r AND q.p = n.p)
      GROUP BY p, e, i)
    GROUP BY p, e) m ON m.p = b.p AND m.e = b.e)"""
    return (
        sql
        + """,
codes AS (
  SELECT k.vec_id, k.label, string_agg(printf('%02x', n.best[2]), '' ORDER BY n.p) AS code, sum(n.best[1])::BIGINT AS error
  FROM near4 n JOIN kept k ON k.r = n.r GROUP BY k.r, k.vec_id, k.label),
flat AS (SELECT p, e, unnest(c) AS y, generate_subscripts(c, 1) AS i FROM book4)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
       (SELECT sha256(string_agg(y::VARCHAR, ',' ORDER BY p, e, i)) FROM flat) AS codebooks_sha256
FROM codes
"""
    )


def _urls_sql() -> str:
    """The same models level by level; URLs are ASCII here, so characters are bytes."""
    o, names = url_filter.ORDER, ("a", "r")
    fits = lambda h, p: f"((host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}'))"
    ordered = sorted(URL_RULES, key=lambda r: -len(r[0] + r[1]))
    case = lambda k: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{(h + p, v)[k]}'" for h, p, v in ordered) + " END"
    sql = f"""
WITH parted AS (
  SELECT page_id, coalesce(url, '') AS url, translate(regexp_extract(coalesce(url, ''), '{url_filter.PARTS}', 1), '{url_filter.UPPER}', '{url_filter.LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '{url_filter.PARTS}', 2) AS path FROM pages),
ruled AS (SELECT *, {case(0)} AS rule, {case(1)} AS verdict FROM parted),
urls AS MATERIALIZED (SELECT DISTINCT url, rule, verdict, substr(md5(url), 1, 1) < '3' AS late FROM ruled),
places AS MATERIALIZED (
  SELECT url, rule, verdict, late, substr(repeat(chr(2), {o}) || url || chr(3), i::BIGINT, {o + 1}) AS w FROM urls, LATERAL (SELECT unnest(range(1, length(url) + 2)) AS i)),
counts AS MATERIALIZED (
  SELECT w, count(*) FILTER (verdict = 'allow') AS a, count(*) FILTER (verdict = 'block') AS r FROM places WHERE rule IS NOT NULL AND NOT late GROUP BY w),
g0 AS (SELECT substr(w, {o + 1}, 1) AS g, sum(a)::BIGINT AS a, sum(r)::BIGINT AS r FROM counts GROUP BY 1),
whole AS (SELECT sum(a) AS xa, sum(r) AS xr, count(*) FILTER (a > 0) AS ta, count(*) FILTER (r > 0) AS tr FROM g0),
p0 AS (
  SELECT w, {", ".join(f"(coalesce(g.{c}, 0) + t{c}::DOUBLE / {url_filter.ALPHABET}) / (x{c} + t{c})::DOUBLE AS p{c}" for c in names)}
  FROM (SELECT DISTINCT w FROM places WHERE rule IS NULL OR late) s CROSS JOIN whole LEFT JOIN g0 g ON g.g = substr(s.w, {o + 1}, 1))"""
    for k in range(1, o + 1):
        sql += f""",
g{k} AS (SELECT substr(w, {o + 1 - k}, {k + 1}) AS g, sum(a)::BIGINT AS a, sum(r)::BIGINT AS r FROM counts GROUP BY 1),
x{k} AS (SELECT substr(g, 1, {k}) AS x, sum(a) AS xa, sum(r) AS xr, count(*) FILTER (a > 0) AS ta, count(*) FILTER (r > 0) AS tr FROM g{k} GROUP BY 1 HAVING sum(a) + sum(r) >= {url_filter.LEAST}),
p{k} AS (
  SELECT w, {", ".join(f"CASE WHEN x{c} > 0 THEN (coalesce(g.{c}, 0) + t{c} * p{c}) / (x{c} + t{c})::DOUBLE ELSE p{c} END AS p{c}" for c in names)}
  FROM p{k - 1} s LEFT JOIN g{k} g ON g.g = substr(s.w, {o + 1 - k}, {k + 1}) LEFT JOIN x{k} x ON x.x = substr(s.w, {o + 1 - k}, {k}))"""
    return (
        sql
        + f""",
diffs AS (SELECT w, round({url_filter.UNIT} * (ln(pa) - ln(pr)))::BIGINT AS diff FROM p{o}),
scores AS (SELECT url, rule, verdict, sum(diff)::BIGINT AS total, count(*) AS n FROM places JOIN diffs USING (w) WHERE rule IS NULL OR late GROUP BY url, rule, verdict),
buckets AS (
  SELECT floor(total::DOUBLE / ({url_filter.STEP} * n))::BIGINT AS b, count(*) FILTER (verdict = 'allow') AS a, count(*) FILTER (verdict = 'block') AS r FROM scores WHERE rule IS NOT NULL GROUP BY 1),
cuts AS (SELECT b, a, r FROM buckets UNION ALL SELECT {url_filter.BUCKETS + 1}, 0, 0),
below AS (
  SELECT least(greatest(0, coalesce(lag(b) OVER (ORDER BY b) + 1, {-url_filter.BUCKETS})), b) AS b, coalesce(sum(a) OVER w, 0) AS a, coalesce(sum(r) OVER w, 0) AS r, sum(a) OVER () AS all_a, sum(r) OVER () AS all_r
  FROM cuts WINDOW w AS (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
bound AS (SELECT arg_min(b, (a * all_r + (all_r - r) * all_a, abs(b), b)) AS t FROM below)
SELECT d.page_id, d.host, d.path, d.rule,
       CASE WHEN d.rule IS NOT NULL THEN d.verdict WHEN s.total >= s.n * {url_filter.STEP} * t THEN 'allow' ELSE 'block' END AS verdict
FROM ruled d CROSS JOIN bound LEFT JOIN scores s ON d.rule IS NULL AND s.url = d.url
"""
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_license_scan": op2_license_scan,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_quality": op4_quality,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_mix": op6_mix,
    "op7_langid": op7_langid,
    "op8_fingerprint": op8_fingerprint,
    "op9_gru_lm": op9_gru_lm,
    "op10_bpe": op10_bpe,
    "op11_search": op11_search,
    "op12_vector_codes": op12_vector_codes,
    "op13_url_filter": op13_url_filter,
    "near_documents": near_documents,
}

ORACLE_SQL: dict[str, str] = {
    "op1_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
firsts AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, strlen(payload) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((('0x' || substr(p.h, (1 + 5 * (i // 4))::BIGINT, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::BIGINT, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN firsts USING (h)
""",
    "op3_jaccard_join": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
sizes AS (SELECT d.doc_id, count(s.s) AS n FROM documents d LEFT JOIN shingles s ON d.doc_id = s.doc_id GROUP BY d.doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a)
SELECT s.doc_id, s.n AS n_shingles, c.component_id
FROM sizes s JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = s.doc_id
""",
    "op6_mix": r"""
WITH rows AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents),
sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM rows GROUP BY source),
weighted AS (
  SELECT *, [5, 2, 1][1 + rank % 3]::BIGINT AS weight, 3 * source_size AS cap FROM sizes),
ordered AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0) AS room, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS of_weight
  FROM weighted WINDOW w AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (
  SELECT *, room::DOUBLE / of_weight AS level, cap <= weight * (room::DOUBLE / of_weight) AS capped FROM ordered),
targets AS (
  SELECT source, rank, source_size,
         CASE WHEN capped THEN cap::DOUBLE ELSE weight * (SELECT arg_min(level, cap / weight) FROM levels WHERE NOT capped) END AS target
  FROM levels),
queued AS (
  SELECT r.doc_id, r.size, r.key, t.rank, t.source_size, t.target,
         sum(r.size) OVER (PARTITION BY t.rank ORDER BY r.key, r.doc_id, r.size ROWS UNBOUNDED PRECEDING)::BIGINT AS sent
  FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source),
copies AS (
  SELECT doc_id, size, key, rank, (e * source_size + sent) / target AS finish
  FROM queued, (VALUES (0), (1), (2)) x(e) WHERE size > 0 AND target > 0),
ranged AS (
  SELECT *, sum(size) OVER (ORDER BY finish, rank, key, doc_id ROWS UNBOUNDED PRECEDING) AS until FROM copies),
taken AS (
  SELECT doc_id, count(*) AS n FROM ranged WHERE until <= (SELECT sum(size) FROM rows) GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, (q.size * coalesce(t.n, 0))::BIGINT AS taken
FROM queued q LEFT JOIN taken t ON q.doc_id = t.doc_id
""",
    "op11_search": r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM documents),
tfs AS (SELECT doc_id, t, count(*) AS tf FROM words GROUP BY ALL),
docs AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tfs GROUP BY doc_id),
totals AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_words FROM docs),
weights AS (SELECT t, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tfs, totals GROUP BY t),
parts AS (
  SELECT doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_words))) AS part
  FROM tfs JOIN docs USING (doc_id) JOIN weights USING (t), totals),
asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM benchmark),
terms AS (SELECT item_id, t, count(*) AS copies FROM asked GROUP BY ALL),
scores AS (SELECT item_id, doc_id, sum(copies * part)::BIGINT AS score FROM terms JOIN parts USING (t) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 10
""",
    "op12_vector_codes": _codes_sql(),
    "op13_url_filter": _urls_sql(),
}
