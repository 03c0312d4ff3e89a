"""Queries on vectors and ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftfield.operators import vector_index
from siftfield.operators import vectors as v
from siftfield.plans.registry import query, table
from siftfield.sources.scratch import scratch_dir

UNIT = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
#: Queries are the vectors whose id is divisible by 50; their own text serves as the question.
ASKED = "vec_id % 50 = 0"


def stored(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def asked(spark, d):
    return stored(spark, d).filter("id % 50 = 0").select(F.col("id").alias("qid"), "embedding")


def first_vector(spark, d):
    return stored(spark, d).orderBy("id").limit(1).collect()[0]["embedding"]


@query("vector_topk_cosine", f"SELECT a.vec_id AS id, round({UNIT}, 6) AS similarity, row_number() OVER (ORDER BY {UNIT} DESC, a.vec_id DESC) AS rank FROM embeddings a, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) b QUALIFY rank <= 10")
def vector_topk_cosine(spark, d):
    out = v.top_k(stored(spark, d), first_vector(spark, d), 10)
    return out.select("id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


L2 = "(1 - list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) * (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE))))"


@query("vector_topk_l2", f"SELECT a.vec_id AS id, round({L2}, 6) AS similarity, row_number() OVER (ORDER BY {L2} DESC, a.vec_id DESC) AS rank FROM embeddings a, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) b QUALIFY rank <= 10")
def vector_topk_l2(spark, d):
    out = v.top_k(stored(spark, d), first_vector(spark, d), 10, metric="l2")
    return out.select("id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


HITS = f"""hits AS (SELECT b.vec_id AS qid, a.vec_id AS id, a.label, round({UNIT}, 6) AS similarity,
  row_number() OVER (PARTITION BY b.vec_id ORDER BY round({UNIT}, 6) DESC, a.vec_id) AS rank
  FROM embeddings a JOIN embeddings b ON b.{ASKED} QUALIFY rank <= 20)"""


def hits(spark, d, k=20):
    return v.batch_top_k(stored(spark, d), asked(spark, d), k, digits=6).withColumn("rank", F.col("rank").cast("long"))


@query("vector_batch_topk", f"WITH {HITS} SELECT qid, id, similarity, rank FROM hits")
def vector_batch_topk(spark, d):
    return hits(spark, d)


@query("vector_index_topk", f"WITH {HITS} SELECT qid, id, similarity, rank FROM hits")
def vector_index_topk(spark, d):
    """The same finds as vector_batch_topk, from stored cells: those that the bounds leave are not read."""
    path = scratch_dir(spark, "vector-index")
    vector_index.build(stored(spark, d), path)
    return vector_index.search(spark, path, asked(spark, d), 20, digits=6).withColumn("rank", F.col("rank").cast("long"))


@query("multi_query_union_dedupe", f"WITH {HITS}, once AS (SELECT *, row_number() OVER (PARTITION BY label, id % 10 ORDER BY qid, rank) AS r FROM hits) SELECT qid, id, rank FROM once WHERE r = 1 ORDER BY qid, rank LIMIT 25")
def multi_query_union_dedupe(spark, d):
    rows = hits(spark, d).join(stored(spark, d).select("id", "label"), "id")
    key = F.struct("label", F.col("id") % 10)
    return v.union_of_queries(rows, "qid", key).select("qid", "id", "rank")


@query("multi_request_union", f"""
WITH {HITS}, once AS (SELECT *, qid % 3 AS request, row_number() OVER (PARTITION BY qid % 3, label, id % 10 ORDER BY qid, rank) AS r FROM hits)
SELECT request, qid, id, rank FROM once WHERE r = 1 QUALIFY row_number() OVER (PARTITION BY request ORDER BY qid, rank) <= 25""")
def multi_request_union(spark, d):
    """As above for several requests at once; a query's number says whose it is."""
    rows = hits(spark, d).join(stored(spark, d).select("id", "label"), "id").withColumn("request", F.col("qid") % 3)
    return v.union_of_queries(rows, "qid", F.struct("label", F.col("id") % 10), request=["request"]).select("request", "qid", "id", "rank")


FOUND = HITS.replace("rank <= 20", "rank <= 40") + """, words AS (SELECT doc_id, text, source, list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '')) AS w FROM documents),
kept AS (SELECT h.qid, h.id, h.rank, h.similarity, d.text, d.source, round(len(list_intersect(q.w, d.w))::DOUBLE / len(q.w), 9) AS score
  FROM hits h JOIN words d ON d.doc_id = h.id JOIN words q ON q.doc_id = h.qid WHERE contains(lower(d.text), 'the')),
best AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rank) AS rerank_rank FROM kept QUALIFY rerank_rank <= 6)"""


def found(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "source")
    queries = asked(spark, d).join(docs.select(F.col("id").alias("qid"), F.col("text").alias("query")), "qid")
    return v.search_and_filter(stored(spark, d).select("id", "embedding"), queries, docs, 20, 6, weed=["the"], digits=6)


@query("search_filter_after_topk", f"WITH {FOUND} SELECT qid, id, rank, score AS rerank_score, rerank_rank FROM best")
def search_filter_after_topk(spark, d):
    return found(spark, d).select("qid", "id", F.col("rank").cast("long").alias("rank"), F.round("rerank_score", 9).alias("rerank_score"), F.col("rerank_rank").cast("long").alias("rerank_rank"))


@query("numbered_context", f"WITH {FOUND} SELECT qid, md5(string_agg('[' || rerank_rank || '] [FUENTE: ' || source || ']' || chr(10) || text, chr(10) || '---' || chr(10) ORDER BY rerank_rank)) AS context_md5, count(*) AS n FROM best GROUP BY qid")
def numbered_context(spark, d):
    rows = found(spark, d)
    context = v.numbered_context(rows, "qid", "rerank_rank", F.col("source"), F.col("text"))
    return context.join(rows.groupBy("qid").agg(F.count("*").alias("n")), "qid").select("qid", F.md5("context").alias("context_md5"), "n")


@query("source_map", f"WITH {FOUND} SELECT qid, string_agg(rerank_rank || ':' || id || ':' || source || ':' || length(text), ',' ORDER BY rerank_rank) AS sources FROM best GROUP BY qid")
def source_map(spark, d):
    facts = {"id": F.col("id"), "source": F.col("source"), "chars": F.length("text")}
    sources = v.source_map(found(spark, d), "qid", "rerank_rank", facts)
    line = lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"]["id"].cast("string"), e["value"]["source"], e["value"]["chars"].cast("string"))
    return sources.select("qid", F.array_join(F.transform(F.map_entries("sources"), line), ",").alias("sources"))


@query("failure_vector", "SELECT vec_id, round(CASE WHEN label % 3 = 0 THEN 0 ELSE 1 END, 6)::DOUBLE AS self_similarity, CASE WHEN label % 3 = 0 THEN 64 ELSE len(embedding) END AS n, coalesce(round(CASE WHEN label % 3 = 0 THEN 0 ELSE list_sum(embedding::DOUBLE[]) END, 4), 0)::DOUBLE AS total FROM embeddings")
def failure_vector(spark, d):
    broken = F.when(F.col("label") % 3 == 0, F.lit(None)).otherwise(F.col("embedding"))
    total = F.round(F.aggregate("e", F.lit(0.0), lambda a, x: a + x.cast("double")), 4)
    return stored(spark, d).withColumn("e", v.or_zeros(broken, 64)).select(F.col("id").alias("vec_id"), F.round(v.cosine(F.col("e"), F.col("e")), 6).alias("self_similarity"), F.size("e").cast("long").alias("n"), (total + F.lit(0.0)).alias("total"))


@query("embedding_cache_miss", "SELECT DISTINCT md5(text) AS text_md5 FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE lang = 'fr')")
def embedding_cache_miss(spark, d):
    docs = table(spark, d, "documents")
    cache = docs.filter("lang = 'fr'").select(F.md5("text").alias("text_md5"), F.array(F.lit(0.0).cast("float")).alias("embedding")).distinct()
    misses, _ = v.embed_unseen(docs, cache, "text")
    return misses.select("text_md5")


#: One word per dimension: a text's vector has 1 where its word occurs.
MARKS = ["license", "token", "http", "the", "der", "les"]


@query("embedding_vectors", "SELECT DISTINCT md5(text) AS text_md5, concat_ws(',', " + ", ".join(f"contains(lower(text), '{w}')::INT" for w in MARKS) + ") AS vector FROM documents")
def embedding_vectors(spark, d):
    docs = table(spark, d, "documents")
    half, empty = docs.filter("doc_id % 2 = 0"), spark.createDataFrame([], "text_md5 string, embedding array<float>")
    _, cache = v.embed_unseen(half, empty, "text", len(MARKS), embedder=v.word_marks(MARKS))
    _, cache = v.embed_unseen(docs, cache, "text", len(MARKS), embedder=v.word_marks(MARKS))
    return cache.select("text_md5", F.array_join(F.transform("embedding", lambda x: x.cast("int").cast("string")), ",").alias("vector"))


@query("embedding_cache_fill", "SELECT count(DISTINCT md5(text)) AS n_cached, 64 AS dim FROM documents")
def embedding_cache_fill(spark, d):
    docs = table(spark, d, "documents")
    empty = spark.createDataFrame([], "text_md5 string, embedding array<float>")
    _, cache = v.embed_unseen(docs, empty, "text")
    return cache.agg(F.count("*").alias("n_cached"), F.max(F.size("embedding")).alias("dim"))


@query("query_enrichment", "SELECT conv_id, turn, md5(CASE WHEN contains(lower(text), 'the') OR contains(lower(text), 'die') THEN 'lenteja ' || text ELSE text END) AS query_md5 FROM conversations WHERE role = 'user'")
def query_enrichment(spark, d):
    users = table(spark, d, "conversations").filter("role = 'user'")
    return users.select("conv_id", "turn", F.md5(v.enriched(F.col("text"), ["the", "die"], "lenteja")).alias("query_md5"))


@query("term_overlap", """SELECT item_id, doc_id, round(len(list_intersect(a.w, b.w))::DOUBLE / len(a.w), 9) AS overlap
FROM (SELECT item_id, list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '')) AS w FROM benchmark) a,
     (SELECT doc_id, list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '')) AS w FROM documents) b WHERE a.item_id = b.doc_id""")
def term_overlap(spark, d):
    items = table(spark, d, "benchmark").select("item_id", F.col("text").alias("question"))
    docs = table(spark, d, "documents").select("doc_id", "text")
    rows = items.join(docs, F.col("item_id") == F.col("doc_id"))
    return rows.select("item_id", "doc_id", F.round(v.term_overlap(F.col("question"), F.col("text")), 9).alias("overlap"))
