"""Queries on stores, runs, logs and payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftfield.operators import logs
from siftfield.plans.registry import query, table
from siftfield.sources import files, store
from siftfield.sources.scratch import scratch_dir

IDS = "SELECT 'chunk_' || (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) || '_' || source AS id, doc_id FROM documents"


@query("append_unseen", f"SELECT id, doc_id FROM ({IDS}) WHERE id NOT IN (SELECT 'chunk_' || (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) || '_' || source FROM documents WHERE lang = 'en')")
def append_unseen(spark, d):
    docs = table(spark, d, "documents")
    stored = store.with_ids(docs.filter("lang = 'en'"), "source", ["doc_id"]).select("id")
    return store.unseen(store.with_ids(docs, "source", ["doc_id"]), stored).select("id", "doc_id")


@query("upsert_last_wins", "SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def upsert_last_wins(spark, d):
    return store.last_wins(table(spark, d, "events"), "user_id", F.col("event_id")).select("user_id", "event_id", "value")


@query("upsert_store", "SELECT user_id, arg_max(event_id, (event_type = 'view', event_id)) AS event_id, arg_max(value, (event_type = 'view', event_id)) AS value FROM events GROUP BY user_id")
def upsert_store(spark, d):
    """All but the views go into a bucketed store, then the views over them."""
    events, path = table(spark, d, "events").select("user_id", "event_id", "value", "event_type"), scratch_dir(spark, "store")
    for part in (F.col("event_type") != "view", F.col("event_type") == "view"):
        store.upsert(events.filter(part).drop("event_type"), path, "user_id", order=F.col("event_id"))
    return store.stored(spark, path, events.drop("event_type").schema)


@query("collection_counts", "SELECT lang AS collection, count(*) AS n FROM documents GROUP BY lang")
def collection_counts(spark, d):
    return store.collection_counts(table(spark, d, "documents").withColumnRenamed("lang", "collection"))


@query("ingest_summary", "SELECT user_id, count(*) AS total, count(*) FILTER (WHERE event_type <> 'error') AS ok, count(*) FILTER (WHERE event_type = 'error') AS failed, round(100.0::DOUBLE * count(*) FILTER (WHERE event_type <> 'error') / count(*), 1) AS success_pct, max(CASE WHEN event_type = 'error' THEN substr(props, 1, 200) END) AS error FROM events GROUP BY user_id")
def ingest_summary(spark, d):
    return store.ingest_summary(table(spark, d, "events"), ["user_id"], F.col("event_type") != "error", F.col("props"))


@query("payload_number", "SELECT event_id, (props::JSON ->> 'k')::BIGINT AS k FROM events")
def payload_number(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("inline_payload", "SELECT doc_id, md5(text) AS text_md5 FROM documents")
def inline_payload(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("data:text/plain;base64,"), F.base64(F.encode("text", "UTF-8"))).alias("data"))
    return docs.select("doc_id", F.md5(files.inline_bytes(F.col("data"))).alias("text_md5"))


ORDERED = ["purchase", "signup", "click", "view"]
RANK = "CASE event_type " + " ".join(f"WHEN '{e}' THEN {i}" for i, e in enumerate(ORDERED)) + " END"


@query("first_success", f"""
SELECT u.user_id, a.model, coalesce(a.content, 'Servicio no disponible') AS content, u.n AS attempts
FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) u LEFT JOIN (
  SELECT user_id, event_type AS model, props AS content FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {RANK}, event_id) AS r FROM events WHERE event_type <> 'error' AND value > 100) WHERE r = 1) a USING (user_id)""")
def first_success(spark, d):
    events = table(spark, d, "events")
    place = F.array_position(F.array(*(F.lit(e) for e in ORDERED)), F.col("event_type"))
    attempts = events.select("user_id", F.struct(place, "event_id").alias("priority"), F.col("event_type").alias("model"), F.col("props").alias("content"), ((F.col("event_type") != "error") & (F.col("value") > 100)).alias("success"))
    return logs.first_success(events.select("user_id").distinct(), attempts, "user_id")


@query("call_log_stats", """
SELECT count(*) AS total, count(*) FILTER (WHERE ok AND event_type = 'view') AS primary_ok, count(*) FILTER (WHERE ok AND event_type <> 'view') AS fallback_ok, count(*) FILTER (WHERE NOT ok) AS failures,
  round(100.0::DOUBLE * count(*) FILTER (WHERE ok) / count(*), 1) AS success_pct, round(100.0::DOUBLE * count(*) FILTER (WHERE ok AND event_type <> 'view') / count(*), 1) AS fallback_pct,
  arg_max(props, (ts, event_id)) FILTER (WHERE NOT ok) AS last_error, (SELECT string_agg(event_type || '=' || n, ',' ORDER BY event_type) FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)) AS by_model
FROM (SELECT *, event_type <> 'error' AS ok FROM events)""")
def call_log_stats(spark, d):
    ok = F.col("event_type") != "error"
    calls = table(spark, d, "events").select(F.col("event_type").alias("model"), ok.alias("success"), F.when(~ok, F.col("props")).alias("error"), "ts", F.col("event_id").alias("order"))
    line = F.array_join(F.transform(F.array_sort(F.map_entries("by_model")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return logs.router_stats(calls, "view").withColumn("by_model", line)
