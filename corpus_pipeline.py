"""From raw documents to token ids: five stages, each an operator of ``siftfield.llm``.

Every stage takes what its predecessor kept, written as Parquet and read again, and all but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftfield.llm import bpe, jaccard_join, mixing, quality, suffix_dedup
from siftfield.llm.common import modest_batches, read_table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: What makes near copies in the corpus: words of a shingle, and similarity; op3_jaccard_join has its own.
WIDTH, PERCENT = 5, 80
SOME_WORD = r"[^\x20\x09-\x0D]"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go: among them null, empty and blank texts, as they have too few words.

    Rows are judged one by one, in blocks of whole texts, so repeated rows, null ids and null languages
    change nothing for others.
    """
    import public_tokenizers

    modest_batches(spark)
    paths = [public_tokenizers.path(x) for x in quality.VOCABULARIES]
    return quality.judge(docs.select(*COLUMNS), paths).filter("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity of 0.8 or more), the document with the smallest id stays.

    Null ids come after all others; where ids are equal, one text is chosen by its hash.  Of rows that are
    equal in id and text, one stays.  Texts without words (null, empty, blank) have no copies: all stay.
    """
    modest_batches(spark)
    docs = docs.select(*COLUMNS)
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    groups = jaccard_join.similar_groups(docs, width=WIDTH, percent=PERCENT, with_keys=True).filter("component is not null")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col("text_key").alias("key")))
    stays = written(groups.groupBy("component").agg(first.alias("x"), F.count("*").alias("n")).select("x.id", "x.key"), "stays")
    n = stays.count()
    stays = F.broadcast(stays) if n <= jaccard_join.SMALL else stays
    worded = docs.filter(F.coalesce(F.col("text").rlike(SOME_WORD), F.lit(False)))
    kept = worded.join(stays, F.col("doc_id").cast("long").eqNullSafe(F.col("id")) & (key == F.col("key")), "left_semi")
    if kept.select("doc_id").count() > n:  # rows that stand there twice
        kept = kept.dropDuplicates(["doc_id", "text"])
    return kept.unionByName(docs.filter(~F.coalesce(F.col("text").rlike(SOME_WORD), F.lit(False))))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of 50 bytes that an earlier document has are cut; documents of which nothing is left go.

    Texts from which nothing is cut stay as they are, blank and null ones too (null becomes empty).  Null ids
    come last, and rows with one id don't cut each other.
    """
    modest_batches(spark)
    cut = suffix_dedup.remove_repeats(docs.select(*COLUMNS), keep=("lang", "source", "n_chars"), as_text=True)
    same = F.size("spans") == 0
    text = F.col("kept")
    n_chars = F.when(same, F.col("rest.n_chars")).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType)
    out = cut.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), text.alias("text"), "rest.lang", "rest.source", n_chars.alias("n_chars"), same.alias("same"))
    return out.filter(F.col("same") | F.col("text").rlike(SOME_WORD)).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their weights: a document stays out, or comes up to three times.

    A null source is a source; texts without words have no size and stay out; rows with one id are each
    mixed for themselves.
    """
    return mixing.mixed_documents(docs.select(*COLUMNS))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text as token ids: their number, and fingerprints of the ids and of the decoded text.

    Null texts count as empty: no ids.  Each row gives one row, whatever its id.
    """
    import public_tokenizers

    modest_batches(spark)
    return bpe.digests(bpe.encode_texts(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing sources to target weights", mixed),
    ("BPE encoding and decoding", token_ids),
]

#: The tokenisers and the iterated components are beyond SQL; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
