"""From raw documents to packed sequences: language, exact copies, near copies, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; ``run`` writes what a stage returns
as Parquet to the shared folder and hands what it reads back to the next.  Stages are planned when their result is written, so the
language stage leaves the session with Arrow batches of at most ``BATCH_ROWS`` rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkjson.llm.common import ascii_lower, materialize
from sparkjson.llm.dedup import exact_dedup
from sparkjson.llm.langid import add_language, fit
from sparkjson.llm.ngram_join import ngram_components
from sparkjson.llm.packing import pack_documents
from sparkjson.llm.pii import key_from, pseudonymize, store_key

#: Near copies: shingles of five words, Jaccard of 0.8 or more.
NGRAM, SIMILAR = 5, (80, 100)
PSEUDONYM_KEY = "demo-key"
#: Rows of an Arrow batch; with Spark's default a whole input split is one batch, held by the JVM and by its Python worker.
BATCH_ROWS = 512


def _only(docs: DataFrame, kept: DataFrame, digest: Column) -> DataFrame:
    """The rows of ``docs`` whose doc_id (null counts as a value) and ``digest`` are in ``kept``."""
    kept = kept.toDF("__id", "__digest")
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("__id")) & (digest == F.col("__digest")), "left_semi")


def _small_batches(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = int(spark.conf.get(name))
    spark.conf.set(name, min(rows, BATCH_ROWS) if rows > 0 else BATCH_ROWS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language can be found go; a missing label is filled in."""
    _small_batches(spark)
    known = add_language(docs, fit(docs), into=("__lang", "__score")).where("__lang <> 'und'")
    return known.withColumn("lang", F.coalesce("lang", "__lang")).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays."""
    kept = exact_dedup(docs).where("kept").select("doc_id", "text_sha256")
    return _only(docs, kept, F.sha2(ascii_lower(F.coalesce("text", F.lit(""))), 256))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the one with the smallest doc_id stays; of its texts with that doc_id, the one with the smallest hash."""
    groups = ngram_components(docs, ngram=NGRAM, num=SIMILAR[0], den=SIMILAR[1])
    first = groups.where("doc_id = component_id AND group_id IS NOT NULL").groupBy("group_id").agg(F.min("doc_id").alias("doc_id"), F.min("text_hash").alias("text_hash"))
    alone = groups.where("group_id IS NULL").select("doc_id", "text_hash").distinct()
    return _only(docs, first.select("doc_id", "text_hash").unionByName(alone), F.xxhash64("text"))


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become pseudonyms; n_chars follows the new text."""
    changed = pseudonymize(docs, key_from(spark, store_key(spark, PSEUDONYM_KEY))).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return changed.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequence and their offset in it."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language), ("exact_dedup", exact), ("ngram_jaccard", near), ("pii_pseudonyms", privacy), ("best_fit_packing", packing)]

#: Suffix automata, pseudonyms and packing are beyond SQL; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
