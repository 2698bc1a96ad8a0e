"""A corpus pipeline of five of the operators: language, near-duplicates, personal data, source mix, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a DataFrame that the
caller writes and reads again; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agrolith.llm import lang_id, mixing, packing, pii, probminhash
from agrolith.llm.common import checkpoint, fresh, shared_dir, small_batches
from agrolith.llm.mixing import few
from agrolith.session import let_workers_import

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _ready(spark: SparkSession) -> None:
    let_workers_import(spark)
    small_batches(spark)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those whose language score is below the calibrated threshold, go."""
    _ready(spark)
    return lang_id.predict(docs, lang_id.fit(docs)).where("not rejected").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates one row stays: one with the least id (a null is the greatest), whatever rows equal it.

    A row is known by a digest of id and text. Rows equal in both are alike for this; of their other columns one row's are
    kept. Only where a digest that stays is that of several rows are those reduced to one, on the map side, before texts move.
    """
    _ready(spark)
    key, row = fresh(docs, "_row_key", "_row")
    digest = F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))), 256)
    keyed = docs.select(*COLUMNS, F.unhex(digest).alias(key))
    found = probminhash.classes(keyed, keep=(key,))
    kept = checkpoint(found.groupBy(key).agg(F.max("leads").alias("leads"), F.count("*").alias("rows")).where("leads"))
    out = keyed.join(kept.where("rows = 1").select(key), key, "left_semi").select(*COLUMNS)
    if kept.where("rows > 1").isEmpty():
        return out
    repeated = keyed.join(few(kept.where("rows > 1").select(key)), key, "left_semi")
    return out.unionByName(repeated.groupBy(key).agg(F.first(F.struct(*COLUMNS)).alias(row)).select(f"{row}.*"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data give way to their kind in angle brackets; where that changes a text, n_chars follows it."""
    _ready(spark)
    (new,) = fresh(docs, "_clean")
    clean = pii.redact(pii.find(docs), new)
    n_chars = F.when(F.col(new) != F.col("text"), F.length(new).cast("long")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", n_chars).withColumn("text", F.col(new)).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    _ready(spark)
    return mixing.mixed(docs.select(*COLUMNS)).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens, with their ids."""
    _ready(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1, remembered=100_000)  # stages before it left memory in use


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mix_sources", mix_sources), ("pack", pack)]

#: SQL can't express trained models, signatures or tokenizers; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
