"""A corpus pipeline of five operators; each stage works on all that the one before it kept."""

from __future__ import annotations

from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm import bpe, langid, minhash, mixing, pii
from millrace.llm.common import read, written


#: Rows of a batch that goes to Python: texts, their word lists and what is made of them stay in a worker's memory at once.
BATCH_ROWS = 1000


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; those without letters, or without one n-gram of any language, go."""
    _small_batches(spark)
    model = langid.fit(docs.filter(~langid.held_out()))
    return langid.predict(docs, model).filter("lang_pred <> 'und' and score > 0").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate class; a row without id is a class of its own.

    Rows that share an id are one document: the one that is least by a hash of its columns stays. An empty
    table stays empty.
    """
    _small_batches(spark)
    found = written(minhash.classes(docs).filter("id = class_id").select(F.col("id").alias("_kept")).distinct())
    least = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64(*docs.columns), F.hash(*docs.columns)))
    kept = docs.join(found, F.col("doc_id") == F.col("_kept"), "left_semi").withColumn("_least", least).filter("_least = 1")
    return kept.select(*docs.columns).unionByName(docs.filter("doc_id is null"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates for personal data; n_chars is counted anew. Null texts stay null, repeated rows repeated."""
    out = pii.replaced(docs, pii.session_key(spark)).drop("n_entities")
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    A row is known by two hashes of all its columns, so rows without id, or that share one, keep their own
    numbers. Rows that are alike in all columns come as often as the mix takes them together. Null and empty
    texts have size 0 and are never taken; an empty table stays empty.
    """
    keyed = docs.withColumns({"_a": F.xxhash64(*docs.columns), "_b": F.hash(*docs.columns)})
    taken = mixing.mix(keyed, carry=("_a", "_b")).groupBy("_a", "_b").agg(F.sum("copies").alias("_copies")).filter("_copies > 0")
    once = F.row_number().over(Window.partitionBy("_a", "_b").orderBy("_copies"))
    joined = keyed.join(taken, ["_a", "_b"]).withColumn("_once", once).filter("_once = 1")
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again, as digests; a null text counts as an empty one."""
    _small_batches(spark)
    data = Path(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).read_bytes()
    return bpe.digests(docs, data, public_tokenizers.PATTERN)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixture", mixture), ("tokens", tokens)]

#: No SQL expresses a learned model; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents, each stage's rows written and read again as the next one's."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
