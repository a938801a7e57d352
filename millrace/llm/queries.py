"""The registered queries of this folder: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, gnat, hnsw, langid, licenses, minhash, mixing, oracles, packing, pii, prefix_trie, quality, secrets
from .common import read


def op1_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """Every document encoded and decoded again, as digests."""
    data = Path(vocabulary or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).read_bytes()
    return bpe.digests(read(spark, sf_dir, "documents"), data, public_tokenizers.PATTERN)


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document; the first of a class is kept."""
    found = minhash.classes(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "class_id", "n_checked_links", F.coalesce(F.col("id") == F.col("class_id"), F.lit(True)).alias("kept"))


def op3_token_packing(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """Every document's ids in packed rows."""
    data = Path(vocabulary or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).read_bytes()
    return packing.tokenize_and_pack(read(spark, sf_dir, "documents"), data, public_tokenizers.PATTERN)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the rows outside the test fold only."""
    docs = read(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(~langid.held_out()))
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op5_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every row whose vec_id is divisible by 20."""
    vectors = ann.usable(read(spark, sf_dir, "embeddings"))
    found = ann.search(vectors, vectors.filter("id % 20 = 0"), 20)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of every document. Its path is made of its source and numbers: up to two levels of folders, one file in 40 named LICENSE."""
    number = F.col("doc_id")
    name = F.when(number % 40 == 3, F.concat(F.lit("LICENSE-"), number.cast("string"))).otherwise(F.concat(number.cast("string"), F.lit(".txt")))
    folders = [F.coalesce("source", F.lit("")), F.when(number % 4 > 0, F.concat(F.lit("d"), (number % 17).cast("string"))), F.when(number % 4 > 1, F.concat(F.lit("e"), (number % 5).cast("string")))]
    docs = read(spark, sf_dir, "documents").withColumn("path", F.concat_ws("/", *folders, name))
    return licenses.scan(docs, carry=("doc_id",)).select("doc_id", "path", "licence", "cosine", "origin")


def op7_hnsw_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    found = hnsw.near_duplicates(read(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with surrogates for personal data."""
    return pii.replaced(read(spark, sf_dir, "documents").select("doc_id", "text"), pii.session_key(spark))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secrets.digests(read(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_gnat_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every row whose vec_id is divisible by 100, for each of its positives."""
    return gnat.hard_negatives(gnat.usable(read(spark, sf_dir, "embeddings")), F.col("id") % 100 == 0)


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdicts of every document."""
    return quality.assess(read(spark, sf_dir, "documents")).drop("text_left")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations."""
    return prefix_trie.nodes(prefix_trie.rebuilt(prefix_trie.sequences(read(spark, sf_dir, "conversations"))))


QUERIES = {
    f.__name__: f
    for f in (
        op1_bpe,
        op2_minhash_near_dedup,
        op3_token_packing,
        op4_language_id,
        op5_additive_quantisation,
        op6_license_scan,
        op7_hnsw_near_dedup,
        op8_pii_surrogates,
        op9_secret_scan,
        op10_mixing,
        op11_gnat_hard_negatives,
        op12_quality_rules,
        op13_prefix_trie,
    )
}

#: Vectors of one label and length, pair by pair; ids are distinct.
_OP7 = """WITH RECURSIVE
fine AS MATERIALIZED (
  SELECT vec_id, label, len(embedding) AS n, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.label = b.label AND a.n = b.n AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reached(vec_id, root) AS (
  SELECT vec_id, vec_id FROM fine UNION SELECT l.b, r.root FROM reached r JOIN links l ON l.a = r.vec_id),
roots AS (SELECT vec_id, min(root) AS root FROM reached GROUP BY vec_id),
counts AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT e.vec_id, coalesce(c.n_links, 0) AS n_links, coalesce(r.root, e.vec_id) AS component_id, coalesce(e.vec_id = coalesce(r.root, e.vec_id), true) AS kept
FROM embeddings e LEFT JOIN roots r ON r.vec_id = e.vec_id LEFT JOIN counts c ON c.vec_id = e.vec_id"""
#: The others rest on models, hashes and seeded choices, or on forms that SQL cannot parse.
ORACLE_SQL: dict[str, str] = {"op7_hnsw_near_dedup": _OP7, "op11_gnat_hard_negatives": oracles.OP11, "op12_quality_rules": oracles.OP12, "op13_prefix_trie": oracles.OP13}
