"""The queries opN_<name>, thin over the operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, exact_dedup, lm, mixing, near_dedup, quality, sharding, toxicity, warc
from .common import fold_of, materialize, small_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents; a document's source is its host, its language there the path."""
    docs = table(spark, sf_dir, "documents")
    return quality.quality(docs, table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    path = tokenizer_path()
    ids = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path).drop("text")
    both = bpe.decode(ids, path)
    joined = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-pass Bloom filtering over all documents; the narrow table of digests is written once, so texts are read once."""
    digests = materialize(exact_dedup.with_digest(table(spark, sf_dir, "documents")).select("doc_id", "_digest"), "digests")
    return exact_dedup.exact_dedup(digests).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents whose shingle sets are similar by 0.75 or more."""
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes."""
    out = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gated recurrent model of the training folds, and the log10 probability it gives every whole text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fitted = lm.fit(docs.where(fold_of() != 1))
    out = lm.score(docs, fitted)
    return out.select("doc_id", (fold_of() == 1).alias("held_out"), "n_tokens", "n_known", F.lit(fitted.n).cast("long").alias("train_tokens"), "base_score", "score")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a lexicon learned from the training folds of labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels").where(fold_of() != 0))
    out = toxicity.score(docs, lexicon)
    return out.select("doc_id", (fold_of() == 0).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest found of every vector whose id is divisible by 100."""
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of all pages."""
    out = warc.derive(warc.responses(table(spark, sf_dir, "pages")))
    return out.select("page_id", "record_type", "record_id", "refers_to", "concurrent_to", "target_uri", "date", "content_type", "content_length", "block_digest", "payload_digest", F.col("source_headers").cast("string").alias("source_headers"), F.decode("block", "UTF-8").alias("content"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed with sources weighing 5, 2, 1, repeating, none above three times its size."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_bpe": op2_bpe,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_near_dedup": op4_near_dedup,
    "op5_sharding": op5_sharding,
    "op6_lm_score": op6_lm_score,
    "op7_toxicity": op7_toxicity,
    "op8_ann": op8_ann,
    "op9_warc": op9_warc,
    "op10_mixing": op10_mixing,
}

ORACLE_SQL: dict[str, str] = {
    "op3_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
}
