"""A corpus pipeline of five stages; each works on all that its predecessor kept, written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import bloom, bpe, exact_dedup, mixing, near_dedup, toxicity
from barloom.llm.common import fold_of, materialize, scratch, small_batches, spread
from barloom.llm.queries import table, tokenizer_path


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5. The lexicon is learned from the training folds of labels, on documents of this stage."""
    small_batches(spark)
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels").where(fold_of() != 0))
    out = "_toxicity"
    while out in docs.columns:
        out += "_"
    return toxicity.score(docs, lexicon, out_col=out).where(F.col(out) < 0.5).select(*[F.col(f"`{c}`") for c in docs.columns])


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:  # noqa: ARG001
    """Of equal texts, the row with the largest id."""
    return exact_dedup.keep_one(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:  # noqa: ARG001
    """Of linked texts, the one with the least id. Only rows that may have to go are shuffled; rows with a null id stay."""
    small_batches(spark)
    gone = materialize(near_dedup.near_dedup(docs).where("not kept").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col("doc_id").cast("long").alias("_id"))
    tested = bloom.test(rows, "_id", bloom.written(bloom.filter_of, gone, "_gone"), "_maybe")
    stays = tested.where(~F.col("_maybe")).select("_doc")
    checked = tested.where("_maybe").join(spread(gone), F.col("_id") == F.col("_gone"), "left_anti").select("_doc")
    return stays.unionByName(checked).select("_doc.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:  # noqa: ARG001
    """Each document as often as the mix of sources takes it."""
    small_batches(spark)
    return mixing.mixed(docs)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:  # noqa: ARG001
    """The ids of each document's text."""
    small_batches(spark)
    out = bpe.encode(docs, tokenizer_path()).drop("text", "n_chars")
    return out.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("mixing", mixed),
    ("bpe", tokenized),
]

#: The stages learn, draw and link by similarity: SQL can't express them; tests/llm/ has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch():  # a stage's own tables go once its result is written
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}", keep=True)
    return docs
