"""Exact deduplication by two-pass Bloom filtering, with DataFrame functions only.

The first pass over the digests builds a filter of bits set twice or more. The second pass sends the rows that the filter
rules out straight through; only rows whose digest may be repeated are shuffled, aggregated by digest before the shuffle
and joined with their group. A hot group is one row of the aggregate; its rows are split by Spark's skew join.

Null text counts as empty, and empty texts are equal. A null id loses against any other id. Rows equal in id and text are
the same record: each carries the same verdict, and keep_one() leaves one of them. An empty table gives an empty result.
Columns of the input stay; the added names (keep_id, group_size, kept, text_sha256) replace columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import materialize, spread, text_or_empty

ADDED = ("keep_id", "group_size", "kept", "text_sha256")


def with_digest(df: DataFrame, text_col: str = "text") -> DataFrame:
    return df.drop("_digest").withColumn("_digest", F.unhex(F.sha2(text_or_empty(text_col), 256)))


def _groups(maybe: DataFrame, id_col: str) -> DataFrame:
    """For each possibly repeated digest: the id that stays, how many rows have it, and the group's size."""
    by_id = maybe.groupBy("_digest", id_col).agg(F.count("*").alias("_n"))
    best = by_id.groupBy("_digest").agg(F.max(F.struct(F.col(id_col).alias("id"), F.col("_n").alias("n"))).alias("_best"), F.sum("_n").alias("group_size"))
    return best.select("_digest", F.col("_best.id").alias("keep_id"), F.col("_best.n").alias("_ties"), "group_size")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with keep_id (the largest id among equal texts), group_size, kept and text_sha256; every row stays.

    If df already has the column _digest, df is read as it is: pass a narrow, written table to read long texts once.
    """
    rows = (df if "_digest" in df.columns else with_digest(df, text_col)).drop(*ADDED)
    narrow = df if "_digest" in df.columns else materialize(rows.select(id_col, "_digest"), "digests")
    found = bloom.filter_of_repeated(narrow, "_digest", narrow.count())
    found = materialize(found[0], "repeated"), found[1]
    groups = spread(_groups(bloom.test(narrow, "_digest", found, "_maybe").where("_maybe").drop("_maybe"), id_col))
    tested = bloom.test(rows, "_digest", found, "_maybe")
    once = tested.where(~F.col("_maybe")).select(*rows.columns, F.col(id_col).alias("keep_id"), F.lit(1).cast("long").alias("_ties"), F.lit(1).cast("long").alias("group_size"))
    again = tested.where("_maybe").select(*rows.columns).join(groups, "_digest").select(*rows.columns, "keep_id", "_ties", "group_size")
    out = once.unionByName(again).withColumn("kept", F.col(id_col).eqNullSafe(F.col("keep_id")))
    return out.withColumn("text_sha256", F.lower(F.hex("_digest")))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that stay, one for each text, with df's columns."""
    out = exact_dedup(df.withColumn("_row", F.struct(*[F.col(f"`{c}`") for c in df.columns])).select(id_col, text_col, "_row"), id_col, text_col).where("kept")
    single, tied = out.where("_ties = 1"), out.where("_ties > 1").dropDuplicates(["_digest"])
    return single.unionByName(tied).select("_row.*")
