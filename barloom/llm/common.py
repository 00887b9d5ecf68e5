"""What the operators share: tables written to the shared folder, and the definition of a word."""

from __future__ import annotations

import re
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as Spark's regular expressions and as bytes.split() see it.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one set here if a local session has none."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", sc.master):  # local-cluster has executors with folders of their own
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "/tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{sc.applicationId}"


class _Open(threading.local):
    def __init__(self) -> None:
        self.tables: list[list[DataFrame]] = []


_open = _Open()


@contextmanager
def scratch() -> Iterator[None]:
    """Deletes, at its end, the tables written within it; those to keep pass to the scratch around it, if there is one."""
    _open.tables.append([])
    try:
        yield
    finally:
        for df in _open.tables.pop():
            drop_table(df)


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """df as a table written to the shared folder: its lineage is cut, and it survives the loss of executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    for tables in _open.tables[-2:-1] if keep else _open.tables[-1:]:
        tables.append(out)
    return out


BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of long texts that Spark passes to Python at once.
BATCH = 2_000


def small_batches(spark: SparkSession) -> None:
    """Sets, for the session, that batches for Python hold BATCH rows at most: they bound what texts take in either process."""
    now = int(spark.conf.get(BATCH_KEY))
    if not 0 < now <= BATCH:
        spark.conf.set(BATCH_KEY, str(BATCH))


def drop_table(df: DataFrame) -> None:
    """Deletes what materialize() wrote, once nothing reads it any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_to)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """df dealt anew, so that a join with it exchanges both sides, which lets Spark split a hot key's partition."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def placed(df: DataFrame, out_col: str, *order: Column) -> DataFrame:
    """df with each row's place (from 0) in an order: a range partitioning sorted within, and the rows of the partitions before."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows = rows.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    rows = materialize(rows, "order")
    before, at = [], 0
    for r in rows.groupBy("_part").count().orderBy("_part").collect():  # one row a partition
        before.append((r["_part"], at))
        at += r["count"]
    starts = df.sparkSession.createDataFrame(before, "_part int, _before long")
    return rows.join(F.broadcast(starts), "_part").withColumn(out_col, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def fold_of(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5: the fold that keeps rows out of training."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(5))
