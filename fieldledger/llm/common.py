"""Helpers shared by the operators: shared tables, row numbering and text access."""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only a local master may run without the setting: there one machine holds everything.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    import tempfile

    own = "file://" + tempfile.mkdtemp(prefix="fieldledger-")
    sc.setCheckpointDir(own)
    return own


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and return the written table, so that a lost
    executor costs at most its unfinished tasks. The files go when the JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of shared tables that nothing reads any more."""
    for table in tables:
        sc = table.sparkSession.sparkContext
        for name in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            at = sc._jvm.org.apache.hadoop.fs.Path(name)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


#: Bytes of an Arrow batch of texts. A row that goes to Python waits in the JVM with all its columns for its batch to come back, and
#: the batch is there once in the making, once as it is sent, and in Python as Arrow and as strings.
BATCH_BYTES, BATCH_SETTING = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """From now on this session's rows go to Python in batches of about BATCH_BYTES, not of Spark's 64 MB; a value
    that the session was given stays. It stays set, since plans that are built here run later; no result depends on it."""
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, f"{BATCH_BYTES}b")


def carried(docs: DataFrame) -> DataFrame:
    """docs as one struct column ``row``, so that no name of theirs meets an operator's own."""
    return docs.select(F.struct("*").alias("row"))


def uncarried(rows: DataFrame, like: DataFrame, **new: Column) -> DataFrame:
    """The columns of ``like`` out of ``row``, those named in ``new`` (in any case) replaced."""
    by = {c.lower(): v for c, v in new.items()}
    row = F.col("row")
    columns = [by[c.lower()].cast(like.schema[i].dataType) if c.lower() in by else row.getField(c) for i, c in enumerate(like.columns)]
    return rows.select(*[value.alias(c) for value, c in zip(columns, like.columns, strict=True)])


#: Rows whose key is shared by more than one in so many of all rows are joined by broadcast.
HOT_SHARE = 10_000


def join_hot(rows: DataFrame, facts: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """rows joined with the one row of facts that has their key; count tells how many rows have it.

    A key with more than one in HOT_SHARE of ``total`` rows is hot. There are fewer than HOT_SHARE
    such keys, whatever the data, so they are broadcast and their rows stay where they are; all
    other rows are joined by a shuffle that no single key can burden.
    """
    most = max(1000, total // HOT_SHARE)
    hot, cold = facts.where(F.col(count) > most), facts.where(F.col(count) <= most)
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key))


def text_of(column: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def buckets_for(rows: int) -> int:
    """About the square root, so that neither a bucket nor the list of buckets grows large."""
    return max(1, math.isqrt(max(rows, 1)))


def running_sum(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, into: str, buckets: int, bucket: Column | None = None) -> DataFrame:
    """The sum of value over the rows before this one in its group, by a two-level prefix sum.

    Rows are ordered by (bucket, order); the bucket is a hash of order unless another number is
    given, which should spread as evenly. No task sees more than one bucket of a
    group, and the sums of a group's buckets are the only thing that meets in one task: a group
    with a third of all rows is spread like any other. group must hold no nulls.
    """
    keyed = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)) if bucket is None else bucket)
    sums = keyed.groupBy(*group, "_bucket").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*group, "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*group, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = keyed.withColumn("_own", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return own.join(base, [*group, "_bucket"]).withColumn(into, F.col("_base") + F.col("_own")).drop("_bucket", "_base", "_own")


def dense_number(df: DataFrame, group: Sequence[str], order: Sequence[str], into: str, buckets: int) -> DataFrame:
    """Numbers 0, 1, 2, ... without gaps inside each group, dealt by running_sum."""
    return running_sum(df.withColumn("_one", F.lit(1).cast("long")), group, order, "_one", into, buckets).drop("_one")
