"""Helpers shared by the corpus operators: written tables, running sums, words."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliograde.session import shared_folder

#: Words of the whitespace kind: everything but space and the controls 9 to 13.
PLAIN_WORD = "[^\\x20\\x09-\\x0D]+"
#: Words of letters and digits: everything from U+0080 on counts as a letter.
ALNUM_WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: The same words before A-Z are lower-cased.
ALNUM_WORD_ANY_CASE = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"

#: Spark's setting by which the shuffle files of a query go when it ends.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: it cuts lineage and survives lost executors.

    Nobody else reads the shuffles of that job, so their files go as soon as it ends, not when the driver collects garbage.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.select("*").write.parquet(path)
    finally:
        spark.conf.set(SHUFFLES_GO, before) if before is not None else spark.conf.unset(SHUFFLES_GO)
    table = spark.read.schema(df.schema).parquet(path)
    table.saved_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete written tables that no later plan reads."""
    for table in tables:
        if path := getattr(table, "saved_at", None):
            spark = table.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def root_of(n: int) -> int:
    """Buckets for n rows so that neither a bucket nor the list of buckets grows faster than the root."""
    return max(1, math.isqrt(max(0, n)))


def running_before(df: DataFrame, part: list[str], bucket: str, order: list[Column | str], value: str, out: str) -> DataFrame:
    """Add the sum of ``value`` over the rows that come before, within ``part``, by bucket and then ``order``.

    No task sees more than one bucket's rows, or one row per bucket of a part, however many rows a part has.
    ``part`` and ``bucket`` columns hold no nulls.
    """
    sums = df.groupBy(*part, bucket).agg(F.sum(value).alias("_sum"))
    over = Window.partitionBy(*part).orderBy(bucket)
    offsets = sums.select(*part, bucket, (F.sum("_sum").over(over) - F.col("_sum")).alias("_offset"))
    local = Window.partitionBy(*part, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("_local", F.coalesce(F.sum(value).over(local), F.lit(0)))
    joined = rows.join(offsets, [*part, bucket])
    return joined.withColumn(out, F.col("_offset") + F.col("_local")).drop("_offset", "_local")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def spark_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")
