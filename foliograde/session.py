"""Session helpers: the shared folder and the plan-time size check."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A cluster session must name it.  Only a single-machine session, as in the
    tests, gets a temporary folder, which is then kept in the session setting.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
    folder = tempfile.mkdtemp(prefix="foliograde-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Spark's setting by which the shuffle files of a query go when it ends.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Within it, the shuffle files of a query go as soon as it ends, not when the driver collects garbage."""
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLES_GO, before) if before is not None else spark.conf.unset(SHUFFLES_GO)


def small_rows(df: DataFrame, limit: int) -> list | None:
    """Rows of a table that should be configuration-sized; None if it has more than ``limit``."""
    rows = df.limit(limit + 1).collect()
    return None if len(rows) > limit else rows
