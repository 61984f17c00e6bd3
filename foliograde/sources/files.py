"""Files: what lies in a folder and what kind it is.  File contents are never read here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograde import fixed_values as fv


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-cased last suffix with its dot; empty if there is none (``.pdf`` alone is a name)."""
    return F.lower(F.regexp_extract(file_name(path), r"[^.].*(\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    name = file_name(path)
    return F.substring(name, F.lit(1), F.length(name) - F.length(extension(path)))


def is_pdf(path: Column) -> Column:
    return F.endswith(F.lower(path), F.lit(fv.PDF_EXTENSION))


def is_image(path: Column) -> Column:
    return extension(path).isin(fv.IMAGE_EXTENSIONS)


def file_kind(path: Column) -> Column:
    """``pdf``, ``image`` or ``unsupported``, by extension."""
    return (
        F.when(extension(path) == fv.PDF_EXTENSION, "pdf")
        .when(is_image(path), "image")
        .otherwise("unsupported")
    )


def file_info(df: DataFrame, path: str = "path", length: str = "length", *keep: str) -> DataFrame:
    p = F.col(path)
    return df.select(
        *keep, p.alias("path"), file_name(p).alias("filename"), F.col(length).alias("size_bytes"),
        F.bround(F.col(length) / (1024 * 1024), 2).alias("size_mb"), extension(p).alias("extension"),
        is_pdf(p).alias("is_pdf"), is_image(p).alias("is_image"))


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """Inventory of a folder tree, from directory listings; the content column is pruned."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return file_info(files, "path", "length", "modificationTime").withColumn(
        "kind", file_kind(F.col("path")))


def result_name(path: Column, doc_type: Column, stamp: Column) -> Column:
    """``{stem}_{doc_type}_{stamp}.json``; the time stamp is that of the job."""
    return F.concat(F.concat_ws("_", stem(path), doc_type, stamp), F.lit(".json"))
