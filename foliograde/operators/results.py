"""Published results: the whole chain from extracted records, and error rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliograde import fixed_values as fv
from foliograde.functions import text as tx
from foliograde.functions.confidence import Weights
from foliograde.operators import fields as fl
from foliograde.operators import pages, responses, routing, scoring, validation
from foliograde.schemas import DISTRIBUTION, FIELD, METADATA, RECORD_TYPES, VALIDATION


def judge_records(df: DataFrame, weights: Weights = Weights(),
                  rules: dict[str, list[validation.Rule]] = validation.RULES,
                  record_types: dict[str, T.StructType] = RECORD_TYPES,
                  freeform: bool = True) -> DataFrame:
    """Validate, flatten and score extracted records, all within the row."""
    df = validation.validate(df, rules, record_types, freeform)
    df = fl.flatten_records(df, record_types, freeform)
    return scoring.score(df, weights)


def route_documents(df: DataFrame, doc_id: str,
                    routing_responses: DataFrame | None = None) -> DataFrame:
    """Add ``error``, ``doc_type`` and the routing columns; a document without text is ``unknown``."""
    df = df.withColumn("error", F.when(~tx.has_text(F.col("text")), fv.NO_TEXT_ERROR))
    df = routing.route(df, routing_responses, doc_id=doc_id)
    return df.withColumn(
        "doc_type", F.when(F.col("error").isNull(), F.col("doc_type")).otherwise(fv.UNKNOWN))


def process_documents(df: DataFrame, *ids: str, routing_responses: DataFrame | None = None,
                      weights: Weights = Weights(),
                      rules: dict[str, list[validation.Rule]] = validation.RULES,
                      record_types: dict[str, T.StructType] = RECORD_TYPES) -> DataFrame:
    """Documents with replies to results: route, extract, validate, score, publish.

    Needs the id columns, ``source_file``, ``text``, ``ocr_quality``, ``response`` and
    ``fallback_response``.  Without ``routing_responses`` there is no join and no shuffle.
    """
    df = route_documents(df, ids[0], routing_responses)
    df = responses.extract(df, record_types=record_types)
    return publish(judge_records(df, weights, rules, record_types), *ids, record_types=record_types)


def process_pages(documents: DataFrame, layer: DataFrame, ocr_pages: DataFrame, tokens: DataFrame,
                  doc_id: str = "doc_id", **options) -> DataFrame:
    """From pages to results: choose each document's text, then ``process_documents``.

    ``documents`` has the id, ``source_file``, ``response`` and ``fallback_response``; ``options``
    go to ``process_documents``.  A document without pages has no text and gets an error result.
    """
    texts = pages.document_texts(documents, layer, ocr_pages, tokens, doc_id)
    return process_documents(documents.join(texts, doc_id), doc_id, **options)


def publish(df: DataFrame, *ids: str,
            record_types: dict[str, T.StructType] = RECORD_TYPES) -> DataFrame:
    """Judged records as result rows; rows with an ``error`` become error results."""
    if "record_error" in df.columns:
        df = df.withColumn("error", F.coalesce("error", "record_error"))
    ok = F.col("error").isNull()
    no_names = F.array().cast("array<string>")
    quality = F.coalesce("ocr_quality", F.lit(fv.DEFAULT_OCR_QUALITY))
    checked = F.struct("passed_rules", "failed_rules", F.col("rule_notes").alias("notes"))
    broken = F.struct(
        no_names.alias("passed_rules"),
        F.array(F.lit(fv.PROCESSING_ERROR_RULE)).alias("failed_rules"),
        F.concat(F.lit(fv.PROCESSING_FAILED_NOTE), F.col("error")).alias("notes"))
    metadata = F.struct(
        F.col("source_file"),
        F.when(ok, quality).alias("ocr_quality"),
        F.when(ok, F.col("extraction_method")).alias("extraction_method"),
        F.when(ok, F.col("routing_confidence")).alias("routing_confidence"),
        F.when(ok, F.size("scored")).otherwise(0).cast("long").alias("field_count"),
        F.when(ok, scoring.distribution(F.col("confidences"), F.col("avg_field_confidence")))
        .cast(DISTRIBUTION).alias("confidence_distribution"),
        F.when(ok, F.col("scoring_metadata")).alias("scoring_metadata"),
        F.col("error"))
    return df.select(
        *ids,
        F.when(ok, F.col("doc_type")).otherwise(fv.UNKNOWN).alias("doc_type"),
        F.when(ok, fl.published_fields(F.col("scored")))
        .otherwise(F.array().cast(T.ArrayType(FIELD))).alias("fields"),
        *[F.when(ok, F.col(name)).alias(name) for name in record_types],
        F.when(ok, F.col("freeform")).alias("freeform"),
        F.when(ok, F.col("overall_confidence")).otherwise(0.0).alias("overall_confidence"),
        F.when(ok, checked).otherwise(broken).cast(VALIDATION).alias("validation"),
        metadata.cast(METADATA).alias("processing_metadata"))
