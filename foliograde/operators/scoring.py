"""Confidence scoring of fields and documents, all within the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliograde import fixed_values as fv
from foliograde.functions import confidence as cf
from foliograde.functions.confidence import Weights
from foliograde.functions.once import with_once
from foliograde.schemas import LEAF, SCORING_METADATA


def rule_text(rules: Column) -> Column:
    """Rule names as one lower-cased text, in which a key can be looked up in one go.

    The separator does not occur in rule names, so a key is found within a single name.
    """
    return F.lower(F.array_join(rules, "\n\0\n"))


def rule_status(key: Column, passed: Column, failed: Column) -> Column:
    """What the rules say about a field: false, true or null.

    A rule speaks about a field if its name contains the field's key; a failed rule wins.  The
    empty key is in every name, and in none if there are no rules.
    ``passed`` and ``failed`` are ``rule_text`` columns.
    """
    name = F.lower(key)
    return F.when((failed != "") & F.contains(failed, name), False).when((passed != "") & F.contains(passed, name), True)


def score_leaves(leaves: Column, passed: Column, failed: Column, ocr_quality: Column,
                 weights: Weights = Weights()) -> Column:
    """Leaves with their ``confidence``; ``ocr_quality`` is its share of it, weighted already."""
    w_val = weights.normalised()[2]

    def checked(name: Column) -> Column:
        # what the rules say is asked and weighed in one go, as a lambda works out an expression anew wherever it stands
        return (
            F.when((failed != "") & F.contains(failed, name), w_val * fv.RULE_FAILED_SCORE)
            .when((passed != "") & F.contains(passed, name), w_val * fv.RULE_PASSED_SCORE)
            .otherwise(w_val * fv.RULE_ABSENT_SCORE))

    return F.transform(leaves, lambda f: F.struct(
        f["path"].alias("path"), f["key"].alias("key"), f["value"].alias("value"),
        cf.weighted(
            F.coalesce(f["llm_conf"], cf.estimate(f["value"], f["falsy"])),
            ocr_quality,
            checked(F.lower(f["key"])),
            weights,
        ).alias("confidence"),
    ))


def critical_failures(failed: Column) -> Column:
    """Number of failed rules whose name says that something essential is wrong."""
    return F.size(F.filter(failed, lambda r: r.rlike("|".join(fv.CRITICAL_RULE_WORDS))))


def adjusted(base: Column, failed: Column, method: Column) -> Column:
    """Document confidence: the field mean, lowered for critical failures, then by method."""
    penalty = F.least(F.lit(fv.CRITICAL_PENALTY_CAP), critical_failures(failed) * fv.CRITICAL_PENALTY)
    lowered = base * (F.lit(1.0) - penalty)
    by_method = (
        F.when(F.contains(method, F.lit("fallback")), lowered * fv.FALLBACK_FACTOR)
        .when(F.contains(method, F.lit("structured")), F.least(F.lit(1.0), lowered * fv.TYPED_FACTOR))
        .otherwise(lowered)
    )
    return cf.unit_range(by_method)


def distribution(values: Column, centre: Column) -> Column:
    """Counts by band, smallest, largest and population deviation; null if there are no values.

    ``centre`` is the mean of the values, as a column of its own.
    """
    def count(low: float | None, high: float | None) -> Column:
        def inside(c: Column) -> Column:
            above = F.lit(True) if low is None else c >= low
            return above if high is None else above & (c < high)
        return F.size(F.filter(values, inside)).cast("long")

    spread = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + (x - centre) * (x - centre))
    return F.when(F.size(values) > 0, F.struct(
        count(fv.HIGH_CONFIDENCE, None).alias("high"),
        count(fv.MEDIUM_CONFIDENCE, fv.HIGH_CONFIDENCE).alias("medium"),
        count(None, fv.MEDIUM_CONFIDENCE).alias("low"),
        F.array_min(values).alias("min_confidence"),
        F.array_max(values).alias("max_confidence"),
        F.when(F.size(values) < 2, 0.0).otherwise(F.sqrt(spread / F.size(values))).alias("std_deviation"),
    ))


def scoring_metadata(ocr_quality: Column, method: Column, valid: Column, error: Column, weights: Weights) -> Column:
    """Quality (its default if null), method, whether all rules passed, and the weights, scaled to add up to 1; or the
    error alone."""
    used = F.struct(*[F.lit(w).alias(f"{name}_weight") for name, w in zip(("llm", "ocr", "validation"), weights.normalised())])
    fine = error.isNull()
    return F.struct(
        F.when(fine, F.coalesce(ocr_quality, F.lit(fv.DEFAULT_OCR_QUALITY))).alias("ocr_quality"),
        F.when(fine, method).alias("extraction_method"), F.when(fine, valid).alias("validation_passed"),
        F.when(fine, used).alias("weights_used"), error.alias("error")).cast(SCORING_METADATA)


def score(df: DataFrame, weights: Weights = Weights()) -> DataFrame:
    """Add ``scored`` (leaves with confidence), ``confidences``, ``avg_field_confidence``, ``overall_confidence`` and
    ``scoring_metadata``.

    Needs ``leaves``, ``passed_rules``, ``failed_rules``, ``ocr_quality`` and ``extraction_method``, and takes
    ``overall_valid`` if it is there.  A field whose confidence cannot be worked out gets 0.5.  A document whose leaves
    are unknown (null) is not scored: it has no fields, 0.5 for both confidences, without adjustment, and an error.
    """
    df = with_once(df, {"_quality": F.lit(weights.normalised()[1]) * F.coalesce("ocr_quality", F.lit(fv.DEFAULT_OCR_QUALITY)),
                        "_passed": rule_text(F.col("passed_rules")),
                        "_failed": rule_text(F.col("failed_rules")),
                        "_unscored": F.when(F.col("leaves").isNull(), fv.UNSCORED_ERROR)})
    known = F.coalesce("leaves", F.array().cast(T.ArrayType(LEAF)))
    df = with_once(df, {"scored": score_leaves(
        known, F.col("_passed"), F.col("_failed"), F.col("_quality"), weights,
    )}).drop("_passed", "_failed", "_quality")
    total = F.aggregate("scored", F.lit(0.0), lambda acc, f: acc + f["confidence"])
    df = with_once(df, {
        "confidences": F.transform("scored", lambda f: f["confidence"]),
        "avg_field_confidence": F.when(F.size("scored") > 0, total / F.size("scored")).otherwise(
            fv.DEFAULT_FIELD_CONFIDENCE)})
    overall = adjusted(F.col("avg_field_confidence"), F.col("failed_rules"), F.col("extraction_method"))
    valid = F.col("overall_valid") if "overall_valid" in df.columns else F.size("failed_rules") == 0
    return with_once(df, {
        "overall_confidence": F.when(F.col("_unscored").isNotNull(), fv.DEFAULT_FIELD_CONFIDENCE).otherwise(overall),
        "scoring_metadata": scoring_metadata(F.col("ocr_quality"), F.col("extraction_method"), valid, F.col("_unscored"), weights),
    }).drop("_unscored")
