"""Column functions that put a number between 0 and 1 on a value."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliograde import fixed_values as fv
from foliograde.functions import text as tx


def evidence(value: Column, lower_text: Column) -> Column:
    """How well a value is supported by the (lower-cased) document text.

    The whole value found: 0.9.  Otherwise the share of its words that are found,
    times 0.7; 0.3 if none is.  No value or no text: 0.
    """
    return evidence_of_lower(F.lower(value), lower_text)


def evidence_of_lower(low: Column, lower_text: Column) -> Column:
    """``evidence`` of a value that is lower-cased already.

    The usual case comes first, and lists of one bind what is needed more than once: inside a lambda every mention of an
    expression is worked out anew.
    """
    def share(c: Column) -> Column:
        return F.when(c["hits"] > 0, F.lit(0.7) * (c["hits"] / c["all"])).otherwise(0.3)

    counts = F.transform(F.array(tx.words(low)), lambda parts: F.struct(
        F.size(F.filter(parts, lambda w: F.contains(lower_text, w))).alias("hits"), F.size(parts).alias("all")))
    usable = (low != "") & (lower_text != "")
    return (
        F.when((low != "") & F.contains(lower_text, low), 0.9)
        .when(~F.coalesce(usable, F.lit(False)), 0.0)
        .when(~low.rlike(fv.WHITESPACE), 0.3)  # a single word, and it was not found
        .otherwise(F.get(F.transform(counts, share), F.lit(0)))
    )


def estimate(value: Column, falsy: Column | None = None) -> Column:
    """Confidence guessed from the looks of a value, where the extractor gave none."""
    bare = F.regexp_replace(value, rf"^{fv.WHITESPACE}+|{fv.WHITESPACE}+$", "")
    digit = r"[\p{Nd}²³¹]"
    shape = (
        F.when(F.regexp_replace(bare, "[.,]", "").rlike(rf"^{digit}+\z"), 0.9)
        .when(bare.rlike(digit) & bare.rlike("[/ -]"), 0.8)
        .when(F.replace(bare, F.lit(" "), F.lit("")).rlike(r"^\p{L}+\z") & (F.length(bare) > 3), 0.7)
        .otherwise(0.5)
    )
    looks = F.least(F.lit(1.0), (F.least(F.lit(1.0), F.length(bare) / 20.0) + shape) / 2.0)
    nothing = value.isNull() | (F.length(value) == 0)
    if falsy is not None:
        nothing = nothing | F.coalesce(falsy, F.lit(False))
    return F.when(nothing, 0.0).otherwise(looks)


@dataclass(frozen=True)
class Weights:
    """Shares of the three parts of a field's confidence; they are scaled to add up to 1."""

    llm: float = fv.LLM_WEIGHT
    ocr: float = fv.OCR_WEIGHT
    validation: float = fv.VALIDATION_WEIGHT

    def normalised(self) -> tuple[float, float, float]:
        total = self.llm + self.ocr + self.validation
        return self.llm / total, self.ocr / total, self.validation / total


def unit_range(number: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), number))


def field_confidence(llm_conf: Column, ocr_quality: Column, rule_status: Column,
                     weights: Weights = Weights(), text_match: Column | None = None) -> Column:
    """Weighted sum of extractor confidence, OCR quality and the rules that mention the field.

    ``rule_status`` is true, false or null (no rule mentions the field).
    """
    w_llm, w_ocr, w_val = weights.normalised()
    if text_match is not None:
        matched = F.least(F.lit(1.0), llm_conf * (F.lit(0.5) + F.lit(0.5) * text_match))
        llm_conf = F.when(text_match.isNotNull(), matched).otherwise(llm_conf)
    quality = F.lit(w_ocr) * F.coalesce(ocr_quality, F.lit(fv.DEFAULT_OCR_QUALITY))
    checked = (
        F.when(rule_status, w_val * fv.RULE_PASSED_SCORE)
        .when(~rule_status, w_val * fv.RULE_FAILED_SCORE)
        .otherwise(w_val * fv.RULE_ABSENT_SCORE)
    )
    return weighted(llm_conf, quality, checked, weights)


def weighted(llm_conf: Column, quality: Column, checked: Column, weights: Weights) -> Column:
    """A field's confidence from the extractor's, and from the shares of OCR quality and rules, weighted already."""
    total = F.lit(weights.normalised()[0]) * llm_conf + quality + checked
    return F.coalesce(unit_range(total), F.lit(fv.DEFAULT_FIELD_CONFIDENCE))


def band(confidence: Column) -> Column:
    return (
        F.when(confidence >= fv.HIGH_CONFIDENCE, "high")
        .when(confidence >= fv.MEDIUM_CONFIDENCE, "medium")
        .otherwise("low")
    )
