"""Rule validation.

A rule looks at one record and gives an ``Outcome``.  All rules of a document are
evaluated in one projection as an array ``rules`` of
``struct<name, outcome, warnings>``, where outcome is ``passed``, ``failed`` or
``error``; nothing is shuffled.  Rule lists are plain Python lists, so a user adds a
rule by passing another mapping.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliograde import fixed_values as fv
from foliograde.functions import text as tx
from foliograde.functions.once import with_once
from foliograde.functions.record import FreeRecord, TypedRecord
from foliograde.schemas import RECORD_TYPES

Record = TypedRecord | FreeRecord


@dataclass(frozen=True)
class Outcome:
    passed: Column
    warnings: Column | None = None
    error: Column | None = None


@dataclass(frozen=True)
class Rule:
    """A named check.  ``guarded``: whatever goes wrong in evaluating it is an error of the rule, not of the job; a check
    that cannot raise, and gives null for "not passed" only, may go without."""

    name: str
    check: Callable[[Record], Outcome]
    guarded: bool = True


# --- rule kinds -------------------------------------------------------------------


def present(field: str) -> Callable[[Record], Outcome]:
    return lambda record: Outcome(~record.cell(field).blank)


def amount(field: str) -> Callable[[Record], Outcome]:
    """A number that is not negative."""
    def check(record: Record) -> Outcome:
        cell = record.cell(field)
        return Outcome(~cell.missing & (cell.number >= 0))
    return check


def date(field: str) -> Callable[[Record], Outcome]:
    def check(record: Record) -> Outcome:
        cell = record.cell(field)
        fits = tx.looks_like_date(cell.text)
        odd = F.when(~cell.blank & ~fits, F.concat(F.lit("Unusual date format: "), cell.text))
        return Outcome(~cell.blank & fits, F.array_compact(F.array(odd)))
    return check


def totals_match(record: Record) -> Outcome:
    """Line items (plus tax) add up to the total; a wrong subtotal is only a warning."""
    items = record.elements("line_items")
    item_sum = F.aggregate(
        items, F.lit(0.0),
        lambda acc, i: acc + F.coalesce(record.element("line_items", i).cell("total_price").number,
                                        F.lit(0.0)),
    )
    subtotal, tax, total = (record.cell(n) for n in ("subtotal", "tax_amount", "total_amount"))
    has_items = F.size(items) > 0
    wrong_total = total.number.isNull() | _differs(
        item_sum + F.coalesce(tax.number, F.lit(0.0)), total.number)
    warning = (
        F.when(~has_items | subtotal.missing, F.lit(None).cast("string"))
        .when(subtotal.number.isNull(), "Subtotal is not a valid number")
        .when(_differs(item_sum, subtotal.number), F.concat(
            F.lit("Line items total ("), tx.money(item_sum),
            F.lit(") doesn't match subtotal ("), tx.money(subtotal.number), F.lit(")")))
    )
    return Outcome(has_items & (total.missing | ~wrong_total),
                   F.array_compact(F.array(warning)))


def balance_matches(record: Record) -> Outcome:
    """Total minus amount paid equals the balance, if a balance is given."""
    total, paid, balance = (record.cell(n) for n in ("total_amount", "amount_paid", "balance_due"))
    readable = (total.number.isNotNull()
                & (paid.missing | paid.number.isNotNull())
                & (balance.missing | balance.number.isNotNull()))
    left = total.number - F.coalesce(paid.number, F.lit(0.0))
    return Outcome(readable & (balance.missing | ~_differs(left, balance.number)))


def medicines_named(record: Record) -> Outcome:
    return Outcome(F.exists(record.elements("medicines"),
                            lambda m: record.element("medicines", m).cell("name").truthy))


def dosages_usual(record: Record) -> Outcome:
    """Never fails; warns about each dosage without a usual unit.

    A dosage that is not text cannot be checked, which is an error of the rule.
    """
    items = record.elements("medicines")

    def dosage(m: Column):
        return record.element("medicines", m).cell("dosage")

    unreadable = F.exists(items, lambda m: dosage(m).truthy & ~dosage(m).is_text)
    warnings = F.transform(items, lambda m, i: F.when(
        dosage(m).truthy & ~dosage(m).text.rlike(fv.DOSAGE_PATTERN),
        F.concat(F.lit("Medicine "), (i + 1).cast("string"),
                 F.lit(" has unusual dosage format: "), dosage(m).text)))
    return Outcome(F.lit(True), F.array_compact(warnings), unreadable)


def _differs(a: Column, b: Column) -> Column:
    gap = F.abs(a - b)
    return (gap > fv.MONEY_TOLERANCE) & ~F.isnan(gap)


# --- rule lists ---------------------------------------------------------------------

RULES: dict[str, list[Rule]] = {
    fv.INVOICE: [
        Rule("invoice_number_present", present("invoice_number"), guarded=False),
        Rule("total_amount_valid", amount("total_amount"), guarded=False),
        Rule("line_items_total_match", totals_match, guarded=False),
        Rule("vendor_name_present", present("vendor_name"), guarded=False),
        Rule("date_format_valid", date("date"), guarded=False),
    ],
    fv.MEDICAL_BILL: [
        Rule("patient_name_present", present("patient_name"), guarded=False),
        Rule("hospital_name_present", present("hospital_name"), guarded=False),
        Rule("total_amount_valid", amount("total_amount"), guarded=False),
        Rule("bill_date_valid", date("bill_date"), guarded=False),
        Rule("balance_calculation_valid", balance_matches, guarded=False),
    ],
    fv.PRESCRIPTION: [
        Rule("patient_name_present", present("patient_name"), guarded=False),
        Rule("doctor_name_present", present("doctor_name"), guarded=False),
        Rule("medicines_present", medicines_named, guarded=False),
        Rule("prescription_date_valid", date("prescription_date"), guarded=False),
        Rule("medicine_dosages_valid", dosages_usual, guarded=False),
    ],
}

_NO_WARNINGS = "array<string>"
_RULE_ROW = "struct<name:string,outcome:string,warnings:array<string>>"
_RULE_ROWS = f"array<{_RULE_ROW}>"


def _rule_row(name: Column, outcome: Column, warnings: Column | None) -> Column:
    kept = F.array().cast(_NO_WARNINGS) if warnings is None else warnings
    return F.struct(name.alias("name"), outcome.alias("outcome"), kept.alias("warnings"))


def tried(text: Column) -> Column:
    """The value of a text expression; null if anything in it raises, as division by zero and failed casts do.

    A ``try_`` function turns whatever its argument raises into null, so the text takes the way through one.
    """
    return F.try_to_binary(text, F.lit("utf-8")).cast("string")


def rule_outcomes(record: Record, rules: list[Rule]) -> Column:
    """Outcomes of the rules, in list order.

    A rule passes, fails or errs.  It errs if it says so, and, if it is guarded, also if its outcome is null or if its
    evaluation raises; then it has no warnings.  Unguarded rules fail where their outcome is null.
    """
    rows = []
    for rule in rules:
        name, result = F.lit(rule.name), rule.check(record)
        passed = result.passed if rule.guarded else F.coalesce(result.passed, F.lit(False))
        outcome = F.when(passed, "passed").when(~passed, "failed").otherwise("error")
        if result.error is not None:
            outcome = F.when(F.coalesce(result.error, F.lit(False)), "error").otherwise(outcome)
        if rule.guarded:
            broken = _rule_row(name, F.lit("error"), None).cast(_RULE_ROW)
            whole = tried(F.to_json(_rule_row(name, outcome, result.warnings)))
            read = F.from_json(whole, _RULE_ROW)
            rows.append(F.coalesce(F.get(F.filter(F.array(read), lambda row: row["outcome"] != "error"), F.lit(0)), broken))
            continue
        warnings = result.warnings
        if result.error is not None:
            warnings = F.when(outcome == "error", F.array().cast(_NO_WARNINGS)).otherwise(warnings)
        rows.append(_rule_row(name, outcome, warnings))
    return F.array(*rows)


def common_outcomes(record: Record) -> Column:
    """E-mail and phone fields, where the record has them.  An odd phone is only a warning."""
    rows = []
    for field in fv.EMAIL_FIELDS:
        cell = record.cell(field)
        good = tx.is_email(cell.text)
        rows.append(F.when(cell.truthy, _rule_row(
            F.when(good, f"{field}_format_valid").otherwise(f"{field}_format_invalid"),
            F.when(good, "passed").otherwise("failed"), None)))
    for field in fv.PHONE_FIELDS:
        cell = record.cell(field)
        good = tx.is_phone(cell.text)
        odd = F.array(F.concat(F.lit("Unusual phone number format: "), cell.text))
        rows.append(F.when(cell.truthy, _rule_row(
            F.lit(f"{field}_format_valid"),
            F.when(good, "passed").otherwise("warning"),
            F.when(good, F.array().cast(_NO_WARNINGS)).otherwise(odd))))
    return F.array_compact(F.array(*rows)).cast(_RULE_ROWS)


def free_record(freeform: Column) -> Column:
    """The VARIANT that rules see for a record without a type: ``{}`` if there is none."""
    return F.try_parse_json(F.coalesce(freeform, F.lit("{}")))


def validate(df: DataFrame, rules: dict[str, list[Rule]] = RULES,
             record_types: dict[str, T.StructType] = RECORD_TYPES, freeform: bool = True) -> DataFrame:
    """Add the outcome of all rules to a table of extracted records.

    New columns: ``rules`` (one entry per rule), ``passed_rules``, ``failed_rules``,
    ``rule_warnings``, ``rule_notes`` (one sentence) and ``overall_valid``.

    Needs ``doc_type``, ``extraction_method``, ``freeform`` and one struct column per
    record type.  A document without a typed record is checked as the free-form one, or as
    an empty one.  ``freeform=False`` is for tables in which every record is typed.
    """
    typed = F.col("extraction_method") == fv.METHOD_TYPED
    none = F.array().cast(_RULE_ROWS)
    own = F.when(F.lit(False), none)
    for name, schema in record_types.items():
        own = own.when(typed & (F.col("doc_type") == name),
                       rule_outcomes(TypedRecord(F.col(name), schema), rules[name]))
    if freeform:
        df = with_once(df, {"_free": free_record(F.col("freeform"))})
        free = FreeRecord(F.col("_free"))
        unreadable = F.array(_rule_row(
            F.lit(fv.SYSTEM_ERROR_RULE), F.lit("failed"),
            F.array(F.lit("Validation system error: unreadable record")))).cast(_RULE_ROWS)
        loose = F.when(F.col("_free").isNull(), unreadable)
        for name in record_types:
            loose = loose.when(F.col("doc_type") == name, rule_outcomes(free, rules[name]))
        common = F.when(F.col("_free").isNull(), none).otherwise(common_outcomes(free))
        outcome = own.otherwise(F.concat(loose.otherwise(none), common))
    else:
        outcome = own.otherwise(none)
    df = with_once(df, {"rules": outcome}).drop("_free")
    rules_col = F.col("rules")
    df = with_once(df, {
        "passed_rules": F.transform(
            F.filter(rules_col, lambda r: r.outcome == "passed"), lambda r: r["name"]),
        "failed_rules": F.transform(
            F.filter(rules_col, lambda r: r.outcome.isin("failed", "error")),
            lambda r: F.when(r.outcome == "error", F.concat(r["name"], F.lit(" (error)")))
            .otherwise(r["name"])),
        "rule_warnings": F.flatten(F.transform(rules_col, lambda r: r.warnings)),
    })
    summary = note(F.size("passed_rules"), F.size("failed_rules"), F.size("rule_warnings"))
    broken = F.array_contains("failed_rules", fv.SYSTEM_ERROR_RULE)
    return df.withColumns({
        "rule_notes": F.when(broken, fv.SYSTEM_ERROR_NOTE).otherwise(summary),
        "overall_valid": F.size("failed_rules") == 0})


def note(passed: Column, failed: Column, warnings: Column) -> Column:
    """One sentence: the counts and a verdict."""
    return F.concat(
        passed.cast("string"), F.lit(" validation rules passed"),
        F.when(failed > 0, F.concat(F.lit(", "), failed.cast("string"), F.lit(" failed"))).otherwise(""),
        F.when(warnings > 0, F.concat(F.lit(", "), warnings.cast("string"), F.lit(" warnings"))).otherwise(""),
        F.when(failed > 0, " - Document has validation issues")
        .when(warnings > 0, " - Document valid with minor warnings")
        .otherwise(" - Document appears valid"),
    )


def rule_rows(df: DataFrame, *ids: str) -> DataFrame:
    """Long form: one row per document and rule."""
    return (
        df.select(*ids, F.posexplode("rules").alias("pos", "rule"))
        .select(*ids, F.col("pos").cast("long").alias("pos"), F.col("rule.name").alias("rule"),
                F.col("rule.outcome").alias("outcome"),
                F.size("rule.warnings").cast("long").alias("warnings"))
    )


#: What each field of a published result must have.
FIELD_KEYS = ("name", "value", "confidence")


def structural_issues(record: Column) -> Column:
    """What is wrong with the shape of a published result, given as JSON text; empty if nothing.

    The record is parsed once: a lambda's argument is, an expression is worked out wherever it stands.
    """
    return F.get(F.transform(F.array(F.try_parse_json(record)), _issues_of), F.lit(0))


def _issues_of(data: Column) -> Column:
    confidence = FreeRecord(data).cell("overall_confidence").number
    has = {k: F.try_variant_get(data, f"$.{k}", "variant").isNotNull()
           for k in ("doc_type", "fields", "overall_confidence")}
    # a key that is absent is null, one that is null a null VARIANT; what is no object is null as a whole
    listed = f"array<struct<{', '.join(f'{key}: variant' for key in FIELD_KEYS)}>>"
    missing = [F.when(~there, f"Missing required key: {key}") for key, there in has.items()]
    out_of_range = F.when(has["overall_confidence"]
                          & ~F.coalesce((confidence >= 0) & (confidence <= 1), F.lit(False)),
                          "Overall confidence not between 0 and 1")
    fields = F.coalesce(F.try_variant_get(data, "$.fields", listed), F.array().cast(listed))

    def whole(field: Column) -> Column:
        return reduce(lambda a, b: a & b, [field[key].isNotNull() for key in FIELD_KEYS])

    def field_issues(field: Column, i: Column) -> Column:
        prefix = F.concat(F.lit("Field "), i.cast("string"))
        lacking = F.array(*[
            F.when(field[key].isNull(), F.concat(prefix, F.lit(f" missing key: {key}"))) for key in FIELD_KEYS])
        return F.when(field.isNotNull(), lacking).otherwise(
            F.array(F.concat(prefix, F.lit(" is not a dictionary"))))

    odd = F.array_compact(F.transform(fields, lambda field, i: F.when(~whole(field), field_issues(field, i))))
    return F.array_compact(F.concat(F.array(*missing, out_of_range), F.flatten(odd)))
