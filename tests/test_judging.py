"""Rules, fields and scores of single records, typed and free-form."""

import json

import pytest
from pyspark.sql import functions as F

from foliograde.functions.confidence import Weights
from foliograde.operators import fields, responses, results, scoring, validation

SCHEMA = ("doc_id string, source_file string, text string, ocr_quality double, response string, "
          "fallback_response string")
INVOICE_TEXT = "Invoice A1 vendor Acme customer Bo total 10.5 tax"


def process(spark, *cases):
    """Process all cases (text, reply, second reply) in one query; rows in the order given."""
    rows = [(str(i), f"/in/{i}.pdf", *(list(c) + [None] * (3 - len(c)))) for i, c in enumerate(cases)]
    df = spark.createDataFrame([(*r[:3], 1.0, *r[3:]) for r in rows], SCHEMA)
    return sorted(results.process_documents(df, "doc_id").collect(), key=lambda r: int(r.doc_id))


def invoice(**changes):
    record = {"invoice_number": "A1", "date": "2024-01-15", "vendor_name": "Acme", "total_amount": 10.5,
              "line_items": [{"description": "pen", "total_price": 10.5, "confidence": 0.9}]}
    record.update(changes)
    return json.dumps({k: v for k, v in record.items() if v != "absent"})


def test_documents_without_records(spark):
    blank, unknown, *empty = process(spark, ("  ",), ("nothing to see",), ("invoice",), ("hospital",), ("rx",))
    assert blank.doc_type == "unknown" and blank.overall_confidence == 0.0 and blank.fields == []
    assert blank.validation.failed_rules == ["processing_error"]
    assert blank.validation.notes == "Processing failed: No text could be extracted from the document"
    assert blank.processing_metadata.field_count == 0
    assert (unknown.doc_type, unknown.overall_confidence) == ("unknown", 0.5)
    assert unknown.validation.notes == "0 validation rules passed - Document appears valid"
    assert [r.overall_confidence for r in empty] == pytest.approx([0.35] * 3)


def test_typed_invoice(spark):
    (row,) = process(spark, (INVOICE_TEXT, invoice()))
    assert row.processing_metadata.extraction_method == "llm_structured"
    assert row.validation.failed_rules == [] and len(row.validation.passed_rules) == 5
    names = [f.name for f in row.fields]
    assert names == ["invoice_number", "date", "vendor_name", "line_items[0].description",
                     "line_items[0].total_price", "line_items[0].confidence", "total_amount", "currency"]
    by_name = {f.name: f for f in row.fields}
    assert by_name["vendor_name"].confidence == pytest.approx(0.94)      # found, rule passed
    assert by_name["date"].confidence == pytest.approx(0.6 * 0.3 + 0.4)  # not found, rule passed
    assert by_name["line_items[0].confidence"].value == "0.9"
    assert by_name["currency"].confidence == pytest.approx(0.6 * 0.3 + 0.2 + 0.14)
    assert by_name["vendor_name"].source.page == 1


INVOICE_CASES = [
    ({"invoice_number": "  "}, ["invoice_number_present"]),
    ({"total_amount": None}, ["total_amount_valid"]),
    ({"total_amount": -1.0}, ["total_amount_valid", "line_items_total_match"]),
    ({"line_items": []}, ["line_items_total_match"]),
    ({"total_amount": 10.505}, []),
    ({"total_amount": 11.5, "tax_amount": 1.0}, []),
    ({"date": "soon"}, ["date_format_valid"]),
    ({"vendor_name": "absent"}, ["vendor_name_present"]),
]


def test_invoice_rules_typed_and_free(spark):
    records = [invoice(**changes) for changes, _ in INVOICE_CASES]
    expected = [failed for _, failed in INVOICE_CASES]
    rows = process(spark, *[(INVOICE_TEXT, r) for r in records],
                   *[(INVOICE_TEXT, "no", f"Here: {r}!") for r in records])
    typed, free = rows[:len(records)], rows[len(records):]
    assert {r.processing_metadata.extraction_method for r in typed} == {"llm_structured"}
    assert {r.processing_metadata.extraction_method for r in free} == {"fallback_json"}
    assert [r.validation.failed_rules for r in typed] == expected
    assert [r.validation.failed_rules for r in free] == expected


def check(spark, *cases):
    """Validate free-form records (type, record) in one query; rows in the order given."""
    rows = [(i, t, "fallback_json", r if isinstance(r, str) else json.dumps(r)) for i, (t, r) in enumerate(cases)]
    df = spark.createDataFrame(rows, "i long, doc_type string, extraction_method string, freeform string")
    for name, schema in results.RECORD_TYPES.items():
        df = df.withColumn(name, F.lit(None).cast(schema))
    return sorted(validation.validate(df).collect(), key=lambda r: r.i)


BILL = {"patient_name": "A", "hospital_name": "B", "bill_date": "1/2/24", "total_amount": 10,
        "amount_paid": 4, "balance_due": 6}
RX = {"patient_name": "A", "doctor_name": "B", "prescription_date": "5 May 2024",
      "medicines": [{"name": "m", "dosage": "5 MG"}, {"name": "n", "dosage": "drops"}]}
ODD_ITEMS = [{"description": "pen", "total_price": "10.5"}, {"total_price": "x"}, {"other": 1}, 5, True]
FREE_CASES = [
    # type, record, failed rules, warnings
    ("invoice", invoice(subtotal=9.0, date="n/a"), ["date_format_valid"],
     ["Line items total (10.50) doesn't match subtotal (9.00)", "Unusual date format: n/a"]),
    ("invoice", invoice(subtotal="nine"), [], ["Subtotal is not a valid number"]),
    ("invoice", invoice(invoice_number=12, total_amount="10.5", line_items=ODD_ITEMS), [], []),
    ("invoice", invoice(total_amount="1,500"), ["total_amount_valid", "line_items_total_match"], []),
    ("invoice", invoice(date=20240115), ["date_format_valid"], ["Unusual date format: 20240115"]),
    ("medical_bill", BILL, [], []),
    ("medical_bill", {**BILL, "balance_due": 7}, ["balance_calculation_valid"], []),
    ("medical_bill", {**BILL, "amount_paid": "x"}, ["balance_calculation_valid"], []),
    ("medical_bill", {**BILL, "balance_due": None}, [], []),
    ("prescription", RX, [], ["Medicine 2 has unusual dosage format: drops"]),
    ("prescription", {**RX, "medicines": [{"name": "m", "dosage": 5}]}, ["medicine_dosages_valid (error)"], []),
    ("prescription", {**RX, "medicines": [{"name": ""}]}, ["medicines_present"], []),
    ("other", {"email": "a@b.co", "vendor_email": "x", "contact_email": "", "phone": "12",
               "vendor_phone": 15551234567}, ["vendor_email_format_invalid"], ["Unusual phone number format: 12"]),
    ("invoice", "{x", ["validation_system_error"], ["Validation system error: unreadable record"]),
]


def test_free_form_rules(spark):
    rows = check(spark, *[c[:2] for c in FREE_CASES])
    for row, (_, record, failed, warnings) in zip(rows, FREE_CASES):
        assert (row.failed_rules, row.rule_warnings) == (failed, warnings), record
    assert rows[1].rule_notes == "5 validation rules passed, 1 warnings - Document valid with minor warnings"
    assert rows[12].passed_rules == ["email_format_valid", "vendor_phone_format_valid"]
    assert rows[13].rule_notes == "Validation could not be completed due to system error"


def test_freeform_leaves(value):
    record = {"b": 1500.0, "b_confidence": 0.8, "a": {"x": True, "y": [1, {"z": "q", "confidence": 0.4}, [{"w": 2}]]},
              "n": None, "s": " ", "zero": 0, "c": "t", "cConfidence": "0.25"}
    got = value(fields.freeform_leaves, "r string", json.dumps(record))
    assert [(x.path, x.value, x.llm_conf, x.falsy) for x in got] == [
        ("b", "1500.0", 0.8, False), ("a.x", "True", None, False), ("a.y[1].z", "q", 0.4, False),
        ("a.y[1].confidence", "0.4", 0.4, False), ("a.y[2][0].w", "2", None, False), ("zero", "0", None, True),
        ("c", "t", 0.25, False), ("cConfidence", "0.25", None, False)]
    assert value(fields.freeform_leaves, "r string", None) == []
    deep = "{\"a\":" * 400 + "1" + "}" * 400
    assert [x.key for x in value(fields.freeform_leaves, "r string", deep)] == ["a"]


@pytest.mark.parametrize("record, issues", [
    ({"doc_type": "i", "overall_confidence": 0.5, "fields": []}, []),
    ({"overall_confidence": 1.2, "fields": [{"name": "a", "confidence": 1}, 7]},
     ["Missing required key: doc_type", "Overall confidence not between 0 and 1", "Field 0 missing key: value",
      "Field 1 is not a dictionary"]),
    ({}, ["Missing required key: doc_type", "Missing required key: fields",
          "Missing required key: overall_confidence"]),
])
def test_structure(value, record, issues):
    assert value(validation.structural_issues, "r string", json.dumps(record)) == issues


def test_own_rule_lists(spark):
    rules = {**validation.RULES, "invoice": [validation.Rule("currency_present", validation.present("currency"))]}
    df = spark.createDataFrame([("d", "f", INVOICE_TEXT, 1.0, invoice(), None)], SCHEMA)
    row = results.process_documents(df, "doc_id", rules=rules).first()
    assert row.validation.passed_rules == ["currency_present"]


def own_rule(check, **columns):
    return validation.Rule("own", lambda record: validation.Outcome(check(record), **columns))


@pytest.mark.parametrize("check,outcome", [
    (lambda r: r.cell("total_amount").number > 0, "passed"),
    (lambda r: r.cell("total_amount").number < 0, "failed"),
    (lambda r: F.lit(1) / (r.cell("total_amount").number - 10.5) > 0, "error"),  # divides by zero
    (lambda r: r.cell("vendor_name").text.cast("int") > 0, "error"),  # no number
    (lambda r: F.element_at(r.elements("line_items"), 9)["confidence"] > 0, "error"),  # out of bounds
    (lambda r: F.exists(r.elements("line_items"), lambda x: x["description"].cast("double") > 0), "error"),  # inside a list
    (lambda r: F.raise_error(F.concat(F.lit("broken "), r.cell("vendor_name").text)).isNull(), "error"),
    (lambda r: F.lit(None).cast("boolean"), "error"),
    (lambda r: r.cell("no_such_key").number > 0, "error"),
])
@pytest.mark.parametrize("ansi", ["true", "false"])
def test_any_rule_is_isolated(spark, check, outcome, ansi):
    df = responses.extract(spark.createDataFrame([("1", "invoice", invoice(), None)], "doc_id string, doc_type string, response string, fallback_response string"))
    plain = validation.Rule("vendor_name_present", validation.present("vendor_name"))
    rules = {t: [] for t in validation.RULES} | {"invoice": [own_rule(check, warnings=F.array(F.lit("w,1"), F.lit('"2"'))), plain]}
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        row = validation.validate(df, rules, freeform=False).first()
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")
    own, other = row.rules
    assert (other.name, other.outcome) == ("vendor_name_present", "passed")
    assert own.outcome == outcome
    assert own.warnings == ([] if outcome == "error" else ["w,1", '"2"'])
    assert row.failed_rules == {"passed": [], "failed": ["own"], "error": ["own (error)"]}[outcome]
    assert row.overall_valid == (outcome == "passed")


def test_warnings_that_raise_are_an_error(spark):
    df = responses.extract(spark.createDataFrame([("1", "invoice", invoice(), None)], "doc_id string, doc_type string, response string, fallback_response string"))
    share = F.lit(1) / (F.col("invoice.total_amount") - 10.5)
    rule = validation.Rule("own", lambda record: validation.Outcome(F.lit(True), F.array(share.cast("string"), share.cast("string"))))
    assert validation.validate(df, {t: [rule] for t in validation.RULES}).first().failed_rules == ["own (error)"]


def test_scoring_metadata_and_failure(spark):
    leaf = "array<struct<path:string,key:string,value:string,llm_conf:double,falsy:boolean>>"
    df = spark.createDataFrame([
        (1, [("a", "a", "x", 0.9, False)], ["p"], [], None, "llm_structured"), (2, None, [], ["total_bad"], 0.5, "fallback_json"),
        (3, [], [], ["f"], 0.25, "failed")], f"i long, leaves {leaf}, passed_rules array<string>, failed_rules array<string>, ocr_quality double, extraction_method string")
    fine, lost, empty = sorted(scoring.score(df, Weights(llm=2.0, ocr=1.0, validation=1.0)).collect(), key=lambda r: r.i)
    assert fine.scoring_metadata.asDict(True) == {
        "ocr_quality": 0.8, "extraction_method": "llm_structured", "validation_passed": True, "error": None,
        "weights_used": {"llm_weight": 0.5, "ocr_weight": 0.25, "validation_weight": 0.25}}
    assert (lost.overall_confidence, lost.avg_field_confidence, lost.scored) == (0.5, 0.5, [])
    assert lost.scoring_metadata.error and lost.scoring_metadata.weights_used is None
    assert empty.scoring_metadata.error is None and empty.scoring_metadata.validation_passed is False
