import json
import math

import pytest

from foliograde import fixed_values as fv
from foliograde.operators import requests, responses, results

INVOICE = {"invoice_number": "A1", "date": "2024-01-15", "total_amount": 10.5,
           "line_items": [{"description": "x", "quantity": 1, "total_price": 10.5, "confidence": 0.9}]}


def parse(spark, replies, doc_type="invoice"):
    """Parse all replies in one query; rows in the order given."""
    rows = [(i, doc_type, r) for i, r in enumerate(replies)]
    df = spark.createDataFrame(rows, "i long, doc_type string, response string")
    return sorted(responses.parse_typed(df).collect(), key=lambda r: r.i)


def with_item(**changes):
    item = {**INVOICE["line_items"][0], **changes}
    return {**INVOICE, "line_items": [{k: v for k, v in item.items() if v != "absent"}]}


ACCEPTED = [
    json.dumps(INVOICE), "```json\n" + json.dumps(INVOICE) + "\n```", "```\n" + json.dumps(INVOICE) + "```",
    json.dumps({**INVOICE, "other": [1, {"a": 2}]}), json.dumps({**INVOICE, "total_amount": "10.5"}),
    json.dumps(with_item(confidence="absent")), json.dumps(with_item(quantity=None)), "{}",
    json.dumps({**INVOICE, "vendor_name": None}), json.dumps({**INVOICE, "invoice_number": "2024-1"}),
    json.dumps({**INVOICE, "invoice_number": "7"}), json.dumps({**INVOICE, "vendor_name": "false"}),
    '{"vendor_name": 5, "vendor_name": "last counts"}', '{"total_amount": NaN}', '{"total_amount": -Infinity, "line_items": []}',
    '{"line_items": [{}], "line_items": [{"description": 1, "description": "d", "quantity": 1, "quantity": null}]}',
    '{"other": {"line_items": null}}', ' \n{"currency": null}\t', '{"vendor_name": "a \\"line_items\\": null b"}',
]

REJECTED = [
    None, "", "no json", "[1]", '{"a": ', "Here: " + json.dumps(INVOICE),
    json.dumps({**INVOICE, "line_items": None}), json.dumps({**INVOICE, "line_items": {}}),
    json.dumps({**INVOICE, "line_items": ["x"]}), json.dumps({**INVOICE, "total_amount": "1,500"}),
    json.dumps({**INVOICE, "invoice_number": 7}), json.dumps({**INVOICE, "invoice_number": True}),
    json.dumps(with_item(description="absent")), json.dumps(with_item(description=None)),
    json.dumps(with_item(confidence=2.0)), json.dumps(with_item(confidence=None)),
    json.dumps({**INVOICE, "vendor_name": ["a"]}), '{"vendor_name": NaN}', '{"vendor_name": "last counts", "vendor_name": 5}',
    '{"line_items": [], "line_items": null}', '{"line_items": [null]}', '{"line_items": "x"}', '{"line_items": [{"description": "d", "confidence": NaN}]}',
    "{'vendor_name': 'x'}", '{"total_amount": 01}', '{} {}', '{}, {}', '{}]} {"reply": [{}', '{"a": 1} tail', "5", "null", '"x"', '{"line_items": null, "total_amount": NaN}',
]


def test_accepted_and_rejected(spark):
    rows = parse(spark, ACCEPTED + REJECTED)
    assert [ACCEPTED[r.i] for r in rows[:len(ACCEPTED)] if not r.typed_ok] == []
    assert [REJECTED[r.i - len(ACCEPTED)] for r in rows[len(ACCEPTED):] if r.typed_ok or r.invoice] == []


def test_values_and_defaults(spark):
    first, no_currency, number_text, true, no_score, empty = [r.invoice for r in parse(spark, [
        json.dumps(INVOICE), json.dumps({**INVOICE, "currency": None}), json.dumps({**INVOICE, "total_amount": "2"}),
        json.dumps({**INVOICE, "total_amount": True}), json.dumps(with_item(confidence="absent")), "{}"])]
    assert first.currency == "USD" and first.vendor_name is None
    assert first.line_items[0].asDict() == {
        "description": "x", "quantity": 1.0, "unit_price": None, "total_price": 10.5, "confidence": 0.9}
    assert no_currency.currency is None
    assert number_text.total_amount == 2.0 and true.total_amount == 1.0
    assert no_score.line_items[0].confidence == 0.0
    last, odd = [r.invoice for r in parse(spark, ['{"vendor_name": 5, "vendor_name": "b", "line_items": [{"description": "c", "description": "d"}]}', '{"total_amount": NaN}'])]
    assert last.vendor_name == "b" and last.line_items[0].description == "d" and math.isnan(odd.total_amount)
    assert empty.line_items == []


@pytest.mark.parametrize("reply, span", [
    ('Sure: {"a": {"b": 1}} ok', '{"a": {"b": 1}}'), ("none", None), ("} {", None), ("{", None), ("}", None),
    ("{}", "{}"), ("x {a} y {b}", "{a} y {b}"), (None, None)])
def test_braced(value, reply, span):
    assert value(responses.braced, "r string", reply) == span


def test_outcome(spark):
    none = "All extraction methods failed: No valid JSON found in response"
    cases = [
        ("invoice", json.dumps(INVOICE), None, "llm_structured", None),
        ("invoice", "bad", 'x {"a": 1} y', "fallback_json", None),
        ("invoice", "bad", "none", "failed", none),
        ("invoice", "bad", "{a}", "failed", "All extraction methods failed: Invalid JSON"),
        ("invoice", None, None, "failed", none),
        ("unknown", json.dumps(INVOICE), "{}", "failed", "Unknown document type: unknown"),
    ]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)],
                               "i long, doc_type string, response string, fallback_response string")
    rows = sorted(responses.extract(df).collect(), key=lambda r: r.i)
    assert [(r.extraction_method, r.extraction_error) for r in rows] == [c[3:] for c in cases]


def test_rendered_tables(value):
    schema = "t array<struct<page:int,table_index:int,headers:array<string>,rows:array<array<string>>>>"
    table = (2, 0, ["a", None], [[str(i), None] for i in range(7)])
    got = value(requests.rendered_tables, schema, [table])
    assert got == ("Table 1 (Page 2):\nHeaders: a, \n" + "".join(f"Row {i + 1}: {i}, None\n" for i in range(5))
                   + "... and 2 more rows\n")
    assert value(requests.rendered_tables, schema, []) == "No tables found"


def test_requests(spark):
    df = spark.createDataFrame([(1, "invoice", "x" * 5000), (2, "unknown", "y"), (3, "prescription", " ")],
                               "doc_id long, doc_type string, text string")
    routed = {r.doc_id: r for r in requests.routing_requests(df, "doc_id").collect()}
    assert set(routed) == {1, 2} and routed[1].user.endswith("x" * 2000 + "...")
    asked = {r.doc_id: r for r in requests.extraction_requests(df, "doc_id").collect()}
    assert set(asked) == {1, 3}
    assert asked[1].user.count("x") >= 4000 and "x" * 4001 not in asked[1].user
    assert "No tables found" in asked[1].user and "This is an INVOICE document" in asked[1].system
    assert "this invoice document" in requests.fallback_requests(df, "doc_id").first().user


def test_apply_model(spark):
    df = spark.createDataFrame([(i, f"q{i}") for i in range(50)], "doc_id long, user string")
    out = requests.apply_model(df, lambda batch: batch["user"].str.upper(), "doc_id")
    assert {(r.doc_id, r.response) for r in out.collect()} == {(i, f"Q{i}") for i in range(50)}


@pytest.mark.parametrize("reply,method,fields", [
    ('{"a":"x"} trailing {"b":"y"}', fv.METHOD_FAILED, []),
    ('{"a":1,"a":2}', fv.METHOD_FALLBACK, [("a", "2")]),
    ('so: {"a":NaN,"b":"c"} done', fv.METHOD_FALLBACK, [("a", "nan"), ("b", "c")]),
    ('{"v":"\\ud800"}', fv.METHOD_FALLBACK, [("v", "�")]),
    ('{"v":[{"w":[[{"x":"deep"}],7]}]}', fv.METHOD_FALLBACK, [("v[0].w[0][0].x", "deep")]),
    ('{"v":"x"', fv.METHOD_FAILED, []),
    (None, fv.METHOD_FAILED, []),
])
def test_one_reading_decides_outcome_and_fields(spark, reply, method, fields):
    row = published(spark, reply)
    assert row.processing_metadata.extraction_method == method and row.processing_metadata.error is None
    assert [(f.name, f.value) for f in row.fields] == fields


@pytest.mark.parametrize("reply", ['{"v":"x","v_confidence":1' + "0" * 400 + "}", '{"v":1' + "0" * 5000 + "}"])
def test_a_record_that_cannot_be_used_is_one_error_row(spark, reply):
    row = published(spark, reply)
    assert row.processing_metadata.error and row.overall_confidence == 0.0 and row.fields == []


def published(spark, reply):
    df = spark.createDataFrame([(1, "/in/1", "an invoice with total", None, None, reply)],
                               "doc_id long, source_file string, text string, ocr_quality double, response string, fallback_response string")
    return results.process_documents(df, "doc_id").first()
