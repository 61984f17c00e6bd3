"""What reading a reply and checking a published record no longer costs, with the same results."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as spark_entry
from foliograde.functions.record import SeenCell, seen
from foliograde.operators import responses, validation


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_braces_are_found_without_turning_the_text_round(spark):
    """F1"""
    texts = [None, "", "x", "{", "}", "}{", "{}", 'a{"b": 1}c', "ü{é}}ö}ß", "{{", "a{b}c{d"]
    found = spark.createDataFrame([(t,) for t in texts], "t string").repartition(1).select("t", responses.braced(F.col("t")).alias("span"))
    assert "reverse" not in plan(found)
    assert {r.t: r.span for r in found.collect()} == {None: None, "": None, "x": None, "{": None, "}": None, "}{": None, "{}": "{}", 'a{"b": 1}c': '{"b": 1}',
                                                      "ü{é}}ö}ß": "{é}}ö}", "{{": None, "a{b}c{d": "{b}"}


@pytest.mark.parametrize("given, kind, number", [
    ("12.50", None, 12.5), ("-3", None, -3.0), ('"12.5"', None, 12.5), ('"1e3"', "STRING", 1000.0), ("1e30", "DOUBLE", 1e30), ("true", "BOOLEAN", 1.0),
    ('"true"', "STRING", None), ('"x"', None, None), ("null", None, None), ("[1]", "ARRAY<BIGINT>", None), ("123456789012345678901", None, 123456789012345678901.0)])
def test_a_plain_number_needs_no_kind(spark, given, kind, number):
    """the kind of a VARIANT is only asked for where its print leaves the number open."""
    df = spark.createDataFrame([(given,)], "t string").select(F.parse_json("t").alias("v"))
    row = df.select(seen(F.col("v"), True).alias("s")).select("s.kind", SeenCell(F.col("s")).number.alias("n")).first()
    assert (row.kind, row.n) == (kind, number)


def test_records_that_nobody_reads_are_not_made(spark, sf):
    """the outcome of the extraction needs no values of the records."""
    text = plan(spark_entry.queries()["extraction_outcome"](spark, sf))
    assert text.count("false, [invoice#") == 1  # that of the input


def test_fields_are_checked_without_their_schema(spark):
    """F2"""
    fields = '[{"name": 1, "value": null, "confidence": [], "more": {"a": 1}}, 7, {"name": "x"}, null, [], {"value": {"name": 1}, "confidence": 0}]'
    rows = [f'{{"doc_type": "x", "overall_confidence": 0.5, "fields": {f}}}' for f in (fields, "{}", "null", "[]")] + ["no", None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, r string").repartition(1)
    checked = df.select("i", validation.structural_issues(F.col("r")).alias("issues"))
    assert "ArrayType(VariantType" not in plan(checked)  # no field is put together again as a VARIANT
    found = {r.i: r.issues for r in checked.collect()}
    assert found[0] == ["Field 1 is not a dictionary", "Field 2 missing key: value", "Field 2 missing key: confidence", "Field 3 is not a dictionary",
                        "Field 4 is not a dictionary", "Field 5 missing key: name"]
    assert found[1] == found[2] == found[3] == []
    assert found[4] == found[5] == [f"Missing required key: {k}" for k in ("doc_type", "fields", "overall_confidence")]
