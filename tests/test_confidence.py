import pytest
from pyspark.sql import functions as F

from foliograde.functions import confidence as cf
from foliograde.functions.confidence import Weights


@pytest.mark.parametrize("text, expected", [
    ("INV-2024-001", 0.7), ("1250.0", 0.6), ("ABC Corporation", 0.725), ("N/A", 0.325), ("", 0.0)])
def test_estimate(value, text, expected):
    assert value(cf.estimate, "t string", text) == pytest.approx(expected)


def test_estimate_of_falsy_values(value):
    assert value(lambda t, f: cf.estimate(t, f), "t string, f boolean", "0", True) == 0.0


@pytest.mark.parametrize("claim, text, expected", [
    ("Acme Ltd", "from acme ltd.", 0.9),
    ("one two three four five six seven eight nine ten", "only ten here", 0.07),
    ("1500.0", "total 1,500.00", 0.3), ("nowhere man", "text", 0.3), ("x", "", 0.0), ("", "x", 0.0)])
def test_evidence(value, claim, text, expected):
    got = value(lambda v, t: cf.evidence(v, F.lower(t)), "v string, t string", claim, text)
    assert got == pytest.approx(expected)


@pytest.mark.parametrize("llm, ocr, status, expected", [
    (0.9, 1.0, True, 0.94), (0.9, 1.0, None, 0.88), (0.9, 1.0, False, 0.74), (0.3, 1.0, None, 0.52),
    (0.9, None, None, 0.84), (5.0, 1.0, True, 1.0)])
def test_field_confidence(value, llm, ocr, status, expected):
    got = value(cf.field_confidence, "l double, o double, s boolean", llm, ocr, status)
    assert got == pytest.approx(expected)


def test_weights_and_text_match(value):
    build = lambda l, o, s: cf.field_confidence(l, o, s, Weights(2, 1, 1))
    assert value(build, "l double, o double, s boolean", 0.8, 1.0, True) == pytest.approx(0.9)
    matched = lambda l, m: cf.field_confidence(
        l, F.lit(1.0), F.lit(True), text_match=m)
    assert value(matched, "l double, m double", 0.8, 0.5) == pytest.approx(0.6 * 0.6 + 0.4)
