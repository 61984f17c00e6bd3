"""Free-form records are read with one parser and stored column by column."""

import json

import pyarrow as pa

from foliograde.operators import freeform


def read(*texts):
    return freeform.read.func(pa.array(texts, pa.string())).to_pylist()


def test_one_parser_reads_all_records(monkeypatch):
    """before, a parser was made for each record, and a dictionary for each leaf."""
    made = []
    decoder = json.JSONDecoder
    monkeypatch.setattr(json, "JSONDecoder", lambda *args, **kw: made.append(1) or decoder(*args, **kw))
    assert len(read(*['{"a": {"b": 1}}'] * 50)) == 50
    assert len(made) == 1


def test_records_do_not_leak_into_each_other():
    rows = read('{"a": 1, "a": 2}', '{"a":  3}', None, "no", '{"b": NaN}', '{"c": [{"d": " "}, {"e": false, "e_confidence": "0.5"}], "confidence": 1}', "[]")
    assert [row and row["json"] for row in rows] == ['{"a": 2}', '{"a":  3}', None, None, '{"b": "NaN"}', rows[5]["json"], "[]"]
    assert [row and [tuple(leaf.values()) for leaf in row["leaves"]] for row in rows] == [
        [("a", "a", "2", None, False)], [("a", "a", "3", None, False)], None, None, [("b", "b", "nan", None, False)],
        [("c[1].e", "e", "False", 0.5, True), ("confidence", "confidence", "1", 1.0, False)], []]


def test_problems_stay_with_their_record():
    rows = read('{"a": "\\ud800"}', '{"a": 1, "a_confidence": ' + "9" * 400 + "}", '["x", [{"é": "ü"}], {"b": 0}]')
    assert rows[0]["leaves"][0]["value"] == "�"
    assert rows[1]["error"].startswith("OverflowError") and rows[1]["leaves"] == []
    assert [(leaf["path"], leaf["value"], leaf["falsy"]) for leaf in rows[2]["leaves"]] == [("item_1[0].é", "ü", False), ("item_2.b", "0", True)]


def test_no_records():
    assert freeform.read.func(pa.array([], pa.string())).to_pylist() == []
    assert read(None, None) == [None, None]
