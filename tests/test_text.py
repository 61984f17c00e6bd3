import math
import random

import pytest
from pyspark.sql import functions as F

from foliograde import fixed_values as fv
from foliograde.functions import text as tx

SAMPLE = ("Due 2024-01-15 or 1/2/24, 15 Jan 2024 and March 3, 2024; call 555-123-4567 (555) 123-4567 "
          "+1-555-123-4567; pay $1,234.50 , a@b.co ,,")


@pytest.mark.parametrize("raw, cleaned", [
    ("a ' b", "a  b"), ("  x\t\n y  ", "x y"), ("’€–é²^`~", "é²"), ("a b\x1cc d", "a b c d"),
    ("", ""), (None, ""), ("[x] {y} <z> \"q\" \\ | / 5%", "[x] {y} <z> \"q\" \\ | / 5%"),
])
def test_clean_text(value, raw, cleaned):
    assert value(tx.clean_text, "t string", raw) == cleaned


def test_patterns(value):
    assert value(tx.extract_dates, "t string", SAMPLE) == [
        "24-01-15", "1/2/24", "2024-01-15", "15 Jan 2024", "March 3, 2024"]
    assert value(tx.extract_emails, "t string", SAMPLE) == ["a@b.co"]
    assert value(tx.extract_phones, "t string", SAMPLE) == [
        "555-123-4567", "555-123-4567", "(555) 123-4567", "+1-555-123-4567"]
    assert value(tx.extract_numbers, "t string", "pay $1,234.50 , 7. ,, 3") == [1234.5, 7.0, 3.0]
    assert value(tx.extract_numbers, "t string", None) == []


def test_word_edges_see_letters_of_all_scripts(value):
    assert value(tx.extract_dates, "t string", "é5 Jan 2024") == []
    assert value(tx.extract_dates, "t string", "(5 jan 2024)") == ["5 jan 2024"]


def test_dates_are_found_as_the_patterns_say(spark):
    """The faster forms of the date patterns match what the stated ones match."""
    rng = random.Random(11)
    parts = ["1", "12", "123", "2024", "12345", "-", "/", " ", "\u00a0", ",", "Jan", "JUNE", "mAy", "Decx", "Mar1", "\u0661", "\u00e9", "_", "x", "\n", "\U0001d7d9"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    texts += [f"{a}{d}{s}{m}{t}{y}{z}" for a in ("", "x", "(") for d in ("1", "15", "115") for s in (" ", "") for m in ("Jan", "may", "Marchx") for t in (" ", "\t ") for y in ("24", "2024", "20245") for z in ("", "a", ".")]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert all("(?<=" not in p for p in tx._DATES)
    rows = df.select("t", tx.extract_dates(F.col("t")).alias("got"), tx._all_matches(F.col("t"), fv.DATE_PATTERNS).alias("stated")).collect()
    assert [r.t for r in rows if r.got != r.stated] == [] and sum(map(bool, (r.got for r in rows))) > 50


def test_text_is_told_from_white_space(value):
    for text, expected in ((None, False), ("", False), (" \t\x1c\u00a0", False), ("\x7f", True), (" a", True), ("!", True), ("\u00e9", True), ("~~", True)):
        assert value(tx.has_text, "t string", text) is expected


def test_words_and_cuts(value):
    assert value(tx.word_count, "t string", " a b  c ") == 3
    assert value(tx.word_count, "t string", "  ") == 0
    assert value(lambda t: tx.truncate(t, 5, "..."), "t string", "abcdefg") == "abcde..."
    assert value(lambda t: tx.truncate(t, 5, "..."), "t string", "abcde") == "abcde"


def test_similarity(value):
    assert value(tx.char_jaccard, "a string, b string", "abc", "bcd") == 0.5
    assert value(tx.char_jaccard, "a string, b string", "", "bcd") == 0.0
    assert value(tx.char_jaccard, "a string, b string", "AB", "ba") == 1.0


def test_box_and_label(value):
    assert tuple(value(tx.bbox_struct, "b array<double>", [1.0, 2.0, 3.0, 4.0])) == (1, 2, 3, 4)
    assert tuple(value(tx.bbox_struct, "b array<double>", [1.0])) == (0, 0, 0, 0)
    assert value(tx.label, "n string", "medical_bill") == "Medical Bill"


def test_float_text_prints_like_python(spark):
    rng = random.Random(5)
    numbers = [0.0, 1500.0, 10000000.25, 1e16, 1.5e16, 5e-5, 0.0005, 1e100, -2.5e-10, 1e15, -12.5,
               math.inf, -math.inf, math.nan] + [
        round(rng.uniform(-1, 1) * 10 ** rng.randint(-3, 14), rng.randint(0, 4)) for _ in range(500)]
    df = spark.createDataFrame([(n,) for n in numbers], "n double")
    for row in df.select("n", tx.float_text(F.col("n")).alias("t")).collect():
        assert row.t == str(row.n)


@pytest.mark.parametrize("text, number", [
    ("12", 12.0), (" 12.5 ", 12.5), ("1_000", 1000.0), (".5", 0.5), ("5.", 5.0), ("1e3", 1000.0),
    ("12d", None), ("1,500", None), ("", None), ("0x10", None), ("inf", math.inf),
])
def test_to_number(value, text, number):
    assert value(tx.to_number, "t string", text) == number


@pytest.mark.parametrize("text, good", [
    ("2024-01-15", True), ("due 1/2/24 maybe", True), ("5 January 2024", True), ("Mayo 3, 2024", True),
    ("n/a", False), ("2024.01.05", False),
])
def test_dates_in_rules(value, text, good):
    assert value(tx.looks_like_date, "t string", text) is good


def test_contacts(value):
    assert value(tx.is_email, "t string", "a.b@c.org") is True
    assert value(tx.is_email, "t string", "a b@c.org") is False
    assert value(tx.is_phone, "t string", "+1 (555) 123-4567") is True
    assert value(tx.is_phone, "t string", "12-34") is False
