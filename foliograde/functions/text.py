"""Column functions on text: cleaning, pattern extraction, similarity, printing.

Every function takes and returns Columns and stays inside the JVM.
"""

from __future__ import annotations

import string
import unicodedata
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliograde import fixed_values as fv


def filled(template: str, **parts: Column) -> Column:
    """A template with ``{name}`` places, each filled with a column."""
    pieces = []
    for literal, name, *_ in string.Formatter().parse(template):
        pieces += [F.lit(literal)] if literal else []
        pieces += [parts[name].cast("string")] if name else []
    return F.concat(*pieces)


def clean_text(text: Column) -> Column:
    """Collapse white space, then delete characters outside the kept set, then trim.

    Deleting comes second, so a deleted character between two blanks leaves both.
    """
    return F.coalesce(F.trim(clean_fragment(text)), F.lit(""))


def clean_fragment(text: Column) -> Column:
    """``clean_text`` without the final trim, for pieces that are joined later."""
    collapsed = F.regexp_replace(text, fv.WHITESPACE + "+", " ")
    return F.regexp_replace(collapsed, fv.DELETED_BY_CLEANING, "")


def has_text(text: Column) -> Column:
    """True if there is at least one character that is not white space."""
    printable = (text >= "!") & (text < "\x7f")  # by its first byte
    return F.when(printable, True).otherwise(F.coalesce(text.rlike(fv.NOT_WHITESPACE), F.lit(False)))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(fv.NOT_WHITESPACE + "+"), F.lit(0))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(fv.NOT_WHITESPACE + "+")), F.lit(0))


def truncate(text: Column, limit: int, mark: str = "") -> Column:
    """The first ``limit`` characters; ``mark`` is appended where text was cut off."""
    cut = F.substring(text, 1, limit)
    if not mark:
        return cut
    return F.when(F.length(text) > limit, F.concat(cut, F.lit(mark))).otherwise(text)


# --- pattern extraction ---------------------------------------------------------


def _all_matches(text: Column, patterns: Iterable[str]) -> Column:
    """Matches of each pattern in turn: all of the first, then all of the second, ..."""
    return F.concat(*[
        F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(p), F.lit(0)) for p in patterns
    ])


#: The decimal digits of all other scripts, and their values.
_OTHER_DIGITS = "".join(c for c in map(chr, range(0x80, 0x110000)) if unicodedata.category(c) == "Nd")
_ASCII_OF_THEM = "".join(str(unicodedata.decimal(c)) for c in _OTHER_DIGITS)


def extract_numbers(text: Column) -> Column:
    found = _all_matches(text, [fv.NUMBER_PATTERN])
    parsed = F.transform(found, lambda m: F.replace(
        F.translate(m, _OTHER_DIGITS, _ASCII_OF_THEM), F.lit(","), F.lit("")).try_cast("double"))
    return F.filter(parsed, lambda n: n.isNotNull())


#: ``DATE_PATTERNS`` with the same matches, found sooner: the first character is looked at before the edge of a word is
#: looked for, and what cannot be shared with the next part is not given back.
_DATES = [
    r"\p{Nd}{1,2}+[-/]\p{Nd}{1,2}+[-/]\p{Nd}{2,4}",
    r"\p{Nd}{2,4}+[-/]\p{Nd}{1,2}+[-/]\p{Nd}{1,2}",
    rf"(?i)(?=\p{{Nd}})(?<!{fv.WORD_CHAR})\p{{Nd}}{{1,2}}+{fv.WHITESPACE}++(?=[JFMASOND])(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*+{fv.WHITESPACE}++\p{{Nd}}{{2,4}}+(?!{fv.WORD_CHAR})",
    rf"(?i)(?=[JFMASOND])(?<!{fv.WORD_CHAR})(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*+{fv.WHITESPACE}++\p{{Nd}}{{1,2}}+,?{fv.WHITESPACE}++\p{{Nd}}{{2,4}}+(?!{fv.WORD_CHAR})",
]


def extract_dates(text: Column) -> Column:
    return _all_matches(text, _DATES)


def extract_emails(text: Column) -> Column:
    return _all_matches(text, [fv.EMAIL_PATTERN])


def extract_phones(text: Column) -> Column:
    return _all_matches(text, fv.PHONE_PATTERNS)


def looks_like_date(text: Column) -> Column:
    """True if any accepted date shape occurs anywhere in the value."""
    return text.rlike("|".join(fv.DATE_RULE_PATTERNS))


def is_email(text: Column) -> Column:
    return text.rlike(fv.EMAIL_RULE_PATTERN)


def is_phone(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"\P{Nd}", "")).between(7, 15)


# --- similarity -------------------------------------------------------------------


def char_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of the two sets of lower-cased characters; 0 if either is empty."""
    left, right = F.split(F.lower(a), ""), F.split(F.lower(b), "")
    shared = F.size(F.array_intersect(left, right))
    either = F.size(F.array_union(left, right))
    usable = (F.length(a) > 0) & (F.length(b) > 0)
    return F.when(usable, shared / either).otherwise(F.lit(0.0))


# --- labels and printing ------------------------------------------------------------


def label(name: Column) -> Column:
    """``medical_bill`` -> ``Medical Bill``."""
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def bbox_struct(box: Column) -> Column:
    """``[x0, y0, x1, y1]`` as a struct; zeros if there are fewer than four numbers."""
    def side(i: int) -> Column:
        return F.when(F.size(box) >= 4, F.get(box, i).cast("double")).otherwise(F.lit(0.0))

    return F.struct(side(0).alias("x0"), side(1).alias("y0"),
                    side(2).alias("x1"), side(3).alias("y1"))


def money(amount: Column, grouped: bool = False) -> Column:
    """Two decimals, with or without thousands separators."""
    return F.call_function("format_number", amount, F.lit("#,##0.00" if grouped else "0.00"))


def float_text(number: Column) -> Column:
    """A double printed with the shortest digits: plain from 1e-4 up to 1e16, else ``1e+16`` style."""
    plain, size = number.cast("string"), F.abs(number)
    whole = F.concat(number.try_cast("decimal(38,0)").cast("string"), F.lit(".0"))
    unfolded = F.rtrim(plain.try_cast("decimal(38,20)").cast("string"), F.lit("0"))
    exponent = F.substring_index(plain, "E", -1).try_cast("int")
    scientific = F.concat(
        F.regexp_replace(F.substring_index(plain, "E", 1), r"\.0$", ""),
        F.when(exponent < 0, "e-").otherwise("e+"),
        F.when(F.abs(exponent) < 10, "0").otherwise(""),
        F.abs(exponent).cast("string"),
    )
    return (
        F.when(((size >= 1e-3) & (size < 1e7)) | (size == 0), plain)
        .when(F.isnan(number), "nan")
        .when(size == float("inf"), F.when(number > 0, "inf").otherwise("-inf"))
        .when((size >= 1e16) | (size < 1e-4), scientific)
        .when(number == F.floor(number), whole)
        .when(number.isNotNull(), unfolded)
    )


def to_number(text: Column) -> Column:
    """Text as a double; null if it is not a plain decimal number, ``inf`` or ``nan``."""
    bare = F.regexp_replace(text, rf"^{fv.WHITESPACE}+|{fv.WHITESPACE}+$", "")
    bare = F.regexp_replace(bare, r"(?<=[0-9])_(?=[0-9])", "")
    shape = r"(?i)^[+-]?(?:[0-9]+\.?[0-9]*(?:e[+-]?[0-9]+)?|\.[0-9]+(?:e[+-]?[0-9]+)?|inf|infinity|nan)$"
    return F.when(bare.rlike(shape), bare.try_cast("double"))


def rounded(number: Column, digits: int) -> Column:
    """Round half up by plain double arithmetic, so that other engines can repeat it exactly."""
    unit = float(10 ** digits)
    return F.floor(number * unit + 0.5) / unit
