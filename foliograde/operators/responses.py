"""Reading model replies: typed parsing, the free-form fallback, and the outcome of both."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliograde import fixed_values as fv
from foliograde.functions.once import with_once
from foliograde.functions.record import SeenCell, seen
from foliograde.operators import freeform
from foliograde.schemas import KEY_DEFAULTS, RECORD_TYPES


def unfenced(response: Column) -> Column:
    """The inside of a Markdown code fence, or the whole reply if there is none."""
    inside = F.regexp_extract(response, r"(?s)```(?:json)?(.*?)```", 1)
    return F.when(F.contains(response, F.lit("```")) & (F.length(inside) > 0), inside).otherwise(response)


def _raw(schema: T.StructType) -> T.StructType:
    """The type in which a record is read: every value a VARIANT, lists as lists of such structs."""
    return T.StructType([
        T.StructField(f.name, T.ArrayType(_raw(f.dataType.elementType)) if isinstance(f.dataType, T.ArrayType) else T.VariantType())
        for f in schema.fields])


def read_object(response: Column, schema: T.StructType) -> Column:
    """The reply as a struct of VARIANTs, one per key of ``schema``; null if it is not one JSON object.

    One pass of the parser: a key that is absent is null, one that is null is a null VARIANT; of repeated keys the last
    one counts; NaN is a number.  Something that is no list of objects where a list belongs (null aside), also under a key
    that is repeated later, makes the reply unreadable.  The parser stops after the first value, so the reply is read as the one element of a list with
    something behind it: text after the object breaks that.
    """
    whole = T.StructType([T.StructField("reply", T.ArrayType(_raw(schema))), T.StructField("end", T.IntegerType()), T.StructField("unread", T.StringType())])
    framed = F.concat(F.lit('{"reply":['), unfenced(response), F.lit('],"end":0}'))
    read = F.from_json(framed, whole, {"allowSingleQuotes": "false", "columnNameOfCorruptRecord": "unread"})
    # the element is picked by a filter, so that the parse is written once
    fine = F.filter(F.array(read), lambda r: r["unread"].isNull() & r["end"].isNotNull() & (F.size(r["reply"]) == 1))
    return F.get(F.get(fine, F.lit(0))["reply"], F.lit(0))


def braced(response: Column) -> Column:
    """From the first ``{`` to the last ``}``; null if there is no such span."""
    start = F.instr(response, "{")
    end = F.length(response) - F.length(F.substring_index(response, "}", -1))
    usable = (start > 0) & (F.instr(response, "}") > 0) & (end > start)
    return F.when(usable, F.substring(response, start, end - start + 1))


# --- typed parsing ---------------------------------------------------------------------


def _seen(raw: Column, schema: T.StructType) -> Column:
    """The record with every VARIANT printed once; null for a list element that is none."""
    def one(f: T.StructField) -> Column:
        own = raw.getField(f.name)
        if isinstance(f.dataType, T.ArrayType):
            return F.transform(own, lambda x: F.when(x.isNotNull(), _seen(x, f.dataType.elementType)))
        return seen(own, isinstance(f.dataType, T.DoubleType))
    return F.struct(*[one(f).alias(f.name) for f in schema.fields])


def _scalar(value_seen: Column, field: T.StructField) -> Column:
    """A field's value, and whether it may stand as it is (``fit``): absent or null where that is allowed, or text."""
    cell, absent = SeenCell(value_seen), value_seen["raw"].isNull()
    if isinstance(field.dataType, T.DoubleType):
        value, fit = cell.number, cell.missing
    else:
        value, fit = cell.printed, cell.is_text if field.metadata.get("required") else cell.missing | cell.is_text
    if field.name in KEY_DEFAULTS:
        value = F.when(absent, KEY_DEFAULTS[field.name]).otherwise(value)
    return F.struct(value.cast(field.dataType).alias("value"), F.coalesce(fit, F.lit(False)).alias("fit"))


def _good(cell: Column, field: T.StructField) -> Column:
    """A value is acceptable if it fits; a number also if it could be read, a confidence only if it is between 0 and 1."""
    value = cell.getField("value")
    if field.name == "confidence":
        return F.coalesce((value >= 0) & (value <= 1), F.lit(False))
    fit = cell.getField("fit")
    return fit | value.isNotNull() if isinstance(field.dataType, T.DoubleType) else fit


def _cells(record: Column, schema: T.StructType) -> Column:
    """For each field the struct of ``_scalar``; for a list those of its elements, null for an element that is none."""
    def cell(f: T.StructField) -> Column:
        if isinstance(f.dataType, T.ArrayType):
            return F.transform(record.getField(f.name), lambda x: F.when(x.isNotNull(), _cells(x, f.dataType.elementType)))
        return _scalar(record.getField(f.name), f)
    return F.struct(*[cell(f).alias(f.name) for f in schema.fields])


def _all_good(cells: Column, schema: T.StructType) -> Column:
    good = F.lit(True)
    for f in schema.fields:
        own = cells.getField(f.name)
        if isinstance(f.dataType, T.ArrayType):
            element = f.dataType.elementType
            good = good & F.coalesce(F.forall(own, lambda x: x.isNotNull() & _all_good(x, element)), F.lit(True))
        else:
            good = good & _good(own, f)
    return F.coalesce(good, F.lit(False))


def _values(cells: Column, schema: T.StructType) -> Column:
    def value(f: T.StructField) -> Column:
        own = cells.getField(f.name)
        if isinstance(f.dataType, T.ArrayType):
            rows = F.transform(own, lambda x: _values(x, f.dataType.elementType))
            return F.coalesce(rows, F.array()).cast(f.dataType)
        return own.getField("value")
    return F.struct(*[value(f).alias(f.name) for f in schema.fields])


def _null_list(response: Column, raw: Column, schema: T.StructType) -> Column:
    """True if a list of the record is given as null, which is not the same as left out."""
    def given(name: str) -> Column:
        keys = F.json_object_keys(unfenced(response))  # null where there is a NaN, which it does not read
        return F.coalesce(F.array_contains(keys, name), response.rlike(rf'"{name}"\s*:\s*null'))
    lists = [raw.getField(f.name).isNull() & given(f.name) for f in schema.fields if isinstance(f.dataType, T.ArrayType)]
    return reduce(lambda a, b: a | b, lists, F.lit(False))


def parse_typed(df: DataFrame, response: str = "response",
                record_types: dict[str, T.StructType] = RECORD_TYPES) -> DataFrame:
    """Add one struct column per record type and ``typed_ok``.

    Only the struct of the document's ``doc_type`` is filled, and only if the reply parses: every
    key the type knows is absent, null where allowed, or of the right kind.  Numbers may come as
    numeric text; text must be text; a list must be a list of acceptable objects.  Absent keys get
    their defaults.  Each reply is parsed once, each value read once.
    """
    def when_type(name: str, value: Column) -> Column:
        return F.when(F.col("doc_type") == name, value)

    raw, read, cells = ({name: f"_{kind}_{name}" for name in record_types} for kind in ("raw", "seen", "cells"))
    df = with_once(df, {raw[n]: when_type(n, read_object(F.col(response), schema)) for n, schema in record_types.items()})
    df = with_once(df, {
        read[n]: F.when(F.col(raw[n]).isNotNull() & ~_null_list(F.col(response), F.col(raw[n]), schema), _seen(F.col(raw[n]), schema))
        for n, schema in record_types.items()}).drop(*raw.values())
    df = with_once(df, {
        cells[n]: F.when(F.col(read[n]).isNotNull(), _cells(F.col(read[n]), schema)) for n, schema in record_types.items()}).drop(*read.values())
    ok = reduce(lambda a, b: a | b, [F.col(cells[n]).isNotNull() & _all_good(F.col(cells[n]), schema) for n, schema in record_types.items()], F.lit(False))
    df = with_once(df, {"typed_ok": F.coalesce(ok, F.lit(False))})
    # plain columns: who does not read a record does not have it made
    return df.withColumns({
        name: F.when(F.col("typed_ok") & F.col(cells[name]).isNotNull(), _values(F.col(cells[name]), schema))
        for name, schema in record_types.items()}).drop(*cells.values())


# --- outcome ------------------------------------------------------------------------------


def extract(df: DataFrame, response: str = "response", fallback: str = "fallback_response",
            record_types: dict[str, T.StructType] = RECORD_TYPES) -> DataFrame:
    """From replies to records: typed if it parses, else free-form, else failed.

    Adds one struct column per record type, ``freeform`` (JSON text), ``freeform_leaves``,
    ``extraction_method``, ``extraction_error`` and ``record_error`` (a free-form record that can
    be parsed but not used).  An unknown type fails without looking at the replies.  The second
    reply is read once, and only where the first one does not parse; text after its JSON makes it
    fail, of repeated keys the last one counts.
    """
    df = parse_typed(df, response, record_types)
    known = F.coalesce(F.col("doc_type").isin(list(record_types)), F.lit(False))
    df = with_once(df, {"_span": F.when(known & ~F.col("typed_ok"), braced(F.col(fallback)))})
    df = with_once(df, {"_read": freeform.read(F.col("_span"))})
    method = (
        F.when(~known, fv.METHOD_FAILED)
        .when(F.col("typed_ok"), fv.METHOD_TYPED)
        .when(F.col("_read").isNotNull(), fv.METHOD_FALLBACK)
        .otherwise(fv.METHOD_FAILED)
    )
    df = with_once(df, {"extraction_method": method})
    failed = F.col("extraction_method") == fv.METHOD_FAILED
    return (
        df.withColumn("freeform", F.col("_read.json"))
        .withColumn("freeform_leaves", F.col("_read.leaves"))
        .withColumn("record_error", F.col("_read.error"))
        .withColumn("extraction_error", F.when(
            failed & ~known, F.concat(F.lit(fv.UNKNOWN_TYPE_ERROR), F.col("doc_type")))
            .when(failed, F.concat(F.lit(fv.FALLBACK_FAILED_ERROR), F.when(
                F.col("_span").isNull(), fv.NO_JSON_ERROR).otherwise("Invalid JSON"))))
        .drop("_span", "_read", "typed_ok")
    )


def rejected(df: DataFrame, response: str = "response",
             record_types: dict[str, T.StructType] = RECORD_TYPES) -> DataFrame:
    """Documents of a known type whose first reply does not parse: they need a second request."""
    return (
        parse_typed(df, response, record_types)
        .filter(F.col("doc_type").isin(list(record_types)) & ~F.col("typed_ok"))
        .drop("typed_ok", *record_types)
    )
