"""Record types: the Spark schemas of the three document types.

A record type is a plain ``StructType``; new types are added by passing another
mapping to the operators (see ``RECORD_TYPES``).  Declaration order matters: it
is the order of the flattened fields.
"""

from __future__ import annotations

import json

from pyspark.sql import types as T

from foliograde import fixed_values as fv

LINE_ITEM = T.StructType([
    T.StructField("description", T.StringType(), metadata={"required": True}),
    T.StructField("quantity", T.DoubleType()),
    T.StructField("unit_price", T.DoubleType()),
    T.StructField("total_price", T.DoubleType()),
    T.StructField("confidence", T.DoubleType()),
])

MEDICINE = T.StructType([
    T.StructField("name", T.StringType(), metadata={"required": True}),
    T.StructField("dosage", T.StringType()),
    T.StructField("frequency", T.StringType()),
    T.StructField("duration", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
])


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields])


def _strings(*names: str) -> list[tuple[str, T.DataType]]:
    return [(n, T.StringType()) for n in names]


def _doubles(*names: str) -> list[tuple[str, T.DataType]]:
    return [(n, T.DoubleType()) for n in names]


INVOICE = _struct(
    *_strings("invoice_number", "date", "due_date", "vendor_name", "vendor_address",
              "customer_name", "customer_address"),
    ("line_items", T.ArrayType(LINE_ITEM)),
    *_doubles("subtotal", "tax_amount", "total_amount"),
    *_strings("currency"),
)

MEDICAL_BILL = _struct(
    *_strings("patient_name", "patient_id", "hospital_name", "hospital_address",
              "bill_date", "service_date", "doctor_name"),
    ("line_items", T.ArrayType(LINE_ITEM)),
    *_strings("insurance_info"),
    *_doubles("total_amount", "amount_paid", "balance_due"),
    *_strings("currency"),
)

PRESCRIPTION = _struct(
    *_strings("patient_name", "patient_age", "patient_address", "doctor_name",
              "doctor_license", "clinic_name", "clinic_address", "prescription_date"),
    ("medicines", T.ArrayType(MEDICINE)),
    *_strings("diagnosis", "notes"),
)

RECORD_TYPES: dict[str, T.StructType] = {
    fv.INVOICE: INVOICE,
    fv.MEDICAL_BILL: MEDICAL_BILL,
    fv.PRESCRIPTION: PRESCRIPTION,
}

#: Values of keys that a response leaves out (an explicit null stays null).
KEY_DEFAULTS: dict[str, object] = {"currency": fv.DEFAULT_CURRENCY, "confidence": 0.0}

#: One flattened leaf of a record.  ``llm_conf`` is null when nothing in the
#: record says how sure the extractor was; ``falsy`` marks 0, 0.0 and False.
LEAF = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("key", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("llm_conf", T.DoubleType()),
    T.StructField("falsy", T.BooleanType()),
])

BBOX = _struct(*_doubles("x0", "y0", "x1", "y1"))
SOURCE = _struct(("page", T.IntegerType()), ("bbox", BBOX))
FIELD = _struct(*_strings("name", "value"), *_doubles("confidence"), ("source", SOURCE))

VALIDATION = _struct(
    ("passed_rules", T.ArrayType(T.StringType())),
    ("failed_rules", T.ArrayType(T.StringType())),
    ("notes", T.StringType()),
)

DISTRIBUTION = _struct(
    ("high", T.LongType()), ("medium", T.LongType()), ("low", T.LongType()),
    *_doubles("min_confidence", "max_confidence", "std_deviation"),
)

#: What the score was made of; only ``error`` is filled where scoring failed.
SCORING_METADATA = _struct(
    *_doubles("ocr_quality"),
    *_strings("extraction_method"),
    ("validation_passed", T.BooleanType()),
    ("weights_used", _struct(*_doubles("llm_weight", "ocr_weight", "validation_weight"))),
    *_strings("error"),
)

METADATA = _struct(
    *_strings("source_file"),
    *_doubles("ocr_quality"),
    *_strings("extraction_method"),
    *_doubles("routing_confidence"),
    ("field_count", T.LongType()),
    ("confidence_distribution", DISTRIBUTION),
    ("scoring_metadata", SCORING_METADATA),
    *_strings("error"),
)


def result_schema(id_fields: T.StructType,
                  record_types: dict[str, T.StructType] = RECORD_TYPES) -> T.StructType:
    """Schema of the published result rows, for reading them back from JSON."""
    return T.StructType(
        list(id_fields.fields)
        + [T.StructField("doc_type", T.StringType()),
           T.StructField("fields", T.ArrayType(FIELD))]
        + [T.StructField(name, schema) for name, schema in record_types.items()]
        + [T.StructField("freeform", T.StringType()),
           T.StructField("overall_confidence", T.DoubleType()),
           T.StructField("validation", VALIDATION),
           T.StructField("processing_metadata", METADATA)]
    )


def describe(schema: T.StructType) -> str:
    """A JSON description of a record type, for the request text."""

    def kind(dtype: T.DataType):
        if isinstance(dtype, T.ArrayType):
            return [kind(dtype.elementType)]
        if isinstance(dtype, T.StructType):
            return {f.name: kind(f.dataType) for f in dtype.fields}
        return "number" if isinstance(dtype, T.DoubleType) else "string"

    return json.dumps(kind(schema))
