"""Reading values out of a record, whether typed (a struct) or free-form (a VARIANT).

Rules are written once against ``Cell`` and work on both kinds.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliograde.functions import text as tx


class Cell:
    """One value of a record.  Expressions are built only when a rule asks for them.

    ``missing``: the key is absent or null.  ``text``: the value printed.  ``number``: the
    value as a double, null if it is not one.  ``is_text``: it is a string.  ``truthy``: it
    is not empty, zero or false.
    """

    missing: Column
    text: Column
    number: Column
    is_text: Column
    truthy: Column

    @cached_property
    def blank(self) -> Column:
        return self.missing | (self.is_text & ~tx.has_text(self.text))


class TextCell(Cell):
    def __init__(self, value: Column):
        self.text = value

    @cached_property
    def missing(self) -> Column:
        return self.text.isNull()

    @cached_property
    def number(self) -> Column:
        return tx.to_number(self.text)

    @cached_property
    def is_text(self) -> Column:
        return F.lit(True)

    @cached_property
    def truthy(self) -> Column:
        return F.coalesce(F.length(self.text) > 0, F.lit(False))


class NumberCell(Cell):
    def __init__(self, value: Column):
        self.number = value

    @cached_property
    def missing(self) -> Column:
        return self.number.isNull()

    @cached_property
    def text(self) -> Column:
        return tx.float_text(self.number)

    @cached_property
    def is_text(self) -> Column:
        return F.lit(False)

    @cached_property
    def truthy(self) -> Column:
        return F.coalesce(self.number != 0, F.lit(False))


_PLAIN_NUMBER = r"-?[0-9]+(?:\.[0-9]+)?"
_OPEN_KIND = r"^(?:-?[0-9]|-?Infinity$|NaN$|true$|false$|[\[{])"


class VariantCell(Cell):
    """A value below a VARIANT.

    Asking for the kind of a VARIANT builds a schema text, so that is done only where the
    printed value leaves the kind open.
    """

    def __init__(self, record: Column, name: str | None = None):
        """The value of a key of ``record``, or ``record`` itself."""
        self.record, self.path = record, "$" if name is None else f"$['{name}']"

    def get(self, kind: str) -> Column:
        """The value read as a Spark type; null if it cannot be."""
        return F.try_variant_get(self.record, self.path, kind)

    @cached_property
    def value(self) -> Column:
        return self.record if self.path == "$" else self.get("variant")

    @cached_property
    def printed(self) -> Column:
        return self.get("string")

    @cached_property
    def kind(self) -> Column:
        return F.coalesce(F.schema_of_variant(self.value), F.lit("VOID"))

    @cached_property
    def missing(self) -> Column:
        return self.printed.isNull()

    @cached_property
    def blank(self) -> Column:
        return ~tx.has_text(self.printed)

    @property
    def open_kind(self) -> Column:
        """The printed value could be of several kinds."""
        return self.printed.rlike(_OPEN_KIND)

    @property
    def odd_kind(self) -> Column:
        """The printed value could be of several kinds and is no plain number."""
        return self.printed.rlike(rf"^(?!{_PLAIN_NUMBER}$){_OPEN_KIND[1:]}")

    @cached_property
    def is_text(self) -> Column:
        return F.when(self.missing, False).when(self.open_kind, self.kind == "STRING").otherwise(True)

    @cached_property
    def text(self) -> Column:
        is_bool = self.printed.isin("true", "false") & (self.kind == "BOOLEAN")
        return F.when(is_bool, F.initcap(self.printed)).otherwise(self.printed)

    @cached_property
    def number(self) -> Column:
        return (
            F.when(self.missing, F.lit(None).cast("double"))
            .when(self.printed.rlike(rf"^{_PLAIN_NUMBER}$"), self.printed.try_cast("double"))
            .when(self.is_text, tx.to_number(self.printed))
            .when(self.kind == "BOOLEAN", self.get("boolean").cast("double"))
            .otherwise(self.get("double"))
        )

    @cached_property
    def truthy(self) -> Column:
        open_kind = self.printed.rlike(r"^(?:-?0+(?:\.0+)?|false|\[\]|\{\})$")
        return (
            F.when(self.missing | (self.printed == ""), False)
            .when(open_kind, self.kind == "STRING")
            .otherwise(True)
        )


class SeenCell(VariantCell):
    """A VARIANT that has been printed already: ``struct<raw, printed>`` as ``seen`` makes it."""

    def __init__(self, seen: Column):
        super().__init__(seen["raw"])
        self.printed, self.kind = seen["printed"], seen["kind"]


def seen(raw: Column, as_number: bool = False) -> Column:
    """A VARIANT beside its printed value and its kind, the latter only where the printed value leaves it open.

    Who only reads it as a number (``as_number``) needs no kind for what is printed as a plain one.
    """
    cell = VariantCell(raw)
    kind = F.when(raw.isNotNull() & (cell.odd_kind if as_number else cell.open_kind), cell.kind)
    return F.struct(raw.alias("raw"), cell.printed.alias("printed"), kind.alias("kind"))


class AbsentCell(Cell):
    @cached_property
    def missing(self) -> Column:
        return F.lit(True)

    @cached_property
    def text(self) -> Column:
        return F.lit(None).cast("string")

    @cached_property
    def number(self) -> Column:
        return F.lit(None).cast("double")

    @cached_property
    def is_text(self) -> Column:
        return F.lit(False)

    @cached_property
    def truthy(self) -> Column:
        return F.lit(False)


class TypedRecord:
    def __init__(self, record: Column, schema: T.StructType):
        self.record, self.schema = record, schema

    def cell(self, name: str) -> Cell:
        if name not in self.schema.fieldNames():
            return AbsentCell()
        text = isinstance(self.schema[name].dataType, T.StringType)
        return (TextCell if text else NumberCell)(self.record.getField(name))

    def elements(self, name: str) -> Column:
        if name not in self.schema.fieldNames():
            return F.array()
        return F.coalesce(self.record.getField(name), F.array())

    def element(self, name: str, item: Column) -> "TypedRecord":
        return TypedRecord(item, self.schema[name].dataType.elementType)


class FreeRecord:
    """A JSON object of any shape, held as a VARIANT."""

    def __init__(self, record: Column):
        self.record = record

    def cell(self, name: str) -> Cell:
        return VariantCell(self.record, name)

    def elements(self, name: str) -> Column:
        listed = F.try_variant_get(self.record, f"$['{name}']", "array<variant>")
        return F.coalesce(listed, F.array().cast("array<variant>"))

    def element(self, name: str, item: Column) -> "FreeRecord":
        return FreeRecord(item)
