"""Free-form records: JSON objects of any depth, read once for both the outcome and the leaves.

The JSON parser hands over every object when it is complete, innermost first.  At that moment
the object is turned into its leaves, with paths relative to it and the confidence its own keys
state; the enclosing object or list only puts its step in front.  So no second walk is needed.
"""

from __future__ import annotations

import gc
import json
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliograde.schemas import LEAF

# Ship the helpers below with the function, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

READ = T.StructType([
    T.StructField("json", T.StringType()),
    T.StructField("leaves", T.ArrayType(LEAF)),
    T.StructField("error", T.StringType()),
])


class _Leaves(list):
    """Leaves of one object: (path from here, key, value, stated confidence, falsy)."""


def _put(leaves: list[tuple], step: str, value: list) -> None:
    """Add the leaves of a nested object or list, behind the step that leads to them."""
    if isinstance(value, _Leaves):
        step += "."
        leaves += [(step + path, key, text, sure, falsy) for path, key, text, sure, falsy in value]
        return
    for i, item in enumerate(value):
        if isinstance(item, list):
            _put(leaves, f"{step}[{i}]", item)


def _number(value) -> float | None:
    if isinstance(value, (str, int, float)):
        try:
            return float(value)
        except ValueError:
            return None
    return None


def _object_leaves(own: dict) -> _Leaves:
    """The leaves of an object, whose objects are leaves already."""
    everyones = _number(own.get("confidence"))
    names = "\n".join(own)
    stating = "_confidence" in names or "Confidence" in names
    leaves = _Leaves()
    for key, value in own.items():
        if stating and key.endswith("_confidence"):
            continue
        if isinstance(value, str):
            if not value.strip():
                continue
            printed, falsy = value, False
        elif isinstance(value, list):
            _put(leaves, key, value)
            continue
        elif value is None:
            continue
        else:
            printed, falsy = str(value), not value
        sure = everyones
        if stating:
            stated = _number(own.get(key + "_confidence"))
            if stated is None:
                stated = _number(own.get(key + "Confidence"))
            sure = everyones if stated is None else stated
        leaves.append((key, key, printed, sure, falsy))
    return leaves


def _whole(text: str) -> str:
    """Text that can be written as UTF-8: half surrogate pairs become replacement characters."""
    return text if text.isascii() else text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


class _Reader:
    """Reads records one by one with one JSON parser."""

    def __init__(self):
        self.odd = False
        self.decoder = json.JSONDecoder(object_pairs_hook=self._object, parse_constant=self._constant)

    def _object(self, pairs: list[tuple]) -> _Leaves:
        """What the parser calls for each object; of repeated keys the last one counts."""
        own = dict(pairs)
        if len(own) < len(pairs):
            self.odd = True
        return _object_leaves(own)

    def _constant(self, name: str) -> float:
        self.odd = True
        return float(name)

    def read(self, text: str) -> tuple[str, list[tuple], str | None] | None:
        """A record's JSON, leaves and error; null if the text as a whole is no JSON value.

        Numbers that Python cannot print or convert are the record's error; nothing here stops
        the job.  The JSON is the text, or, where a stricter parser would refuse it (repeated
        keys, NaN), the same record written again.
        """
        self.odd = False
        try:
            value = self.decoder.decode(text)
            if isinstance(value, _Leaves):
                found = value
            elif isinstance(value, list):
                found = []
                for i, item in enumerate(value):
                    if isinstance(item, list):
                        _put(found, f"item_{i}", item)
            else:
                found = []
            kept = json.dumps(json.loads(text, parse_constant=str)) if self.odd else text
        except (json.JSONDecodeError, RecursionError):
            return None
        except (ValueError, OverflowError) as problem:
            return text, [], f"{type(problem).__name__}: {problem}"
        if text.isascii() and "\\u" not in text:  # then so are all its parts
            return kept, found, None
        return _whole(kept), [(_whole(p), _whole(k), _whole(v), sure, falsy) for p, k, v, sure, falsy in found], None


_LEAF_ARROW = pa.struct(list(zip(LEAF.fieldNames(), [pa.string(), pa.string(), pa.string(), pa.float64(), pa.bool_()])))
_READ_ARROW = pa.struct([("json", pa.string()), ("leaves", pa.list_(_LEAF_ARROW)), ("error", pa.string())])


def read_all(records: pa.Array) -> pa.Array:
    """``struct<json, leaves, error>`` of each text, made column by column."""
    reader = _Reader()
    kept, errors, flat, ends = [], [], [], [0]
    collecting = gc.isenabled()
    gc.disable()  # thousands of leaves, and no cycles among them
    try:
        for text in records.to_pylist():
            found = None if text is None else reader.read(text)
            whole, own, error = found or (None, (), None)
            kept.append(whole)
            errors.append(error)
            flat += own
            ends.append(len(flat))
    finally:
        if collecting:
            gc.enable()
    columns = zip(*flat) if flat else [()] * len(_LEAF_ARROW)
    leaf = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _LEAF_ARROW)], fields=list(_LEAF_ARROW))
    listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), leaf, type=_READ_ARROW.field("leaves").type)
    jsons = pa.array(kept, pa.string())
    return pa.StructArray.from_arrays([jsons, listed, pa.array(errors, pa.string())], fields=list(_READ_ARROW), mask=jsons.is_null())


@F.arrow_udf(READ)
def read(records: pa.Array) -> pa.Array:
    """``struct<json, leaves, error>`` of each text; null in, null out, without any work."""
    return read_all(records)


def leaves(record: Column) -> Column:
    return F.coalesce(read(record).getField("leaves"), F.array().cast(T.ArrayType(LEAF)))
