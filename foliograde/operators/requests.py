"""Request tables for a model, and the hook that applies one to them."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliograde import fixed_values as fv
from foliograde.functions import text as tx
from foliograde.schemas import RECORD_TYPES, describe

# Ship the hook with its closure, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def routing_requests(df: DataFrame, *ids: str, text: str = "text") -> DataFrame:
    """``system`` and ``user`` text per document with any text."""
    cut = tx.truncate(F.col(text), fv.ROUTING_TEXT_LIMIT, "...")
    return df.filter(tx.has_text(F.col(text))).select(
        *ids, F.lit(fv.ROUTING_SYSTEM_PROMPT).alias("system"),
        F.concat(F.lit(fv.ROUTING_USER_PROMPT), cut).alias("user"))


def extraction_requests(df: DataFrame, *ids: str, text: str = "text", tables: str | None = None,
                        record_types: dict[str, T.StructType] = RECORD_TYPES) -> DataFrame:
    """``system`` and ``user`` text per document of a known type.

    The texts per type are a handful of literals, chosen by ``doc_type`` within the row.
    """
    system = user_tail = F
    for name, schema in record_types.items():
        prompt = fv.EXTRACTION_BASE_PROMPT + fv.EXTRACTION_TYPE_PROMPTS.get(name, "")
        system = system.when(F.col("doc_type") == name, prompt)
        user_tail = user_tail.when(F.col("doc_type") == name, (
            f"\n\nReturn a JSON object of this shape: {describe(schema)}\n\n"
            f"{fv.EXTRACTION_REQUEST_CLOSING}\n"))
    rendered = F.lit(fv.NO_TABLES) if tables is None else F.coalesce(F.col(tables), F.lit(fv.NO_TABLES))
    user = F.concat(
        F.lit("\nDocument Text:\n"), tx.truncate(F.col(text), fv.EXTRACTION_TEXT_LIMIT),
        F.lit("\n\nTable Data:\n"), rendered, user_tail)
    return df.filter(F.col("doc_type").isin(list(record_types))).select(
        *ids, "doc_type", system.alias("system"), user.alias("user"))


def fallback_requests(df: DataFrame, *ids: str, text: str = "text") -> DataFrame:
    """The simpler second request, for documents whose first reply was rejected."""
    user = tx.filled(fv.FALLBACK_REQUEST, doc_type=F.col("doc_type"), text=tx.truncate(F.col(text), fv.FALLBACK_TEXT_LIMIT))
    return df.select(*ids, "doc_type", user.alias("user"))


def apply_model(requests: DataFrame, reply: Callable[[pd.DataFrame], pd.Series],
                *ids: str) -> DataFrame:
    """Replies of a caller-supplied function to a request table, batch by batch.

    ``reply`` gets a batch of requests and returns one text per row.  It runs in the
    executors' Python workers and must give the same answer if a batch is run again.
    """
    kept = requests.select(*ids).schema
    schema = T.StructType(kept.fields + [T.StructField("response", T.StringType())])

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = frame[list(ids)].copy()
            out["response"] = reply(frame)
            yield out

    return requests.mapInPandas(batches, schema)


def rendered_tables(tables: Column) -> Column:
    """Tables as text: page, headers and the first rows of each.

    ``tables`` is an array of ``struct<page, table_index, headers, rows>``.
    """
    shown = fv.RENDERED_TABLE_ROWS

    def one(t: Column, i: Column) -> Column:
        rows = F.transform(F.slice(t["rows"], 1, shown), lambda r, j: tx.filled(
            fv.TABLE_ROW, number=j + 1, cells=F.array_join(r, ", ", "None")))
        more = F.size(t["rows"]) - shown
        return F.concat(
            tx.filled(fv.TABLE_TITLE, number=i + 1, page=t["page"]),
            F.when(F.size(t["headers"]) > 0, tx.filled(
                fv.TABLE_HEADERS, headers=F.array_join(t["headers"], ", ", ""))).otherwise(""),
            F.array_join(rows, ""),
            F.when(more > 0, tx.filled(fv.TABLE_MORE_ROWS, count=more)).otherwise(""),
        )

    return F.when(F.size(tables) > 0, F.array_join(F.transform(tables, one), "\n")).otherwise(fv.NO_TABLES)
