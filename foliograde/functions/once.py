"""Columns that are worked out exactly once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


_ROW = "_once"


def with_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add costly columns so that the optimizer does not copy their expressions.

    A filter or an explode on a projected column is pushed below the projection by
    repeating the column's expression there, and again below the one before it; for a
    chain of costly columns that multiplies the work.  The output of a one-row generator is
    not repeated, while filters on other columns still reach the scan.  A generator may
    interpret its expression, so the row is made by a projection below it, which is compiled
    and works out what its columns share only once.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    kept = [name for name in df.columns if name not in columns]
    return df.select(*kept, row.alias(_ROW)).select(*kept, F.inline(F.array(_ROW)))
