"""Documents and reference items by the Jaccard similarity of their character sets.

A character set is held in a few numbers: one bit each for the 128 ASCII characters, in two words, and a list of the
others.  Shared characters are then counted by ``bit_count``.  Documents with the same set are compared once, however
many there are, and only with items whose set is of a size that can reach the similarity asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograde.functions.once import with_once

def _bits(characters: Column, low: int) -> Column:
    """A word with a bit for each of the characters from ``low`` to ``low + 63``."""
    own = F.filter(characters, lambda c: F.ascii(c).between(low, low + 63))
    return F.aggregate(own, F.lit(0).cast("long"), lambda word, c: word.bitwiseOR(
        F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(c) - low)))


def with_characters(df: DataFrame, text: str) -> DataFrame:
    """Add the set of the lower-cased characters of a text: ``low``, ``high``, ``others`` and ``size``; empty if it is null."""
    df = with_once(df, {"_chars": F.array_distinct(F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), ""), lambda c: c != ""))})
    return with_once(df, {
        "low": _bits(F.col("_chars"), 0), "high": _bits(F.col("_chars"), 64),
        "others": F.sort_array(F.filter("_chars", lambda c: ~F.ascii(c).between(0, 127))), "size": F.size("_chars")}).drop("_chars")


def best_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text",
               least: float = 0.5) -> DataFrame:
    """The most similar item of each document: the ids and ``similarity``, ties to the smaller item id.

    ``docs`` and ``items`` hold an id and a text.  Every item is compared with a document's set unless its size alone
    keeps it below ``least``: two sets of n and m characters reach at most min(n, m) / max(n, m).  Documents without
    characters, or without an item that reaches ``least``, have no row; items with the same set differ by id only.
    """
    keys = ["low", "high", "others", "size"]
    sets = with_characters(docs.select(doc_id, text), text).where("size > 0").select(doc_id, *keys)
    known = with_characters(items.select(item_id, text), text).where("size > 0").groupBy(*keys).agg(F.min(item_id).alias(item_id))
    sizes = known.select(F.array_distinct(F.array_agg("size")).alias("sizes"))
    near = F.filter(F.coalesce(F.col("sizes"), F.array().cast("array<int>")), lambda m: F.least(m, F.col("size")) >= least * F.greatest(m, F.col("size")))
    one = sets.select(*keys).distinct().withColumn("sizes", sizes.scalar()).select(*keys, F.explode(near).alias("item_size"))
    other = known.select(item_id, *[F.col(k).alias(f"item_{k}") for k in keys])
    both = one.join(other, "item_size")
    shared = (F.bit_count(F.col("low").bitwiseAND(F.col("item_low"))) + F.bit_count(F.col("high").bitwiseAND(F.col("item_high")))
              + F.when((F.size("others") > 0) & (F.size("item_others") > 0), F.size(F.array_intersect("others", "item_others"))).otherwise(0))
    scored = both.select(*keys, item_id, (shared / (F.col("size") + F.col("item_size") - shared)).alias("similarity")).where(F.col("similarity") >= least)
    best = scored.groupBy(*keys).agg(F.min(F.struct((-F.col("similarity")).alias("less"), F.col(item_id))).alias("best"))
    return sets.join(best, keys).select(doc_id, f"best.{item_id}", (-F.col("best.less")).alias("similarity"))

