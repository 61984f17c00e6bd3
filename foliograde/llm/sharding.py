"""Shards of equal size that keep linked documents together: balanced label propagation.

Documents with equal texts are linked.  Members of one group are interchangeable, so the propagation works
on cells, one row for each group and shard with the number of members there; a group has one cell per shard
at most, however many members it has.  In each round the cells of a group move towards the shard where most
of their group is, as far as the free places of that shard go; larger gains first.  Documents without a link
then fill all shards to sizes (in rows) at most one apart.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliograde.llm.common import discard, root_of, running_before, saved


def _at(values: list[int], shard: Column) -> Column:
    return F.element_at(F.lit(values), shard + 1)


def _slot_of(ends: list[int], position: Column) -> Column:
    """The first interval that ends after the position."""
    return F.size(F.filter(F.lit(ends), lambda end: end <= position))


def _loads(cells: DataFrame, shards: int) -> list[int]:
    found = {row.shard: row.n for row in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # a row per shard
    return [found.get(j, 0) for j in range(shards)]


def _movers(cells: DataFrame, free: list[int], most: int) -> DataFrame:
    """Cells that want to join a larger cell of their group in a shard with free places."""
    group = Window.partitionBy("key")
    ranked = group.orderBy(F.desc("open"), F.desc("n"), F.desc("tie"), "shard")
    cells = (
        cells.withColumn("open", _at(free, F.col("shard")) > 0)
        .withColumn("tie", F.xxhash64("key", "shard"))
        .withColumn("rank", F.row_number().over(ranked) - 1)
        .withColumn("homes", F.greatest(F.lit(1), F.least(
            F.ceil(F.sum("n").over(group) / F.lit(most)).cast("int"),
            F.sum(F.col("open").cast("int")).over(group).cast("int"))))
        .withColumn("cells", F.collect_list(F.struct("shard", "n", "open")).over(
            ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .withColumn("home", F.element_at("cells", F.col("rank") % F.col("homes") + 1))
    )
    return cells.where((F.col("rank") >= F.col("homes")) & F.col("home.open") & (F.col("home.n") >= F.col("n"))).select(
        "key", "shard", "n", F.col("home.shard").alias("target"), F.col("home.n").alias("gain"))


def _round(cells: DataFrame, free: list[int], most: int, buckets: int) -> tuple[DataFrame, bool]:
    movers = saved(_movers(cells, free, most).withColumn(
        "bucket", (F.lit(64) - F.floor(F.log2("gain"))) * buckets + F.pmod(F.xxhash64("key"), F.lit(buckets))), "movers")
    if movers.isEmpty():
        discard(movers)
        return cells, False
    asked = running_before(movers, ["target"], "bucket", ["key", "shard"], "n", "before")
    granted = asked.withColumn("n", F.least("n", F.greatest(F.lit(0), _at(free, F.col("target")) - F.col("before")))).where("n > 0")
    moves = granted.select("key", F.explode(F.array(
        F.struct(F.col("shard"), (-F.col("n")).alias("n")), F.struct(F.col("target").alias("shard"), F.col("n")))).alias("m"))
    after = saved(
        cells.select("key", "shard", "n").unionByName(moves.select("key", "m.shard", "m.n"))
        .groupBy("key", "shard").agg(F.sum("n").alias("n")).where("n > 0"), "cells")
    discard(movers, cells)
    return after, True


def _fitted(cells: DataFrame, load: list[int], cap: list[int], buckets: int) -> tuple[DataFrame, list[int]]:
    """Cells cut to the shards' places, what is too much put where places are left; and the places left then."""
    if all(a <= b for a, b in zip(load, cap)):
        return cells, [b - a for a, b in zip(load, cap)]
    cells = cells.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    cut = running_before(cells, ["shard"], "bucket", ["key"], "n", "before").withColumn(
        "kept", F.least("n", F.greatest(F.lit(0), _at(cap, F.col("shard")) - F.col("before"))))
    cut = saved(cut.select("key", "shard", "kept", (F.col("n") - F.col("kept")).alias("over"), "bucket"), "cut")
    kept = cut.select("key", "shard", F.col("kept").alias("n")).where("n > 0")
    left = [b - a for a, b in zip(_loads(kept, len(cap)), cap)]
    ends = list(accumulate(left))
    starts = [0, *ends[:-1]]
    over = running_before(cut.where("over > 0").withColumn("all", F.lit(0)), ["all"], "bucket", ["key", "shard"], "over", "at")
    till = F.col("at") + F.col("over")
    spread = (
        over.withColumn("to", F.explode(F.sequence(_slot_of(ends, F.col("at")), _slot_of(ends, till - 1))))
        .select("key", F.col("to").alias("shard"), (F.least(till, _at(ends, F.col("to"))) - F.greatest("at", _at(starts, F.col("to")))).alias("n"))
        .where("n > 0")
    )
    fitted = saved(kept.unionByName(spread).groupBy("key", "shard").agg(F.sum("n").alias("n")), "fitted")
    return fitted, [b - a for a, b in zip(_loads(fitted, len(cap)), cap)]


def shard_documents(docs: DataFrame, shards: int = 40, rounds: int = 6) -> DataFrame:
    """Give every row of ``docs`` (doc_id, text) a shard and a place in it.

    Returns doc_id, size (bytes of the text and 16 more), text_crc32, law (``rows``: shards differ by one row at
    most), shard, slot (from 0, without gaps, by bucket and doc_id) and grown_shard (null: the law is not ``key``).
    A null text counts as an empty one; rows with the same id each get a slot; no rows give no rows; other columns
    are not read.  The same rows give the same shards at every run.
    """
    rows = saved(docs.select(
        F.col("doc_id"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("key")), "rows")
    total = rows.count()
    cap = [total // shards + (j < total % shards) for j in range(shards)]
    buckets = root_of(total)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))

    started = rows.groupBy("key", F.pmod(F.xxhash64("doc_id", F.lit("start")), F.lit(shards)).cast("int").alias("shard")).agg(F.count("*").alias("n"))
    cells = saved(started.withColumn("members", F.sum("n").over(Window.partitionBy("key"))).where("members > 1").drop("members"), "cells")
    load = _loads(cells, shards)
    for _ in range(rounds):
        cells, moved = _round(cells, [max(0, b - a) for a, b in zip(load, cap)], max(1, cap[0]), buckets)
        if not moved:
            break
        load = _loads(cells, shards)
    cells, left = _fitted(cells, load, cap, buckets)

    ends = Window.partitionBy("key").orderBy("shard")
    places = (
        cells.withColumn("end", F.sum("n").over(ends)).groupBy("key")
        .agg(F.sort_array(F.collect_list(F.struct("end", "shard"))).alias("places"))  # a place per shard
    )
    by_bucket = rows.groupBy("key", "bucket").agg(F.count("*").alias("n"))
    offsets = (
        by_bucket.withColumn("offset", F.sum("n").over(Window.partitionBy("key").orderBy("bucket")) - F.col("n")).drop("n")
        .join(places, "key")
    )
    local = F.row_number().over(Window.partitionBy("key", "bucket").orderBy("doc_id")) - 1
    ranked = rows.withColumn("local", local).join(offsets, ["key", "bucket"], "left")
    member = F.col("offset") + F.col("local")
    ranked = saved(ranked.select(
        "doc_id", "size", "text_crc32", "bucket",
        F.filter("places", lambda place: place["end"] > member)[0]["shard"].alias("shard"), F.lit(1).alias("one"), F.lit(0).alias("all")), "ranked")
    linked = ranked.where("shard IS NOT NULL")
    single = running_before(ranked.where("shard IS NULL"), ["all"], "bucket", ["doc_id"], "one", "at").withColumn(
        "shard", _slot_of(list(accumulate(left)), F.col("at")))
    placed = saved(linked.unionByName(single.drop("at")), "placed")
    discard(ranked)
    slots = running_before(placed, ["shard"], "bucket", ["doc_id", "text_crc32", "size"], "one", "slot")
    return slots.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
