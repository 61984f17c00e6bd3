"""A mix of sources that meets target weights: whole epochs first, then weighted sampling without replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliograde.llm.common import PLAIN_WORD, discard, root_of, saved

#: Above this many sources their table is joined by shuffle instead of broadcast (about 200 bytes a source).
BROADCAST_SOURCES = 100_000


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(PLAIN_WORD)), F.lit(0)).cast("long")


def quality_of(text: Column) -> Column:
    """Share of letters among the characters that are no white space, from 0.05 for junk to 1; empty text: 0.05."""
    seen = F.length(F.regexp_replace(text, "\\s+", ""))
    letters = F.length(F.regexp_replace(text, "[^\\p{L}]+", ""))
    return F.greatest(F.lit(0.05), F.coalesce(F.try_divide(letters, seen), F.lit(0.0)))


def _sampling_key(quality: Column, seed: int) -> Column:
    """Exponential key of Efraimidis and Spirakis: the smaller, the sooner taken; heavier documents get smaller ones."""
    bits = F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit(seed)), 11)
    return -F.log((bits + F.lit(0.5)) / F.lit(float(2**53))) / quality


def _with_source(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_source", F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name")))


def targets(sizes: DataFrame, weights: tuple[float, ...], factor: float, most: float) -> DataFrame:
    """Share ``factor`` of all words by weight; a source stops at ``most`` times its size and the rest is shared again.

    ``sizes``: one row per source (_source, source_size).  Sources are ranked in one task: a row per source only.
    """
    ranked = sizes.withColumn("weight", F.element_at(
        F.lit([float(w) for w in weights]), (F.row_number().over(Window.orderBy("_source")) - 1) % len(weights) + 1)).withColumn(
        "cap", F.col("source_size") * F.lit(float(most)))
    filled = Window.orderBy(F.col("cap") / F.col("weight"), "_source")
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    level = (F.sum("source_size").over(every) * F.lit(float(factor)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("level", level).withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
    shared = F.max(F.when(~F.col("full"), F.col("level"))).over(every)
    return ranked.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.least(F.col("cap"), shared * F.col("weight")))).select(
        "_source", "source_size", "target")


_STEPS = "array<struct<fits:long,cutoff:double>>"
_PARTS = "array<struct<key:double,take:long,whole:boolean>>"


def _cutoffs(rows: DataFrame, sources: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """For each round a table (_source, left, cutoff, part): documents that fit into ``left`` words and whose key is at
    most ``cutoff`` are taken, and so many (take) of the equal rows that share the key of ``part``; what still fits is
    tried again in the next round, until nothing does.  And a table (_source, last): the key of one more document that
    brings the source nearer to its target, if there is one, and whether it is the only one with that key.

    Rows that are repeated in full share a key; they are counted before they move, so no group of them is large.
    """
    open_rows = rows.where("size > 0").groupBy("_source", "key", "size").agg(F.count("*").alias("n"))
    open_rows = open_rows.join(F.broadcast(sources) if sources.count() <= BROADCAST_SOURCES else sources, "_source").where("epochs < 2 AND left > 0")
    buckets = root_of(rows.count())
    open_rows = open_rows.select("_source", "size", "key", "n", F.floor((1 - F.exp(-F.col("key"))) * buckets).cast("int").alias("bucket"), "left")
    found, written = [], []
    while True:
        tried = saved(open_rows.select("_source", "size", "key", "n", "bucket", "left"), "open")
        written.append(tried)
        fit = tried.where("size <= left").withColumn("words", F.col("size") * F.col("n"))
        if fit.isEmpty():
            break
        sums = fit.groupBy("_source", "bucket").agg(F.sum("words").alias("sum"))
        offsets = sums.select("_source", "bucket", (F.sum("sum").over(Window.partitionBy("_source").orderBy("bucket")) - F.col("sum")).alias("offset"))
        local = F.sum("words").over(Window.partitionBy("_source", "bucket").orderBy("key").rangeBetween(Window.unboundedPreceding, 0))
        placed = fit.withColumn("local", local).join(offsets, ["_source", "bucket"])
        free = F.col("left") - (F.col("offset") + F.col("local") - F.col("words"))
        placed = placed.withColumn("take", F.least(F.col("n"), F.floor(free / F.col("size")))).where("take > 0")
        whole = F.col("take") == F.col("n")
        cut = saved(placed.groupBy("_source", "left").agg(
            F.coalesce(F.max(F.when(whole, F.col("key"))), F.lit(-1.0)).alias("cutoff"),
            F.max(F.when(~whole, F.struct("key", "take", F.lit(False).alias("whole")))).alias("part"),
            F.sum(F.col("take") * F.col("size")).alias("took")), "cut")
        found.append(cut)
        after = cut.select("_source", "cutoff", F.col("part.key").alias("part_key"), F.col("part.take").alias("part_take"), (F.col("left") - F.col("took")).alias("after"))
        after = F.broadcast(after) if after.count() <= BROADCAST_SOURCES else after
        rest = F.col("n") - F.when(F.col("key") == F.col("part_key"), F.col("part_take")).otherwise(0)
        open_rows = tried.join(after, "_source", "left").where("cutoff IS NULL OR key > cutoff OR size > left").select(
            "_source", "size", "key", rest.alias("n"), "bucket", F.coalesce("after", "left").alias("left")).where("left > 0")
    nearer = tried.where("size < 2 * left").groupBy("_source").agg(
        F.min_by(F.struct("key", F.lit(1).cast("long").alias("take"), (F.col("n") == 1).alias("whole")), F.struct(F.abs(F.col("size") - F.col("left")), "key")).alias("last"))
    nearer = saved(nearer, "last")
    discard(*written)
    return found, nearer


def _numbered(rows: DataFrame) -> DataFrame:
    """Add ``_nth``: 1, 2, ... among the rows of a source with one key.  They are equal, so any order will do; a group of
    any size is numbered in the tasks that hold its rows."""
    held = saved(rows.withColumn("_task", F.spark_partition_id()), "equal-rows")
    per_task = held.groupBy("_source", "_key", "_task").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_source", "_key").orderBy("_task")) - F.col("_n")
    offsets = per_task.select("_source", "_key", "_task", before.alias("_before"))
    local = F.row_number().over(Window.partitionBy("_source", "_key", "_task").orderBy("_size"))
    return held.withColumn("_local", local).join(offsets, ["_source", "_key", "_task"]).withColumn(
        "_nth", F.col("_before") + F.col("_local")).drop("_before", "_local", "_task")


def mixed(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), factor: float = 1.5, most: float = 2.0,
          seed: int = 17) -> DataFrame:
    """Say of every row of ``docs`` (doc_id, text, source) how often the mix takes it.

    Returns ``row`` (all columns of the input as one struct, so names never clash), size in words, source_size and
    target of its source, and copies.

    Every document is taken as often as whole epochs fit the target.  The rest of the target is drawn without
    replacement: keys of Efraimidis and Spirakis from a hash of id and text, scaled by a quality weight, sorted in
    each source and summed up to the words left; documents too large for what is left are passed over and smaller
    ones tried in further rounds, until none fits.  A round is kept as one cutoff per source, so the choice is a function
    of the row, and reruns agree.  Null source: a source of its own, last; null or empty text: size 0; a source without
    words has target 0; rows that are repeated in full share one key, and as many of them are taken as fit, whichever;
    no rows give no rows.
    """
    size, key = words_of(F.col("text")), _sampling_key(quality_of(F.col("text")), seed)
    rows = saved(_with_source(docs).select("doc_id", "_source", size.alias("size"), key.alias("key")), "sizes")
    sources, rounds_found = _plan(rows, weights, factor, most)
    whole = docs.select("doc_id", "text", "source", F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    return _decided(_with_source(whole).withColumn("_size", size).withColumn("_key", key), sources, rounds_found).select(
        "row", "size", "source_size", "target", "copies")


def _plan(rows: DataFrame, weights, factor, most) -> tuple[DataFrame, tuple[list[DataFrame], DataFrame]]:
    sizes = rows.groupBy("_source").agg(F.sum("size").alias("source_size"))
    sources = targets(sizes, weights, factor, most).withColumn(
        "epochs", F.least(F.lit(int(most)), F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0))).cast("long"))
    sources = saved(sources.withColumn("left", F.greatest(F.lit(0), F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))), "sources")
    return sources, _cutoffs(rows, sources.select("_source", "epochs", "left"))


def _decided(whole: DataFrame, sources: DataFrame, rounds_found: tuple[list[DataFrame], DataFrame]) -> DataFrame:
    """Copies of each row from the cutoffs of its source; ``whole`` has _source, _size and _key."""
    cuts, last = rounds_found
    none, no_parts = F.array().cast(_STEPS), F.array().cast(_PARTS)
    plan = sources.join(last, "_source", "left").withColumn("steps", none).withColumn("parts", no_parts)
    for cut in cuts:
        step = cut.groupBy("_source").agg(F.first(F.struct(F.col("left").alias("fits"), "cutoff")).alias("step"), F.first("part").alias("part"))
        plan = plan.join(step, "_source", "left").withColumn("steps", F.concat("steps", F.array_compact(F.array("step")).cast(_STEPS))).withColumn(
            "parts", F.concat("parts", F.array_compact(F.array("part")).cast(_PARTS))).drop("step", "part")
    plan = plan.withColumn("parts", F.concat("parts", F.array_compact(F.array("last")).cast(_PARTS)))
    plan = saved(plan.select("_source", "source_size", "target", "epochs", "steps", "parts"), "plan")
    small = plan.count() <= BROADCAST_SOURCES
    drawn = F.exists("steps", lambda step: (F.col("_size") <= step["fits"]) & (F.col("_key") <= step["cutoff"]))
    own = F.filter("parts", lambda part: part["key"] == F.col("_key"))
    joined = whole.join(F.broadcast(plan) if small else plan, "_source")
    partial = ~F.forall(own, lambda part: part["whole"])
    alone = joined.withColumn("copies", F.col("epochs") + (drawn | (F.size(own) > 0)).cast("long"))
    shared = plan.where(F.exists("parts", lambda part: ~part["whole"]))
    if not shared.isEmpty():  # of some equal rows only a number is taken
        take = F.aggregate(own, F.lit(0).cast("long"), lambda n, part: n + part["take"])
        some = _numbered(joined.where(partial)).withColumn("copies", F.col("epochs") + (drawn | (F.col("_nth") <= take)).cast("long"))
        alone = alone.where(~partial).unionByName(some.drop("_nth"))
    return alone.drop("_source", "_key", "epochs", "steps", "parts").withColumnRenamed("_size", "size")


def mix_report(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), factor: float = 1.5, most: float = 2.0,
               seed: int = 17) -> DataFrame:
    """The mix without texts: doc_id, size, source_size, target and taken (words, repeats counted); see ``mixed``."""
    facts = _with_source(docs).select(
        "doc_id", "_source", words_of(F.col("text")).alias("size"), _sampling_key(quality_of(F.col("text")), seed).alias("key"))
    rows = saved(facts, "sizes")
    sources, rounds_found = _plan(rows, weights, factor, most)
    decided = _decided(rows.withColumnRenamed("size", "_size").withColumnRenamed("key", "_key"), sources, rounds_found)
    return decided.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with the columns of ``docs``."""
    taken = mixed(docs, **options).where("copies > 0")
    return taken.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("row.*")
