"""Documents that hold passages of a benchmark: winnowed fingerprints, extended to whole windows.

Words are runs of ASCII letters and digits and of characters from U+0080 on; A-Z count as a-z.  A window is ten
words of an item, or all words of a shorter one.  Of the hashes of the k-grams in a window the least is kept, on
both sides; texts that share a window share its least hash, so no shared window is missed.  A first pass over the
documents keeps those that share a fingerprint with the benchmark; a second one, over these only, extends each
shared fingerprint to the words of its window and compares them as text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograde.functions.once import with_once
from foliograde.llm.common import ALNUM_WORD, ALNUM_WORD_ANY_CASE, ascii_lower, saved

#: Most rows of a side that is broadcast (fingerprints 8 bytes, windows about 100 bytes, keys 16 bytes a row).
BROADCAST_ROWS = 400_000


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(ALNUM_WORD), F.lit(0))


def fingerprinted(df: DataFrame, window: int, gram: int) -> DataFrame:
    """Add ``prints``: for each window of ``words``, in order, the least hash of its k-grams; null if there is none."""
    gram = min(gram, window)
    width = window - gram + 1
    grams = F.transform(F.sequence(F.lit(1), F.size("words") - (gram - 1)), lambda i: F.xxhash64(*[F.get("words", i + (j - 1)) for j in range(gram)]))
    least = F.transform(F.sequence(F.lit(1), F.size("grams") - (width - 1)), lambda i: F.array_min(F.slice("grams", i, width)))
    df = with_once(df, {"grams": F.when(F.size("words") >= window, grams)})
    return with_once(df, {"prints": F.when(F.col("grams").isNotNull(), least)}).drop("grams")


def _sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def benchmark_windows(benchmark: DataFrame, window: int = 10, gram: int = 4) -> tuple[DataFrame, list[int]]:
    """Distinct windows of all items (length, print, passage, items) and the lengths there are (``window`` at most)."""
    items = saved(benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("words")).where(F.size("words") > 0), "items")
    lengths = sorted(r[0] for r in items.select(F.least(F.size("words"), F.lit(window))).distinct().collect())  # ``window`` values at most
    every = []
    for length in lengths:
        whole = items.where(F.size("words") >= window if length == window else F.size("words") == length)
        at = fingerprinted(whole, length, gram).select("item", "words", F.posexplode("prints").alias("at", "print"))
        every.append(at.select(F.lit(length).alias("length"), "print", F.array_join(F.slice("words", F.col("at") + 1, length), " ").alias("passage"), "item"))
    if not every:
        empty = items.select(F.lit(0).alias("length"), F.lit(0).cast("long").alias("print"), F.lit("").alias("passage"), "item").limit(0)
        every = [empty]
    found = reduce(DataFrame.unionByName, every).groupBy("length", "print", "passage").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return saved(found, "windows"), lengths


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, gram: int = 4) -> DataFrame:
    """For every row of ``docs`` (doc_id, text) what it shares with ``benchmark`` (item_id, text).

    Returns doc_id, doc_key (of id and text), n_words, n_hit (words inside a shared window), items (the ids, sorted
    as strings) and spans (from, to: the hit windows as word positions).  Null and empty texts have no words and no
    hits; items without words match nothing; a null item id counts in no list; rows repeated in full get equal
    results; an empty benchmark leaves all documents clean.
    """
    keyed = docs.select("doc_id", "text", F.unhex(F.md5(F.concat_ws("\x00", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))))).alias("doc_key"))
    windows, lengths = benchmark_windows(benchmark, window, gram)
    n_windows = windows.count()
    prints = _sized(windows.select("length", "print").distinct(), n_windows)
    tokens = with_once(keyed, {"words": words_of(F.col("text"))}).select("doc_key", "words")
    shared = [
        fingerprinted(tokens, length, gram).select("doc_key", F.explode(F.array_distinct("prints")).alias("print"))
        .join(prints.where(F.col("length") == length).drop("length"), "print", "left_semi").select("doc_key")
        for length in lengths
    ] or [keyed.select("doc_key").limit(0)]
    candidates = saved(reduce(DataFrame.unionByName, shared).distinct(), "candidates")
    near = with_once(
        keyed.join(_sized(candidates, candidates.count()), "doc_key", "left_semi"), {"words": words_of(F.col("text"))}).select("doc_key", "words")
    known = _sized(windows.select("length", "print", "passage", F.xxhash64("items").alias("owners")), n_windows)
    hits = [
        fingerprinted(near, length, gram).select("doc_key", "words", F.posexplode("prints").alias("at", "print"))
        .select("doc_key", "at", "print", F.array_join(F.slice("words", F.col("at") + 1, length), " ").alias("passage"))
        .join(known.where(F.col("length") == length), ["print", "passage"])
        .select("doc_key", F.struct(F.col("at").alias("from"), (F.col("at") + F.lit(length)).alias("to")).alias("span"), "owners")
        for length in lengths
    ] or [keyed.select("doc_key", F.struct(F.lit(0).alias("from"), F.lit(0).alias("to")).alias("span"), F.lit(0).cast("long").alias("owners")).limit(0)]
    hits = saved(reduce(DataFrame.unionByName, hits).distinct(), "hits")
    spans = hits.groupBy("doc_key").agg(F.sort_array(F.collect_set("span")).alias("spans"))
    owners = windows.select(F.xxhash64("items").alias("owners"), "items").distinct()
    items = (
        hits.select("doc_key", "owners").distinct().join(_sized(owners, n_windows), "owners")
        .select("doc_key", F.explode("items").alias("item")).groupBy("doc_key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    counts = keyed.select("doc_id", "doc_key", F.coalesce(F.regexp_count("text", F.lit(ALNUM_WORD_ANY_CASE)), F.lit(0)).cast("long").alias("n_words"))
    return counts.join(spans.join(items, "doc_key", "left"), "doc_key", "left").select(
        "doc_id", "doc_key", "n_words", F.coalesce(_covered(F.col("spans")), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), "spans")


def _covered(spans: Column) -> Column:
    """Words inside any of the sorted spans: each adds what lies beyond the furthest end so far."""
    return F.aggregate(
        spans, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda done, span: F.struct(
            (done["n"] + F.greatest(F.lit(0), span["to"] - F.greatest(span["from"], done["end"]))).alias("n"),
            F.greatest(done["end"], span["to"]).alias("end")),
        lambda done: done["n"])


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = 10, gram: int = 4) -> DataFrame:
    """The rows of ``docs`` that share no window with the benchmark, with all their columns."""
    names = docs.columns
    found = contamination(docs, benchmark, window, gram).where("n_hit > 0").select(F.col("doc_key").alias("_bad")).distinct()
    found = saved(found, "contaminated")
    key = F.unhex(F.md5(F.concat_ws("\x00", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))))
    marked = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), key.alias("_bad"))
    return marked.join(_sized(found, found.count()), "_bad", "left_anti").select("row.*")
