"""Quality rules whose cutoffs limit the share of good documents that they reject.

Each rule measures a document by a whole number from 0 to 1000; documents above the rule's cutoff go.  A cutoff is
chosen per stratum (the language, for instance) on a labelled holdout, the good documents of the labels that pass the
base rules.  A cutoff with k of n good documents above it is certified when a rule that rejects a share of ``risk`` of
all good documents would leave k or fewer of n with a probability of at most ``doubt``: the exact binomial tail, no
approximation.  Cutoffs are tried from the loosest to the strictest and the last certified one counts, so the tries of
one rule need no correction; those of different rules and strata share the doubt evenly (Bonferroni), and the rules of a
stratum share the risk.  With probability 1 - doubt no stratum loses more than ``risk`` of its good documents.
Strata with too few labels to certify anything keep all their documents.

Everything is DataFrame functions; labels decide cutoffs only and never a single document.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliograde.functions.once import with_once
from foliograde.llm.common import saved

#: Most good documents, and most strata, that are broadcast (8 and about 100 bytes a row).
BROADCAST_ROWS = 400_000
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 3


def _per_mille(part: Column, whole: Column) -> Column:
    return F.coalesce(F.least(F.lit(1000), F.floor(part * 1000 / F.nullif(whole, F.lit(0)))), F.lit(0)).cast("int")


def _word_length() -> Column:
    """Ten times the mean word length, 1000 at most."""
    return _per_mille(F.col("word_chars"), F.col("n_words") * 100)


def rules() -> dict[str, Column]:
    """The rules by name: columns over the facts of a document, whole numbers from 0 to 1000, larger is worse."""
    return {
        "symbols": _per_mille(F.col("n_symbols"), F.col("word_chars")),
        "marks": _per_mille(F.col("n_marks"), F.col("word_chars")),
        "capitals": _per_mille(F.col("n_capitals"), F.col("word_chars")),
        "dup_lines": _per_mille(F.col("n_dup_lines"), F.col("n_lines")),
        "repeat_words": _per_mille(F.col("n_repeat_words"), F.col("n_words")),
        "long_words": _word_length(),
        "short_words": F.lit(1000) - _word_length(),
    }


def _repeated_words(df: DataFrame) -> DataFrame:
    """Add ``n_repeat_words``: words inside windows of three words that are found at least twice in the text.

    Windows are compared by 64-bit hashes within their text.  Texts without a repeated window, told by a hash set,
    skip the sort.
    """
    hashes = F.transform(F.sequence(F.lit(0), F.size("words") - WINDOW), lambda i: F.xxhash64(*[F.get("words", i + j) for j in range(WINDOW)]))
    df = with_once(df, {"grams": F.when(F.size("words") >= WINDOW, hashes)})
    repeats = F.size(F.array_distinct("grams")) < F.size("grams")
    placed = F.transform("grams", lambda gram, i: F.struct(gram.alias("gram"), i.alias("at")))
    df = with_once(df, {"sorted": F.when(F.col("grams").isNotNull() & repeats, F.sort_array(placed))}).drop("grams")
    twice = F.filter("sorted", lambda spot, i: (
        (F.get("sorted", i + 1)["gram"].eqNullSafe(spot["gram"])) | ((i > 0) & F.get("sorted", i - 1)["gram"].eqNullSafe(spot["gram"]))))
    df = with_once(df, {"spots": F.sort_array(F.transform(twice, lambda spot: spot["at"]))}).drop("sorted")
    fresh = F.transform("spots", lambda at, i: F.least(F.lit(WINDOW), F.coalesce(F.get("spots", i + 1) - at, F.lit(WINDOW))))
    covered = F.aggregate(fresh, F.lit(0).cast("long"), lambda n, more: n + more)
    return with_once(df, {"n_repeat_words": F.coalesce(covered, F.lit(0).cast("long"))}).drop("spots")


def facts(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """doc_id, stratum and what the rules need to know of every row of ``docs`` (doc_id, text, the stratum's column).

    Texts are read whole; a null text counts as empty, and an empty one has zeros everywhere.  Rows repeated in full
    give equal rows.  Other columns are not read, so their names do not matter.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    df = docs.select(docs["doc_id"].alias("doc_id"), docs[stratum].cast("string").alias("stratum"), text.alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda line: F.regexp_like(line, F.lit(r"[^\x20\x09-\x0D]")))
    df = with_once(df, {"words": F.array_remove(F.split("text", SPACES), ""), "lines": lines})
    count = lambda pattern: F.regexp_count("text", F.lit(pattern)).cast("long")
    df = with_once(df, {
        "n_words": F.size("words").cast("long"),
        "word_chars": F.char_length(F.array_join("words", "")).cast("long"),
        "n_symbols": count(SYMBOLS),
        "n_lines": F.size("lines").cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "n_marks": count(r"[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]"),
        "n_capitals": count(r"\p{Lu}"),
    }).drop("text", "lines")
    return _repeated_words(df).drop("words")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def allowed_rejections(n: Column, risk: float, doubt: float) -> Column:
    """The largest k with P(Binomial(n, risk) <= k) <= doubt; -1 if there is none.

    Sums the tail from 0 in logarithms, so it holds for any n.  k is below risk * n, where the tail nears one half.
    """
    odds = math.log(risk / (1 - risk))

    def step(done: Column, i: Column) -> Column:
        term = F.when(i == 0, done["term"]).otherwise(done["term"] + F.log((n - i + 1) / i) + odds)
        tail = F.greatest(done["tail"], term) + F.log1p(F.exp(-F.abs(done["tail"] - term)))
        return F.struct(term.alias("term"), tail.alias("tail"), F.when(tail <= math.log(doubt), i).otherwise(done["k"]).alias("k"))

    start = F.struct((n * math.log(1 - risk)).alias("term"), F.lit(float("-inf")).alias("tail"), F.lit(-1).cast("long").alias("k"))
    steps = F.sequence(F.lit(0).cast("long"), F.floor(n * risk).cast("long"))
    return F.aggregate(steps, start, step, lambda done: done["k"])


def _sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def cutoffs(measured: DataFrame, labels: DataFrame, n_rules: int, risk: float, doubt: float) -> DataFrame:
    """stratum and limits: the certified cutoff of each rule, by number, null where nothing can be certified.

    ``measured`` holds doc_id, stratum, base_failed and values (one per rule); ``labels`` doc_id and quality.  A
    document is good if its labels are all 1; null ids and null qualities label nothing; documents of one id count one
    by one.  The sums are counts per stratum, rule and value, so a stratum with most of the rows is no larger
    than another.  Strata without good documents have no row.
    """
    good = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    rows = measured.where("NOT base_failed AND doc_id IS NOT NULL").groupBy("doc_id", "stratum", "values").agg(F.count("*").alias("n"))
    held = rows.join(good, "doc_id", "left_semi")
    counts = held.select("stratum", "n", F.posexplode("values").alias("rule", "value")).groupBy("stratum", "rule", "value").agg(F.sum("n").alias("n"))
    counts = saved(counts, "rule-counts")
    sizes = counts.where("rule = 0").groupBy("stratum").agg(F.sum("n").alias("total"))
    n_strata = max(1, sizes.count())
    share = doubt / (n_strata * n_rules)
    limits = sizes.select(F.col("stratum").alias("of"), allowed_rejections(F.col("total"), risk / n_rules, share).alias("k")).where("k >= 0")
    from_top = Window.partitionBy("stratum", "rule").orderBy(F.desc("value"))
    above = counts.withColumn("at_least", F.sum("n").over(from_top))
    chosen = above.join(_sized(limits, n_strata), F.col("stratum").eqNullSafe(F.col("of"))).where("at_least > k").groupBy("stratum", "rule").agg(F.max("value").alias("cutoff"))
    return chosen.groupBy("stratum").agg(F.sort_array(F.collect_list(F.struct("rule", "cutoff"))).alias("found")).select(
        "stratum", F.transform("found", lambda one: one["cutoff"]).alias("limits"))


def judged(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.05, doubt: float = 0.05) -> DataFrame:
    """The verdict on every row of ``docs`` (doc_id, text, the stratum's column), with cutoffs learnt from ``labels``.

    Returns doc_id, stratum, the facts, base_failed, failed_rules (names, in order) and kept.  Null texts are empty and
    fail the base; a null stratum is a stratum like others; a null doc_id has no label but is judged; rows repeated in
    full get equal verdicts; a value equal to the cutoff passes; without labels, or with too few, only the base
    rejects; no rows give no rows.
    """
    named = rules()
    measured = facts(docs, stratum).withColumn("base_failed", base_failed()).withColumn("values", F.array(*named.values()))
    measured = saved(measured, "facts")
    limits = saved(cutoffs(measured, labels, len(named), risk, doubt).withColumnRenamed("stratum", "of"), "cutoffs")
    judged_rows = measured.join(_sized(limits, limits.count()), F.col("stratum").eqNullSafe(F.col("of")), "left")
    names = F.array(*[F.lit(name) for name in named])
    failed = F.filter(names, lambda name, i: F.coalesce(F.get("values", i) > F.get("limits", i), F.lit(False)))
    fine = judged_rows.withColumn("failed_rules", F.when(F.col("limits").isNull(), F.array().cast("array<string>")).otherwise(failed))
    return fine.drop("of", "limits", "values").withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
