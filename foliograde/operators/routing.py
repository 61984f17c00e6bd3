"""Routing: which type a document has.

Keyword routing counts how many distinct keywords of each type occur anywhere in the
lower-cased text (as substrings).  It is one projection of ``contains`` calls.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliograde import fixed_values as fv
from foliograde.functions import confidence as cf
from foliograde.functions import text as tx
from foliograde.functions.once import with_once
from foliograde.functions.record import VariantCell
from foliograde.operators.responses import read_object
from foliograde.session import small_rows

Lexicon = dict[str, list[str]]

#: A lexicon table up to this size is turned into expressions; beyond it, into a join.
LEXICON_EXPRESSION_LIMIT = 5_000


def keyword_scores(lower_text: Column, lexicon: Lexicon = fv.ROUTING_KEYWORDS) -> dict[str, Column]:
    """Number of distinct keywords found, per type."""
    return {
        doc_type: sum((F.contains(lower_text, F.lit(k)).cast("int") for k in keywords), F.lit(0))
        for doc_type, keywords in lexicon.items()
    }


def add_keyword_scores(df: DataFrame, text: str = "text",
                       lexicon: Lexicon = fv.ROUTING_KEYWORDS) -> DataFrame:
    """Add ``score_<type>`` columns and ``words``."""
    df = with_once(df, {"_lower": F.lower(F.coalesce(F.col(text), F.lit("")))})
    scores = {f"score_{t}": s for t, s in keyword_scores(F.col("_lower"), lexicon).items()}
    return with_once(df, {**scores, "words": tx.word_count(F.col("_lower"))}).drop("_lower")


def decide(df: DataFrame, types: list[str], prefix: str = "keyword_") -> DataFrame:
    """From ``score_<type>`` and ``words`` to type, confidence and reasoning.

    The best score wins, the earlier type wins a tie, and no hit at all is ``unknown``.
    """
    scores = {t: F.col(f"score_{t}") for t in types}
    best = F.greatest(*scores.values()) if len(scores) > 1 else next(iter(scores.values()))
    df = df.withColumn("_best", best)
    winner = F.when(F.col("_best") == 0, fv.UNKNOWN)
    for doc_type, total in scores.items():
        winner = winner.when(total == F.col("_best"), doc_type)
    density = F.col("_best") / F.greatest(F.lit(1.0), F.col("words") / fv.WORDS_PER_KEYWORD)
    return (
        df.withColumns({
            f"{prefix}doc_type": winner,
            f"{prefix}confidence": F.when(F.col("_best") == 0, 0.0).otherwise(
                F.least(F.lit(fv.KEYWORD_CONFIDENCE_CAP), density)),
            f"{prefix}reasoning": F.when(F.col("_best") == 0, fv.NO_KEYWORDS).otherwise(
                tx.filled(fv.KEYWORD_REASON, score=F.col("_best"))),
        }).drop("_best", "words", *[f"score_{t}" for t in types])
    )


def route_by_keywords(df: DataFrame, text: str = "text",
                      lexicon: Lexicon = fv.ROUTING_KEYWORDS, prefix: str = "keyword_") -> DataFrame:
    return decide(add_keyword_scores(df, text, lexicon), list(lexicon), prefix)


def route_segments(segments: DataFrame, *ids: str,
                   lexicon: Lexicon = fv.ROUTING_KEYWORDS) -> DataFrame:
    """Keyword routing of documents that are spread over several text segments.

    Each segment is searched where it lies; only one flag per keyword and a word count
    are aggregated, with partial aggregation, so the size of a document does not matter.
    Segments are whole pages and every page starts with a ``--- Page n ---`` line after a blank,
    so only a keyword with a hyphen behind a blank could lie across two of them.
    """
    keywords = sorted({k for ks in lexicon.values() for k in ks})
    if any(" -" in k for k in keywords):
        raise ValueError("keywords with a blank and a hyphen need the whole text in one segment")
    flags = {k: f"_k{i}" for i, k in enumerate(keywords)}
    hits = (
        segments.withColumn("_lower", F.lower("text"))
        .select(*ids, tx.word_count(F.col("_lower")).alias("words"),
                *[F.contains("_lower", F.lit(k)).alias(c) for k, c in flags.items()])
        .groupBy(*ids)
        .agg(F.sum("words").alias("words"), *[F.max(c).alias(c) for c in flags.values()])
    )
    for doc_type, ks in lexicon.items():
        hits = hits.withColumn(f"score_{doc_type}",
                               sum((F.col(flags[k]).cast("int") for k in ks), F.lit(0)))
    return decide(hits.drop(*flags.values()), list(lexicon))


def route_with_lexicon(df: DataFrame, lexicon: DataFrame, doc_id: str = "doc_id",
                       text: str = "text", limit: int = LEXICON_EXPRESSION_LIMIT) -> DataFrame:
    """Best type per document from a lexicon table ``(doc_type, keyword, priority)``.

    A lexicon of configuration size becomes literals.  A larger one becomes an index of character
    sequences (see ``lexicon_hits``).  Documents without a hit are ``unknown``.
    """
    rows = small_rows(lexicon.select("doc_type", "keyword", "priority").distinct(), limit)
    if rows is None:
        return _route_by_index(df, lexicon, doc_id, text)
    by_type: dict[str, list[str]] = {}
    for row in sorted(rows, key=lambda r: (r.priority, r.doc_type, r.keyword)):
        if row.keyword not in by_type.setdefault(row.doc_type, []):
            by_type[row.doc_type].append(row.keyword)
    lowered = df.select(doc_id, F.lower(text).alias("_lower"))
    scored = lowered.select(doc_id, F.array(*[
        F.struct(
            F.size(F.filter(F.lit(ks), lambda k: F.contains(F.col("_lower"), k))).cast("long").alias("n"),
            F.lit(-rank).alias("rank"), F.lit(t).alias("doc_type"))
        for rank, (t, ks) in enumerate(by_type.items())
    ]).alias("_scores"))
    best = F.array_max("_scores")
    return scored.select(
        doc_id,
        F.when(best["n"] > 0, best["doc_type"]).otherwise(fv.UNKNOWN).alias("doc_type"),
        best["n"].alias("score"),
    )


#: Lengths of the character sequences that keywords are filed under.
GRAM_SIZES = (8, 5, 3, 2, 1, 0)
#: Most bits of the filter of filed sequences (1 MB); a fuller filter lets more through, the result stays the same.
FILTER_BITS = 1 << 23
#: Most keywords whose index is broadcast (about 100 bytes each).
BROADCAST_KEYWORDS = 1_000_000


def _grams(text: Column, size: int) -> Column:
    """The character sequences of a length; of length 0 there is one.  Short ones are distinct, long ones nearly so."""
    if size == 0:
        return F.array(F.lit(""))
    every = F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{size}}}))"), F.lit(1))
    return F.array_distinct(every) if size <= 3 else every


def _place(gram: Column, bits: int) -> tuple[Column, Column]:
    """Where a gram is marked in a set of ``bits`` bits, a power of two: the word and the two bits in it."""
    place = F.xxhash64(gram)
    one = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), F.call_function("shiftright", place, F.lit(at)).bitwiseAND(F.lit(63)).cast("int"))
    return F.call_function("shiftright", place.bitwiseAND(F.lit(bits - 1)), F.lit(6)).cast("int"), one(0).bitwiseOR(one(26))


def keyword_index(lexicon: DataFrame) -> DataFrame:
    """Each keyword of a lexicon table, filed under the rarest character sequence it holds.

    Returns size and gram (a keyword of length n has the largest size up to n), keyword and types (type and the least
    priority of any of the type's keywords).  A text that holds the keyword holds the sequence.  Rare is what few
    keywords hold; ties go to the first in order.  Null keywords are left out.
    """
    lex = lexicon.where("keyword IS NOT NULL").select("doc_type", "keyword", "priority").distinct()
    ranks = lex.groupBy("doc_type").agg(F.min("priority").alias("rank"))
    words = lex.select("doc_type", "keyword").distinct().join(ranks, "doc_type").groupBy("keyword").agg(
        F.collect_list(F.struct("doc_type", "rank")).alias("types"))
    length = F.length("keyword")
    size = reduce(lambda other, n: F.when(length >= n, n).otherwise(other), reversed(GRAM_SIZES), F.lit(0))
    held = reduce(lambda other, n: F.when(length >= n, F.array_distinct(_grams(F.col("keyword"), n))).otherwise(other), reversed(GRAM_SIZES), F.array(F.lit("")))
    filed = words.select("keyword", size.alias("size"), F.explode(held).alias("gram"))
    rare = filed.groupBy("size", "gram").agg(F.count("*").alias("holders"))
    best = filed.join(rare, ["size", "gram"]).groupBy("keyword", "size").agg(F.min(F.struct("holders", "gram")).alias("best"))
    return best.join(words, "keyword").select("size", F.col("best.gram").alias("gram"), "keyword", "types")


def _filter_of(index: DataFrame) -> tuple[int, dict[int, Column], int]:
    """Keywords in the index, a bit set per size that marks the hashes of its grams, and the bits of a set."""
    sizes = index.groupBy("size").agg(F.count("*").alias("n")).collect()  # a row per size
    total = sum(r.n for r in sizes)
    bits = min(FILTER_BITS, 1 << max(10, (32 * max([r.n for r in sizes], default=0)).bit_length()))
    word, mark = _place(F.col("gram"), bits)
    marked = index.select("size", word.alias("word"), mark.alias("bit"))
    words = marked.groupBy("size", "word").agg(F.bit_or("bit").alias("bits")).collect()  # bits / 64 rows a size at most
    sets: dict[int, Column] = {}
    for size in (r["size"] for r in sizes):
        own = [0] * (bits // 64)
        for row in words:
            if row["size"] == size:
                own[row["word"]] = row["bits"]
        # folded to one array literal before the plan runs
        sets[size] = F.split(F.lit(",".join(map(str, own))), ",").cast("array<bigint>")
    return total, sets, bits


def near_grams(df: DataFrame, index: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The sequences of the lower-cased texts that may be filed in the index: doc_id, _lower (the text), size and gram.

    All others are left out within the row, by a bit set of what is filed (built by one job over the index).
    """
    return _near(df, _filter_of(index), doc_id, text)


def _near(df: DataFrame, filter_of: tuple[int, dict[int, Column], int], doc_id: str, text: str) -> DataFrame:
    _, sets, bits = filter_of
    lowered = df.select(doc_id, F.lower(text).alias("_lower")).where("_lower IS NOT NULL")
    if not sets:
        return lowered.limit(0).select(doc_id, "_lower", F.lit(0).alias("size"), F.lit("").alias("gram"))

    def filed(gram: Column, size: int) -> Column:
        word, mark = _place(gram, bits)
        return F.get(sets[size], word).bitwiseAND(mark) == mark

    def kept(size: int) -> Column:
        own = F.array_distinct(F.filter(f"_g{size}", lambda gram: filed(gram, size)))
        return F.transform(own, lambda gram: F.struct(F.lit(size).alias("size"), gram.alias("gram")))

    grams = with_once(lowered, {f"_g{n}": _grams(F.col("_lower"), n) for n in sets})
    return grams.select(doc_id, "_lower", F.explode(F.concat(*map(kept, sets))).alias("_at")).select(doc_id, "_lower", "_at.size", "_at.gram")


def lexicon_hits(df: DataFrame, index: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Which keywords of the index the lower-cased texts hold: doc_id, keyword and types, one row each.

    Sequences that may be filed meet the index by equality, and one ``contains`` settles each keyword.  An index beyond
    BROADCAST_KEYWORDS is met by a shuffle of ids and sequences, and the texts join the candidates afterwards.
    """
    filter_of = _filter_of(index)
    near = _near(df, filter_of, doc_id, text)
    if filter_of[0] <= BROADCAST_KEYWORDS:
        found = near.join(F.broadcast(index), ["size", "gram"])
    else:
        candidates = near.select(doc_id, "size", "gram").join(index, ["size", "gram"]).select(doc_id, "keyword", "types")
        found = candidates.join(df.select(doc_id, F.lower(text).alias("_lower")), doc_id)
    return found.where(F.contains("_lower", F.col("keyword"))).select(doc_id, "keyword", "types")


def _route_by_index(df: DataFrame, lexicon: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Lexicon routing for lexicons of any size (see ``lexicon_hits``).

    Types rank as with literals: most keywords, then the least priority of any of the type's keywords, then the name.
    """
    hits = lexicon_hits(df, keyword_index(lexicon), doc_id, text).select(doc_id, F.inline("types"))
    per_type = hits.groupBy(doc_id, "doc_type", "rank").agg(F.count("*").alias("n"))
    best = per_type.groupBy(doc_id).agg(F.min(F.struct((-F.col("n")).alias("less"), F.col("rank"), F.col("doc_type"))).alias("best"))
    return df.select(doc_id).join(best, doc_id, "left").select(
        doc_id, F.coalesce("best.doc_type", F.lit(fv.UNKNOWN)).alias("doc_type"),
        F.coalesce(-F.col("best.less"), F.lit(0)).cast("long").alias("score"))


# --- model responses -----------------------------------------------------------------


#: What a routing reply may hold.
ROUTING_REPLY = T.StructType([T.StructField(name, T.StringType()) for name in ("doc_type", "confidence", "reasoning")])


def with_routing_reply(df: DataFrame, response: str = "response", types: list[str] = fv.DOC_TYPES, out: str = "reply") -> DataFrame:
    """Add a model's routing reply as ``struct<doc_type, confidence, reasoning>``.

    An unlisted type becomes ``unknown`` with confidence 0.  A reply that is no JSON
    object, or whose confidence is missing or no number for a listed type, has failed.
    Confidence is brought into [0, 1].  The reply is parsed once, and each of its values read once.
    """
    df = with_once(df, {"_read": read_object(F.col(response), ROUTING_REPLY)})
    kind, sure, why = (VariantCell(F.col("_read")[name]) for name in ROUTING_REPLY.fieldNames())
    df = with_once(df, {
        "_given": F.col("_read").isNotNull(),
        "_type": F.when(kind.is_text & kind.printed.isin(types), kind.printed),
        "_sure": F.when(~sure.is_text, sure.number),
        "_why": why.text})
    failure = F.concat(F.lit(fv.CLASSIFICATION_FAILED), F.when(F.col("_given"), "no usable confidence").otherwise("Invalid response format"))
    listed, usable = F.col("_type").isNotNull(), F.col("_type").isNull() | F.col("_sure").isNotNull()
    fine = F.col("_given") & usable
    reply = F.struct(
        F.when(fine & listed, F.col("_type")).otherwise(fv.UNKNOWN).alias("doc_type"),
        F.when(fine & listed, cf.unit_range(F.col("_sure"))).otherwise(0.0).alias("confidence"),
        F.when(fine, F.col("_why")).otherwise(failure).alias("reasoning"))
    return with_once(df, {out: reply}).drop("_read", "_given", "_type", "_sure", "_why")


def route(df: DataFrame, responses: DataFrame | None, doc_id: str = "doc_id", text: str = "text",
          lexicon: Lexicon = fv.ROUTING_KEYWORDS, use_fallback: bool = True) -> DataFrame:
    """Add ``doc_type``, ``routing_confidence`` and ``routing_reasoning``.

    ``responses(doc_id, response)`` holds at most one model reply per document; where it is
    missing, unusable or undecided, the keywords decide on the whole text.
    """
    df = route_by_keywords(df, text, lexicon, prefix="_kw_") if use_fallback else df
    if responses is not None:
        # what the text decides is settled before the join, which carries the text only if it is wanted later
        df = with_once(df, {"_has_text": tx.has_text(F.col(text))})
        df = df.join(responses.select(doc_id, F.col("response").alias("_response")), doc_id, "left")
        empty = F.struct(F.lit(fv.UNKNOWN).alias("doc_type"), F.lit(0.0).alias("confidence"),
                         F.lit(fv.NO_TEXT_CONTENT).alias("reasoning"))
        df = with_routing_reply(df, "_response", list(lexicon), "_model").drop("_response")
        df = with_once(df, {"_model": F.when(F.col("_has_text"), F.col("_model")).otherwise(empty)}).drop("_has_text")

    def pick(part: str) -> Column:
        if responses is None:
            return F.col(f"_kw_{part}")
        if not use_fallback:
            return F.col("_model")[part]
        return F.when(F.col("_model.doc_type") != fv.UNKNOWN, F.col("_model")[part]).otherwise(
            F.col(f"_kw_{part}"))

    return (
        df.withColumns({
            "doc_type": pick("doc_type"),
            "routing_confidence": pick("confidence"),
            "routing_reasoning": pick("reasoning"),
        }).drop("_model", "_kw_doc_type", "_kw_confidence", "_kw_reasoning")
    )
