"""Near copies by the Jaccard similarity of their word n-grams: rare-first prefix filtering, exact.

A document is the set of its distinct n-grams (64-bit hashes).  Two sets that overlap enough share one of the first
``n - ceil(t n) + 1`` n-grams in any common order, so only these prefixes are joined.  The order is rarest first: all
n-grams of all documents are counted, and the counts of the frequent ones go to all tasks as a table of bounded size.
Prefix n-grams that occur in one document only can join nothing; a bitmap of the repeated ones keeps most of them out.

Documents with equal sets are one node.  Nodes that share a prefix n-gram form a list.  A list is not paired out: its
most central node (fewest rare n-grams) is paired with the others, the pairs that pass the length, positional and suffix
filters are verified once, and the links give components.  Only lists that still hold several components are looked at
again, and there every pair across components is verified, so no component is split for want of a comparison.
Lists of the same nodes, as the n-grams of one shared passage make, are one list that counts as many, so that two nodes
meet once for each different list they share and not once for each n-gram.
Such pairs also pass a suffix filter over whole sets: parities of 256 parts by hash bound how many n-grams differ.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliograde.llm.common import discard, saved
from foliograde.llm.rarity import Rarity, count_keys, text_bytes
from foliograde.llm.words import PLAIN, mix, words_of
from foliograde.llm.words import pieces_of as parts_of

#: Sets that a task remembers to list each once.
HELD = 1_000_000
#: Most rows of document ids that are broadcast (8 bytes each).
BROADCAST_IDS = 1_000_000
#: Most pairs that are broadcast (16 bytes each).
BROADCAST_PAIRS = 1_000_000
#: Nodes of a component from which on its number is broadcast instead of moving the nodes to it.
LARGE = 10_000
#: Rounds that join components over their most central nodes before all pairs across components are looked at.
MERGES = 2
#: Lists of a node that each of its entries remembers, so that two nodes do not meet in one list after the other.
LATELY = 8
_U = np.uint64


def gram_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text; a text with fewer words has its whole sequence as the one n-gram."""
    words = words_of(texts, PLAIN)
    bounds = words.bounds()
    h = words.hash
    grams = np.zeros(len(h), np.uint64)
    for j in range(size):
        factor = _U(0x9E3779B97F4A7C15 * (2 * j + 3) & 0xFFFFFFFFFFFFFFFF | 1)
        grams[:max(0, len(h) - j)] += mix(h[j:] * factor)
    grams = mix(grams)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(grams[a:b - size + 1]))
        elif b > a:
            whole = np.array([b - a], np.uint64)
            for i in range(a, b):
                whole = mix(whole * _U(0xD6E8FEB86659FD93) + h[i:i + 1])
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def parities(grams: np.ndarray) -> list[int]:
    """Whether a set has an odd number of n-grams in each of 256 parts by hash, as four words.

    Where two sets differ in parity they differ in at least one n-gram of that part.
    """
    odd = np.bincount((grams >> _U(8) & _U(255)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8").tolist()


def node_of(grams: np.ndarray) -> int:
    """One number for a set; equal sets get the same."""
    return int(np.array([mix(grams ^ _U(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) + _U(len(grams))], np.uint64).view(np.int64)[0])


def needed(n: Column, percent: int) -> Column:
    """ceil(percent * n / 100)."""
    return F.floor((n * percent + 99) / 100)


def count_grams(docs: DataFrame, size: int) -> Rarity:
    """Counts of the n-grams of all documents, once per document."""
    return count_keys(docs, lambda part: np.concatenate([np.zeros(0, np.uint64), *gram_sets(part, size)]), text_bytes(docs) // 5 + 1)


_POSTING = "doc_id long, node long, n int, gram long, place int, rank int, rare int, profile long, " + ", ".join(f"s{i} long" for i in range(4))
#: Parities of a set by hash: the columns of the four words.
SKETCH = [f"s{i}" for i in range(4)]
#: What a list holds of a node; the first of a list by these columns is its most central node.
ENTRY = ["rare", "node", "n", "place", "rank", "profile"]


def postings(docs: DataFrame, size: int, percent: int, rarity: Rarity) -> DataFrame:
    """A row per document (doc_id, node, n, and for a set listed here its parities by hash; gram null) and one per prefix
    n-gram that may be repeated, with its place (from 1), its rank among those that may be, the number of rare n-grams
    of the document and the profile of its set: eight counts by hash, a byte each."""
    shared = docs.sparkSession.sparkContext.broadcast(rarity.parts())

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Rarity(*shared.value)
        seen: set[int] = set()
        for batch in batches:
            done = 0
            for part in parts_of(batch.column(1)):
                ids = batch.column(0).slice(done, len(part)).to_pylist()
                done += len(part)
                rows: list[list] = [[] for _ in range(12)]
                for doc_id, grams in zip(ids, gram_sets(part, size)):
                    n = len(grams)
                    node = node_of(grams) if n else None
                    again = not n or node in seen  # a task lists a set once, however many copies there are
                    for column, value in zip(rows, (doc_id, node, n, *[None] * 5, *([None] * 4 if again else parities(grams)))):
                        column.append([value])
                    if again:
                        continue
                    seen.add(node)
                    if len(seen) > HELD:
                        seen.clear()
                    counts = known.count(grams)
                    order = np.lexsort((grams, counts))[:n - -(-percent * n // 100) + 1]
                    prefix = grams[order]
                    place = np.flatnonzero(known.may_repeat(prefix))
                    if len(place):
                        profile = np.minimum(np.bincount((grams & _U(7)).astype(np.int64), minlength=8), 255).astype(np.uint8).view(np.int64)[0]
                        k = len(place)
                        for column, value in zip(rows, ([None] * k, [node] * k, [n] * k, prefix[place].view(np.int64).tolist(), (place + 1).tolist(),
                                                        list(range(1, k + 1)), [int((counts == 0).sum())] * k, [int(profile)] * k, *[[None] * k] * 4)):
                            column.append(value)
                arrays = [pa.array([v for chunk in column for v in chunk], t) for column, t in zip(
                    rows, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), *[pa.int64()] * 5))]
                yield pa.record_batch(arrays, names=[f.split(" ")[0] for f in _POSTING.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(mapped, _POSTING)


def _may_link(a: str, b: str, percent: int) -> Column:
    """Length, positional and suffix filters for two entries of a list (columns ``a.n`` and so on)."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    p, q = F.col(f"{a}.place"), F.col(f"{b}.place")
    overlap = F.floor(((n + m) * percent + (99 + percent)) / (100 + percent))
    at_most = F.least(f"{a}.rank", f"{b}.rank") + F.least(n - p, m - q)  # what cannot be repeated is not common
    apart = sum((F.abs(F.shiftrightunsigned(f"{a}.profile", 8 * i).bitwiseAND(F.lit(255)) - F.shiftrightunsigned(f"{b}.profile", 8 * i).bitwiseAND(F.lit(255)))
                 for i in range(8)), F.lit(0))
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (at_most >= overlap) & (apart <= n + m - 2 * overlap)


def _may_be_alike(a: str, b: str, percent: int) -> Column:
    """Suffix filter by the parities of whole sets: no more n-grams may differ than the least overlap leaves over."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    overlap = F.floor(((n + m) * percent + (99 + percent)) / (100 + percent))
    differ = sum((F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))) for s in SKETCH), F.lit(0))
    return differ <= n + m - 2 * overlap


def _pairs(joined: DataFrame, a: str, b: str) -> DataFrame:
    x, y = F.col(f"{a}.node"), F.col(f"{b}.node")
    return joined.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def _common(a: pa.Array, b: pa.Array) -> pa.Array:
    out = np.empty(len(a), np.int32)
    for i in range(len(a)):
        x, y = _unpacked(a[i].as_buffer()), _unpacked(b[i].as_buffer())
        at = np.minimum(np.searchsorted(x, y), len(x) - 1)
        out[i] = np.count_nonzero(x[at] == y)
    return pa.array(out, pa.int32())


def _packed(grams: np.ndarray) -> bytes:
    """The upper six bytes of each hash."""
    return np.ascontiguousarray((grams >> _U(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpacked(packed) -> np.ndarray:
    raw = np.frombuffer(packed, np.uint8).reshape(-1, 6)
    whole = np.zeros((len(raw), 8), np.uint8)
    whole[:, :6] = raw
    return whole.view("<u8").ravel()


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in parts_of(batch.column(0)):
            found = {node_of(g): _packed(g) for g in gram_sets(part, size) if len(g)}
            yield pa.record_batch([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.binary())], names=["node", "grams"])


def verified(pairs: DataFrame, docs: DataFrame, firsts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets really are similar enough.  ``firsts``: a document (first) for each node.

    Sets are made anew from the texts of the documents in question.  Those of the b side meet their pairs where they
    are made, if the pairs can be broadcast, and move once, to the a side.
    """
    few = pairs.count() <= BROADCAST_PAIRS

    def sets_of(side: str) -> DataFrame:
        nodes = pairs.select(F.col(side).alias("node")).distinct()
        wanted = _sized(saved(firsts.join(nodes, "node").select("first").distinct(), "wanted"))
        texts = docs.join(wanted, docs["doc_id"].cast("long").eqNullSafe(wanted["first"]), "left_semi").select("text")
        made = texts.mapInArrow(lambda batches: _sets(batches, size), "node long, grams binary")
        return made.select(F.col("node").alias(side), F.col("grams").alias(f"grams_{side}"))

    near_b = sets_of("b").join(F.broadcast(pairs) if few else pairs, "b")
    near_a = sets_of("a").join(_sized(pairs.select("a").distinct()), "a", "left_semi")
    both = near_b.join(near_a, "a")
    counted = both.select(
        "a", "b", (F.octet_length("grams_a") / 6).alias("n"), (F.octet_length("grams_b") / 6).alias("m"), F.arrow_udf("int")(_common)("grams_a", "grams_b").alias("common"))
    return saved(counted.where(F.col("common") * 100 >= (F.col("n") + F.col("m") - F.col("common")) * percent).select("a", "b").distinct(), "links")


def components(links: DataFrame) -> DataFrame:
    """node and the least node reachable (part) for all nodes of the links; written again in each round."""
    edges = saved(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = saved(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("part")), "labels")
    while True:
        near = edges.join(labels, edges["a"] == labels["node"]).groupBy(F.col("b").alias("node")).agg(F.min("part").alias("near"))
        stepped = saved(labels.join(near, "node").select("node", "part", F.least("part", "near").alias("least")), "stepped")
        jump = stepped.select(F.col("node").alias("least"), F.col("least").alias("further"))
        after = saved(stepped.join(jump, "least", "left").select("node", "part", F.least("least", F.coalesce("further", "least")).alias("now")), "after")
        changed = not after.where("now <> part").isEmpty()
        discard(labels, stepped)
        labels = after.select("node", F.col("now").alias("part"))
        labels.saved_at = after.saved_at
        if not changed:
            discard(edges)
            return labels


def _different(lists: DataFrame) -> DataFrame:
    """One of all lists (rows of gram and node, each once) that hold the same nodes, with the number of nodes (members) and of lists (copies).

    Nodes are told by two 64-bit sums of their hashes.
    """
    members = lists.groupBy("gram").agg(
        F.count("*").alias("members"), F.bit_xor(F.xxhash64("node")).alias("_one"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("_two"))
    kept = members.groupBy("members", "_one", "_two").agg(F.min("gram").alias("gram"), F.count("*").alias("copies"))
    return lists.join(kept.select("gram", "members", "copies"), "gram")


def _across(lists: DataFrame, heads: DataFrame, parts: DataFrame, sketches: DataFrame, percent: int, all_pairs: bool) -> DataFrame:
    """Pairs of nodes of one list that are still in different components.

    First only the most central node of each component with the list's head; in the end, with ``all_pairs``, every node
    outside the head's component with every node of another component.
    """
    of_list = lists.join(parts, "node", "left").withColumn("part", F.coalesce("part", "node"))
    split = of_list.groupBy("gram").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("gram")
    named = heads.join(split, "gram").join(parts, "node", "left").withColumn("part", F.coalesce("part", "node"))
    if not all_pairs:
        central = of_list.join(named.select("gram", F.col("part").alias("head_part")), "gram").where("part <> head_part").groupBy("gram", "part").agg(
            F.min(F.struct(*ENTRY)).alias("first")).select("gram", "first.*")
        joined = central.alias("e").join(named.alias("o"), "gram").where(_may_link("e", "o", percent))
        return _pairs(joined, "e", "o")
    still = of_list.join(named.select("gram", F.col("part").alias("head_part")), "gram")
    small_first = Window.partitionBy("node").orderBy("members", "gram")
    still = still.withColumns({
        "before": F.sum("copies").over(small_first.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("copies"),
        "held": F.sum("copies").over(Window.partitionBy("node")),
        "lately": F.collect_list("gram").over(small_first.rowsBetween(-LATELY, -1))}).join(sketches, "node")
    return _pairs(_meetings(still, percent), "e", "o")


def _meetings(still: DataFrame, percent: int) -> DataFrame:
    """Rows (e, o) of nodes of one list in different components: at least one for every pair that may be linked.

    Of the n-grams that two linked sets have in common, only so many lie behind one of the prefixes; so many at least are
    in both.  In any order of lists, then, the first that both are in has room for the others behind it, in what each
    node holds; the order is smallest lists first, and lists too late in it are not paired.  Nor are two nodes that were
    together in one of the last few lists of both, as they have met there or earlier.
    """
    n, m = F.col("e.n"), F.col("o.n")
    overlap = F.floor(((n + m) * percent + (99 + percent)) / (100 + percent))
    shared = overlap - F.greatest(needed(n, percent), needed(m, percent)) + 1
    early = (F.col("e.held") - F.col("e.before") >= shared) & (F.col("o.held") - F.col("o.before") >= shared)
    new = ~F.arrays_overlap("e.lately", "o.lately")
    once = (F.col("o.part") == F.col("o.head_part")) | (F.col("e.node") < F.col("o.node"))
    return still.where("part <> head_part").alias("e").join(still.alias("o"), F.col("e.gram") == F.col("o.gram")).where(
        (F.col("e.part") != F.col("o.part")) & once & early & new & _may_link("e", "o", percent) & _may_be_alike("e", "o", percent))


def similar_documents(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """For every row of ``docs`` (doc_id, text) its class by similarity of n-grams of ``size`` words.

    Returns doc_id, n_shingles and component_id, the smallest doc_id that links reach, its own included; two documents
    link when 100 * common >= percent * union.  Null and empty texts, and texts without words, have no n-grams and link
    with nothing, so they are their own component; rows that are repeated have equal sets and link; a null doc_id takes
    part, but never is the smallest unless all are null; no rows give no rows.  Other columns are not read.
    """
    docs = docs.select("doc_id", "text")
    listed = saved(postings(docs, size, percent, count_grams(docs, size)), "postings")
    facts = listed.where("gram IS NULL").select("doc_id", "node", "n")
    firsts = saved(facts.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("first")), "firsts")
    sketches = listed.where("s0 IS NOT NULL").groupBy("node").agg(*[F.first(s).alias(s) for s in SKETCH])
    entries = listed.where("gram IS NOT NULL").select("gram", *ENTRY)

    several = entries.groupBy("gram").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("gram")
    every = saved(entries.join(several, "gram", "left_semi").groupBy("gram", "node").agg(*[F.first(c).alias(c) for c in ENTRY if c != "node"]), "every-list")
    lists = saved(_different(every), "lists")
    discard(every)
    heads = saved(lists.groupBy("gram").agg(F.min(F.struct(*ENTRY)).alias("head")).select("gram", "head.*"), "heads")
    star = lists.alias("e").join(heads.alias("h"), "gram").where((F.col("e.node") != F.col("h.node")) & _may_link("e", "h", percent))
    # each node with the one head it shares most lists with
    shares = star.groupBy(F.col("e.node").alias("node"), F.col("h.node").alias("head")).agg(F.sum("e.copies").alias("lists"))
    closest = shares.groupBy("node").agg(F.max_by("head", F.struct("lists", "head")).alias("head"))
    done = pairs = saved(closest.select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b")).distinct(), "pairs")
    links = verified(pairs, docs, firsts, size, percent)
    parts = components(links)

    for step in range(MERGES + 1):
        across = _across(lists, heads, parts, sketches, percent, all_pairs=step == MERGES)
        pairs = saved(across.join(done, ["a", "b"], "left_anti"), "pairs")
        if pairs.isEmpty():
            if step < MERGES:
                continue
            break
        done = saved(done.unionByName(pairs), "done")
        links = saved(links.unionByName(verified(pairs, docs, firsts, size, percent)), "links")
        parts = components(links)

    in_part = firsts.join(parts, "node", "left")
    of_part = saved(in_part.where("part IS NOT NULL").groupBy("part").agg(F.min("first").alias("component"), F.count("*").alias("nodes")), "parts")
    of_node = saved(_named(in_part, of_part).select("node", F.coalesce("component", "first").alias("component")), "nodes")
    discard(of_part)
    return facts.join(of_node, "node", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))


def _named(in_part: DataFrame, of_part: DataFrame) -> DataFrame:
    """The nodes with their part's component.  Parts of many nodes are few and go to all tasks; the others move by part."""
    if of_part.count() <= BROADCAST_IDS:
        return in_part.join(F.broadcast(of_part.select("part", "component")), "part", "left")
    large = of_part.where(F.col("nodes") > LARGE).select("part", F.col("component").alias("of_large"))  # a node in LARGE at most
    marked = in_part.join(F.broadcast(large) if large.count() <= BROADCAST_IDS else large, "part", "left")
    small = of_part.where(F.col("nodes") <= LARGE).select(F.col("part").alias("small"), F.col("component").alias("of_small"))
    rest = marked.where("of_large IS NULL").join(small, F.col("part") == F.col("small"), "left").withColumn("component", F.col("of_small")).drop("small", "of_small")
    return marked.where("of_large IS NOT NULL").withColumn("component", F.col("of_large")).unionByName(rest)


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without those that link, directly or over others, to a row that stays.

    All columns are kept.  A row is told by its id and text, so two texts under one id are judged apart, and rows without
    an id like others.  Of linked rows the one with the smallest id stays, null last; of rows with equal id and text
    one stays, with or without words; other documents without words stay; no rows give no rows.
    """
    key = F.xxhash64(docs["doc_id"].isNull(), docs["doc_id"], docs["text"].isNull(), docs["text"])
    found = saved(similar_documents(docs.select(key.alias("doc_id"), docs["text"].alias("text")), size, percent), "similar")
    each = found.groupBy("doc_id").agg(F.max("n_shingles").alias("n"), F.max("component_id").alias("part"), F.count("*").alias("rows"))
    ids = docs.select(key.alias("doc_id"), docs["doc_id"].cast("long").alias("own")).groupBy("doc_id").agg(F.min("own").alias("own"))
    facts = saved(each.join(ids, "doc_id"), "facts")
    linked = facts.where("n > 0")
    stays = linked.groupBy("part").agg(F.min(F.struct(F.col("own").isNull().alias("none"), "own", "doc_id")).alias("first")).select("first.doc_id")
    gone = saved(linked.join(stays, "doc_id", "left_anti").select(F.col("doc_id").alias("_key")), "gone")
    again = saved(facts.where("rows > 1").select(F.col("doc_id").alias("_key")), "again")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), key.alias("_key"))
    kept = rows.join(_sized(gone), "_key", "left_anti")
    if not again.isEmpty():
        once = kept.join(_sized(again), "_key", "left_anti")
        kept = once.unionByName(kept.join(_sized(again), "_key", "left_semi").dropDuplicates(["_key"]))
    return kept.select("row.*")


def _sized(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
