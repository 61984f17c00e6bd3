"""Removal of lines that repeat an earlier line, exactly or nearly: an exact set-similarity join of lines.

A line is the set of its words.  Words are put in order of rarity, from counts over all lines.  Of two lines that are
similar enough the longer one has, among its first ``n - ceil(t n) + 1`` words, one of the first
``m - ceil(2 t m / (1 + t)) + 1`` words of the shorter one; only these are joined, under the length filter, the
positional filter and a filter on parities of words by hash: where two lines differ in parity they differ in a word, and
few may.  What passes is verified once per pair of distinct lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliograde.llm.common import discard, saved
from foliograde.llm.rarity import Rarity, count_keys, text_bytes
from foliograde.llm.words import PLAIN, mix, words_of
from foliograde.llm.words import pieces_of as parts_of

#: Most documents whose wanted lines are broadcast (about 100 bytes each).
BROADCAST_DOCS = 200_000
#: Lines a task remembers so that it lists each once, and words of lines that it compares at once.
HELD, HELD_WORDS = 1_000_000, 1_000_000
#: Most removed lines, or documents with some, that are broadcast (9 and about 100 bytes each).
BROADCAST_GONE, BROADCAST_REMOVED = 1_000_000, 300_000
#: Shares of the words whose lines are joined one after the other.
ROUNDS = 2
#: Words of a line from which on it has parities of 128 parts instead of 64.
LONG = 48
_U = np.uint64


def ordered(key: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """An order by key, then hash.  Keys hold most of the hash, so that only keys that meet need the whole of it."""
    order = np.argsort(key, kind="stable")
    if np.any((key[order[1:]] == key[order[:-1]]) & (hashes[order[1:]] != hashes[order[:-1]])):
        order = np.lexsort((hashes, key))
    return order


class Lines:
    """Lines with words of an array of texts: their words in order of rarity, each word once."""

    def __init__(self, texts: pa.Array, rarity: Rarity | None = None):
        words = words_of(texts, PLAIN)
        breaks = np.flatnonzero(words.data == 10)
        before = np.searchsorted(breaks, words.start)
        line = words.row + before
        order_key = (line.astype(np.uint64) << _U(40)) | (words.hash >> _U(24))
        if rarity is not None:
            level = np.minimum(np.log2(rarity.count(words.hash) + 1.0) * 8, 255).astype(np.uint64)
            order_key = (line.astype(np.uint64) << _U(40)) | (level << _U(32)) | (words.hash >> _U(32))
        order = ordered(order_key, words.hash)
        line, hashes = line[order], words.hash[order]
        fresh = np.ones(len(line), bool)
        fresh[1:] = (line[1:] != line[:-1]) | (hashes[1:] != hashes[:-1])
        kept = order[fresh]
        self.word_line, self.words = line[fresh], hashes[fresh]
        self.first = np.flatnonzero(np.r_[True, self.word_line[1:] != self.word_line[:-1]]) if len(self.words) else np.zeros(0, np.int64)
        self.size = np.diff(np.r_[self.first, len(self.words)])
        self.index = np.repeat(np.arange(len(self.first)), self.size)
        self.row = words.row[kept[self.first]] if len(self.first) else np.zeros(0, np.int64)
        if len(self.first):
            lengths = np.r_[0, np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64))]
            self.number = before[kept[self.first]] - np.searchsorted(breaks, lengths[self.row])
            sums = np.add.reduceat(mix(self.words ^ _U(0xA5A5A5A5A5A5A5A5)), self.first)
            self.node = mix(sums + self.size.astype(np.uint64)).view(np.int64)
        else:
            self.number, self.node = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def parities(self) -> tuple[np.ndarray, np.ndarray]:
        """Whether a line has an odd number of words in each of 64 parts by hash, and, for lines of ``LONG`` words, of those
        among them that lie in one half by hash (0 for others)."""
        if not len(self.first):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        bit = _U(1) << (self.words & _U(63))
        odd = np.bitwise_xor.reduceat(bit, self.first)
        half = np.bitwise_xor.reduceat(bit * (self.words >> _U(6) & _U(1)), self.first)
        return odd.view(np.int64), np.where(self.size >= LONG, half, _U(0)).view(np.int64)


_LISTED = "doc_id long, text_hash long, line int, node long, n int, word int, place int, odd long, half long, other long"


class _Held:
    """Distinct lines of a task: their prefix words and, to compare them at once, all their words."""

    def __init__(self):
        self.seen: set[int] = set()
        self.start_over()

    def start_over(self) -> None:
        self.parts: list[tuple] = []
        self.many = 0

    def full(self) -> bool:
        return self.many > HELD_WORDS or len(self.seen) > HELD

    def add(self, lines: Lines, order: np.ndarray, rarity: Rarity, percent: int) -> None:
        k = len(lines.node)
        if not k:
            return
        distinct, first = np.unique(lines.node, return_index=True)
        fresh = np.zeros(k, bool)
        fresh[first] = [node not in self.seen for node in distinct.tolist()]
        self.seen.update(distinct.tolist())
        place = np.arange(len(lines.words)) - lines.first[lines.index]
        use = (place < lines.size[lines.index] + (-percent * lines.size[lines.index] // 100) + 1) & fresh[lines.index]
        use[use] = rarity.may_repeat(lines.words[use])
        number = np.cumsum(fresh) - 1
        keep = fresh[lines.index]
        self.parts.append((
            lines.node[fresh], lines.size[fresh], order[fresh], *(p[fresh] for p in lines.parities()), lines.words[keep],
            number[lines.index[use]], lines.words[use], place[use] + 1))
        self.many += int(keep.sum())

    def flushed(self, percent: int) -> Iterator[pa.RecordBatch]:
        """Prefix words of the lines held, and pairs that a look at each word's first line has shown to be similar."""
        if len(self.seen) > HELD:  # only with the parts, so that no line is twice among them
            self.seen.clear()
        if not self.parts:
            return
        counts = np.cumsum([0, *(len(p[0]) for p in self.parts)])
        node, size, order, odd, half, words = (np.concatenate([p[i] for p in self.parts]) for i in range(6))
        index = np.concatenate([p[6] + c for p, c in zip(self.parts, counts)])
        word, place = (np.concatenate([p[i] for p in self.parts]) for i in (7, 8))
        bounds = np.r_[0, np.cumsum(size)]
        self.start_over()
        yield _rows(node=node[index], n=size[index], word=(word >> _U(32)).astype(np.uint32).view(np.int32), place=place, odd=odd[index], half=half[index])
        by = np.lexsort((order[index], word))
        head = np.r_[True, word[by][1:] != word[by][:-1]] if len(by) else np.zeros(0, bool)
        x, y = index[by], index[by][np.flatnonzero(head)][np.cumsum(head) - 1] if len(by) else index
        n, m = size[x], size[y]
        overlap = -(-(n + m) * percent // (100 + percent))
        p, q = place[by], place[by][np.flatnonzero(head)][np.cumsum(head) - 1] if len(by) else place
        maybe = ~head & (node[x] != node[y]) & (np.minimum(n, m) * 100 >= np.maximum(n, m) * percent) & (np.minimum(p, q) + np.minimum(n - p, m - q) >= overlap)
        pairs = np.unique(np.stack([x[maybe], y[maybe]], axis=1), axis=0) if maybe.any() else np.zeros((0, 2), np.int64)
        own = [np.sort(words[bounds[i]:bounds[i + 1]]) for i in np.unique(pairs)]
        at = {int(i): w for i, w in zip(np.unique(pairs), own)}
        alike = [(i, j) for i, j in pairs.tolist() if _similar(at[i], at[j], percent)]
        if alike:
            i, j = np.array(alike).T
            yield _rows(node=node[i], other=node[j])


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    common = np.count_nonzero(x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y)
    return common * 100 >= (len(x) + len(y) - common) * percent


def _rows(**columns: np.ndarray | pa.Array) -> pa.RecordBatch:
    """A batch of the listed rows with nulls in all other columns."""
    kinds = {"int": pa.int32(), "long": pa.int64()}
    fields = [f.split(" ") for f in _LISTED.split(", ")]
    size = len(next(iter(columns.values())))
    return pa.record_batch(
        [(pa.array(columns[name]).cast(kinds[kind]) if name in columns else pa.nulls(size, kinds[kind])) for name, kind in fields], names=[name for name, _ in fields])


def _listed(docs: DataFrame, percent: int, rarity: Rarity) -> DataFrame:
    """A row per line with words (doc_id or line set), one per prefix word of a distinct line that may be repeated, and
    one per pair of similar lines (node, other) that a task has found among its own."""
    shared = docs.sparkSession.sparkContext.broadcast(rarity.parts())

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, read = Rarity(*shared.value), _Held(), 0
        for batch in batches:
            done = 0
            for part in parts_of(batch.column(2)):
                own = batch.slice(done, len(part))
                done += len(part)
                lines = Lines(part, known)
                at = pa.array(lines.row)
                yield _rows(doc_id=own.column(0).take(at), text_hash=own.column(1).take(at), line=lines.number, node=lines.node, n=lines.size)
                held.add(lines, np.arange(read, read + len(lines.node)), known, percent)
                read += len(lines.node)
                if held.full():
                    yield from held.flushed(percent)
        yield from held.flushed(percent)

    return docs.select("doc_id", "text_hash", "text").mapInArrow(mapped, _LISTED)


def _candidates(entries: DataFrame, gone: DataFrame, percent: int) -> DataFrame:
    """Pairs of distinct lines that pass all filters, once each: the longer one (a) and the shorter one (b).

    Of two lines that are both known to repeat an earlier one (``gone``) nothing more need be known.
    """
    entries = entries.join(_sized(gone.withColumn("gone", F.lit(True)), BROADCAST_GONE), "node", "left")
    index = entries.where(F.col("place") <= F.col("n") - F.floor((2 * percent * F.col("n") + (99 + percent)) / (100 + percent)) + 1)
    n, m, p, q = F.col("e.n"), F.col("i.n"), F.col("e.place"), F.col("i.place")
    overlap = F.floor(((n + m) * percent + (99 + percent)) / (100 + percent))
    at_most = F.least(p, q) + F.least(n - p, m - q)
    odd, half = F.col("e.odd").bitwiseXOR(F.col("i.odd")), F.col("e.half").bitwiseXOR(F.col("i.half"))
    # of long lines both halves by hash are told apart, which makes 128 parts
    apart = F.when(m >= LONG, F.bit_count(half) + F.bit_count(odd.bitwiseXOR(half))).otherwise(F.bit_count(odd))
    ordered = (m < n) | ((m == n) & (F.col("i.node") < F.col("e.node")))
    asked = F.col("e.gone").isNull() | F.col("i.gone").isNull()
    joined = entries.alias("e").join(
        index.alias("i"), (F.col("e.word") == F.col("i.word")) & ordered & asked & (m * 100 >= n * percent) & (at_most >= overlap) & (apart <= n + m - 2 * overlap))
    return joined.select(F.col("e.node").alias("a"), F.col("i.node").alias("b")).distinct()


def _sized(df: DataFrame, most: int) -> DataFrame:
    return F.broadcast(df) if df.count() <= most else df


def _common(a: pa.Array, b: pa.Array) -> pa.Array:
    out = np.empty(len(a), np.int32)
    for i in range(len(a)):
        x, y = np.frombuffer(a[i].as_buffer(), np.uint64), np.frombuffer(b[i].as_buffer(), np.uint64)
        out[i] = len(np.intersect1d(x, y, assume_unique=True))
    return pa.array(out)


def _verified(pairs: DataFrame, docs: DataFrame, firsts: DataFrame, percent: int) -> DataFrame:
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = saved(firsts.join(nodes, "node").groupBy("first.doc_id", "first.text_hash").agg(F.collect_set("node").alias("nodes")), "wanted")
    many = wanted.count() > BROADCAST_DOCS
    wanted = wanted.select(F.col("doc_id").alias("own_id"), F.col("text_hash").alias("own_hash"), "nodes")
    texts = docs.join(wanted if many else F.broadcast(wanted), docs["doc_id"].eqNullSafe(F.col("own_id")) & (docs["text_hash"] == F.col("own_hash")))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for part in parts_of(batch.column(0)):
                asked = batch.column(1).slice(done, len(part)).to_pylist()
                done += len(part)
                lines = Lines(part)
                found = {}
                wanted_here = [set(x) for x in asked]
                for i, (row, node) in enumerate(zip(lines.row.tolist(), lines.node.tolist())):
                    if node in wanted_here[row]:
                        found[node] = lines.words[lines.first[i]:lines.first[i] + lines.size[i]].tobytes()
                yield pa.record_batch([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.binary())], names=["node", "words"])

    words = saved(texts.select("text", "nodes").mapInArrow(sets, "node long, words binary").dropDuplicates(["node"]), "line-sets")
    both = (
        pairs.join(words.select(F.col("node").alias("b"), F.col("words").alias("words_b")), "b")
        .join(words.select(F.col("node").alias("a"), F.col("words").alias("words_a")), "a")
    )
    counted = both.select(
        "a", "b", (F.octet_length("words_a") / 8).alias("n"), (F.octet_length("words_b") / 8).alias("m"), F.arrow_udf("int")(_common)("words_a", "words_b").alias("common"))
    return saved(counted.where(F.col("common") * 100 >= (F.col("n") + F.col("m") - F.col("common")) * percent).select("a", "b"), "similar-lines")


def without_repeated_lines(docs: DataFrame, percent: int = 80) -> DataFrame:
    """Take from every text of ``docs`` (doc_id, text) the lines that are similar to an earlier line of any document.

    Lines are what newlines part; their order is by doc_id (null first), a hash of the text, and place.  A line goes if an
    earlier line, whether that stays or not, has a word set with 100 * common >= percent * union; so of equal lines the first
    stays.  Words are runs without white space, A-Z as a-z.  Lines without words always stay.  Returns doc_id, n_lines,
    n_removed and text (null stays null, with 0 lines; an empty text is one line).  Rows repeated in full count as one
    row and get the same result; other columns are not read; no rows give no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("text_hash"))
    rarity = count_keys(docs, lambda part: Lines(part).words, text_bytes(docs) // 6 + 1)
    listed = saved(_listed(docs, percent, rarity), "lines")
    lines = listed.where("line IS NOT NULL").select("doc_id", "text_hash", "line", "node")
    place = F.struct("doc_id", "text_hash", "line")
    firsts = saved(lines.groupBy("node").agg(F.min(place).alias("first")), "first-lines")
    first_of = lambda side: firsts.select(F.col("node").alias(side), F.col("first").alias(f"first_{side}"))

    def later(similar: DataFrame) -> DataFrame:
        both = similar.where("a <> b").join(first_of("a"), "a").join(first_of("b"), "b")
        return both.select(F.when(F.col("first_a") < F.col("first_b"), F.col("b")).otherwise(F.col("a")).alias("node")).distinct()

    gone = saved(later(listed.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")).distinct()), "gone")
    entries = listed.where("word IS NOT NULL").select("word", "node", "n", "place", "odd", "half")
    # all words meet, one share of them after the other, so that no more than a share is shuffled at a time
    rounds = [saved(_candidates(entries.where(F.pmod("word", F.lit(ROUNDS)) == i), gone, percent), "line-pairs") for i in range(ROUNDS)]
    pairs = saved(reduce(DataFrame.unionByName, rounds).distinct(), "line-pairs")
    discard(*rounds)
    gone = gone.unionByName(later(_verified(pairs, docs, firsts, percent))).distinct().withColumn("gone", F.lit(True))
    removed = (
        lines.join(firsts.join(gone, "node", "left"), "node").where(F.col("gone").isNotNull() | ~F.col("first").eqNullSafe(place))
        .groupBy(F.col("doc_id").alias("own_id"), F.col("text_hash").alias("own_hash")).agg(F.collect_set("line").alias("removed"))
    )
    removed = _sized(saved(removed, "removed"), BROADCAST_REMOVED)
    marked = docs.join(removed, docs["doc_id"].eqNullSafe(F.col("own_id")) & (docs["text_hash"] == F.col("own_hash")), "left")
    return (
        marked.select("doc_id", "text", F.when(F.col("removed").isNotNull(), F.split("text", "\n", -1)).alias("parts"), F.regexp_count("text", F.lit("\n")).alias("breaks"), "removed")
        .select("doc_id", (F.coalesce(F.col("breaks") + 1, F.lit(0))).cast("long").alias("n_lines"),
                F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
                F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.array_join(
                    F.transform(F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), "removed"), lambda i: F.get("parts", i)), "\n")).alias("text"))
    )
