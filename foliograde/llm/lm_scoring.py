"""Log-probabilities of whole texts under a log-bilinear model trained by noise-contrastive estimation.

Every word belongs to a class: the most frequent words and the end of a text have one of their own, all others one
by their last three bytes, and in it a slot by their hash.  Classes and slots each grow with the cube root of the number
of distinct words, as the words within a pair of both then do, so that the work for a token grows no faster.  A log-bilinear model predicts
the class of a token and then its slot within the class, both from the four tokens before it, each of which has the
sum of a vector for its class and one for its slot.  Within a slot of a class a word has its add-one share of the
training count, and one share stands for the words never seen.  Scores are matrix products over batches of tokens,
normalised over all classes and over the slots of a class weighted by their shares, so the probabilities of all known
words and the unseen ones sum to one.

Counts cover all words of all training texts.  The model is trained in each partition on all its texts, starting from
common parameters, and averaged by tokens; there are ``ROUNDS`` such rounds on disjoint parts of the documents, and
every task goes over its texts of a round once, however many it has.
Words with high counts go to all executors as a table of bounded size; the others are looked up by a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograde.llm.common import saved
from foliograde.llm.words import PLAIN, Words, parts_of, words_of

CONTEXT, WIDTH = 4, 16
#: Least classes, half of them for one word each, and noise slots for a token.
CLASSES, NOISE_SLOTS = 128, 4
#: Most words in the table that every executor gets (20 bytes each).
TABLE_WORDS = 1 << 19
BATCH, NOISE, NOISE_RATIO, RATE, ROUNDS = 2048, 48, 8.0, 0.15, 2
END = np.uint64(0x6A09E667F3BCC908)
#: Distinct words a task holds before it passes their counts on.
HELD_WORDS = 1_000_000
#: Tokens scored at once: few enough that their scores stay in a core's cache.
BLOCK = 1024
#: Tasks that add up the parameters of all training tasks before one adds up theirs.
FAN = 64


class Sizes(NamedTuple):
    """Classes, those of them for one word each, and slots of the others; without slots the class is all."""

    classes: int
    own: int
    slots: int

    def shapes(self) -> list[tuple[int, ...]]:
        """Context and output vectors and biases of the classes, then of the slots; the last context is none."""
        shapes = [(CONTEXT, self.classes + 1, WIDTH), (self.classes, WIDTH), (self.classes,)]
        return shapes + ([(CONTEXT, self.slots + 1, WIDTH), (self.slots, WIDTH)] if self.slots else [])

    def class_of(self, shape: np.ndarray) -> np.ndarray:
        return (self.own + (shape.astype(np.int64) * SPREAD >> 8) % (self.classes - self.own)).astype(np.int32)

    def slot_of(self, hashes: np.ndarray, classes: np.ndarray) -> np.ndarray:
        return np.where(classes >= self.own, (hashes >> np.uint64(20)) % np.uint64(max(1, self.slots)), np.uint64(self.slots)).astype(np.int32)

    def cell_columns(self) -> tuple[Column, Column]:
        """Class without own words, and slot, as columns of ``word`` and ``shape``; as in the functions above."""
        return (F.shiftright(F.col("shape").cast("long") * SPREAD, 8) % (self.classes - self.own)).cast("int"), (
            F.shiftrightunsigned("word", 20) % self.slots).cast("int")


def sizes_for(distinct: int) -> Sizes:
    """About the cube root of the distinct words, for classes and for slots."""
    classes = max(CLASSES, round(distinct ** (1 / 3)))
    return Sizes(classes, classes // 2, classes)


SPREAD = 1_000_003


def _shapes(words: Words) -> np.ndarray:
    """Last three bytes of a word."""
    size, found = words.end - words.start, np.zeros(len(words.end), np.int32)
    for back in (3, 2, 1):
        byte = np.where(size >= back, words.data[np.maximum(words.end - back, 0)], 0).astype(np.int32)
        found = found * 256 + np.where((byte >= 65) & (byte <= 90), byte + 32, byte)
    return found


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = texts = 0

    def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        hashes, shapes, counts = (np.concatenate(x) for x in zip(*held))
        found, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        return found, shapes[first], np.bincount(back, weights=counts).astype(np.int64)

    def out(hashes: np.ndarray, shapes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(hashes.view(np.int64)), pa.array(shapes.astype(np.int32)), pa.array(counts)], names=["word", "shape", "n"])

    for batch in batches:
        for part in parts_of(batch.column(0)):
            texts += len(part)
            words = words_of(part, PLAIN)
            found, first, n = np.unique(words.hash, return_index=True, return_counts=True)
            held.append((found, _shapes(words)[first], n))
            size += len(found)
            if size > 2 * HELD_WORDS:
                held = [merged()]
                size = len(held[0][0])
                if size > HELD_WORDS:
                    yield out(*held[0])
                    held, size = [], 0
    if texts:
        held.append((np.array([END]), np.array([0], np.int32), np.array([texts])))
        yield out(*merged())


class _Lookup:
    """Classes and counts of the words in a table sorted by hash."""

    def __init__(self, table: tuple[np.ndarray, np.ndarray, np.ndarray], sizes: Sizes = Sizes(CLASSES, CLASSES // 2, 0)):
        self.words, self.classes, self.counts = table
        self.sizes = sizes

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Class and count of each word; count -1 if it is not in the table."""
        classes = self.sizes.class_of(_shapes(words))
        if not len(self.words):
            return classes, np.full(len(classes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.words, words.hash), len(self.words) - 1)
        hit = self.words[at] == words.hash
        return np.where(hit, self.classes[at], classes), np.where(hit, self.counts[at], -1)


def _contexts(words: Words, classes: np.ndarray, end_class: int, none: int = CLASSES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class (or slot) of every token, ends included, its text's row, and the classes of the tokens before it."""
    rows = words.rows
    bounds = words.bounds()
    token = np.empty(len(classes) + rows, np.int32)
    row = np.empty(len(token), np.int64)
    at = np.arange(len(classes)) + words.row
    ends = bounds[1:] + np.arange(rows)
    token[at], row[at] = classes, words.row
    token[ends], row[ends] = end_class, np.arange(rows)
    begin = (bounds[:-1] + np.arange(rows))[row]
    before = np.full((CONTEXT, len(token)), none, np.int32)
    for j in range(1, CONTEXT + 1):
        if len(token) > j:
            inside = np.arange(j, len(token)) - j >= begin[j:]
            before[j - 1, j:][inside] = token[:-j][inside]
    return token, row, before


def _tables(flat: np.ndarray, sizes: Sizes) -> list[np.ndarray]:
    ends = np.cumsum([math.prod(x) for x in sizes.shapes()])
    return [part.reshape(x) for part, x in zip(np.split(flat[:ends[-1]], ends[:-1]), sizes.shapes())]


def started(shares: np.ndarray, slots: int = 0) -> np.ndarray:
    """Parameters before training: the classes' shares as biases and small context and output vectors."""
    rng = np.random.default_rng(7)
    shapes = Sizes(len(shares), 0, slots).shapes()
    return np.concatenate([np.log(shares) if len(x) == 1 else rng.normal(0, 0.05, math.prod(x)) for x in shapes]).astype(np.float32)


class Trainer:
    """Noise-contrastive estimation with per-parameter rates, batch after batch.

    ``cells``: shares of the slots (columns) in the classes of many words (rows); noise slots are drawn by them.
    """

    def __init__(self, flat: np.ndarray, shares: np.ndarray, cells: np.ndarray | None = None):
        self.flat = flat.astype(np.float32)
        slots = 0 if cells is None else cells.shape[1]
        self.sizes = Sizes(len(shares), len(shares) - (0 if cells is None else len(cells)), slots)
        self.context, self.out, self.bias, *self.slot = _tables(self.flat, self.sizes)
        self.squares = _tables(np.full(len(flat), 1e-2, np.float32), self.sizes)
        self.offset = np.log(NOISE_RATIO * shares).astype(np.float32)
        self.steps, self.tokens, self.rng = np.cumsum(shares) / np.sum(shares), 0, np.random.default_rng(11)
        if slots:
            self.bounds = np.cumsum(cells.astype(np.float64))

    def _step(self, table: np.ndarray, squares: np.ndarray, places: np.ndarray, gradient: np.ndarray) -> None:
        squares[places] += gradient * gradient
        table[places] -= RATE * gradient / np.sqrt(squares[places])

    def learn(self, token: np.ndarray, before: np.ndarray, slot: np.ndarray | None = None, slots_before: np.ndarray | None = None) -> None:
        every = np.arange(self.sizes.classes)
        for i in range(0, len(token), BATCH):
            w, c = token[i:i + BATCH], before[:, i:i + BATCH]
            n = len(w)
            self.tokens += n
            drawn = np.searchsorted(self.steps, self.rng.random(NOISE), side="right")
            r = sum(self.context[j][c[j]] for j in range(CONTEXT))
            if slot is not None:
                d = slots_before[:, i:i + BATCH]
                r += sum(self.slot[0][j][d[j]] for j in range(CONTEXT))
            real = np.einsum("ij,ij->i", r, self.out[w]) + self.bias[w] - self.offset[w]
            fake = r @ self.out[drawn].T + (self.bias - self.offset)[drawn]
            g_real = (1 / (1 + np.exp(-np.clip(real, -30, 30))) - 1) / n
            g_fake = (1 / (1 + np.exp(-np.clip(fake, -30, 30)))) * np.float32(NOISE_RATIO / NOISE / n)
            g_r = g_real[:, None] * self.out[w] + g_fake @ self.out[drawn]
            places, g_out = _summed(np.r_[w, drawn], np.concatenate([g_real[:, None] * r, g_fake.T @ r]))
            if slot is not None:
                self._learn_slots(r, w, slot[i:i + BATCH], g_r)
                for j in range(CONTEXT):
                    self._step(self.slot[0][j], self.squares[3][j], *_summed(d[j], g_r))
            g_bias = np.bincount(w, g_real, len(every)) + np.bincount(drawn, g_fake.sum(0), len(every))
            for j in range(CONTEXT):
                self._step(self.context[j], self.squares[0][j], *_summed(c[j], g_r))
            self._step(self.out, self.squares[1], places, g_out)
            self._step(self.bias, self.squares[2], every, g_bias.astype(np.float32))

    def _learn_slots(self, r: np.ndarray, w: np.ndarray, slot: np.ndarray, g_r: np.ndarray) -> None:
        """Tell each token's slot from slots drawn by the shares in its class; adds to the gradient of the contexts."""
        at = np.flatnonzero(w >= self.sizes.own)
        if not len(at):
            return
        first = (w[at].astype(np.int64) - self.sizes.own) * self.sizes.slots
        low, high = np.where(first > 0, self.bounds[first - 1], 0.0), self.bounds[first + self.sizes.slots - 1]
        drawn = np.searchsorted(self.bounds, low[:, None] + self.rng.random((len(at), NOISE_SLOTS)) * (high - low)[:, None], side="right")
        drawn = np.clip(drawn - first[:, None], 0, self.sizes.slots - 1)
        both = np.concatenate([slot[at][:, None], drawn], axis=1)
        out, h = self.slot[1][both], r[at]
        guess = 1 / (1 + np.exp(-np.clip(np.einsum("ik,ijk->ij", h, out) - np.float32(math.log(NOISE_SLOTS)), -30, 30)))
        guess[:, 0] -= 1
        guess = (guess / len(w)).astype(np.float32)
        g_r[at] += np.einsum("ij,ijk->ik", guess, out)
        self._step(self.slot[1], self.squares[4], *_summed(both.ravel(), (guess[:, :, None] * h[:, None, :]).reshape(-1, WIDTH)))


def _summed(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and the sums of the rows that share one, by sorting instead of one addition after the other."""
    order = np.argsort(at.astype(np.uint16) if len(at) and at.max() < 1 << 16 else at, kind="stable")  # short numbers are sorted digit by digit
    places = at[order]
    first = np.flatnonzero(np.r_[True, places[1:] != places[:-1]])
    return places[first], np.add.reduceat(rows[order], first, axis=0).astype(np.float32)


def class_log_probs(flat: np.ndarray, token: np.ndarray, before: np.ndarray, slot: np.ndarray | None = None,
                    slots_before: np.ndarray | None = None, cells: np.ndarray | None = None) -> np.ndarray:
    """Natural log of the probability of each token's class, normalised over all classes.

    With ``cells`` also of its slot in the class, divided by the slot's share (a word has a part of it by its count).
    """
    slots = 0 if cells is None else cells.shape[1]
    fixed = (CONTEXT + 1) * WIDTH * slots + 2 * CONTEXT * WIDTH if slots else CONTEXT * WIDTH
    classes = (len(flat) - fixed) // ((CONTEXT + 1) * WIDTH + 1)
    own = classes - (0 if cells is None else len(cells))
    context, out, bias, *more = _tables(flat, Sizes(classes, own, slots))
    found = np.empty(len(token))
    for i in range(0, len(token), BLOCK):
        w = token[i:i + BLOCK]
        r = sum(context[j][before[j, i:i + BLOCK]] for j in range(CONTEXT))
        if slots:
            r += sum(more[0][j][slots_before[j, i:i + BLOCK]] for j in range(CONTEXT))
        scores = r @ out.T
        scores += bias
        scores -= scores.max(axis=1, keepdims=True)
        mine = scores[np.arange(len(w)), w].astype(np.float64)
        np.exp(scores, out=scores)
        found[i:i + BLOCK] = mine - np.log((scores @ np.ones(classes, np.float32)).astype(np.float64))
        if slots and len(at := np.flatnonzero(w >= own)):
            scores = r[at] @ more[1].T
            scores -= scores.max(axis=1, keepdims=True)
            mine = scores[np.arange(len(at)), slot[i:i + BLOCK][at]].astype(np.float64)
            np.exp(scores, out=scores)
            found[i + at] += mine - np.log(np.maximum(np.einsum("ij,ij->i", scores, cells[w[at] - own]), 1e-30))
    return found


def _model(train: DataFrame) -> dict:
    """Counts, classes and trained parameters; ``train``: text and doc_id of the training documents."""
    spark = train.sparkSession
    counts = saved(
        train.select("text").mapInArrow(_counted, "word long, shape int, n long")
        .groupBy("word").agg(F.sum("n").alias("n"), F.first("shape").alias("shape")), "word-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    bins = {r.bin: r.words for r in counts.groupBy(F.floor(F.log2("n") * 4).cast("int").alias("bin")).agg(F.count("*").alias("words")).collect()}  # under 256
    least, words = 0, 0
    for b in sorted(bins, reverse=True):
        words += bins[b]
        if words > TABLE_WORDS:
            least = math.ceil(2 ** ((b + 1) / 4) - 1e-9)
            break
    sizes = sizes_for(distinct)
    top = counts.orderBy(F.desc("n"), "word").limit(sizes.own - 1).toArrow()  # about half the cube root of the distinct words
    own = {int(w): i + 1 for i, w in enumerate(x for x in top.column("word").to_pylist() if x != int(END.view(np.int64)))}
    own[int(END.view(np.int64))] = 0
    is_end = F.col("word") == int(END.view(np.int64))  # always in the table: the later join looks up words only
    table = counts.where((F.col("n") >= least) | is_end).toArrow()  # TABLE_WORDS rows at most, and the end
    hashes = table.column("word").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    hashes, n, shapes = hashes[order], table.column("n").to_numpy()[order], table.column("shape").to_numpy()[order]
    classes = sizes.class_of(shapes)
    small = np.array(sorted(own), np.int64).view(np.uint64)
    small = np.sort(small)
    small_classes = np.array([own[int(x)] for x in small.view(np.int64)], np.int32)
    at = np.searchsorted(hashes, small)
    for place, word, cls in zip(at, small, small_classes):
        if place < len(hashes) and hashes[place] == word:
            classes[place] = cls
    sums, cells = np.zeros(sizes.classes), np.ones((sizes.classes - sizes.own, sizes.slots), np.float32)
    shape, slot = sizes.cell_columns()
    many = counts.join(F.broadcast(spark.createDataFrame([(w,) for w in own], "word long")), "word", "left_anti")
    found = many.groupBy(shape.alias("shape"), slot.alias("slot")).agg(F.sum("n").alias("n"), F.count("*").cast("int").alias("words")).toArrow()  # a row per cell: half the power 2/3 of the words
    at, place, counted = (found.column(x).to_numpy() for x in ("shape", "slot", "n"))
    cells[at, place] += counted + found.column("words").to_numpy()
    sums[sizes.own:] = np.bincount(at, counted, sizes.classes - sizes.own)
    for w, c in zip(hashes.view(np.int64).tolist(), n.tolist()):
        if w in own:
            sums[own[w]] += c
    shares = (sums + 1) / (sums.sum() + sizes.classes)
    flat = started(shares, sizes.slots)
    small_table = spark.sparkContext.broadcast((small, small_classes, np.zeros(len(small), np.int64)))
    shared_cells = spark.sparkContext.broadcast(cells)
    for step in range(ROUNDS):
        part = train.where(F.pmod(F.xxhash64("doc_id", F.lit("round")), F.lit(ROUNDS)) == step).select("text")
        flat = _averaged(part, spark.sparkContext.broadcast(flat), shares, small_table, flat, sizes, shared_cells)
    return {"counts": counts, "least": least, "total": total, "distinct": distinct, "flat": flat, "sizes": sizes, "cells": shared_cells,
            "table": (hashes, classes, n)}


def _tokens(words: Words, classes: np.ndarray, sizes: Sizes) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """Class of every token and of those before it, the same of the slots if there are any, and the token's text."""
    token, row, before = _contexts(words, classes, 0, sizes.classes)
    if not sizes.slots:
        return (token, before), row
    slot, _, slots_before = _contexts(words, sizes.slot_of(words.hash, classes), sizes.slots, sizes.slots)
    return (token, before, slot, slots_before), row


def _averaged(part: DataFrame, start, shares: np.ndarray, small_table, before_round: np.ndarray, sizes: Sizes = Sizes(CLASSES, CLASSES // 2, 0),
              cells=None) -> np.ndarray:
    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, trainer = _Lookup(small_table.value, sizes), Trainer(start.value, shares, cells and cells.value)
        for batch in batches:
            for texts in parts_of(batch.column(0)):
                words = words_of(texts, PLAIN)
                trainer.learn(*_tokens(words, lookup.find(words)[0], sizes)[0])
        if trainer.tokens:
            yield _sum_row(TaskContext.get().partitionId(), trainer.flat * float(trainer.tokens), float(trainer.tokens))

    sums = part.mapInArrow(trained, _SUM).repartition(FAN, "task").mapInArrow(_added, _SUM)
    found = sums.repartition(1).mapInArrow(_added, _SUM).collect()  # one row, of all parameters
    return np.divide(np.frombuffer(found[0]["total"]), found[0]["weight"]).astype(np.float32) if found else before_round.copy()


_SUM = "task long, total binary, weight double"


def _sum_row(task: int, total: np.ndarray, weight: float) -> pa.RecordBatch:
    return pa.record_batch(
        [pa.array([task], pa.int64()), pa.array([total.astype(np.float64).tobytes()], pa.binary()), pa.array([weight])], names=["task", "total", "weight"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for all rows of a task: sums of parameters, weighted by tokens; one row is held at a time."""
    total, weight, task = None, 0.0, 0
    for batch in batches:
        for i in range(batch.num_rows):
            own = np.frombuffer(batch.column(1)[i].as_buffer())
            total = own.copy() if total is None else total + own
            weight += batch.column(2)[i].as_py()
            task = batch.column(0)[i].as_py()
    if total is not None:
        yield _sum_row(task, total, weight)


def scored(docs: DataFrame, held_out) -> DataFrame:
    """Score every row of ``docs`` (doc_id, text), learning from the rows where ``held_out`` is not true.

    Returns doc_id, held_out, n_tokens (words and one end), n_known, train_tokens, base_score and score (both log10).
    Null and empty texts have one token, the end.  Rows that are repeated are scored each; an id that is null counts
    as training; without training texts the base score is 0 and the model is the one before training.  Other columns
    are not read.
    """
    spark = docs.sparkSession
    marked = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    model = _model(marked.where("NOT held_out").select("doc_id", "text"))
    shared = spark.sparkContext.broadcast(model["table"])
    flat = spark.sparkContext.broadcast(model["flat"])
    base = math.log10(model["total"] + model["distinct"] + 1)
    sizes, cells = model["sizes"], model["cells"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = _Lookup(shared.value, sizes)
        end_at = np.searchsorted(lookup.words, END) if len(lookup.words) else 0
        ends = int(lookup.counts[end_at]) if end_at < len(lookup.words) and lookup.words[end_at] == END else 0
        for batch in batches:
            done = 0
            for texts in parts_of(batch.column(batch.schema.get_field_index("text"))):
                words = words_of(texts, PLAIN)
                classes, counts = lookup.find(words)
                tokens_of, row = _tokens(words, classes, sizes)
                n = len(texts)
                total = np.bincount(row, class_log_probs(flat.value, *tokens_of, cells.value) / math.log(10), n)
                known = counts >= 0
                logs = np.log10(np.maximum(counts, 0) + 1.0)
                base_part = np.bincount(words.row, logs, n) + math.log10(ends + 1)
                within = np.bincount(words.row, np.where(classes >= sizes.own, logs, 0.0), n)
                tokens = np.bincount(row, minlength=n)
                rare = words.hash[~known].view(np.int64)
                starts = np.searchsorted(words.row[~known], np.arange(n + 1)).astype(np.int32)
                own = batch.slice(done, n)
                done += n
                yield pa.record_batch([
                    own.column(0), own.column(1), own.column(2), pa.array(tokens.astype(np.int64)),
                    pa.array((np.bincount(words.row, known, n) + (ends > 0)).astype(np.int64)),
                    pa.array(base_part - base * tokens), pa.array(total + within),
                    pa.ListArray.from_arrays(pa.array(starts), pa.array(rare))],
                    names=["row_id", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare"])

    kind = dict(docs.dtypes)["doc_id"]
    table = saved(
        marked.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "held_out", "text").mapInArrow(
            rows, f"row_id long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<long>"), "scores")
    rare = (
        table.select("row_id", F.explode("rare").alias("word"))
        .join(model["counts"].where(F.col("n") < model["least"]), "word")
        .groupBy("row_id").agg(F.sum(F.log10(F.col("n") + 1)).alias("logs"), F.count("*").alias("seen"))
    )
    return table.drop("rare").join(rare, "row_id", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("seen", F.lit(0))).alias("n_known"),
        F.lit(model["total"]).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("logs", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("logs", F.lit(0.0))).alias("score"))
