"""Hard negatives by the threshold algorithm: sorted lists per dimension, random access to whole vectors.

Rows are dealt to shards of bounded size, those of a common label to shards of their own, those of rare labels together.
A shard keeps, for each dimension, its rows in the order of that component.  For an anchor the lists are read from the
side that its component's sign asks for, some ranks at a time; rows met for the first time are scored as whole vectors.
No row that was not met yet can score above the threshold, the anchor times the components at the ranks reached.
Reading stops once the threshold lies strictly below the k-th score of every window (or below the window's lower end,
while it holds fewer than k), so rows that tie with the k-th are met too.

Anchors come in blocks of bounded size.  A first pass over a block finds each anchor's positives, a second one the
negatives in the window of each positive; both carry the k-th scores of a task from shard to shard.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliograde.llm.common import saved

#: Rows of a shard, anchors of a block (with 64 components 8 MB), ranks read from each list at a time.
SHARD_ROWS, BLOCK_ANCHORS, STEP = 4096, 16_384, 64
#: Most labels whose counts are broadcast.
BROADCAST_LABELS = 400_000
LOWEST = np.iinfo(np.int64).min // 2
_PARTS = ["rows", "ids", "labels", "vectors", "order"]
_FOUND = "anchor long, window int, id long, score long, row long"


def usable_rows(table: DataFrame, scale: int = 256) -> DataFrame:
    """row (a number of its own for every row), vec_id, label and the vector as integers floor(scale * x).

    Rows with a null vec_id, label or vector, or with a component that is null or not finite, are left out.
    """
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(x * F.lit(float(scale))).cast("long"))
    rows = table.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fine, F.lit(False)))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), whole.alias("vector"))


class Lists:
    """The rows of one shard and, for each dimension, their order by that component."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, order: np.ndarray | None = None):
        self.rows, self.ids, self.labels, self.vectors = rows, ids, labels, vectors
        self.order = np.argsort(vectors, axis=0, kind="stable").astype(np.int32) if order is None else order
        self.sorted = np.take_along_axis(vectors, self.order, axis=0)

    def met(self, anchor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """Rows met for the first time, their scores, and the threshold for all rows not met yet."""
        n = len(self.rows)
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        fresh = np.ones(n, bool)
        for start in range(0, n, STEP):
            stop = min(n, start + STEP)
            lists = np.concatenate([self.order[n - stop:n - start, up].ravel(), self.order[start:stop, down].ravel()])
            if not len(lists):  # a zero anchor scores 0 everywhere
                lists = np.arange(n, dtype=np.int32)
            new = np.unique(lists[fresh[lists]])
            fresh[new] = False
            bound = int(anchor[up] @ self.sorted[n - stop, up] + anchor[down] @ self.sorted[stop - 1, down])
            yield new, self.vectors[new] @ anchor, bound
            if not fresh.any():
                return


class Windows:
    """The k best rows with scores from ``low`` to ``high`` for each window of one anchor."""

    def __init__(self, k: int, low: np.ndarray, high: np.ndarray):
        self.k, self.low, self.high = k, low, high
        self.best: list[list[tuple[int, int, int]]] = [[] for _ in low]

    def kth(self) -> int:
        """No row that scores below this can enter any window."""
        return min((max(int(low), -best[-1][0]) if len(best) == self.k else int(low)) for best, low in zip(self.best, self.low))

    def add(self, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        for w, best in enumerate(self.best):
            least = max(int(self.low[w]), -best[-1][0]) if len(best) == self.k else self.low[w]
            inside = np.flatnonzero((scores >= least) & (scores <= self.high[w]))
            if len(inside):
                inside = inside[np.lexsort((rows[inside], ids[inside], -scores[inside]))[:self.k]]
                self.best[w] = sorted(best + list(zip((-scores[inside]).tolist(), ids[inside].tolist(), rows[inside].tolist())))[:self.k]

    def search(self, lists: Lists, anchor: np.ndarray, eligible: Callable[[np.ndarray], np.ndarray]) -> None:
        for new, scores, bound in lists.met(anchor):
            fit = eligible(new)
            if fit.any():
                chosen = new[fit]
                self.add(scores[fit], lists.ids[chosen], lists.rows[chosen])
            if bound < self.kth():
                return


def _padded(rows: list, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for i, row in enumerate(rows):
        out[i, :len(row)] = row
    return out


def _built(group: pa.Table, width: int) -> pa.Table:
    lists = Lists(*[group.column(name).to_numpy() for name in ("row", "vec_id", "label")], _padded(group.column("vector").to_pylist(), width))
    return pa.table({name: pa.array([np.ascontiguousarray(getattr(lists, name)).tobytes()], pa.binary()) for name in _PARTS})


def _read(row: dict, width: int) -> Lists:
    rows, ids, labels, vectors = (np.frombuffer(row[name], np.int64) for name in _PARTS[:4])
    return Lists(rows, ids, labels, vectors.reshape(-1, width), np.frombuffer(row["order"], np.int32).reshape(-1, width))


def shards(rows: DataFrame, width: int) -> DataFrame:
    """One row per shard with its lists.  Labels of SHARD_ROWS rows or more are split by a hash into shards of their own;
    rarer ones share shards, dealt by a hash of the label."""
    counts = saved(rows.groupBy("label").agg(F.count("*").alias("n")), "label-counts")
    n_labels, rare = counts.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("n") < SHARD_ROWS, F.col("n"))), F.lit(0))).first()
    pools = max(1, -(-rare // SHARD_ROWS))
    common = counts.where(F.col("n") >= SHARD_ROWS)
    common = F.broadcast(common) if n_labels <= BROADCAST_LABELS else common
    piece = F.pmod(F.xxhash64("row"), F.ceil(F.col("n") / SHARD_ROWS).cast("long"))
    dealt = rows.join(common, "label", "left").withColumn("pool", F.when(F.col("n").isNull(), F.pmod(F.xxhash64("label"), F.lit(pools))).otherwise(F.lit(-1)))
    keyed = dealt.select("row", "vec_id", "label", "vector", "pool", F.when(F.col("n").isNotNull(), F.col("label")).alias("own"), F.coalesce(piece, F.lit(0)).alias("piece"))
    kinds = ", ".join(f"{name} binary" for name in _PARTS)
    return keyed.groupBy("pool", "own", "piece").applyInArrow(lambda group: _built(group, width), kinds)


def hard_negatives(table: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, percent: int = 80, scale: int = 256) -> DataFrame:
    """Hard negatives from ``table`` (vec_id, embedding, label): for each anchor and each of its ``positives`` best other
    rows of the same label, the ``negatives`` best rows of other labels that score between ``percent`` per cent of the
    positive's score and that score.

    ``is_anchor`` is a column over vec_id; a score is the inner product of vectors rounded down to integers at ``scale``,
    ties go to the smaller vec_id.  Returns anchor_id, positive_id, rank (from 1), negative_id, positive_score and
    negative_score.  Rows with a null vec_id, label or vector, or with a null or infinite component, take no part;
    shorter vectors count as filled up with zeros; every row of a repeated id is a row of its own, and an anchor leaves
    out only its own row; an anchor without positives, and a positive with an empty window (always, if it scores below
    zero), give no rows; empty tables give no rows.  Other columns are not read.
    """
    rows = saved(usable_rows(table, scale).withColumn("row", F.monotonically_increasing_id()), "rows")
    width = rows.agg(F.coalesce(F.max(F.size("vector")), F.lit(0))).first()[0] or 1
    built = saved(shards(rows, width), "shards")
    anchors = saved(rows.where(is_anchor).withColumn("block", F.pmod(F.xxhash64("row", F.lit("block")), F.lit(10**9))), "anchors")
    blocks = max(1, -(-anchors.count() // BLOCK_ANCHORS))
    out = None
    for block in range(blocks):
        own = anchors.where(F.col("block") % blocks == block).select("row", "vec_id", "label", "vector").toArrow()  # about BLOCK_ANCHORS rows
        found = saved(_mined(built, own, width, positives, negatives, percent), "mined")
        out = found if out is None else out.unionByName(found)
    return out


def _mined(built: DataFrame, own: pa.Table, width: int, positives: int, negatives: int, percent: int) -> DataFrame:
    spark = built.sparkSession
    rows, ids, labels = (own.column(name).to_numpy() for name in ("row", "vec_id", "label"))
    vectors = _padded(own.column("vector").to_pylist(), width)

    def search(k: int, lows: np.ndarray, highs: np.ndarray, same: bool) -> DataFrame:
        """The k best rows of each window (anchor by window; empty if low > high), over all shards."""
        block = spark.sparkContext.broadcast((rows, labels, vectors, lows, highs))

        def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own_rows, own_labels, queries, low, high = block.value
            real = [np.flatnonzero(a <= b) for a, b in zip(low, high)]
            windows = [Windows(k, low[i][w], high[i][w]) for i, w in enumerate(real)]
            for batch in batches:
                for at in range(batch.num_rows):
                    lists = _read(batch.slice(at, 1).to_pylist()[0], width)
                    for i, some in enumerate(windows):
                        fits = lists.labels == own_labels[i] if same else lists.labels != own_labels[i]
                        fits &= lists.rows != own_rows[i]
                        if len(some.best) and fits.any():
                            some.search(lists, queries[i], lambda new: fits[new])
            columns = list(zip(*[(i, w, one, -score, row) for i, some in enumerate(windows) for w, best in zip(real[i].tolist(), some.best) for score, one, row in best]))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns or [[]] * 5, kinds)], names=["anchor", "window", "id", "score", "row"])

        best = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id", "row")
        return built.mapInArrow(searched, _FOUND).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    n = len(rows)
    near = search(positives, np.full((n, 1), LOWEST), np.full((n, 1), -LOWEST), same=True).toArrow()  # at most positives rows per anchor
    at, place = near.column("anchor").to_numpy(), near.column("rank").to_numpy() - 1
    scores, good = np.full((n, positives), -1), np.full((n, positives), -1)
    scores[at, place], good[at, place] = near.column("score").to_numpy(), near.column("id").to_numpy()
    lows = -(-percent * scores // 100)  # the least whole score that is not below; above the score itself if that is negative
    hard = search(negatives, lows, scores, same=False)
    pairs = pa.table({
        "anchor": np.repeat(np.arange(n), positives), "window": np.tile(np.arange(positives, dtype=np.int32), n),
        "anchor_id": np.repeat(ids, positives), "positive_id": good.ravel(), "positive_score": scores.ravel()})
    named = spark.createDataFrame(pairs)
    joined = hard.join(F.broadcast(named), ["anchor", "window"])  # positives rows per anchor of the block
    return joined.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
