"""Exact search for the largest inner products: one ball tree per shard, branch and bound.

Vectors are dealt to shards of bounded size by a hash.  A shard is a tree of balls; no vector in a ball of centre c and
radius r scores above q.c + |q| r.  Queries come in blocks of bounded size.  For a block all shards are searched at
once; a task visits the nodes of its shards with the largest bound first, drops a query from a branch as soon as the
bound is below the query's k-th score, and carries that score from shard to shard.  Every task starts from the k-th
scores that a first search over a few shards has found.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliograde.llm.common import saved

SHARD_ROWS, LEAF_ROWS, BLOCK_QUERIES, FIRST_SHARDS = 4096, 64, 4096, 2
LOWEST = np.iinfo(np.int64).min + 1  # its negative is a number too


def whole_vectors(table: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id, copy (tells apart rows of one id) and the vector as integers floor(scale * x).

    Rows whose vector is null, or holds a null or a number that is not finite, are left out.
    """
    fine = F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))
    whole = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(x * F.lit(float(scale))).cast("long"))
    rows = table.where(fine & F.col("vec_id").isNotNull()).select("vec_id", whole.alias("vector"))
    copies = Window.partitionBy("vec_id").orderBy("vector")
    return rows.withColumn("copy", F.row_number().over(copies))


class Tree:
    """Balls over one shard; nodes in breadth-first order, leaves hold slices of the reordered vectors."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray, vectors: np.ndarray):
        order = np.arange(len(ids))
        spans, children, queue = [(0, len(ids))], [(-1, -1)], [0]
        while queue:
            node = queue.pop()
            low, high = spans[node]
            if high - low <= LEAF_ROWS:
                continue
            own = order[low:high]
            part = vectors[own]
            axis = int(np.argmax(part.max(axis=0) - part.min(axis=0))) if part.shape[1] else 0
            middle = (high - low) // 2
            if part.shape[1]:
                order[low:high] = own[np.argpartition(part[:, axis], middle)]
            for span in ((low, low + middle), (low + middle, high)):
                spans.append(span)
                children.append((-1, -1))
            children[node] = (len(spans) - 2, len(spans) - 1)
            queue += children[node]
        self.ids, self.copies, self.vectors = ids[order], copies[order], vectors[order]
        self.spans, self.children = np.array(spans), np.array(children)
        reals = self.vectors.astype(np.float64)
        self.centres = np.array([reals[a:b].mean(axis=0) for a, b in spans])
        self.radii = np.array([np.sqrt(((reals[a:b] - c) ** 2).sum(axis=1).max()) for (a, b), c in zip(spans, self.centres)])


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, query_copies: np.ndarray, k: int, floor: np.ndarray):
        self.queries, self.ids, self.copies, self.k, self.floor = queries, query_ids, query_copies, k, floor
        self.lengths = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
        self.score = np.full((len(queries), k), LOWEST)
        self.found = np.zeros((len(queries), k), np.int64)

    def kth(self) -> np.ndarray:
        return np.maximum(self.score[:, -1], self.floor)

    def add(self, active: np.ndarray, ids: np.ndarray, copies: np.ndarray, vectors: np.ndarray) -> None:
        scores = self.queries[active] @ vectors.T
        scores[(self.ids[active][:, None] == ids) & (self.copies[active][:, None] == copies)] = LOWEST
        all_scores = np.concatenate([self.score[active], scores], axis=1)
        all_ids = np.concatenate([self.found[active], np.broadcast_to(ids, scores.shape)], axis=1)
        order = np.lexsort((all_ids, -all_scores), axis=1)[:, :self.k] if all_scores.size else np.zeros((0, self.k), int)
        self.score[active] = np.take_along_axis(all_scores, order, axis=1)
        self.found[active] = np.take_along_axis(all_ids, order, axis=1)

    def search(self, tree: Tree) -> None:
        queries = self.queries.astype(np.float64)
        slack = 1e-9 * (1 + np.abs(queries).sum(axis=1) * (np.abs(tree.vectors).max() if tree.vectors.size else 0))
        bounds = queries @ tree.centres.T + np.outer(self.lengths, tree.radii) + slack[:, None]
        heap = [(-np.inf, 0, np.arange(len(queries)))]
        while heap:
            _, node, active = heapq.heappop(heap)
            active = active[bounds[active, node] >= self.kth()[active]]
            if not len(active):
                continue
            low, high = tree.spans[node]
            left, right = tree.children[node]
            if left < 0:
                self.add(active, tree.ids[low:high], tree.copies[low:high], tree.vectors[low:high])
                continue
            for child in (left, right):
                heapq.heappush(heap, (-float(bounds[active, child].max()), int(child), active))


def _padded(rows: list, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for i, row in enumerate(rows):
        out[i, :len(row)] = row
    return out


def _built(group: pa.Table, width: int) -> pa.Table:
    """The rows of one shard as a table of one row that holds its tree."""
    tree = Tree(group.column("vec_id").to_numpy(), group.column("copy").to_numpy().astype(np.int64), _padded(group.column("vector").to_pylist(), width))
    columns = {name: pa.array([np.ascontiguousarray(getattr(tree, name)).tobytes()], pa.binary()) for name in _PARTS}
    return pa.table({"shard": pa.array([group.column("shard")[0].as_py()], pa.int32())} | columns)


_PARTS = ["ids", "copies", "vectors", "spans", "children", "centres", "radii"]


def _read_tree(row: dict, width: int) -> Tree:
    tree = Tree.__new__(Tree)
    whole = lambda name: np.frombuffer(row[name], np.int64)
    tree.ids, tree.copies, tree.vectors = whole("ids"), whole("copies"), whole("vectors").reshape(-1, width)
    tree.spans, tree.children = whole("spans").reshape(-1, 2), whole("children").reshape(-1, 2)
    tree.centres, tree.radii = np.frombuffer(row["centres"]).reshape(-1, width), np.frombuffer(row["radii"])
    return tree


def top_products(table: DataFrame, is_query, k: int = 10, scale: int = 1024) -> DataFrame:
    """The k largest inner products of each query with all other rows of ``table`` (vec_id, embedding).

    ``is_query`` is a column over vec_id.  Returns query_id, rank (from 1), vec_id and score, ties to the smaller
    vec_id.  Vectors that are null or hold a null or a number that is not finite take no part, nor do rows without an
    id; shorter vectors count as filled up with zeros; every row of a repeated id is a row of its own, and a query
    leaves out only its own row; fewer than k other rows give fewer ranks; empty tables give no rows.
    """
    vectors = saved(whole_vectors(table, scale), "vectors")
    total, width = vectors.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    width = max(1, width)
    shards = max(1, -(-total // SHARD_ROWS))
    shard = F.pmod(F.xxhash64("vec_id", "copy"), F.lit(shards)).cast("int")
    dealt = vectors.withColumn("shard", shard)
    kinds = "shard int, " + ", ".join(f"{name} binary" for name in _PARTS)

    trees = saved(dealt.groupBy("shard").applyInArrow(lambda group: _built(group, width), kinds), "trees")
    queries = saved(vectors.where(is_query).withColumn(
        "block", F.pmod(F.xxhash64("vec_id", "copy", F.lit("block")), F.lit(10**9))), "queries")
    n_queries = queries.count()
    blocks = max(1, -(-n_queries // BLOCK_QUERIES))
    results = []
    for block in range(blocks):
        own = queries.where(F.col("block") % blocks == block).select("vec_id", "copy", "vector").toArrow()  # about BLOCK_QUERIES rows
        if own.num_rows:
            results.append(saved(_block(trees, own, width, shards, k), "found"))
    if not results:
        return vectors.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).limit(0)
    found = results[0]
    for more in results[1:]:
        found = found.unionByName(more)
    best = Window.partitionBy("query_id", "query_copy").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _block(trees: DataFrame, own: pa.Table, width: int, shards: int, k: int) -> DataFrame:
    spark = trees.sparkSession
    ids, copies = own.column("vec_id").to_numpy(), own.column("copy").to_numpy().astype(np.int64)
    matrix = _padded(own.column("vector").to_pylist(), width)

    def searched(floors: np.ndarray):
        block = spark.sparkContext.broadcast((matrix, ids, copies, floors))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            queries, query_ids, query_copies, floor = block.value
            best = Best(queries, query_ids, query_copies, k, floor)
            for batch in batches:
                for i in range(batch.num_rows):
                    best.search(_read_tree(batch.slice(i, 1).to_pylist()[0], width))
            row, place = np.nonzero(best.score > LOWEST)
            yield pa.record_batch(
                [pa.array(query_ids[row]), pa.array(query_copies[row]), pa.array(best.found[row, place]), pa.array(best.score[row, place])],
                names=["query_id", "query_copy", "vec_id", "score"])

        return search

    kinds = "query_id long, query_copy long, vec_id long, score long"
    floors = np.full(len(ids), LOWEST)
    if shards > FIRST_SHARDS:
        first = trees.where(F.col("shard") < FIRST_SHARDS).coalesce(1).mapInArrow(searched(floors), kinds)
        kth = first.groupBy("query_id", "query_copy").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") == k).toArrow()
        known = dict(zip(zip(kth.column("query_id").to_pylist(), kth.column("query_copy").to_pylist()), kth.column("kth").to_pylist()))
        floors = np.array([known.get(key, LOWEST) for key in zip(ids.tolist(), copies.tolist())], np.int64)
    return trees.mapInArrow(searched(floors), kinds)
