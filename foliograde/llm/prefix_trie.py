"""A prefix trie of conversations by ROLLUP: one aggregation counts all prefixes of all conversations.

A conversation is cut into blocks of four turns.  A row holds one block of one conversation: the digests of its turns in
four columns and the key of the node that the block before ends in, so that
``GROUP BY block, key, ROLLUP (t1, t2, t3, t4)`` makes a group for each node and ``grouping_id()`` tells its depth.  A
long conversation has more rows, not more rounds: the key of a prefix is the exclusive or of one 128-bit number per turn
(of its depth and digest), a running aggregate that no task has to follow from the first turn on.

A first rollup gives each node's members, its smallest member and how many end there.  Each node is then owned by its
smallest member; a member owns the lower end of its own path.  What a conversation's own nodes add to the nodes above
is a sum from the end of its path upwards; a second rollup over the owners' rows adds these up for all subtrees at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliograde.llm.common import PLAIN_WORD, saved

WIDTH = 4
#: Blocks of one conversation that a running aggregate orders in one task.
RUN = 4096
#: Ids that are joined into one piece of text before it is hashed.
PIECE = 65_536
#: A node with more than one child in this many is met by broadcast: there are fewer such nodes than this.
HOT_SHARE = 1000
_TURNS = [f"t{j}" for j in range(1, WIDTH + 1)]
_KEY = ["key1", "key2"]
_NODE = ["depth", "node1", "node2"]


def numbered_turns(turns: DataFrame) -> DataFrame:
    """conv_id, at (1, 2, ... within the conversation, in turn order), digest and words of every turn.

    The order is by turn (null first), role, text.  All turns are sorted together and a task counts on in what it
    reads, so a conversation of any length is dealt over tasks; the counts of the tasks before are added afterwards.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"), F.monotonically_increasing_id().alias("row"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text", "row"]
    digest = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "conv_id", digest.alias("digest"), F.regexp_count("text", F.lit(PLAIN_WORD)).cast("long").alias("words"), F.spark_partition_id().alias("task"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at = None, 0
        for batch in batches:
            places = []
            for conv_id in batch.column(0).to_pylist():
                at = at + 1 if conv_id == last else 1
                last = conv_id
                places.append(at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], names=[*batch.schema.names, "local"])

    local = saved(ordered.mapInArrow(counted, "conv_id long, digest binary, words long, task int, local long"), "turns")
    # a task goes on with at most one conversation of the tasks before it: one row per task at most
    per_task = local.groupBy("conv_id", "task").agg(F.max("local").alias("n"))
    spread = per_task.groupBy("conv_id").agg(F.count("*").alias("tasks")).where("tasks > 1").select("conv_id")
    before = Window.partitionBy("conv_id").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_task.join(F.broadcast(spread), "conv_id").select("conv_id", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return local.join(F.broadcast(offsets), ["conv_id", "task"], "left").select(
        "conv_id", (F.col("local") + F.coalesce("offset", F.lit(0))).alias("at"), "digest", "words")


def with_shared_heads(turns: DataFrame, base: Column, head: Column) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations: the first ``head`` turns of conversation ``base``, then the own turns after the first ``head``.

    ``turns`` as ``numbered_turns`` gives them; ``base`` and ``head`` are columns over conv_id.  A base that is absent
    gives no turns, a shorter one all it has.  Returns the turns (conv_id, at, digest, words) and every conv_id, those
    without turns too.
    """
    turns = saved(turns, "numbered")
    convs = saved(turns.groupBy("conv_id").agg(F.max("at").alias("n")).withColumn("base", base).withColumn("head", head), "convs")
    lengths = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    taken = saved(convs.join(lengths, "base", "left").select(
        "conv_id", "base", "head", F.least(F.col("head"), F.coalesce("n_base", F.lit(0))).cast("long").alias("taken")), "taken")
    most = taken.agg(F.max("taken")).first()[0] or 0
    heads = turns.where(F.col("at") <= most).withColumnRenamed("conv_id", "base")
    shared = taken.select("conv_id", "base", "taken").join(heads, "base").where(F.col("at") <= F.col("taken")).select("conv_id", "at", "digest", "words")
    # own turns keep their places unless the base is shorter than the head; a long conversation meets that in runs
    moved = taken.where("taken < head").join(convs.select("conv_id", "n"), "conv_id").select(
        "conv_id", (F.col("head") - F.col("taken")).alias("by"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / RUN))).alias("run"))
    own = turns.withColumn("head", head).where("at > head").withColumn("run", F.floor(F.col("at") / RUN))
    kept = own.join(moved, ["conv_id", "run"], "left").select("conv_id", (F.col("at") - F.coalesce("by", F.lit(0))).alias("at"), "digest", "words")
    return shared.unionByName(kept), convs.select("conv_id")


def _running(df: DataFrame, values: dict[str, str], fold: Callable[[Column], Column], start: Column, join: Callable[[Column, Column], Column], backwards: bool = False) -> DataFrame:
    """Add, for each new name, the fold of a column over the conversation's blocks before (after, if ``backwards``).

    In two levels: within runs of RUN blocks, and over the runs of a conversation, so that no task gets a whole long
    conversation.
    """
    block = F.col("block") * (-1 if backwards else 1)
    df = df.withColumn("run", F.floor(block / RUN))
    earlier = lambda *part, by: Window.partitionBy(*part).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    runs = df.groupBy("conv_id", "run").agg(*[fold(F.col(name)).alias(name) for name in values])
    runs = runs.select("conv_id", "run", *[F.coalesce(fold(F.col(name)).over(earlier("conv_id", by="run")), start).alias(f"run_{out}") for name, out in values.items()])
    inner = [F.coalesce(fold(F.col(name)).over(earlier("conv_id", "run", by=block)), start).alias(out) for name, out in values.items()]
    joined = df.select("*", *inner).join(runs, ["conv_id", "run"])
    for out in values.values():
        joined = joined.withColumn(out, join(F.col(out), F.col(f"run_{out}"))).drop(f"run_{out}")
    return joined.drop("run")


def _xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def _mark(salt: int, depth: Column, digest: Column) -> Column:
    return F.xxhash64(F.lit(salt), depth, digest)


def blocks_of(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """conv_id, block (from 0), t1 to t4, w1 to w4 (words), n (turns of the conversation in the block) and the key of the
    node before the block.  Every conversation has a block 0, without turns if it has none."""
    block, slot = F.floor((F.col("at") - 1) / WIDTH), (F.col("at") - 1) % WIDTH + 1
    placed = turns.select("conv_id", block.alias("block"), slot.cast("int").alias("slot"), "digest", "words",
                          *[_mark(salt, F.col("at"), F.col("digest")).alias(f"own_{key}") for salt, key in enumerate(_KEY)])
    every = placed.unionByName(convs.select("conv_id", F.lit(0).cast("long").alias("block"), F.lit(0).alias("slot")), allowMissingColumns=True)
    rows = every.groupBy("conv_id", "block").agg(
        *[F.max(F.when(F.col("slot") == j, F.col("digest"))).alias(f"t{j}") for j in range(1, WIDTH + 1)],
        *[F.max(F.when(F.col("slot") == j, F.col("words"))).alias(f"w{j}") for j in range(1, WIDTH + 1)],
        F.max("slot").alias("n"),
        *[F.coalesce(F.bit_xor(f"own_{key}"), F.lit(0).cast("long")).alias(f"own_{key}") for key in _KEY])
    keyed = _running(rows, {f"own_{key}": key for key in _KEY}, F.bit_xor, F.lit(0).cast("long"), _xor)
    return keyed.drop(*[f"own_{key}" for key in _KEY])


def _rolled(rows: DataFrame, measures: list[str]) -> DataFrame:
    """One row per node: block, level (0 to 4), the key before the block, t1 to t4 and the measures (LEVEL: the level).

    Left out are groups past a conversation's end and, but for the root, level 0, which is level 4 of the block before.
    """
    level = f"{WIDTH} - CAST(bit_count(grouping_id()) AS INT)"
    out = rows.sparkSession.sql(f"""
        SELECT block, {", ".join(_KEY + _TURNS)}, {level} AS level, {", ".join(measures).replace("LEVEL", level)}
        FROM {{rows}} GROUP BY block, {", ".join(_KEY)}, ROLLUP ({", ".join(_TURNS)})""", rows=rows)
    last = F.get(F.array(*_TURNS), F.col("level") - 1)
    return out.where(((F.col("level") > 0) & last.isNotNull()) | ((F.col("level") == 0) & (F.col("block") == 0)))


def _with_keys(nodes: DataFrame) -> DataFrame:
    """depth, the node's own key (node1, node2) and its parent's (up1, up2) in place of block, level and turns."""
    depth = F.col("block") * WIDTH + F.col("level")
    own = {}
    for salt, key in enumerate(_KEY):
        marks = [F.when(F.col("level") >= j, _mark(salt, F.col("block") * WIDTH + j, F.col(f"t{j}"))).otherwise(F.lit(0).cast("long")) for j in range(1, WIDTH + 1)]
        below = [F.when(F.col("level") > j, m).otherwise(F.lit(0).cast("long")) for j, m in enumerate(marks, 1)]
        for name, parts in ((f"node{salt + 1}", marks), (f"up{salt + 1}", below)):
            value = F.col(key)
            for part in parts:
                value = value.bitwiseXOR(part)
            own[name] = value
    return nodes.select(depth.cast("long").alias("depth"), *[c.alias(name) for name, c in own.items()], *[c for c in nodes.columns if c not in ("block", "level", *_TURNS, *_KEY)])


def ends_of(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """conv_id and the node (depth, node1, node2) that it ends at; the root for one without turns."""
    marks = turns.select("conv_id", "at", *[_mark(salt, F.col("at"), F.col("digest")).alias(f"node{salt + 1}") for salt in range(2)])
    every = marks.unionByName(convs.select("conv_id", F.lit(0).cast("long").alias("at")), allowMissingColumns=True)
    return every.groupBy("conv_id").agg(F.max("at").alias("depth"), *[F.coalesce(F.bit_xor(k), F.lit(0).cast("long")).alias(k) for k in _NODE[1:]])


def ends_digests(ends: DataFrame) -> DataFrame:
    """For each node (depth, node1, node2) that is an end: n_ends and the SHA-256 of the ids that end there, in numerical
    order and joined by commas.

    The ids are sorted over all tasks, joined into pieces of bounded size there, and a node's pieces are hashed one
    after the other, so a node's ids are never together in memory.
    """
    def batch(rows: list, names: list[str], kinds: list) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * len(names), kinds)], names=names)

    whole = [pa.int64()] * 5

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], []

        def cut() -> None:
            if held:
                out.append((*key, held[0], len(held), ",".join(map(str, held))))

        def done() -> pa.RecordBatch:
            return batch(out, [*_NODE, "first", "n", "ids"], [*whole, pa.string()])

        for part in batches:
            for *at, conv_id in zip(*[c.to_pylist() for c in part.columns]):
                if at != key or len(held) == PIECE:
                    cut()
                    key, held = at, []
                held.append(conv_id)
            yield done()
            out = []
        cut()
        yield done()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, total, out = None, None, 0, []

        def done() -> pa.RecordBatch:
            return batch(out, [*_NODE, "n_ends", "ends_sha256"], [*whole[:4], pa.string()])

        for part in batches:
            for *at, _, n, ids in zip(*[c.to_pylist() for c in part.columns]):
                if at == key:
                    state.update(b"," + ids.encode())
                    total += n
                    continue
                if state:
                    out.append((*key, total, state.hexdigest()))
                key, state, total = at, hashlib.sha256(ids.encode()), n
            yield done()
            out = []
        if state:
            out.append((*key, total, state.hexdigest()))
        yield done()

    kinds = "depth long, node1 long, node2 long"
    together = ends.repartitionByRange(*_NODE, "conv_id").sortWithinPartitions(*_NODE, "conv_id").select(*_NODE, "conv_id")
    cut = together.mapInArrow(pieces, f"{kinds}, first long, n long, ids string")
    return cut.repartition(*_NODE).sortWithinPartitions(*_NODE, "first").mapInArrow(hashed, f"{kinds}, n_ends long, ends_sha256 string")


def _subtree_sums(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """n_leaves and saved_tokens of every node (depth, node1, node2) that has any.

    A node's smallest member owns it.  Each block of an owner's path gets, for each level, what the owner's nodes from
    that level on add up to; the rollup sums this over the members, who are the owners of the subtree's nodes.
    """
    at = F.greatest(F.col("depth") - 1, F.lit(0))
    placed = nodes.select("conv_id", F.floor(at / WIDTH).alias("block"), F.when(F.col("depth") == 0, 0).otherwise(at % WIDTH + 1).alias("slot"),
                          ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), F.when(F.col("n_ends") == F.col("n_convs"), 1).otherwise(0).cast("long").alias("leaf"))
    zero = F.lit(0).cast("long")
    tail = lambda name, j: F.sum(F.when(F.col("slot") >= j, F.col(name)).otherwise(zero))
    owned = placed.groupBy("conv_id", "block").agg(*[tail(name, j).alias(f"{name}{j}") for name in ("saved", "leaf") for j in range(WIDTH + 1)])
    names = [f"{name}{j}" for name in ("saved", "leaf") for j in range(WIDTH + 1)]
    path = rows.select("conv_id", "block", *_KEY, *_TURNS).join(owned, ["conv_id", "block"], "left").select(
        "conv_id", "block", *_KEY, *_TURNS, *[F.coalesce(name, zero).alias(name) for name in names])
    path = _running(path, {"saved0": "saved_later", "leaf0": "leaf_later"}, F.sum, zero, lambda a, b: a + b, backwards=True)
    for name in ("saved", "leaf"):
        for j in range(WIDTH + 1):
            path = path.withColumn(f"{name}{j}", F.col(f"{name}{j}") + F.col(f"{name}_later"))
    path = path.where("saved0 > 0 OR leaf0 > 0")
    by_level = lambda name: f"get(array({', '.join(f'sum({name}{j})' for j in range(WIDTH + 1))}), LEVEL)"
    return _with_keys(_rolled(path, [f"{by_level('leaf')} AS n_leaves", f"{by_level('saved')} AS saved_tokens"]))


def trie_nodes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the trie of all conversations: ``turns`` (conv_id, at, digest, words), ``convs`` (every conv_id).

    Returns conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256.  Conversations without turns are members of the root alone; without conversations there is no root.
    """
    rows = saved(blocks_of(turns, convs), "blocks")
    words = f"coalesce(get(array({', '.join(f'max(w{j})' for j in range(1, WIDTH + 1))}), LEVEL - 1), 0L) AS words"
    counted = _with_keys(_rolled(rows, ["count(*) AS n_convs", "min(conv_id) AS conv_id", words]))
    nodes = saved(counted.join(ends_digests(saved(ends_of(turns, convs), "ends")), _NODE, "left"), "nodes")
    sums = _subtree_sums(rows, nodes).drop("up1", "up2")

    up = [F.col("depth") - 1, F.col("up1"), F.col("up2")]
    children = nodes.where("depth > 0").groupBy(*[c.alias(name) for c, name in zip(up, _NODE)]).agg(F.count("*").alias("n_children"))
    known = saved(nodes.join(children, _NODE, "left").join(sums, _NODE, "left"), "known")
    parents = known.where("n_children > 0").select(*[F.col(name).alias(f"of_{name}") for name in _NODE], F.col("conv_id").alias("parent_conv_id"), "n_children")
    least = known.count() // HOT_SHARE
    is_up = (F.col("depth") - 1 == F.col("of_depth")) & (F.col("up1") == F.col("of_node1")) & (F.col("up2") == F.col("of_node2"))
    hot = F.broadcast(parents.where(F.col("n_children") > least).drop("n_children"))
    under_hot = known.join(hot, is_up)
    others = known.join(hot, is_up, "left_anti").join(parents.where(F.col("n_children") <= least).drop("n_children"), is_up, "left")
    zero = F.lit(0).cast("long")
    return under_hot.unionByName(others).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), F.coalesce("n_leaves", zero).alias("n_leaves"),
        F.coalesce("saved_tokens", zero).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, base: Column, head: Column) -> DataFrame:
    """The trie of the rebuilt conversations of a table (conv_id, turn, role, text); see ``with_shared_heads``.

    One row per distinct beginning of conversations, the empty one included; turns are equal if role and text are.
    Rows without a conv_id take no part; a null role or text is empty; turns are ordered by turn, null first, ties by
    role and text, and repeated rows are repeated turns; an empty table has no nodes.  Other columns are not read.
    """
    turns, convs = with_shared_heads(numbered_turns(conversations.select("conv_id", "turn", "role", "text")), base, head)
    return trie_nodes(saved(turns, "rebuilt"), saved(convs, "members"))
