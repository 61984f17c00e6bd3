"""The prefix trie, the quality rules and the hard negatives against plain versions, odd input included."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliograde.llm import hard_negatives, prefix_trie, quality_rules

CONV = "conv_id long, turn long, role string, text string"
DOC = "doc_id long, text string, lang string"
VEC = "vec_id long, embedding array<float>, label int"


# ---- prefix trie

def plain_trie(rows):
    """Nodes by walking every rebuilt conversation; rows are (conv_id, turn, role, text)."""
    turns = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            turns[conv_id].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}
    built = {}
    for c in own:
        head = zlib.crc32(str(c).encode()) % 4
        base = c - int(math.fmod(c, 20))
        built[c] = own.get(base, [])[:head] + own[c][head:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
        ends[tuple(path)].append(c)
    out = []
    for node, convs in members.items():
        below = [n for n in members if n[:len(node)] == node]
        kids = [n for n in below if len(n) == len(node) + 1]
        leaves = [n for n in below if not any(len(m) == len(n) + 1 and m[:len(n)] == n for m in below)]
        words = lambda n: len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1].decode())) if n else 0
        digest = hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(kids), len(leaves),
                    sum((len(members[n]) - 1) * words(n) for n in below), digest))
    return sorted(out, key=str)


def trie(df):
    conv = F.col("conv_id")
    return prefix_trie.conversation_trie(df, conv - conv % 20, F.crc32(conv.cast("string")) % 4)


def trie_rows(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r[n] for n in names) for r in trie(df).collect()), key=str)


def odd_conversations():
    rng = random.Random(5)
    rows = []
    for c in [*range(-25, 45), 100, 105, 119, 10**15, 10**15 + 7]:
        if c == 20:  # an absent base
            continue
        for turn in range(rng.choice([1, 1, 2, 4, 5, 9, 13])):
            rows.append((c, turn, rng.choice(["user", "assistant", None]), rng.choice(["a b", "a b c", "", None, "x\ty"])))
    rows += [(3, None, "user", "first of all"), (3, 0, "user", "tie"), (3, 0, "user", "tie"), (7, 2, None, None)]
    rows += [(None, 1, "user", "nobody's"), (None, None, None, None)]
    rows += [(200 + i, t, "user", f"same {t}") for i in range(30) for t in range(6)]  # copies under one beginning
    rows += [(300, t, "user", f"long {t % 3} " * 3) for t in range(90)]
    return rows


def test_trie_equals_walking(spark):
    rows = odd_conversations()
    df = spark.createDataFrame(rows, CONV).repartition(5)
    assert trie_rows(df) == plain_trie(rows)


def test_trie_of_long_conversations_in_short_runs(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "RUN", 3)
    monkeypatch.setattr(prefix_trie, "PIECE", 4)
    rows = odd_conversations()
    assert trie_rows(spark.createDataFrame(rows, CONV).repartition(3)) == plain_trie(rows)


def test_trie_deals_one_conversation_over_tasks(spark):
    rows = [(40, t // 2, "user", f"turn {t % 5}") for t in range(4000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small tables would end in one task
    try:
        placed = prefix_trie.numbered_turns(spark.createDataFrame(rows, CONV))
        assert sorted(r["at"] for r in placed.collect()) == list(range(1, 4001))
        assert len(placed.inputFiles()) > 1  # one file per task that had rows
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_trie_turnless_and_empty(spark):
    lonely = [c for c in range(1, 200) if zlib.crc32(str(c).encode()) % 4 == 3 and c % 20][:2]
    rows = [(c, 0, "user", "hello") for c in lonely]
    assert trie_rows(spark.createDataFrame(rows, CONV)) == plain_trie(rows)
    assert len(plain_trie(rows)) == 1  # both lose their only turn
    assert trie_rows(spark.createDataFrame([], CONV)) == []
    clash = spark.createDataFrame(rows, CONV).withColumn("block", F.lit("b")).withColumn("at", F.lit(None)).withColumn("key1", F.lit(1))
    assert trie_rows(clash) == plain_trie(rows)


def test_trie_tells_role_from_text(spark):
    rows = [(0, 0, "user", "1:a"), (20, 0, "user1", ":a"), (40, 0, "us", "er1:a")]
    assert len(trie_rows(spark.createDataFrame(rows, CONV))) == len(plain_trie(rows))


# ---- quality rules

def plain_facts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    grams = defaultdict(list)
    for i in range(len(words) - 2):
        grams[tuple(words[i:i + 3])].append(i)
    covered = {k for at in grams.values() if len(at) > 1 for i in at for k in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


ODD_TEXTS = [None, "", " \n\t\x0b\r\n", "one", "a b", "a b c a b c", "a a a a", "a b a b a b", "x\ny\nx\n x\nx\r\nx", "# * $ % & | < > #a",
             "é ü ß 日本 \U0001F600 \U0001F600 \U0001F600", "Same line here\nSame line here\nSame line here", "\n\n\nA\n\nA", "a b c d a b e a b c",
             "w " * 5000 + "v", " ".join(f"w{i % 700}" for i in range(30_000))]


def test_facts_equal_plain_ones(spark):
    docs = spark.createDataFrame([(i, text, "en") for i, text in enumerate(ODD_TEXTS)], DOC)
    found = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.facts(docs).collect()}
    assert found == {i: plain_facts(text) for i, text in enumerate(ODD_TEXTS)}


@pytest.mark.parametrize("n", [1, 50, 400, 2500])
def test_binomial_tail_is_exact(spark, n):
    from fractions import Fraction
    risk, doubt = Fraction(1, 40), Fraction(1, 500)
    tail, k = Fraction(0), -1
    for i in range(n + 1):
        tail += math.comb(n, i) * risk**i * (1 - risk) ** (n - i)
        if tail > doubt:
            break
        k = i
    got = spark.createDataFrame([(n,)], "n long").select(quality_rules.allowed_rejections(F.col("n"), 0.025, 0.002).alias("k")).first().k
    assert got == k


def fresh_text(rng, symbols=0, words=60):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.choice([3, 4, 5]))) for _ in range(words)) + " #" * symbols


def labelled(n_good=3000, n_bad=300, hot="en"):
    rng = random.Random(3)
    docs = [(i, fresh_text(rng, symbols=rng.choice([0, 0, 1])), hot) for i in range(n_good)]
    docs += [(n_good + i, fresh_text(rng, symbols=40), hot) for i in range(n_bad)]
    docs += [(10_000 + i, fresh_text(rng, symbols=40), None) for i in range(20)]
    labels = [(i, int(i < n_good), 0) for i in range(n_good + n_bad)] + [(None, 0, 0), (1, None, 0)]
    return docs, labels


def test_rules_reject_the_bad_and_limit_false_rejection(spark):
    docs, labels = labelled()
    found = quality_rules.judged(spark.createDataFrame(docs, DOC), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(found) == len(docs)
    good = [r for r in found if r.doc_id < 3000]
    assert sum(not r.kept for r in good) <= 0.05 * len(good)
    assert not any(r.kept for r in found if 3000 <= r.doc_id < 3300)
    assert all("symbols" in r.failed_rules for r in found if 3000 <= r.doc_id < 3300)
    assert all(r.kept and not r.failed_rules for r in found if r.doc_id >= 10_000)  # a stratum without labels: only the base decides


def test_rules_without_enough_labels_keep_all(spark):
    docs, labels = labelled(n_good=40, n_bad=10)
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert all(r.kept for r in quality_rules.judged(spark.createDataFrame(docs, DOC), labels).collect())
    assert all(r.kept for r in quality_rules.judged(spark.createDataFrame(docs, DOC), labels.limit(0)).collect())


def test_rules_of_odd_rows(spark):
    docs, labels = labelled(n_good=1500, n_bad=20)
    docs += [(None, docs[0][1], "en"), (None, None, None), (5, docs[5][1], "en"), (5, docs[5][1], "en"), (9, "", "en")]
    df = spark.createDataFrame(docs, DOC).withColumn("words", F.lit(1)).withColumn("stratum", F.lit("x")).withColumn("n", F.lit(2)).withColumn("rule", F.lit(3))
    labels = spark.createDataFrame(labels + [(6, 1, 0), (6, 0, 1), (7, 1, 0)], "doc_id long, quality int, toxic int")
    found = quality_rules.judged(df, labels).collect()
    assert len(found) == len(docs)
    assert [r.kept for r in found if r.doc_id is None and r.n_words == 0] == [False]
    repeats = {(r.n_words, r.kept, tuple(r.failed_rules)) for r in found if r.doc_id == 5}
    assert len(repeats) == 1
    empty = quality_rules.judged(df.limit(0), labels)
    assert empty.count() == 0 and "kept" in empty.columns


def test_rules_use_no_python(spark):
    docs, labels = labelled(n_good=50, n_bad=5)
    df = quality_rules.judged(spark.createDataFrame(docs, DOC).coalesce(1), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    plan = quality_rules.facts(spark.createDataFrame(docs, DOC))._jdf.queryExecution().executedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---- hard negatives

def plain_negatives(rows, scale=256):
    width = max((len(v) for _, v, _ in rows if v), default=1)
    fit = []
    for vec_id, vector, label in rows:
        if vec_id is None or vector is None or label is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        whole = [math.floor(scale * float(np.float32(x))) for x in vector]
        fit.append((vec_id, np.array(whole + [0] * (width - len(whole)), np.int64), label))
    out = []
    for a, (anchor, x, label) in enumerate(fit):
        if anchor % 100:
            continue
        scored = [(-int(x @ y), i, l) for b, (i, y, l) in enumerate(fit) if b != a]
        for score, good, _ in sorted((s for s in scored if s[2] == label), key=lambda s: s[:2])[:5]:
            fits = sorted((s[:2] for s in scored if s[2] != label and 80 * -score <= 100 * -s[0] <= 100 * -score))[:5]
            out += [(anchor, good, rank, bad, -score, -low) for rank, (low, bad) in enumerate(fits, 1)]
    return sorted(out)


def mined(df):
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r[n] for n in names) for r in hard_negatives.hard_negatives(df, F.col("vec_id") % 100 == 0).collect())


def vectors(n=900, width=6, seed=2, hot=0.4):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=width)
    label = lambda: 0 if rng.random() < hot else int(rng.integers(1, 9))
    return [(i, [float(x) for x in centre + rng.normal(size=width)], label()) for i in range(n)]


def test_negatives_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "SHARD_ROWS", 100)
    monkeypatch.setattr(hard_negatives, "BLOCK_ANCHORS", 3)
    monkeypatch.setattr(hard_negatives, "STEP", 5)
    rows = vectors()
    assert mined(spark.createDataFrame(rows, VEC)) == plain_negatives(rows)


def test_negatives_with_ties_and_repeats(spark):
    rows = [(i, [float(i % 3), 1.0], i % 2) for i in range(350)]  # few distinct scores
    rows += [(100, [2.0, 1.0], 0), (100, [2.0, 1.0], 0), (17, [2.0, 1.0], 1), (17, [2.0, 1.0], 1)]
    assert mined(spark.createDataFrame(rows, VEC)) == plain_negatives(rows)


def test_negatives_of_odd_rows(spark):
    rows = vectors(220) + [
        (300, None, 1), (400, [], 2), (500, [float("nan")] * 6, 1), (600, [float("inf")] * 6, 1), (700, [None] * 6, 1), (800, [0.0] * 6, 1),
        (None, [1.0] * 6, 1), (900, [1.0] * 6, None), (1000, [1.0], 3), (1100, [-1.0] * 6, 77), (1200, [-5.0] * 6, 2)]
    df = spark.createDataFrame(rows, VEC).withColumn("row", F.lit("r")).withColumn("block", F.lit(1)).withColumn("score", F.lit(None)).withColumn("n", F.lit(4))
    assert mined(df) == plain_negatives(rows)
    assert mined(df.limit(0)) == [] and mined(df.where("vec_id = 1")) == []


def test_reading_stops_before_the_end():
    rng = np.random.default_rng(1)
    values = rng.integers(-1000, 1000, (3000, 3))
    lists = hard_negatives.Lists(np.arange(3000), np.arange(3000), np.zeros(3000, np.int64), values)
    anchor = np.array([5, -3, 2])
    windows = hard_negatives.Windows(5, np.array([hard_negatives.LOWEST]), np.array([-hard_negatives.LOWEST]))
    met = []
    windows.search(lists, anchor, lambda new: met.append(len(new)) or np.ones(len(new), bool))
    best = sorted(zip((-(values @ anchor)).tolist(), range(3000)))[:5]
    assert [(score, one) for score, one, _ in windows.best[0]] == best
    assert sum(met) < 2500
