"""Edge cases of the corpus operators, each with its defined result, and plain versions to compare with."""

import collections
import hashlib
import math
import os
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliograde.llm import (
    ball_tree, common, decontaminate, html_text, line_dedup, lm_scoring, mixing, ngram_join, queries, sharding, toxicity, warc)
from foliograde.llm.words import ALNUM, PLAIN, words_of

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, size long, node long, _id long"
WORD = re.compile("[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
TEXTS = [
    None, "", " \t\n ", "one", "One TWO three", "a a a a a a a a", LONG, LONG + " tail", "Älter É x y", "stupid words here\nstupid words here",
    "the quick brown fox jumps over the lazy dog and runs far away", "the quick brown fox jumps over the lazy dog and runs far away",
]


def docs_of(spark, texts=TEXTS):
    rows = [(i, t, "en", None if i % 4 == 3 else f"s{i % 3}", None, "r", 7, 8, 9) for i, t in enumerate(texts)]
    rows += rows[-1:] + [(None, "no id at all", None, None, None, None, None, None, None)] if texts else []
    return spark.createDataFrame(rows, DOCS)


def tokens(text):
    return WORD.findall((text or "").translate(FOLD))


def test_words_match_the_pattern():
    for kind, pattern in ((PLAIN, "[^\x20\x09-\x0D]+"), (ALNUM, "[0-9a-z\x80-\U0010ffff]+")):
        found = words_of(pa.array(TEXTS), kind)
        expected = [(i, w) for i, t in enumerate(TEXTS) for w in re.findall(pattern, (t or "").translate(FOLD))]
        assert found.row.tolist() == [i for i, _ in expected]
        by_word = {}
        for (_, word), h in zip(expected, found.hash.tolist()):
            assert by_word.setdefault(word, h) == h
        assert len(set(by_word.values())) == len(by_word)


def test_lm_scores(spark):
    docs = docs_of(spark)
    found = {(r.doc_id, r.n_tokens): r for r in lm_scoring.scored(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 2).collect()}
    rows = [(r.doc_id, tokens(r.text) + ["\n"]) for r in docs.collect()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = collections.Counter(w for i, ws in rows if not held(i) for w in ws)
    total = sum(counts.values())
    for i, ws in rows:
        r = found[i, len(ws)]
        assert r.held_out == held(i) and r.train_tokens == total and r.n_known == sum(counts[w] > 0 for w in ws)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in ws))
        assert r.score < 0
    empty = lm_scoring.scored(docs.limit(0), F.lit(False))
    assert empty.count() == 0


def test_lm_is_normalised():
    rng = np.random.default_rng(1)
    shares = rng.dirichlet(np.ones(lm_scoring.CLASSES))
    trainer = lm_scoring.Trainer(lm_scoring.started(shares), shares)
    token = rng.integers(0, lm_scoring.CLASSES, 3000).astype(np.int32)
    token[1::2] = (token[::2] * 3 + 1) % lm_scoring.CLASSES
    before = np.full((lm_scoring.CONTEXT, 3000), lm_scoring.CLASSES, np.int32)
    for j in range(lm_scoring.CONTEXT):
        before[j, j + 1:] = token[:-j - 1]
    start = lm_scoring.class_log_probs(trainer.flat, token, before).mean()
    for _ in range(200):
        trainer.learn(token, before)
    assert lm_scoring.class_log_probs(trainer.flat, token, before).mean() > start + 0.5
    every = np.arange(lm_scoring.CLASSES, dtype=np.int32)
    context = np.repeat(before[:, 50:51], lm_scoring.CLASSES, axis=1)
    assert np.exp(lm_scoring.class_log_probs(trainer.flat, every, context)).sum() == pytest.approx(1, abs=1e-5)


def test_lm_goes_over_few_texts_once(spark):
    texts = ["a few words of one small task"] * 30
    shares = np.full(lm_scoring.CLASSES, 1 / lm_scoring.CLASSES)
    start, table = lm_scoring.started(shares), (np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int64))
    share = spark.sparkContext.broadcast
    found = lm_scoring._averaged(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1), share(start), shares, share(table), start)
    words, once = words_of(pa.array(texts), PLAIN), lm_scoring.Trainer(start, shares)
    token, _, before = lm_scoring._contexts(words, lm_scoring._Lookup(table).find(words)[0], 0)
    once.learn(token, before)
    assert np.allclose(found, once.flat, atol=1e-6)


def test_lm_tells_words_of_one_ending_apart(spark):
    assert lm_scoring.sizes_for(10**9).classes == lm_scoring.sizes_for(10**9).slots == 10**3
    assert lm_scoring.sizes_for(10**7).classes == 215
    rng = np.random.default_rng(2)
    texts = [" ".join(x for p in rng.integers(0, 400, 40) for x in (f"q{p}zing", f"r{p}zing")) for i in range(600)]
    held = ["q7zing r7zing q301zing r301zing", "q7zing r301zing q301zing r7zing"]
    docs = spark.createDataFrame(list(enumerate(texts + held)), "doc_id long, text string").coalesce(1)
    scores = [r.score for r in lm_scoring.scored(docs, F.col("doc_id") >= len(texts)).where("held_out").orderBy("doc_id").collect()]
    assert abs(scores[0] - scores[1]) > 1e-3


def test_lm_is_normalised_over_slots():
    rng = np.random.default_rng(3)
    sizes = lm_scoring.Sizes(8, 4, 6)
    cells = rng.integers(1, 50, (4, 6)).astype(np.float32)
    shares = rng.dirichlet(np.ones(8))
    trainer = lm_scoring.Trainer(lm_scoring.started(shares, 6), shares, cells)
    token = rng.integers(0, 8, 3000).astype(np.int32)
    slot = np.where(token >= 4, rng.integers(0, 6, 3000), 6).astype(np.int32)
    before, slots_before = np.full((4, 3000), 8, np.int32), np.full((4, 3000), 6, np.int32)
    before[0, 1:], slots_before[0, 1:] = token[:-1], slot[:-1]
    trainer.learn(token, before, slot, slots_before)
    every = [(c, 6, 1.0) for c in range(4)] + [(4 + c, b, cells[c, b]) for c in range(4) for b in range(6)]
    c, b, mass = (np.array(x) for x in zip(*every))
    k = len(every)
    logs = lm_scoring.class_log_probs(trainer.flat, c, np.repeat(before[:, 9:10], k, 1), b, np.repeat(slots_before[:, 9:10], k, 1), cells)
    assert (np.exp(logs) * mass).sum() == pytest.approx(1, abs=1e-5) and trainer.sizes == sizes


def filled(sizes, weights, total):
    """Shares by weight; what is above a cap is shared again until nothing is."""
    targets, left, open_ = {}, total, sorted(sizes)
    while open_:
        level = left / sum(weights[s] for s in open_)
        full = [s for s in open_ if level * weights[s] >= 2 * sizes[s]]
        if not full:
            return targets | {s: level * weights[s] for s in open_}
        for s in full:
            targets[s] = 2 * sizes[s]
            left -= targets[s]
        open_ = [s for s in open_ if s not in full]
    return targets


def test_mix(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").union(spark.createDataFrame([(10**6, None, "x", None, 0), (10**6 + 1, "z z z z", "x", None, 0)],
                                                                                     "doc_id long, text string, lang string, source string, n_chars long"))
    first, second = (sorted(mixing.mix_report(docs).collect()) for _ in range(2))
    assert first == second
    source = {r.doc_id: r.source for r in docs.collect()}
    sizes = collections.Counter()
    for r in first:
        sizes[source[r.doc_id]] += r.size
    names = sorted(s for s in sizes if s is not None) + [None]
    order = {s: i for i, s in enumerate(names)}
    expected = filled({order[s]: n for s, n in sizes.items()}, {i: (3, 1, 2)[i % 3] for i in range(len(names))}, 1.5 * sum(sizes.values()))
    taken = collections.Counter()
    for r in first:
        taken[source[r.doc_id]] += r.taken
        assert r.target == pytest.approx(expected[order[source[r.doc_id]]]) and r.source_size == sizes[source[r.doc_id]]
        assert r.taken % max(1, r.size) == 0 and r.taken <= 2 * r.size
    for s in names:  # whole documents, ten a source: the last one taken or left leaves half its size at most
        largest = max(r.size for r in first if source[r.doc_id] == s)
        assert abs(taken[s] - expected[order[s]]) <= max(20, largest / 2)


def test_mix_of_odd_rows(spark):
    docs = docs_of(spark)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() > 0
    assert mixing.mix_report(docs).count() == docs.count()
    assert mixing.mix_report(docs.limit(0)).count() == 0 and mixing.mixed_documents(docs.where("text IS NULL")).count() >= 0


def test_mix_takes_repeated_rows_by_number(spark):
    equal = [(1, "w " * 100, "a")] * 10 + [(None, "v " * 70, "b")] * 31 + [(3, "u " * 90, "b"), (4, "t " * 11, "b"), (5, "", "b")] + [(6, "s " * 40, "c")] * 4
    docs = spark.createDataFrame(equal, "doc_id long, text string, source string").repartition(7)
    report = mixing.mix_report(docs, weights=(1, 1, 1), factor=1.2).collect()
    assert len(report) == len(equal)
    by_size = collections.defaultdict(list)
    for r in report:
        by_size[(r.source_size, r.target)].append(r)
    for (_, target), rows in by_size.items():
        assert abs(sum(r.taken for r in rows) - target) <= max(r.size for r in rows) / 2 + 1
        assert all(r.taken in (0, r.size, 2 * r.size) for r in rows)
    whole = mixing.mixed_documents(docs, weights=(1, 1, 1), factor=1.2)
    assert whole.columns == docs.columns
    got = collections.Counter((r.doc_id, r.source) for r in whole.collect())
    assert got[(1, "a")] == sum(r.taken for r in report if r.doc_id == 1) // 100
    assert got[(None, "b")] == sum(r.taken for r in report if r.doc_id is None) // 70


def test_toxicity_learns_words(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["lo", "rem", "ip", "sum", "do", "lor"], 12)) + (" filth" if i % 5 == 0 else "") for i in range(400)]
    docs = docs_of(spark, texts + [None, ""])
    labels = spark.createDataFrame([(i, int(i % 5 == 0), 1) for i in range(400)] + [(3, None, 0), (None, 1, 0), (4, 0, 0)], "doc_id long, toxic int, quality int")
    rows = toxicity.with_scores(docs, labels).select("doc_id", "held_out", "score", "predicted", "row.*").select("score", "predicted", "text").collect()
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int("filth" in (r.text or ""))
    assert toxicity.without_toxic(docs, labels).columns == docs.columns
    assert {r.score for r in toxicity.with_scores(docs, labels.limit(0)).collect()} == {0.0}


def test_top_products(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 8)], 0) for i in range(300)]
    rows += [rows[100], rows[100], (400, None, 0), (401, [None, 1.0], 0), (402, [float("nan")], 0), (403, [float("inf")], 0), (500, [], 0), (None, [1.0], 0), (200, [2.0], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    fine = []
    for i, v, _ in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole = [math.floor(1024 * float(np.float32(x))) for x in v]
            fine.append((i, np.array(whole + [0] * (8 - len(whole)), np.int64)))
    expected = []
    for q, (i, v) in enumerate(fine):
        if i % 100 == 0:
            others = sorted((-int(v @ w), j) for c, (j, w) in enumerate(fine) if c != q)[:10]
            expected += [(i, k + 1, j, -s) for k, (s, j) in enumerate(others)]
    keep = ball_tree.SHARD_ROWS, ball_tree.LEAF_ROWS, ball_tree.BLOCK_QUERIES
    ball_tree.SHARD_ROWS, ball_tree.LEAF_ROWS, ball_tree.BLOCK_QUERIES = 40, 8, 3
    try:
        found = ball_tree.top_products(table, F.col("vec_id") % 100 == 0)
        assert sorted(map(tuple, found.collect())) == sorted(expected)
        assert ball_tree.top_products(table.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    finally:
        ball_tree.SHARD_ROWS, ball_tree.LEAF_ROWS, ball_tree.BLOCK_QUERIES = keep


def alnum(text):
    return re.findall("[0-9a-z\x80-\U0010ffff]+", (text or "").translate(FOLD))


def test_benchmark_hits(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    same = " ".join(["again"] * 40)
    items = [(1, passage), (2, "only three words"), (3, None), (4, ""), (11, passage + " more"), (5, same), (6, "p3 p4"), (7, "PX, p5 p6; p7 p8 p9 p10 p11 p12 p13 p14")]
    texts = [None, "", passage, f"x {passage.upper()}! y", " ".join(f"p{i}" for i in range(9)), "say only three words now", same, " ".join(f"p{i}" for i in range(5, 16)),
             "only three  words only three words", LONG + " " + passage, "p3 q p4", "clean text of no item"]
    docs, bench = docs_of(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    windows = collections.defaultdict(set)
    for i, t in items:
        ws = alnum(t)
        n = min(10, len(ws))
        for k in range(len(ws) - n + 1 if n else 0):
            windows[tuple(ws[k:k + n])].add(str(i))
    expected = []
    for r in docs.collect():
        ws, hit, found = alnum(r.text), set(), set()
        for n in {len(w) for w in windows}:
            for k in range(len(ws) - n + 1):
                if (w := tuple(ws[k:k + n])) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[w]
        expected.append((r.doc_id, len(ws), len(hit), ",".join(sorted(found))))
    rows = decontaminate.contamination(docs, bench).select("doc_id", "n_words", "n_hit", F.array_join("items", ",")).collect()
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, expected))
    clean = decontaminate.clean_documents(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(e[2] == 0 for e in expected)
    assert decontaminate.clean_documents(docs, bench.limit(0)).count() == docs.count()
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0


def test_warc(spark):
    big, other = "ä" * 600, "b" * 1000
    rows = [(1, "http://www.A.example/x?q=1#f", big), (5, "http://a.example/x?q=1", big), (3, "nonsense", big), (2, None, other), (4, "", "b" * 999), (6, "h\r\nttp://q", "b" * 999),
            (7, "http://z", None), (8, "http://z", "two\r\n\r\nparts\r\n\r\n"), (5, "http://a.example/x?q=1", big), (None, "http://n", big), (-2, "http://a.example/x?q=1", other)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, body int")
    keep = warc.CAPTURES_PER_RANGE, warc.RECORDS_PER_ARCHIVE
    warc.CAPTURES_PER_RANGE, warc.RECORDS_PER_ARCHIVE = 3, 2
    try:
        found = warc.archived(pages).collect()
    finally:
        warc.CAPTURES_PER_RANGE, warc.RECORDS_PER_ARCHIVE = keep
    largest = {}
    for i, _, html in rows:
        largest[html] = max(largest.get(html, -10), i if i is not None else -10)
    expected = []
    for i, _, html in rows:
        body = (html or "").encode()
        again = len(body) >= 1000 and largest[html] != i
        expected.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", largest[html] if again else None))
    assert sorted(map(str, ((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found))) == sorted(map(str, expected))
    ordered = sorted(found, key=lambda r: (r.range, r.place))
    assert [bytes(r.sort_key) for r in ordered] == sorted(bytes(r.sort_key) for r in found)
    assert warc.archived(pages.limit(0)).count() == 0


@pytest.mark.parametrize("lists", [[], [[]], [[1, 2], [], [0]], [[3, 3], [1, 3], [2], [3, 9], [0, 0]]])
def test_loser_tree(lists):
    assert list(warc.LoserTree(lists)) == sorted(x for one in lists for x in one)


def brute_components(texts, size, percent):
    sets = []
    for t in texts:
        ws = tokens(t)
        sets.append({tuple(ws[i:i + size]) for i in range(len(ws) - size + 1)} if len(ws) >= size else {tuple(ws)} - {()})
    part = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * len(sets[i] | sets[j]):
                a, b = part[i], part[j]
                part = [b if p == a else p for p in part]
    return sets, part


def test_similar_documents(spark):
    rng = np.random.default_rng(9)
    base = [f"v{i}" for i in range(200)]
    texts = list(TEXTS)
    for _ in range(60):  # a chain of copies, each changed a little from one of the earlier ones
        base = list(base)
        base[int(rng.integers(0, 200))] = f"n{rng.integers(0, 10**9)}"
        texts.append(" ".join(base))
    docs = docs_of(spark, texts).where("doc_id IS NOT NULL")
    every = [(r.doc_id, r.text) for r in docs.collect()]
    for size, percent in ((4, 85), (5, 80)):
        sets, part = brute_components([t for _, t in every], size, percent)
        least = {}
        for (i, _), p in zip(every, part):
            least[p] = min(i, least.get(p, i))
        found = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_documents(docs, size, percent).collect())
        assert found == sorted((i, len(s), least[p]) for (i, _), s, p in zip(every, sets, part))
    one = ngram_join.one_of_each(docs, 5, 80)
    assert one.columns == docs.columns
    assert sorted(r.doc_id for r in one.collect()) == sorted({least[p] for p in part})
    assert ngram_join.similar_documents(docs.limit(0)).count() == 0
    assert ngram_join.similar_documents(docs_of(spark, ["x y"])).where("doc_id IS NULL").first().component_id is None


def test_nodes_of_many_lists_meet_once(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base, texts, rows = [f"v{i}" for i in range(400)], [], []

    def changed(words, times):
        words = list(words)
        for at in rng.choice(400, times, replace=False):
            words[at] = f"n{rng.integers(0, 10**9)}"
        return words

    for i in range(24):  # all a little too different, and every fourth with a near copy
        words = changed(base, 5)
        texts += [" ".join(words), *([" ".join(changed(words, 2))] if i % 4 == 0 else [])]
    meetings = ngram_join._meetings

    def counted(still, percent):
        met = meetings(still, percent)
        pairs = met.select(F.least("e.node", "o.node").alias("a"), F.greatest("e.node", "o.node").alias("b"))
        rows.append((met.count(), pairs.distinct().count()))
        return met

    monkeypatch.setattr(ngram_join, "_meetings", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = [r.component_id for r in ngram_join.similar_documents(docs).orderBy("doc_id").collect()]
    sets, part = brute_components(texts, 4, 85)
    assert found == [part.index(p) for p in part]
    assert len(set(found)) < len(texts) and len(rows) == 1
    assert 0 < rows[0][0] <= 3 * rows[0][1]  # they share up to 40 lists


def test_pages(spark):
    shell = "<html><head><title>t</title></head><body><div class='top-menu'>menu</div><div>Site &amp; motto</div>{}<div id='footer'>f</div></body></html>"
    pages = [(i, "http://h.example/%d" % i, shell.format(f"<div><p>Own text {i}<p>Second&nbsp;par <b>bo</b>ld<br>line {i}</div>")) for i in range(12)]
    pages += [(100, None, None), (101, "x", ""), (102, "http://q/", "<article><h1>Head</h1><p>all of it</p><div class=comments>no</div></article><footer>no"),
              (103, "http://q/", "plain &lt;text"), (104, "http://deep/", "<div>" * 5000 + "deep" + "</div>" * 5000), (102, "http://q/", "<p>a<script>var x='<p>'</script>b")]
    table = spark.createDataFrame([(*p, "n") for p in pages], "page_id long, url string, html string, host string")
    found = collections.defaultdict(set)
    for r in html_text.main_text(table).collect():
        assert r.n_chars == len(r.text)
        found[r.page_id].add(r.text)
    for i in range(12):
        assert found[i] == {f"Own text {i} Second par bold line {i}"}
    assert found[100] == found[101] == {""} and found[102] == {"Head all of it", "ab"} and found[103] == {"plain <text"} and found[104] == {"deep"}
    assert html_text.main_text(table.limit(0)).count() == 0


@pytest.mark.parametrize("most", [0, 1000])
def test_templates_by_count(spark, most):
    menu, notice = "<div><a>Section</a> <a>menu</a></div>", "<p>This site is being moved.</p>"
    page = "<body>{}<main>{}<p>Own words {} here</p><h2>{}</h2></main></body>"
    pages = [(i, f"http://big/{i}", page.format("", notice + (menu if i < 30 else ""), i, "Conclusion")) for i in range(250)]
    pages += [(1000 + i, f"http://small/{i}", page.format("", menu, i, "End")) for i in range(2)]
    keep, html_text.BROADCAST_SUBTREES = html_text.BROADCAST_SUBTREES, most
    try:
        found = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    finally:
        html_text.BROADCAST_SUBTREES = keep
    assert found == {i: f"Own words {i % 1000} here {'Conclusion' if i < 1000 else 'End'}" for i, _, _ in pages}


def shards_are_right(rows, shards):
    sizes = collections.Counter(r.shard for r in rows)
    counts = [sizes[j] for j in range(shards)]
    assert max(counts) - min(counts) <= 1 and set(sizes) <= set(range(shards))
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards(spark):
    docs = docs_of(spark, [f"text {i}" for i in range(70)] + ["same"] * 45 + ["pair"] * 2 + [None, ""])
    found = sharding.shard_documents(docs, 8).collect()
    shards_are_right(found, 8)
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in found:
        body = (text[r.doc_id] or "").encode()
        assert r["size"] == len(body) + 16 and r.text_crc32 == zlib.crc32(body) and r.law == "rows" and r.grown_shard is None
    assert len({r.shard for r in found if text[r.doc_id] == "pair"}) == 1
    assert len({r.shard for r in found if text[r.doc_id] == "same"}) <= 4
    assert sorted(map(str, found)) == sorted(map(str, sharding.shard_documents(docs, 8).collect()))
    shards_are_right(sharding.shard_documents(docs_of(spark, ["all alike"] * 50), 7).collect(), 7)
    assert sharding.shard_documents(docs.limit(0)).count() == 0


def plain_line_dedup(rows, percent):
    earlier, out = [], {}
    for key, text in rows:
        kept, lines = [], (text.split("\n") if text is not None else [])
        for line in lines:
            own = frozenset(tokens(line))
            if not own or not any(100 * len(own & e) >= percent * len(own | e) for e in earlier):
                kept.append(line)
            if own:
                earlier.append(own)
        out[key] = (len(lines), len(lines) - len(kept), None if text is None else "\n".join(kept))
    return out


def test_line_dedup(spark):
    line = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    texts = [None, "", "\n\n", line, line.upper() + "\nother line here", line.replace("kappa", "lambda") + "\n" + line, "short\nshort\nnew short", "x\r\ny\r\nx",
             " ".join(f"w{i}" for i in range(4000)), " ".join(f"w{i}" for i in range(3500)), "\n".join(f"line {i % 50} of {i % 50}" for i in range(3000))]
    docs = docs_of(spark, texts).where("doc_id IS NOT NULL")
    expected = plain_line_dedup(list(enumerate(texts)), 80)
    found = line_dedup.without_repeated_lines(docs).collect()
    assert len(found) == len(texts) + 1
    for r in found:
        assert (r.n_lines, r.n_removed, r.text) == expected[r.doc_id]
    assert line_dedup.without_repeated_lines(docs.limit(0)).count() == 0


def test_line_dedup_of_more_lines_than_a_task_holds(spark):
    texts = [f"keep me once whatever happens\nown line number {i} x{i} y{i} z{i}\nother words{i} of{i} text{i}" for i in range(40)]
    docs = docs_of(spark, texts).where("doc_id IS NOT NULL").coalesce(1)
    expected = plain_line_dedup(list(enumerate(texts)), 80)
    keep, parts = line_dedup.HELD, line_dedup.parts_of
    line_dedup.HELD = 3
    line_dedup.parts_of = lambda texts: (texts.slice(i, 2) for i in range(0, len(texts), 2))
    try:
        found = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in line_dedup.without_repeated_lines(docs).collect()}
    finally:
        line_dedup.HELD, line_dedup.parts_of = keep, parts
    assert found == expected


def test_lines_of_common_words_are_not_verified(spark, monkeypatch):
    rng = np.random.default_rng(5)
    words = [f"v{i}" for i in range(120)]
    lines = [" ".join(rng.permutation(words)[:n]) for n in rng.integers(30, 60, 80)]  # prefixes meet, sets are far apart
    lines += [line + f" n{i}" for i, line in enumerate(lines[:10])]
    candidates, rows = line_dedup._candidates, []

    def counted(entries, gone, percent):
        assert {r[0] % line_dedup.ROUNDS for r in entries.select("word").distinct().collect()} == {len(rows)}
        rows.append(found := candidates(entries, gone, percent))
        return found

    monkeypatch.setattr(line_dedup, "_candidates", counted)
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(20)
    expected = plain_line_dedup(list(enumerate(lines)), 80)
    found = line_dedup.without_repeated_lines(docs).collect()
    assert {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in found} == expected
    assert sum(r.n_removed for r in found) == 10
    assert sum(r.count() for r in rows) <= 200  # of 4,005


def test_parities_bound_how_many_words_differ():
    rng = np.random.default_rng(6)
    words = [f"v{i}" for i in range(400)]
    texts = [" ".join(rng.permutation(words)[:n]) for n in [1, 5, 40, 47, 48, 49, 130, 300] * 3]
    lines = line_dedup.Lines(pa.array(texts))
    odd, half = lines.parities()
    for i in range(len(texts)):
        for j in range(len(texts)):
            differ = len(set(tokens(texts[i])) ^ set(tokens(texts[j])))
            x, y = int(odd[i] ^ odd[j]) & 2**64 - 1, int(half[i] ^ half[j]) & 2**64 - 1
            assert x.bit_count() <= differ
            if min(lines.size[i], lines.size[j]) >= line_dedup.LONG:
                assert y.bit_count() + (x ^ y).bit_count() <= differ


def test_shuffles_of_saved_tables_go(spark):
    before = spark.conf.get(common.SHUFFLES_GO)

    def files():
        return {name for _, _, names in os.walk(root) for name in names if name.startswith("shuffle_")}

    root = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()[0].getParent()
    there = files()
    table = common.saved(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    assert spark.conf.get(common.SHUFFLES_GO) == before
    for _ in range(50):
        if not files() - there:
            break
        time.sleep(0.1)
    assert not files() - there
    assert table.count() == 7


def test_names():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]


def test_words_with_equal_keys_are_told_apart():
    key, hashes = np.array([7, 7, 7, 3], np.uint64), np.array([1, 2, 1, 9], np.uint64)
    assert hashes[line_dedup.ordered(key, hashes)].tolist() == [9, 1, 1, 2]
    many = np.random.default_rng(0).integers(0, 50, 2000).astype(np.uint64)
    by_key = many[line_dedup.ordered(many // np.uint64(7), many)]
    assert (np.flatnonzero(np.diff(by_key.astype(np.int64))).size + 1) == len(set(many.tolist()))


def test_the_end_of_texts_is_known_however_rare(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "TABLE_WORDS", 30)
    text = " ".join(f"w{i}" for i in range(40)) + " " + " ".join(f"w{i}" for i in range(40))
    row = lm_scoring.scored(spark.createDataFrame([(1, text)], "doc_id long, text string"), F.lit(False)).first()
    counts, total, distinct = collections.Counter(text.split()) + collections.Counter({None: 1}), 81, 41
    assert (row.n_tokens, row.n_known, row.train_tokens) == (81, 81, 81)
    assert row.base_score == pytest.approx(sum(n * math.log10((n + 1) / (total + distinct + 1)) for n in counts.values()))


@pytest.mark.parametrize("attributes,shown", [
    ('title="the hidden gem"', True), ("title='not hidden at all' lang=en", True), ('data-x="display: none"', True), ("data-hidden=1", True), ('class="x" title="a style=\'display:none\' b"', True),
    ("hidden", False), ('lang="en" hidden', False), ('hidden="until-found" title="x"', False), ('style="color: red; display : none"', False),
    ("STYLE='display:none'", False), ("style=display:none", False), ('title="y" style="display:none"', False), ("hidden/", False)])
def test_only_the_attribute_hides(attributes, shown):
    page = html_text.Page(f"<div><p {attributes}>Gem text</p><p>and more</p></div>")
    assert page.text(frozenset()) == ("Gem text and more" if shown else "and more")
