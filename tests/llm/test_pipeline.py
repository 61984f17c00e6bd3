"""The pipeline's stages, each against a plain version on its own input, odd rows included."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from foliograde.llm import toxicity
from foliograde.llm.common import read

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PLAIN, ALNUM = re.compile("[^\x20\x09-\x0D]+"), re.compile("[0-9a-z\x80-\U0010ffff]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size=5):
    words = PLAIN.findall((text or "").translate(FOLD))
    return {tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def rows_of(df):
    return collections.Counter(tuple(r[c] for c in ("doc_id", "text", "source")) for r in df.collect())


def kept_by_hand(rows):
    """One row of each group of linked rows: the smallest id, null last; equal rows are one."""
    once = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    sets = [shingles(r[1]) for r in once]
    part = list(range(len(once)))
    for i in range(len(once)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) * 100 >= 80 * len(sets[i] | sets[j]):
                part = [part[j] if p == part[i] else p for p in part] if part[i] != part[j] else part
    kept = {}
    for i, r in enumerate(once):
        kept.setdefault(part[i] if sets[i] else ("none", i), []).append(r)
    return [group for group in kept.values()]


@pytest.fixture(scope="module")
def planted(spark, sf):
    """Documents with copies, near copies, two texts under one id, null ids, contaminated and odd ones."""
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.choice([3, 5, 7]))) for _ in range(400)]
    text = lambda n=80: " ".join(rng.choices(words, k=n))
    base = [text() for _ in range(12)]
    item = max((r.text for r in read(spark, sf, "benchmark").collect()), key=len)
    passage = " ".join(item.split()[:14])
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(20, base[0]), (21, base[1] + " more"), (22, base[2].replace(base[2].split()[40], "changed", 1)), (3, text()), (3, base[4]), (4, base[4])]
    rows += [(None, base[5]), (None, base[5]), (None, text()), (None, None), (30, None), (31, ""), (31, ""), (32, "two words"), (33, "two words")]
    rows += [(40, text(20) + " " + passage + " " + text(20)), (41, passage.upper()), (42, " ".join(passage.split()[:7]))]
    every = [(i, t, "en", None if k % 5 == 4 else f"s{k % 3}", 0) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(every + every[:1], DOCS).repartition(3)


def test_near_duplicates_follow_the_row(spark, sf, planted):
    rows = [(r.doc_id, r.text) for r in planted.collect()]
    kept = corpus_pipeline.near_duplicates(spark, planted, sf)
    assert kept.columns == planted.columns
    got = collections.Counter((r.doc_id, r.text) for r in kept.collect())
    groups = kept_by_hand(rows)
    assert max(got.values()) == 1 and sum(got.values()) == len(groups)
    for group in groups:
        assert sum(got[r] for r in group) == 1
        stayed = next(r for r in group if got[r])
        assert (stayed[0] is None, stayed[0] or 0) == min((r[0] is None, r[0] or 0) for r in group)
    assert corpus_pipeline.near_duplicates(spark, planted.limit(0), sf).count() == 0


def test_decontamination_against_windows(spark, sf, planted):
    windows = set()
    for r in read(spark, sf, "benchmark").collect():
        words = ALNUM.findall((r.text or "").translate(FOLD))
        n = min(10, len(words))
        windows |= {tuple(words[i:i + n]) for i in range(len(words) - n + 1) if n}
    lengths = {len(w) for w in windows}

    def hit(text):
        words = ALNUM.findall((text or "").translate(FOLD))
        return any(tuple(words[i:i + n]) in windows for n in lengths for i in range(len(words) - n + 1))

    expected = collections.Counter(r for r in rows_of(planted).elements() if not hit(r[1]))
    assert rows_of(corpus_pipeline.benchmark_decontamination(spark, planted, sf)) == expected
    assert sum(expected.values()) < planted.count()


def test_toxicity_mix_and_shards_on_planted_rows(spark, sf, planted):
    clean = corpus_pipeline.toxicity_filter(spark, planted, sf)
    verdicts = toxicity.with_scores(planted, read(spark, sf, "labels")).select("doc_id", "row.text", "predicted").collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in clean.collect()) == sorted((r.doc_id or -1, r.text or "") for r in verdicts if not r.predicted)
    mixed = corpus_pipeline.source_mix(spark, planted, sf)
    assert mixed.columns == planted.columns
    copies = rows_of(mixed)
    assert set(copies) <= set(rows_of(planted)) and all(n <= 2 * rows_of(planted)[r] for r, n in copies.items())
    shards = corpus_pipeline.shard_assignment(spark, mixed, sf).collect()
    per_shard = collections.Counter(r.shard for r in shards)
    assert len(shards) == mixed.count() and max(per_shard.values()) - min(per_shard[i] for i in range(40)) <= 1


def test_whole_run(spark, sf):
    """What comes out holds no near copies, no contaminated document, no toxic one, and nothing new."""
    out = corpus_pipeline.run(spark, sf).collect()
    docs = {r.doc_id: r for r in read(spark, sf, "documents").collect()}
    used = collections.Counter(r.doc_id for r in out)
    assert used and set(used) <= set(docs) and max(used.values()) <= 2
    sets = [shingles(docs[i].text) for i in used]
    assert not any(a and b and len(a & b) * 100 >= 80 * len(a | b) for k, a in enumerate(sets) for b in sets[:k])
    toxic = {r.doc_id for r in toxicity.with_scores(read(spark, sf, "documents"), read(spark, sf, "labels")).where(F.col("predicted") == 1).collect()}
    assert not toxic & set(used)
