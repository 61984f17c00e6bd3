"""Best items by character sets, against the pairwise similarity in plain Python."""

import random

import pytest

from foliograde.operators import similarity


def plain(docs, items, least):
    out = {}
    for i, text in docs:
        a = set((text or "").lower())
        scored = []
        for j, other in items:
            b = set((other or "").lower())
            if a and b and len(a & b) / len(a | b) >= least:
                scored.append((-len(a & b) / len(a | b), j))
        if scored:
            out[i] = min(scored)[1], -min(scored)[0]
    return out


@pytest.mark.parametrize("least", [0.1, 0.5, 0.9, 1.0])
def test_best_items_equal_pairwise(spark, least):
    rng = random.Random(8)
    alphabet = "abcdefghijklmnopqrstuvwxyzABC 0123456789\t\x00\x7f@éÉßñ日本語\U0001F600"
    def text():
        return "".join(rng.choices(alphabet, k=rng.choice([1, 3, 8, 30])))
    docs = [(i, text()) for i in range(150)] + [(200, None), (201, ""), (202, "日本"), (203, "abc"), (204, "CBA"), (203, "zz")]
    items = [(j, text()) for j in range(40)] + [(50, "abc"), (49, "cab"), (51, None), (52, ""), (53, "語本日")]
    found = similarity.best_items(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), least=least).collect()
    once = [(i, t) for i, t in docs if i != 203]
    assert {r.doc_id: (r.item_id, pytest.approx(r.similarity)) for r in found if r.doc_id != 203} == plain(once, items, least)
    assert sorted(r.item_id for r in found if r.doc_id == 203 and r.similarity == 1.0) == [49]


def test_no_items_no_rows(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert similarity.best_items(docs, none).count() == 0 and similarity.best_items(docs.limit(0), none).count() == 0
