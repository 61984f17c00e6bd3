import random

import pytest
from pyspark.sql import functions as F

from foliograde import fixed_values as fv
from foliograde.operators import pages, routing


def routed(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return routing.route_by_keywords(df, prefix="").orderBy("doc_id").collect()


def test_ties_density_and_no_hit(spark):
    three = "invoice vendor tax"
    rows = routed(spark, three, three + " x" * 497, "invoice hospital", "nothing here", None, "HOSPITAL bed")
    assert [r.doc_type for r in rows] == ["invoice", "invoice", "invoice", "unknown", "unknown", "medical_bill"]
    assert rows[0].confidence == 0.8
    assert rows[1].confidence == pytest.approx(0.3)
    assert rows[0].reasoning == "Keyword-based classification: 3 matching keywords"
    assert rows[3].confidence == 0.0 and rows[3].reasoning == "No matching keywords found"


def test_keywords_are_substrings(spark):
    df = spark.createDataFrame([("subtotal in html taxis",)], "text string")
    row = routing.add_keyword_scores(df).first()
    assert (row.score_invoice, row.score_medical_bill, row.score_prescription) == (3, 0, 1)


@pytest.mark.parametrize("reply, doc_type, confidence", [
    ('{"doc_type": "invoice", "confidence": 0.95, "reasoning": "r"}', "invoice", 0.95),
    ('{"doc_type": "invoice", "confidence": 1.7}', "invoice", 1.0),
    ('{"doc_type": "invoice", "confidence": -1}', "invoice", 0.0),
    ('{"doc_type": "receipt", "confidence": 0.9}', "unknown", 0.0),
    ('{"confidence": 0.9}', "unknown", 0.0),
    ('{"doc_type": "invoice"}', "unknown", 0.0),
    ('{"doc_type": "invoice", "confidence": null}', "unknown", 0.0),
    ('{"doc_type": "invoice", "confidence": "high"}', "unknown", 0.0),
    ('["invoice"]', "unknown", 0.0), ('{"doc_type": ', "unknown", 0.0), (None, "unknown", 0.0),
    ('```json\n{"doc_type": "invoice", "confidence": 0.5}\n```', "invoice", 0.5),
])
def test_routing_replies(spark, reply, doc_type, confidence):
    df = spark.createDataFrame([(reply,)], "response string")
    got = routing.with_routing_reply(df).first().reply
    assert (got.doc_type, got.confidence) == (doc_type, confidence)


def test_model_first_then_keywords(spark):
    docs = spark.createDataFrame(
        [(1, "hospital patient"), (2, "hospital patient"), (3, "  "), (4, "rx")], "doc_id long, text string")
    replies = spark.createDataFrame([
        (1, '{"doc_type": "invoice", "confidence": 0.9, "reasoning": "seen"}'),
        (2, '{"doc_type": "receipt", "confidence": 0.9}'),
        (3, '{"doc_type": "invoice", "confidence": 0.9}')], "doc_id long, response string")
    got = {r.doc_id: r for r in routing.route(docs, replies).collect()}
    assert got[1].doc_type == "invoice" and got[1].routing_reasoning == "seen"
    assert got[2].doc_type == "medical_bill"
    assert got[3].doc_type == "unknown" and got[3].routing_reasoning == fv.NO_KEYWORDS
    assert got[4].doc_type == "prescription"
    strict = {r.doc_id: r for r in routing.route(docs, replies, use_fallback=False).collect()}
    assert strict[2].doc_type == "unknown" and strict[3].routing_reasoning == fv.NO_TEXT_CONTENT


def test_segments_route_like_whole_documents(spark):
    words = ["invoice", "vendor", "rx", "hospital", "plain", "purchase order", "tax"]
    rows = [(d, p + 1, f"{words[(d + p) % 7]} ' text {p}") for d in range(6) for p in range(1 + 40 * d)]
    paged = spark.createDataFrame(rows, "doc_id long, page_num long, text string")
    whole = pages.assemble_pages(paged, pages_per_segment=10_000)
    parts = pages.assemble_pages(paged, pages_per_segment=7)
    assert parts.count() > 6 and whole.count() == 6
    expected = {r.doc_id: (r.doc_type, r.confidence, r.reasoning)
                for r in routing.route_by_keywords(whole, prefix="").collect()}
    got = {r.doc_id: (r.keyword_doc_type, r.keyword_confidence, r.keyword_reasoning)
           for r in routing.route_segments(parts, "doc_id").collect()}
    assert got == expected
    with pytest.raises(ValueError):
        routing.route_segments(parts, "doc_id", lexicon={"a": ["x -ray"]})


def test_lexicon_join_equals_expressions(spark):
    rows = [(t, k, i) for i, (t, ks) in enumerate(fv.ROUTING_KEYWORDS.items()) for k in ks]
    lexicon = spark.createDataFrame(rows, "doc_type string, keyword string, priority int")
    texts = ["invoice tax", "hospital, CLINIC and rx", "", "none", "dr. take mg ml\ntablet", "patient vendor"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    small = sorted(routing.route_with_lexicon(docs, lexicon).collect())
    large = sorted(routing.route_with_lexicon(docs, lexicon, limit=0).collect())
    fixed = sorted((r.doc_id, r.doc_type) for r in routing.route_by_keywords(docs, prefix="").collect())
    assert small == large
    assert [(r.doc_id, r.doc_type) for r in small] == fixed


def test_lexicon_paths_agree_on_priorities(spark):
    rows = [("b", "x", 5), ("b", "yy", 1), ("a", "z", 2), ("c", "q", 7), ("d", "q", 7), ("d", "q", 8), ("e", "", 9)]
    lexicon = spark.createDataFrame(rows, "doc_type string, keyword string, priority int")
    docs = spark.createDataFrame(list(enumerate(["x z", "q", "", None, "yy z x"])), "doc_id long, text string")
    small = sorted(routing.route_with_lexicon(docs, lexicon).collect())
    assert small == sorted(routing.route_with_lexicon(docs, lexicon, limit=0).collect())
    assert [r.doc_type for r in small][:2] == ["b", "c"]


def plain_hits(texts, keywords):
    return {(i, k) for i, t in texts if t is not None for k in keywords if k in t.lower()}


def test_lexicon_hits_of_odd_texts_and_keywords(spark):
    keywords = ["", "a", "ab", "abc", "abcdefgh", "abcdefghi", "aaaa", "aaaaaaaaaaaa", "é", "日本語", "\n", "$&|.*", "\U0001F600x", "zz", "never held by any"]
    texts = list(enumerate([None, "", "ABC", "xxabcdefghixx", "a" * 300, "É a\nb", "日本語テキスト", "($&|.*)", "😀x \U0001F600X", "z z", "no" * 5000 + "zz"]))
    lexicon = spark.createDataFrame([("t", k, 1) for k in keywords] + [("u", "abc", 2), ("u", None, 3), ("t", "abc", 4)], "doc_type string, keyword string, priority int")
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = routing.lexicon_hits(docs, routing.keyword_index(lexicon)).collect()
    assert {(r.doc_id, r.keyword) for r in found} == plain_hits(texts, keywords) and len(found) == len(plain_hits(texts, keywords))
    assert {tuple(sorted((t.doc_type, t["rank"]) for t in r.types)) for r in found if r.keyword == "abc"} == {(("t", 1), ("u", 2))}
    assert routing.lexicon_hits(docs, routing.keyword_index(lexicon.limit(0))).count() == 0


def large_lexicon(n=100_000):
    """Keywords of ten lengths, nearly all of them in no text."""
    rng = random.Random(4)
    return list({"".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=5 + i % 10)) for i in range(n)})


@pytest.mark.parametrize("broadcast", [True, False])
def test_large_lexicon_makes_few_rows(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(routing, "BROADCAST_KEYWORDS", 10)
    keywords = large_lexicon()
    rng = random.Random(6)
    texts = [(i, " ".join(["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(300)] + rng.sample(keywords, 3))) for i in range(60)]
    lexicon = spark.createDataFrame([(f"t{hash(k) % 7}", k, len(k)) for k in keywords], "doc_type string, keyword string, priority int")
    index = routing.keyword_index(lexicon)
    assert index.count() == len(keywords)
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    hits = routing.lexicon_hits(docs, index)
    found = {(r.doc_id, r.keyword) for r in hits.collect()}
    by_length = {n: {k for k in keywords if len(k) == n} for n in {len(k) for k in keywords}}
    expected = {(i, t[at:at + n]) for i, t in texts for n, ks in by_length.items() for at in range(len(t) - n + 1) if t[at:at + n] in ks}
    assert found == expected and len(found) >= 3 * len(texts)
    # of about 2,100 characters a text only filed sequences become rows, few more than there are hits
    rows = routing.near_grams(docs, index).count()
    assert len(found) <= rows <= 3 * len(found) + 200
