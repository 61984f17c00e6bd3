import random
import re

from pyspark.sql import functions as F

from foliograde.operators import pages


def brute_clean(text):
    text = re.sub(r"\s+", " ", text)
    return re.sub(r'[^\w\s.,;:!?\-@#$%&*()+=\[\]{}|\\/<>"]', "", text).strip()


def test_segments_join_to_the_whole_text(spark):
    rng = random.Random(3)
    docs = {d: [" ".join(rng.choice(["a", "’", "b.", "\n", " ", "é"]) for _ in range(6)) for _ in range(n)]
            for d, n in enumerate([1, 3, 25])}
    rows = [(d, i + 1, t) for d, ts in docs.items() for i, t in enumerate(ts)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, page_num long, text string")
    for size in (4, 256):
        parts = pages.assemble_pages(df, pages_per_segment=size).orderBy("doc_id", "segment").collect()
        assert max(p.pages for p in parts) <= size
        for d, ts in docs.items():
            whole = "".join(f"\n--- Page {i + 1} ---\n{t}\n" for i, t in enumerate(ts))
            joined = "".join(p.text + " " * p.tail_blanks for p in parts if p.doc_id == d)
            assert joined.rstrip(" ") == brute_clean(whole)


def test_scan_detection(spark):
    df = spark.createDataFrame([
        (1, 1, "x" * 60), (1, 2, "y" * 60), (2, 1, "x" * 40), (2, 2, ""), (3, 1, "x" * 149 + " "),
        (3, 2, None), (3, 3, " ’"), (3, 4, "z" * 900)], "doc_id long, page_num long, text string")
    docs = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "doc_id long")
    got = {r.doc_id: r for r in pages.detect_scanned(docs, df).collect()}
    assert (got[1].scanned, got[1].chars_per_page) == (False, 60.0)
    assert got[2].scanned and got[2].text_source == "ocr"
    assert got[3].scanned and got[3].chars_per_page == 149 / 3
    assert got[4].scanned and got[4].chars_per_page is None


def test_ocr_pages(spark):
    rows = [(1, 1, i, w, c) for i, (w, c) in enumerate(
        [("Hello", 90), (" ", 50), ("big", -1), ("", 10), ("world", 0), ("end", 30)])]
    tokens = spark.createDataFrame(rows + [(1, 2, 0, "lost", 80)],
                                   "doc_id long, page_num long, pos int, word string, conf int")
    listed = spark.createDataFrame([(1, 1, None), (1, 2, "timeout"), (1, 3, None)],
                                   "doc_id long, page_num long, error string")
    stats = pages.ocr_page_stats(listed, tokens)
    got = {r.page_num: r for r in stats.collect()}
    assert (got[1].word_count, got[1].text_length, got[1].avg_confidence) == (4, 19, 60.0)
    assert (got[2].word_count, got[2].confidence, got[3].word_count) == (0, 0.0, 0)
    assert pages.ocr_quality(stats).first().ocr_quality == 0.6 / 3
    parts = pages.ocr_page_text(listed, tokens, tokens_per_part=3).orderBy("page_num", "part").collect()
    assert [(p.page_num, p.part, p.text) for p in parts] == [
        (1, 0, "Hello big"), (1, 1, "world end"), (2, 0, "[OCR failed: timeout]"), (3, 0, "")]


def test_quality_by_source(spark):
    docs = spark.createDataFrame([(1, "text"), (2, "ocr"), (3, "ocr")], "doc_id long, text_source string")
    quality = spark.createDataFrame([(1, 0.3), (2, 0.3)], "doc_id long, ocr_quality double")
    got = {r.doc_id: r.ocr_quality for r in pages.with_quality(docs, quality).collect()}
    assert got == {1: 1.0, 2: 0.3, 3: 0.8}


def test_table_normalisation(value):
    build = lambda raw: pages.normalised_table(raw, F.lit(2), F.lit(0))
    schema = "raw array<array<string>>"
    got = value(build, schema, [["h"], ["1"], ["2"]])
    assert (got.headers, got["rows"], got.page) == (["h"], [["1"], ["2"]], 2)
    assert value(build, schema, [["h"]])["rows"] == []
    assert value(build, schema, []) is None
