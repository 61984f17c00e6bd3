"""Plans and skew: what would hurt on a cluster."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as spark_entry
from foliograde.functions.once import with_once
from foliograde.operators import batch, results, validation
from foliograde.plans import catalog, inputs
from foliograde.sources import results_io
from foliograde.streaming import ingest

ID_SCHEMA = "doc_id string, source_file string, text string, ocr_quality double, response string, fallback_response string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored_replies(spark, sf, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("replies"))
    inputs.replies(spark, sf).select("doc_id", "source_file", "text", "ocr_quality", "response",
                                     "fallback_response").write.mode("overwrite").parquet(folder)
    return folder


def test_processing_needs_no_shuffle(spark, stored_replies):
    df = results.process_documents(spark.read.parquet(stored_replies), "doc_id")
    assert "Exchange" not in plan(df)


def test_filters_reach_the_scan_through_the_chain(spark, stored_replies):
    df = results.process_documents(spark.read.parquet(stored_replies), "doc_id")
    text = plan(df.filter(F.col("doc_id") == "12").select("doc_id", "overall_confidence"))
    assert "EqualTo(doc_id,12)" in text
    assert "source_file" not in text.split("ReadSchema")[1]


@pytest.mark.parametrize("name", ["route_lexicon_join", "char_jaccard", "assemble_pages", "ocr_page_stats",
                                  "band_shares", "confidence_histogram", "batch_dedup", "line_items_long"])
def test_no_cross_joins(spark, sf, name):
    text = plan(spark_entry.queries()[name](spark, sf))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_results_do_not_depend_on_partitioning(spark, stored_replies):
    def run(df):
        rows = results.process_documents(df, "doc_id").select(
            "doc_id", "doc_type", "overall_confidence", "validation.failed_rules").collect()
        return sorted(map(repr, rows))
    df = spark.read.parquet(stored_replies)
    assert run(df.coalesce(1)) == run(df.repartition(13, F.xxhash64("text")))


def hot_tables(spark, sf, folder, hot_lines):
    """A copy of the small tables in which one order has many extra lines."""
    for name in ("orders", "customer", "part", "supplier", "nation", "documents"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    ids = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(hot_lines - 1).cast("long"))).alias("id")
    extra = lines.limit(1).select("*", ids).withColumn("l_orderkey", F.lit(12).cast("long"))
    extra = extra.withColumn("l_partkey", F.col("id") % 200).withColumn(
        "l_linenumber", (F.col("id") % 7).cast("int")).drop("id")
    lines.unionByName(extra).write.parquet(f"{folder}/lineitem.parquet")
    return lines.count() + hot_lines


def test_a_huge_order_is_one_document(spark, sf, tmp_path):
    total = hot_tables(spark, sf, str(tmp_path), 5000)
    docs = inputs.order_documents(spark, str(tmp_path)).select("doc_id", "o_orderkey", F.size("lines").alias("n")).collect()
    assert sum(r.n for r in docs) == total
    assert [r.n > 5000 for r in docs if r.o_orderkey == 12] == [True]
    assert len({r.doc_id for r in docs}) == len(docs)


def test_stream_equals_batch_and_stores_once(spark, stored_replies, tmp_path):
    source, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    df = spark.read.parquet(stored_replies).select("doc_id", "source_file", "text", "ocr_quality", "response",
                                                   "fallback_response").limit(300).cache()
    first, second = df.filter("doc_id % 2 = 0"), df.filter("doc_id % 2 = 1")
    first.coalesce(1).write.mode("append").parquet(source)
    for late in (second, None, None):
        stream = ingest.read_documents(spark, source, df.schema)
        ingest.ingest(stream, out, state, "doc_id").awaitTermination()
        if late is not None:
            late.coalesce(1).write.mode("append").parquet(source)
    columns = ["doc_id", "doc_type", "overall_confidence"]
    stored = sorted(map(tuple, spark.read.json(out).select(columns).collect()))
    batch = sorted(map(tuple, results.process_documents(df, "doc_id").select(columns).collect()))
    assert stored == batch
    assert len([d for d in os.listdir(out) if d.startswith("batch=")]) == 2


@pytest.mark.parametrize("name", ["route_with_fallback", "pages_to_results", "extraction_outcome", "validate_own_rules"])
def test_code_is_generated_whole(spark, sf, name):
    """No stage is too large to compile, which would quietly interpret it."""
    settings = {"spark.sql.codegen.fallback": "false", "spark.sql.codegen.factoryMode": "CODEGEN_ONLY"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        assert catalog.QUERIES[name](spark, sf).collect()
    finally:
        for key in settings:
            spark.conf.unset(key)


def test_metrics_of_a_batch(spark, tmp_path):
    rows = [(i, f"/in/{i % 6}", text, None, reply, None) for i, (text, reply) in enumerate(
        [("an invoice", '{"vendor_name": "a", "currency": null}'), ("  ", None), ("rx", None), ("an invoice", "{}"), ("nothing", None), ("hospital", None)] * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, source_file string, text string, ocr_quality double, response string, fallback_response string")
    totals, metrics = batch.run_batch(docs, str(tmp_path), "doc_id", "doc_id")
    assert metrics == {"documents": 6, "errors": 1, "fields": 2}  # the last entry of each path; one without text
    assert (totals.first().total_files, totals.first().failed) == (6, 1)


def test_costly_columns_are_made_by_a_projection(spark):
    """Not by the generator, which may interpret them."""
    df = with_once(spark.range(3), {"a": F.transform(F.array("id"), lambda x: x + 1)})
    assert "inline(array(_once" in plan(df)
    assert [r.a for r in df.orderBy("id").collect()] == [[1], [2], [3]]


def test_results_are_stored_compressed(spark, tmp_path):
    folder = str(tmp_path / "out")
    results_io.write_results(spark.createDataFrame([(1, "invoice")], "doc_id long, doc_type string"), folder)
    names = [f for _, _, files in os.walk(folder) for f in files if f.startswith("part-")]
    assert names and all(f.endswith(".json.gz") for f in names)
    assert spark.read.json(folder).select("doc_id", "doc_type").collect() == [(1, "invoice")]


def test_tables_meet_their_texts_where_they_lie(spark, sf):
    """Texts are not shuffled once more to be joined with the tables of the same order."""
    assert "hashpartitioning(doc_id" not in plan(spark_entry.queries()["extraction_requests"](spark, sf))


def test_routing_replies_are_joined_without_the_texts(spark, sf):
    df = spark_entry.queries()["route_with_fallback"](spark, sf)
    join = next(n for n in plan(df).split("\n") if "Join [doc_id" in n)
    above = plan(df).split(join)[0]
    assert " text#" not in above and "_lower" not in above and "_has_text#" in above


def test_a_published_record_is_parsed_once(spark):
    df = spark.createDataFrame([('{"doc_type": "x", "fields": [], "overall_confidence": 0.5}',)], "record string")
    checked = df.select(validation.structural_issues(F.col("record")).alias("issues"))
    assert plan(checked).count("parse_json") + plan(checked).count("parseJson") == 1
    assert checked.first().issues == []


def test_rule_texts_are_made_per_document(spark, sf):
    text = plan(spark_entry.queries()["field_rule_status"](spark, sf))
    assert "array_join" not in text.split("explode")[0] and "array_join" in text


@pytest.mark.parametrize("name", ["extraction_outcome", "parse_typed_response"])
def test_queries_on_replies_do_not_make_texts(spark, sf, name):
    scans = [line for line in plan(spark_entry.queries()[name](spark, sf)).splitlines() if "documents.parquet" in line]
    assert scans and not any("text" in line.partition("ReadSchema")[2] for line in scans)


def test_leaves_are_walked_once(spark, sf):
    """Evidence and scores are worked out in one pass over the leaves, which are filtered once."""
    text = plan(spark_entry.queries()["score_documents"](spark, sf))
    assert "zip_with" not in text
