"""What is moved and kept on disk: lines by order, texts by document, shuffles after a write."""

import os

import pytest

import __spark_entry__ as spark_entry
from foliograde.operators import batch, pages, routing, summary
from foliograde.plans import inputs
from foliograde.session import SHUFFLES_GO, shuffles_go
from foliograde.sources import results_io


@pytest.fixture
def unadapted(spark):
    """Plans as they are at first, without small tables sent around."""
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield spark
    for key in settings:
        spark.conf.unset(key)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def few_orders(spark, folder):
    """Two orders whose lines lie apart; a supplier that comes twice, one without a nation, and a line without any."""
    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    put("lineitem", [(1, 1, 1, 1, 2.0, 10.0, 0.1, 0.05), (2, 2, 2, 1, 1.0, 5.0, 0.0, 0.0), (1, 2, 3, 2, 1.0, 7.0, 0.0, 0.1),
                     (1, None, None, 3, 3.0, 9.0, 0.5, 0.0), (None, 1, 1, 1, 1.0, 1.0, 0.0, 0.0)],
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double")
    put("part", [(1, "bolt", 3), (2, "ring", 4)], "p_partkey long, p_name string, p_size int")
    put("supplier", [(1, "b", 1), (1, "a", 1), (2, "c", 1), (3, "d", None)], "s_suppkey long, s_name string, s_nationkey int")
    put("nation", [(1, "PERU")], "n_nationkey int, n_name string")
    return inputs.order_lines(spark, folder)


def test_lines_are_not_moved_by_supplier(unadapted, sf):
    """F8: the names of suppliers and what is worked out from a line are added where the orders lie."""
    text = plan(inputs.order_documents(unadapted, sf))
    assert "hashpartitioning(l_suppkey" not in text
    assert text.count("Exchange hashpartitioning(l_orderkey") == 1


@pytest.mark.parametrize("most", [0, 500_000])
def test_lines_do_not_depend_on_how_suppliers_are_met(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(inputs, "BROADCAST_SUPPLIERS", most)
    found = few_orders(spark, str(tmp_path)).select("l_orderkey", "l_linenumber", "p_name", "s_name", "s_nation", "total_price", "unit_price", "tax")
    assert sorted(map(tuple, found.collect()), key=repr) == sorted([
        (1, 1, "bolt", "a", "PERU", 9.0, 5.0, 0.45), (1, 1, "bolt", "b", "PERU", 9.0, 5.0, 0.45), (1, 2, "ring", None, None, 7.0, 7.0, 0.7),
        (1, 3, None, None, None, 4.5, 3.0, 0.0), (2, 1, "ring", "c", "PERU", 5.0, 5.0, 0.0),
        (None, 1, "bolt", "a", "PERU", 1.0, 1.0, 0.0), (None, 1, "bolt", "b", "PERU", 1.0, 1.0, 0.0)], key=repr)


def test_whole_documents_are_moved_once(unadapted):
    """pages are put together by document, and routing by document needs no other shuffle."""
    df = unadapted.createDataFrame([("a", 2, "total"), ("a", 1, "invoice"), ("b", 1, None), (None, 1, "x")], "doc_id string, page_num long, text string")
    whole = pages.assemble_pages(df)
    assert plan(routing.route_segments(whole, "doc_id")).count("Exchange hashpartitioning") == 1
    assert whole.columns == ["doc_id", "segment", "pages", "text", "tail_blanks"]
    assert dict(whole.dtypes) == dict(pages.assemble_pages(df, pages_per_segment=1).dtypes)
    assert {(r.doc_id, r.segment, r.pages) for r in whole.collect()} == {("a", 0, 2), ("b", 0, 1), (None, 0, 1)}


def test_tables_and_texts_share_the_moved_lines(unadapted, sf):
    """lines are moved once for the tables and the texts of the same orders."""
    lines = [line for line in plan(spark_entry.queries()["extraction_requests"](unadapted, sf)).splitlines() if "Exchange hashpartitioning(l_orderkey" in line]
    assert ["ReusedExchange" in line for line in lines] == [False, True]


def shuffle_files(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for d in dirs for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}


def test_shuffles_go_once_results_are_stored(spark, tmp_path):
    """the shuffles behind stored results do not lie beside what is stored next."""
    before = shuffle_files(spark)
    rows = spark.range(100).selectExpr("id AS doc_id", "'invoice' AS doc_type").repartition(4, "doc_id")
    results_io.write_results(rows, str(tmp_path / "out"))
    assert not shuffle_files(spark) - before
    assert spark.read.json(str(tmp_path / "out")).count() == 100


@pytest.mark.parametrize("was", [None, "false"])
def test_the_setting_is_put_back(spark, was):
    if was is not None:
        spark.conf.set(SHUFFLES_GO, was)
    try:
        with pytest.raises(ZeroDivisionError), shuffles_go(spark):
            assert spark.conf.get(SHUFFLES_GO) == "true"
            1 / 0
        assert spark.conf.get(SHUFFLES_GO) == "false"
    finally:
        spark.conf.unset(SHUFFLES_GO)


def test_a_batch_moves_only_what_results_are_made_of(spark, tmp_path, monkeypatch):
    """columns that no step reads are not carried to the last entry of a path."""
    moved = []
    latest = summary.latest
    monkeypatch.setattr(summary, "latest", lambda df, key, order, *columns: moved.extend(columns) or latest(df, key, order, *columns))
    docs = spark.createDataFrame([("7", 1, "/in/7", "an invoice", None, "{}", None, "x" * 50), ("8", 2, "/in/7", "hospital", None, None, None, "y")],
                                 "doc_id string, entry long, source_file string, text string, ocr_quality double, response string, fallback_response string, more string")
    totals, metrics = batch.run_batch(docs, str(tmp_path), "doc_id", "entry")
    assert moved == ["doc_id", "text", "ocr_quality", "response", "fallback_response"]
    assert (totals.first().total_files, metrics["documents"]) == (1, 1)
