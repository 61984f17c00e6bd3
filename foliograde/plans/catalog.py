"""The registered queries: each operator applied to the given tables, as a flat result."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliograde import fixed_values as fv
from foliograde.functions import confidence as cf
from foliograde.functions import text as tx
from foliograde.functions.confidence import Weights
from foliograde.functions.once import with_once
from foliograde.operators import (
    batch, fields, freeform, pages, requests, responses, results, routing, scoring, similarity, summary, validation,
)
from foliograde.plans import inputs
from foliograde.session import shared_folder
from foliograde.sources import files, results_io
from foliograde.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Ship the stand-in model below to the workers by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

JOB_STAMP = "20240115_103000"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def r6(value: Column | str) -> Column:
    """Six digits; the small shift keeps exact halves from falling with the order of a sum."""
    number = F.col(value) if isinstance(value, str) else value
    return F.floor(number * 1e6 + 0.500001) / 1e6


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.table(spark, sf, "documents", "doc_id", "text")


def order_texts(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.records(spark, sf).select("doc_id", "o_orderkey", "kind", "text")


def judged(spark: SparkSession, sf: str) -> DataFrame:
    return results.judge_records(inputs.typed_records(spark, sf), freeform=False)


def published(spark: SparkSession, sf: str) -> DataFrame:
    return results.publish(judged(spark, sf), "doc_id")


def processed(spark: SparkSession, sf: str) -> DataFrame:
    return results.process_documents(inputs.replies(spark, sf), "doc_id")


def scored_fields(spark: SparkSession, sf: str) -> DataFrame:
    return judged(spark, sf).select(
        "doc_id", "doc_type", "passed_rules", "failed_rules", F.posexplode("scored").alias("pos", "field"),
    ).select("doc_id", "doc_type", F.col("pos").cast("long").alias("pos"), "field.*", "passed_rules", "failed_rules")


def long_form(df: DataFrame, values: Column, kind: str) -> DataFrame:
    """One row per extracted value, in order of finding."""
    return df.select("doc_id", F.lit(kind).alias("kind"), F.posexplode(values).alias("pos", "value")).select(
        "doc_id", "kind", F.col("pos").cast("long").alias("pos"), "value")


def run_folder(spark: SparkSession, sf: str, name: str) -> str:
    """A folder of this application's own below the shared one."""
    source = sf.strip("/").replace("/", "_")
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}/{source}"


# --- files, sinks, streams --------------------------------------------------------------------

@query
def file_inventory(spark, sf):
    return files.list_files(spark, sf).select("filename", "size_bytes", "size_mb", "extension", "kind")


@query
def file_info(spark, sf):
    return files.file_info(inputs.files(spark, sf))


@query
def file_kind(spark, sf):
    path = F.col("path")
    return inputs.files(spark, sf).select(
        "path", files.extension(path).alias("extension"), files.file_kind(path).alias("kind"))


@query
def result_name(spark, sf):
    doc_type = F.element_at(F.array(*map(F.lit, fv.DOC_TYPES)), (F.col("page_id") % 3 + 1).cast("int"))
    return inputs.files(spark, sf).select(
        "path", files.result_name(F.col("path"), doc_type, F.lit(JOB_STAMP)).alias("result_name"))


@query
def result_roundtrip(spark, sf):
    """Results written as JSON, one folder per type, and read back with their full schema."""
    folder = run_folder(spark, sf, "results")
    results_io.write_results(published(spark, sf), folder, mode="overwrite")
    ids = T.StructType([T.StructField("doc_id", T.StringType())])
    back = results_io.read_results(spark, folder, ids)
    return back.select(
        "doc_id", "doc_type", r6("overall_confidence").alias("overall_confidence"),
        F.size("fields").cast("long").alias("fields"),
        F.array_join("validation.failed_rules", ",").alias("failed_rules"))


def stream_session(spark: SparkSession) -> SparkSession:
    """A session of its own, whose few partitions suit the state of the small streams below."""
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", "8")
    own.conf.set("spark.sql.session.timeZone", "UTC")
    return own


#: The id of rows that only move a stream's clock.
HEARTBEAT = "#"


def two_arrivals(own: SparkSession, df: DataFrame, folder: str, first: Column, run: Callable[[], None]) -> None:
    """A table as files of a stream: the rows of the first arrival, a run, the others, another run."""
    for part in (first, ~F.coalesce(first, F.lit(False))):
        df.where(part).write.mode("append").parquet(folder)
        run()


@query
def stream_ingest(spark, sf):
    """Order documents and their replies as two streams, joined, processed and stored; the stored results.

    Documents arrive in the order of their keys, replies up to 50 minutes later, both in two arrivals: the replies of
    some documents come with the second one.
    """
    own, run = stream_session(spark), run_folder(spark, sf, f"ingest-{uuid.uuid4().hex}")
    docs = inputs.replies(spark, sf)
    clock = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("o_orderkey"))
    replied = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("o_orderkey") + (F.col("o_orderkey") % 50) * 60)
    papers = docs.select("doc_id", "source_file", "text", "ocr_quality", clock.alias("arrived"))
    answers = docs.select("doc_id", "response", "fallback_response", replied.alias("replied"))
    last = inputs.table(spark, sf, "orders", "o_orderkey").agg(F.max("o_orderkey").alias("last"))
    beat = last.select(F.lit(HEARTBEAT).alias("doc_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.coalesce("last", F.lit(0)) + 100_000).alias("t"))
    halves = F.timestamp_seconds(F.lit(1_700_000_000) + F.coalesce(last.select(F.floor(F.col("last") / 2)).scalar(), F.lit(0)))
    for name, table, time in (("documents", papers, "arrived"), ("replies", answers, "replied")):
        whole = table.unionByName(beat.select("doc_id", F.col("t").alias(time)), allowMissingColumns=True)
        whole.withColumn("early", F.col(time) < halves).write.parquet(f"{run}/{name}-all")
    for early in (True, False):
        for name in ("documents", "replies"):
            spark.read.parquet(f"{run}/{name}-all").where(F.col("early") == early).drop("early").write.mode("append").parquet(f"{run}/{name}")
        streams = [ingest.read_documents(own, f"{run}/{name}", spark.read.parquet(f"{run}/{name}").schema) for name in ("documents", "replies")]
        ingest.ingest_with_replies(*streams, f"{run}/out", f"{run}/requests", f"{run}/checkpoint", heartbeat=HEARTBEAT).awaitTermination()
    ids = T.StructType([T.StructField("doc_id", T.StringType())])
    return results_io.read_results(spark, f"{run}/out", ids).select(
        "doc_id", "doc_type", F.col("processing_metadata.extraction_method").alias("extraction_method"),
        r6("overall_confidence").alias("overall_confidence"), F.col("validation.notes").alias("notes"))


def event_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Events as entries of a batch list: a path per user, the text of the event, no replies."""
    none = F.lit(None).cast("string")
    return inputs.table(spark, sf, "events", "event_id", "event_type", "props", "user_id").select(
        F.concat(F.lit("/in/u"), F.col("user_id").cast("string")).alias("source_file"), F.col("event_id").alias("entry"),
        F.concat(F.when(F.col("event_id") % 3 == 0, "Invoice total ").when(F.col("event_id") % 3 == 1, "patient, hospital: ").otherwise(""),
                 "event_type", F.lit(" "), "props").alias("text"),
        F.lit(None).cast("double").alias("ocr_quality"), none.alias("response"), none.alias("fallback_response"))


@query
def stream_dedup(spark, sf):
    """Paths that arrive several times, within a micro-batch and across two: the result of the last entry counts."""
    own, run = stream_session(spark), run_folder(spark, sf, f"latest-{uuid.uuid4().hex}")
    entries = event_documents(spark, sf)

    def go() -> None:
        stream = ingest.read_documents(own, f"{run}/entries", entries.schema)
        ingest.ingest_latest(stream, f"{run}/out", f"{run}/checkpoint", "entry").awaitTermination()

    two_arrivals(own, entries, f"{run}/entries", F.col("entry") % 2 == 0, go)
    ids = T.StructType([T.StructField("entry", T.LongType())])
    return ingest.latest_results(spark, f"{run}/out", ids).select(
        F.col("processing_metadata.source_file").alias("path"), "entry", "doc_type", r6("overall_confidence").alias("overall_confidence"))


@query
def stream_summary(spark, sf):
    """Totals that grow with stored results, which come in two arrivals; the stored totals after the second."""
    own, run = stream_session(spark), run_folder(spark, sf, f"totals-{uuid.uuid4().hex}")
    ids = T.StructType([T.StructField("doc_id", T.StringType())])
    results_io.write_results(published(spark, sf), f"{run}/all", mode="overwrite")
    done = results_io.read_results(spark, f"{run}/all", ids)
    for number, part in enumerate((F.col("doc_id") % 2 == 0, F.col("doc_id") % 2 != 0)):
        results_io.write_results(done.where(part), f"{run}/out/batch={number}")
        stream = ingest.read_results_stream(own, f"{run}/out", ids)
        ingest.running_summary(stream, f"{run}/summary", f"{run}/checkpoint").awaitTermination()
    totals = spark.read.schema(summary.batch_summary(done).schema).json(f"{run}/summary")
    return totals.withColumns({"success_rate": r6("success_rate"), "average_confidence": r6("average_confidence")})


# --- text and pages --------------------------------------------------------------------------

@query
def clean_text(spark, sf):
    return documents(spark, sf).select("doc_id", tx.clean_text(F.col("text")).alias("text"))


@query
def truncate_text(spark, sf):
    t = F.col("text")
    return documents(spark, sf).select(
        "doc_id", tx.truncate(t, fv.ROUTING_TEXT_LIMIT, "...").alias("routing_text"),
        tx.truncate(t, fv.EXTRACTION_TEXT_LIMIT).alias("extraction_text"),
        tx.truncate(t, fv.FALLBACK_TEXT_LIMIT).alias("fallback_text"))


@query
def assemble_pages(spark, sf):
    return pages.assemble_pages(inputs.conversation_pages(spark, sf))


@query
def page_metadata(spark, sf):
    return pages.page_metadata(inputs.conversation_pages(spark, sf), "doc_id")


@query
def detect_scanned(spark, sf):
    known = documents(spark, sf).select("doc_id")
    found = pages.detect_scanned(known, inputs.layer_pages(spark, sf))
    return found.select("doc_id", r6("chars_per_page").alias("chars_per_page"), "scanned", "text_source")


def page_stats(spark: SparkSession, sf: str) -> DataFrame:
    return pages.ocr_page_stats(inputs.ocr_pages(spark, sf), inputs.ocr_tokens(spark, sf))


@query
def ocr_page_stats(spark, sf):
    return page_stats(spark, sf).withColumns({
        "avg_confidence": r6("avg_confidence"), "confidence": r6("confidence")})


@query
def ocr_page_text(spark, sf):
    return pages.ocr_page_text(inputs.ocr_pages(spark, sf), inputs.ocr_tokens(spark, sf))


@query
def ocr_quality(spark, sf):
    quality = pages.ocr_quality(page_stats(spark, sf))
    sources = pages.detect_scanned(documents(spark, sf).select("doc_id"), inputs.layer_pages(spark, sf))
    return pages.with_quality(sources, quality).select(
        "doc_id", "text_source", r6("ocr_quality").alias("ocr_quality"))


@query
def pages_to_results(spark, sf):
    """Conversations as page by page documents: text or OCR, model routing, extraction, result."""
    done = results.process_pages(
        inputs.page_documents(spark, sf), inputs.layer_pages(spark, sf), inputs.ocr_pages(spark, sf),
        inputs.ocr_tokens(spark, sf), routing_responses=inputs.page_routing(spark, sf))
    return done.select(
        "doc_id", "doc_type", r6("processing_metadata.ocr_quality").alias("ocr_quality"),
        F.col("processing_metadata.extraction_method").alias("extraction_method"),
        r6("processing_metadata.routing_confidence").alias("routing_confidence"),
        F.col("processing_metadata.field_count").alias("field_count"))


def tables(spark: SparkSession, sf: str) -> DataFrame:
    df = inputs.raw_tables(spark, sf)
    return df.withColumn("table", pages.normalised_table(F.col("raw"), F.col("page"), F.col("table_index")))


@query
def table_normalize(spark, sf):
    """Long form of normalised tables: one row per table row."""
    df = tables(spark, sf).filter(F.col("table").isNotNull())
    return df.select(
        "doc_id", F.col("table.page").alias("page"), F.array_join("table.headers", "|", "").alias("headers"),
        F.posexplode("table.rows").alias("row_num", "row"),
    ).select("doc_id", "page", "headers", F.col("row_num").cast("long").alias("row_num"),
             F.array_join("row", "|", "None").alias("row"))


@query
def table_render(spark, sf):
    listed = F.array_compact(F.array(F.col("table")))
    return tables(spark, sf).select("doc_id", requests.rendered_tables(listed).alias("tables"))


# --- patterns and similarity -----------------------------------------------------------------

@query
def extract_numbers(spark, sf):
    return long_form(order_texts(spark, sf), tx.extract_numbers(F.col("text")), "number")


@query
def extract_dates(spark, sf):
    return long_form(order_texts(spark, sf), tx.extract_dates(F.col("text")), "date")


@query
def extract_emails(spark, sf):
    return long_form(documents(spark, sf), tx.extract_emails(F.col("text")), "email")


@query
def extract_phones(spark, sf):
    """Over the replies, whose free-form records hold phone numbers."""
    df = inputs.replies(spark, sf).select("doc_id", F.col("fallback_response").alias("text"))
    return long_form(df, tx.extract_phones(F.col("text")), "phone")


@query
def char_jaccard(spark, sf):
    bench = inputs.table(spark, sf, "benchmark", "item_id", F.col("text").alias("other"))
    size = bench.select(F.count("*").alias("n")).scalar()
    pairs = documents(spark, sf).withColumn("size", size).join(bench, F.col("doc_id") % F.col("size") == F.col("item_id"))
    return pairs.select("doc_id", "item_id", r6(tx.char_jaccard(F.col("text"), F.col("other"))).alias("similarity"))


@query
def char_best_items(spark, sf):
    """For each document the benchmark item with the most similar set of characters."""
    found = similarity.best_items(documents(spark, sf), inputs.table(spark, sf, "benchmark", "item_id", "text"))
    return found.withColumn("similarity", r6("similarity"))


@query
def bbox_struct(spark, sf):
    """Boxes from embedding vectors: every fifth row has too few numbers."""
    df = inputs.table(spark, sf, "embeddings", "vec_id", "embedding")
    size = F.when(F.col("vec_id") % 5 == 0, 3).otherwise(4)
    box = tx.bbox_struct(F.slice("embedding", F.lit(1), size))
    return df.select("vec_id", box.alias("box")).select(
        "vec_id", *[r6(F.col(f"box.{n}")).alias(n) for n in ("x0", "y0", "x1", "y1")])


@query
def label_format(spark, sf):
    """Labels of all rule names that occur, counted over the documents."""
    rows = validation.rule_rows(rules_of(spark, sf), "doc_id")
    return rows.groupBy("rule").agg(F.count("*").alias("documents")).select(
        tx.label(F.col("rule")).alias("label"), "documents")


# --- routing -----------------------------------------------------------------------------------

@query
def keyword_scores(spark, sf):
    df = routing.add_keyword_scores(order_texts(spark, sf))
    return df.select("doc_id", *[F.col(f"score_{t}").cast("long").alias(t) for t in fv.DOC_TYPES],
                     F.col("words").cast("long").alias("words"))


@query
def route_keywords(spark, sf):
    df = routing.route_by_keywords(order_texts(spark, sf), prefix="")
    return df.select("doc_id", "doc_type", r6("confidence").alias("confidence"), "reasoning")


@query
def route_segments(spark, sf):
    """Keyword routing of documents given as pages: conversations and order lines."""
    paged = inputs.conversation_pages(spark, sf).select(
        F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("doc_id"), "page_num", "text")
    texts = order_texts(spark, sf).select("doc_id", F.lit(1).cast("long").alias("page_num"), "text")
    segments = pages.assemble_pages(paged.unionByName(texts))
    routed = routing.route_segments(segments, "doc_id")
    return routed.select("doc_id", F.col("keyword_doc_type").alias("doc_type"),
                         r6("keyword_confidence").alias("confidence"),
                         F.col("keyword_reasoning").alias("reasoning"))


@query
def route_model(spark, sf):
    df = routing.with_routing_reply(inputs.routing_replies(spark, sf))
    return df.select("doc_id", "reply.doc_type", r6("reply.confidence").alias("confidence"), "reply.reasoning")


@query
def route_with_fallback(spark, sf):
    df = routing.route(order_texts(spark, sf), inputs.routing_replies(spark, sf))
    return df.select("doc_id", "doc_type", r6("routing_confidence").alias("confidence"),
                     F.col("routing_reasoning").alias("reasoning"))


@query
def routing_requests(spark, sf):
    return requests.routing_requests(order_texts(spark, sf), "doc_id")


def lexicon(spark: SparkSession, sf: str) -> DataFrame:
    """A lexicon table: the keywords of the routing types."""
    rows = [(t, k, i) for i, (t, ks) in enumerate(fv.ROUTING_KEYWORDS.items()) for k in ks]
    return spark.createDataFrame(rows, "doc_type string, keyword string, priority int")


@query
def route_lexicon(spark, sf):
    return routing.route_with_lexicon(order_texts(spark, sf), lexicon(spark, sf))


@query
def route_lexicon_join(spark, sf):
    """The same by equi-join, as for a lexicon that is too large for expressions."""
    return routing.route_with_lexicon(documents(spark, sf), inputs.part_lexicon(spark, sf), limit=0)


# --- requests and replies ------------------------------------------------------------------------

@query
def extraction_requests(spark, sf):
    listed = F.array_compact(F.array(F.col("table")))
    rendered = tables(spark, sf).select("o_orderkey", requests.rendered_tables(listed).alias("tables"))
    # a type that no filter sees through: both sides then move the same lines, which Spark does once
    df = with_once(order_texts(spark, sf), {"doc_type": F.col("kind")}).drop("kind")
    # by the order key, by which both sides are partitioned already
    df = df.join(rendered, "o_orderkey", "left")
    out = requests.extraction_requests(df, "doc_id", tables="tables")
    return out.select("doc_id", "doc_type", "system", "user")


@query
def fallback_requests(spark, sf):
    df = inputs.replies(spark, sf).withColumnRenamed("kind", "doc_type")
    return requests.fallback_requests(responses.rejected(df), "doc_id")


def first_replies(spark: SparkSession, sf: str) -> DataFrame:
    """Replies with the true type; every 40th document counts as of unknown type."""
    df = inputs.replies(spark, sf, text=False)
    return df.withColumn("doc_type", F.when(F.col("o_orderkey") % 40 == 0, fv.UNKNOWN).otherwise(F.col("kind")))


@query
def parse_typed_response(spark, sf):
    df = responses.parse_typed(first_replies(spark, sf)).filter("typed_ok")
    inv, bill, rx = F.col("invoice"), F.col("medical_bill"), F.col("prescription")
    items = F.coalesce(inv.line_items, bill.line_items)
    return df.select(
        "doc_id", "doc_type",
        F.coalesce(inv.invoice_number, bill.patient_id, rx.patient_age).alias("code"),
        F.coalesce(inv["date"], bill.bill_date, rx.prescription_date).alias("date"),
        F.coalesce(inv.total_amount, bill.total_amount).alias("total_amount"),
        F.coalesce(inv.currency, bill.currency).alias("currency"),
        F.coalesce(F.size(items), F.size(rx.medicines)).cast("long").alias("items"),
        r6(F.aggregate(F.coalesce(items, F.array()), F.lit(0.0),
                       lambda a, x: a + x.total_price)).alias("item_total"))


@query
def response_rejects(spark, sf):
    return responses.rejected(first_replies(spark, sf)).select(
        "doc_id", "doc_type", F.col("case").cast("long").alias("case"))


@query
def fallback_json(spark, sf):
    """What the second reply holds between its outer braces, read key by key."""
    df = inputs.replies(spark, sf).withColumn("span", responses.braced(F.col("fallback_response")))
    df = with_once(df, {"read": freeform.read(F.col("span"))})
    data = F.try_parse_json("read.json")
    return df.filter(F.col("fallback_response").isNotNull()).select(
        "doc_id", F.col("span").isNotNull().alias("has_span"), data.isNotNull().alias("is_json"),
        F.try_variant_get(data, "$.vendor_email", "string").alias("vendor_email"),
        F.try_variant_get(data, "$.contact_phone", "string").alias("contact_phone"),
        F.try_variant_get(data, "$.extra.level", "double").alias("level"))


@query
def extraction_outcome(spark, sf):
    return responses.extract(first_replies(spark, sf)).select(
        "doc_id", "doc_type", "extraction_method", F.col("extraction_error").alias("error"))


def echo_length(batch: pd.DataFrame) -> pd.Series:
    """A stand-in for a model: replies with the length of the request."""
    return '{"doc_type": "invoice", "confidence": 0.5, "reasoning": "' + batch["user"].str.len().astype(str) + '"}'


@query
def model_apply_stub(spark, sf):
    asked = requests.routing_requests(documents(spark, sf), "doc_id")
    replies = requests.apply_model(asked, echo_length, "doc_id")
    return routing.with_routing_reply(replies).select("doc_id", "reply.doc_type", "reply.confidence", "reply.reasoning")


@query
def evidence_confidence(spark, sf):
    """How well each document's text supports the names of its own record."""
    df = inputs.records(spark, sf).select(
        "doc_id", F.lower("text").alias("lower_text"),
        F.explode(F.array_compact(F.array(
            F.col("invoice.vendor_name"), F.col("invoice.customer_address"),
            F.concat(F.col("invoice.vendor_address"), F.lit(" depot nowhere")),
            F.col("medical_bill.hospital_name"), F.col("medical_bill.doctor_name"),
            F.concat(F.lit("Doctor "), F.col("medical_bill.doctor_name")),
            F.col("prescription.clinic_address"), F.col("prescription.diagnosis")))).alias("value"))
    return df.select("doc_id", "value", r6(cf.evidence(F.col("value"), F.col("lower_text"))).alias("confidence"))


# --- fields ----------------------------------------------------------------------------------------

def leaves_of(spark: SparkSession, sf: str, doc_type: str) -> DataFrame:
    df = inputs.typed_records(spark, sf).filter(F.col("doc_type") == doc_type)
    return fields.flatten_records(df, with_freeform=False).select(
        "doc_id", F.posexplode("leaves").alias("pos", "leaf")).select(
        "doc_id", F.col("pos").cast("long").alias("pos"), "leaf.path", "leaf.key", "leaf.value",
        r6(F.col("leaf.llm_conf")).alias("llm_conf"))


@query
def flatten_invoice(spark, sf):
    return leaves_of(spark, sf, fv.INVOICE)


@query
def flatten_medical(spark, sf):
    return leaves_of(spark, sf, fv.MEDICAL_BILL)


@query
def flatten_prescription(spark, sf):
    return leaves_of(spark, sf, fv.PRESCRIPTION)


@query
def flatten_freeform(spark, sf):
    df = inputs.event_records(spark, sf).select(
        "doc_id", F.posexplode(fields.freeform_leaves(F.col("freeform"))).alias("pos", "leaf"))
    return df.select("doc_id", F.col("pos").cast("long").alias("pos"), "leaf.path", "leaf.key",
                     "leaf.value", r6(F.coalesce(
                         "leaf.llm_conf", cf.estimate(F.col("leaf.value"), F.col("leaf.falsy")))).alias("llm_conf"))


@query
def result_fields(spark, sf):
    df = with_once(published(spark, sf).select("doc_id", "fields"), {"fields": F.col("fields")})
    df = df.select("doc_id", F.explode("fields").alias("f"))
    return df.select("doc_id", "f.name", "f.value", r6("f.confidence").alias("confidence"),
                     F.col("f.source.page").cast("long").alias("page"),
                     *[F.col(f"f.source.bbox.{n}").alias(n) for n in ("x0", "y0", "x1", "y1")])


@query
def fields_long(spark, sf):
    return fields.field_rows(published(spark, sf), "doc_id").withColumn("confidence", r6("confidence"))


@query
def line_items_long(spark, sf):
    df = inputs.typed_records(spark, sf, text=False)
    items = df.withColumn("items", F.coalesce("invoice.line_items", "medical_bill.line_items"))
    return fields.element_rows(items, "items", "doc_id")


@query
def medicines_long(spark, sf):
    return fields.element_rows(inputs.typed_records(spark, sf, text=False), "prescription.medicines", "doc_id")


# --- validation -----------------------------------------------------------------------------------

def rules_of(spark: SparkSession, sf: str, doc_type: str | None = None) -> DataFrame:
    df = inputs.typed_records(spark, sf, text=False)
    if doc_type is not None:
        df = df.filter(F.col("doc_type") == doc_type)
    return validation.validate(df, freeform=False)


@query
def validate_invoice(spark, sf):
    return validation.rule_rows(rules_of(spark, sf, fv.INVOICE), "doc_id")


@query
def validate_medical(spark, sf):
    return validation.rule_rows(rules_of(spark, sf, fv.MEDICAL_BILL), "doc_id")


@query
def validate_prescription(spark, sf):
    return validation.rule_rows(rules_of(spark, sf, fv.PRESCRIPTION), "doc_id")


@query
def validation_notes(spark, sf):
    return rules_of(spark, sf).select("doc_id", "doc_type", F.col("rule_notes").alias("notes"), "overall_valid")


@query
def validation_warnings(spark, sf):
    return rules_of(spark, sf).select(
        "doc_id", F.posexplode("rule_warnings").alias("pos", "warning")).select(
        "doc_id", F.col("pos").cast("long").alias("pos"), "warning")


def _date_from(field: str) -> Callable[[validation.Record], validation.Outcome]:
    """A date must be one and lie after 1991: a cast that raises on anything else."""
    return lambda record: validation.Outcome(record.cell(field).text.cast("date") > F.lit("1991-12-31").cast("date"))


def _tax_share(record: validation.Record) -> validation.Outcome:
    """Tax over tax: raises where there is none, and warns of the amount."""
    tax, subtotal = record.cell("tax_amount").number, record.cell("subtotal").number
    share = subtotal / (tax - tax * F.when(subtotal % 2 < 1, 1.0).otherwise(0.0))
    return validation.Outcome(share < 25, F.array_compact(F.array(F.when(share >= 20, F.concat(F.lit("Low tax: "), (share - share % 1).cast("int").cast("string"))))))


#: Rules of a user's own, some of which raise on some records.
OWN_RULES = {
    fv.INVOICE: [validation.Rule("date_real", _date_from("date")), validation.Rule("tax_share_usual", _tax_share),
                 validation.Rule("vendor_name_present", validation.present("vendor_name"))],
    fv.MEDICAL_BILL: [validation.Rule("bill_date_real", _date_from("bill_date")), *validation.RULES[fv.MEDICAL_BILL]],
    fv.PRESCRIPTION: [validation.Rule("age_usual", lambda record: validation.Outcome(record.cell("patient_age").text.cast("int") < 75))],
}


@query
def validate_own_rules(spark, sf):
    """Rules that divide by zero and cast: where they raise the rule is in error, and the job goes on."""
    checked = validation.validate(inputs.typed_records(spark, sf, text=False), OWN_RULES, freeform=False)
    return checked.select("doc_id", "doc_type", F.array_join("passed_rules", ",").alias("passed"), F.array_join("failed_rules", ",").alias("failed"),
                          F.array_join("rule_warnings", ",").alias("warnings"), "overall_valid")


@query
def validate_common(spark, sf):
    """E-mail and phone rules over free-form records."""
    df = inputs.event_records(spark, sf).withColumns({
        "doc_type": F.lit(fv.UNKNOWN), "extraction_method": F.lit(fv.METHOD_FALLBACK)})
    checked = validation.validate(df, {}, {})
    return checked.select(
        "doc_id", F.array_join("passed_rules", ",").alias("passed"),
        F.array_join("failed_rules", ",").alias("failed"),
        F.array_join("rule_warnings", ",").alias("warnings"), F.col("rule_notes").alias("notes"))


@query
def validate_unreadable(spark, sf):
    """The same records, every sixth cut short: it cannot be read, which is an error of the validation as a whole."""
    cut = F.when(F.col("doc_id").cast("long") % 6 == 0, F.expr("left(freeform, length(freeform) - 2)")).otherwise(F.col("freeform"))
    df = inputs.event_records(spark, sf).withColumns({
        "freeform": cut, "doc_type": F.lit(fv.UNKNOWN), "extraction_method": F.lit(fv.METHOD_FALLBACK)})
    checked = validation.validate(df, {}, {})
    return checked.select(
        "doc_id", F.array_join("failed_rules", ",").alias("failed"), F.array_join("rule_warnings", ",").alias("warnings"),
        F.col("rule_notes").alias("notes"), "overall_valid")


@query
def structural_check(spark, sf):
    """Published results as JSON, some of them damaged, checked for their shape."""
    o = F.col("doc_id").cast("long")
    done = published(spark, sf).select("doc_id", "doc_type", "fields", "overall_confidence")
    listed = F.to_json("fields")
    odd = F.when(o % 5 == 0, '{"name": "x"}').when(o % 5 == 1, "7")
    # cut as bytes: the last one is the bracket, and no character has to be counted
    head = F.substring(F.col("_fields").cast("binary"), F.lit(1), F.octet_length("_fields") - 1).cast("string")
    more = F.when(odd.isNotNull(), F.concat(head, F.when(F.size("fields") > 0, ", ").otherwise(""), odd, F.lit("]")))
    done = with_once(done, {"_fields": listed})
    number = F.when(o % 11 == 0, F.lit("5.5")).when(o % 11 == 1, '"high"').otherwise(F.col("overall_confidence").cast("string"))
    whole = F.concat(F.lit('{"doc_type": "'), F.col("doc_type"), F.lit('", "overall_confidence": '), number,
                     F.lit(', "fields": '), F.coalesce(more, F.col("_fields")), F.lit("}"))
    record = F.when(o % 7 == 0, F.to_json(F.struct("overall_confidence"))).otherwise(whole)
    df = with_once(with_once(done, {"record": record}).select("doc_id", "record"), {"issues": validation.structural_issues(F.col("record"))})
    return df.select("doc_id", (F.size("issues") == 0).alias("is_valid"), F.array_join("issues", "; ").alias("issues"))


# --- scoring ---------------------------------------------------------------------------------------

@query
def score_fields(spark, sf):
    return scored_fields(spark, sf).select("doc_id", "pos", "path", r6("confidence").alias("confidence"))


@query
def score_custom_weights(spark, sf):
    weights = Weights(llm=2.0, ocr=1.0, validation=1.0)
    df = results.judge_records(inputs.typed_records(spark, sf), weights, freeform=False)
    return df.select("doc_id", r6("avg_field_confidence").alias("avg_field_confidence"),
                     r6("overall_confidence").alias("overall_confidence"))


@query
def score_text_match(spark, sf):
    """Field confidence with the text-match factor: names against the customer address."""
    df = inputs.records(spark, sf).select("doc_id", F.lower("text").alias("t"), "ocr_quality", F.coalesce(
        "invoice.customer_name", "medical_bill.patient_name", "prescription.patient_name").alias("value"))
    df = df.filter(F.col("value").isNotNull()).withColumn("llm", cf.evidence(F.col("value"), F.col("t")))
    score = cf.field_confidence(F.col("llm"), F.col("ocr_quality"), F.lit(None).cast("boolean"),
                                text_match=tx.char_jaccard(F.col("value"), F.col("t")))
    return df.select("doc_id", r6(score).alias("confidence"))


@query
def estimate_confidence(spark, sf):
    """Guessed confidence of names, dates, codes and amounts over several tables' columns."""
    orders = inputs.table(spark, sf, "orders", F.col("o_orderkey").cast("string").alias("id"), F.explode(F.array(
        F.date_format("o_orderdate", "yyyy-MM-dd"), tx.float_text(F.col("o_totalprice")),
        F.col("o_orderpriority"), F.col("o_orderkey").cast("string"))).alias("value"))
    people = inputs.table(spark, sf, "customer", F.col("c_name").alias("id"), F.explode(F.array(
        F.col("c_mktsegment"), F.col("c_name"), F.lit("N/A"))).alias("value"))
    texts = inputs.table(spark, sf, "documents", F.col("doc_id").cast("string").alias("id"), F.col("text").alias("value"))
    every = orders.unionByName(people).unionByName(texts)
    return every.select("id", "value", r6(cf.estimate(F.col("value"))).alias("confidence"))


@query
def field_rule_status(spark, sf):
    texts = {name: scoring.rule_text(F.col(f"{name}_rules")) for name in ("passed", "failed")}
    df = with_once(judged(spark, sf).select("doc_type", "scored", "passed_rules", "failed_rules"), texts)
    df = df.select("doc_type", "passed", "failed", F.explode("scored.key").alias("key"))
    status = scoring.rule_status(F.col("key"), F.col("passed"), F.col("failed"))
    return df.select("doc_type", "key", F.coalesce(status.cast("string"), F.lit("none")).alias("status")).groupBy(
        "doc_type", "key", "status").agg(F.count("*").alias("fields"))


@query
def score_documents(spark, sf):
    return judged(spark, sf).select(
        "doc_id", "doc_type", F.size("scored").cast("long").alias("field_count"),
        r6("avg_field_confidence").alias("avg_field_confidence"),
        scoring.critical_failures(F.col("failed_rules")).cast("long").alias("critical_failures"),
        r6("overall_confidence").alias("overall_confidence"))


@query
def scoring_metadata(spark, sf):
    """What the scores were made of; every 50th document has unknown leaves, which is a failure of scoring."""
    df = fields.flatten_records(validation.validate(inputs.typed_records(spark, sf), freeform=False), with_freeform=False)
    lost = df.withColumn("leaves", F.when(F.col("o_orderkey") % 50 != 0, F.col("leaves")))
    m = "scoring_metadata"
    return scoring.score(lost, Weights(llm=2.0, ocr=1.0, validation=1.0)).select(
        "doc_id", F.size("scored").cast("long").alias("field_count"), r6("avg_field_confidence").alias("avg_field_confidence"),
        r6("overall_confidence").alias("overall_confidence"), r6(f"{m}.ocr_quality").alias("ocr_quality"), f"{m}.extraction_method",
        f"{m}.validation_passed", f"{m}.weights_used.llm_weight", f"{m}.weights_used.ocr_weight", f"{m}.weights_used.validation_weight", f"{m}.error")


@query
def confidence_distribution(spark, sf):
    out = summary.confidence_distribution(scored_fields(spark, sf))
    return out.withColumns({c: r6(c) for c in ("min_confidence", "max_confidence", "std_deviation")})


@query
def document_distribution(spark, sf):
    df = published(spark, sf).select("doc_id", "processing_metadata.confidence_distribution")
    df = with_once(df, {"d": F.col("confidence_distribution")})
    return df.select(
        "doc_id", "d.high", "d.medium", "d.low",
        *[r6(f"d.{n}").alias(n) for n in ("min_confidence", "max_confidence", "std_deviation")])


# --- results and summaries ---------------------------------------------------------------------------

@query
def document_results(spark, sf):
    """The whole chain over documents with replies: route, extract, validate, score, publish."""
    m = "processing_metadata"
    return processed(spark, sf).select(
        "doc_id", "doc_type", F.col(f"{m}.extraction_method").alias("extraction_method"),
        F.col(f"{m}.field_count").alias("field_count"),
        F.array_join("validation.passed_rules", ",").alias("passed_rules"),
        F.array_join("validation.failed_rules", ",").alias("failed_rules"),
        F.col("validation.notes").alias("notes"),
        r6("overall_confidence").alias("overall_confidence"), F.col(f"{m}.error").alias("error"))


@query
def error_rows(spark, sf):
    return processed(spark, sf).filter(F.col("processing_metadata.error").isNotNull()).select(
        "doc_id", "doc_type", "overall_confidence",
        F.array_join("validation.failed_rules", ",").alias("failed_rules"),
        F.col("validation.notes").alias("notes"),
        F.col("processing_metadata.field_count").alias("field_count"))


@query
def batch_summary(spark, sf):
    return summary.batch_summary(processed(spark, sf)).withColumns({
        "success_rate": r6("success_rate"), "average_confidence": r6("average_confidence")})


@query
def batch_run(spark, sf):
    """A whole batch in one call; the stored summary."""
    entries = inputs.replies(spark, sf).withColumn("entry", F.col("doc_id").cast("long"))
    totals, _ = batch.run_batch(entries, run_folder(spark, sf, "batch"), "doc_id", "entry")
    return totals.withColumns({
        "success_rate": r6("success_rate"), "average_confidence": r6("average_confidence")})


@query
def doc_type_counts(spark, sf):
    """Counted right after routing: no later stage changes the type."""
    return summary.doc_type_counts(results.route_documents(order_texts(spark, sf), "doc_id"))


@query
def batch_digest(spark, sf):
    df = processed(spark, sf).withColumn("path", F.col("processing_metadata.source_file"))
    return summary.batch_digest(df, "path").withColumn("confidence", r6("confidence"))


@query
def batch_dedup(spark, sf):
    """Paths given several times: the last entry counts.  Events as a batch list, by user."""
    df = inputs.table(spark, sf, "events", "event_id", "event_type", "value",
                      F.concat(F.lit("/in/u"), F.col("user_id").cast("string")).alias("path"))
    return summary.latest(df, "path", "event_id", "event_id", "event_type", "value")


@query
def confidence_band(spark, sf):
    return judged(spark, sf).select(
        "doc_id", r6("overall_confidence").alias("confidence"),
        cf.band(r6("overall_confidence")).alias("band"))


def field_confidences(spark: SparkSession, sf: str) -> DataFrame:
    return scored_fields(spark, sf).select(r6("confidence").alias("confidence"))


@query
def band_shares(spark, sf):
    return summary.band_shares(field_confidences(spark, sf)).withColumn("share", r6("share"))


@query
def confidence_histogram(spark, sf):
    return summary.confidence_histogram(field_confidences(spark, sf))


@query
def rule_pass_rates(spark, sf):
    rows = validation.rule_rows(rules_of(spark, sf), "doc_id")
    return summary.rule_pass_rates(rows).withColumn("pass_rate", r6("pass_rate"))


@query
def overview(spark, sf):
    rounded = published(spark, sf).withColumn("overall_confidence", r6("overall_confidence"))
    return summary.overview(rounded, "doc_id")


@query
def valid_invoices(spark, sf):
    """How many invoices pass all rules, and how sure are we of them?"""
    df = judged(spark, sf).filter(F.col("doc_type") == fv.INVOICE)
    return df.groupBy("overall_valid").agg(
        F.count("*").alias("invoices"), r6(F.avg("overall_confidence")).alias("average_confidence"))
