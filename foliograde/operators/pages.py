"""From pages and OCR tokens to document text and quality.

Pages come as rows ``(doc_id, page_num, text)`` with pages numbered from 1, tokens as rows
``(doc_id, page_num, pos, word, conf)``.  A document is one row and a page is one row, whatever
their size.  Who only searches huge documents can ask for bounded pieces instead: a *part* is a
run of tokens of one page, a *segment* a run of pages of one document, in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograde import fixed_values as fv
from foliograde.functions import text as tx


def _piece(position: Column, size: int | None) -> Column:
    return F.lit(0).cast("long") if size is None else (position / size).cast("long")


def in_order(text: str, between: str, *order: str) -> Column:
    """Aggregate: the texts of a group in order, ties by the text itself, joined; null if there are none."""
    keys = ", ".join(f"`{name}`" for name in (*order, text))
    return F.expr(f"listagg(`{text}`, '{between}') WITHIN GROUP (ORDER BY {keys})")


def page_piece(page_num: Column, text: Column) -> Column:
    """One page as it appears in the cleaned document text, ending in a blank.

    Each page starts and ends with a line break, so cleaning page by page and joining
    gives the same text as joining and cleaning.
    """
    return tx.clean_fragment(F.concat(
        F.lit("--- Page "), page_num.cast("string"), F.lit(" ---\n"),
        F.coalesce(text, F.lit("")), F.lit("\n")))


def assemble_pages(pages: DataFrame, doc_id: str = "doc_id",
                   pages_per_segment: int | None = None) -> DataFrame:
    """Document text from pages: one row per document, or per document and segment if asked for.

    The segments of a document in order, each followed by ``tail_blanks`` blanks, are the
    cleaned text of the whole document (blanks at its very end are cut off).
    """
    pieces = pages.select(
        doc_id, _piece(F.col("page_num") - 1, pages_per_segment).alias("segment"),
        "page_num", page_piece(F.col("page_num"), F.col("text")).alias("piece"))
    # the one segment of a document is no part of the key, so that later steps by document need no other shuffle
    keys, one = ([doc_id, "segment"], "segment") if pages_per_segment is not None else ([doc_id], _piece(F.lit(0), None).alias("segment"))
    joined = pieces.groupBy(*keys).agg(F.count("*").alias("pages"), in_order("piece", "", "page_num").alias("_t")).select(doc_id, one, "pages", "_t")
    return joined.select(
        doc_id, "segment", "pages", F.rtrim("_t").alias("text"),
        (F.length("_t") - F.length(F.rtrim("_t"))).cast("long").alias("tail_blanks"))


def page_metadata(pages: DataFrame, *ids: str) -> DataFrame:
    return pages.select(
        *ids, "page_num", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("text_length"),
        tx.word_count(F.col("text")).cast("long").alias("word_count"))


def detect_scanned(documents: DataFrame, pages: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Whether a document has so little text on its first pages that it needs OCR.

    Only the first three pages are read, which the filter pushes into the scan; a document
    without pages counts as scanned.
    """
    first = pages.filter(F.col("page_num").between(1, fv.SCAN_CHECK_PAGES)).groupBy(doc_id).agg(
        F.sort_array(F.collect_list(F.struct("page_num", F.coalesce("text", F.lit("")).alias("t")))).alias("_ps"))
    density = first.select(doc_id, (
        F.length(tx.clean_text(F.array_join(F.col("_ps.t"), ""))) / F.size("_ps")).alias("chars_per_page"))
    out = documents.select(doc_id).join(density, doc_id, "left")
    scanned = F.coalesce(F.col("chars_per_page") < fv.SCAN_CHARS_PER_PAGE, F.lit(True))
    return out.select(doc_id, "chars_per_page", scanned.alias("scanned"),
                      F.when(scanned, "ocr").otherwise("text").alias("text_source"))


def _usable_tokens(tokens: DataFrame) -> DataFrame:
    return tokens.filter(tx.has_text(F.col("word")))


def ocr_page_stats(pages: DataFrame, tokens: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Words, text length and confidence of each OCR page, by partial aggregation.

    ``pages(doc_id, page_num, error)`` lists the pages; a page with an error has no words.
    """
    stats = _usable_tokens(tokens).groupBy(doc_id, "page_num").agg(
        F.count("*").alias("n"),
        F.sum(F.length("word")).alias("chars"),
        F.sum(F.when(F.col("conf") > 0, F.col("conf"))).alias("conf_sum"),
        F.count(F.when(F.col("conf") > 0, 1)).alias("conf_n"))
    read = F.col("error").isNull() & F.col("n").isNotNull()
    mean = F.when(read & (F.col("conf_n") > 0), F.col("conf_sum") / F.col("conf_n")).otherwise(0.0)
    return pages.select(doc_id, "page_num", "error").join(stats, [doc_id, "page_num"], "left").select(
        doc_id, "page_num",
        F.when(read, F.col("n")).otherwise(0).cast("long").alias("word_count"),
        F.when(read, F.col("chars") + F.col("n") - 1).otherwise(0).cast("long").alias("text_length"),
        mean.alias("avg_confidence"), (mean / 100.0).alias("confidence"), "error")


def ocr_page_text(pages: DataFrame, tokens: DataFrame, doc_id: str = "doc_id",
                  tokens_per_part: int | None = None) -> DataFrame:
    """Text of each OCR page from its words: one row per page, or per page and part if asked for.

    Parts are joined with a blank.  A page with an error has a note in place of text; a page
    without words has empty text.
    """
    parts = _usable_tokens(tokens).groupBy(
        doc_id, "page_num", _piece(F.col("pos"), tokens_per_part).alias("part"),
    ).agg(in_order("word", " ", "pos").alias("text"))
    failed = tx.filled(fv.OCR_FAILED_PAGE, error=F.col("error"))
    good = pages.filter(F.col("error").isNull()).select(doc_id, "page_num").join(
        parts, [doc_id, "page_num"], "left")
    bad = pages.filter(F.col("error").isNotNull()).select(
        doc_id, "page_num", F.lit(0).cast("long").alias("part"), failed.alias("text"))
    return good.select(doc_id, "page_num", F.coalesce("part", F.lit(0)).alias("part"),
                       F.coalesce("text", F.lit("")).alias("text")).unionByName(bad)


def ocr_quality(page_stats: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Mean page confidence per document, pages without confidence counting as 0."""
    return page_stats.groupBy(doc_id).agg(
        (F.sum(F.when(F.col("confidence") > 0, F.col("confidence")).otherwise(0.0))
         / F.count("*")).alias("ocr_quality"))


def with_quality(documents: DataFrame, quality: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Add ``ocr_quality``: 1 for a text layer, the measured value for OCR, else the default."""
    return documents.join(quality, doc_id, "left").withColumn("ocr_quality", F.when(
        F.col("text_source") == "text", fv.TEXT_LAYER_QUALITY).otherwise(
        F.coalesce("ocr_quality", F.lit(fv.DEFAULT_OCR_QUALITY))))


def document_texts(documents: DataFrame, layer: DataFrame, ocr_pages: DataFrame, tokens: DataFrame,
                   doc_id: str = "doc_id") -> DataFrame:
    """Text and quality of each document by the path the scan check chooses.

    Pages of the text layer where there is enough of it, else the OCR pages; put together to one
    ``text`` per document, with ``text_source`` and ``ocr_quality``.
    """
    sources = detect_scanned(documents, layer, doc_id)
    read = ocr_page_text(ocr_pages, tokens, doc_id).select(doc_id, "page_num", "text")
    scanned = sources.filter("scanned").select(doc_id)
    chosen = layer.select(doc_id, "page_num", "text").join(scanned, doc_id, "left_anti").unionByName(
        read.join(scanned, doc_id, "left_semi"))
    quality = ocr_quality(ocr_page_stats(ocr_pages, tokens, doc_id), doc_id)
    return with_quality(sources, quality, doc_id).select(doc_id, "text_source", "ocr_quality").join(
        assemble_pages(chosen, doc_id).select(doc_id, "text"), doc_id, "left")


def normalised_table(raw: Column, page: Column, index: Column) -> Column:
    """A raw table as ``struct<page, table_index, headers, rows>``; null if it has no rows."""
    return F.when(F.size(raw) > 0, F.struct(
        page.alias("page"), index.alias("table_index"), F.get(raw, 0).alias("headers"),
        F.slice(raw, F.lit(2), F.greatest(F.size(raw) - 1, F.lit(0))).alias("rows")))
