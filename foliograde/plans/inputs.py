"""Inputs of the registered queries, derived from the given tables by joins and projections.

The tables hold orders, not paper, so each order is turned into one document: a third become
invoices, a third medical bills, a third prescriptions, with a known share of defects.  One order
is one document, however many lines it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograde import fixed_values as fv
from foliograde import schemas
from foliograde.functions import text as tx
from foliograde.functions.once import with_once


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def every(n: int, key: str = "o_orderkey") -> Column:
    return F.col(key) % n == 0


# --- orders as documents ----------------------------------------------------------------

#: Most suppliers whose names are sent to every task (about 100 bytes each); beyond it they are met by a shuffle.
BROADCAST_SUPPLIERS = 500_000


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with part, supplier and money, the money rounded to cents; partitioned by order.

    The lines are moved twice, by part and by order.  What follows from their own columns, and, if there are few
    enough of them, their suppliers, is added where the orders lie, so that it is not moved.
    """
    lines = table(
        spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    part = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_size")
    supplier = table(spark, sf_dir, "supplier", "s_suppkey", "s_name", "s_nationkey")
    few = supplier.count() <= BROADCAST_SUPPLIERS
    nation = table(spark, sf_dir, "nation", "n_nationkey", "n_name")
    supplier = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        "s_suppkey", "s_name", F.col("n_name").alias("s_nation"))
    total = tx.rounded(F.col("l_extendedprice") * (1 - F.col("l_discount")), 2)
    lines = lines.join(part, F.col("l_partkey") == F.col("p_partkey"), "left").drop("p_partkey")
    by_supplier = F.col("l_suppkey") == F.col("s_suppkey")
    if few:
        lines = lines.repartition("l_orderkey").join(F.broadcast(supplier), by_supplier, "left")
    else:
        lines = lines.join(supplier, by_supplier, "left").drop("s_suppkey").repartition("l_orderkey")
    return (
        lines.withColumn("total_price", total)
        .withColumn("unit_price", tx.rounded(F.col("l_extendedprice") / F.col("l_quantity"), 2))
        .withColumn("tax", tx.rounded(F.col("total_price") * F.col("l_tax"), 2))
    )


_LINE = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount",
         "l_tax", "p_name", "p_size", "s_name", "s_nation", "total_price", "unit_price", "tax"]


def order_documents(spark: SparkSession, sf_dir: str, notes: bool = True) -> DataFrame:
    """One row per order: the order, its customer, its lines in order and a text note.

    Everything is joined on the order key, so each input is shuffled once.  Without ``notes`` the
    documents are not read.
    """
    lines = order_lines(spark, sf_dir).groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(F.struct(*_LINE))).alias("lines"))
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    customer = table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    nation = table(spark, sf_dir, "nation", F.col("n_nationkey"), F.col("n_name").alias("c_nation"))
    orders = (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .select("o_orderkey", "o_totalprice", "o_orderdate", "c_custkey", "c_name",
                "c_mktsegment", "c_nation")
    )
    empty = F.array().cast(lines.schema["lines"].dataType)
    joined = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey")
    if notes:
        # every 9th order gets a document's text, every 5th gets one appended
        doc_id = F.col("doc_id")
        uses = F.array_compact(F.array(doc_id * 9, F.when((doc_id * 5) % 9 != 0, doc_id * 5)))
        noted = table(spark, sf_dir, "documents", "doc_id", "text").select(
            F.explode(uses).alias("n_orderkey"), F.col("text").alias("note"))
        joined = joined.join(noted, F.col("o_orderkey") == F.col("n_orderkey"), "left").drop("n_orderkey")
    joined = (
        joined.withColumn("lines", F.coalesce("lines", empty))
        .withColumn("doc_id", F.col("o_orderkey").cast("string"))
        .withColumn("kind", F.element_at(F.array(*map(F.lit, fv.DOC_TYPES)),
                                         (F.col("o_orderkey") % 3 + 1).cast("int")))
    )
    return with_once(joined, {
        "day": F.date_format("o_orderdate", "yyyy-MM-dd"),
        "vendor": F.array_min(F.transform("lines", lambda x: F.struct(x.s_name, x.s_nation, x.l_suppkey))),
        "goods": tx.rounded(F.aggregate("lines", F.lit(0.0), lambda a, x: a + x.total_price), 2),
        "tax": tx.rounded(F.aggregate("lines", F.lit(0.0), lambda a, x: a + x.tax), 2)})


def _line_items() -> Column:
    return F.transform("lines", lambda x: F.struct(
        x.p_name.alias("description"), x.l_quantity.alias("quantity"),
        x.unit_price.alias("unit_price"), x.total_price.alias("total_price"),
        F.lit(0.0).alias("confidence"))).cast(schemas.INVOICE["line_items"].dataType)


def _none_if(condition: Column, value: Column) -> Column:
    return F.when(~condition, value)


def invoice_record() -> Column:
    vendor = F.col("vendor")
    tax = _none_if(every(7), F.col("tax"))
    total = tx.rounded(F.col("goods") + F.coalesce(tax, F.lit(0.0)), 2)
    return F.struct(
        F.when(every(17), F.lit(None)).when(every(19), "   ").otherwise(
            F.concat(F.lit("INV-"), F.col("o_orderkey").cast("string"))).alias("invoice_number"),
        F.when(every(13), "n/a").otherwise(F.col("day")).alias("date"),
        F.date_format(F.date_add("o_orderdate", 30), "yyyy-MM-dd").alias("due_date"),
        _none_if(every(23), vendor.s_name).alias("vendor_name"),
        vendor.s_nation.alias("vendor_address"),
        F.col("c_name").alias("customer_name"),
        F.col("c_nation").alias("customer_address"),
        _line_items().alias("line_items"),
        (F.col("goods") + F.when(every(11), 1.0).otherwise(0.0)).alias("subtotal"),
        tax.alias("tax_amount"),
        _none_if(every(29), total + F.when(every(10), 5.0).otherwise(0.0)).alias("total_amount"),
        F.lit(fv.DEFAULT_CURRENCY).alias("currency"),
    ).cast(schemas.INVOICE)


def medical_bill_record() -> Column:
    total = F.when(every(31), -F.col("o_totalprice")).otherwise(F.col("o_totalprice"))
    paid = _none_if(every(5), tx.rounded(total * 0.25, 2))
    balance = tx.rounded(total - F.coalesce(paid, F.lit(0.0)), 2) + F.when(every(7), 1.0).otherwise(0.0)
    return F.struct(
        _none_if(every(41), F.col("c_name")).alias("patient_name"),
        F.concat(F.lit("P"), F.col("c_custkey").cast("string")).alias("patient_id"),
        _none_if(every(13), F.concat(F.lit("Hospital "), F.col("c_nation"))).alias("hospital_name"),
        F.col("c_nation").alias("hospital_address"),
        F.when(every(17), "soon").otherwise(F.col("day")).alias("bill_date"),
        F.col("day").alias("service_date"),
        F.col("vendor").s_name.alias("doctor_name"),
        _line_items().alias("line_items"),
        F.col("c_mktsegment").alias("insurance_info"),
        _none_if(every(37), total).alias("total_amount"),
        paid.alias("amount_paid"),
        _none_if(every(8), balance).alias("balance_due"),
        F.lit(fv.DEFAULT_CURRENCY).alias("currency"),
    ).cast(schemas.MEDICAL_BILL)


def prescription_record() -> Column:
    vendor = F.col("vendor")
    medicines = F.transform("lines", lambda x: F.struct(
        x.p_name.alias("name"),
        F.when(x.p_size % 7 == 0, "drops").otherwise(
            F.concat(x.p_size.cast("string"), F.lit(" mg"))).alias("dosage"),
        F.lit("twice daily").alias("frequency"),
        F.concat(x.l_quantity.cast("long").cast("string"), F.lit(" days")).alias("duration"),
        F.lit(0.0).alias("confidence")))
    return F.struct(
        _none_if(every(41), F.col("c_name")).alias("patient_name"),
        (F.col("c_custkey") % 60 + 20).cast("string").alias("patient_age"),
        F.col("c_nation").alias("patient_address"),
        _none_if(every(23), vendor.s_name).alias("doctor_name"),
        F.concat(F.lit("LIC"), vendor.l_suppkey.cast("string")).alias("doctor_license"),
        F.concat(F.lit("Clinic "), vendor.s_nation).alias("clinic_name"),
        vendor.s_nation.alias("clinic_address"),
        F.when(every(13), F.date_format("o_orderdate", "yyyy.MM.dd")).otherwise(
            F.date_format("o_orderdate", "d MMMM yyyy")).alias("prescription_date"),
        medicines.alias("medicines"),
        F.col("c_mktsegment").alias("diagnosis"),
        F.lit(None).cast("string").alias("notes"),
    ).cast(schemas.PRESCRIPTION)


def _grouped(amount: Column) -> Column:
    return F.coalesce(tx.money(amount, True), F.lit(""))


def _said(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("")) for p in parts])


def document_text() -> Column:
    """What the paper would say, with thousands separators in some of the amounts."""
    inv, bill, rx = F.col("invoice"), F.col("medical_bill"), F.col("prescription")
    rows = F.array_join(F.transform("lines", lambda x: F.concat(
        x.p_name, F.lit(" x"), x.l_quantity.cast("long").cast("string"), F.lit(" at "),
        tx.money(x.unit_price, True), F.lit(" = "),
        tx.money(x.total_price, True))), "; ")
    doses = F.array_join(F.transform(rx.medicines, lambda m: F.concat_ws(
        " ", F.lit("take"), m["name"], m.dosage, m.frequency, F.lit("for"), m.duration)), "; ")
    own = (
        F.when(F.col("kind") == fv.INVOICE, _said(
            "Invoice ", inv.invoice_number, "\nDate: ", F.col("day"), " Due: ", inv.due_date,
            "\nVendor: ", inv.vendor_name, ", ", inv.vendor_address, "\nCustomer: ", inv.customer_name,
            "\nLine items: ", rows, "\nSubtotal ", _grouped(inv.subtotal), " Tax ", _grouped(inv.tax_amount),
            "\nTotal USD ", _grouped(inv.total_amount)))
        .when(F.col("kind") == fv.MEDICAL_BILL, _said(
            bill.hospital_name, "\nHospital bill, service date ", bill.service_date,
            "\nPatient: ", bill.patient_name, " (", bill.patient_id, ")\nInsurance: ", bill.insurance_info,
            "\nTreatment: ", rows, "\nTotal ", _grouped(bill.total_amount),
            " paid ", _grouped(bill.amount_paid), " balance ", _grouped(bill.balance_due)))
        .otherwise(_said(
            "Prescription ", rx.prescription_date, "\nDoctor: ", rx.doctor_name, " ", rx.doctor_license,
            "\n", rx.clinic_name, "\nPatient: ", rx.patient_name, ", age ", rx.patient_age,
            "\nMedication: ", doses, "\nDiagnosis ", rx.diagnosis))
    )
    return F.when(every(9), F.coalesce("note", F.lit(""))).otherwise(
        F.concat_ws("\n", own, F.col("note")))


def records(spark: SparkSession, sf_dir: str, text: bool = True, notes: bool | None = None) -> DataFrame:
    """Extracted records of all three types, one struct filled per row, and their text if asked for.

    With ``notes`` but without ``text`` the ids of the documents are joined, as each gives a row, and their texts not read.
    """
    kind = F.col("kind")
    noted = text if notes is None else notes
    orders = order_documents(spark, sf_dir, noted)
    df = with_once(orders if text or not noted else orders.drop("note"), {
        "invoice": F.when(kind == fv.INVOICE, invoice_record()),
        "medical_bill": F.when(kind == fv.MEDICAL_BILL, medical_bill_record()),
        "prescription": F.when(kind == fv.PRESCRIPTION, prescription_record())})
    quality = F.when(every(4), 1.0).when(F.col("o_orderkey") % 4 == 1, F.lit(None)).otherwise(
        (F.col("o_orderkey") * 7 % 41) / 40.0)
    df = df.withColumn("ocr_quality", quality)
    if text:
        df = with_once(df, {"text": document_text()})
    return df.select("doc_id", "o_orderkey", "kind", *(["text"] if text else []), "ocr_quality", *schemas.RECORD_TYPES)


def typed_records(spark: SparkSession, sf_dir: str, text: bool = True) -> DataFrame:
    """``records`` as the judging operators take them: every record typed, none free-form."""
    return (
        records(spark, sf_dir, text).withColumnRenamed("kind", "doc_type")
        .withColumn("extraction_method", F.lit(fv.METHOD_TYPED))
        .withColumn("freeform", F.lit(None).cast("string"))
        .withColumn("routing_confidence", F.lit(1.0))
        .withColumn("source_file", F.concat(F.lit("/in/"), F.col("doc_id"), F.lit(".pdf")))
        .withColumn("error", F.lit(None).cast("string"))
    )


# --- model replies -----------------------------------------------------------------------

def case() -> Column:
    """Which of ten reply shapes a document gets."""
    return F.floor(F.col("o_orderkey") / 3) % 10


def _json(record: Column, keep_nulls: bool = True) -> Column:
    return F.to_json(record, {"ignoreNullFields": "false" if keep_nulls else "true"})


def replies(spark: SparkSession, sf_dir: str, text: bool = True) -> DataFrame:
    """Documents with a first reply and, for some shapes, a second one; without ``text`` their texts are not made.

    Shapes: 0 all keys, half of them with a key repeated, 1 null keys left out, half of them with a NaN, 2 prose around the JSON, 3 code fence, 4 null in
    place of the list, 5 a list element without its name, 6 a confidence above 1, 7 an amount
    with a thousands separator, 8 no JSON at all, 9 broken JSON.  Of the second replies every fourth holds repeated keys,
    a NaN and half surrogate pairs, or, in shape 5, two objects.
    """
    df = records(spark, sf_dir, text, notes=True).withColumn("case", case())
    record = F
    for name in schemas.RECORD_TYPES:
        brief, full = _json(F.col(name), False), _json(F.col(name))
        record = record.when(F.col("kind") == name, F.when(F.col("case") == 1, brief).otherwise(full))
    listed = F.when(F.col("kind") == fv.PRESCRIPTION, "medicines").otherwise("line_items")
    df = with_once(df, {"_full": record})
    head = F.substring("_full", F.lit(1), F.length("_full") - 1)

    def plus(tail: Column) -> Column:
        return F.concat(head, tail, F.lit("}"))

    bad_list = F.concat(F.lit('{"'), listed, F.lit('": [{"confidence": 0.5}]}'))
    over_one = F.concat(F.lit('{"'), listed, F.lit('": [{"description": "x", "name": "x", "confidence": 2.0}]}'))
    amount = F.when(F.col("kind") == fv.PRESCRIPTION, F.lit('{"patient_age": 44}')).otherwise(
        F.lit('{"total_amount": "1,500"}'))
    extras = F.concat(
        F.lit(', "vendor_email": "'), F.when(every(2), "sales@example.com").otherwise("sales at example"),
        F.lit('", "contact_phone": "'), F.when(every(5), "12").otherwise("+1 555-123-4567"),
        F.lit('", "total_amount_confidence": 0.85, "extra": {"checked": true, "codes": [1, 2], "level": 1500.0}'))
    # a NaN, half a surrogate pair and repeated keys, none of which leaves a field
    extras = F.concat(F.when(every(4), ', "vendor_email": 7').otherwise(""), extras, F.when(
        every(4), ', "odd_confidence": NaN, "half_confidence": "\\ud800", "half_confidence": "\\udc00"').otherwise(""))
    c = F.col("case")
    rest = F.substring("_full", F.lit(2), F.length("_full"))
    first = (
        F.when((c == 0) & every(2), F.concat(F.lit('{"currency": "XXX", '), rest))
        .when((c == 1) & every(2), F.concat(F.lit('{"remark": NaN, '), rest))
        .when(c.isin(0, 1), F.col("_full"))
        .when(c == 2, F.concat(F.lit("Here it is: "), F.col("_full"), F.lit(" Anything else?")))
        .when(c == 3, F.concat(F.lit("```json\n"), F.col("_full"), F.lit("\n```")))
        .when(c == 4, F.concat(F.lit('{"'), listed, F.lit('": null}')))
        .when(c == 5, bad_list).when(c == 6, over_one).when(c == 7, amount)
        .when(c == 8, "I could not read the document.")
        .otherwise('{"currency": "USD", ')
    )
    second = (
        F.when((c == 5) & every(4), 'Either {"a": "x"} or {"b": "y"}')
        .when(c.isin(2, 4, 5, 6), F.concat(F.lit("Sure: "), plus(extras), F.lit(" Done.")))
        .when(c == 7, F.concat(plus(extras)))
        .when(c == 8, "Sorry, nothing found.")
        .when(c == 9, 'Almost: {"currency": "USD", }')
    )
    return (
        with_once(df, {"response": first, "fallback_response": second})
        .withColumn("source_file", F.concat(F.lit("/in/"), F.col("doc_id"), F.lit(".pdf")))
        .drop("_full", *schemas.RECORD_TYPES)
    )


def routing_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One routing reply per order, in ten shapes; the last shape has no row at all."""
    o = F.col("o_orderkey")
    kind = F.element_at(F.array(*map(F.lit, fv.DOC_TYPES)), (o % 3 + 1).cast("int"))
    stated = ((o % 91) / 100.0).cast("string")

    def reply(confidence: Column | str, t: Column | str = kind) -> Column:
        return F.concat(F.lit('{"doc_type": "'), t if isinstance(t, Column) else F.lit(t),
                        F.lit('", "confidence": '),
                        confidence if isinstance(confidence, Column) else F.lit(confidence),
                        F.lit(', "reasoning": "seen"}'))

    c = F.floor(o / 3) % 10
    response = (
        F.when(c == 0, reply(stated)).when(c == 1, reply("0.9", "receipt")).when(c == 2, reply("1.7"))
        .when(c == 3, reply("-0.2"))
        .when(c == 4, F.concat(F.lit('{"doc_type": "'), kind, F.lit('", "reasoning": "seen"}')))
        .when(c == 5, reply("null")).when(c == 6, reply('"high"')).when(c == 7, '["invoice"]')
        .when(c == 8, '{"doc_type": "invoice", ')
    )
    return (
        table(spark, sf_dir, "orders", "o_orderkey").filter(c != 9)
        .select(o.cast("string").alias("doc_id"), response.alias("response"))
    )


# --- pages, tokens, tables, files ------------------------------------------------------------

def conversation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations", F.col("conv_id").alias("doc_id"),
                 (F.col("turn") + 1).alias("page_num"), "text")


def layer_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with their text layer; every third document is a scan without one."""
    return conversation_pages(spark, sf_dir).withColumn("text", F.when(F.col("doc_id") % 3 != 0, F.col("text")))


def page_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents the pages belong to, with replies of four shapes: typed, typed with a repeated key, free-form, none."""
    c = F.floor(F.col("doc_id") / 3) % 4
    first = (F.when(c == 0, '{"currency": "EUR"}').when(c == 1, '{"currency": 5, "currency": "EUR"}').when(c == 2, "Nothing to report."))
    return conversation_pages(spark, sf_dir).select("doc_id").distinct().select(
        "doc_id", F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("source_file"),
        first.alias("response"), F.when(c == 2, 'Sure: {"currency": "EUR", "level": 2, "none": null} as asked').alias("fallback_response"))


def page_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routing replies for the same documents, but for every fifth."""
    kind = F.element_at(F.array(*map(F.lit, fv.DOC_TYPES)), (F.col("doc_id") % 3 + 1).cast("int"))
    return page_documents(spark, sf_dir).filter("doc_id % 5 <> 0").select(
        "doc_id", F.concat(F.lit('{"doc_type": "'), kind, F.lit('", "confidence": 0.75, "reasoning": "seen"}')).alias("response"))


def ocr_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as the OCR step leaves them; some have failed."""
    failed = (F.col("doc_id") * 7 + F.col("page_num")) % 23 == 0
    return conversation_pages(spark, sf_dir).select(
        "doc_id", "page_num", F.when(failed, "engine timeout").alias("error"))


def ocr_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = conversation_pages(spark, sf_dir).select(
        "doc_id", "page_num", F.posexplode(F.split("text", " ")).alias("pos", "word"))
    return split.withColumn("conf", (F.length("word") * 37 + F.col("pos") * 13) % 111 - 10)


def raw_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order a raw table: a header row and a row per line; nothing for orders without lines."""
    header = F.array(F.when(every(17), F.lit(None)).otherwise(F.lit("item")), F.lit("qty"), F.lit("total"))
    body = F.transform("lines", lambda x: F.array(
        F.when(x.p_size % 11 != 0, x.p_name), x.l_quantity.cast("long").cast("string"),
        tx.money(x.total_price)))
    raw = F.when(F.size("lines") > 0, F.concat(F.array(header), body)).otherwise(
        F.array().cast("array<array<string>>"))
    return order_documents(spark, sf_dir, notes=False).select(
        "doc_id", F.col("o_orderkey"), (F.col("o_orderkey") % 3 + 1).cast("int").alias("page"),
        F.lit(0).alias("table_index"), raw.alias("raw"))


FILE_EXTENSIONS = [".pdf", ".PNG", ".jpeg", ".tif", ".docx", ""]


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file list: one path per web page, with the length of its content."""
    ext = F.element_at(F.array(*map(F.lit, FILE_EXTENSIONS)),
                       (F.col("page_id") % len(FILE_EXTENSIONS) + 1).cast("int"))
    return table(spark, sf_dir, "pages", "page_id", "html").select(
        F.concat(F.lit("/in/page.v"), F.col("page_id").cast("string"), ext).alias("path"),
        (F.length("html").cast("long") * 3001).alias("length"), "page_id")


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free-form records: event properties, with contact data and stated confidences added."""
    e = F.col("event_id")
    mail = F.when(e % 3 == 0, "user@example.org").when(e % 3 == 1, "user at example").otherwise("")
    phone = F.when(e % 4 == 0, "(555) 123-4567").when(e % 4 == 1, "12-34").otherwise("")
    json_text = F.concat(
        F.substring("props", F.lit(1), F.length("props") - 1),
        F.lit(', "k_confidence": '), ((e % 100) / 100.0).cast("string"),
        F.lit(', "kind": "'), F.col("event_type"), F.lit('", "kindConfidence": 0.25, "email": "'), mail,
        F.lit('", "phone": "'), phone, F.lit('", "empty": null, "inner": {"user": "u'),
        F.col("user_id").cast("string"), F.lit('", "seen": true, "list": [{"n": '),
        (e % 7).cast("string"), F.lit('}, 5]}}'))
    return table(spark, sf_dir, "events", "event_id", "event_type", "user_id", "props").select(
        e.cast("string").alias("doc_id"), json_text.alias("freeform"))


def part_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lexicon table derived from the nations and part names: word beginnings as keywords."""
    names = table(spark, sf_dir, "part", F.explode(F.split("p_name", " ")).alias("w"))
    return names.select(
        F.concat(F.lit("kind_"), F.substring("w", 1, 1)).alias("doc_type"),
        F.lower(F.substring("w", 1, 3)).alias("keyword"),
        F.ascii("w").alias("priority")).distinct()
