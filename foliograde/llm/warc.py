"""Pages as WARC archives, read back through an index in the order of URL and time.

Archives are written by Spark, a record per page: ``response`` with the payload, or ``revisit`` that refers to the
response with the same payload.  Reading one archive gives a run, the captures of that archive sorted by URL key,
timestamp and page.  Runs are cut at common splitting keys, and each range of keys is merged from the pieces of all runs
by a loser tree; the ranges follow each other, so the whole index is in order.  A URL with any number of captures may
fall into several ranges, since timestamp and page are part of the key.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograde.llm.common import saved
from foliograde.session import shared_folder

#: Payloads from this size on are stored once.
LEAST_SHARED = 1000
RECORDS_PER_ARCHIVE, CAPTURES_PER_RANGE, SAMPLED_KEYS = 10_000, 50_000, 10_000
#: Most repeated payloads whose table is broadcast (about 70 bytes each).
BROADCAST_PAYLOADS = 400_000
END_OF_RECORD = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
NAME = "urn:foliograde:page:"


def url_key(url: Column) -> Column:
    """The host from right to left, then path and query: ``com,example,blog)/a?b``."""
    url = F.coalesce(url, F.lit(""))
    host = F.regexp_replace(F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1)), "^www\\.", "")
    path = F.regexp_extract(url, "^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^#]*)", 1)
    key = F.concat(F.array_join(F.reverse(F.split(host, "\\.")), ","), F.lit(")"), F.when(path == "", "/").otherwise(path))
    return F.regexp_replace(key, "[\\x00-\\x20]", "%20")


def captured_at(page_id: Column) -> Column:
    """A time of capture for tables without one: seconds from 2000 on, by the page's number."""
    return F.timestamp_seconds(F.lit(946_684_800) + F.coalesce(F.pmod(page_id, F.lit(1_000_000_000)), F.lit(0)))


def _sort_key() -> Column:
    """Strings that sort as URL key, timestamp, page."""
    number = F.coalesce(F.col("page_id"), F.lit(-(2**63)))
    signed = F.lpad(F.hex(number.bitwiseXOR(F.lit(-(2**63)))), 16, "0")
    return F.concat(F.col("url_key"), F.lit("\x00"), F.col("stamp"), F.lit("\x00"), signed)


def _payloads(pages: DataFrame, captured: Column) -> DataFrame:
    body = F.coalesce(pages["html"].cast("binary"), F.lit("").cast("binary"))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", body.alias("body"), F.sha1(body).alias("digest"), F.octet_length(body).cast("long").alias("bytes"),
        url_key(pages["url"]).alias("url_key"), F.date_format(captured, "yyyyMMddHHmmss").alias("stamp"), F.date_format(captured, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"))


def write_archives(pages: DataFrame, captured: Column) -> str:
    """Write a record per row of ``pages`` and give the folder of the archives."""
    spark = pages.sparkSession
    rows = _payloads(pages, captured)
    shared = saved(
        rows.where(F.col("bytes") >= LEAST_SHARED).groupBy("digest", "bytes").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1").drop("n"), "payloads")
    shared = F.broadcast(shared) if shared.count() <= BROADCAST_PAYLOADS else shared
    rows = rows.join(shared, ["digest", "bytes"], "left").withColumn("again", F.coalesce(~F.col("page_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull(), F.lit(False)))
    target = F.regexp_replace(F.coalesce("url", F.lit("")), "[\\x00-\\x20]", "%20")
    name = lambda page: F.concat(F.lit(f"<{NAME}"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">"))
    block = F.concat(F.lit(HTTP).cast("binary"), F.when(F.col("again"), F.lit("").cast("binary")).otherwise(F.col("body")))
    fields = [
        ("WARC-Type", F.when(F.col("again"), "revisit").otherwise("response")), ("WARC-Record-ID", name(F.col("page_id"))),
        ("WARC-Date", F.col("date")), ("WARC-Target-URI", target), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        ("X-Payload-Length", F.col("bytes").cast("string")), ("X-URL-Key", F.col("url_key")), ("X-Sort-Key", F.hex(_sort_key().cast("binary"))),
        ("WARC-Refers-To", F.when(F.col("again"), name(F.col("first")))),
        ("WARC-Profile", F.when(F.col("again"), "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")),
        ("Content-Type", F.lit("application/http; msgtype=response")), ("Content-Length", F.octet_length(block).cast("string")),
    ]
    lines = [F.coalesce(F.concat(F.lit(f"{field}: "), value, F.lit("\r\n")), F.lit("")) for field, value in fields]
    record = F.concat(F.concat(F.lit("WARC/1.0\r\n"), *lines, F.lit("\r\n")).cast("binary"), block).cast("string")
    folder = f"{shared_folder(spark)}/llm/{spark.sparkContext.applicationId}/warc-{uuid.uuid4().hex}"
    rows.select(record.alias("value")).write.option("lineSep", END_OF_RECORD).option("compression", "gzip").option(
        "maxRecordsPerFile", RECORDS_PER_ARCHIVE).text(folder)
    return folder


def records(archive: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset (in the unpacked archive), header fields and block of each record; unpacks as it goes."""
    unpacker = zlib.decompressobj(31)
    held, at, fed = b"", 0, 0

    def more() -> bool:
        nonlocal held, fed, unpacker
        if fed >= len(archive):
            return False
        held += unpacker.decompress(archive[fed:fed + (1 << 18)])
        fed += 1 << 18
        return True

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                return
        head, *lines = held[:end].decode("utf-8", "replace").split("\r\n")
        if not head.startswith("WARC/"):
            raise ValueError("not the start of a WARC record")
        fields = dict(line.split(": ", 1) for line in lines)
        size = int(fields["Content-Length"])
        while len(held) < end + 4 + size + 4 and more():
            pass
        yield at, fields, held[end + 4:end + 4 + size]
        at += end + 8 + size
        held = held[end + 8 + size:]


class LoserTree:
    """Merge of k sorted lists: each step replays one path of the tree, log2 k comparisons.

    ``tree[0]`` is the list with the least head; every inner node keeps the loser of its two sides.
    """

    def __init__(self, lists: list[list]):
        self.lists, self.at = lists, [0] * len(lists)
        self.tree = [-1] * len(lists)
        for i in range(len(lists)):
            self._play(i, building=True)

    def _less(self, a: int, b: int) -> bool:
        done_a, done_b = self.at[a] >= len(self.lists[a]), self.at[b] >= len(self.lists[b])
        if done_a or done_b:
            return done_b and not done_a
        return self.lists[a][self.at[a]] < self.lists[b][self.at[b]]

    def _play(self, i: int, building: bool = False) -> None:
        node = (i + len(self.lists)) // 2
        while node:
            other = self.tree[node]
            if other < 0:
                if building:
                    self.tree[node] = i
                    return
            elif self._less(other, i):
                self.tree[node], i = i, other
            node //= 2
        self.tree[0] = i

    def __iter__(self):
        while self.lists and self.at[self.tree[0]] < len(self.lists[self.tree[0]]):
            i = self.tree[0]
            yield self.lists[i][self.at[i]]
            self.at[i] += 1
            self._play(i)


_ENTRY = pa.struct([
    ("sort_key", pa.binary()), ("url_key", pa.string()), ("date", pa.string()), ("page_id", pa.int64()), ("url", pa.string()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
    ("archive", pa.string()), ("offset", pa.int64())])
_ENTRY_DDL = ("sort_key binary, url_key string, date string, page_id long, url string, payload_bytes long, payload_digest string, "
              "record_type string, refers_to long, archive string, offset long")


def _page_of(name: str) -> int | None:
    number = name.strip("<>").removeprefix(NAME)
    return int(number) if number else None


def _entry(path: str, at: int, fields: dict[str, str], block: bytes) -> dict:
    again = fields["WARC-Type"] == "revisit"
    payload = block.split(b"\r\n\r\n", 1)[1]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:") if again else hashlib.sha1(payload).hexdigest()
    if f"sha1:{digest}" != fields["WARC-Payload-Digest"]:
        raise ValueError(f"damaged record at {at} of {path}")
    return {
        "sort_key": bytes.fromhex(fields["X-Sort-Key"]), "url_key": fields["X-URL-Key"], "date": fields["WARC-Date"],
        "page_id": _page_of(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"],
        "payload_bytes": int(fields["X-Payload-Length"]) if again else len(payload), "payload_digest": digest,
        "record_type": "revisit" if again else "response", "refers_to": _page_of(fields["WARC-Refers-To"]) if again else None,
        "archive": path, "offset": at}


def captures(pages: DataFrame, folder: str, captured: Column) -> DataFrame:
    """The index of the archives in ``folder``, in order by (range, place): all fields of every capture."""
    spark = pages.sparkSession
    keys = pages.select(F.col("page_id").cast("long").alias("page_id"), url_key(pages["url"]).alias("url_key"), F.date_format(captured, "yyyyMMddHHmmss").alias("stamp"))
    keys = keys.select(_sort_key().cast("binary").alias("key"))
    ranges = max(1, -(-keys.count() // CAPTURES_PER_RANGE))
    sample = sorted(bytes(r.key) for r in keys.orderBy(F.xxhash64("key"), "key").limit(SAMPLED_KEYS).collect()) if ranges > 1 else []
    splits = [sample[len(sample) * i // ranges] for i in range(1, ranges)] if sample else []

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                run = sorted((_entry(path, *record) for record in records(content.as_py())), key=lambda e: e["sort_key"])
                pieces: list[list[dict]] = [[] for _ in range(len(splits) + 1)]
                i = 0
                for entry in run:
                    while i < len(splits) and entry["sort_key"] >= splits[i]:
                        i += 1
                    pieces[i].append(entry)
                for i, piece in enumerate(pieces):
                    if piece:
                        yield pa.record_batch([pa.array([i], pa.int32()), pa.array([piece], pa.list_(_ENTRY))], names=["range", "piece"])

    def merge(pieces: pa.Table) -> pa.Table:
        lists = [[(e["sort_key"], e["archive"], e["offset"], e) for e in piece] for piece in pieces.column("piece").to_pylist()]
        merged = [e for *_, e in LoserTree(lists)]
        table = pa.Table.from_pylist(merged, schema=pa.schema(list(_ENTRY)))
        number = pa.array([pieces.column("range")[0].as_py()] * len(merged), pa.int32())
        return table.add_column(0, "range", number).add_column(1, "place", pa.array(range(len(merged)), pa.int64()))

    archives = spark.read.format("binaryFile").load(folder).select("path", "content")
    found = archives.mapInArrow(runs, f"range int, piece array<struct<{', '.join(f'{f.name}:{_DDL[f.name]}' for f in _ENTRY)}>>")
    return found.groupBy("range").applyInArrow(merge, f"range int, place long, {_ENTRY_DDL}")


_DDL = dict(field.split(" ") for field in _ENTRY_DDL.split(", "))


def archived(pages: DataFrame, captured: Column | None = None) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives, read them back and give their index; see ``captures``.

    Of rows with equal payloads of at least 1000 bytes those with the largest page_id are responses, the others
    revisits that refer to it; smaller ones are all responses.  Null html is an empty payload, a null url an empty
    target; a row without page_id has a record name without number and can't be referred to: where no row of a
    payload has an id, all are responses.  Rows that are repeated have a record each.  No pages, no captures.
    """
    captured = captured_at(F.col("page_id")) if captured is None else captured
    folder = write_archives(pages, captured)
    return captures(pages, folder, captured)
