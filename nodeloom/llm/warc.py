"""WARC archives: revisit resolution, deduplicated writing, reading back.

Only headers (id, digest, length) are shuffled by payload digest. The smallest
id of each digest becomes the response; the others are joined to it and become
revisit records, whose payload isn't written. What was found meets the pages
again by id and digest, which moves each payload once unless the revisits are
few. Archives hold one gzip member per record, so that readers can seek, and
are closed once they reach a number of bytes. Spark's text writer puts them
on any file system that it knows, a row per file; the zero byte that it ends a
file with counts as padding to readers of gzip. Records are read back by their
Content-Length, so payloads may hold anything, even WARC headers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, stored

END = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
TEXTS = ("record_type", "record_id", "refers_to_id", "target_uri", "header_digest", "payload_digest")
RECORD = T.StructType([T.StructField("page_id", T.LongType()), *(T.StructField(x, T.StringType()) for x in TEXTS), T.StructField("payload_bytes", T.LongType())])


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1 of binary data: 20 bits, five hex and four base32 digits, at a time."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def urn(page_id: Column, url: Column, digest: Column) -> Column:
    """A record's id: rows of one id and url with different payloads are different records."""
    h = F.md5(F.concat_ws(" ", page_id.cast("string"), url, digest))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, digest, bytes, and for revisits first_id and first_url, the response that they refer to.

    Of equal payloads of min_bytes or more, the smallest page_id is the
    response, as is each row that repeats that id; null ids come last.
    """
    full = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    full = full.withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("digest", base32_sha1(F.col("payload").cast("binary")))
    headers = full.select("page_id", "url", "digest", "bytes").where(F.col("bytes") >= min_bytes)
    # A struct keeps rows whose id is null from being passed over.
    firsts = headers.groupBy("digest").agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")).alias("first"), F.count("*").alias("n"))
    firsts = firsts.where("n > 1").select("digest", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"))
    revisits = headers.join(firsts, "digest").where(~F.col("page_id").eqNullSafe(F.col("first_id")))
    revisits = revisits.select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "first_id", "first_url").distinct()
    return full.join(revisits, full["page_id"].eqNullSafe(revisits["p"]) & (full["digest"] == revisits["d"]), "left").drop("p", "d")


def write_archives(resolved: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", file_bytes: int = 16_000_000, level: int = 6) -> None:
    """Writes a response or revisit record per row of with_revisits(), each under fresh headers, to files of about file_bytes."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(END))
    clean = lambda url: F.regexp_replace(url, r"[\r\n]", "%0A")
    revisit = F.col("first_id").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("bytes").cast("string"), F.lit(END * 2))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    head = F.concat(
        F.lit(f"WARC/1.1{END}"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn(F.col("page_id"), F.col("url"), F.col("digest"))),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", clean(F.col("url"))), F.lit("")),
        F.coalesce(line("X-Page-ID", F.col("page_id").cast("string")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", urn(F.col("first_id"), F.col("first_url"), F.col("digest"))), F.coalesce(line("WARC-Refers-To-Target-URI", clean(F.col("first_url"))), F.lit("")))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
    )
    value = F.concat(head, line("Content-Length", F.octet_length(F.col("block")).cast("string")), F.lit(END), F.col("block"), F.lit(END * 2))

    def members(batches):
        import zlib

        import pyarrow as pa

        held, size = [], 0
        for batch in slices(batches):
            for record in batch.column(0):
                coder = zlib.compressobj(level, zlib.DEFLATED, 31)
                held.append(coder.compress(record.as_buffer()) + coder.flush())
                size += len(held[-1])
                if size >= file_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["file"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["file"])

    files = resolved.withColumn("block", block).select(value.alias("value")).mapInArrow(members, "file binary")
    files.select(F.col("file").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).option("compression", "none").text(path)


def unpacked(content):
    """The content of one gzip member after another, or all of it if it isn't packed. What a damaged member gives before the damage counts."""
    import zlib

    view, at = memoryview(content).cast("B"), 0
    if view[:2] != b"\x1f\x8b":
        yield bytes(view)
        return
    while view[at : at + 2] == b"\x1f\x8b":
        coder, parts = zlib.decompressobj(31), []
        try:
            while not coder.eof and at < len(view):
                parts.append(coder.decompress(view[at : at + 65536]))
                at += min(65536, len(view) - at)
            at -= len(coder.unused_data)
        except zlib.error:
            at = len(view)
        yield b"".join(parts)


def parse(content):
    """(headers with lower-case names, block) of each record.

    A record that is cut off, in its headers or its block, ends the reading; one
    without a valid Content-Length is left out, and reading goes on behind its
    headers.
    """
    for part in unpacked(content):
        view, at = memoryview(part), 0
        while (start := part.find(b"WARC/", at)) >= 0:
            stop = part.find(b"\r\n\r\n", start)
            if stop < 0:
                break
            fields = (x.partition(b":") for x in part[start:stop].split(b"\r\n")[1:])
            headers = {k.strip().lower().decode("utf-8", "replace"): v.strip().decode("utf-8", "replace") for k, _, v in fields}
            size = headers.get("content-length", "")
            at = stop + 4
            if not (size.isascii() and size.isdigit()):
                continue
            at += int(size)
            if at > len(part):
                break
            yield headers, view[stop + 4 : at]


def payload_of(headers: dict[str, str], block) -> memoryview:
    """What follows the HTTP headers of a block, however long these are; nothing if they never end. A block that isn't HTTP is its own payload."""
    view = memoryview(block)
    if headers.get("content-type", "").startswith("application/http") or view[:5] == b"HTTP/":
        stop = bytes(view).find(b"\r\n\r\n")
        return view[stop + 4 :] if stop >= 0 else view[:0]
    return view


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row of RECORD per record. payload_digest and payload_bytes are of the payload that the record itself holds."""

    def run(batches):
        import base64
        import hashlib

        import pyarrow as pa

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(RECORD), (pa.int64(), *[pa.string()] * 6, pa.int64()))], names=RECORD.names)

        for batch in batches:
            for content in batch.column(0):
                rows = []
                for h, block in parse(content.as_buffer()):
                    payload = payload_of(h, block)
                    page = h.get("x-page-id")
                    rows.append((page and int(page), h.get("warc-type"), h.get("warc-record-id"), h.get("warc-refers-to"), h.get("warc-target-uri"), h.get("warc-payload-digest", "").removeprefix("sha1:"), base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)))
                    if len(rows) == 4096:
                        yield out(rows)
                        rows = []
                yield out(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def resolve(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to per record, with revisits joined to the response that they name."""
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    first = records.where("record_type = 'response'").groupBy(F.col("record_id").alias("named_id")).agg(*(F.min(c).alias(f"first_{c}") for c in ("page_id", "payload_bytes")))
    revisits = records.where("record_type = 'revisit'").join(first, F.col("refers_to_id") == F.col("named_id"), "left")
    revisits = revisits.select("page_id", F.col("first_payload_bytes").alias("payload_bytes"), F.col("header_digest").alias("payload_digest"), "record_type", F.col("first_page_id").alias("refers_to"))
    return records.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long")).select(*columns).unionByName(revisits)


def archive(pages: DataFrame, path: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes pages to deduplicated archives under path and returns what reading them back, once, gives.

    Null payloads are empty; texts may be of any length; null urls have no target header; repeated rows
    give repeated records; rows whose id is null are written without a page
    header, and are responses if nothing equal has an id; an empty table
    writes empty archives. Other columns are ignored.
    """
    chosen = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    write_archives(with_revisits(chosen, min_bytes), path)
    return resolve(stored(read_archives(pages.sparkSession, path), "records"))
