"""WARC archives: writing captures, reading records back, and assembling transactions.

A capture is three records: its request, its response (or a revisit of an equal payload) and its metadata. Request and
metadata name the response in WARC-Concurrent-To. Every record is a gzip member of its own and every file, named
.warc.gz, begins with a warcinfo record. A task compresses records until a file's worth of bytes is together; Spark's
text sink writes such a row as a file (a gzip member's last byte is the highest of its length, zero below 16 MB: the
sink's line separator supplies it). Files are bounded by bytes, a longer record stands alone; they are read as whole
files, decompressed and parsed as a stream. Assembly joins records by the identifier they are concurrent to and emits
one nested row per capture; a revisit's payload is looked up at the response it refers to.

Joins with a table that has one row a digest or response leave it to adaptive execution to split partitions that a
payload of very many pages has swollen.

Among captures with equal payloads of at least `least` bytes that with the largest id is the response, of repeated
rows one. Null payloads are empty; null addresses become urn:page. Captures with a null id are responses of their own.
An empty table gives an empty result. Payloads may hold anything and be of any length, also text that looks like a
record: lengths rule. A file that ends within a record is an error. Only the three columns named are read, so others
can't clash.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialise, named, remove, shared_dir

LEAST, FILE_BYTES, LEVEL = 1000, 8 << 20, 5
DATE = "2024-01-01T00:00:00Z"  # the pages carry no date of their own


def _urn(*parts: Column | str) -> Column:
    h = F.md5(F.concat_ws("\x1f", *[p if isinstance(p, Column) else F.lit(p) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)), F.lit(">"))


def _record(kind: str | Column, urn: Column, headers: list[tuple[str, Column]], content: str, block: Column) -> Column:
    """One record; headers that are null are left out."""
    line = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind if isinstance(kind, Column) else F.lit(kind)), F.concat(F.lit("WARC-Record-ID: "), urn), F.lit(f"WARC-Date: {DATE}")]
    line += [F.concat(F.lit(f"{name}: "), value) for name, value in headers]
    line += [F.lit(f"Content-Type: {content}"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws("\r\n", *line), F.lit("\r\n\r\n"), block, F.lit("\r\n\r\n"))


def planned(pages: DataFrame, least: int) -> DataFrame:
    """pages (id, url, payload) with `digest`, `head` (id of the response with the same payload, null for a response) and
    `turn` (which of the rows of one id and payload); lookups are written tables.
    """
    rows = pages.select("id", "url", F.coalesce("payload", F.lit("")).alias("payload")).withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    marks = materialise(rows.select("id", "digest", F.octet_length("payload").alias("n")), "warc-marks")
    heads = marks.where((F.col("n") >= least) & F.col("id").isNotNull()).groupBy("digest").agg(F.max("id").alias("head"), F.count("*").alias("times")).where("times > 1").drop("times")
    heads = materialise(heads, "warc-heads")
    found = materialise(marks.where("id is not null").join(heads, "digest").select("id", "digest", "head").distinct(), "warc-revisits")
    repeated = marks.groupBy("id", "digest").count().where("count > 1").limit(1).count()
    discard(marks, heads)
    rows = rows.join(found.withColumnsRenamed({"id": "mark_id", "digest": "mark_digest"}), (F.col("id") == F.col("mark_id")) & (F.col("digest") == F.col("mark_digest")), "left").drop("mark_id", "mark_digest")
    turn = F.row_number().over(Window.partitionBy("id", "digest").orderBy("url")) if repeated else F.lit(1)
    return rows.withColumn("turn", turn).withColumn("head", F.when((F.col("head") == F.col("id")) & (F.col("turn") == 1), None).otherwise(F.col("head")))


def gzipped(record: bytes) -> bytes:
    """A gzip member, followed by an empty one if it does not end with a zero byte."""
    out = _member(record)
    return out if out.endswith(b"\0") else out + _member(b"")


def _member(data: bytes) -> bytes:
    squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


def info() -> bytes:
    """The record that a file begins with."""
    block = b"software: drawlens\r\nformat: WARC File Format 1.1\r\nconformsTo: http://iipc.github.io/warc-specifications/specifications/warc-format/warc-1.1/\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def filed(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Bodies of files of `most` bytes, without their last byte, of records (binary)."""
    held, size = [], 0

    def body() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([b"".join([gzipped(info()), *held])[:-1]], pa.binary())], ["value"])

    for batch in batches:
        for record in batch.column("record"):
            member = gzipped(record.as_py())
            if held and size + len(member) > most:
                yield body()
                held, size = [], 0
            held.append(member)
            size += len(member)
    if held:
        yield body()


def write_archives(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST, file_bytes: int = FILE_BYTES) -> str:
    """Write the captures of pages and return the archives' folder."""
    spark = pages.sparkSession
    rows = planned(pages.select(named(page_id).alias("id"), named(url).alias("url"), named(payload).alias("payload")), least)
    key = F.coalesce(F.col("id").cast("string"), F.lit("null"))
    own = _urn("response", key, F.col("digest"), F.when(F.col("id").isNull(), F.uuid()).otherwise(F.col("turn").cast("string")))
    rows = rows.withColumn("urn", own).withColumn("uri", F.coalesce(F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20"), F.concat(F.lit("urn:page:"), key)))
    digest = F.concat(F.lit("sha1:"), F.col("digest"))
    revisit = F.col("head").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit("\r\n\r\n"))
    refers = F.when(revisit, _urn("response", F.col("head").cast("string"), F.col("digest"), "1"))
    profile = F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    main = _record(
        F.when(revisit, "revisit").otherwise("response"), F.col("urn"),
        [("WARC-Target-URI", F.col("uri")), ("WARC-Payload-Digest", digest), ("WARC-Refers-To", refers), ("WARC-Profile", profile)],
        "application/http; msgtype=response", F.when(revisit, http).otherwise(F.concat(http, F.col("payload"))),
    )
    concurrent = [("WARC-Target-URI", F.col("uri")), ("WARC-Concurrent-To", F.col("urn"))]
    request = _record("request", _urn("request", F.col("urn")), concurrent, "application/http; msgtype=request", F.concat(F.lit("GET "), F.col("uri"), F.lit(" HTTP/1.1\r\n\r\n")))
    about = _record("metadata", _urn("metadata", F.col("urn")), concurrent, "application/warc-fields", F.concat(F.lit("page-id: "), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit("\r\n")))
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    records = rows.select(F.explode(F.array(request, main, about)).alias("record")).select(F.col("record").cast("binary").alias("record"))
    files = records.mapInArrow(lambda batches: filed(batches, file_bytes), "value binary").select(F.col("value").cast("string").alias("value"))
    files.write.option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", 1).text(path)
    rename(spark, path)
    return path


def rename(spark: SparkSession, path: str) -> None:
    """Give the files of a folder their name's ending."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in files.listStatus(folder):
        name = status.getPath().getName()
        if name.endswith(".txt"):
            files.rename(status.getPath(), spark._jvm.org.apache.hadoop.fs.Path(folder, f"{name[:-4]}.warc.gz"))


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of every record of a file, gzipped (also in members) or not."""
    view, held, at = memoryview(data), bytearray(), 0
    zipped = data[:2] == b"\x1f\x8b"
    unzip = zlib.decompressobj(31) if zipped else None

    def more() -> bool:
        nonlocal at, unzip
        if at >= len(view):
            return False
        part = bytes(view[at : at + (1 << 16)])
        at += len(part)
        if not zipped:
            held.extend(part)
            return True
        held.extend(unzip.decompress(part))
        while unzip.eof:
            left = unzip.unused_data.lstrip(b"\0")
            unzip = zlib.decompressobj(31)
            if not left:
                break
            held.extend(unzip.decompress(left))
        return True

    start = 0
    while True:
        while True:  # line ends between records
            while start < len(held) and held[start] in b"\r\n":
                start += 1
            if start < len(held) or not more():
                break
        if start >= len(held):
            return
        while (end := held.find(b"\r\n\r\n", start)) < 0 and more():
            pass
        if end < 0:
            raise ValueError("a record's header has no end")
        lines = held[start:end].decode("utf-8", "replace").split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = int(headers.get("content-length", 0))
        while len(held) < end + 4 + length and more():
            pass
        if len(held) < end + 4 + length:
            raise ValueError("a file ends within a record")
        yield headers, bytes(held[end + 4 : end + 4 + length])
        start = end + 4 + length
        if start > 1 << 22:
            del held[:start]
            start = 0


RECORD = "record_id string, kind string, concurrent_to string, refers_to string, uri string, date string, payload_bytes bigint, payload_digest string, fields string, payload binary"


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """One row a record: its headers' fields, payload_bytes and payload_digest as found, and with payloads the payload."""
    names = [x.split()[0] for x in RECORD.split(", ")]

    def row(h: dict[str, str], block: bytes) -> tuple:
        kind = h.get("warc-type", "")
        http = kind == "response" and h.get("content-type", "").startswith("application/http")
        body = block.partition(b"\r\n\r\n")[2] if http else b"" if kind == "revisit" else block
        digest = hashlib.sha1(body).hexdigest() if kind == "response" else h.get("warc-payload-digest", "").removeprefix("sha1:") or None
        fields = body.decode("utf-8", "replace") if kind in ("request", "metadata") else None
        return h.get("warc-record-id"), kind, h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), h.get("warc-date"), len(body), digest, fields, body if payloads and kind == "response" else None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for data in frame["content"]:
                out = []
                for h, block in records(data):
                    out.append(row(h, block))
                    if len(out) == 5000:
                        yield pd.DataFrame(out, columns=names)
                        out = []
                if out:
                    yield pd.DataFrame(out, columns=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, RECORD)


def assemble(rows: DataFrame) -> DataFrame:
    """One nested row per capture: capture (its identifier), main, request and metadata (null where missing)."""
    main = F.col("kind").isin("response", "revisit")
    capture = F.when(main, F.col("record_id")).otherwise(F.col("concurrent_to"))
    whole = F.struct("record_id", "kind", "refers_to", "uri", "date", "payload_bytes", "payload_digest", "payload")
    small = F.struct("record_id", "uri", "date", "fields")
    of = lambda kind: F.max(F.when(F.col("kind") == kind, small)).alias(kind)
    grouped = rows.where(capture.isNotNull()).groupBy(capture.alias("capture")).agg(F.max(F.when(main, whole)).alias("main"), of("request"), of("metadata"))
    return grouped.where("main is not null")


def round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, as read back from the archives written."""
    spark = pages.sparkSession
    path = write_archives(pages, page_id, url, payload, least)
    captures = assemble(read_archives(spark, path))
    kind = pages.schema[page_id].dataType.simpleString()
    own = F.nullif(F.trim(F.regexp_extract(F.col("metadata.fields"), r"page-id: ([^\r\n]*)", 1)), F.lit("")).cast(kind)
    flat = materialise(captures.select("capture", own.alias("id"), F.col("main.kind").alias("record_type"), F.col("main.refers_to").alias("to"), F.col("main.payload_bytes").alias("n"), F.col("main.payload_digest").alias("digest")), "warc-captures")
    remove(spark, path)
    responses = flat.where("record_type = 'response'")
    heads = responses.select(F.col("capture").alias("to"), F.col("id").alias("refers_to"), F.col("n").alias("original"))
    revisits = flat.where("record_type = 'revisit'").join(heads, "to", "left").select("id", F.col("original").alias("payload_bytes"), "digest", "record_type", "refers_to")
    out = revisits.unionByName(responses.select("id", F.col("n").alias("payload_bytes"), "digest", "record_type", F.lit(None).cast(kind).alias("refers_to")))
    return out.select(F.col("id").alias(page_id), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")
