"""WARC archives: writing, and reading by boundary-chain verification.

Writing.  Each row becomes a record.  Of equal payloads the smallest id
becomes a response with the payload; the others become revisit records that
refer to it.  Spark's text writer puts records into gzip files of a bounded
number of records, through the file system's own commit protocol.

Reading.  Tasks cut the archive at every ``WARC/1.0`` line, wherever it
stands, and emit for each such candidate its offset and, from its header's
Content-Length, the offset of its successor.  A magic line inside a payload
gives a candidate too, but no chain from the start of its file reaches it.
Pointer jumping finds what is reachable: each round a set of reached offsets
grows by one jump, and every jump doubles its length, so a file of n records
takes about log2(n) rounds of joins over (file, offset, successor).

Defined results: a null payload is empty; a null url is left out; a row without
an id is a response only where no row of its payload has one; rows that share
id and payload are responses alike when that id is the smallest of the payload; an empty table gives no records and no
rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import written

MAGIC = "WARC/1.0\r\n"
RECORDS_PER_FILE = 1024
LEAST_BYTES = 0
LENGTH_DIGITS = 18  # a length of more digits, in a false candidate, is beyond any file

_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def sha1_base32(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: five hex digits are four letters."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789" + _B32[:22], _B32)


def records(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """id, url, payload, digest, type and refers_to of each row of ``pages``
    (page_id, url, html)."""
    rows = pages.select(pages["page_id"].alias("id"), pages["url"].alias("url"),
                        F.coalesce(pages["html"], F.lit("")).alias("payload"))
    content = F.sha2("payload", 256)
    first = (rows.where(F.octet_length("payload") >= least_bytes).groupBy(content.alias("content"))
             .agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("id"))
    return (rows.withColumn("digest", sha1_base32(F.col("payload").cast("binary")))
            .join(first, content == F.col("content"), "left")
            .select("id", "url", "payload", "digest", F.when(revisit, "revisit").otherwise("response").alias("type"),
                    F.when(revisit, F.col("first")).alias("refers_to")))


def write(records: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write ``records`` as WARC files."""
    end = "\r\n"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{end}Content-Type: text/html; charset=utf-8{end}Content-Length: "),
                    F.octet_length("payload").cast("string"), F.lit(end + end), F.col("payload"))
    block = F.when(F.col("type") == "response", http).otherwise(F.lit(f"HTTP/1.1 200 OK{end}{end}"))

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(end)), F.lit(""))

    head = F.concat(
        F.lit(MAGIC), line("WARC-Type", F.col("type")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("")),
                                        F.lit(">"))),
        line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "%20")),
        F.lit(f"WARC-Date: 2000-01-01T00:00:00Z{end}"),
        line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.lit(f"Content-Type: application/http; msgtype=response{end}Content-Length: "),
        F.octet_length("block").cast("string"), F.lit(end + end), F.col("block"))
    (records.withColumn("block", block).select(head.alias("value")).write
     .option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records_per_file)
     .option("compression", "gzip").text(path))


_HEADER = re.compile(rb"^([A-Za-z-]+):[ \t]*(.*?)[ \t]*$")


def _header(raw: bytes) -> dict[bytes, bytes]:
    return {m[1].lower(): m[2] for m in map(_HEADER.match, raw.split(b"\r\n")) if m}


def _length(fields: dict[bytes, bytes]) -> int | None:
    """The stated length; of more digits than a file has bytes, it is none."""
    digits = fields.get(b"content-length", b"")
    return int(digits) if digits.isdigit() and len(digits) <= LENGTH_DIGITS else None


def _payload(block: bytes) -> bytes:
    return block.partition(b"\r\n\r\n")[2]


def _urn(value: bytes | None) -> str | None:
    m = re.fullmatch(rb"<urn:page:(.+)>", value or b"")
    return m[1].decode("utf-8", "replace") if m else None


def _base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


CANDIDATE = pa.schema([
    ("file", pa.int64()), ("split", pa.int64()), ("at", pa.int64()), ("span", pa.int64()), ("size", pa.int64()),
    ("type", pa.string()), ("id", pa.string()), ("refers_to", pa.string()), ("digest", pa.string()),
    ("bytes", pa.int64())])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, bytes]]:
    """(file, split, offset in the split, text after the magic) in file order.
    The offset is that of the magic; the text before a file's first magic
    starts at minus its length."""
    now, at = None, 0
    for batch in batches:
        files, splits = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        texts = batch.column(2).cast(pa.binary())
        for i, key in enumerate(zip(files, splits, strict=True)):
            if key != now:
                now, at = key, 0
            text = texts[i].as_py()
            yield *key, at, text
            at += len(text) + len(MAGIC)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    for file, split, at, text in _chunks(batches):
        head, gap, rest = text.partition(b"\r\n\r\n")
        fields = _header(head)
        length = _length(fields)
        size = len(MAGIC) + len(head) + 8 + length if gap and length is not None else None
        whole = size is not None and size == len(MAGIC) + len(text)
        payload = _payload(rest[:length]) if whole else None
        rows.append((file, split, at, len(MAGIC) + len(text), size, fields.get(b"warc-type", b"").decode("latin-1"),
                     _urn(fields.get(b"warc-record-id")), _urn(fields.get(b"warc-refers-to")),
                     _base32(payload) if whole else None, len(payload) if whole else None))
        if len(rows) >= 5000:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), CANDIDATE.types)], schema=CANDIDATE)
            rows = []
    if rows:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), CANDIDATE.types)], schema=CANDIDATE)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for file, split, at, text in _chunks(batches):
        yield pa.record_batch([pa.array([file], pa.int64()), pa.array([split], pa.int64()), pa.array([at], pa.int64()),
                               pa.array([text], pa.binary())], names=["file", "split", "at", "text"])


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """The archive cut at each magic, in file order within a task; a file is
    known by the hash of its path."""
    return spark.read.option("lineSep", MAGIC).text(path).select(
        F.xxhash64("_metadata.file_path").alias("file"), "_metadata.file_block_start", F.col("value").cast("binary"))


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """file, offset, successor and header of each candidate record."""
    schema = ("file long, split long, at long, span long, size long, type string, id string, refers_to string, "
              "digest string, bytes long")
    files = spark.read.format("binaryFile").load(path).select(  # a listing: no content is read
        F.col("_metadata.file_path").alias("path"))
    if files.groupBy(F.xxhash64("path")).count().where("count > 1").count():
        raise ValueError("two archive files have one hash: rename one")
    found = written(_lines(spark, path).mapInArrow(_candidates, schema), "candidates")
    # a split starts where the splits before it end; offset 0 is the first magic
    before = F.sum("bytes").over(Window.partitionBy("file").orderBy("split")) - F.col("bytes")
    splits = found.groupBy("file", "split").agg(F.sum("span").alias("bytes")).select(
        "file", "split", (before - len(MAGIC)).alias("start"))
    return (found.join(splits, ["file", "split"]).withColumn("offset", F.col("start") + F.col("at"))
            .withColumn("successor", F.col("offset") + F.col("size")))


def reachable(links: DataFrame) -> DataFrame:
    """(file, offset) of those ``links`` (file, offset, successor) that the
    chain from offset 0 of their file reaches, by pointer jumping."""
    # a jump ends at a candidate; one that ends elsewhere leads nowhere
    nodes = links.select("file", "offset")
    jumps = written(links.select("file", "offset", "successor").join(
        nodes.withColumnRenamed("offset", "successor"), ["file", "successor"]).distinct(), "jumps")
    reached = written(nodes.where("offset = 0").distinct(), "reached")
    n = reached.count()
    while n:
        next_ones = reached.join(jumps, ["file", "offset"]).select("file", F.col("successor").alias("offset"))
        reached = written(reached.union(next_ones).distinct(), "reached")
        n, before = reached.count(), n
        if n == before:
            break
        far = jumps.select("file", F.col("offset").alias("successor"), F.col("successor").alias("far"))
        jumps = written(jumps.join(far, ["file", "successor"]).select("file", "offset", F.col("far").alias("successor")),
                        "jumps")
    return reached


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per record of the archives: type, id, refers_to, and digest and bytes
    of the payload it carries."""
    found = written(candidates(spark, path), "linked")
    true = written(found.join(reachable(found), ["file", "offset"]), "records")
    # a payload with a magic inside was cut: put its pieces together again
    cut = true.where("digest is null")
    if cut.isEmpty():
        return true.select("type", "id", "refers_to", "digest", "bytes")
    # each piece belongs to the true record that starts last before it
    starts = true.select("file", "offset", F.when(F.col("digest").isNull(), F.col("offset")).otherwise(-1).alias("own"))
    owner = F.last("own", ignorenulls=True).over(Window.partitionBy("file").orderBy("offset"))
    pieces = (found.select("file", "split", "at", "offset").join(starts, ["file", "offset"], "left")
              .withColumn("record", owner).where("record >= 0")
              .select("file", "split", "at", "record", F.col("offset").alias("piece")))
    texts = _lines(spark, path).mapInArrow(_texts, "file long, split long, at long, text binary")
    whole = (texts.join(pieces, ["file", "split", "at"]).groupBy("file", "record")
             .agg(F.array_sort(F.collect_list(F.struct("piece", "text"))).alias("pieces")))
    mended = whole.mapInArrow(_mended, "file long, offset long, digest string, bytes long")
    mended = cut.drop("digest", "bytes").join(mended, ["file", "offset"])
    columns = ["type", "id", "refers_to", "digest", "bytes"]
    return true.where("digest is not null").select(columns).unionByName(mended.select(columns))


def _mended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests, sizes = [], []
        for pieces in batch.column(2):
            text = MAGIC.encode().join(p["text"] for p in pieces.as_py())
            head, _, rest = text.partition(b"\r\n\r\n")
            length = _length(_header(head))
            payload = _payload(rest[:length]) if length is not None else None  # a broken record, last of its chain
            digests.append(None if payload is None else _base32(payload))
            sizes.append(None if payload is None else len(payload))
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(digests, pa.string()),
                               pa.array(sizes, pa.int64())], names=["file", "offset", "digest", "bytes"])


def resolved(archive: DataFrame) -> DataFrame:
    """``archive`` (as ``read`` gives it) with the payload that each revisit
    refers to: id, type, refers_to, digest, bytes."""
    own = archive.where("type = 'response'").select("id", "type", "refers_to", "digest", "bytes")
    target = own.select(F.col("id").alias("target"), F.col("digest").alias("found"), "bytes").distinct()
    stated = archive.where("type = 'revisit'").select("id", "type", "refers_to")
    return own.unionByName(stated.join(target, F.col("refers_to") == F.col("target")).select(
        "id", "type", "refers_to", F.col("found").alias("digest"), "bytes"))
