"""WARC archives compressed record by record with an embedded Zstandard dictionary.

Every archive starts with a skippable frame that holds a dictionary trained on
its own first records; each record follows as a frame of its own, so a reader
can seek to any of them.  Records with a payload that an archived response
already holds become revisits that name it.

Spark's text writer stores the bytes: a row is one frame and the line
separator is an empty skippable frame, which Zstandard readers pass over.  So
archives reach any file system that Spark reaches, through its commit protocol,
and a lost executor leaves no half-written archive behind.  Each task writes
one archive from a stream: only the training sample is held, ``SAMPLE_BYTES``
at most and one record at least.

Payloads meet by digest in a join that adaptive execution can split; the
response of each digest comes from an aggregate.  Reading checks every
response's digest.

Defined cases: a null payload is empty; among equal payloads the response is
the one with the largest id, and so are all rows that share that id; payloads
below ``least_bytes`` are responses always; a null id or address is left out of
the record and read back as null; too few bytes to train on give an archive
without a dictionary; an empty table gives no records.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazetteer.llm.common import bounded
from gazetteer.session import shared_dir

# Fixed values of the format: the frame that carries a dictionary, and one that carries nothing.
DICTIONARY_MAGIC = 0x184D2A5D
EMPTY_FRAME = "P*M\x18\x00\x00\x00\x00"
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

DICTIONARY_BYTES = 32 << 10
SAMPLE_BYTES = 1 << 20
SAMPLE_PART = 2048
LEVEL = 6
DATE = "1970-01-01T00:00:00Z"


def _id(page) -> str:
    return f"<urn:page:{page}>"


def _page(text: str | None) -> int | None:
    return None if text is None else int(text.removeprefix("<urn:page:").removesuffix(">"))


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, revisit: bool, date: str = DATE) -> bytes:
    """One WARC/1.1 record; a revisit keeps the header of the response and drops the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    named = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id} {url} {digest}").urn if page_id is None else _id(page_id).strip("<>")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{named}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_id(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}",
             f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Fields of one record: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x[16:]) for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or _base32(payload) != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    own = fields["WARC-Record-ID"]
    return {"page_id": _page(own) if own.startswith("<urn:page:") else None, "url": fields.get("WARC-Target-URI"),
            "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"],
            "refers_to": _page(fields.get("WARC-Refers-To")), "payload": None if revisit else payload}


def _base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary trained on pieces of the samples, or None where they are too few."""
    pieces = [s[i: i + SAMPLE_PART] for s in samples for i in range(0, len(s), SAMPLE_PART)]
    if sum(map(len, pieces)) < 4 * SAMPLE_PART or len(pieces) < 8:
        return None
    size = min(DICTIONARY_BYTES, max(1024, sum(map(len, pieces)) // 8))
    try:
        return zstandard.train_dictionary(size, pieces, level=LEVEL)
    except zstandard.ZstdError:
        return None


def _frames(records: Iterator[bytes], level: int) -> Iterator[bytes]:
    """An archive's frames: the dictionary, then one frame per record."""
    held, size = [], 0
    for one in records:
        held.append(one)
        size += len(one)
        if size >= SAMPLE_BYTES:
            break
    if not held:
        return
    trained = dictionary(held)
    if trained is not None:
        body = trained.as_bytes()
        yield struct.pack("<II", DICTIONARY_MAGIC, len(body)) + body
    press = zstandard.ZstdCompressor(level=level, dict_data=trained)
    for one in held:
        yield press.compress(one)
    held.clear()
    for one in records:
        yield press.compress(one)


def read_archive(data: bytes) -> Iterator[bytes]:
    """The records of an archive, one decompressed frame after another."""
    trained, at = None, 0
    opener = zstandard.ZstdDecompressor()
    view = memoryview(data)
    while at < len(data):
        magic, size = struct.unpack_from("<II", data, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            if magic == DICTIONARY_MAGIC and trained is None:
                trained = zstandard.ZstdCompressionDict(bytes(view[at + 8: at + 8 + size]))
                opener = zstandard.ZstdDecompressor(dict_data=trained)
            at += 8 + size
            continue
        one = opener.decompressobj()
        parts, low = [], at
        while not one.eof:  # feed growing steps, so that a long archive is not copied for each record
            step = view[low: low + (1 << 16)]
            if not len(step):
                raise ValueError("an archive ends inside a frame")
            parts.append(one.decompress(step))
            low += len(step)
        at = low - len(one.unused_data)
        yield b"".join(parts)


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html",
                   least_bytes: int = 0, level: int = LEVEL) -> None:
    """Write one archive per task into a new folder."""
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
                        F.coalesce(F.col(payload), F.lit("")).alias("body"))
    rows = rows.withColumn("sha", F.sha1("body"))
    groups = rows.where(F.octet_length("body") >= least_bytes).groupBy(F.col("sha").alias("_sha")).agg(
        F.max("page_id").alias("first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    rows = rows.join(groups, (F.col("sha") == F.col("_sha")) & (F.octet_length("body") >= least_bytes), "left")
    rows = rows.select("page_id", "url", "body", "first",
                       (F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))).alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            for batch in bounded(batches, "body"):
                for r in batch.to_pylist():
                    body = r["body"].encode("utf-8")
                    yield record(r["page_id"], r["url"], body, _base32(body), r["first"], r["revisit"])

        for frame in _frames(records(), level):
            yield pa.RecordBatch.from_arrays([pa.array([frame], pa.binary())], names=["value"])

    frames = rows.mapInArrow(run, "value binary")
    frames.select(F.col("value").cast("string")).write.option("lineSep", EMPTY_FRAME).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of all archives in a folder, with its archive's file name and its payload."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    schema = T.StructType([
        T.StructField("archive", T.StringType()), T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()),
        T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()),
        T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType()),
        T.StructField("payload", T.BinaryType())])
    types = pa.schema([("archive", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()),
                       ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                       ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name = batch.column(0)[i].as_py().rsplit("/", 1)[-1]
                held, size = [], 0
                for raw in read_archive(batch.column(1)[i].as_buffer().to_pybytes()):
                    held.append({"archive": name, **parse(raw)})
                    size += len(raw)
                    if size >= 4 << 20:
                        yield pa.RecordBatch.from_pylist(held, types)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, types)

    return files.mapInArrow(run, schema)


def archive_and_read(pages: DataFrame, **options) -> DataFrame:
    """Write the archives to a new folder of the shared store and read them back."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, **options)
    return read_archives(spark, path)
