"""Dictionary-compressed WARC archives (.warc.zst).

Each archive begins with a skippable frame (magic number 0x184D2A5D) that holds a Zstandard dictionary built
from that archive's own records; every record follows as a frame of its own, compressed with it. Payloads that
occur again are written as revisit records that name the response record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import Scratch, batch_of

DICT_MAGIC = 0x184D2A5D
#: Records are gathered to so many bytes before an archive is closed; a larger record makes a larger archive.
ARCHIVE_BYTES = 16 << 20
DICT_BYTES = 64 << 10
MIN_REVISIT = 1000
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP header, with the payload's length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(page_id, digest)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if kind == "revisit":
        lines += [f"WARC-Refers-To: {_urn(refers_to, digest)}", f"WARC-Profile: {_PROFILE}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def train(records: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A dictionary from the records; empty where they are too few for one."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, records, k=512, d=8, level=3).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_archive(out, records: list[bytes]) -> int:
    """Writes the dictionary frame and a frame for each record; returns the bytes written."""
    import zstandard

    trained = train(records)
    tool = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(trained) if trained else None, write_checksum=True)
    size = out.write(struct.pack("<II", DICT_MAGIC, len(trained)) + trained)
    for x in records:
        size += out.write(tool.compress(x))
    return size


def read_archive(source, step: int = 1 << 20) -> Iterator[bytes]:
    """Records of an open archive, one at a time."""
    import zstandard

    magic, n = struct.unpack("<II", source.read(8))
    if magic != DICT_MAGIC:
        raise ValueError("no leading dictionary frame")
    trained = source.read(n) if n else b""
    tool = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained) if trained else None)
    rest = source.read(step)
    while rest:
        one, parts = tool.decompressobj(), []
        while True:
            parts.append(one.decompress(rest))
            if one.eof:
                rest = one.unused_data or source.read(step)
                break
            rest = source.read(step)
            if not rest:
                raise ValueError("the archive ends within a record")
        yield b"".join(parts)


def parse(raw: bytes) -> tuple[dict[str, str], bytes, dict[str, str], bytes]:
    """WARC header, block, HTTP header and payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    top, _, payload = block.partition(b"\r\n\r\n")
    return fields, block, dict(line.split(": ", 1) for line in top.decode().split("\r\n")[1:]), payload


def _urn(page_id: int | None, digest: str) -> str:
    """A record's name: rows of one page_id, or without one, are told apart by their payloads."""
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}>"


def _page(urn: str | None) -> int | None:
    page = urn.split(":")[2] if urn else ""
    return int(page) if page else None


def write_warc(pages: DataFrame, scratch: Scratch, page: str = "page_id", url: str = "url", html: str = "html", date: str = "2024-01-01T00:00:00Z", min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Writes the archives below scratch and returns their manifest (path, records, bytes).

    A payload is the html in UTF-8 (null: empty). Of records with equal payloads of at least min_revisit bytes
    the one with the largest page_id is a response and the others revisit it; smaller ones are all responses.
    Repeated rows with that page_id are all responses; only rows equal in page_id and payload share a record's name.
    A null page_id is below all others and, where a payload has no other, all of its records are responses. Groups
    are found by digest and length: one aggregation that combines before its shuffle, then a join whose large side
    can be split where one payload is very common; payloads that cannot be revisits carry keys of their own. Task
    attempts write files of their own names, and only those in the manifest, itself written once, count. Archives
    go through pyarrow's file systems, so the shared folder must be one of theirs (file, hdfs, s3, gs, abfs).
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(page).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    keyed = rows.withColumns({"digest": F.sha1(F.col("html").cast("binary")), "n": F.octet_length("html")})
    groups = keyed.where(F.col("n") >= min_revisit).groupBy("digest", "n").agg(F.max("page_id").alias("first"), F.count("*").alias("times")).where("times > 1 AND first IS NOT NULL").select(F.concat_ws("-", "digest", "n").alias("key"), "first")
    own = F.concat(F.lit("page "), F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    marked = keyed.withColumn("key", F.when(F.col("n") >= min_revisit, F.concat_ws("-", "digest", "n")).otherwise(own)).join(groups, "key", "left")
    ready = marked.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))
    folder = scratch.path("archives")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)

    def run(batches):
        store, base = pyarrow.fs.FileSystem.from_uri(folder)
        waiting, size = [], 0

        def close():
            name = f"{uuid.uuid4().hex}.warc.zst"
            with store.open_output_stream(f"{base}/{name}", compression=None) as out:
                written = write_archive(out, waiting)
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": pa.array([len(waiting)], pa.int64()), "bytes": pa.array([written], pa.int64())})

        for batch in batches:
            for p, u, h, ref in zip(*(batch.column(i) for i in range(4)), strict=True):
                p, u, h, ref = p.as_py(), u.as_py(), h.as_py().encode(), ref.as_py()
                waiting.append(record(p, u, h, "response" if ref is None else "revisit", ref, date))
                size += len(waiting[-1])
                if size >= ARCHIVE_BYTES:
                    yield close()
                    waiting, size = [], 0
        if waiting:
            yield close()

    written = ready.mapInArrow(run, "path string, records long, bytes long")
    return scratch.keep(written.repartition(spark.sparkContext.defaultParallelism), "manifest")


def read_warc(manifest: DataFrame) -> DataFrame:
    """Every record of the archives: page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri.

    Responses are checked against their digest.
    """
    size = manifest.agg({"bytes": "sum"}).head()[0] or 0
    n = max(manifest.sparkSession.sparkContext.defaultParallelism, size // ARCHIVE_BYTES)

    def run(batches):
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("target_uri", pa.string())])
        for batch in batches:
            for at in batch.column("path").to_pylist():
                store, path = pyarrow.fs.FileSystem.from_uri(at)
                out = [[] for _ in schema]
                with store.open_input_stream(path, compression=None) as source:
                    for raw in read_archive(source):
                        fields, _, http, payload = parse(raw)
                        digest = base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex()
                        if fields["WARC-Type"] == "response" and hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"{at}: a payload differs from its digest")
                        row = (_page(fields["WARC-Record-ID"]), int(http["Content-Length"]), digest, fields["WARC-Type"], _page(fields.get("WARC-Refers-To")), fields.get("WARC-Target-URI"))
                        for x, v in zip(out, row, strict=True):
                            x.append(v)
                yield batch_of(schema, *out)

    return manifest.select("path").repartition(n).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string")
