"""Web archives: writing records, reading them back, and assembling transactions through concurrent-to identifiers."""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import filesystem, shared_folder, stored

# Fixed values of the archive format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ROLL_BYTES = 64 << 20
CHUNK = 1 << 18
RECORD_SCHEMA = ("file string, offset bigint, record_id string, concurrent_to string, record_type string, "
                 "target_uri string, refers_to_id string, payload_bytes bigint, payload_digest string, "
                 "page_id bigint, url string, payload binary")


def identifier(*parts) -> str:
    """A record id that depends on its parts alone, so a task run again writes the same records."""
    text = "\x1f".join("" if p is None else str(p) for p in parts)
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(text.encode()).digest()[:16])}>"


def record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in headers if v is not None), f"Content-Length: {len(block)}".encode()]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def header_uri(url: str | None) -> str | None:
    """The url as a header can carry it: blanks and control characters percent-encoded (the exact url is metadata)."""
    if url is None:
        return None
    return "".join(f"%{ord(c):02X}" if c <= " " or c == "\x7f" else c for c in url)


def capture_records(page_id, url, payload: bytes, digest: str, first, is_first: bool, nth: int, date: str) -> list[bytes]:
    """Request, response or revisit, and metadata of one page."""
    main = identifier("response" if is_first else "revisit", page_id, digest, nth)
    uri = header_uri(url)
    common = [("WARC-Date", date), ("WARC-Target-URI", uri)]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    request = record([("WARC-Type", "request"), ("WARC-Record-ID", identifier("request", main)), *common,
                      ("WARC-Concurrent-To", main), ("Content-Type", "application/http;msgtype=request")],
                     f"GET {uri or '/'} HTTP/1.1\r\n\r\n".encode())
    about = [("WARC-Record-ID", main), *common, ("WARC-Payload-Digest", f"sha256:{digest}"),
             ("Content-Type", "application/http;msgtype=response")]
    if is_first:
        answer = record([("WARC-Type", "response"), *about], http + payload)
    else:
        answer = record([("WARC-Type", "revisit"), *about, ("WARC-Profile", REVISIT_PROFILE),
                         ("WARC-Refers-To", identifier("response", first, digest, 0))], http)
    metadata = record([("WARC-Type", "metadata"), ("WARC-Record-ID", identifier("metadata", main)), *common,
                       ("WARC-Concurrent-To", main), ("Content-Type", "application/json")],
                      json.dumps({"page_id": page_id, "url": url}).encode())
    return [request, answer, metadata]


def marked_pages(pages: DataFrame, min_bytes: int) -> DataFrame:
    """Pages with payload, digest and, for payloads that repeat, the smallest page_id holding them.

    Equal payloads meet as one aggregated row each; only payloads that do repeat are joined back.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    repeated = rows.filter(F.octet_length("html") >= min_bytes).groupBy("digest").agg(
        F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first")).filter("n > 1")
    firsts = stored(repeated.select(F.col("digest").alias("_digest"), "first", F.lit(True).alias("repeats")), "repeated-payloads")
    return rows.join(firsts, F.col("digest") == F.col("_digest"), "left").select(
        "page_id", "url", F.col("html").cast("binary").alias("payload"), "digest", "first",
        (F.col("repeats").isNull() | F.col("page_id").eqNullSafe(F.col("first"))).alias("is_first"))


def write_archives(pages: DataFrame, folder: str, *, min_bytes: int = 100, date: str = "1970-01-01T00:00:00Z",
                   compress: bool = True) -> DataFrame:
    """Writes three records per page into archives of about ROLL_BYTES; returns the manifest (file, n_records).

    Of equal payloads of at least `min_bytes` bytes the smallest page_id is written as response, the others as
    revisits of it (rows repeating that page_id are responses too).  Null html is an empty payload, a null url a
    record without target, a null page_id sorts after all others.  A file gets its name when it is complete.
    """
    marked = marked_pages(pages, min_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        task, files, out, size, seen = TaskContext.get(), [], None, 0, Counter()
        fs.create_dir(base, recursive=True)
        partial = f"{base}/_{task.partitionId():06d}.{task.taskAttemptId()}"

        def close():
            out.close()
            name = f"part-{task.partitionId():06d}-{len(files):04d}.warc{'.gz' if compress else ''}"
            fs.move(partial, f"{base}/{name}")
            files.append((name, written))

        written = 0
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "digest", "first", "is_first"))):
                page_id, url, payload, digest, first, is_first = (x.as_py() for x in row)
                key = (page_id, digest)
                if out is None:
                    out, size, written = fs.open_output_stream(partial), 0, 0
                    seen.clear()
                for raw in capture_records(page_id, url, payload, digest, first, is_first, seen[key], date):
                    if compress:
                        raw = zlib.compress(raw, 1, wbits=31)
                    out.write(raw)
                    size += len(raw)
                    written += 1
                seen[key] += 1
                if size >= ROLL_BYTES:
                    close()
                    out = None
        if out is not None:
            close()
        if files:
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in files]), pa.array([n for _, n in files], pa.int64())],
                                             ["file", "n_records"])

    return stored(marked.mapInArrow(run, "file string, n_records bigint"), "archive-manifest")


def parse_archive(source, compressed: bool) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers with lower-case names, block) of every record; holds one record at a time."""
    unpack = zlib.decompressobj(wbits=31) if compressed else None
    data, offset = bytearray(), 0
    while True:
        chunk = source.read(CHUNK)
        if not compressed:
            data += chunk
        else:
            left = chunk
            while left:
                data += unpack.decompress(left)
                left = unpack.unused_data
                if unpack.eof:
                    unpack = zlib.decompressobj(wbits=31)
        begin = 0
        while (head := data.find(b"\r\n\r\n", begin)) >= 0:
            lines = data[begin:head].decode().split("\r\n")
            if lines[0] != VERSION.decode():
                raise ValueError(f"no record at {offset}")
            headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            end = head + 4 + int(headers["content-length"])
            if len(data) < end + 4:
                break
            yield offset, headers, bytes(data[head + 4:end])
            offset += end + 4 - begin
            begin = end + 4
        del data[:begin]
        if not chunk:
            if data:
                raise ValueError("the archive ends within a record")
            return


def read_archives(manifest: DataFrame, folder: str, *, with_payload: bool = True) -> DataFrame:
    """One row per record; a response's digest is recomputed and must equal its header."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("record_id", pa.string()),
                            ("concurrent_to", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()),
                            ("refers_to_id", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                            ("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(f"{base}/{name}", compression=None) as source:
                    for offset, headers, block in parse_archive(source, name.endswith(".gz")):
                        rows.append(record_row(name, offset, headers, block, with_payload))
                        held += len(block)
                        if len(rows) >= 3000 or (with_payload and held >= 8 << 20):
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    parts = max(1, manifest.count())
    return manifest.select("file").repartition(parts, "file").mapInArrow(run, RECORD_SCHEMA)


def record_row(file: str, offset: int, headers: dict[str, str], block: bytes, with_payload: bool) -> dict:
    kind = headers["warc-type"]
    row = {"file": file, "offset": offset, "record_id": headers["warc-record-id"], "record_type": kind,
           "concurrent_to": headers.get("warc-concurrent-to"), "target_uri": headers.get("warc-target-uri"),
           "refers_to_id": headers.get("warc-refers-to")}
    if kind == "metadata":
        row |= {k: v for k, v in json.loads(block).items() if k in ("page_id", "url")}
    elif kind in ("response", "revisit"):
        head, _, payload = block.partition(b"\r\n\r\n")
        digest = headers["warc-payload-digest"].removeprefix("sha256:")
        row["payload_digest"] = digest
        if kind == "response":
            if hashlib.sha256(payload).hexdigest() != digest:
                raise ValueError(f"payload of {row['record_id']} in {file} is damaged")
            row["payload_bytes"] = len(payload)
            row["payload"] = payload if with_payload else None
        else:
            lengths = [x.split(b":")[1] for x in head.lower().split(b"\r\n") if x.startswith(b"content-length:")]
            row["payload_bytes"] = int(lengths[0])
    return row


def assemble_captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: records of one archive joined through their concurrent-to identifiers.

    A capture is a response or revisit with the requests and metadata that name it; records that name no response
    of their archive give a row without one.  All kinds are read in one pass and meet in one shuffle.
    """
    key = F.coalesce("concurrent_to", "record_id").alias("capture_id")
    main = F.struct("record_id", "record_type", "target_uri", "refers_to_id", "payload_bytes", "payload_digest", "payload")
    request = F.struct("record_id", "target_uri")
    metadata = F.struct("record_id", "page_id", "url")
    kind = F.col("record_type")
    return records.groupBy("file", key).agg(
        F.first(F.when(kind.isin("response", "revisit"), main), ignorenulls=True).alias("response"),
        F.collect_list(F.when(kind == "request", request)).alias("requests"),
        F.collect_list(F.when(kind == "metadata", metadata)).alias("metadata"))


def archive_digest(pages: DataFrame, *, folder: str | None = None, min_bytes: int = 100) -> DataFrame:
    """Writes, reads back and assembles; per page its payload's length and digest, record type and the page revisited."""
    folder = folder or shared_folder(pages.sparkSession, "archives")
    records = read_archives(write_archives(pages, folder, min_bytes=min_bytes), folder, with_payload=False)
    captures = stored(assemble_captures(records).select(
        F.try_element_at("metadata", F.lit(1)).getField("page_id").alias("page_id"), "response.record_id", "response.record_type",
        "response.refers_to_id", "response.payload_bytes", "response.payload_digest"), "captures")
    originals = captures.filter("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to_id")).agg(
        F.min("page_id").alias("refers_to"))
    return captures.join(originals, "refers_to_id", "left").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_warc(spark, sf_dir: str) -> DataFrame:
    return archive_digest(spark.read.parquet(f"{sf_dir}/pages.parquet"))


OP10_SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, strlen(html) as payload_bytes, sha256(html) as payload_digest from p),
f as (select *, min(page_id) over (partition by payload_digest) as first from d)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes < 100 or page_id = first then 'response' else 'revisit' end as record_type,
       case when payload_bytes < 100 or page_id = first then null else first end as refers_to
from f
"""
