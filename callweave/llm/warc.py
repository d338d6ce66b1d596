"""WARC archives: writing pages as records and reading them back, segments reassembled.

``write`` makes one record for each page: an HTTP response with a chunked body, or, where another page has the same
payload and a larger id, a revisit that refers to it. A record block beyond ``segment_bytes`` is cut: the first part
keeps its type, the rest are continuation records. Each record is a gzip member of its own, as usual in WARC files.

``read`` parses the files where they lie. Whole records are decoded at once. Segments are grouped by the origin's
record id, ordered by segment number and joined if numbers run from 1 without a gap and the total length is the one
that the last segment states; then the chunked framing is taken off. Only segments are shuffled, and a group is one
record. Revisits get length and digest from the record that they refer to.

Files are written by executors into a folder that all share, under names that hold the task attempt; only files that
successful tasks report are read, so a lost or repeated task leaves nothing but an unread file.

Edge cases: a null html is an empty payload; control characters in a url are percent-encoded, a null url is left out;
pages that repeat id and payload are all responses, as is a page without an id; an empty table gives no file and an empty result; further columns
are not read. A record that fails its checks keeps its row with ``intact`` false.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.llm.common import map_arrow, settle, shared_dir, slices

VERSION = b"WARC/1.1\r\n"
TAG = "tag:callweave,2026:page/"
#: Defaults: bytes of a file before the next begins, of a record block before it is cut, of an HTTP chunk.
FILE_BYTES, SEGMENT_BYTES, CHUNK_BYTES = 64 << 20, 64 << 10, 16 << 10
DATE = "2026-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
READ = "done boolean, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean, origin string, segment int, total long, block binary"


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = []
    for at in range(0, len(payload), size):
        part = payload[at : at + size]
        parts += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError if the framing is broken."""
    parts, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not n:
            return b"".join(parts)
        if body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("chunk without its end")
        parts.append(body[at : at + n])
        at += n + 2


def _record(kind: str, record_id: str, headers: dict[str, str], block: bytes) -> bytes:
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Date": DATE, **headers, "Content-Length": str(len(block))}
    text = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return VERSION + text.encode() + b"\r\n" + block + b"\r\n\r\n"


def records(page_id: int, url: str | None, payload: bytes, refers_to: int | None, unique: str, segment_bytes: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """The WARC records of one page: one, or its segments."""
    record_id = f"{TAG}{page_id}/{unique}"
    headers = {} if url is None else {"WARC-Target-URI": re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)}
    headers |= {"WARC-Payload-Digest": f"sha1:{digest32(payload)}", "Content-Type": "application/http; msgtype=response"}
    if refers_to is not None:
        headers |= {"WARC-Refers-To": f"<{TAG}{refers_to}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
        yield _record("revisit", record_id, headers, HTTP)
        return
    block = HTTP + chunked(payload)
    parts = [block[at : at + segment_bytes] for at in range(0, len(block), segment_bytes)]
    if len(parts) == 1:
        yield _record("response", record_id, headers, block)
        return
    yield _record("response", record_id, headers | {"WARC-Segment-Number": "1"}, parts[0])
    for k, part in enumerate(parts[1:], 2):
        more = {"WARC-Segment-Origin-ID": f"<{record_id}>", "WARC-Segment-Number": str(k)}
        if k == len(parts):
            more["WARC-Segment-Total-Length"] = str(len(block))
        yield _record("continuation", f"{record_id}/{k}", more, part)


def parsed(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record of a WARC stream."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline().rstrip(b"\r\n")) != b"":
            k, _, v = line.decode("utf-8", "replace").partition(":")
            headers[k.strip().lower()] = v.strip()
        n = int(headers["content-length"])
        block = stream.read(n)
        if len(block) != n:
            raise ValueError("record cut short")
        yield headers, block


def _page(uri: str) -> int | None:
    page = uri.strip("<>").removeprefix(TAG).split("/")[0]
    return None if page == "None" else int(page)


def decoded(block: bytes) -> bytes:
    """The payload of an HTTP message."""
    head, _, body = block.partition(b"\r\n\r\n")
    return dechunked(body) if re.search(rb"(?im)^transfer-encoding:\s*chunked\s*$", head.replace(b"\r", b"")) else body


def _result(headers: dict[str, str], block: bytes, intact: bool = True) -> dict:
    """A row of READ for a whole record."""
    kind, stated = headers["warc-type"], headers.get("warc-payload-digest", "").removeprefix("sha1:")
    row = {"done": True, "page_id": _page(headers["warc-record-id"]), "payload_digest": stated, "record_type": kind, "intact": intact}
    if kind == "revisit":
        return row | {"refers_to": _page(headers["warc-refers-to"])}
    try:
        payload = decoded(block)
    except ValueError:
        return row | {"intact": False}
    own = digest32(payload)
    return row | {"payload_bytes": len(payload), "payload_digest": own, "intact": intact and own == stated}


def with_roles(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, refers_to): refers_to is the largest id with the same payload, for all others that have it.

    Only payloads that occur twice reach the join; where they are few, adaptive execution broadcasts them by their
    measured size, else both sides are shuffled and a payload that many pages share is split."""
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("h", F.sha1("html"))
    many = p.where(F.octet_length("html") >= min_bytes).groupBy("h").agg(F.max("page_id").alias("top"), F.min("page_id").alias("low")).where("low < top")
    out = p.join(many.select("h", "top"), "h", "left")
    return out.select("page_id", "url", "html", F.when(F.col("page_id") < F.col("top"), F.col("top")).alias("refers_to"))


def write(pages: DataFrame, folder: str, min_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the archives into ``folder`` (a URI that all executors reach); returns the manifest (path, records), which
    is computed once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}"
        store, base = filesystem(folder)
        out, path, size, count, files = None, "", 0, 0, 0

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([count], pa.int64())], ["path", "records"])

        def put(record: bytes) -> int:
            z = zlib.compressobj(3, zlib.DEFLATED, 31)
            return out.write(z.compress(record) + z.flush()) or 0

        row = 0
        for b in slices(batches, "html"):
            for page_id, url, html, refers in zip(*(b.column(k).to_pylist() for k in ("page_id", "url", "html", "refers_to")), strict=True):
                if out is None:
                    store.create_dir(base, recursive=True)
                    path, size, count = f"{name}-{files:04d}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{base}/{path}", compression=None)
                    info = b"software: callweave\r\nformat: WARC File Format 1.1\r\n"
                    put(_record("warcinfo", f"urn:uuid:{uuid.uuid4()}", {"Content-Type": "application/warc-fields", "WARC-Filename": path}, info))
                for record in records(page_id, url, html.encode(), refers, f"{task.partitionId()}-{row}", segment_bytes):
                    size += put(record)
                    count += 1
                row += 1
                if size >= file_bytes:
                    yield closed()
                    out, files = None, files + 1
        if out is not None:
            yield closed()

    return settle(map_arrow(with_roles(pages, min_bytes), run, "path string, records long"))


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, intact): a row for each record but warcinfo, its
    segments joined. The files are read once."""
    files = manifest.count()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = filesystem(folder)
        schema = pa.schema([("done", pa.bool_()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
                            ("refers_to", pa.int64()), ("intact", pa.bool_()), ("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("block", pa.binary())])
        rows, held = [], 0
        for b in batches:
            for path in b.column("path").to_pylist():
                with store.open_input_stream(f"{base}/{path}", compression=None) as raw, io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20) as stream:
                    for headers, block in parsed(stream):
                        if headers["warc-type"] == "warcinfo":
                            continue
                        if "warc-segment-number" not in headers:
                            rows.append(_result(headers, block))
                        else:
                            first = headers["warc-type"] != "continuation"
                            origin = headers["warc-record-id"] if first else headers["warc-segment-origin-id"]
                            total = headers.get("warc-segment-total-length")
                            rows.append({"done": False, "page_id": _page(origin), "payload_digest": headers.get("warc-payload-digest"), "record_type": headers["warc-type"],
                                         "origin": origin, "segment": int(headers["warc-segment-number"]), "total": total and int(total), "block": block})
                            held += len(block)
                        if len(rows) >= 5000 or held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    found = settle(manifest.select("path").repartition(max(1, files), "path").mapInArrow(parse, READ))
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact"]
    parts = found.where("not done").groupBy("origin").agg(
        F.sort_array(F.collect_list(F.struct("segment", "total", "block"))).alias("parts"),
        F.max(F.when(F.col("segment") == 1, F.col("payload_digest"))).alias("digest"),
        F.max(F.when(F.col("segment") == 1, F.col("record_type"))).alias("kind"),
    )
    numbers, total = F.transform("parts", lambda p: p["segment"]), F.element_at("parts", -1)["total"]
    sound = (numbers == F.sequence(F.lit(1), F.size("parts"))) & (total == F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + F.octet_length(p["block"])))
    # fetched, then joined: segments of one record, in order
    whole = parts.select("origin", "digest", F.coalesce("kind", F.lit("continuation")).alias("kind"), F.coalesce(sound, F.lit(False)).alias("sound"), F.transform("parts", lambda p: p["block"]).alias("blocks"))

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("intact", pa.bool_())])
        for b in batches:
            rows = []
            for r in b.to_pylist():
                headers = {"warc-type": r["kind"], "warc-record-id": r["origin"], "warc-payload-digest": r["digest"] or ""}
                rows.append({k: v for k, v in _result(headers, b"".join(r["blocks"]), r["sound"]).items() if k != "done"})
            yield pa.RecordBatch.from_pylist(rows, schema)

    joined = whole.mapInArrow(assemble, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean")
    every = found.where("done").select(*names).union(joined.select(*names))
    every = settle(every)
    origin = every.where("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to")).agg(
        F.max_by(F.struct("payload_bytes", "payload_digest", "intact"), "payload_digest").alias("o"))
    visits = every.where("record_type = 'revisit'").drop("payload_bytes").join(origin, "refers_to", "left")
    visits = visits.select(
        "page_id", F.col("o.payload_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to",
        F.coalesce(F.col("intact") & F.col("o.intact") & (F.col("o.payload_digest") == F.col("payload_digest")), F.lit(False)).alias("intact"),
    )
    return every.where("record_type <> 'revisit'").select(*names).union(visits.select(*names))


def digest(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """The contract's columns: all pages written to archives, the archives read back and removed."""
    spark: SparkSession = pages.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    out = read(write(pages, folder, min_bytes), folder)
    store, base = filesystem(folder)
    if store.get_file_info(base).type != fs.FileType.NotFound:
        store.delete_dir(base)  # what was read from it is in the shared folder already
    return out
