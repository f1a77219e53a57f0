"""WARC archives: records written in segments, read back and put together again.

Writing: a page is a response whose HTTP block has chunked transfer framing. A block longer than a segment goes on in
continuation records that name the first one's id, their number, and at the end the length of the whole block. A page
whose payload another page already gives is a revisit that names that page's record and URI. Record ids are UUIDs of page,
URI and digest, so that a retried task writes the same ones and a revisit knows the id that it refers to. Page numbers are
extension fields. Records leave through Spark's text writer with the four bytes that end a record as line separator, so any
Hadoop store works; a file is one gzip stream, and its records, none longer than a segment, are at most FILE_BYTES.

Reading: files are parsed by Content-Length as they are decompressed. Pieces are shuffled by the id of their origin and
sorted by segment number, then joined, checked against the total length, freed of the framing, and checked against the
digest. A record of one piece is decoded where it is read and only its digest moves. A record that was written more than
once, with one id, comes back as often.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import textbuf as T
from strandline.sources.shared import ensure_checkpoint_dir, importable, passing

END = "\r\n\r\n"
#: Bytes of records in a file at most, and what a header may take of them.
FILE_BYTES, HEADER = 400_000_000, 3_000


def cut(data: bytes, size: int) -> Iterator[bytes]:
    """Pieces of at most ``size`` bytes (at least 4), never inside a UTF-8 character."""
    at = 0
    while at < len(data):
        stop = min(at + size, len(data))
        while stop < len(data) and data[stop] & 0xC0 == 0x80:
            stop -= 1
        yield data[at:stop]
        at = stop


def chunked(payload: bytes, size: int) -> bytes:
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in cut(payload, size)) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload in chunked framing; chunk extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        n = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if not n:
            return b"".join(out)
        if body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        out.append(body[at : at + n])
        at += n + 2


def _record(fields: list[tuple[str, object]], block: bytes) -> str:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))] if v is not None)
    return f"WARC/1.1\r\n{head}\r\n{block.decode()}"


def record_id(page_id: int | None, uri: str, digest: str) -> str:
    """The id of a page's response, the same in every run."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest} {uri}')}>"


def target_uri(url: str | None, page_id: int | None) -> str:
    """``url`` with all that may not stand in a header line in percent signs; a page without one is named by its number. What is
    too long for a header is cut and goes by its digest."""
    uri = quote(url, safe="".join(map(chr, range(33, 127)))) if url else f"urn:page:{page_id}"
    return uri if len(uri) <= 1_000 else f"{uri[:900]}#sha1:{hashlib.sha1(uri.encode()).hexdigest()}"


def page_records(page_id: int | None, url: str | None, payload: str, digest: str, refers_to: tuple[int, str | None] | None, serial: str, segment: int, chunk: int) -> Iterator[str]:
    """The records of one page; blocks end before the separator that the writer adds. refers_to: page and url of the response
    that a revisit repeats. ``serial`` tells apart what is no response to refer to."""
    uri = target_uri(url, page_id)
    origin = record_id(page_id, uri, digest)
    common = [("WARC-Date", "2000-01-01T00:00:00Z"), ("WARC-Target-URI", uri), ("WARC-Page-ID", page_id), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(payload.encode())
        first = target_uri(refers_to[1], refers_to[0])
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", record_id(page_id, f"{uri} {serial}", digest)), *common, ("WARC-Refers-To", record_id(refers_to[0], first, digest)), ("WARC-Refers-To-Target-URI", first), ("WARC-Refers-To-Page-ID", refers_to[0]), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")], block)
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload.encode(), chunk)
    pieces = list(cut(block, segment))
    yield _record([("WARC-Type", "response"), ("WARC-Record-ID", origin), *common, ("WARC-Segment-Number", 1 if len(pieces) > 1 else None)], pieces[0])
    for n, piece in enumerate(pieces[1:], 2):
        total = len(block) if n == len(pieces) else None
        yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", record_id(page_id, f"{uri} {n}", digest)), *common[:2], ("WARC-Segment-Origin-ID", origin), ("WARC-Segment-Number", n), ("WARC-Segment-Total-Length", total)], piece)


def write_archives(pages: DataFrame, path: str, least: int = 1000, segment: int = 16_384, chunk: int = 4_096) -> None:
    """Archives of ``pages`` (page_id, html, and url if there is one) under ``path``; other columns are ignored.

    Of equal payloads of at least ``least`` bytes, the greatest page_id is the response; a null page_id never is. Rows
    that repeat that page_id are responses too, and revisits name the one with the greatest url. A null html is an empty
    payload, a null or empty url is named by the page_id.
    """
    importable(pages.sparkSession)
    payload = F.coalesce("html", F.lit(""))
    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    rows = pages.select("page_id", url.alias("url"), payload.alias("payload"), F.sha1(F.encode(payload, "UTF-8")).alias("digest"), F.octet_length(payload).alias("n"))
    heads = pages.select("page_id", url.alias("url"), F.sha1(F.encode(payload, "UTF-8")).alias("digest"), F.octet_length(payload).alias("n"))
    firsts = heads.where(F.col("n") >= least).groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("x"), F.count(F.lit(1)).alias("c")).where("c > 1").select("digest", F.col("x.page_id").alias("chosen"), F.col("x.url").alias("chosen_url"))
    told = rows.join(firsts, "digest", "left").withColumn("revisit", (F.col("n") >= least) & F.col("chosen").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("chosen")))

    def run(stream):
        from pyspark import TaskContext

        part, serial = TaskContext.get().partitionId(), 0
        for batch in stream:
            out, held = [], 0
            for page_id, url, payload, digest, revisit, chosen, chosen_url in zip(*(batch.column(c) for c in names), strict=True):
                page, text = page_id.as_py(), payload.as_py()
                refers_to = (chosen.as_py(), chosen_url.as_py()) if revisit.as_py() else None
                records = list(page_records(page, url.as_py(), text, digest.as_py(), refers_to, f"{part}.{serial}", segment, chunk))
                out += records
                held += sum(map(len, records))
                serial += 1
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
                    out, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    names = ["page_id", "url", "payload", "digest", "revisit", "chosen", "chosen_url"]
    per_file = max(FILE_BYTES // (segment + HEADER), 1)
    lines = told.select(*names).mapInArrow(T.tidy(run), "value string")
    lines.write.mode("overwrite").option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record, by Content-Length."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("no record starts here")
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            k, _, v = line.decode().partition(":")
            fields[k.strip().lower()] = v.strip()
        block = stream.read(int(fields["content-length"]))
        if len(block) != int(fields["content-length"]):
            raise ValueError("the file ends within a record")
        yield fields, block


def payload_of(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    return dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def _checked(block: bytes, digest: str) -> int:
    payload = payload_of(block)
    if hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError("the payload does not have its digest")
    return len(payload)


PIECES = "origin string, segment long, total long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, block binary"


def _pieces(stream):
    names = [x.strip().split(" ")[0] for x in PIECES.split(",")]
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    types = [kinds[x.strip().split(" ")[1]] for x in PIECES.split(",")]
    number = lambda f, k: int(f[k]) if k in f else None

    def flush(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    for batch in stream:
        for i in range(batch.num_rows):
            content = batch.column("content")[i].as_buffer().to_pybytes()
            raw = io.BytesIO(content)
            rows, held = [], 0
            for f, block in parse(io.BufferedReader(gzip.GzipFile(fileobj=raw)) if content[:2] == b"\x1f\x8b" else raw):
                kind, digest = f["warc-type"], f.get("warc-payload-digest", "").removeprefix("sha1:") or None
                row = [f.get("warc-segment-origin-id", f["warc-record-id"]), number(f, "warc-segment-number") or 1, number(f, "warc-segment-total-length"), number(f, "warc-page-id"), None, digest, kind, number(f, "warc-refers-to-page-id"), None]
                if kind == "revisit":
                    length = [x for x in block.split(b"\r\n") if x.lower().startswith(b"content-length:")]
                    row[4] = int(length[0].split(b":")[1]) if length else None
                elif kind == "response" and "warc-segment-number" not in f:
                    row[4] = _checked(block, digest)
                elif kind in ("response", "continuation"):
                    row[8] = block
                else:
                    continue
                rows.append(row)
                held += len(row[8] or b"")
                if len(rows) >= 5000 or held > 8 << 20:
                    yield flush(rows)
                    rows, held = [], 0
            if rows:
                yield flush(rows)


def _joined(stream):
    """Rows sorted by (origin, segment) to whole records; only one record is held, however often it was written."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    open_, parts, times = None, [], []

    def close():
        if open_ is None:
            raise ValueError("a continuation has no first segment")
        if [p["segment"] for p in parts] != list(range(1, len(parts) + 1)) or len(set(times)) > 1:
            raise ValueError(f"segments of {open_['origin']} are missing")
        block = b"".join(p["block"] for p in parts)
        if parts[-1]["total"] != len(block):
            raise ValueError(f"{open_['origin']} has not its total length")
        return [[open_["page_id"], _checked(block, open_["payload_digest"]), open_["payload_digest"], "response", None]] * times[0]

    for batch in stream:
        out = []
        for row in batch.to_pylist():
            if parts and parts[-1]["origin"] != row["origin"]:
                out += close()
                open_, parts, times = None, [], []
            if row["block"] is None:
                out.append([row[n] for n in names])
                continue
            if parts and parts[-1]["segment"] == row["segment"]:
                if parts[-1]["block"] != row["block"]:
                    raise ValueError(f"{row['origin']} has two segments {row['segment']}")
                times[-1] += 1
                continue
            if row["segment"] == 1:
                open_ = row
            parts.append(row)
            times.append(1)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)
    if parts:
        out = close()
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of all pages in the archives under ``path``.

    A missing segment, a wrong total, a broken frame or digest fails the read.
    """
    files = importable(spark).read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    pieces = files.mapInArrow(T.tidy(_pieces), PIECES)
    return pieces.repartition("origin").sortWithinPartitions("origin", "segment").mapInArrow(T.tidy(_joined), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Writes ``pages`` to the shared folder and reads the archives back; they are deleted when the driver ends."""
    spark = pages.sparkSession
    path = passing(spark, f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}")
    write_archives(pages, path, **options)
    return read_archives(spark, path)


SQL = """WITH p AS (SELECT page_id, strlen(coalesce(html,'')) AS n, sha1(coalesce(html,'')) AS d FROM pages),
  g AS (SELECT d, max(page_id) AS chosen FROM p WHERE n >= 1000 GROUP BY d HAVING count(*) > 1)
  SELECT page_id, n::BIGINT AS payload_bytes, p.d AS payload_digest, CASE WHEN n >= 1000 AND chosen IS NOT NULL AND page_id IS DISTINCT FROM chosen THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN n >= 1000 AND chosen IS NOT NULL AND page_id IS DISTINCT FROM chosen THEN chosen END AS refers_to FROM p LEFT JOIN g ON p.d = g.d"""
