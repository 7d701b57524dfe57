"""WARC (operator 8): writing archives and assembling their transactions.

Each capture becomes three records - request, response or revisit, metadata -
that name each other through WARC-Concurrent-To; a revisit names the response that it
repeats by WARC-Refers-To, target URI and date. Reading parses every record of
every archive and joins the three kinds through the concurrent-to identifier into one nested
row for each capture, and revisits with what they refer to.

Payload copies: of captures with equal payloads of at least ``min_bytes`` bytes,
the one with the smallest page_id is a response and the others are revisits of
it; smaller payloads are always responses.

Defined results: null html is the empty payload; null url is the empty URI; a
repeated row is a capture of its own (repeated rows of the response's page_id
all are responses, and revisits of them name its URI and date, but no record); null page_ids come last among copies, and a payload that
only rows without page_id have is always a response. Other columns are ignored.

Scale: archives are closed at ``archive_bytes``, so a reader holds one of them
at a time. Digests are computed in the JVM; copies are found on digest rows with
a map-side minimum, and only digests that recur are joined back: broadcast if at most
``broadcast_rows`` do, so that pages are not shuffled. The writer's
manifest is cut in the shared folder: a lost task writes files under new names,
and only names of tasks that succeeded are read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import common as C

DATE = "2024-01-01T00:00:00Z"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, record_id: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One WARC/1.1 record."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}"]
    lines += [f"{k}: {v}" for k, v in headers]
    return ("\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""])).encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of one gzip-member-per-record archive."""
    view, at = memoryview(data), 0
    while at < len(data):
        z, parts = zlib.decompressobj(31), []
        while not z.eof:  # in pieces, so that what follows the member is not copied for every member
            if at >= len(data):
                raise ValueError("the archive ends inside a record")
            parts.append(z.decompress(view[at : at + 65536]))
            at = min(len(data), at + 65536) - len(z.unused_data)
        raw = b"".join(parts)
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        yield headers, rest[: int(headers["content-length"])]


def _uri(url: str) -> str:
    """Header values are one line."""
    return "".join(c if c.isprintable() and c != " " else "%" + "%".join(f"{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url)


def original_id(digest: str, page_id: int) -> str:
    """Record id of the one capture of a payload that its copies refer to: the same in every task."""
    return uuid.uuid5(uuid.NAMESPACE_URL, f"urn:sha1:{digest}:{page_id}").urn


def _members(unit: uuid.UUID, n: int, page_id, url: str, payload: bytes, original: dict | None) -> list[bytes]:
    """The three records of a capture. original: of a payload with copies, page_id, url and rows of the capture that they refer to."""
    digest, uri = base32_sha1(payload), _uri(url)
    ids = {k: uuid.uuid5(unit, f"{n}:{k}").urn for k in ("request", "response", "metadata")}
    is_copy = original is not None and page_id != original["page_id"]
    named = original is not None and original["rows"] == 1  # repeated rows of the original have no common record
    if named and not is_copy:
        ids["response"] = original_id(digest, page_id)
    path = uri.split("://", 1)[-1]
    path = "/" + path.partition("/")[2]
    host = uri.split("://", 1)[-1].partition("/")[0]
    target = [("WARC-Target-URI", uri)]
    tied = [("WARC-Concurrent-To", f"<{ids['response']}>")]
    asked = record("request", ids["request"], [*target, *tied, ("Content-Type", "application/http;msgtype=request")], f"GET {path} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode())
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    shared = [*target, ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    if not is_copy:
        got = record("response", ids["response"], shared, http + payload)
    else:
        profile = ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        first = [("WARC-Refers-To", f"<{original_id(digest, original['page_id'])}>")] * named
        first += [("WARC-Refers-To-Target-URI", _uri(original["url"])), ("WARC-Refers-To-Date", DATE)]
        got = record("revisit", ids["response"], [*shared, profile, *first], http)
    fields = [("pageId", "" if page_id is None else page_id)]
    meta = record("metadata", ids["metadata"], [*target, *tied, ("Content-Type", "application/warc-fields")], "".join(f"{k}: {v}\r\n" for k, v in fields).encode())
    return [asked, got, meta]


def write(pages: DataFrame, folder: str, archive_bytes: int = 16 << 20, min_bytes: int = 0, broadcast_rows: int = 200_000) -> DataFrame:
    """Writes archives below the folder; their manifest (path, captures, bytes)."""
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    base = base.withColumn("digest", F.unhex(F.sha1(F.col("html").cast("binary"))))
    rows = base.filter(F.octet_length("html") >= min_bytes).groupBy("digest", "page_id").agg(F.min("url").alias("url"), F.count("*").alias("rows"))
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url", "rows"))).alias("original")
    again = C.cut(rows.groupBy("digest").agg(first, F.sum("rows").alias("n")).filter("n > 1 and original is not null"))
    if again.limit(broadcast_rows + 1).count() <= broadcast_rows:
        tied = base.join(F.broadcast(again.drop("n")), "digest", "left")  # pages stay where they are
    else:
        tied = C.join_by_key(base, again, "digest", F.xxhash64("page_id", "url"))
    tied = tied.select("page_id", "url", "html", "original")

    kind = C.schema_of("path string, captures long, bytes long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = C.filesystem(folder)
        fs.create_dir(at, recursive=True)
        schema = C.arrow_schema(kind)
        buffer, unit, n = io.BytesIO(), uuid.uuid4(), 0

        def close() -> pa.RecordBatch:
            name = f"{unit.hex}.warc.gz"
            with fs.open_output_stream(f"{at}/{name}", compression=None) as out:
                out.write(buffer.getvalue())
            return C.to_batch({"path": [f"{folder}/{name}"], "captures": [n], "bytes": [buffer.tell()]}, schema)

        for batch in batches:
            for page_id, url, html, original in zip(*(C.column(batch, c).to_pylist() for c in ("page_id", "url", "html", "original"))):
                for raw in _members(unit, n, page_id, url, html.encode("utf-8"), original):
                    z = zlib.compressobj(1, zlib.DEFLATED, 31)
                    buffer.write(z.compress(raw) + z.flush())
                n += 1
                if buffer.tell() >= archive_bytes:
                    yield close()
                    buffer, unit, n = io.BytesIO(), uuid.uuid4(), 0
        if n:
            yield close()

    return C.cut(tied.mapInArrow(run, kind))


def read_records(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """A row for each record of the archives: record_id, concurrent_to, type, uri, digest, payload_bytes, payload, refers_to, refers_uri, refers_date, fields."""
    kind_of = C.schema_of("record_id string, concurrent_to string, type string, uri string, date string, digest string, payload_bytes long, payload binary, refers_to string, refers_uri string, refers_date string, fields map<string,string>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = C.arrow_schema(kind_of)
        for batch in batches:
            for path in C.column(batch, "path").to_pylist():
                fs, at = C.filesystem(path)
                with fs.open_input_stream(at, compression=None) as f:
                    data = f.read()
                rows = []
                for h, block in parse(data):
                    kind, fields, payload = h["warc-type"], [], None
                    http, _, body = block.partition(b"\r\n\r\n")
                    if kind == "metadata":
                        fields = [(k, v.strip()) for k, _, v in (x.partition(":") for x in block.decode().split("\r\n") if x)]
                    elif kind == "response":
                        payload = body
                        if f"sha1:{base32_sha1(body)}" != h["warc-payload-digest"]:
                            raise ValueError(f"payload of {h['warc-record-id']} does not match its digest")
                    digest = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    tied = h.get("warc-concurrent-to")
                    rows.append((h["warc-record-id"].strip("<>"), tied and tied.strip("<>"), kind, h.get("warc-target-uri"), h["warc-date"], digest, None if payload is None else len(payload), payload if with_payload else None, h.get("warc-refers-to", "").strip("<>") or None, h.get("warc-refers-to-target-uri"), h.get("warc-refers-to-date"), fields))
                    if len(rows) == 512:
                        yield C.to_batch(dict(zip(schema.names, map(list, zip(*rows)))), schema)
                        rows = []
                if rows:
                    yield C.to_batch(dict(zip(schema.names, map(list, zip(*rows)))), schema)

    archives = max(1, manifest.count())
    return manifest.repartition(min(archives, max(1000, archives // 8))).mapInArrow(run, kind_of)  # by number: small manifests would otherwise be read by one task


def assemble(records: DataFrame) -> DataFrame:
    """One nested row for each capture: the response or revisit, its request and its metadata.

    The records are read once and cut; requests and metadata then join the
    response or revisit that their concurrent-to identifier names.
    """
    records = C.cut(records)
    whole = F.struct("record_id", "type", "uri", "date", "digest", "payload_bytes", "payload", "refers_to", "refers_uri", "refers_date")
    captures = records.filter(F.col("type").isin("response", "revisit")).select(F.col("record_id").alias("capture_id"), whole.alias("response"))
    requests = records.filter("type = 'request'").select(F.col("concurrent_to").alias("capture_id"), F.struct("record_id", "uri", "date").alias("request"))
    metadata = records.filter("type = 'metadata'").select(F.col("concurrent_to").alias("capture_id"), F.struct("record_id", "fields").alias("metadata"))
    return captures.join(requests, "capture_id", "left").join(metadata, "capture_id", "left")


def resolve(captures: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (a page_id) of each capture.

    A revisit is joined with the response that it refers to: by record id where
    it names one, else by payload digest, URI and date.
    """
    named = lambda id_, uri, date: F.when(id_.isNotNull(), id_).otherwise(F.concat_ws(" ", F.col("response.digest"), uri, date))
    key = lambda c: F.unhex(F.md5(c.cast("binary")))
    r = lambda k: F.col(f"response.{k}")
    page = F.expr("try_cast(metadata.fields['pageId'] as bigint)")
    plain = captures.select(
        "capture_id", page.alias("page_id"), r("payload_bytes").alias("bytes"), r("digest").alias("payload_digest"), r("type").alias("record_type"),
        F.when(r("type") == "revisit", key(named(r("refers_to"), r("refers_uri"), r("refers_date")))).alias("to"),
        F.when(r("type") == "response", F.array(key(r("record_id")), key(F.concat_ws(" ", r("digest"), r("uri"), r("date"))))).alias("names"),
    )
    plain = C.cut(plain)
    wanted = plain.filter("to is not null").groupBy("to").agg(F.count("*").alias("n"))
    originals = plain.filter("names is not null").select(F.explode("names").alias("to"), F.struct("page_id", "bytes").alias("original"))
    targets = wanted.join(originals, "to").groupBy("to").agg(F.min("original").alias("original"), F.first("n").alias("n"))
    joined = C.join_by_key(plain, targets, "to", F.xxhash64("capture_id"))
    return joined.select("page_id", F.coalesce("bytes", "original.bytes").alias("payload_bytes"), "payload_digest", "record_type", F.col("original.page_id").alias("refers_to"))


def op8_warc(spark, sf_dir: str) -> DataFrame:
    manifest = write(C.table(spark, sf_dir, "pages"), C.new_folder(spark, "warc"))
    return resolve(assemble(read_records(manifest, with_payload=False)))
