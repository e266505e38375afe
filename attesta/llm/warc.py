"""WARC archives: writing, reading, and reassembly of segmented records.

Writer: every page becomes a record whose block is an HTTP message with a chunked body. Of the pages with
equal payloads the one with the smallest page_id is a response, the others are revisits that refer to it
and carry headers alone. A block over ``SEGMENT_BYTES`` is cut into a first segment and continuation records.
Each record is a gzip member; a file ends after ``FILE_BYTES``.

Reader: each file is opened once, by a task of its own, and read record by record. Segments are grouped by the identifier of their origin, ordered by
segment number and checked: numbers without a gap, the stated total length, then the chunk framing, the payload
digest and length. A record that fails a check is returned with the reason in ``fault``.

Results: a null html is an empty payload; empty payloads are payloads like others; rows that
share the smallest page_id of a payload are all responses; a null page_id comes last. No row is left out.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import Output, new_folder, one_file_a_task, open_input
from .graph import stored

CHUNK_BYTES = 16 << 10
SEGMENT_BYTES = 32 << 10
FILE_BYTES = 64 << 20
CRLF = b"\r\n"
#: Fixed value: the profile that the standard names for revisits by digest.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def chunked(payload: bytes) -> bytes:
    """The payload in chunked transfer framing."""
    parts = [payload[k : k + CHUNK_BYTES] for k in range(0, len(payload), CHUNK_BYTES)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def dechunked(framed: bytes) -> bytes:
    """The payload of a chunked body; ValueError if the framing is broken or cut off."""
    out, at = [], 0
    while True:
        end = framed.index(CRLF, at)
        size = int(framed[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            rest = framed[at:]  # trailer fields may stand before the last empty line
            if rest != CRLF and not rest.endswith(CRLF + CRLF):
                raise ValueError("the chunked body does not end")
            return b"".join(out)
        if framed[at + size : at + size + 2] != CRLF:
            raise ValueError("a chunk has another length than stated")
        out.append(framed[at : at + size])
        at += size + 2


def record(fields: dict[str, object], block: bytes) -> bytes:
    """One record as a gzip member."""
    head = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields.items() if v is not None), f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + CRLF + CRLF + block + CRLF + CRLF) + pack.flush()


def one_line(url: str | None) -> str | None:
    return (url or "").translate({10: "%0A", 13: "%0D"}) or None


def page_records(page: dict) -> Iterator[bytes]:
    """The records of one page: one, or a first segment and its continuations."""
    revisit = page["revisit"]
    payload = b"" if revisit else (page["html"] or "").encode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    block = http if revisit else http + chunked(payload)
    segments = [block[k : k + SEGMENT_BYTES] for k in range(0, len(block), SEGMENT_BYTES)]
    identifier = f"<urn:uuid:{uuid.uuid4()}>"
    fields = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": identifier,
        "WARC-Date": DATE,
        "WARC-Target-URI": one_line(page["url"]),
        "WARC-Payload-Digest": "sha1:" + page["payload_digest"],
        "WARC-Page-ID": page["page_id"],
        "WARC-Payload-Length": page["payload_bytes"],
        "Content-Type": "application/http;msgtype=response",
    }
    if revisit:
        fields |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To-Target-URI": one_line(page["refers_to_url"]), "WARC-Refers-To-Page": page["refers_to"]}
    if len(segments) > 1:
        fields["WARC-Segment-Number"] = 1
    yield record(fields, segments[0])
    for number, segment in enumerate(segments[1:], 2):
        more = {
            "WARC-Type": "continuation",
            "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>",
            "WARC-Date": DATE,
            "WARC-Segment-Origin-ID": identifier,
            "WARC-Segment-Number": number,
            "WARC-Segment-Total-Length": len(block) if number == len(segments) else None,
        }
        yield record(more, segment)


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html, payload_bytes, digest, and for revisits the page and url that they refer to.

    Only payloads that occur on several pages are joined back, as one row each and without the html, so pages are
    shuffled only where that table is too large for Spark to broadcast; then large groups are split.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", "html", F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload).alias("digest"))
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")).alias("first")
    groups = rows.where(F.col("payload_bytes") >= least_bytes).groupBy("digest").agg(first, F.count("*").alias("n")).where("n > 1")
    shared = stored(groups.select("digest", F.lit(True).alias("shared"), F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url")))
    other = F.col("shared").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return rows.join(shared, "digest", "left").select(
        "page_id", "url", "html", "payload_bytes", "digest", F.coalesce(other, F.lit(False)).alias("revisit"),
        F.when(other, F.col("first_id")).alias("refers_to"), F.when(other, F.col("first_url")).alias("refers_to_url"),
    )


def write(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Writes the archives of ``pages`` and returns one (uri, records) row for each file."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n = None, 0
        for batch in batches:
            for k in range(batch.num_rows):
                page = {name: batch.column(name)[k].as_py() for name in batch.schema.names}
                page["payload_digest"] = base64.b32encode(bytes.fromhex(page["digest"])).decode()
                out = out or Output(folder, ".warc.gz")
                for data in page_records(page):
                    out.write(data)
                    n += 1
                if out.size >= FILE_BYTES:
                    yield pa.RecordBatch.from_pydict({"uri": [out.close()], "records": [n]})
                    out, n = None, 0
        if out:
            yield pa.RecordBatch.from_pydict({"uri": [out.close()], "records": [n]})

    return stored(with_revisits(pages, least_bytes).mapInArrow(task, "uri string, records bigint"))


def records(uri: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of one file, compressed by member or plain."""
    with open_input(uri) as stream:
        yield from parsed(_inflated(stream))


def _inflated(stream) -> Iterator[bytes]:
    unpack = None
    while data := stream.read(1 << 20):
        while data:
            if unpack is None:
                unpack = zlib.decompressobj(31)
            yield unpack.decompress(data)
            data = unpack.unused_data
            if unpack.eof:
                unpack = None
    if unpack is not None and not unpack.eof:
        raise ValueError("the file ends within a record")


def parsed(parts: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    held = bytearray()

    def fill(n: int) -> bool:
        while len(held) < n:
            more = next(parts, None)
            if more is None:
                return False
            held.extend(more)
        return True

    while fill(1):
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not fill(len(held) + 1):
                raise ValueError("a record header does not end")
        version, *head = held[:end].decode("utf-8", "replace").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head)}
        size = int(fields["content-length"])
        if not fill(end + 4 + size + 4):
            raise ValueError("a record is shorter than stated")
        yield fields, bytes(held[end + 4 : end + 4 + size])
        del held[: end + 4 + size + 4]


FIELDS = {
    "record_id": "warc-record-id", "type": "warc-type", "url": "warc-target-uri", "digest": "warc-payload-digest", "page_id": "warc-page-id",
    "payload_length": "warc-payload-length", "refers_to_page": "warc-refers-to-page", "refers_to": "warc-refers-to-target-uri",
    "origin": "warc-segment-origin-id", "number": "warc-segment-number", "total": "warc-segment-total-length",
}


def read_records(manifest: DataFrame) -> DataFrame:
    """Every record of the files named in ``uri``: header fields as text, and the block."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*FIELDS, "block"]
        for batch in batches:
            for uri in batch.column("uri").to_pylist():
                rows, size = [], 0
                for fields, block in records(uri):
                    rows.append((*(fields.get(f) for f in FIELDS.values()), block))
                    size += len(block)
                    if size > 4 << 20:
                        yield _batch(rows, names)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows, names)

    return one_file_a_task(manifest.select("uri"), "uri").mapInArrow(task, ", ".join(f"{c} string" for c in FIELDS) + ", block binary")


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.string()] * (len(names) - 1) + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def _payload(block: bytes) -> bytes:
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("the HTTP header does not end")
    is_chunked = any(line.lower().replace(b" ", b"") == b"transfer-encoding:chunked" for line in head.split(CRLF))
    return dechunked(body) if is_chunked and body else body


#: What is known of a response or revisit; a segment waits as ``block`` with its number, stated total and the record it belongs to.
WHOLE = "record_id string, type string, url string, page_id string, refers_to_page string, refers_to string, payload binary, payload_bytes bigint, payload_digest string, fault string"
WAITING = "first_id string, segment int, total string, stated string, stated_length string, block binary"


def _number(text: str | None) -> int | None:
    return int(text) if text and text.isdigit() else None


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "binary": pa.binary(), "bigint": pa.int64(), "int": pa.int32()}
    fields = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(zip(*rows), fields)], [n for n, _ in fields])


def decoded(head: dict, block: bytes, fault: str | None, payloads: bool) -> tuple:
    """The ``WHOLE`` columns of a record."""
    payload, stated, length = b"", (head["digest"] or "").removeprefix("sha1:"), _number(head["payload_length"])
    size, digest = length or 0, stated
    if head["type"] != "revisit" and not fault:
        try:
            payload = _payload(block)
            size, digest = len(payload), sha1_base32(payload)
            fault = "digest differs" if stated and digest != stated else "length differs" if length is not None and length != size else None
        except ValueError as broken:
            fault = str(broken)
    kept = payload if payloads else None
    return (head["record_id"], head["type"], head["url"], head["page_id"], head["refers_to_page"], head["refers_to"], kept, size, digest, fault)


def reassemble(read: DataFrame, payloads: bool = True) -> DataFrame:
    """One row per response or revisit: its fields, payload, payload_bytes, payload_digest and fault (null if sound).

    The records are read once: whole ones are decoded where they are, segments are set aside as they are, and both are
    stored. Only the segments are then dealt by their record. ``payloads=False`` checks payloads but does not keep them.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, nothing = f"{WHOLE}, {WAITING}", (None,) * 6
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                made = []
                for r in batch.slice(k, 256).to_pylist():
                    if r["number"] is not None:
                        of, head = r["origin"] or r["record_id"], (r["record_id"], r["type"], r["url"], r["page_id"], r["refers_to_page"], r["refers_to"])
                        made.append((*head, None, None, None, None, of, _number(r["number"]), r["total"], r["digest"], r["payload_length"], r["block"]))
                    elif r["type"] in ("response", "revisit", "resource"):
                        made.append(decoded(r, r["block"], None, payloads) + nothing)
                if made:
                    yield _rows(made, schema)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come ordered by record and number; one record at a time is held."""
        own: list[dict] = []
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                if own and own[0]["first_id"] != row["first_id"]:
                    yield _rows([put_together(own)], WHOLE)
                    own = []
                own.append(row)
        if own:
            yield _rows([put_together(own)], WHOLE)

    def put_together(own: list[dict]) -> tuple:
        block = b"".join(r["block"] for r in own)
        total = own[-1]["total"]
        fault = None
        if [r["segment"] for r in own] != list(range(1, len(own) + 1)):
            fault = "segments are missing or repeated"
        elif _number(total) != len(block):
            fault = "the total length differs"
        return decoded(own[0] | {"digest": own[0]["stated"], "payload_length": own[0]["stated_length"]}, block, fault, payloads)

    found = stored(read.mapInArrow(first, f"{WHOLE}, {WAITING}"))
    whole = found.where("first_id IS NULL").select(*[c.split()[0] for c in WHOLE.split(", ")])
    segments = found.where("first_id IS NOT NULL").drop("payload", "payload_bytes", "payload_digest", "fault")
    ordered = segments.repartition("first_id").sortWithinPartitions("first_id", "segment")
    return whole.unionByName(ordered.mapInArrow(joined, WHOLE))


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes ``pages`` as archives, reads them back, and returns what the archives say of each page."""
    manifest = write(pages, new_folder(pages.sparkSession, "warc"), least_bytes)
    found = reassemble(read_records(manifest), payloads=False)
    return found.select(
        F.col("page_id").cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.col("type").alias("record_type"),
        F.col("refers_to_page").cast("long").alias("refers_to"),
        "fault",
    )
