"""WARC archives as a chunked record table.

Each record is stored as rows (archive, record_id, chunk_no, last, sha1_so_far, data): chunk
0 holds the WARC and HTTP headers, later chunks at most ``CHUNK`` bytes of the payload, each
with the digest of the payload up to its end.  ``data`` is compressed, one gzip member for
each record, flushed at each chunk: concatenating an archive's ``data`` in the order of the
key gives a valid ``.warc.gz`` file.  Neither writer nor reader holds more of a record's
WARC form than one chunk, and a reader detects the first damaged chunk.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from volpanel.llm.frames import arrow_map, cut, discard, stored

CHUNK = 1 << 16
HEAD = 1 << 26  # plain bytes of a record's headers, a long address included
BATCH_BYTES = 1 << 22
LEVEL = 1
CHUNKS = "archive int, record_id string, page_id long, chunk_no int, last boolean, sha1_so_far string, data binary"
RECORDS = "record_id string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to_id string, intact boolean, whole boolean"
FIXED_DATE = "2024-01-01T00:00:00Z"
END = b"\r\n\r\n"


def record_uuid(page_id: int | None, digest: str, copy: int) -> str:
    return str(uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}:{digest}:{copy}"))


def plan(pages: DataFrame) -> DataFrame:
    """Thin table (page_id, sha1, keeper), one row per distinct page and payload.

    Of the pages with equal payloads that of the largest page_id is kept, the others refer
    to it.  Only digests are shuffled; Spark can split a hot digest, since the keepers come
    from a partial aggregate and the join back may be skewed.
    """
    thin = cut(_with_digest(pages).select("page_id", "sha1", F.octet_length("html").alias("bytes")).distinct())
    keepers = thin.groupBy("sha1", "bytes").agg(F.max("page_id").alias("keeper"))
    return thin.join(keepers, ["sha1", "bytes"]).select("page_id", "sha1", "keeper")


def _with_digest(pages: DataFrame) -> DataFrame:
    html = F.coalesce(F.col("html"), F.lit(""))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url"), F.lit("")).alias("url"), html.alias("html"), F.sha1(F.encode(html, "UTF-8")).alias("sha1"))


def base32(sha1: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1)).decode()


def _header(url: str, page_id: int | None, copy: int, digest: str, size: int, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{record_uuid(page_id, digest, copy)}>",
        f"WARC-Date: {FIXED_DATE}",
        "WARC-Target-URI: " + "".join(url.split()),
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + (size if refers_to is None else 0)}",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{record_uuid(refers_to, digest, 0)}>"]
    return "\r\n".join(lines).encode() + END + http


def _chunks(head: bytes, payload: memoryview) -> Iterator[tuple[int, bool, str, bytes]]:
    """(chunk_no, last, sha1_so_far, data) of one record, made one chunk at a time."""
    sha1, gzip = hashlib.sha1(), zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    yield 0, False, sha1.hexdigest(), gzip.compress(head) + gzip.flush(zlib.Z_SYNC_FLUSH)
    number = 0
    for number, low in enumerate(range(0, len(payload), CHUNK), 1):
        piece = payload[low : low + CHUNK]
        sha1.update(piece)
        yield number, False, sha1.hexdigest(), gzip.compress(piece) + gzip.flush(zlib.Z_SYNC_FLUSH)
    yield number + 1, True, sha1.hexdigest(), gzip.compress(END) + gzip.flush()


def write_chunks(pages: DataFrame, archives: int = 64) -> DataFrame:
    """Chunk rows of one record per row of ``pages`` (page_id, url, html); null html and url are empty.

    Rows of equal id and payload: the later ones (by url) are revisits of the first.  Rows
    with a null id are responses, each on its own.
    """
    columns = ["page_id", "url", "html", "sha1", "copy", "refers_to"]
    own = Window.partitionBy("page_id", "sha1").orderBy("url")
    known = _with_digest(pages).join(plan(pages), ["page_id", "sha1"]).withColumn("copy", F.row_number().over(own).cast("long") - 1)
    known = known.withColumn("refers_to", F.when((F.col("page_id") != F.col("keeper")) | (F.col("copy") > 0), F.col("keeper")))
    lost = _with_digest(pages.where(F.col("page_id").isNull())).withColumn("copy", F.monotonically_increasing_id()).withColumn("refers_to", F.lit(None).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            html = batch.column("html")
            for i in range(batch.num_rows):
                page_id, url, sha1, copy, refers_to = (batch.column(c)[i].as_py() for c in ("page_id", "url", "sha1", "copy", "refers_to"))
                digest = base32(sha1)
                payload = memoryview(html[i].as_buffer())
                record = record_uuid(page_id, digest, copy)
                head = _header(url, page_id, copy, digest, len(payload), refers_to)
                for number, last, so_far, data in _chunks(head, payload if refers_to is None else payload[:0]):
                    rows.append((int(record[:8], 16) % archives, record, page_id, number, last, so_far, data))
                    held += len(data)
                    if held > BATCH_BYTES:
                        yield _chunk_batch(rows)
                        rows, held = [], 0
            if rows:
                yield _chunk_batch(rows)

    return arrow_map(known.select(*columns).unionByName(lost.select(*columns)), run, CHUNKS)


def _chunk_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [c.split()[0] for c in CHUNKS.split(", ")])


RECORD_TYPES = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.bool_())


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of a stream of chunk rows, hashed chunk by chunk as they arrive.

    A record of which the stream lacks the begin or the end comes with ``whole`` false.
    """
    now: dict | None = None
    for batch in batches:
        out = []
        columns = [batch.column(c) for c in ("record_id", "page_id", "chunk_no", "last", "sha1_so_far", "data")]
        for i in range(batch.num_rows):
            record, page_id, number, last, so_far, data = (c[i].as_py() for c in columns)
            if now is not None and (now["id"] != record or now["chunks"] != number):
                out.append(_part(now["id"]))
                now = None
            if number == 0:
                now = {"id": record, "page": page_id, "gzip": zlib.decompressobj(31), "sha1": hashlib.sha1(), "bytes": 0, "chunks": 0, "ok": True}
                now |= _read_header(_inflated(now, data, HEAD))
                now["ok"] &= now["type"] is not None
            elif now is None:
                if last:
                    out.append(_part(record))
                continue
            else:
                plain = _inflated(now, data, CHUNK)
                if last:
                    now["ok"] &= plain == END
                else:
                    now["sha1"].update(plain)
                    now["bytes"] += len(plain)
            now["chunks"] += 1
            now["ok"] &= now["sha1"].hexdigest() == so_far
            if last:
                out.append(_record(now))
                now = None
        if out:
            yield _record_batch(out)
    if now is not None:
        yield _record_batch([_part(now["id"])])


def _inflated(now: dict, data: bytes, most: int) -> bytes:
    """The plain bytes of a record's next chunk; none from the first damaged one on, which marks the record.

    A chunk that gives more than ``most`` bytes, as no writer makes it, is damaged: it is not inflated further.
    """
    if now["gzip"] is not None:
        try:
            plain = now["gzip"].decompress(data, most + 1)
        except zlib.error:
            plain = None
        if plain is not None and len(plain) <= most:
            return plain
        now["gzip"], now["ok"] = None, False
    return b""


def _part(record: str) -> tuple:
    return record, None, None, None, None, None, None, False


def _record_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), RECORD_TYPES, strict=True)], [c.split()[0] for c in RECORDS.split(", ")])


def read_chunks(chunks: DataFrame) -> DataFrame:
    """Records of a chunk table, read as it lies: writers leave a record's chunks in a row.

    Only records that a file split cuts in two are brought together by a shuffle.
    ``intact`` is false if a chunk cannot be decompressed, or a chunk's digest, the whole
    digest or the length does not agree with the headers; of a record with a broken header
    only the ids are known, and the other columns are null.
    """
    found = cut(arrow_map(chunks, _stream, RECORDS))
    torn = found.where(~F.col("whole")).select("record_id").distinct()
    again = chunks.join(torn, "record_id", "left_semi").repartition("record_id").sortWithinPartitions("record_id", "chunk_no")
    return found.where("whole").unionByName(arrow_map(again, _stream, RECORDS))


def _read_header(data: bytes) -> dict:
    """What the headers of a record say; nothing if they are broken."""
    try:
        return _fields(data)
    except (KeyError, ValueError):
        return dict.fromkeys(("type", "digest", "size", "block", "refers_to"))


def _fields(data: bytes) -> dict:
    warc, http, _ = data.split(END, 2)
    fields = dict(line.split(": ", 1) for line in warc.decode().split("\r\n")[1:])
    inner = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    return {
        "type": fields["WARC-Type"],
        "digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        "size": int(inner["Content-Length"]),
        "block": int(fields["Content-Length"]) - len(http) - len(END),
        "refers_to": fields["WARC-Refers-To"][len("<urn:uuid:") : -1] if "WARC-Refers-To" in fields else None,
    }


def _record(r: dict) -> tuple:
    if r["type"] is None:
        return r["id"], r["page"], None, None, None, None, False, True
    if r["type"] == "response":
        digest, size = base64.b32encode(r["sha1"].digest()).decode(), r["bytes"]
    else:
        digest, size = r["digest"], r["size"]
    return r["id"], r["page"], size, digest, r["type"], r["refers_to"], r["ok"] and digest == r["digest"] and size == r["size"] and r["bytes"] == r["block"], True


def round_trip(pages: DataFrame, archives: int = 64) -> DataFrame:
    """Write the archives of ``pages`` to the shared folder, read them back, resolve revisits, delete the archives.

    Returns page_id, payload_bytes, payload_digest, record_type, refers_to, intact; a row
    with a null page_id is a response of its own.  An empty table gives an empty result.
    """
    chunks, path = stored(write_chunks(pages, archives))
    records = read_chunks(chunks)
    ids = records.where(F.col("record_type") == "response").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to")).distinct()
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")
    # Responses refer to nothing: their one null key stays out of the join.
    others = records.where(F.col("refers_to_id").isNull()).withColumn("refers_to", F.lit(None).cast("long"))
    revisits = records.where(F.col("refers_to_id").isNotNull()).join(ids, "refers_to_id", "left")
    out = cut(others.select(*columns).unionByName(revisits.select(*columns)))
    discard(pages.sparkSession, path)
    return out
