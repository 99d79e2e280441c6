"""WARC records in seekable Zstandard bundles.

A bundle holds WARC/1.1 records in independent Zstandard frames of some hundred kB. After the last frame comes
a skippable frame with the seek table of the Zstandard seekable format: compressed and plain size of each
frame, their number, a descriptor and the magic number. An index table maps each record identifier (WARC-Record-ID) to
bundle, frame and place in the frame's plain bytes, so that one record is read with one range read and one small
decompression.

Equal payloads of at least MIN_REVISIT bytes are stored once: the record of the smallest page_id is the
response, the others are revisits. Responses are written first, so that a revisit can name the response's identifier
(WARC-Refers-To). A revisit needs no html: its row comes from the table of digests. Pages whose key a filter of the
revisits rejects are written where they are read; only pages that it passes without need are looked up by key.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, url_filter

MIN_REVISIT = 100
#: Plain bytes after which a frame ends, and compressed bytes after which a bundle ends.
FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 64 << 20
#: Keys of some 50 bytes that are sent to all tasks at most.
MOST_BROADCAST = 100_000
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records carry the time of the format's own example where pages have none.
_DATE = "2016-09-19T17:20:24Z"


def make_record(record_id: str, page_id, url: str | None, payload: bytes | None, n_bytes: int, digest: bytes, refers_to=None, refers_record: str | None = None, refers_url: str | None = None) -> bytes:
    """A response with an HTTP head and the payload, or a revisit (payload None) with the head alone. record_id: a UUID that
    no other record has."""
    kind = b"response" if payload is not None else b"revisit"
    head = [b"WARC/1.1", b"WARC-Type: " + kind, b"WARC-Record-ID: <urn:uuid:%b>" % record_id.encode(), b"WARC-Date: " + _DATE.encode()]
    if url is not None:
        head.append(b"WARC-Target-URI: " + " ".join(url.split()).encode())
    head += [b"WARC-Payload-Digest: sha256:" + base64.b32encode(digest), b"X-Page-Id: %b" % (b"null" if page_id is None else b"%d" % page_id)]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n_bytes
    if payload is not None:
        block += payload
    else:
        head += [b"X-Refers-To-Page: %d" % refers_to, b"WARC-Refers-To: <urn:uuid:%b>" % refers_record.encode(), b"WARC-Refers-To-Date: " + _DATE.encode(), b"WARC-Profile: " + _PROFILE.encode()]
        head += [b"WARC-Refers-To-Target-URI: " + " ".join(refers_url.split()).encode()] if refers_url is not None else []
    head += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def make_info(name: str) -> bytes:
    """The record that opens a bundle."""
    block = b"software: loomspark\r\nformat: WARC File Format 1.1\r\n"
    head = [b"WARC/1.1", b"WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>".encode(), b"WARC-Date: " + _DATE.encode(), b"WARC-Filename: " + name.encode()]
    head += [b"Content-Type: application/warc-fields", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def http_payload(block: bytes) -> tuple[bytes, int]:
    """(payload of an HTTP response, its length as the head states it)."""
    stop = block.index(b"\r\n\r\n")
    told = next(int(line.split(b":")[1]) for line in block[:stop].split(b"\r\n") if line.lower().startswith(b"content-length:"))
    return block[stop + 4 :], told


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, place after the record)."""
    stop = data.index(b"\r\n\r\n", at)
    lines = data[at:stop].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    begin, n = stop + 4, int(headers["Content-Length"])
    if data[begin + n : begin + n + 4] != b"\r\n\r\n":
        raise ValueError("record without its end")
    return headers, data[begin : begin + n], begin + n + 4


class BundleWriter:
    """Collects records into frames; finish() gives the bundle."""

    def __init__(self, level: int = 3):
        self.compressor = zstandard.ZstdCompressor(level=level)
        self.out, self.frames, self.plain, self.size = io.BytesIO(), [], [], 0

    def add(self, record: bytes) -> tuple[int, int, int]:
        """(frame, place in its plain bytes, length)."""
        place = (len(self.frames), self.size, len(record))
        self.plain.append(record)
        self.size += len(record)
        if self.size >= FRAME_BYTES:
            self._end_frame()
        return place

    def _end_frame(self) -> None:
        if self.size:
            self.frames.append((self.out.write(self.compressor.compress(b"".join(self.plain))), self.size))
            self.plain, self.size = [], 0

    def finish(self) -> bytes:
        self._end_frame()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, _SEEKABLE)
        self.out.write(struct.pack("<II", _SKIPPABLE, len(table)) + table)
        return self.out.getvalue()


class Bundle:
    """Random access to a bundle through read(offset, size)."""

    def __init__(self, read, size: int):
        self.read = read
        n, _, magic = struct.unpack("<IBI", read(size - 9, 9))
        if magic != _SEEKABLE:
            raise ValueError("no seek table")
        table = np.frombuffer(read(size - 9 - 8 * n, 8 * n), "<u4").reshape(n, 2).astype(np.int64)
        self.sizes = table
        self.starts = np.cumsum(table[:, 0]) - table[:, 0]

    def frame(self, k: int) -> bytes:
        return zstandard.ZstdDecompressor().decompress(self.read(int(self.starts[k]), int(self.sizes[k, 0])), max_output_size=int(self.sizes[k, 1]))

    def record(self, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
        headers, block, _ = parse_record(self.frame(frame), offset)
        return headers, block

    def records(self) -> Iterator[tuple[dict[str, str], bytes]]:
        for k in range(len(self.sizes)):
            data, at = self.frame(k), 0
            while at < len(data):
                headers, block, at = parse_record(data, at)
                yield headers, block


def open_bundle(uri: str, size: int) -> Bundle:
    fs, path = common.filesystem(uri)
    handle = fs.open_input_file(path)
    return Bundle(lambda at, n: handle.read_at(n, at), size)


def _digest(html) -> Column:
    """SHA-256 of a text's UTF-8 bytes, as bytes."""
    return F.unhex(F.sha2(html.cast("binary"), 256))


def revisits(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(digests, revisits), both stored: page_id, url, n_bytes and digest of each page with an id and MIN_REVISIT bytes or more,
    and those of them whose payload a page with a smaller id has, with that id: refers_to."""
    html = F.col("html").cast("string")
    fits = pages.where((F.octet_length(html) >= MIN_REVISIT) & F.col("page_id").isNotNull())
    digests = common.saved(fits.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.octet_length(html).cast("bigint").alias("n_bytes"), _digest(html).alias("digest")), "payloads")
    first = digests.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("digest").alias("of"), "refers_to")
    return digests, common.saved(digests.join(first, digests["digest"] == first["of"]).where("page_id > refers_to").drop("of"), "revisits")


def _filter(keys: DataFrame):
    """A function that says for hashes whether they may be among those of keys (h); it holds a bounded filter."""
    bloom = url_filter.build_filter(keys, keys.count())

    def possible(h: np.ndarray) -> np.ndarray:
        block, bits = url_filter._places(h, len(bloom))
        return ((bloom[block] & bits) == bits).all(axis=1)

    return possible


_INDEX = "record_id string, page_id bigint, url string, digest binary, uri string, bytes bigint, frame int, offset bigint, length bigint"


def _writer(folder: str, kept_back=None):
    """A map over rows (page_id, url, html, n_bytes, digest, refers_to, refers_record, refers_url, h) to the index of the records
    it writes: of all rows, or of those without h or whose h `kept_back` rejects. A response refers to null."""
    schema = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.binary()), ("uri", pa.string()), ("bytes", pa.int64()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None

        def flush():
            data = writer.finish()
            fs, path = common.filesystem(uri)
            with fs.open_output_stream(path, compression=None) as out:
                out.write(data)
            record_id, page_id, url, digest, (frame, offset, length) = *zip(*[r[:4] for r in rows], strict=True), zip(*[r[4] for r in rows], strict=True)
            return common.record(schema, record_id=record_id, page_id=page_id, url=url, digest=digest, uri=[uri] * len(rows), bytes=[len(data)] * len(rows), frame=frame, offset=offset, length=length)

        for batch in batches:
            if kept_back is not None and batch.num_rows:
                h = batch.column(8)
                batch = batch.filter(pa.array(~kept_back(h.fill_null(0).to_numpy()) | h.is_null().to_numpy(zero_copy_only=False)))
            for b in common.blocks([batch], "html"):
                htmls = b.column(2).to_pylist()
                for page_id, url, html, n_bytes, digest, *refers in zip(*[b.column(i).to_pylist() for i in (0, 1)], htmls, *[b.column(i).to_pylist() for i in (3, 4, 5, 6, 7)], strict=True):
                    if writer is None:
                        uri = f"{folder}/{uuid.uuid4().hex}.warc.zst"
                        writer, rows = BundleWriter(), []
                        writer.add(make_info(uri.rsplit("/", 1)[1]))
                    record_id = str(uuid.uuid5(uuid.NAMESPACE_URL, f"{uri} {len(rows)}"))
                    payload = (html or "").encode() if refers[0] is None else None
                    rows.append((record_id, page_id, url, digest, writer.add(make_record(record_id, page_id, url, payload, n_bytes, digest, *refers))))
                    if writer.out.tell() >= BUNDLE_BYTES:
                        yield flush()
                        writer = None
        if writer is not None:
            yield flush()

    return run


def write_bundles(pages: DataFrame, folder: str) -> DataFrame:
    """Writes a record per row of pages (page_id, url, html) under folder; returns the index, stored, one row per record:
    record_id (the UUID of WARC-Record-ID), page_id, url, digest, bundle uri and size, frame, offset and length in the
    frame's plain bytes. Each bundle opens with a warcinfo record, which the index leaves out.

    Null html counts as empty. A null page_id is always a response and is not referred to; a page whose id and
    payload repeat is a response each time, with identifiers of their own, and revisits name the one of the least
    identifier. Other columns are not read. An empty table writes nothing. A task that runs again writes bundles of
    other names; the index lists those of the attempt that counts.
    """
    fs, path = common.filesystem(folder)
    fs.create_dir(path, recursive=True)
    digests, later = revisits(pages)
    key = F.xxhash64("page_id", "digest").alias("h")
    possible = _filter(later.select(key))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("refers_to", "bigint"), ("refers_record", "string"), ("refers_url", "string"))]
    source = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    source = source.withColumn("n_bytes", F.coalesce(F.octet_length("html"), F.lit(0)).cast("bigint")).withColumn("digest", _digest(F.coalesce("html", F.lit(""))))
    small = F.col("page_id").isNull() | (F.col("n_bytes") < MIN_REVISIT)
    rows = source.select("page_id", "url", "html", "n_bytes", "digest", *none, F.when(~small, key).alias("h"))

    written = rows.mapInArrow(_writer(folder, possible), _INDEX)

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(possible(b.column(2).to_numpy())))

    asked = digests.select("page_id", "digest", key).mapInArrow(passed, "page_id bigint, digest binary, h bigint").drop("h").distinct()
    wrongly = common.saved(asked.join(later.select("page_id", "digest"), ["page_id", "digest"], "left_anti"), "passed-without-need")
    if n := wrongly.count():
        wrongly = F.broadcast(wrongly) if n <= MOST_BROADCAST else wrongly
        missed = rows.where("h is not null").join(wrongly, ["page_id", "digest"], "left_semi").select(*rows.columns)
        written = written.unionByName(missed.mapInArrow(_writer(folder), _INDEX))
    responses = common.saved(written, "response-index")
    named = responses.where("page_id is not null").groupBy(F.col("page_id").alias("refers_to"), F.col("digest").alias("of")).agg(F.min(F.struct("record_id", "url")).alias("to"))
    told = later.join(named, (later["refers_to"] == named["refers_to"]) & (later["digest"] == named["of"])).select("page_id", later["url"], F.lit(None).cast("string").alias("html"), "n_bytes", "digest", later["refers_to"], F.col("to.record_id").alias("refers_record"), F.col("to.url").alias("refers_url"), F.lit(0).cast("bigint").alias("h"))
    return responses.unionByName(common.saved(told.mapInArrow(_writer(folder), _INDEX), "revisit-index"))


def read_bundles(index: DataFrame) -> DataFrame:
    """Each record of the index: page_id, url, record_type, refers_to, payload_bytes, payload_digest (hex), payload (null
    for a revisit). Records are reached by their places in the index: a frame is read once for those of it that the
    index lists, so an index of some rows reads some frames. Digests of responses are taken from the payload read."""
    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
    page = lambda text: None if text in (None, "null") else int(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, opened, frame, plain, rows, held = None, None, None, b"", [], 0
        for b in batches:
            for uri, size, k, offset in zip(*[b.column(i).to_pylist() for i in range(4)], strict=True):
                if uri != opened:
                    bundle, opened, frame = open_bundle(uri, size), uri, None
                if k != frame:
                    frame, plain = k, bundle.frame(k)
                headers, block, _ = parse_record(plain, offset)
                payload, told_bytes = http_payload(block)
                told, response = base64.b32decode(headers["WARC-Payload-Digest"][7:]), headers["WARC-Type"] == "response"
                if response and (hashlib.sha256(payload).digest() != told or len(payload) != told_bytes):
                    raise ValueError(f"payload of {headers['WARC-Record-ID']} is damaged")
                rows.append((page(headers["X-Page-Id"]), headers.get("WARC-Target-URI"), headers["WARC-Type"], page(headers.get("X-Refers-To-Page")), told_bytes, told.hex(), payload if response else None))
                held += len(payload)
                if held > (8 << 20) or len(rows) >= 10_000:
                    yield common.record(schema, **dict(zip(schema.names, zip(*rows, strict=True), strict=True)))
                    rows, held = [], 0
        if rows:
            yield common.record(schema, **dict(zip(schema.names, zip(*rows, strict=True), strict=True)))

    places = index.select("uri", "bytes", "frame", "offset").repartition(n, "uri").sortWithinPartitions("uri", "frame", "offset")
    return places.mapInArrow(run, "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_bundles(write_bundles(common.read(spark, sf_dir, "pages"), common.fresh(spark, "warc"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = {
    "op5_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT page_id, strlen(html) AS n, sha256(html) AS d, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN n >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN n >= 100 AND page_id > first THEN first END AS refers_to FROM f""",
}
