"""WARC archives in seekable Zstandard bundles."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlab.session import ship

from ._space import Workspace

#: Bytes of records in a frame and in a bundle, compression level.
FRAME, BUNDLE, LEVEL = 256 << 10, 8 << 20, 3
#: Fixed values of the seekable format: magic of the skippable frame, magic of the footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
DATE = "2024-01-01T00:00:00Z"
PAGE = "urn:page"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def name(page_id: int | None, said: str, row: int | None) -> str:
    """Identifier of a record: page, digest of the payload and, where several rows would share these, a row number."""
    return ":".join([PAGE, "null" if page_id is None else str(page_id), said, *([] if row is None else [str(row)])])


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, row: int | None = None, sole: bool = True) -> tuple[str, bytes]:
    """Identifier and bytes of a WARC/1.1 record: a response with its payload, or a revisit that names the response and
    has no block.  Without ``sole`` several rows are that response, and no single identifier is named."""
    block, said = payload if refers_to is None else b"", digest(payload)
    own = name(page_id, said, row)
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{own}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(url.splitlines()))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    head += [f"WARC-Payload-Digest: sha1:{said}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}"]
        head += [f"WARC-Refers-To: <{name(refers_to, said, None)}>"] * sole
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return own, "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers and block of the record at ``at``, and where the next begins."""
    stop = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:stop].decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record here")
    head = dict(line.split(": ", 1) for line in lines)
    begin, size = stop + 4, int(head["Content-Length"])
    return head, data[begin : begin + size], begin + size + 4


class BundleWriter:
    """Collects records into independent frames; :meth:`close` appends the seek table in the footer."""

    def __init__(self) -> None:
        self.done, self.sizes, self.now, self.index = bytearray(), [], bytearray(), []
        self.pack = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)

    def add(self, name: str, data: bytes) -> None:
        if self.now and len(self.now) + len(data) > FRAME:
            self._frame()
        self.index.append((name, len(self.sizes), len(self.now), len(data)))
        self.now += data

    def _frame(self) -> None:
        packed = self.pack.compress(bytes(self.now))
        self.sizes.append((len(packed), len(self.now)))
        self.done += packed
        self.now = bytearray()

    def close(self) -> tuple[bytes, list[tuple[str, int, int, int]]]:
        """The bundle, and for each record its name, frame, offset in the frame's content, and length."""
        if self.now:
            self._frame()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        return bytes(self.done) + struct.pack("<II", SKIPPABLE, len(table)) + table, self.index


def frames(bundle: bytes) -> list[tuple[int, int, int]]:
    """Offset, packed and unpacked size of each frame, from the footer."""
    n, flags, magic = struct.unpack_from("<IBI", bundle, len(bundle) - 9)
    if magic != SEEKABLE or flags & 0x80:
        raise ValueError("no seek table without checksums in the footer")
    at, out = 0, []
    for packed, size in struct.iter_unpack("<II", bundle[len(bundle) - 9 - 8 * n : len(bundle) - 9]):
        out.append((at, packed, size))
        at += packed
    return out


def frame(bundle: bytes, number: int) -> bytes:
    at, packed, size = frames(bundle)[number]
    return zstandard.ZstdDecompressor().decompress(bundle[at : at + packed], max_output_size=size)


def fetch(bundle: bytes, number: int, offset: int) -> tuple[dict[str, str], bytes]:
    """One record by its place in the index; no other frame is unpacked."""
    return parse(frame(bundle, number), offset)[:2]


BUNDLES = "bundle string, data binary, records array<struct<name:string,frame:int,offset:int,length:int>>"


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    writer, size = BundleWriter(), 0

    def close() -> pa.RecordBatch:
        data, index = writer.close()
        kind = pa.list_(pa.struct([("name", pa.string()), ("frame", pa.int32()), ("offset", pa.int32()), ("length", pa.int32())]))
        rows = [dict(zip(("name", "frame", "offset", "length"), x, strict=True)) for x in index]
        return pa.RecordBatch.from_arrays([pa.array([hashlib.sha1(data).hexdigest()]), pa.array([data], pa.binary()), pa.array([rows], kind)], ["bundle", "data", "records"])

    for batch in batches:
        for page_id, url, html, refers_to, row, sole in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own, data = record(page_id, url, html.encode(), refers_to, row, sole)
            writer.add(own, data)
            size += len(data)
            if size > BUNDLE:
                yield close()
                writer, size = BundleWriter(), 0
    if size:
        yield close()


def write_bundles(pages: DataFrame, least: int = 0) -> DataFrame:
    """Bundles (bundle, data, records) with a record for every row of ``pages`` (page_id, url, html; null html: empty).

    Of rows with equal payloads of ``least`` bytes or more that with the largest page_id is the response; the others
    revisit it.  Rows that share that page_id are all responses, and so are rows without a page_id where no other has
    one.  Every record has an identifier of its own: page and payload digest, and a row number where other rows could
    have the same.  Other columns of ``pages`` are not read; an empty table gives no bundles.  The bundles are rows of
    a table, so any store that Spark writes can hold them; ``data`` is a whole .warc.zst file.  Payload digests are
    matched by a table of repeated ones only.
    """
    space = Workspace(pages.sparkSession, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    known = rows.select("page_id", F.sha1("html").alias("_digest"), F.octet_length("html").alias("_size")).where(F.col("_size") >= least)
    pages_of = known.groupBy("_digest", "page_id").agg(F.count("*").alias("_n"))
    last = F.max(F.struct("page_id", "_n"))
    repeated = pages_of.groupBy("_digest").agg(F.sum("_n").alias("_rows"), F.max("_n").alias("_most"), last["page_id"].alias("_last"), (last["_n"] == 1).alias("_sole")).where("_rows > 1").drop("_rows")
    keyed = rows.withColumn("_digest", F.when(F.octet_length("html") >= least, F.sha1("html")))
    placed = keyed.hint("merge").join(space.put(repeated, "repeated"), "_digest", "left")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("_last")), F.col("_last"))
    alone = F.col("_digest").isNotNull() & F.coalesce(F.col("_most") == 1, F.lit(True)) | F.col("_sole") & (F.col("page_id") == F.col("_last"))
    number = F.when(~F.coalesce(alone, F.lit(False)), F.monotonically_increasing_id())
    placed = placed.select("page_id", "url", "html", refers.alias("refers_to"), number.alias("number"), F.coalesce("_sole", F.lit(True)).alias("sole"))
    return space.put(placed.mapInArrow(_write, BUNDLES), "bundles")


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows, now, content = [], None, b""
            for at in sorted(places, key=lambda p: (p["frame"], p["offset"])):
                if at["frame"] != now:
                    now, content = at["frame"], frame(data, at["frame"])
                head, block, _ = parse(content, at["offset"])
                rows.append((head["WARC-Record-ID"][1:-1], head["WARC-Type"], block))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.binary()), strict=True)], ["name", "record_type", "block"])


def fetch_records(bundles: DataFrame, names: DataFrame) -> DataFrame:
    """name, record_type and block of the records that ``names`` (name) identifies.

    The index gives each record's frame and offset; no other frame of a bundle is unpacked.  Names that no record has,
    null ones and repeated ones add nothing.
    """
    ship(bundles.sparkSession)
    wanted = bundles.select("bundle", F.explode("records").alias("r")).join(names.select("name").distinct(), F.col("r.name") == F.col("name"), "left_semi")
    places = wanted.groupBy(F.col("bundle").alias("_bundle")).agg(F.collect_list(F.struct("r.frame", "r.offset")).alias("places"))
    return bundles.select("bundle", "data").join(places, F.col("bundle") == F.col("_bundle")).select("data", "places").mapInArrow(_fetch, "name string, record_type string, block binary")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column(0).to_pylist():
            unpack = zstandard.ZstdDecompressor()
            out: list[tuple] = []
            for at, packed, size in frames(data):
                content, where = unpack.decompress(data[at : at + packed], max_output_size=size), 0
                while where < len(content):
                    head, block, where = parse(content, where)
                    kind = head["WARC-Type"]
                    said = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and digest(block) != said:
                        raise ValueError(f"the payload of {head['WARC-Record-ID']} does not match its digest")
                    page, refers = (int(x) if (x := head.get(k)) else None for k in ("X-Page-ID", "X-Refers-To-Page-ID"))
                    out.append((page, head.get("WARC-Target-URI"), int(head["X-Payload-Length"]), said, kind, refers, block.decode() if kind == "response" else None))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
            for lo in range(0, len(out), 1000):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[lo : lo + 1000], strict=True), kinds, strict=True)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])


def read_bundles(bundles: DataFrame) -> DataFrame:
    """A row for each record: page_id, url, payload_bytes, payload_digest (base32 SHA-1), record_type, refers_to, payload.

    The first two figures are of the full payload, for revisits too; a revisit's payload is null.  Each frame is found
    by the seek table.  A response whose payload does not match its digest is an error.
    """
    ship(bundles.sparkSession)
    return bundles.select("data").mapInArrow(_read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string")


#: The same figures for DuckDB; base32 of the 20 bytes in four groups of 40 bits.
ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
s AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS x, max(page_id) OVER (PARTITION BY sha1(h)) AS latest FROM p)
SELECT page_id, payload_bytes,
  list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(x, 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::INT, 1) FOR i IN range(32)], 'string_agg', '') AS payload_digest,
  CASE WHEN page_id < latest THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < latest THEN latest END AS refers_to
FROM s
"""
