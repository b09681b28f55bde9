"""WARC records in seekable Zstandard bundles.

A bundle is one WARC file: its records stand in frames that are compressed on
their own, and a skippable frame at the end holds the seek table of the
Zstandard seekable format (compressed and plain size of each frame).  Readers that
know nothing of it see one ordinary ``.warc.zst`` stream.  An index maps each
record to its frame and to its place inside that frame, so that one record costs
the decompression of one frame.

Records with equal payloads are written once: the one with the largest id is a
``response``, the others are ``revisit`` records that refer to it.  Which payloads
are equal is decided on digests before any body moves.

Bundles are rows of a table, so that Spark writes, commits and repeats them like any
other; ``bundle`` of a row is the content of one file.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.llm.common import bounded_batches, column

# Fixed values of the seekable format.
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 8 << 20
DATE = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "array<struct<record_id: string, frame: int, offset: int, length: int>>"
BUNDLES = f"bundle_id string, bundle binary, records {INDEX}"


# --- one bundle ----------------------------------------------------------------


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{page_id}>"


def page_of(record: str | None) -> int | None:
    number = record[len("<urn:page:") : -1] if record else "None"
    return None if number == "None" else int(number)


def one_line(value: str) -> str:
    """Header values stand on one line: control characters and ``%`` are percent-encoded."""
    return "".join(c if c >= " " and c not in "%\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def write_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record.  A revisit has no block; its digest and length are those of the full payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", one_line(url or "")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Payload-Length", str(len(payload))),
    ]
    if revisit:
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    block = b"" if revisit else payload
    headers.append(("Content-Length", str(len(block))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n"
    return head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes


def read_record(data: bytes, at: int = 0) -> tuple[Record, int]:
    """The record that starts at ``at`` and the place behind it; ``ValueError`` if there is none."""
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0 or not data.startswith(b"WARC/1.1\r\n", at):
        raise ValueError(f"no record at {at}")
    lines = data[at:stop].decode("utf-8", "surrogatepass").split("\r\n")[1:]
    headers = dict(line.split(": ", 1) for line in lines)
    begin = stop + 4
    end = begin + int(headers["Content-Length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError(f"record at {at} is cut off")
    return Record(headers, data[begin:end]), end + 4


class Bundler:
    """Collects records; ``done`` gives the bytes of the bundle and its index."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = 3) -> None:
        import zstandard

        self.compressor = zstandard.ZstdCompressor(level=level)
        self.frame_bytes = frame_bytes
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.index: list[tuple[str, int, int, int]] = []
        self.plain = bytearray()
        self.written = 0

    def add(self, name: str, record: bytes) -> None:
        if self.plain and len(self.plain) + len(record) > self.frame_bytes:
            self._close()
        self.index.append((name, len(self.frames), len(self.plain), len(record)))
        self.plain += record

    def _close(self) -> None:
        if self.plain:
            frame = self.compressor.compress(bytes(self.plain))
            self.frames.append(frame)
            self.sizes.append((len(frame), len(self.plain)))
            self.written += len(frame)
            self.plain = bytearray()

    @property
    def size(self) -> int:
        return self.written + len(self.plain)

    def done(self) -> tuple[bytes, list[tuple[str, int, int, int]]]:
        self._close()
        entries = b"".join(struct.pack("<II", *s) for s in self.sizes)
        footer = struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        table = struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer
        return b"".join(self.frames) + table, self.index


def seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(place, compressed size, plain size) of each frame, read from the footer."""
    if len(bundle) < 17:
        raise ValueError("no seek table")
    count, flags, magic = struct.unpack("<IBI", bundle[-9:])
    start = len(bundle) - 9 - 8 * count - 8
    if magic != SEEKABLE or flags or start < 0 or struct.unpack("<I", bundle[start : start + 4])[0] != SKIPPABLE:
        raise ValueError("no seek table")
    out, at = [], 0
    for i in range(count):
        size, plain = struct.unpack_from("<II", bundle, start + 8 + 8 * i)
        out.append((at, size, plain))
        at += size
    return out


def read_frame(bundle: bytes, frame: tuple[int, int, int]) -> bytes:
    import zstandard

    at, size, plain = frame
    return zstandard.ZstdDecompressor().decompress(bundle[at : at + size], max_output_size=plain)


# --- Spark ---------------------------------------------------------------------


def roles(pages: DataFrame, least_bytes: int) -> DataFrame:
    """``pages`` (page_id, url, html) with the id each one refers to, null for responses."""
    marked = pages.withColumn("k", F.sha2("html", 256)).withColumn("n", F.octet_length("html"))
    first = (
        marked.filter(F.col("n") >= least_bytes)
        .groupBy("k")
        .agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1")
        .select("k", "first")
    )
    # Bodies whose digest occurs once are on the side that is kept whole; a hot digest is split by the join.
    joined = marked.join(first, "k", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "html", F.when(revisit, F.col("first")).alias("refers_to"))


def write_bundles(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    least_bytes: int = 0,
    frame_bytes: int = FRAME_BYTES,
    bundle_bytes: int = BUNDLE_BYTES,
) -> DataFrame:
    """A table of bundles: ``bundle_id, bundle, records``; one record per row of ``pages``.

    Payloads are the texts of ``html_col`` in UTF-8 (null: empty).  Of equal payloads
    with at least ``least_bytes`` bytes the row with the largest id is the response,
    the others are revisits; rows without an id are revisits as soon as a row with
    an id has their payload, else responses.  Rows that repeat id and payload are
    each written, all of them as what the id is.  A bundle is closed when it has
    ``bundle_bytes``; a single record can be longer.  An empty table gives no bundle.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    narrow = pages.select(
        column(id_col).cast("bigint").alias("page_id"),
        column(url_col).alias("url"),
        F.coalesce(column(html_col), F.lit("")).alias("html"),
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundler = Bundler(frame_bytes)
        for batch in batches:
            for page, url, html, refers_to in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                payload = html.encode("utf-8", "surrogatepass")
                bundler.add(record_id(page), write_record(page, url, payload, refers_to, refers_to is not None))
                if bundler.size >= bundle_bytes:
                    yield _row(*bundler.done())
                    bundler = Bundler(frame_bytes)
        if bundler.index:
            yield _row(*bundler.done())

    return roles(narrow, least_bytes).mapInArrow(pack, BUNDLES)


def _row(bundle: bytes, index: list[tuple[str, int, int, int]]) -> pa.RecordBatch:
    """A bundle is named after its content: a repeated task gives the same names."""
    name = hashlib.sha256(bundle).hexdigest()[:32]
    keys = ("record_id", "frame", "offset", "length")
    kind = pa.list_(
        pa.struct([("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int32()), ("length", pa.int32())])
    )
    records = pa.array([[dict(zip(keys, i, strict=True)) for i in index]], kind)
    return pa.RecordBatch.from_arrays(
        [pa.array([name]), pa.array([bundle], pa.binary()), records], ["bundle_id", "bundle", "records"]
    )


READ = "page_id bigint, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, url string"


def read_bundles(bundles: DataFrame) -> DataFrame:
    """One row per record, read back from the bundles frame by frame.

    Digests of blocks are computed anew and compared with the headers; a mismatch,
    or an index that does not fit, is an error.
    """

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bundle, records in zip(batch.column(0), batch.column(1), strict=True):
                yield _records(bundle.as_py(), records.as_py())

    one_by_one = bundles.select("bundle", "records")
    return one_by_one.mapInArrow(unpack, READ)


def _records(bundle: bytes, index: list[dict]) -> pa.RecordBatch:
    frames = seek_table(bundle)
    rows, held, data = [], None, b""
    for entry in index:
        if entry["frame"] != held:
            held = entry["frame"]
            data = read_frame(bundle, frames[held])
        record, end = read_record(data, entry["offset"])
        head = record.headers
        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
        revisit = head["WARC-Type"] == "revisit"
        own = base64.b32encode(hashlib.sha1(record.block).digest()).decode()
        size = int(head["X-Payload-Length"])
        if head["WARC-Record-ID"] != entry["record_id"] or end - entry["offset"] != entry["length"]:
            raise ValueError(f"the index does not fit record {entry['record_id']}")
        if not revisit and (own != digest or size != len(record.block)):
            raise ValueError(f"payload of {entry['record_id']} is damaged")
        refers_to = page_of(head.get("WARC-Refers-To"))
        rows.append((page_of(entry["record_id"]), head["WARC-Type"], refers_to, size, digest, head["WARC-Target-URI"]))
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
    names = ["page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "url"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def fetch(bundles: DataFrame, wanted: DataFrame) -> DataFrame:
    """``record_id, warc`` (the record's bytes) of the records named in ``wanted`` (column ``record_id``).

    Only bundles that hold one are read, and of those only the frames concerned.
    """
    places = bundles.select("bundle_id", F.inline("records")).join(wanted.select("record_id").distinct(), "record_id", "left_semi")
    asked = places.groupBy("bundle_id").agg(F.collect_list(F.struct("record_id", "frame", "offset", "length")).alias("asked"))
    found = bundles.select("bundle_id", "bundle").join(asked, "bundle_id").select("bundle", "asked")

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bundle, asked in zip(batch.column(0), batch.column(1), strict=True):
                data, frames = bundle.as_py(), seek_table(bundle.as_py())
                names, records = [], []
                for frame in sorted({a["frame"] for a in asked.as_py()}):
                    plain = read_frame(data, frames[frame])
                    for a in asked.as_py():
                        if a["frame"] == frame:
                            names.append(a["record_id"])
                            records.append(plain[a["offset"] : a["offset"] + a["length"]])
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(records, pa.binary())], ["record_id", "warc"])

    return found.mapInArrow(cut_out, "record_id string, warc binary")


# Base 32 of the SHA-1: its 160 bits as 32 groups of five.
ORACLE = r"""
with p as (select page_id, encode(coalesce(html, '')) as b, coalesce(html, '') as h from pages),
g as (select h, max(page_id) as most, count(*) as copies from p group by h),
x as (
  select p.page_id, octet_length(b) as payload_bytes, sha1(b) as hex, most, copies
  from p join g on p.h = g.h)
select page_id, cast(payload_bytes as bigint) as payload_bytes,
       array_to_string(list_transform(range(32), lambda i:
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
           1 + cast(((('0x' || hex[1 + 10 * (i // 8) : 10 + 10 * (i // 8)])::bigint) >> (35 - 5 * (i % 8))) & 31 as integer)]), '') as payload_digest,
       case when page_id = most then 'response' else 'revisit' end as record_type,
       case when page_id = most then null else most end as refers_to
from x"""
