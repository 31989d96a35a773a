"""WARC archives in seekable Zstandard bundles: written by tasks, read back by frame.

A bundle is one file of independent Zstandard frames, each holding whole records up to ``FRAME`` bytes, and
a last skippable frame with the seek table (compressed and plain size of each frame) and its footer, so
that any frame is found from the end of the file. The index maps each record identifier to its bundle,
frame and offset within the frame; it is a Parquet table that Spark commits, and only bundles that it
names count: a task that is lost leaves a file that no row points to (:func:`orphans`), and its repeat
writes another one. Of equal payloads of ``LEAST`` bytes or more the one with the largest id is a
response and the others revisit it. Payloads are told apart by SHA-256, and named by SHA-1 as is usual.

Few payloads can have many copies: those with more than a ``HOT``-th of all rows are at most ``HOT``, and are
looked up by broadcast; rows of all others are dealt by payload, and rows without a copy anyhow.

Defined cases: null html reads as empty; null ids come before all others, and where all copies lack an id
all are responses; rows repeated with id and payload are all responses or all revisits, under one record
identifier; line breaks and spaces in a url are percent-encoded; an empty table gives an archive without
bundles; other columns, whatever their names, are ignored. Memory: one frame, or one longer record, and
the index rows of one bundle.
"""

from __future__ import annotations

import base64
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs as files
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_chunks, shared_folder, store

FRAME, BUNDLE, LEVEL, LEAST, HOT = 1 << 20, 256 << 20, 3, 1000, 1000
#: A task reads so many bytes of records, by runs of so many frames of a bundle.
TASK, FRAMES = 32 << 20, 16
DATE = "1970-01-01T00:00:00Z"
#: Fixed values of the seekable Zstandard format: magic numbers of a skippable frame and of its footer.
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_ENTRY, _FOOTER = struct.Struct("<II"), struct.Struct("<IBI")
_INDEX = "record_id string, bundle string, frame int, offset long, length long"
_RECORD = "record_id string, record_type string, uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"


@dataclass
class Archive:
    """A folder of bundles, the index of their records and the type of the page ids."""

    folder: str
    index: DataFrame
    id_type: str


class BundleWriter:
    """Writes records into frames of one file; ``entries`` are (record_id, frame, offset, length)."""

    def __init__(self, stream, frame_bytes: int = FRAME, level: int = LEVEL):
        self._stream, self._frame_bytes, self._packer = stream, frame_bytes, zstandard.ZstdCompressor(level=level)
        self._frame, self._sizes = bytearray(), []
        self.entries: list[tuple[str, int, int, int]] = []
        self.written = 0

    def add(self, record_id: str | None, record: bytes) -> None:
        if self._frame and len(self._frame) + len(record) > self._frame_bytes:
            self.end_frame()
        if record_id is not None:
            self.entries.append((record_id, len(self._sizes), len(self._frame), len(record)))
        self._frame += record

    def end_frame(self) -> None:
        if self._frame:
            packed = self._packer.compress(bytes(self._frame))
            self._stream.write(packed)
            self._sizes.append((len(packed), len(self._frame)))
            self.written += len(packed)
            self._frame = bytearray()

    def close(self) -> None:
        self.end_frame()
        table = b"".join(_ENTRY.pack(*s) for s in self._sizes) + _FOOTER.pack(len(self._sizes), 0, _SEEKABLE)
        self._stream.write(_ENTRY.pack(_SKIPPABLE, len(table)) + table)
        self._stream.close()


class BundleReader:
    """Reads single frames of a bundle by its seek table."""

    def __init__(self, file):
        self._file, self._unpacker = file, zstandard.ZstdDecompressor()
        end = file.size()
        file.seek(end - _FOOTER.size)
        n, flags, magic = _FOOTER.unpack(file.read(_FOOTER.size))
        if magic != _SEEKABLE:
            raise ValueError("no seek table at the end of the bundle")
        width = 12 if flags & 0x80 else 8  # with a checksum for each frame, as other writers have it
        file.seek(end - _FOOTER.size - n * width)
        table = file.read(n * width)
        self.frames, at = [], 0
        for k in range(n):
            packed, plain = _ENTRY.unpack_from(table, k * width)
            self.frames.append((at, packed, plain))
            at += packed

    def frame(self, number: int) -> bytes:
        at, packed, plain = self.frames[number]
        self._file.seek(at)
        return self._unpacker.decompress(self._file.read(packed), max_output_size=max(plain, 1))


def record_id(page_id: object) -> str:
    return "<urn:page>" if page_id is None else f"<urn:page:{quote(str(page_id), safe='')}>"


def page_record(page_id: object, uri: str | None, payload: bytes, sha1: str, revisit_of: str | None, date: str = DATE) -> bytes:
    """A response with an HTTP block, or a revisit without payload of the record that ``revisit_of`` identifies."""
    digest = "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()
    lines = [f"WARC-Type: {'revisit' if revisit_of else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}"]
    if uri is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\s\x00-\x20\x7f]", lambda c: quote(c[0], safe=""), uri))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit_of else http + payload
    if revisit_of:
        lines += [f"WARC-Refers-To: {revisit_of}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: {digest}", f"Content-Length: {len(block)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def info_record(date: str = DATE) -> bytes:
    body = b"format: WARC file version 1.1\r\n"
    return f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def parse_record(data: bytes) -> dict[str, object]:
    """The columns of one page record; its HTTP head tells the payload's length, which a revisit has no bytes of."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record at this offset")
    fields = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines)}
    http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
    declared = re.search(rb"(?i)\r\ncontent-length: *([0-9]+)", http)
    revisit = fields["warc-type"] == "revisit"
    return {
        "record_id": fields["warc-record-id"], "record_type": fields["warc-type"], "uri": fields.get("warc-target-uri"), "refers_to": fields.get("warc-refers-to"),
        "payload_digest": base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex(), "payload_bytes": int(declared[1]), "payload": None if revisit else payload,
    }


def _marked(pages: DataFrame, least: int) -> DataFrame:
    """(page_id, uri, payload, sha1, leader): each page with the id of the response that it revisits, in one field, or null."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    slim = pages.select("page_id", F.col("url").alias("uri"), payload.alias("payload"))
    keyed = slim.select("*", F.sha1("payload").alias("sha1"), F.when(F.octet_length("payload") >= least, F.sha2("payload", 256)).alias("key"))
    groups = keyed.where("key IS NOT NULL").groupBy("key").agg(F.max("page_id").alias("leader"), F.count(F.lit(1)).alias("n"))
    groups = store(groups.where("n > 1 AND leader IS NOT NULL"), "warc-groups")
    hot = groups["n"] > pages.count() / HOT
    widely = groups.where(hot).select("key", F.col("leader").alias("hot_leader"))
    others = groups.where(~hot).select(F.col("key").alias("dealt_by"), "leader").hint("shuffle_hash")  # a group has two rows of the other side at least
    spread = F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string"))
    dealt = keyed.join(F.broadcast(widely), "key", "left").withColumn("dealt_by", F.when(F.col("hot_leader").isNull(), F.col("key")))
    found = dealt.withColumn("dealt_by", F.coalesce("dealt_by", spread)).join(others, "dealt_by", "left")
    leader = F.coalesce("hot_leader", "leader")
    of = F.when(leader.isNotNull() & ~F.col("page_id").eqNullSafe(leader), leader)
    return found.select("page_id", "uri", "payload", "sha1", of.cast("string").alias("leader"))


def _bundles(folder: str, frame_bytes: int, bundle_bytes: int, level: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = files.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        bundle, name = None, ""

        def closed() -> pa.RecordBatch:
            bundle.close()
            ids, frames, offsets, lengths = zip(*bundle.entries)
            columns = [pa.array(ids), pa.array([name] * len(ids)), pa.array(frames, pa.int32()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["record_id", "bundle", "frame", "offset", "length"])

        for batch in in_chunks(batches, "payload"):
            for page_id, uri, payload, sha1, leader in zip(*(batch.column(c).to_pylist() for c in ("page_id", "uri", "payload", "sha1", "leader"))):
                if bundle is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    bundle = BundleWriter(system.open_output_stream(f"{root}/{name}", compression=None), frame_bytes, level)
                    bundle.add(None, info_record(date))
                    bundle.end_frame()
                bundle.add(record_id(page_id), page_record(page_id, uri, payload, sha1, record_id(leader) if leader is not None else None, date))
                if bundle.written >= bundle_bytes:
                    yield closed()
                    bundle = None
        if bundle is not None:
            yield closed()

    return run


def write(pages: DataFrame, folder: str | None = None, frame_bytes: int = FRAME, bundle_bytes: int = BUNDLE, level: int = LEVEL, least: int = LEAST, date: str = DATE) -> Archive:
    """Write a record for each row of (page_id, url, html) into bundles in a new or given shared folder."""
    folder = folder or f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    index = _marked(pages, least).mapInArrow(_bundles(folder, frame_bytes, bundle_bytes, level, date), _INDEX)
    return Archive(folder, store(index, "warc-index"), dict(pages.dtypes)["page_id"])


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = files.FileSystem.from_uri(folder)
        name, reader, file = None, None, None
        kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary())
        for batch in batches:
            for bundle, frame, places in zip(*(batch.column(c).to_pylist() for c in ("bundle", "frame", "places"))):
                if bundle != name:
                    if file is not None:
                        file.close()
                    name, file = bundle, system.open_input_file(f"{root}/{bundle}")
                    reader = BundleReader(file)
                plain = reader.frame(frame)
                records = [parse_record(plain[p["offset"] : p["offset"] + p["length"]]) for p in places]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in records], t) for k, t in zip(records[0], kinds)], names=list(records[0]))
        if file is not None:
            file.close()

    return run


def read(archive: Archive, index: DataFrame | None = None) -> DataFrame:
    """The records of the archive, or those of some rows of its index; each frame that holds one is read once.

    (page_id, record_type, uri, refers_to, payload_digest, payload_bytes, payload); a revisit has no payload, and its
    digest and length are those that the record declares. A response whose bytes don't have its digest is an error.
    """
    rows = archive.index if index is None else index
    places = F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("places")
    # The index is small beside what it points to, so the tasks follow from the bytes of the records.
    tasks = -(-(rows.agg(F.sum("length")).first()[0] or 1) // TASK)
    dealt = rows.withColumn("part", F.floor(F.col("frame") / FRAMES)).repartition(int(tasks), "bundle", "part")
    frames = dealt.groupBy("bundle", "part", "frame").agg(places).sortWithinPartitions("bundle", "frame").drop("part")
    page = lambda c: F.when(F.col(c).startswith("<urn:page:"), F.url_decode(F.regexp_extract(c, "^<urn:page:(.*)>$", 1))).cast(archive.id_type)
    whole = F.col("payload").isNull() | (F.sha1("payload") == F.col("payload_digest")) & (F.octet_length("payload") == F.col("payload_bytes"))
    digest = F.when(whole, F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("damaged payload of "), "record_id")))
    return frames.mapInArrow(_read(archive.folder), _RECORD).select(
        page("record_id").alias("page_id"), "record_type", "uri", page("refers_to").alias("refers_to"), digest.alias("payload_digest"), "payload_bytes", "payload"
    )


def lookup(archive: Archive, pages: DataFrame) -> DataFrame:
    """The records of the ids in ``pages`` (page_id), by the index: only frames that hold one of them are read."""
    text = F.col("page_id").cast("string")
    encoded = F.url_encode(text)
    for other, own in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):  # as record_id has them
        encoded = F.replace(encoded, F.lit(other), F.lit(own))
    identifier: Column = F.when(text.isNull(), "<urn:page>").otherwise(F.concat(F.lit("<urn:page:"), encoded, F.lit(">")))
    wanted = pages.select(identifier.alias("record_id")).distinct()
    return read(archive, archive.index.join(wanted, "record_id", "left_semi"))


def with_payloads(records: DataFrame) -> DataFrame:
    """Revisits with the payload of the response that they refer to; ``records`` is read twice."""
    held = records.where("record_type = 'response' AND page_id IS NOT NULL").select(F.col("page_id").alias("refers_to"), F.col("payload").alias("referred")).dropDuplicates(["refers_to"])
    return records.join(held, "refers_to", "left").withColumn("payload", F.coalesce("payload", "referred")).drop("referred")


def orphans(archive: Archive) -> DataFrame:
    """(path) of bundles that the index doesn't name, left by tasks that were lost; only file names are read."""
    spark = archive.index.sparkSession
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(archive.folder).select("path")
    named = archive.index.select("bundle").distinct()
    return found.withColumn("bundle", F.substring_index("path", "/", -1)).join(named, "bundle", "left_anti").select("path")


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read(write(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    response = F.col("record_type") == "response"
    n, digest = F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")), F.when(response, F.sha1("payload")).otherwise(F.col("payload_digest"))
    return found.select("page_id", n.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")


OP11_SQL = """
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN n >= 1000 AND page_id < last_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id < last_id THEN last_id END AS refers_to
FROM (
  SELECT page_id, html, n, max(page_id) OVER (PARTITION BY html) AS last_id
  FROM (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages)
)
"""
