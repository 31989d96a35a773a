"""Archives: exact round trip, types of records, seek table, look-up by frame, damage, odd rows."""

import hashlib
import os

import pytest
import zstandard

from tracemill.llm import warc

BIG = "<p>" + "é body " * 200
SCHEMA = "page_id long, url string, html string, payload string"
ROWS = [
    (1, "http://a.example/1", BIG, "clash"), (5, "http://a.example/ 5\r\nX: y", BIG, None), (9, None, BIG, "clash"), (9, None, BIG, "clash"), (2, "http://b.example/", "short", "x"), (3, "http://b.example/3", "short", "x"),
    (4, "http://c.example/", None, "x"), (None, "http://d.example/", BIG, "x"), (None, "http://d.example/", BIG + "!", "x"), (None, "http://e.example/", BIG + "!", "x"), (6, "http://f.example/", BIG + "\r\n\r\nWARC/1.1\r\n", "x"), (7, "", "", "x"),
]


def contract(rows):
    text = lambda r: (r[2] or "").encode()
    last = {}
    for r in rows:
        if len(text(r)) >= 1000 and r[0] is not None:
            last[text(r)] = max(r[0], last.get(text(r), r[0]))
    out = []
    for r in rows:
        of = last.get(text(r))
        of = None if of == r[0] else of
        out.append((r[0], len(text(r)), hashlib.sha1(text(r)).hexdigest(), "response" if of is None else "revisit", of))
    return sorted(map(str, out))


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.mark.parametrize("frame, bundle, hot", [(1 << 20, 1 << 28, 1000), (1, 1, 2), (4000, 2000, 1000)])
def test_round_trip(spark, pages, monkeypatch, frame, bundle, hot):
    monkeypatch.setattr(warc, "HOT", hot)
    archive = warc.write(pages, frame_bytes=frame, bundle_bytes=bundle)
    got = warc.read(archive).collect()
    assert sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got) == contract(ROWS)
    assert sorted(bytes(r.payload).decode() for r in got if r.record_type == "response" and r.page_id is not None) == sorted([BIG, BIG, "short", "short", "", BIG + "\r\n\r\nWARC/1.1\r\n", ""])
    whole = warc.with_payloads(warc.read(archive)).collect()
    assert all(hashlib.sha1(bytes(r.payload)).hexdigest() == r.payload_digest for r in whole) and len(whole) == len(ROWS)
    assert {r.uri for r in got if r.page_id == 5} == {"http://a.example/%205%0D%0AX:%20y"}
    assert warc.orphans(archive).collect() == []


def test_files_are_plain_zstandard_with_a_seek_table(pages):
    archive = warc.write(pages, frame_bytes=2000)
    names = [r.bundle for r in archive.index.select("bundle").distinct().collect()]
    records = 0
    for name in names:
        with open(f"{archive.folder}/{name}", "rb") as file:
            data = file.read()
        plain = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
        records += plain.count(b"WARC-Record-ID: <urn:page")
        assert plain.count(b"WARC-Type: warcinfo") == 1
        assert data[-4:] == (0x8F92EAB1).to_bytes(4, "little")
    assert records == len(ROWS)


def test_lookup_reads_only_the_frames_asked_for(spark, pages):
    archive = warc.write(pages, frame_bytes=1)
    wanted = spark.createDataFrame([(6,), (2,), (77,)], "page_id long")
    assert sorted(r.page_id for r in warc.lookup(archive, wanted).collect()) == [2, 6]
    place = archive.index.where("record_id = '<urn:page:6>'").first()
    with open(f"{archive.folder}/{place.bundle}", "r+b") as file:  # another frame of its bundle no longer matters
        reader = warc.BundleReader(_File(file))
        at, packed, _ = reader.frames[0]
        file.seek(at)
        file.write(b"\0" * packed)
    assert [bytes(r.payload).decode() for r in warc.lookup(archive, wanted.where("page_id = 6")).collect()] == [ROWS[10][2]]


class _File:
    def __init__(self, file):
        self.seek, self.read = file.seek, file.read
        self._name = file.name

    def size(self):
        return os.path.getsize(self._name)


def test_damage_is_an_error(spark, pages):
    archive = warc.write(pages.where("page_id = 2"))
    place = archive.index.first()
    path = f"{archive.folder}/{place.bundle}"
    with open(path, "rb") as file:
        reader = warc.BundleReader(_File(file))
        plain = [reader.frame(k) for k in range(len(reader.frames))]
    with open(path, "wb") as file:
        writer = warc.BundleWriter(file)
        for frame in plain:
            writer.add(None, frame.replace(b"short", b"shore"))
            writer.end_frame()
        writer.close()
    with pytest.raises(Exception, match="damaged payload"):
        warc.read(archive).collect()


def test_orphans_empty_tables_and_text_ids(spark, pages):
    archive = warc.write(pages)
    with open(f"{archive.folder}/lost.warc.zst", "wb") as file:
        file.write(b"half a bundle")
    assert [os.path.basename(r.path) for r in warc.orphans(archive).collect()] == ["lost.warc.zst"]
    assert len(warc.read(archive).collect()) == len(ROWS)
    none = warc.write(spark.createDataFrame([], SCHEMA))
    assert warc.read(none).collect() == []
    named = warc.write(spark.createDataFrame([("a* b/~ü:>+", "u", BIG), ("z", "u", BIG)], "page_id string, url string, html string"))
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in warc.read(named).collect()) == [("a* b/~ü:>+", "revisit", "z"), ("z", "response", None)]
    assert [r.record_type for r in warc.lookup(named, spark.createDataFrame([("a* b/~ü:>+",)], "page_id string")).collect()] == ["revisit"]


def test_query(spark, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted(str(tuple(r)) for r in warc.op11_warc(spark, str(tmp_path)).collect()) == contract(ROWS)
