"""Tables that grow together: of each batch all rows of all tables are there, or none.

A commit writes one folder per table, ``<table>/commit=<entry>``, and then one small file of the entry's
name into ``ledger/``: what batch of which stream it is, where its source stood, and rows, bounds of time and
folder by table. Only folders that the ledger names are read, so a writer that dies between two tables
leaves nothing to see; :meth:`Ledger.recover` deletes what it left. A batch that is in the ledger isn't
written again. There is one writer at a time, as of a stream with its checkpoint.

A table with ``event_key`` and ``ts_us`` can be asked which keys it holds without reading all of it: commits
whose bounds of time don't meet those of the keys are left out, then those whose Bloom filter has none of the
keys, and of the rest only row groups within the bounds are read. The filter is kept as bitmaps, one row
for each ``SLOT_KEYS`` keys or so, so it grows with its commit and stays a table.

Defined cases: a batch without rows commits empty tables; keys without a time are looked up in commits that
have rows without one; a batch that repeats a key must fold it first (``store.fresh``).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables

#: Keys to a bitmap of 32768 bits, with two bits each: one false answer in 25, in a full one.
SLOT_KEYS, BITS = 4000, 32768
_ENTRY = "entry string, stream string, batch long, offsets string, replaces array<string>, tables array<struct<name:string,folder:string,rows:long,low:long,high:long,untimed:long,slots:long>>"
_TABLE = ("name", "folder", "rows", "low", "high", "untimed", "slots")


def _hash(key: str = "event_key") -> Column:
    return F.xxhash64(key)


def _positions(h: Column) -> Column:
    return F.array(F.pmod(F.shiftright(h, 20), F.lit(BITS)), F.pmod(F.shiftright(h, 40), F.lit(BITS)))


def _bit(bitmap: Column, position: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, F.pmod(position, F.lit(8)).cast("int")) == 1


def bloom(keys: DataFrame, slots: int) -> DataFrame:
    """(slot, bitmap) of all ``event_key``."""
    h = keys.select(_hash().alias("h"))
    bits = h.select(F.pmod("h", F.lit(slots)).alias("slot"), F.explode(_positions(F.col("h"))).alias("bit"))
    return bits.groupBy("slot").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


class Ledger:
    """The tables in ``folder``, a shared one that Spark can read and write."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        #: Commits that the last :meth:`known` read, and those that its bounds of time alone would leave.
        self.read_last, self.near_last = 0, 0

    def _files(self, path: str) -> list[str]:
        system, at = tables.filesystem(self.spark, f"{self.folder}/{path}")
        return [s.getPath().getName() for s in system.listStatus(at)] if system.exists(at) else []

    def entries(self) -> list[dict]:
        """What the ledger says, one entry per commit: metadata of the size of a file listing."""
        if not self._files("ledger"):
            return []
        return [r.asDict(recursive=True) for r in self.spark.read.schema(_ENTRY).json(f"{self.folder}/ledger").where("entry IS NOT NULL").collect()]

    def live(self, name: str) -> list[dict]:
        """The commits of a table that count: those that no other one replaces."""
        entries = self.entries()
        replaced = {r for e in entries for r in e["replaces"]}
        return [t for e in entries if e["entry"] not in replaced for t in e["tables"] if t["name"] == name]

    def _load(self, parts: Sequence[dict]) -> DataFrame | None:
        held = [p for p in parts if p["rows"]]
        if not held:
            return None
        return self.spark.read.option("basePath", f"{self.folder}/{held[0]['name']}").parquet(*[f"{self.folder}/{p['folder']}" for p in held])

    def read(self, name: str) -> DataFrame | None:
        """All rows of a table with the ``commit`` of each, None before its first row."""
        return self._load(self.live(name))

    def known(self, name: str, keys: DataFrame) -> DataFrame | None:
        """The stored ones among (event_key, ts_us), reading only commits that may hold them. ``keys`` is read twice."""
        asked = keys.agg(F.min("ts_us").alias("low"), F.max("ts_us").alias("high"), F.count_if(F.col("ts_us").isNull()).alias("untimed")).first()
        meets = lambda p: bool(asked.untimed and p["untimed"]) or (asked.low is not None and p["low"] is not None and p["low"] <= asked.high and p["high"] >= asked.low)
        near = [p for p in self.live(name) if p["rows"] and meets(p)]
        self.near_last, self.read_last = len(near), 0
        if not near:
            return None
        folders = self.spark.createDataFrame([(p["folder"], p["slots"]) for p in near], "folder string, slots long")
        maps = self.spark.read.parquet(*[f"{self.folder}/{self._index(p['folder'])}" for p in near])
        probes = keys.select(_hash().alias("h")).crossJoin(F.broadcast(folders))  # one row per commit of these times
        probes = probes.select("folder", F.pmod("h", F.col("slots")).alias("slot"), _positions(F.col("h")).alias("at"))
        held = probes.join(maps, ["folder", "slot"]).where(_bit(F.col("bitmap"), F.col("at")[0]) & _bit(F.col("bitmap"), F.col("at")[1]))
        likely = {r.folder for r in held.select("folder").distinct().collect()}
        self.read_last = len(likely)
        found = self._load([p for p in near if p["folder"] in likely])
        if found is None:
            return None
        within = F.col("ts_us").isNull() if asked.low is None else F.col("ts_us").between(asked.low, asked.high)
        return found.where(within | F.col("ts_us").isNull() if asked.untimed else within).select("event_key")

    @staticmethod
    def _index(folder: str) -> str:
        return f"index/{folder.replace('/', '-')}"

    def _write(self, name: str, entry: str, rows: DataFrame) -> dict:
        folder = f"{name}/commit={entry}-{uuid.uuid4().hex[:8]}"
        timed = {"event_key", "ts_us"} <= set(rows.columns)
        (rows.repartitionByRange("ts_us").sortWithinPartitions("ts_us") if timed else rows).write.parquet(f"{self.folder}/{folder}")
        written = self.spark.read.schema(rows.schema).parquet(f"{self.folder}/{folder}")
        if not timed:
            return dict(zip(_TABLE, (name, folder, written.count(), None, None, 0, 0)))
        seen = written.agg(F.count("*").alias("n"), F.min("ts_us").alias("low"), F.max("ts_us").alias("high"), F.count_if(F.col("ts_us").isNull()).alias("untimed")).first()
        slots = -(-seen.n // SLOT_KEYS) or 1
        bloom(written, slots).select(F.lit(folder).alias("folder"), "slot", "bitmap").write.parquet(f"{self.folder}/{self._index(folder)}")
        return dict(zip(_TABLE, (name, folder, seen.n, seen.low, seen.high, seen.untimed, slots)))

    def _publish(self, entry: dict) -> None:
        system, final = tables.filesystem(self.spark, f"{self.folder}/ledger/{entry['entry']}.json")
        _, draft = tables.filesystem(self.spark, f"{self.folder}/drafts/{entry['entry']}-{uuid.uuid4().hex}")
        system.mkdirs(final.getParent())
        out = system.create(draft, True)
        out.write(bytearray((json.dumps(entry) + "\n").encode()))
        out.close()
        if not system.rename(draft, final):
            raise RuntimeError(f"another writer has committed {entry['entry']}")

    def has(self, stream: str, batch: int) -> bool:
        return f"{stream}-{batch}.json" in self._files("ledger")

    def commit(self, stream: str, batch: int, parts: dict[str, DataFrame], offsets: str | None = None, replaces: Sequence[str] = ()) -> bool:
        """Write all tables of a batch and then its ledger entry; False if it is there already."""
        if self.has(stream, batch):
            return False
        entry = f"{stream}-{batch}"
        written = [self._write(name, entry, rows) for name, rows in parts.items()]
        self._publish({"entry": entry, "stream": stream, "batch": batch, "offsets": offsets, "replaces": list(replaces), "tables": written})
        return True

    def recover(self, replaced: bool = False) -> list[str]:
        """Delete folders that the ledger doesn't name, and on demand those of replaced commits that no reader needs any more."""
        entries = self.entries()
        gone = {r for e in entries for r in e["replaces"]} if replaced else set()
        named = {t["folder"] for e in entries if e["entry"] not in gone for t in e["tables"]}
        indexes = {self._index(f) for f in named}
        left = [f"{kind}/{f}" for kind in self._files("") if kind not in ("ledger", "drafts") for f in self._files(kind)]
        lost = [f for f in left if f not in named and f not in indexes] + [f"drafts/{f}" for f in self._files("drafts")]
        tables.delete(self.spark, *[f"{self.folder}/{f}" for f in lost])
        return lost

    def compact(self, least_rows: int = 1_000_000) -> bool:
        """Put the rows of all commits of fewer rows into one, which replaces them; earlier readers keep their folders."""
        entries = self.entries()
        replaced = {r for e in entries for r in e["replaces"]}
        small = [e for e in entries if e["entry"] not in replaced and max((t["rows"] for t in e["tables"]), default=0) < least_rows]
        if len(small) < 2:
            return False
        parts = {name: self._load([t for e in small for t in e["tables"] if t["name"] == name]) for name in {t["name"] for e in small for t in e["tables"]}}
        kept = {name: rows.drop("commit") for name, rows in parts.items() if rows is not None}
        return self.commit(f"compact-{uuid.uuid4().hex[:8]}", len(entries), kept, replaces=[e["entry"] for e in small])
