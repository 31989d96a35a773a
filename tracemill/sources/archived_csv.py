"""What the CSV members of ZIP archives hold: a Spark source ``archived_csv`` with one partition for each member.

``spark.dataSource.register(ArchivedCsv)``, then ``spark.read.format("archived_csv").load(folder)``. The driver
lists members only; a task reads its member once, in pieces, so a member of any size takes little memory. Executors
must reach the folder (local, HDFS, S3, GCS). ``n_lines`` counts physical lines after the first, not records,
as quoted fields may hold line ends. A member that can't be read gives a row with ``error``.
"""

from __future__ import annotations

import csv
import re
import zipfile
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Words in the name of a column that may hold labels.
LABEL_WORDS = ("label", "class", "malicious", "benign", "intent", "sourceintent", "groundtruth")
PIECE, LONGEST_HEADER = 1 << 20, 16 << 20
BOM = b"\xef\xbb\xbf"


def _files(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def labels_among(columns: list[str]) -> list[str]:
    """Columns named by one of :data:`LABEL_WORDS`, as a whole or as a word of theirs."""
    parts = lambda name: {w for w in re.split("[^a-z0-9]+", name.lower()) if w}
    return [c for c in columns if "".join(re.findall("[a-z0-9]", c.lower())) in LABEL_WORDS or parts(c) & set(LABEL_WORDS)]


class Member(InputPartition):
    def __init__(self, archive: str, name: str, size: int):
        self.archive, self.name, self.size = archive, name, size


class ArchivedCsv(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archived_csv"

    def schema(self) -> str:
        return "archive string, member string, size long, encoding string, bom boolean, header string, columns array<string>, n_lines long, label_columns array<string>, error string"

    def reader(self, schema) -> DataSourceReader:
        return Reader(self.options["path"])


class Reader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[Member]:
        from pyarrow import fs

        system, root = _files(self.folder)
        archives = sorted(f.path for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file and f.path.lower().endswith(".zip"))
        found = []
        for archive in archives:
            with system.open_input_file(archive) as file, zipfile.ZipFile(file) as box:
                found += [Member(archive, i.filename, i.file_size) for i in sorted(box.infolist(), key=lambda i: i.filename) if i.filename.lower().endswith(".csv")]
        return found

    def read(self, partition: Member | None) -> Iterator[tuple]:
        if partition is None:  # no member at all
            return
        system, _ = _files(self.folder)
        told = (partition.archive, partition.name, partition.size)
        try:
            with system.open_input_file(partition.archive) as file, zipfile.ZipFile(file) as box, box.open(partition.name) as lines:
                yield (*told, *_profile(lines), None)
        except (ValueError, csv.Error, zipfile.BadZipFile) as failed:
            yield (*told, None, None, None, None, None, None, str(failed))


def _profile(lines) -> tuple:
    first = lines.readline(LONGEST_HEADER)
    if not first:
        raise ValueError("empty member")
    if len(first) == LONGEST_HEADER:
        raise ValueError("the first line has no end within 16 MiB")
    bom = first.startswith(BOM)
    encoding = "utf-8-sig" if bom else "utf-8"
    header = first.decode(encoding).rstrip("\r\n")
    columns = next(csv.reader([header]), [])
    n, last = 0, b"\n"
    while piece := lines.read(PIECE):
        n, last = n + piece.count(b"\n"), piece[-1:]
    return encoding, bom, header, columns, n + (last != b"\n"), labels_among(columns)
