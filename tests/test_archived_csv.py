"""Profiles of CSV members in archives."""

import zipfile

from tracemill.sources import archived_csv


def test_profiles(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    long = "a,b\n" + "x,y\n" * 700_000
    members = {
        "b.csv": b"\xef\xbb\xbfid,Ground-Truth,is_benign,classes\r\n1,\"two\nlines\",0,0\r\n2,x,1,1", "a.CSV": b"id\n", "long.csv": long.encode(), "quoted.csv": b'"a, b",c\n', "latin.csv": b"\xff\xfe\n1", "empty.csv": b"", "note.txt": b"x\n",
    }
    with zipfile.ZipFile(tmp_path / "one.zip", "w", zipfile.ZIP_DEFLATED) as box:
        for name, data in members.items():
            box.writestr(name, data)
    with zipfile.ZipFile(tmp_path / "sub" / "two.zip", "w") as box:
        box.writestr("dir/c.csv", "Label;x\nrow")
    spark.dataSource.register(archived_csv.ArchivedCsv)
    read = spark.read.format("archived_csv").load(str(tmp_path))
    assert read.rdd.getNumPartitions() == 7
    found = {r.member: (r.encoding, r.columns, r.n_lines, r.label_columns) for r in read.where("error IS NULL").collect()}
    assert found == {
        "b.csv": ("utf-8-sig", ["id", "Ground-Truth", "is_benign", "classes"], 3, ["Ground-Truth", "is_benign"]), "a.CSV": ("utf-8", ["id"], 0, []), "long.csv": ("utf-8", ["a", "b"], 700_000, []), "quoted.csv": ("utf-8", ["a, b", "c"], 0, []),
        "dir/c.csv": ("utf-8", ["Label;x"], 1, ["Label;x"]),
    }
    assert sorted(r.member for r in read.where("error IS NOT NULL").collect()) == ["empty.csv", "latin.csv"]


def test_no_archives(spark, tmp_path):
    spark.dataSource.register(archived_csv.ArchivedCsv)
    assert spark.read.format("archived_csv").load(str(tmp_path)).collect() == []
