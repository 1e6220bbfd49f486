"""Records of CSV files that are read in many splits, and archives as columns."""

import csv
import io
import random
import zipfile

import pytest

from cohortlens.sources import readers, records


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def rows_of(seed, n):
    r = random.Random(seed)
    pieces = ["plain", "", "a,b", 'say "x"', "two\nlines", "\n\n", 'end"', "é€ü", "three\nshort\nlines of it", "x" * 700 + "\n" + "y" * 900]
    return [(str(i), "".join(r.choice(pieces) for _ in range(r.randrange(3))), r.choice(pieces)) for i in range(n)]


def write(path, rows, encoding, newline="\n"):
    with open(path, "w", encoding=encoding, newline="") as f:
        w = csv.writer(f, lineterminator=newline)
        w.writerows([("id", "text", "more"), *rows])


@pytest.mark.parametrize("encoding,newline", [("utf-8", "\n"), ("cp1252", "\r\n")])
def test_quoted_line_breaks_over_many_splits(spark, tmp_path, small_splits, encoding, newline):
    rows = rows_of(1, 120)
    write(tmp_path / "a.csv", rows[:90], encoding, newline)
    write(tmp_path / "b.csv", rows[90:], encoding, newline)
    lines = records.split_lines(spark, str(tmp_path))
    states = records.parities(lines).collect()
    assert len(states) > 50 and sum(s.inside for s in states) > 10  # splits, and those that begin inside a field
    got = records.read_csv(spark, str(tmp_path), encoding)
    assert got.columns == ["id", "text", "more"] and lines.rdd.getNumPartitions() > 20
    found = sorted((r.id, r.text or "", r.more or "") for r in got.collect())
    assert found == sorted(rows)


def test_files_without_such_breaks_are_read_line_by_line(spark, tmp_path, small_splits):
    rows = [(str(i), "a,b" * (i % 3), "é€") for i in range(80)]
    write(tmp_path / "a.csv", rows, "cp1252")
    got = records.read_csv(spark, str(tmp_path / "a.csv"), "cp1252")
    assert sorted((r.id, r.text or "", r.more) for r in got.collect()) == sorted(rows)
    assert "multiLine" not in got._jdf.queryExecution().toString()


def test_open_quotes_and_other_layouts_are_errors(spark, tmp_path):
    (tmp_path / "open.csv").write_text('id,text\n1,"never closed\n2,x\n')
    with pytest.raises(ValueError, match="ends inside"):
        records.read_csv(spark, str(tmp_path / "open.csv"))
    (tmp_path / "two").mkdir()
    (tmp_path / "two" / "a.csv").write_text('id,text\n1,"a\nb"\n')
    (tmp_path / "two" / "b.csv").write_text('id,other\n1,"a\nb"\n')
    with pytest.raises(ValueError, match="layouts"):
        records.read_csv(spark, str(tmp_path / "two"))


def test_encoding_is_found_from_all_lines(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_bytes(("id,text\n" + "1,plain text of some length\n" * 60 + "2,é\n").encode("utf-8-sig"))
    (tmp_path / "b.csv").write_bytes(("id,text\n" + "1,plain text of some length\n" * 60 + "2,é\n").encode("cp1252"))
    found = {r.path.rsplit("/", 1)[1]: r.encoding for r in records.detect_encodings(spark, str(tmp_path)).collect()}
    assert found == {"a.csv": "utf-8-sig", "b.csv": "cp1252"}
    back = readers.read_detected(spark, str(tmp_path))
    assert back.count() == 122 and {r.TEXT for r in back.filter("ID = 2").collect()} == {None}  # read_survey casts what is no code column


def zipped(members):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for name, body in members.items():
            z.writestr(name, body)
    return buf.getvalue()


def test_archives_to_columns(spark):
    rows = [("/a.zip", zipped({"x_rv.csv": "﻿id, Name \r\n1,\"Łódź\r\nsecond \"\"line\"\"\"\r\n\r\n2,plain\r\n".encode(), "long_name.csv": b"no\n1\n"})),
            ("/b.zip", zipped({"y.csv": "name,extra,id\ncafé €,7,3\n".encode("cp1252")})), ("/c.zip", zipped({"z.csv": b"id,name\n"}))]
    files = spark.createDataFrame(rows, "path string, content binary")
    got = readers.read_archives(files)
    assert set(got.columns) == {"path", "member", "encoding", "ID", "NAME", "EXTRA"}
    found = {(r.path, r.member, r.encoding, r.ID, r.NAME, r.EXTRA) for r in got.collect()}
    assert found == {("/a.zip", "x_rv.csv", "utf-8-sig", "1", 'Łódź\r\nsecond "line"', None), ("/a.zip", "x_rv.csv", "utf-8-sig", "2", "plain", None), ("/b.zip", "y.csv", "cp1252", "3", "café €", "7")}
    assert readers.read_archives(files.limit(0)).count() == 0
    with pytest.raises(Exception, match="no CSV"):
        readers.read_archives(spark.createDataFrame([("/d.zip", zipped({"a.txt": b"x"}))], "path string, content binary"))
    with pytest.raises(Exception, match="ends inside"):
        readers.read_archives(spark.createDataFrame([("/e.zip", zipped({"a.csv": b'id\n"x\n'}))], "path string, content binary"))
