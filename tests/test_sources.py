import os
import zipfile

import pytest

from cohortlens.sources import parsers, readers, sinks


def test_component_reader(spark, tmp_path):
    p = tmp_path / "ic_2022.csv"
    p.write_bytes("UNITID, InstNM ,CONTROL,OTHER\n1,Universit\xe9,2,x\n".encode("latin-1"))
    r = readers.read_component(spark, "institutional_characteristics", 2022, str(p)).collect()[0]
    assert r.asDict() == {"unitid": 1, "institution_name": "Universit\xe9", "control": 2.0, "survey_year": 2022}
    with pytest.raises(KeyError):
        readers.read_component(spark, "nothing", 2022, str(p))


def test_survey_reader(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text("﻿unitid,CipCode,Val\n10, 01.0000 ,.\n11,99,3.5\n", encoding="utf-8")
    out = [tuple(r) for r in readers.read_survey(spark, str(p), ["UNITID", "CIPCODE", "VAL"]).collect()]
    assert out == [(10, "01.0000", None), (11, "99", 3.5)]
    with pytest.raises(KeyError, match="GONE"):
        readers.read_survey(spark, str(p), ["UNITID", "GONE"])


def test_encoding_archives_and_provenance(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("caf\xe9".encode("utf-8"))
    (tmp_path / "b.csv").write_bytes("caf\xe9".encode("cp1252"))
    got = {os.path.basename(r["path"]): r["encoding"] for r in readers.detect_encoding(readers.binary_files(spark, f"{tmp_path}/*.csv")).collect()}
    assert got == {"a.csv": "utf-8-sig", "b.csv": "cp1252"}
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("data_long_name.csv", "old\n1\n")
        z.writestr("data_rv.csv", "new\n2\n")
        z.writestr("readme.txt", "n")
    lines = readers.intake_archives(readers.binary_files(spark, f"{tmp_path}/*.zip")).orderBy("line_no").collect()
    assert [(r["member"], r["line"]) for r in lines] == [("data_rv.csv", "new"), ("data_rv.csv", "2")]
    assert readers.pick_member(["b.csv", "aa_rv.csv"], "first") == "aa_rv.csv" and readers.pick_member(["long.csv", "a.csv"], "shortest") == "a.csv"
    assert readers.pick_member(["x.txt"], "first") is None
    prov = readers.provenance(readers.binary_files(spark, f"{tmp_path}/a.csv")).collect()[0]
    assert prov["bytes"] == 5 and len(prov["sha256"]) == 64


def test_fiscal_indexes(frame):
    months = [(f"S {y} M{m:02d} {v}",) for y, m, v in [(2020, 7, 110), (2020, 9, 111), (2020, 11, 112), (2021, 1, 110), (2021, 3, 111), (2021, 5, 112), (2021, 7, 200), (2020, 13, 999)]]
    assert [tuple(r) for r in parsers.fiscal_cpi(frame("text string", months), "S").collect()] == [(2020, 111.0)]
    halves = [("S 2015 S02 238.0",), ("S 2016 S01 238.75",), ("S 2016 S02 240.0",), ("T 2017 S01 1",)]
    assert [tuple(r) for r in parsers.semiannual_cpi(frame("text string", halves), "S").collect()] == [(2015, 238.375)]


def test_curated_and_schema_lock(spark, frame, tmp_path):
    d = frame("UNITID int, v double", [(1, float("nan")), (2, 3.0)])
    sinks.write_curated(d, str(tmp_path), "t", period="2023", grain=["UNITID"])
    back, meta = readers.read_curated(spark, str(tmp_path), "t")
    assert meta["rows"] == 2 and meta["columns"] == ["UNITID", "v"] and sorted((r[0], r[1]) for r in back.collect() if r[1] is not None) == [(2, 3.0)]
    with pytest.raises(ValueError):
        sinks.write_curated(d.union(d), str(tmp_path), "t2", period="2023", grain=["UNITID"])
    lock = str(tmp_path / "lock")
    assert sinks.lock_schema(d, lock).collect()[0]["status"] == "created"
    assert sinks.lock_schema(d, lock, strict=True).collect()[0]["status"] == "unchanged"
    changed = sinks.lock_schema(d.withColumnRenamed("v", "w"), lock).collect()[0]
    assert (changed["status"], changed["added"], changed["removed"]) == ("changed", ["w"], ["v"])
    with pytest.raises(ValueError):
        sinks.lock_schema(d.drop("v"), lock, strict=True)


def test_period_check(frame):
    intro = frame("table string, text string", [("A", "Fall 2023 – release"), ("B", ""), ("C", "Fall 2022")])
    want = frame("table string, expected string", [("A", "fall 2023 -"), ("B", "fall"), ("C", "fall 2023"), ("D", "x")])
    assert {r["table"]: r["ok"] for r in readers.check_periods(intro, want).collect()} == {"A": True, "B": False, "C": False, "D": False}
    with pytest.raises(ValueError):
        readers.assert_periods(intro, want)


def test_landed_zips_are_zips():
    import io
    import zipfile

    from cohortlens.plans import landed
    members = [("a.csv", b"n,q\r\n1,2\r\n"), ("a_rv.csv", "François €".encode("cp1252")), ("empty.txt", b"")]
    with zipfile.ZipFile(io.BytesIO(landed.zip_bytes(members))) as z:
        assert z.testzip() is None and [(n, z.read(n)) for n in z.namelist()] == members
