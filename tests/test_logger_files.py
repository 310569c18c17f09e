import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fleetseries.sources import byte_ranges, flat_csv
from fleetseries.sources import logger_files as L

INFO = '"TOA5","St1","CR1000X","1234","OS.05","CPU:prog.CR1X","4711","Min"'


def write(path, lines, raw=None):
    if raw is not None:
        path.write_bytes(raw)
    else:
        path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


@pytest.fixture()
def fleet(tmp_path):
    d = tmp_path / "st1"
    d.mkdir()
    write(d / "st1_Min.dat", [INFO, '"TIMESTAMP","RECORD","AirT","Status","Extra"', '"TS","RN","degC","",""',
                              '"","","Avg","Smp","Smp"',
                              '"2026-01-01 00:20:00",0,1.5,"OK",7',
                              '"2026-01-01 00:30:00",1,"NAN","ERR",8',
                              '"2026-01-01 00:30:00",2,2.5,"OK",9'])
    write(d / "st1_Min_Historical.dat", [INFO, '"TIMESTAMP","RECORD","AirT","Status"', '"TS","RN","degC",""',
                                         '"","","Avg","Smp"',
                                         '"2026-01-01 00:00:00",5,0.5,"OK"',
                                         '"01/01/2026 00:10:00",6,0.7,"OK"'])
    bad = b'"2026-01-01 00:40:00",3,3.5,"\xff\xffX",1\n'
    raw = ("\n".join([INFO, '"TIMESTAMP","RECORD","AirT","Status","Extra"', '"TS","RN","","",""',
                      '"","","","",""']) + "\n").encode() + bad
    write(d / "st1_Min.dat.backup", None, raw)
    write(d / "st1_Min.dat.backup2", ['"NOTTOA5","a","b","c","d","e","f","g"', "x", "y", "z"])
    write(d / "st1_Min.dat.backup3", [INFO, '"TIMESTAMP"'])
    write(d / "st1_Min.dat.backup4", ['"TOA5","only","seven","fields","a","b","c"', "x", "y", "z"])
    write(d / "st1_Min.dat.backup5", [INFO, '"TIMESTAMP","RECORD"', '"TS","RN"', '"",""'])
    write(d / "notes.txt", ["hello"])
    return str(tmp_path)


def headers_of(spark, root):
    return L.scan_headers(L.list_files(spark, root))


def test_header_scan_valid_and_reasons(spark, fleet):
    h = {r["file_name"].split("/")[-1]: r for r in headers_of(spark, fleet).collect()}
    assert h["st1_Min.dat"]["valid"] and h["st1_Min.dat"]["columns"] == ["TIMESTAMP", "RECORD", "AirT",
                                                                          "Status", "Extra"]
    assert h["st1_Min.dat"]["program_name"] == "CPU:prog.CR1X"
    assert h["st1_Min.dat"]["agg_types"] == ["", "", "Avg", "Smp", "Smp"]
    assert not h["st1_Min.dat.backup2"]["valid"] and "marker" in h["st1_Min.dat.backup2"]["reason"]
    assert not h["st1_Min.dat.backup3"]["valid"] and "fewer than 4" in h["st1_Min.dat.backup3"]["reason"]
    assert not h["st1_Min.dat.backup4"]["valid"] and "7 found" in h["st1_Min.dat.backup4"]["reason"]
    assert h["st1_Min.dat.backup5"]["valid"]


def test_header_scan_reads_only_heads(spark, tmp_path):
    big = b"\n".join(b'"2026-01-01 00:00:00",%d' % i for i in range(200_000))
    write(tmp_path / "big.dat", None, "\n".join([INFO, '"TIMESTAMP","RECORD"', '"TS","RN"', '"",""', ""]).encode() + big)
    write(tmp_path / "junk.dat", None, b"x" * 3_000_000)
    (tmp_path / "empty.dat").write_bytes(b"")
    wide = ",".join(f'"c{i}"' for i in range(40_000))
    write(tmp_path / "wide.dat", [INFO, '"TIMESTAMP",' + wide, '"TS",' + wide, '"",' + wide])
    empty = spark.createDataFrame([(str(tmp_path / "empty.dat"), 0)], "file_name string, size long")
    listed = L.list_files(spark, str(tmp_path)).select("file_name", "size").unionByName(empty)
    h = {r["file_name"].split("/")[-1]: r for r in L.scan_headers(listed).collect()}
    assert h["big.dat"]["valid"] and h["big.dat"]["bytes_read"] <= byte_ranges.HEAD_BYTES < h["big.dat"]["size"]
    assert not h["junk.dat"]["valid"] and h["junk.dat"]["bytes_read"] <= byte_ranges.HEAD_BYTES
    assert not h["empty.dat"]["valid"] and "fewer than 4" in h["empty.dat"]["reason"]
    assert h["wide.dat"]["valid"] and len(h["wide.dat"]["columns"]) == 40_001


def test_body_scan_tokens_fallback_bad_bytes_and_drift(spark, fleet):
    body = L.scan_body(headers_of(spark, fleet)).collect()
    by = {(r["file_name"].split("/")[-1], r["cells"]["RECORD"]): r for r in body}
    assert by[("st1_Min.dat", "1")]["cells"]["AirT"] is None          # NAN -> missing
    assert by[("st1_Min.dat", "1")]["cells"]["Status"] == "ERR"
    assert "Extra" not in by[("st1_Min_Historical.dat", "5")]["cells"]  # column only in the live file
    assert by[("st1_Min_Historical.dat", "6")]["time"] == datetime(2026, 1, 1, 0, 10)  # fallback format
    assert "�" in by[("st1_Min.dat.backup", "3")]["cells"]["Status"]  # bad bytes replaced
    names = {r["file_name"].split("/")[-1] for r in body}
    assert "st1_Min.dat.backup5" not in names                        # header only: no rows
    assert len(body) == 6


def test_ranges_of_any_size_give_each_line_once(spark, tmp_path, monkeypatch):
    rnd = random.Random(3)
    rows = [f'"2026-01-01 00:00:{i % 60:02d}",{i},"{"é" * rnd.randint(0, 30)}"' for i in range(300)]
    text = "\r\n".join([INFO, '"TIMESTAMP","RECORD","T"', '"TS","RN",""', '"","",""', *rows[:150]]) + "\n\n"
    text += "\n".join(rows[150:])                                    # a blank line, other line ends, no last one
    data = text.encode()
    write(tmp_path / "a b.dat", None, data)
    headers = headers_of(spark, str(tmp_path))
    want = None
    for size, piece in ((7, 16), (100, 64), (1 << 20, 1 << 20)):
        monkeypatch.setattr(byte_ranges, "PIECE_BYTES", piece)
        got = [(r["row_pos"], r["cells"]["RECORD"], r["cells"]["T"]) for r in L.scan_body(headers, range_bytes=size).collect()]
        got.sort()
        assert [int(r[1]) for r in got] == list(range(300))
        assert all(data[p:].startswith(rows[i].encode()) for i, (p, _, _) in enumerate(got))
        want = want or got
        assert got == want


def test_csv_fields_is_linear_and_unquotes(spark):
    cases = {'a,b': ["a", "b"], '"a,b",c': ["a,b", "c"], '"a""b",': ['a"b', ""], '': [""], ',,': ["", "", ""],
             '"open,x': ["open,x"], '1.5,"NAN"\r': ["1.5", "NAN"], ',"x y"': ["", "x y"]}
    long = ",".join(["1"] * 50_000)
    df = spark.createDataFrame([(k,) for k in [*cases, long]], "line string")
    got = {r["line"]: r["f"] for r in df.select("line", L.csv_fields(F.col("line")).alias("f")).collect()}
    assert {k: got[k] for k in cases} == cases and len(got[long]) == 50_000


def test_ingest_tells_rows_from_rejects_in_one_write(spark, tmp_path):
    d = tmp_path / "in" / "st 9"
    d.mkdir(parents=True)
    write(d / "st9_Min.dat", [INFO, '"TIMESTAMP","RECORD","T","T"', '"TS","RN","",""', '"","","",""',
                              '"2026-01-01 00:00:00",0,1,2', '"soon",1,1,2', '"2026-01-01 00:10:00",2',
                              '"2026-01-01 00:20:00",3,1,2,"x,y"', '"",4'])
    write(d / "notes.dat", ["hello"])
    rows, rejects = L.ingest(headers_of(spark, str(tmp_path / "in")), str(tmp_path / "out"),
                             lambda c: F.regexp_extract(c, r"/([^/]+)/[^/]+$", 1))
    got = {r["cells"]["RECORD"]: (r["dataset_id"], r["cells"]["T"]) for r in rows.collect()}
    assert got == {"0": ("st 9", "1"), "2": ("st 9", None), "3": ("st 9", "1")}
    tags = sorted((r["reason"], r["kept"], (r["line"] or "")[:6], r["row_pos"] is None) for r in rejects.collect())
    assert tags == [("fewer than 4 header rows", False, "", True), ("long_line", True, '"2026-', False),
                    ("no_time", False, '"",4', False), ("no_time", False, '"soon"', False), ("repeated_column", True, "", True),
                    ("short_line", True, '"",4', False), ("short_line", True, '"2026-', False)]
    empty, none = L.ingest(headers_of(spark, str(tmp_path / "in")).limit(0), str(tmp_path / "nil"), lambda c: c)
    assert empty.count() == 0 and none.count() == 0


def test_discovery_by_pattern_family(spark, fleet):
    listing = L.list_files(spark, fleet)
    src = spark.createDataFrame([("st1", "st1/st1_Min.dat", None)],
                                "dataset_id string, file_pattern string, historical_suffix string")
    got = {r["file_name"].split("/")[-1]: r["file_role"] for r in L.discover(listing, src, fleet).collect()}
    assert "notes.txt" not in got
    assert got["st1_Min.dat"] == "live" and got["st1_Min_Historical.dat"] == "archived"
    assert got["st1_Min.dat.backup2"] == "archived"


def test_prefix_table_names_do_not_match(spark, tmp_path):
    d = tmp_path / "s"
    d.mkdir()
    for n in ["s_Min.dat", "s_Min10.dat", "s_Min60.dat", "s_Min_Historical.dat"]:
        write(d / n, [INFO])
    src = spark.createDataFrame([("s", "s/s_Min.dat", None)], "dataset_id string, file_pattern string, "
                                "historical_suffix string")
    got = sorted(r["file_name"].split("/")[-1] for r in
                 L.discover(L.list_files(spark, str(tmp_path)), src, str(tmp_path)).collect())
    assert got == ["s_Min.dat", "s_Min_Historical.dat"]


def test_flat_csv_window_and_own_columns_per_file(spark, tmp_path):
    (tmp_path / "station_x.csv").write_text("timestamp,temp,humidity\n" + "\n".join(
        f"2026-01-01 00:{10 * i:02d}:00,{1.5 + i},{60 + i}" for i in range(5)) + "\n")
    (tmp_path / "y.csv").write_text('\ufeffgust,"temp",timestamp,temp\n"a,b",NA,2026-01-01 00:10:00,7\n1,2,not a time,3\n')
    (tmp_path / "z.csv").write_text("time,temp\n1,2\n")
    headers = flat_csv.scan_headers(L.list_files(spark, str(tmp_path)))
    reasons = {r["file_name"].split("/")[-1]: r["reason"] for r in headers.collect()}
    assert reasons == {"station_x.csv": None, "y.csv": None, "z.csv": "no column timestamp"}
    df = flat_csv.scan_flat_csv(headers)
    from fleetseries.operators.reconcile import time_window
    win = time_window(df, "2026-01-01 00:10:00", "2026-01-01 00:30:00").collect()
    assert sorted(r["cells"]["humidity"] for r in win if "humidity" in r["cells"]) == ["61", "62", "63"]
    assert [dict(r["cells"]) for r in win if "gust" in r["cells"]] == [{"gust": "a,b", "temp": None, "temp.1": "7"}]
    assert df.filter("time is null").count() == 1


def test_globs_against_the_standard_library(spark, tmp_path):
    names = ["s1/a_Min.dat", "s1/b_Min.dat", "s1/sub/a_Min.dat", "s2 x/a_Min.dat", "s2 x/a]b.dat", "t/a+b.dat", "t/A_Min.dat",
             "top.dat", "t/a_Min_Historical.dat", "t/a_Min.dat.backup1", "t/.hid.dat", "t/noext", "t/noext_Historical", "t/a^b.dat", "t/a.b.dat"]
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_text("x")
    globs = ["s1/a_Min.dat", "*/a_Min.dat", "s*/[ab]_Min.dat", "s*/[!a]_Min.dat", "**/a_Min.dat", "s2 x/*.dat", "t/a+b.dat", "t/a?b.dat",
             "t/a[+]b.dat", "s2 x/a[]]b.dat", "t/[a-z]_Min.dat", "*.dat", "t/a[^]b.dat", "t/a[!^+]b.dat", "t/noext", "t/a_Min.dat", "[", "t/.hid.dat"]
    src = spark.createDataFrame([(g, g, None) for g in globs], "dataset_id string, file_pattern string, historical_suffix string")
    listed = spark.createDataFrame([("file:" + str(tmp_path / n), 1, None) for n in names], "file_name string, size long, modified timestamp")
    got = {(r["dataset_id"], r["rel_path"]) for r in L.discover(listed, src, str(tmp_path)).collect()}
    want = {(g, str(p.relative_to(tmp_path))) for g in globs for f in L.pattern_family(g) if g != "[" for p in tmp_path.glob(f) if p.is_file()}
    assert got == want


def test_pattern_family():
    assert L.pattern_family("a/*_Min.dat") == ["a/*_Min.dat", "a/*_Min_Historical.dat", "a/*_Min.dat.backup*"]


def test_listing_is_made_by_tasks_and_hides_what_spark_hides(spark, tmp_path):
    names = ["a.dat", "st 1/b.dat", "st 1/deep/c%20.dat", "_k=1/d.dat", "_tmp/e.dat", ".git/f.dat", "st 1/_g", "st 1/h._COPYING_"]
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_text(n)
    (tmp_path / "empty.dat").touch()
    listed = L.list_files(spark, str(tmp_path))
    by_spark = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path))
    by_spark = by_spark.selectExpr("path AS file_name", "length AS size", "modificationTime AS modified")
    assert sorted(listed.collect()) == sorted(by_spark.collect()) and listed.count() == 4
    assert listed.schema.simpleString() == by_spark.schema.simpleString()
    assert "binaryFile" not in listed._jdf.queryExecution().toString()


def test_places_of_a_wide_header_are_not_searched_for_each_name(spark):
    names = ["r", "b", "TIMESTAMP", "a", "b", "r", "c"]
    h = spark.createDataFrame([("f", 100, 10, True, names)], "file_name string, size long, body_start long, valid boolean, columns array<string>")
    ranges = L.body_ranges(h)
    r = ranges.first()
    assert (r["names"], r["places"], r["ts_place"], r["n_columns"]) == (["r", "b", "a", "c"], [1, 2, 4, 7], 3, 7)
    r = L.body_ranges(h, needed=["c", "b", "none"]).first()
    assert (r["names"], r["places"]) == (["b", "c"], [2, 7])
    assert ranges._jdf.queryExecution().optimizedPlan().toString().count("array_position") == 1
