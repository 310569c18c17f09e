import csv
import json
from datetime import datetime

from pyspark.sql import functions as F

from fleetseries.operators import export as E
from fleetseries.operators import profile as P


def cols(spark, names, ds="d"):
    return spark.createDataFrame([(ds, n) for n in names], "dataset_id string, column_name string")


def test_level_groups(spark):
    names = ["Soil_100cm_Tot", "Soil_5cm_Tot", "Soil_20cm_Tot", "Soil_5cm_Min", "Wind_9ft_x", "depth", "Wind_4m_x"]
    g = P.level_groups(cols(spark, names)).collect()
    assert [(r["prefix"], r["dimension_units"], r["suffix"], r["n_members"]) for r in g] == [("Soil", "cm", "Tot", 3)]
    assert (g[0]["members"], g[0]["levels"]) == ("Soil_5cm_Tot,Soil_20cm_Tot,Soil_100cm_Tot", "5,20,100")


def test_detect_position(spark):
    got = {r["column_name"]: r["position"] for r in P.detect_position(cols(spark, ["LAT", "lon", "Longitude", "lat_deg"])).collect()}
    assert got == {"LAT": "latitude", "lon": "longitude", "Longitude": "longitude"}


def test_suggest_names_knows_names_exactly(spark):
    got = {r["column_name"]: (r["standard_name"], r["units"]) for r in P.suggest_names(cols(spark, ["RH", "RH", "rh", "zzz"])).collect()}
    assert got == {"RH": ("relative_humidity", "%"), "rh": (None, None), "zzz": (None, None)}


def test_rename_classes(spark):
    config = spark.createDataFrame([("d", "Hs"), ("d", "SWH"), ("e", "Tp")], "dataset_id string, raw_name string")
    got = {r["column_name"]: r["classification"] for r in P.rename_classes(cols(spark, ["Hs", "SWH", "Tp"]), config).collect()}
    assert got == {"Hs": "already_mapped", "SWH": "already_mapped", "Tp": "new"}


def wide(spark):
    return spark.createDataFrame([("s", datetime(2026, 1, 1), 1.5, None), ("s", datetime(2026, 1, 1, 0, 10), None, "OK")],
                                 "dataset_id string, time timestamp_ntz, air_temperature double, status string")


def test_csv_lines_preamble_and_body(spark):
    attrs = spark.createDataFrame([("s", {"title": "Line1\nLine2", "a": "b"})],
                                  "dataset_id string, attrs map<string,string>")
    rows = [("s", datetime(2026, 1, 1, 0, 0, 5, 250000), 1.5, "a,b"), ("s", datetime(2026, 1, 1, 0, 10), None, "OK"),
            ("s", datetime(2026, 1, 1, 0, 10, 0, 7), -2.0, 'say "x"')]
    w = spark.createDataFrame(rows, 'dataset_id string, time timestamp_ntz, t double, `a "b", c` string')
    lines = E.csv_lines(w, attrs, ["t", 'a "b", c'])
    got = [r["line"] for r in lines.orderBy("section", "time", "sort_key").collect()]
    assert got[:3] == ["# a: b", "# title: Line1 Line2", "#"]
    back = list(csv.reader([x.replace('\\"', '""') for x in got[3:]]))
    assert back == [["time", "t", 'a "b", c'], ["2026-01-01 00:00:05.250", "1.5", "a,b"], ["2026-01-01 00:10:00", "", "OK"],
                    ["2026-01-01 00:10:00.000007", "-2.0", 'say "x"']]


def test_json_columns_aligned_arrays_in_parts(spark):
    out = E.json_columns(wide(spark), ["air_temperature", "status"]).first()
    assert json.loads(out["json"]) == {"time": ["2026-01-01T00:00:00", "2026-01-01T00:10:00"],
                                       "air_temperature": [1.5, None], "status": [None, "OK"]}
    fast = spark.range(1000).select(F.lit("s").alias("dataset_id"), F.timestamp_millis(F.col("id") * 50).cast("timestamp_ntz").alias("time"),
                                    F.col("id").alias("v"))
    parts = sorted((r["part"], json.loads(r["json"])) for r in E.json_columns(fast.repartition(7), ["v"], part_rows=300).collect())
    assert [p for p, _ in parts] == [0, 1, 2, 3] and [len(j["v"]) for _, j in parts] == [300, 300, 300, 100]
    assert sum((j["v"] for _, j in parts), []) == list(range(1000)) and parts[0][1]["time"][1] == "1970-01-01T00:00:00.050000"


def test_to_wide_typed_columns(spark):
    obs = spark.createDataFrame(
        [("s", datetime(2026, 1, 1), "t", [], 1.0, None), ("s", datetime(2026, 1, 1), "st", [], None, "OK")],
        "dataset_id string, time timestamp_ntz, canonical_name string, "
        "dims array<struct<name:string,units:string,num:double,txt:string>>, value_num double, value_str string")
    r = E.to_wide(obs, [("t", "numeric"), ("st", "string"), ("gone", "numeric")]).first()
    assert (r["t"], r["st"], r["gone"]) == (1.0, "OK", None)


def test_csv_documents_in_bounded_parts(spark, tmp_path):
    hours = [datetime(2026, 1, 31, h) for h in range(24)] + [datetime(2026, 2, 1)]
    w = spark.createDataFrame([("s", t, float(i)) for i, t in enumerate(hours)], "dataset_id string, time timestamp_ntz, air_temperature double")
    attrs = spark.createDataFrame([("s", {"title": "T"})], "dataset_id string, attrs map<string,string>")
    out = tmp_path / "csv"
    E.write_csv_documents(E.csv_lines(w.repartition(4), attrs, ["air_temperature"]), str(out), part_rows=10)
    docs, sizes = {}, []
    for f in sorted(out.rglob("part-*"), key=lambda f: int(f.parent.name.split("=")[1])):
        lines = f.read_text().splitlines()
        sizes.append(sum(not x.startswith(("#", "time")) for x in lines))
        docs.setdefault(f.parent.parent.name, []).extend(lines)
    head = ["# title: T", "#", "time,air_temperature"]
    assert docs == {"chunk=2026-01": head + [f"2026-01-31 {h:02d}:00:00,{float(h)}" for h in range(24)],
                    "chunk=2026-02": head + ["2026-02-01 00:00:00,24.0"]}
    assert max(sizes) == 10


def test_csv_documents_are_written_and_found_by_tasks(spark, tmp_path, monkeypatch):
    ids = ["s", "a/b=c", "50% +x", "é[1]{2}:#*?", "q\"'\\^\x01\x7f", "😀"]
    w = spark.createDataFrame([(d, datetime(2026, m, 1, h), float(h)) for d in ids for m in (1, 2) for h in range(5)]
                              + [(None, datetime(2026, 1, 1), 1.0)], "dataset_id string, time timestamp_ntz, v double")
    attrs = spark.createDataFrame([(d, {"title": "T"}) for d in ids], "dataset_id string, attrs map<string,string>")
    out, own = tmp_path / "csv", tmp_path / "spark"
    spark.createDataFrame([(d, c, p, "x") for d in ids for c in ("2026-01", "2026-02") for p in (0, 1, 2)],
                          "dataset_id string, chunk string, part int, line string") \
        .write.partitionBy("dataset_id", "chunk", "part").text(str(own))

    def never(*_, **__):
        raise AssertionError("the driver would move or list every file")

    monkeypatch.setattr("pyspark.sql.readwriter.DataFrameWriter.partitionBy", never)
    monkeypatch.setattr("pyspark.sql.readwriter.DataFrameReader.text", never)
    E.write_csv_documents(E.csv_lines(w.withColumn("v", F.lit(0.0)), attrs, ["v"]), str(out), part_rows=1)  # replaced by the next
    E.write_csv_documents(E.csv_lines(w, attrs, ["v"]), str(out), part_rows=2)
    got = {(r.dataset_id, r.chunk, r.part): r.text for r in E.read_csv_documents(spark, str(out)).collect()}
    head = "# title: T\n#\ntime,v\n"
    assert got == {(d, f"2026-0{m}", p): (head if p == 0 else "") + "".join(f"2026-0{m}-01 {h:02d}:00:00,{float(h)}\n" for h in range(2 * p, min(2 * p + 2, 5)))
                   for d in ids for m in (1, 2) for p in (0, 1, 2)}
    assert {f.parent.relative_to(out) for f in out.rglob("part-*")} == {f.parent.relative_to(own) for f in own.rglob("part-*")}
    E.write_csv_documents(E.csv_lines(w.limit(0), attrs, ["v"]), str(out))
    assert (out / "_SUCCESS").exists() and E.read_csv_documents(spark, str(out)).count() == 0
