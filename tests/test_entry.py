import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_entry_runs_and_registry_is_consistent(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert {"dataset_id", "time", "air_temperature", "latitude"} <= set(df.columns)
    qs, oracles = E.queries(), E.oracle_sql()
    assert set(oracles) <= set(qs)
    assert len(qs) >= 70
    from fleetseries.plans import registry
    assert set(registry.QUERIES) <= set(oracles)           # every query of the library itself has an SQL twin


def test_queries_survive_a_missing_optional_package(monkeypatch, capsys):
    import __spark_entry__ as E
    from fleetseries.plans import registry
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)     # importing it raises ImportError
    assert set(E.queries()) == set(registry.QUERIES) == set(E.oracle_sql())
    assert "left out" in capsys.readouterr().err


def test_flagship_shuffles_raw_rows_once_on_dedup_key(spark):
    import re

    import __spark_entry__ as E
    df = E.queries()["build_dataset"](spark, "/root/testdata/sf0.01")
    plan = df._jdf.queryExecution().executedPlan().toString()
    shuffles = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    on_dataset = [s for s in shuffles if s.startswith("dataset_id")]
    assert len(on_dataset) == 1 and "time" in on_dataset[0]
    assert "SortMergeJoin" not in plan and "NestedLoop" not in plan


def test_build_fleet_from_catalog(spark):
    import json
    from datetime import datetime

    from fleetseries.operators import catalog as C
    from fleetseries.plans.build import build_fleet

    fixed = {"id": "a", "platform_type": "fixed",
             "variables": [{"raw_name": "T", "standard_name": "air_temperature"}],
             "deployments": [{"start": "2026-01-01T00:00:00", "lat": 78.0, "lon": 15.0}]}
    mobile = {"id": "b", "platform_type": "mobile",
              "variables": [{"raw_name": "Lat", "standard_name": "latitude"},
                            {"raw_name": "Lon", "standard_name": "longitude"}],
              "deployments": [{"start": "2026-01-01T00:00:00", "platform_name": "RV X"}]}
    cat = C.parse_documents(spark.createDataFrame([("a", json.dumps(fixed)), ("b", json.dumps(mobile))],
                                                  "dataset_id string, content string"))
    t = datetime(2026, 1, 2)
    raw = spark.createDataFrame(
        [("a", "a/x.dat", 0, 1, t, {"T": "1.5"}), ("a", "a/x_Historical.dat", 0, 1, t, {"T": "9"}),
         ("b", "b/y.dat", 0, 1, t, {"Lat": "70.5", "Lon": "20.0"})],
        "dataset_id string, file_name string, block_start bigint, row_pos bigint, time timestamp_ntz, "
        "cells map<string,string>")
    out = {(r["dataset_id"], r["canonical_name"]): r for r in build_fleet(raw, cat).collect()}
    assert out[("a", "air_temperature")]["value_num"] == 1.5           # live file wins
    assert out[("a", "air_temperature")]["latitude"] == 78.0
    assert out[("b", "latitude")]["value_num"] == 70.5
    assert out[("b", "latitude")]["platform"] == "RV X"


def test_window_filter_reaches_parquet_scan_on_stored_time(spark, tmp_path):
    from datetime import datetime, timedelta

    from fleetseries.plans.build import build_dataset

    rows = [("s", "s/x.dat", 0, i, datetime(2026, 1, 1) + timedelta(hours=i), {"T": str(i)}) for i in range(48)]
    raw = spark.createDataFrame(rows, "dataset_id string, file_name string, block_start bigint, row_pos bigint, "
                                      "time timestamp_ntz, cells map<string,string>")
    path = str(tmp_path / "bronze")
    raw.write.parquet(path)
    bronze = spark.read.parquet(path)
    out = build_dataset(bronze, [{"raw_name": "T", "standard_name": "t"}], None, start="2026-01-01 10:00:00",
                        end="2026-01-01 20:00:00")
    assert out.count() == 11                                      # inclusive at both ends
    plan = out._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.split("\n") if "FileScan parquet" in line and "cells" in line]
    assert any("GreaterThanOrEqual(time" in s and "LessThanOrEqual(time" in s for s in scans), scans


def test_empty_window_gives_empty_frame_with_full_schema(spark):
    from fleetseries.plans import fixtures as fx
    from fleetseries.plans.build import build_dataset

    d = "/root/testdata/sf0.001"
    out = build_dataset(fx.raw_rows(spark, d), fx.EVENT_SPECS, fx.deployments(spark, d), "fixed",
                        "1990-01-01 00:00:00", "1990-02-01 00:00:00")
    assert out.count() == 0
    assert out.columns == ["dataset_id", "time", "air_temperature", "relative_humidity", "signup",
                           "latitude", "longitude", "elevation"]


def test_build_with_stored_index_prunes_files_and_matches(spark):
    from datetime import datetime, timedelta

    from fleetseries.operators import reconcile as R
    from fleetseries.plans.build import build_dataset

    t = datetime(2026, 1, 1)
    rows = [("s", "s/a_Historical.dat", 0, i, t + timedelta(hours=i), {"T": f"a{i}"}) for i in range(10)] + \
           [("s", "s/a.dat", 0, i, t + timedelta(hours=8 + i), {"T": f"b{i}"}) for i in range(10)]
    raw = spark.createDataFrame(rows, "dataset_id string, file_name string, block_start bigint, row_pos bigint, "
                                      "time timestamp_ntz, cells map<string,string>")
    index = R.classify_roles(R.file_bounds(raw))
    spec = [{"raw_name": "T", "dtype": "string"}]
    a = build_dataset(raw, spec, None, start="2026-01-01 12:00:00", end="2026-01-01 20:00:00", file_index=index)
    b = build_dataset(raw, spec, None, start="2026-01-01 12:00:00", end="2026-01-01 20:00:00")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert a.count() == 6                                          # hours 12..17 of the live file
    c = build_dataset(raw, spec, None, start="2026-01-01 00:00:00", end="2026-01-01 09:00:00", file_index=index)
    got = {r["time"].hour: r["T"] for r in c.collect()}
    assert got[8] == "b0" and got[9] == "b1" and got[7] == "a7"     # live file wins the overlap
