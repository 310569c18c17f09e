import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetseries.operators import deployment as D
from fleetseries.operators import publish as P
from fleetseries.operators import tracks
from fleetseries.schemas import DEPLOYMENTS
from fleetseries.sources.state import StateTable


def deps(spark, rows):
    full = [(r[0], r[1], r[2], r[3], r[4], r[5], r[6] if len(r) > 6 else None,
             r[7] if len(r) > 7 else None, None, None) for r in rows]
    return spark.createDataFrame(full, DEPLOYMENTS)


def obs(spark, times, ds="ds"):
    return spark.createDataFrame([(ds, t) for t in times], "dataset_id string, time timestamp_ntz")


def test_fixed_windows_half_open_and_unmatched(spark):
    d = deps(spark, [("ds", 0, datetime(2026, 1, 1), datetime(2026, 1, 2), 78.0, 15.0, 10.0),
                     ("ds", 1, datetime(2026, 1, 2), None, 79.0, 16.0, None)])
    times = [datetime(2025, 12, 31), datetime(2026, 1, 1, 12), datetime(2026, 1, 2), datetime(2030, 1, 1)]
    out = {r["time"]: (r["latitude"], r["longitude"], r["elevation"])
           for r in D.attach_deployments(obs(spark, times), d).collect()}
    assert out[times[0]] == (None, None, None)          # before the first window
    assert out[times[1]] == (78.0, 15.0, 10.0)
    assert out[times[2]] == (79.0, 16.0, None)          # switch exactly at the boundary, no elevation
    assert out[times[3]] == (79.0, 16.0, None)          # open end


def test_mobile_platform_switch(spark):
    d = deps(spark, [("ds", 0, datetime(2026, 1, 1), datetime(2026, 1, 5), None, None, None, "A"),
                     ("ds", 1, datetime(2026, 1, 5), None, None, None, None, "B")])
    times = [datetime(2026, 1, 4), datetime(2026, 1, 5)]
    out = {r["time"]: r["platform"] for r in D.attach_deployments(obs(spark, times), d, "mobile").collect()}
    assert out == {times[0]: "A", times[1]: "B"}


def test_bucketed_join_equals_range_join_random(spark):
    rnd = random.Random(7)
    rows, times = [], []
    for ds in ("a", "b", "c"):
        t = datetime(2026, 1, 1)
        for k in range(4):
            start = t + timedelta(days=rnd.randint(0, 40))
            end = None if k == 3 else start + timedelta(days=rnd.randint(1, 60))
            rows.append((ds, k, start, end, float(k), float(k), None))
            t = end or start
        times += [(ds, datetime(2026, 1, 1) + timedelta(hours=rnd.randint(0, 24 * 300))) for _ in range(300)]
    d = deps(spark, rows)
    o = spark.createDataFrame(times, "dataset_id string, time timestamp_ntz")
    a = D.attach_deployments(o, d, keep_dep_ord=True).select("dataset_id", "time", "dep_ord").collect()
    ends = o.groupBy("dataset_id").agg(F.max("time").alias("data_end"))
    b = D.attach_deployments_bucketed(o, d, ends, keep_dep_ord=True).select("dataset_id", "time", "dep_ord").collect()
    assert sorted(map(tuple, a), key=str) == sorted(map(tuple, b), key=str)
    # naive reference
    pdf = pd.DataFrame(rows, columns=["ds", "k", "s", "e", "lat", "lon", "el"])
    for ds, t, k in map(tuple, a):
        hit = pdf[(pdf.ds == ds) & (pdf.s <= t) & (pdf.e.isna() | (pdf.e > t))]
        assert (k is None and hit.empty) or (len(hit) == 1 and hit.k.iloc[0] == k)


def test_current_position_active_else_last(spark):
    d = deps(spark, [("x", 0, datetime(2020, 1, 1), datetime(2021, 1, 1), 1.0, 1.0, None),
                     ("x", 1, datetime(2021, 1, 1), None, 2.0, 2.0, None),
                     ("y", 0, datetime(2020, 1, 1), datetime(2020, 6, 1), 3.0, 3.0, None),
                     ("y", 1, datetime(2030, 1, 1), None, 4.0, 4.0, None)])
    got = {r["dataset_id"]: (r["dep_ord"], r["active"]) for r in D.current_position(d, "2022-01-01").collect()}
    assert got == {"x": (1, True), "y": (1, False)}


def cov(spark, rows):
    return spark.createDataFrame(rows, "dataset_id string, data_start timestamp_ntz, data_end timestamp_ntz")


def test_month_bounds_including_december(spark):
    df = spark.createDataFrame([(datetime(2025, 12, 15, 3),)], "t timestamp_ntz")
    s, e = P.month_bounds(F.col("t"))
    r = df.select(s.alias("s"), e.alias("e")).first()
    assert (r["s"], r["e"]) == (datetime(2025, 12, 1), datetime(2026, 1, 1))


def test_settled_months_rules(spark):
    c = cov(spark, [("a", datetime(2026, 1, 10), datetime(2026, 3, 5)),
                    ("b", datetime(2026, 1, 10), datetime(2026, 2, 1)),      # boundary hit counts
                    ("c", datetime(2026, 1, 10), datetime(2026, 1, 31))])    # never left first month
    got = sorted((r["dataset_id"], r["period"]) for r in P.settled_months(c, "2026-06-01").collect())
    assert got == [("a", "2026-01"), ("a", "2026-02"), ("b", "2026-01")]
    capped = sorted(r["period"] for r in P.settled_months(c, "2026-02-15").collect())
    assert capped == ["2026-01", "2026-01"]
    latest = {r["dataset_id"]: r["latest_complete_month"] for r in P.latest_settled(c, "2026-06-01").collect()}
    assert latest == {"a": "2026-02", "b": "2026-01", "c": None}


def test_month_selection_inclusive_end_and_template(spark):
    pending = spark.createDataFrame([("a", "2026-01", datetime(2026, 1, 1), datetime(2026, 2, 1)),
                                     ("a", "2026-02", datetime(2026, 2, 1), datetime(2026, 3, 1))],
                                    "dataset_id string, period string, month_start timestamp_ntz, "
                                    "month_end timestamp_ntz")
    built = obs(spark, [datetime(2026, 1, 31, 23), datetime(2026, 2, 1), datetime(2026, 2, 2)], "a")
    got = sorted((r["period"], r["time"]) for r in P.select_month(built, pending).collect())
    assert got == [("2026-01", datetime(2026, 1, 31, 23)), ("2026-01", datetime(2026, 2, 1)),
                   ("2026-02", datetime(2026, 2, 1)), ("2026-02", datetime(2026, 2, 2))]
    half = P.select_month(built, pending, half_open=True).count()
    assert half == 3
    name = spark.range(1).select(P.render_file_name(F.lit("{station}_{table}_{yyyy}-{mm}.nc"), F.lit("st"),
                                                    F.lit(None).cast("string"),
                                                    F.lit("2026-03-01").cast("timestamp_ntz")).alias("n"))
    assert name.first()["n"] == "st__2026-03.nc"


def test_pending_excludes_published(spark):
    s = spark.createDataFrame([("a", "2026-01"), ("a", "2026-02")], "dataset_id string, period string")
    log = spark.createDataFrame([("a", "2026-01")], "dataset_id string, period string")
    assert [r["period"] for r in P.pending_periods(s, log).collect()] == ["2026-02"]


def test_tracks_skip_missing_positions(spark):
    pos = spark.createDataFrame([("m", datetime(2026, 1, 1), 1.0, 2.0), ("m", datetime(2026, 1, 9), None, 3.0),
                                 ("m", datetime(2026, 1, 8), 5.0, 6.0)],
                                "dataset_id string, time timestamp_ntz, latitude double, longitude double")
    assert tracks.recent_track(pos, "2026-01-10").count() == 1
    last = tracks.latest_position(pos).first()
    assert (last["latitude"], last["longitude"], last["n_points"]) == (5.0, 6.0, 2)


def test_publish_run_commits_once_and_recovers(spark, tmp_path):
    data, log = str(tmp_path / "data"), StateTable(spark, str(tmp_path / "log"), P.LOG_SCHEMA)
    built = spark.createDataFrame([("a", datetime(2026, 1, 5), 1.0), ("a", datetime(2026, 2, 1), 2.0), ("b", datetime(2026, 1, 9), 3.0)],
                                  "dataset_id string, time timestamp_ntz, v double")
    names = spark.createDataFrame([("a", "{station}_{yyyy}{mm}.nc")], "dataset_id string, template string")
    versions = spark.createDataFrame([("a", "hash-a"), ("b", "hash-b")], "dataset_id string, hash string")
    settled = P.settled_months(cov(spark, [("a", datetime(2026, 1, 5), datetime(2026, 2, 1)), ("b", datetime(2026, 1, 9), datetime(2026, 2, 2))]), "2026-03-01")
    schema = T._parse_datatype_string("dataset_id string, period string, time timestamp_ntz, v double, file_name string")
    assert P.published_rows(log, data, schema).count() == 0                # nothing written, empty log

    class Dies(StateTable):
        def append(self, rows, expected):
            raise OSError("killed before the commit")

    with pytest.raises(OSError):
        P.publish_periods(built, settled, names, versions, Dies(spark, log.root, log.schema), data, "2026-03-01", run="dead")
    assert P.published_rows(log, data, schema).count() == 0
    assert [r["run"] for r in P.abandoned_runs(log, data).collect()] == ["dead"]

    assert P.publish_periods(built, settled, names, versions, log, data, "2026-03-01") == 1
    rows = sorted((r["dataset_id"], r["period"], r["v"], r["file_name"]) for r in P.published_rows(log, data, schema).collect())
    assert rows == [("a", "2026-01", 1.0, "a_202601.nc"), ("a", "2026-01", 2.0, "a_202601.nc"), ("b", "2026-01", 3.0, "b_202601")]
    logged = sorted((r["dataset_id"], r["period"], r["n_rows"], r["config_hash"]) for r in log.read().collect())
    assert logged == [("a", "2026-01", 2, "hash-a"), ("b", "2026-01", 1, "hash-b")]
    P.publish_periods(built, settled, names, versions, log, data, "2026-03-02")   # nothing pending: nothing twice
    assert P.published_rows(log, data, schema).count() == 3 and log.read().count() == 2


def test_joins_with_the_log_build_no_table_in_the_driver(spark, tmp_path):
    from fleetseries.operators import publish

    path = str(tmp_path / "log")
    spark.sql("SELECT concat('d', id) AS dataset_id, '2020-01' AS period FROM range(3)").write.parquet(path)
    settled = spark.sql("SELECT concat('d', id) AS dataset_id, '2020-01' AS period FROM range(5)")
    pending = publish.pending_periods(settled, spark.read.parquet(path))
    assert sorted(r["dataset_id"] for r in pending.collect()) == ["d3", "d4"]
    plan = pending._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
