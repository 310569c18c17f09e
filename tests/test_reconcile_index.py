import random
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from fleetseries.operators import index as I
from fleetseries.operators import reconcile as R
from fleetseries.plans.build import file_ranks, ranked_rows
from fleetseries.schemas import FILE_INDEX


def test_roles(spark):
    names = ["d/st_Min.dat", "d/st_Min_Historical.dat", "d/st_Min.dat.backup", "d/st_Min.dat.backup1",
             "d/st_Min10.dat"]
    df = spark.createDataFrame([("ds", n) for n in names], "dataset_id string, file_name string")
    got = {r["file_name"]: r["file_role"] for r in R.classify_roles(df).collect()}
    assert got == {"d/st_Min.dat": "live", "d/st_Min_Historical.dat": "archived",
                   "d/st_Min.dat.backup": "archived", "d/st_Min.dat.backup1": "archived",
                   "d/st_Min10.dat": "live"}
    v = R.role_violations(R.classify_roles(df)).first()
    assert (v["n_live"], v["n_files"]) == (2, 5)


SCHEMA = "dataset_id string, file_name string, block_start bigint, row_pos bigint, time timestamp_ntz, " \
         "cells map<string,string>"


def test_keep_last_whole_row_and_gaps(spark):
    t = [datetime(2026, 1, 1) + timedelta(minutes=10 * i) for i in range(6)]
    data = [
        ("ds", "x_Historical.dat", 0, 0, t[0], {"a": "1", "b": "1"}),
        ("ds", "x_Historical.dat", 0, 1, t[1], {"a": "1", "b": "1"}),
        ("ds", "x_Historical.dat", 0, 2, t[1], {"a": "2", "b": "2"}),  # later line in the file wins
        ("ds", "x.dat", 0, 0, t[1], {"a": "3", "b": None}),              # live beats archived, null kept
        ("ds", "x.dat", 0, 1, t[5], {"a": "9", "c": "7"}),              # gap t2..t4 stays a gap
    ]
    raw = spark.createDataFrame(data, SCHEMA)
    out = R.dedup_keep_last(ranked_rows(raw, file_ranks(raw)))
    got = {r["time"]: dict(r["cells"]) for r in out.collect()}
    assert got == {t[0]: {"a": "1", "b": "1"}, t[1]: {"a": "3", "b": None}, t[5]: {"a": "9", "c": "7"}}


def test_archived_ordered_by_first_timestamp_not_name(spark):
    t = datetime(2026, 1, 1)
    data = [("ds", "a.dat.backup", 0, 0, t + timedelta(days=5), {"v": "late"}),
            ("ds", "a.dat.backup", 0, 1, t + timedelta(days=1), {"v": "late-file"}),
            ("ds", "a_Historical.dat", 0, 0, t + timedelta(days=1), {"v": "early-file"}),
            ("ds", "a_Historical.dat", 0, 1, t + timedelta(days=0), {"v": "x"}),
            ("ds", "a.dat", 0, 0, t + timedelta(days=9), {"v": "live"})]
    raw = spark.createDataFrame(data, SCHEMA)
    ranks = {r["file_name"]: r["file_rank"] for r in file_ranks(raw).collect()}
    assert ranks == {"a_Historical.dat": 1, "a.dat.backup": 2, "a.dat": 3}
    out = {r["time"]: r["cells"]["v"] for r in R.dedup_keep_last(ranked_rows(raw, file_ranks(raw))).collect()}
    assert out[t + timedelta(days=1)] == "late-file"


def test_dedup_random_against_pandas(spark):
    rnd = random.Random(3)
    data = []
    for f, name in enumerate(["s_Historical.dat", "s.dat.backup", "s.dat"]):
        for i in range(300):
            data.append(("s", name, 0, i, datetime(2026, 1, 1) + timedelta(minutes=rnd.randint(0, 400)),
                         {"v": f"{f}-{i}"}))
    raw = spark.createDataFrame(data, SCHEMA)
    got = {r["time"]: r["cells"]["v"] for r in R.dedup_keep_last(ranked_rows(raw, file_ranks(raw))).collect()}
    pdf = pd.DataFrame([(d[1], d[3], d[4], d[5]["v"]) for d in data], columns=["f", "pos", "time", "v"])
    first = pdf.groupby("f").time.min()
    archived = sorted([n for n in first.index if n != "s.dat"], key=lambda n: first[n])
    order = archived + ["s.dat"]
    frames = [pdf[pdf.f == n].sort_values("pos") for n in order]
    cat = pd.concat(frames)
    want = cat[~cat.time.duplicated(keep="last")].set_index("time").v.to_dict()
    assert got == {k.to_pydatetime(): v for k, v in want.items()}


def test_prune_files_and_window(spark):
    idx = spark.createDataFrame([("d", "a", datetime(2026, 1, 1), datetime(2026, 1, 10)),
                                 ("d", "b", datetime(2026, 1, 11), datetime(2026, 1, 20)),
                                 ("d", "c", None, None)],
                                "dataset_id string, file_name string, time_start timestamp_ntz, "
                                "time_end timestamp_ntz")
    got = sorted(r["file_name"] for r in R.prune_files(idx, datetime(2026, 1, 10), None).collect())
    assert got == ["a", "b"]
    got = sorted(r["file_name"] for r in R.prune_files(idx, None, datetime(2026, 1, 10, 23)).collect())
    assert got == ["a"]


def _index(spark, rows):
    return spark.createDataFrame([(d, f, role, size, None, None, [], st) for d, f, role, size, st in rows],
                                 FILE_INDEX)


def test_index_state_machine(spark):
    prev = _index(spark, [("d", "h1", "archived", 10, "closed"), ("d", "live1", "live", 5, "active"),
                          ("e", "live2", "live", 5, "closed"), ("f", "live3", "live", 5, "active"),
                          ("g", "h2", "archived", 7, "active"), ("z", "gone", "archived", 1, "closed")])
    listing = spark.createDataFrame([("d", "h1", "archived", 10), ("d", "live1", "live", 6),
                                     ("e", "live2", "live", 5), ("f", "live3", "live", 5),
                                     ("g", "h2", "archived", 7), ("g", "new", "archived", 3)],
                                    "dataset_id string, file_name string, file_role string, size bigint")
    act = {r["file_name"]: (r["action"], r["status"]) for r in I.refresh_actions(listing, prev).collect()}
    assert act == {"h1": ("reuse", "closed"), "live1": ("parse", "active"), "live2": ("reuse", "closed"),
                   "live3": ("close", "closed"), "h2": ("parse", "closed"), "new": ("parse", "closed")}
    summary = {r["dataset_id"]: (r["n_matched"], r["n_parsed"]) for r in
               I.refresh_summary(I.refresh_actions(listing, prev)).collect()}
    assert summary["d"] == (2, 1)
    upd = I.refreshed_index(I.refresh_actions(listing, prev), listing.withColumn(
        "time_start", F.lit(None).cast("timestamp_ntz")).withColumn("time_end", F.lit(None).cast(
            "timestamp_ntz")).withColumn("variables", F.array().cast("array<string>")))
    merged = {r["file_name"]: r["size"] for r in I.merge_index(prev, upd).collect()}
    assert merged["live1"] == 6 and merged["gone"] == 1 and merged["new"] == 3


def test_hot_station_spreads_over_all_dedup_partitions(spark):
    """One station holds a third of all rows: the dedup key includes time, so the
    hot station's rows land on every shuffle partition, not on one task."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        n = 30000
        data = [("hot" if i % 3 == 0 else f"s{i % 997}", "f.dat", 0, i,
                 datetime(2026, 1, 1) + timedelta(seconds=i), {"v": "1"}) for i in range(n)]
        raw = spark.createDataFrame(data, SCHEMA)
        ranks = spark.createDataFrame([(d, "f.dat", 1, "live") for d in {r[0] for r in data}],
                                      "dataset_id string, file_name string, file_rank int, file_role string")
        out = R.dedup_keep_last(ranked_rows(raw, ranks))
        per_part = (out.filter(F.col("dataset_id") == "hot")
                    .groupBy(F.spark_partition_id().alias("p")).count().collect())
        counts = [r["count"] for r in per_part]
        assert len(counts) == int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert max(counts) < 2 * (n / 3) / len(counts)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_merge_keeps_the_greatest_token_of_rows_with_one_key(spark):
    from fleetseries.operators.index import merge_index
    from fleetseries.schemas import FILE_INDEX

    def entries(*sizes):
        texts = ", ".join(f"({s})" for s in sizes)
        given = spark.sql(f"SELECT CAST(NULL AS STRING) AS dataset_id, CAST(NULL AS STRING) AS file_name, t.size FROM VALUES {texts} AS t(size)")
        from pyspark.sql import functions as F
        return given.select(*[(F.col(f.name) if f.name in given.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in FILE_INDEX.fields])

    for sizes in ((1, 2), (2, 1)):
        assert [r["size"] for r in merge_index(entries(9), entries(*sizes)).collect()] == [2]
