from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fleetseries.operators import coverage as cov
from fleetseries.operators import export as exp
from fleetseries.operators import mapping as M

SCHEMA = "dataset_id string, time timestamp_ntz, raw_name string, raw_value string"
HOURS = [datetime(2025, 7, 14, h) for h in (3, 9, 21)]


def readings(spark, table):
    """Long cells from {raw name: texts per hour}; None leaves the cell out, "" is given as a null value."""
    rows = [("buoy", t, name, v or None) for name, texts in table.items() for t, v in zip(HOURS, texts) if v is not None]
    return spark.createDataFrame(rows, SCHEMA)


def by_hour(df, name, col="value_num"):
    return {r["time"].hour: r[col] for r in df.filter(F.col("canonical_name") == name).collect()}


def mapped(spark, table, *specs):
    return M.map_long(readings(spark, table), M.variable_map_from_specs(spark, list(specs)))


def test_columns_get_their_standard_name_and_units(spark):
    out = mapped(spark, {"Sal": ["34.9", "35.02", "35.1"], "unused": ["7", "7", "7"]},
                 {"raw_name": "Sal", "standard_name": "sea_water_salinity", "units": "1e-3"})
    assert by_hour(out, "sea_water_salinity") == {3: 34.9, 9: 35.02, 21: 35.1}
    assert {(r["canonical_name"], r["units"]) for r in out.collect()} == {("sea_water_salinity", "1e-3")}


def test_text_variables_keep_raw_name_and_text(spark):
    out = mapped(spark, {"mode": ["drift", "12", ""]}, {"raw_name": "mode", "dtype": "string"})
    assert by_hour(out, "mode", "value_str") == {3: "drift", 9: "12"}
    assert not [r for r in out.collect() if r["bad"] or r["value_num"] is not None]


def test_aliases_fill_where_earlier_names_are_missing(spark):
    spec = {"raw_name": "Hs", "old_names": ["Hs_m", "SWH"], "standard_name": "wave_height"}
    assert by_hour(mapped(spark, {"SWH": ["0.4", None, "0.9"]}, spec), "wave_height") == {3: 0.4, 21: 0.9}
    mixed = {"Hs": [None, "", "1.25"], "Hs_m": [None, "2.5", "8"], "SWH": ["0.75", "9", "9"]}
    assert by_hour(mapped(spark, mixed, spec), "wave_height") == {3: 0.75, 9: 2.5, 21: 1.25}


def test_bad_first_name_hides_a_good_alias_and_is_reported(spark):
    spec = {"raw_name": "Hs", "old_names": ["SWH"], "standard_name": "wave_height"}
    out = mapped(spark, {"Hs": ["calm", "2m", "calm"], "SWH": ["0.1", "0.2", "0.3"]}, spec)
    assert by_hour(out, "wave_height") == {3: None, 9: None, 21: None}
    report = M.quality_report(out).first()
    assert report["n_bad"] == 3 and report["warning"].startswith("wave_height: 3 value(s)")
    assert report["warning"].endswith("(examples: ['2m', 'calm'])")


def test_unknown_columns_give_no_rows(spark):
    assert mapped(spark, {"Sal": ["1", "2", "3"]}, {"raw_name": "Chl", "standard_name": "chlorophyll"}).count() == 0


def test_later_declaration_of_a_name_counts(spark):
    first, second = ({"raw_name": n, "standard_name": "depth"} for n in ("Z_old", "Z_new"))
    out = mapped(spark, {"Z_old": ["5", "5", "5"], "Z_new": ["6", "", "8"]}, first, second)
    assert by_hour(out, "depth") == {3: 6.0, 21: 8.0}


@pytest.mark.parametrize("text,expected", [
    ("1.5", 1.5), (" 2 ", 2.0), ("+3", 3.0), (".5", 0.5), ("5.", 5.0), ("1e3", 1000.0),
    ("1.5f", None), ("1.5d", None), ("0x10", None), ("1_000", None), ("1,5", None), ("True", None),
    ("NaN", None), ("ERROR", None),
])
def test_number_grammar(spark, text, expected):
    df = spark.createDataFrame([(text, "numeric")], "raw_value string, dtype string")
    got = M.coerce(df).first()
    assert got["value_num"] == expected
    assert got["bad"] == (expected is None)


def test_inf_is_a_number(spark):
    df = spark.createDataFrame([("inf", "numeric"), ("-Infinity", "numeric")], "raw_value string, dtype string")
    assert [r["value_num"] for r in M.coerce(df).collect()] == [float("inf"), float("-inf")]


CHAIN = {"standard_name": "sea_water_temperature", "units": "degC", "extra_dimension": {"name": "depth", "units": "m"},
         "members": [{"raw_name": "t40", "dimension_value": 40}, {"raw_name": "t5", "dimension_value": 5.0},
                     {"raw_name": "t12", "dimension_value": 12.5}]}
GRID = {"standard_name": "current_speed", "extra_dimension": [{"name": "depth", "units": "m"}, {"name": "beam", "units": ""}],
        "members": [{"raw_name": "c_a", "dimension_value": [8, "fore deck"]}, {"raw_name": "c_b", "dimension_value": [8, "aft"]},
                    {"raw_name": "c_c", "dimension_value": [3.5, "aft"]}]}


def completed(spark, table, spec):
    vm = M.variable_map_from_specs(spark, [spec])
    return M.complete_dimensions(M.map_long(readings(spark, table), vm), vm)


def test_stacking_keeps_declared_order_and_completes(spark):
    full = completed(spark, {"t40": ["4.0", None, "4.2"], "t5": [None, None, "9.5"]}, CHAIN)
    got = sorted((r["time"].hour, r["dim_ord"][0], r["dims"][0]["num"], r["value_num"]) for r in full.collect())
    assert got == [(3, 0, 40.0, 4.0), (3, 1, 5.0, None), (3, 2, 12.5, None), (21, 0, 40.0, 4.2), (21, 1, 5.0, 9.5), (21, 2, 12.5, None)]
    assert completed(spark, {"other": ["1", "1", "1"]}, CHAIN).count() == 0


def test_two_dimensions_give_every_combination(spark):
    full = completed(spark, {"c_a": ["0.1", None, None], "c_c": ["0.3", None, None]}, GRID)
    got = {(r["dims"][0]["num"], r["dims"][1]["txt"]): r["value_num"] for r in full.collect()}
    assert got == {(8.0, "fore deck"): 0.1, (8.0, "aft"): None, (3.5, "fore deck"): None, (3.5, "aft"): 0.3}


def test_wide_columns_are_named_like_the_rows(spark):
    assert [c["column"] for c in M.wide_columns([CHAIN])] == [
        "sea_water_temperature_40m", "sea_water_temperature_5m", "sea_water_temperature_12.5m"]
    grid = {c["column"]: c["raw_names"] for c in M.wide_columns([GRID])}
    assert grid == {"current_speed_8m_fore_deck": ["c_a"], "current_speed_8m_aft": ["c_b"],
                    "current_speed_3.5m_fore_deck": [], "current_speed_3.5m_aft": ["c_c"]}
    for spec in (CHAIN, GRID):
        vm = M.variable_map_from_specs(spark, [spec])
        named = [r["column_name"] for r in exp.with_column_names(vm).orderBy("member_ord").collect()]
        columns = {c["raw_names"][0]: c["column"] for c in M.wide_columns([spec]) if c["raw_names"]}
        assert named == [columns[m["raw_name"]] for m in spec["members"]]
    assert [c["column"] for c in M.wide_columns([GRID, CHAIN, {"raw_name": "x"}], ["x", "current_speed"])][-1] == "x"


def test_wide_mapping_without_shuffle_reports_bad_values(spark):
    rows = spark.createDataFrame([("buoy", HOURS[0], {"Sal": "34.5", "Hs": "calm", "mode": "x"}), ("buoy", HOURS[1], {"Hs": "1"})],
                                 "dataset_id string, time timestamp_ntz, cells map<string,string>")
    cols = M.wide_columns([{"raw_name": "Sal"}, {"raw_name": "Hs", "standard_name": "wave_height"}, {"raw_name": "mode", "dtype": "string"}])
    out = M.map_wide(rows, cols, report_bad=True)
    got = {r["time"].hour: (r["Sal"], r["wave_height"], r["mode"], [tuple(b) for b in r["bad_values"]]) for r in out.collect()}
    assert got == {3: (34.5, None, "x", [("wave_height", "calm")]), 9: (None, 1.0, None, [])}
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_variable_map_from_catalog_keeps_json_types(spark):
    import json

    from fleetseries.operators import catalog as cat
    numbers_as_text = {"standard_name": "flow", "extra_dimension": {"name": "tap", "units": "l"},
                       "members": [{"raw_name": "f1", "dimension_value": "10"}, {"raw_name": "f2", "dimension_value": 10},
                                   {"raw_name": "f3", "dimension_value": 2.5}]}
    specs = [{"raw_name": "Hs", "old_names": ["SWH"], "standard_name": "wave_height"}, CHAIN, GRID, numbers_as_text]
    c = cat.parse_documents(spark.createDataFrame([("buoy", json.dumps({"id": "buoy", "variables": specs}))], "dataset_id string, content string"))
    got, want = M.variable_map_from_catalog(c), M.variable_map_from_specs(spark, specs, "buoy")
    assert sorted(map(repr, (r.asDict(True) for r in got.collect()))) == sorted(map(repr, (r.asDict(True) for r in want.collect())))
    names = {r["raw_name"]: r["column_name"] for r in exp.with_column_names(got).collect()}
    assert (names["f1"], names["f2"], names["f3"]) == ("flow_10", "flow_10l", "flow_2.5l")


def test_attributes_come_from_one_pass_over_the_build(spark):
    rows = [("buoy", HOURS[0], 70.5, 20.0, [("wave_height", "calm"), ("Sal", "x")]), ("buoy", HOURS[2], None, 21.5, [("wave_height", "2m")]),
            ("pier", HOURS[1], None, None, [])]
    built = spark.createDataFrame(rows, "dataset_id string, time timestamp_ntz, latitude double, longitude double, bad_values " + M.BAD_VALUES)
    columns = M.wide_columns([{"raw_name": "Sal"}, {"raw_name": "Hs", "standard_name": "wave_height"}])
    given = spark.createDataFrame([("buoy", {"title": "Buoy"}), ("pier", {"title": "Pier"}), ("none", {"title": "None"})], "dataset_id string, attrs map<string,string>")
    totals = cov.side_totals(built)
    got = {r["dataset_id"]: dict(r["attrs"]) for r in cov.build_attrs(totals, columns, given).collect()}
    warnings = got["buoy"].pop("data_quality_warnings")
    assert warnings.startswith("Sal: 1 value(s)") and "; wave_height: 2 value(s)" in warnings and warnings.endswith("['2m', 'calm'])")
    assert got == {
        "buoy": {"title": "Buoy", "time_coverage_start": "2025-07-14T03:00:00Z", "time_coverage_end": "2025-07-14T21:00:00Z",
                 "geospatial_lat_min": "70.5", "geospatial_lat_max": "70.5", "geospatial_lon_min": "20.0", "geospatial_lon_max": "21.5"},
        "pier": {"title": "Pier", "time_coverage_start": "2025-07-14T09:00:00Z", "time_coverage_end": "2025-07-14T09:00:00Z"},
        "none": {"title": "None"}}
    headers = spark.createDataFrame([("buoy", ["TIMESTAMP", "Hs", "Sal"], ["TS", "m", ""], ["", "Max", "Smp"]), ("buoy", ["Hs"], ["cm"], ["Max"])],
                                    "dataset_id string, columns array<string>, units array<string>, agg_types array<string>")
    vmap = M.variable_map_from_specs(spark, [{"raw_name": "Sal", "units": "1e-3"}, {"raw_name": "Hs", "standard_name": "wave_height"}, {"raw_name": "gone"}])
    attrs = {r["canonical_name"]: (r["units"], r["logger_units"], r["agg_types"], r["n_bad"]) for r in cov.variable_attrs(vmap, headers, totals).collect()}
    assert attrs == {"Sal": ("1e-3", "", "Smp", 1), "wave_height": (None, "cm,m", "Max", 2)}
