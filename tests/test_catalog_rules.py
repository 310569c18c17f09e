import json

import pytest
from pyspark.sql import functions as F

from fleetseries.operators import catalog as C
from fleetseries.operators import coverage as V
from fleetseries.operators import rules as R

BASE = {
    "id": "st", "source_type": "loggernet", "access": "public",
    "source_config": {"file_pattern": "st/*_Min.dat"},
    "variables": [{"raw_name": "AirT_C", "standard_name": "air_temperature", "units": "degC"},
                  {"raw_name": "RH", "standard_name": "relative_humidity"}],
    "platform_type": "fixed",
    "deployments": [{"start": "2020-01-01T00:00:00", "end": "2021-01-01T00:00:00", "lat": 78.0, "lon": 15.0},
                    {"start": "2021-01-01T00:00:00", "lat": 78.5, "lon": 15.5}],
    "metadata": {"title": "Station One", "institution": "Polar Institute", "department": "Geo"},
    "output": {"file_naming": "{station}_{yyyy}{mm}.nc", "publish": True},
}


def variant(**changes):
    d = json.loads(json.dumps(BASE))
    for k, v in changes.items():
        if v is None:
            d.pop(k, None)
        else:
            d[k] = v
    return d


def catalog(spark, docs):
    rows = [(i, d if isinstance(d, str) else json.dumps(d)) for i, d in docs.items()]
    return C.parse_documents(spark.createDataFrame(rows, "dataset_id string, content string"))


def findings(spark, doc):
    return sorted((r["rule"], r["location"], r["message"]) for r in R.all_rules(catalog(spark, {"x": doc})).collect())


def test_valid_config_has_no_findings(spark):
    assert findings(spark, BASE) == []


REJECTED = [
    ({"variables": [{"raw_name": "A", "extra_dimension": {"name": "h", "units": "m"},
                     "members": [{"raw_name": "B", "dimension_value": 1}], "standard_name": "s"}]},
     "variable_shape", "exclude each other"),
    ({"variables": [{"standard_name": "s"}]}, "variable_shape", "neither"),
    ({"variables": [{"extra_dimension": [], "members": [], "standard_name": "s"}]}, "variable_shape",
     "empty list"),
    ({"variables": [{"extra_dimension": {"name": "h", "units": "m"}, "members": [], "standard_name": "s"}]},
     "variable_shape", "no members"),
    ({"variables": [{"extra_dimension": {"name": "h", "units": "m"},
                     "members": [{"raw_name": "B", "dimension_value": 1}]}]}, "variable_shape", "standard_name"),
    ({"variables": [{"extra_dimension": {"name": "h", "units": "m"}, "standard_name": "s",
                     "members": [{"raw_name": "B", "dimension_value": [1, 2]}]}]}, "member_arity", "one dimension"),
    ({"variables": [{"extra_dimension": [{"name": "h", "units": "m"}, {"name": "c", "units": ""}],
                     "standard_name": "s", "members": [{"raw_name": "B", "dimension_value": 1}]}]},
     "member_arity", "2 dimensions"),
    ({"variables": [{"raw_name": "A"}, {"raw_name": "B", "old_names": ["A"]}]}, "name_collision",
     "variable 0 and to variable 1"),
    ({"deployments": []}, "deployments", "no deployment"),
    ({"deployments": [{"start": "2021-01-01T00:00:00", "end": "2020-01-01T00:00:00", "lat": 1, "lon": 1}]},
     "deployments", "ends before"),
    ({"deployments": [{"start": "2020-01-01T00:00:00", "lat": 1, "lon": 1},
                      {"start": "2021-01-01T00:00:00", "lat": 1, "lon": 1}]}, "deployments", "open window"),
    ({"deployments": [{"start": "2021-01-01T00:00:00", "end": "2021-02-01T00:00:00", "lat": 1, "lon": 1},
                      {"start": "2020-01-01T00:00:00", "lat": 1, "lon": 1}]}, "overlap", "starts earlier"),
    ({"deployments": [{"start": "2020-01-01T00:00:00", "end": "2021-02-01T00:00:00", "lat": 1, "lon": 1},
                      {"start": "2021-01-01T00:00:00", "lat": 1, "lon": 1}]}, "overlap", "share time"),
    ({"deployments": [{"start": "2020-01-01T00:00:00", "lon": 1}]}, "platform", "no lat or no lon"),
    ({"deployments": [{"start": "2020-01-01T00:00:00", "lat": 1, "lon": 1, "platform_name": "p"}]},
     "platform", "names a platform"),
    ({"platform_type": "mobile", "deployments": [{"start": "2020-01-01T00:00:00"}]}, "platform",
     "no platform_name"),
    ({"platform_type": "mobile", "deployments": [{"start": "2020-01-01T00:00:00", "platform_name": "p"}]},
     "platform", "latitude,longitude"),
    ({"colour": "red"}, "schema", "unknown keys: colour"),
    ({"access": "secret"}, "schema", "access must be one of"),
    ({"output": None}, "schema", "missing fields: output"),
    ({"source_config": {"file_pattern": "x", "bogus": 1}}, "schema", "unknown keys: bogus"),
    ({"variables": [{"raw_name": "A", "dtype": "float"}]}, "schema", "dtype must be one of"),
]
TYPED = [
    ({"deployments": [{"start": "2020-01-01T00:00:00", "end": "soon", "lat": 1, "lon": 1}]}, "deployments[0].end", "a time, got soon"),
    ({"deployments": [{"end": None, "lat": 1, "lon": 1}]}, "deployments[0]", "missing fields: start"),
    ({"deployments": [{"start": "2020-01-01T00:00:00", "lat": [1], "lon": 1}]}, "deployments[0].lat", "a number, got array"),
    ({"deployments": "none"}, "deployments", "a list, got none"),
    ({"variables": ["T"]}, "variables[0]", "must be an object"),
    ({"variables": [{"raw_name": "A", "old_names": ["x", 1]}]}, "variables[0].old_names", "a list of texts"),
    ({"variables": [{"raw_name": None, "standard_name": "s", "extra_dimension": {"name": "h"},
                     "members": [{"raw_name": "B", "dimension_value": None}]}]}, "variables[0].members[0].dimension_value", "got null"),
    ({"variables": [{"standard_name": "s", "extra_dimension": {"name": "h"},
                     "members": [{"raw_name": "B", "dimension_value": 1}]}]}, "variables[0].extra_dimension", "missing fields: units"),
    ({"metadata": {"title": 5}}, "metadata.title", "text, got 5"),
    ({"output": {"file_naming": "x", "publish": "perhaps"}}, "output.publish", "true or false, got perhaps"),
    ({"source_config": {"table_name": "x"}}, "source_config", "missing fields: file_pattern"),
    ({"source_type": "generic_csv", "source_config": {"file_path": "a.csv", "cache_enabled": []}}, "source_config.cache_enabled", "got array"),
    ({"id": 7}, "id", "text, got 7"),
]


@pytest.fixture(scope="module")
def found(spark):
    """Findings of every case above, from one catalog."""
    docs = {f"rejected{i}": variant(**change) for i, (change, _, _) in enumerate(REJECTED)}
    docs |= {f"typed{i}": variant() | change for i, (change, _, _) in enumerate(TYPED)}
    out = {}
    for r in R.all_rules(catalog(spark, docs)).collect():
        out.setdefault(r["dataset_id"], []).append((r["rule"], r["location"], r["message"]))
    return out


@pytest.mark.parametrize("case", range(len(REJECTED)))
def test_reject_cases(found, case):
    _, rule, fragment = REJECTED[case]
    got = found.get(f"rejected{case}", [])
    assert any(r == rule and fragment in m for r, _, m in got), got


@pytest.mark.parametrize("case", range(len(TYPED)))
def test_typed_schema_walk(found, case):
    _, location, fragment = TYPED[case]
    got = found.get(f"typed{case}", [])
    assert any(r == "schema" and where == location and fragment in m for r, where, m in got), got


def test_accepted_forms(spark):
    doc = variant(metadata={"title": "T", "license": "x", "extra": {"deep": [1]}}, output={"file_naming": "x", "publish": "yes"},
                  deployments=[{"start": "2020-01-01T00:00:00Z", "end": None, "lat": "78.5", "lon": 15, "elevation": None, "notes": None}])
    assert findings(spark, doc) == []
    assert findings(spark, '{"id": "a", "id": "b"}')[-1] == ("schema", "document", "repeated keys")


def test_bad_date_leaves_other_datasets_alone(spark):
    from datetime import datetime

    from fleetseries.plans.build import build_fleet, catalog_deployments

    bad = variant(deployments=[{"start": "2020-01-01T00:00:00", "end": "soon", "lat": 1.0, "lon": 2.0}])
    cat = catalog(spark, {"good": BASE, "bad": bad})
    assert {r["dataset_id"] for r in catalog_deployments(cat).collect()} == {"good"}
    raw = spark.createDataFrame(
        [(d, f"{d}/x.dat", 0, 1, datetime(2020, 5, 1), {"AirT_C": "1.5"}) for d in ("good", "bad")],
        "dataset_id string, file_name string, block_start bigint, row_pos bigint, time timestamp_ntz, cells map<string,string>")
    got = {r["dataset_id"]: (r["value_num"], r["latitude"]) for r in build_fleet(raw, cat).collect()}
    assert got == {"good": (1.5, 78.0), "bad": (1.5, None)}


def test_canonical_json_ignores_order_and_number_forms(spark):
    texts = ['{"b": 1.50, "a": {"z": [1, 2.0], "y": "\\u00fc"}}', '{"a":{"y":"ü","z":[1,2]},"b":1.5}', '{"a":{"y":"ü","z":[2,1]},"b":1.5}', "no json"]
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "dataset_id string, content string")
    h = {r["dataset_id"]: r["hash"] for r in C.config_hash_sorted(rows).collect()}
    assert h["0"] == h["1"] != h["2"] and h["3"] == {r["dataset_id"]: r["hash"] for r in C.config_hash(rows).collect()}["3"]


def test_metadata_keeps_extra_keys_and_broken_documents_are_skipped(spark):
    c = catalog(spark, {"ok": BASE, "broken": '{"id": "x", "oops'})
    rows = {r["dataset_id"]: r for r in c.collect()}
    assert rows["ok"]["parsed_ok"] and not rows["broken"]["parsed_ok"]
    assert rows["ok"]["metadata"]["department"] == "Geo"
    assert rows["ok"]["metadata"]["standard_name_vocabulary"] == "CF-1.10"
    assert [r["dataset_id"] for r in R.valid_configs(c).collect()] == ["ok"]
    summary = {r["status"]: r["n_configs"] for r in R.validate_summary(R.validate_verdicts(c)).collect()}
    assert summary == {"valid": 1, "invalid": 1}
    skipped = {r["status"] for r in R.validate_verdicts(c, only_source="generic_csv").collect()}
    assert "skipped" in skipped


def listing(spark):
    docs = {
        "alpha": BASE,
        "beta": variant(metadata={"title": "Beta Buoy", "institution": "Ocean Lab", "project": "Nansen"},
                        platform_type="mobile", deployments=[{"start": "2020-01-01T00:00:00",
                                                              "platform_name": "RV X"}],
                        variables=[{"raw_name": "Lat", "standard_name": "latitude"},
                                   {"raw_name": "Lon", "standard_name": "longitude"}]),
        "gamma": variant(access="restricted", metadata={"title": "Secret", "institution": "Polar Institute"}),
        "delta": variant(metadata={"title": "50% done_x"}),
    }
    return C.search_documents(R.valid_configs(catalog(spark, docs)))


def test_search_filters_and_facets(spark):
    docs = listing(spark)
    vis = C.visible(docs)
    ids = lambda df: sorted(r["dataset_id"] for r in df.collect())
    assert ids(vis) == ["alpha", "beta", "delta"]
    assert ids(C.visible(docs, authenticated=True)) == ["alpha", "beta", "delta", "gamma"]
    assert ids(C.match_text(vis, "POLAR")) == ["alpha"]
    assert ids(C.match_text(vis, "cf-1.10")) == ["alpha", "beta", "delta"]
    assert ids(C.match_text(vis, "50%")) == ["delta"]           # plain substring: no wildcard
    assert ids(C.match_text(vis, "5_%")) == []
    assert ids(C.match_platform(vis, "mobile")) == ["beta"]
    assert ids(C.match_all_names(vis, ["latitude", "longitude"])) == ["beta"]
    assert ids(C.match_all_names(vis, ["latitude", "air_temperature"])) == []
    assert ids(C.match_metadata(vis, [("project", "nan")])) == ["beta"]
    assert ids(C.match_metadata(vis, [("project", "nan"), ("institution", "polar")])) == []
    names = sorted(r["standard_name"] for r in C.facet_names(vis).collect())
    assert names == ["air_temperature", "latitude", "longitude", "relative_humidity"]
    keys = sorted(r["metadata_key"] for r in C.facet_keys(vis).collect())
    assert "project" in keys and "department" in keys


def test_versions_hash_current_and_changes(spark):
    v = spark.createDataFrame([("a", 1, "x", "2026-01-01"), ("a", 2, "y", "2026-01-01"),
                               ("a", 3, "z", "2025-01-01")],
                              "dataset_id string, version_id long, content string, created_at string") \
        .withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    cur = C.current_version(C.config_hash(v))
    assert cur.first()["version_id"] == 2
    inc = C.config_hash(spark.createDataFrame([("a", "y"), ("b", "q"), ("a2", "y")],
                                              "dataset_id string, content string"))
    ch = sorted((r["dataset_id"], r["is_first"]) for r in C.config_changes(cur, inc, "2026-02-01").collect())
    assert ch == [("a2", True), ("b", True)]
    prov = V.provenance(cur, "2026-02-01 00:00:00").first()
    assert prov["history"].startswith("2026-02-01T00:00:00Z: generated by fleetseries")
    assert prov["history"].endswith(prov["config_hash"][:12])


def test_global_attrs_drop_nulls(spark):
    c = catalog(spark, {"x": variant(metadata={"title": "T", "license": None})})
    got = V.attrs_text(V.global_attrs(c)).first()["attrs_text"]
    assert "license" not in got and "title=T" in got and "platform_type=fixed" in got


def test_config_sources_folder_lines_and_union(spark, tmp_path):
    from fleetseries.sources import catalog_docs as D
    folder = tmp_path / "configs"
    folder.mkdir()
    (folder / "alpha.json").write_text(json.dumps(BASE, indent=2))
    (folder / "beta.json").write_text('{"id": "beta", broken')
    (folder / "notes.txt").write_text("ignored")
    lines = tmp_path / "devices.jsonl"
    lines.write_text(json.dumps(variant(id="dev1")) + "\n\n" + json.dumps(variant(id="dev2")) + "\n")
    a = D.read_config_dir(spark, str(folder), "folder")
    b = D.read_config_lines(spark, str(lines), "devices")
    both = D.union_sources([a, b])
    got = sorted((r["source_id"], r["dataset_id"]) for r in both.collect())
    assert got == [("devices", "dev1"), ("devices", "dev2"), ("folder", "alpha"), ("folder", "beta")]
    parsed = {r["dataset_id"]: r["parsed_ok"] for r in C.parse_documents(both).collect()}
    assert parsed == {"alpha": True, "beta": False, "dev1": True, "dev2": True}


def test_documents_of_one_partition_are_parsed_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "DOCS_PER_TASK", 1, raising=False)
    docs = spark.range(0, 12, 1, 1).selectExpr("concat('d', id) AS dataset_id").withColumn(
        "content", F.when(F.col("dataset_id") == "d7", "[").otherwise(json.dumps(variant(colour="red"))))
    stored, found = R.checked_catalog(docs, str(tmp_path))
    assert len(stored.inputFiles()) == 12 and stored.count() == 12
    assert sorted(r["message"] for r in found.collect()) == ["invalid JSON"] + ["unknown keys: colour"] * 11


def test_stored_documents_are_checked_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "DOCS_PER_TASK", 1)
    docs = spark.range(0, 60, 1, 1).selectExpr("concat('d', id) AS dataset_id").withColumn("content", F.lit(json.dumps(variant(colour="red"))))
    found = R.checked_catalog(docs, str(tmp_path))[1]
    assert found.count() == 60 and len(found.inputFiles()) >= 20  # a reader packs the catalog's small files into a few tasks


def test_an_object_of_a_document_is_read_once(spark):
    plan = R.rule_schema(catalog(spark, {"x": variant()}))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapType(StringType,VariantType") == 1


def test_a_rule_computes_its_own_checks_only(spark, tmp_path):
    cat = catalog(spark, {"x": variant(variables=[{"raw_name": "A"}, {"raw_name": "B", "old_names": ["A"]}], deployments=[])})
    parts = (R.rule_variable_shape, R.rule_name_collision, R.rule_deployments, R.rule_overlap, R.rule_platform)
    own = [[(r["rule"], r["location"], r["message"]) for r in part(cat).collect()] for part in parts]
    assert [len(x) for x in own] == [0, 1, 1, 0, 0]
    assert sorted(x for part in own for x in part) == findings(spark, cat.first()["content"])
    plan = R.rule_name_collision(cat)._jdf.queryExecution().optimizedPlan().toString()
    assert "next_start" not in plan and "member_arity" not in plan


def test_a_catalog_without_findings_is_stored_alone(spark, tmp_path):
    docs = spark.createDataFrame([("x", json.dumps(variant(colour="red")))], "dataset_id string, content string")
    parsed, place = R.parsed_catalog(docs, str(tmp_path))
    assert parsed.count() == 1 and [p.name for p in tmp_path.glob("*/*")] == ["catalog"]
    stored, found = R.checked_catalog(docs, str(tmp_path))
    assert stored.inputFiles() == parsed.inputFiles() and found.count() == 1


def test_tasks_and_broadcasts_do_not_grow_with_the_documents(spark, tmp_path, monkeypatch):
    n = 3 * spark.sparkContext.defaultParallelism
    monkeypatch.setattr(R, "DOCS_PER_TASK", 5)
    docs = spark.range(0, 5 * n, 1, 1).selectExpr("concat('d', id) AS dataset_id").withColumn(
        "content", F.when(F.col("dataset_id") == "d7", json.dumps(variant())).otherwise(json.dumps(variant(colour="red"))))
    stored, found = R.checked_catalog(docs, str(tmp_path))
    per_file = stored.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0]
    assert len(stored.inputFiles()) == n and per_file == 5
    listed, verdicts = R.valid_configs(stored, found), R.validate_verdicts(stored, found)
    assert [r["dataset_id"] for r in listed.collect()] == ["d7"]
    assert {r["status"]: r["n_configs"] for r in R.validate_summary(verdicts).collect()} == {"valid": 1, "invalid": 5 * n - 1}
    assert all("BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString() for df in (listed, verdicts))
