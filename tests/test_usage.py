"""The README usage flow, end to end, on tiny local data."""
import json

from pyspark.sql import functions as F

from fleetseries.operators import catalog, coverage, export, publish, rules
from fleetseries.operators import reconcile as rec
from fleetseries.plans.build import build_dataset, build_fleet, catalog_deployments
from fleetseries.sources import catalog_docs
from fleetseries.sources import logger_files as lf
from fleetseries.sources.state import StateTable

INFO = '"TOA5","st1","CR1000X","1","OS","prog","2","Min"'
SPECS = [{"raw_name": "AirT_C", "old_names": ["AirTemp"], "standard_name": "air_temperature", "units": "degC"},
         {"raw_name": "RH", "standard_name": "relative_humidity"}]
CONFIG = {"id": "st1", "source_type": "loggernet", "access": "public",
          "source_config": {"file_pattern": "st1/st1_Min.dat"}, "variables": SPECS, "platform_type": "fixed",
          "deployments": [{"start": "2025-12-01T00:00:00", "lat": 78.2, "lon": 15.6}],
          "metadata": {"title": "Station 1"}, "output": {"file_naming": "{station}_{yyyy}{mm}.nc", "publish": True}}


def test_readme_flow(spark, tmp_path):
    (tmp_path / "configs").mkdir()
    (tmp_path / "configs" / "st1.json").write_text(json.dumps(CONFIG))
    st = tmp_path / "loggers" / "st1"
    st.mkdir(parents=True)
    head = [INFO, '"TIMESTAMP","RECORD","AirTemp","RH"', '"TS","RN","degC","%"', '"","","Avg","Avg"']
    (st / "st1_Min_Historical.dat").write_text("\n".join(head + [
        f'"2026-01-{d:02d} 00:00:00",{d},{d}.5,50' for d in range(1, 32)] + ['"2026-02-01 00:00:00",99,0.0,1']) + "\n")
    head2 = [INFO, '"TIMESTAMP","RECORD","AirT_C","RH"', '"TS","RN","degC","%"', '"","","Avg","Avg"']
    (st / "st1_Min.dat").write_text("\n".join(head2 + [
        '"2026-02-01 00:00:00",0,-1.5,60', '"2026-02-02 00:00:00",1,-2.5,"NAN"', '"2026-03-02 00:00:00",2,1,1']) + "\n")

    docs = catalog_docs.read_config_dir(spark, str(tmp_path / "configs"))
    cat = rules.valid_configs(catalog.catalog_table(docs.select("dataset_id", "content")))
    assert cat.count() == 1

    headers = lf.scan_headers(lf.list_files(spark, str(tmp_path / "loggers")))
    raw, rejects = lf.ingest(headers, str(tmp_path / "bronze"), lambda c: F.regexp_extract(c, r"/([^/]+)/[^/]+$", 1))
    assert rejects.count() == 0
    index = rec.classify_roles(rec.file_bounds(raw))

    deps = catalog_deployments(cat)
    wide = build_dataset(raw, SPECS, deps, "fixed", "2026-01-31", "2026-02-02", file_index=index)
    got = {r["time"].day: (r["air_temperature"], r["relative_humidity"], r["latitude"]) for r in wide.collect()}
    assert got == {31: (31.5, 50.0, 78.2), 1: (-1.5, 60.0, 78.2), 2: (-2.5, None, 78.2)}  # live wins on the 1st

    obs = build_fleet(raw, cat, "2026-01-31", "2026-02-02", file_index=index)
    assert obs.filter(F.col("canonical_name") == "air_temperature").count() == 3

    attrs = coverage.coverage_attrs(wide).select("dataset_id", F.create_map(
        F.lit("time_coverage_start"), F.col("time_coverage_start")).alias("attrs"))
    columns = ["air_temperature", "relative_humidity"]
    export.write_csv_documents(export.csv_lines(wide, attrs, columns), str(tmp_path / "csv"))
    assert len(list((tmp_path / "csv").rglob("part-*"))) == 2            # January and February documents
    assert export.json_columns(wide, columns).count() == 3

    cov = coverage.time_coverage(index)
    settled = publish.settled_months(cov, "2026-06-01")
    assert sorted(r["period"] for r in settled.collect()) == ["2026-01", "2026-02"]
    full = build_dataset(raw, SPECS, deps, "fixed", file_index=index)
    log = StateTable(spark, str(tmp_path / "log"), publish.LOG_SCHEMA)
    names = cat.select("dataset_id", F.col("file_naming").alias("template"))
    versions = catalog.config_hash(docs).select("dataset_id", "hash")
    publish.publish_periods(full, settled, names, versions, log, str(tmp_path / "pub"), "2026-06-01 00:00:00")
    per_period = {r["period"]: r["n_rows"] for r in log.read().collect()}
    assert per_period == {"2026-01": 32, "2026-02": 2}                   # Feb 1st midnight counted in January too
