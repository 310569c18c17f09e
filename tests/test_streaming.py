from fleetseries.streaming.archived_ingest import start_archived_ingest

INFO = '"TOA5","St1","CR1000X","1234","OS.05","prog","4711","Min"'
HEAD = [INFO, '"TIMESTAMP","RECORD","AirT"', '"TS","RN","degC"', '"","","Avg"']


def _file(path, rows):
    path.write_text("\n".join(HEAD + rows) + "\n")


def test_archived_files_ingested_once(spark, tmp_path):
    src = tmp_path / "src" / "st1"
    src.mkdir(parents=True)
    _file(src / "st1_Min_Historical.dat", ['"2026-01-01 00:00:00",1,1.5', '"2026-01-01 00:10:00",2,2.5'])
    bronze, ckpt = str(tmp_path / "bronze"), str(tmp_path / "ckpt")
    q = start_archived_ingest(spark, str(tmp_path / "src"), bronze, ckpt)
    q.awaitTermination(120)
    assert spark.read.parquet(bronze + "/rows").count() == 2
    _file(src / "st1_Min_Historical.dat.backup1", ['"2026-01-01 00:20:00",3,3.5'])
    (src / "st1_Min.dat").write_text("\n".join(HEAD) + "\n")   # live file: not streamed
    q = start_archived_ingest(spark, str(tmp_path / "src"), bronze, ckpt)
    q.awaitTermination(120)
    df = spark.read.parquet(bronze + "/rows")
    assert df.count() == 3
    assert {r["dataset_id"] for r in df.collect()} == {"st1"}
    assert spark.read.parquet(bronze + "/rejects").filter("reason = 'no_time'").count() == 0
