import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fleetseries.functions.scalar import parse_number
from fleetseries.operators import catalog as C
from fleetseries.schemas import FILE_INDEX, NUMBER_PATTERN
from fleetseries.sources import state


def test_versions_and_index_in_state_tables(spark, tmp_path):
    versions = state.StateTable(spark, str(tmp_path / "versions"), "dataset_id string, version_id long, hash string, "
                                                                  "content string, created_at timestamp_ntz")
    assert versions.version() == 0 and versions.read().count() == 0
    docs = C.config_hash(spark.createDataFrame([("a", '{"id":"a"}')], "dataset_id string, content string"))
    state.record_versions(versions, C.config_changes(versions.read(), docs, "2026-01-01 00:00:00"), 0)
    assert versions.version() == 1 and versions.read().count() == 1
    again = C.config_changes(C.current_version(versions.read()), docs, "2026-01-02 00:00:00")
    assert again.count() == 0                                    # unchanged hash: no new version

    index = state.StateTable(spark, str(tmp_path / "index"), FILE_INDEX)
    first = spark.createDataFrame([("a", "f1", "archived", 1, None, None, [], "closed")], FILE_INDEX)
    v = index.replace(first, 0)
    upd = spark.createDataFrame([("a", "f2", "live", 5, None, None, [], "active"), ("a", "f1", "archived", 2, None, None, [], "closed")], FILE_INDEX)
    v = state.update_index(index, upd, v)
    assert sorted((r["file_name"], r["size"]) for r in index.read().collect()) == [("f1", 2), ("f2", 5)]
    assert [(r["file_name"], r["size"]) for r in index.read(1).collect()] == [("f1", 1)]      # earlier versions stay readable


def test_two_writers_from_one_version(spark, tmp_path):
    table = state.StateTable(spark, str(tmp_path / "t"), "x long")
    other = state.StateTable(spark, str(tmp_path / "t"), "x long")
    seen = table.version(), other.version()
    table.append(spark.range(3).withColumnRenamed("id", "x"), seen[0])
    with pytest.raises(state.ConcurrentUpdate):
        other.append(spark.range(5).withColumnRenamed("id", "x"), seen[1])
    assert other.version() == 1 and other.read().count() == 3
    # both pass the first look, then one puts the snapshot in place before the other
    late = state.StateTable(spark, str(tmp_path / "t"), "x long")
    late.version = lambda: 1
    table.append(spark.range(2).withColumnRenamed("id", "x"), 1)
    with pytest.raises(state.ConcurrentUpdate):
        late.append(spark.range(7).withColumnRenamed("id", "x"), 1)
    assert other.read().count() == 5 and other.version() == 2
    assert not [p for p in (tmp_path / "t" / "_snapshots").iterdir() if p.name.startswith("_")]


_PY = re.compile(NUMBER_PATTERN[4:], re.IGNORECASE)


def _python_parse(text):
    if not _PY.match(text):
        return None
    return float(text.strip())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(
    st.floats(allow_nan=False, allow_infinity=False, width=32).map(repr),
    st.integers(-10**6, 10**6).map(str),
    st.text(alphabet="0123456789.eE+-_ ,xfdInainfty", min_size=0, max_size=8),
), min_size=1, max_size=40))
def test_number_grammar_matches_python(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r["v"] for r in df.select(parse_number(F.col("t")).alias("v")).collect()]
    want = [_python_parse(t) for t in texts]
    assert got == want
