"""Stages are written once per version of their tables."""

import pyarrow as pa
import pyarrow.parquet as pq

from folioscope.sources.staging import stage_once


def test_stage_follows_its_table(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    read = lambda: stage_once(spark.read.parquet(path), "t", [path])
    pq.write_table(pa.table({"x": [1, 2]}), path)
    first = read()
    assert read() is first and first.count() == 2
    pq.write_table(pa.table({"x": [1, 2, 3]}), path)
    spark.catalog.refreshByPath(path)
    assert read().count() == 3
