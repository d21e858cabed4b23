import os

from chainweave.plans import lineage


def test_scratch_tables_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lineage, "shared_dir", lambda spark: f"file://{tmp_path}")
    with lineage.scratch(spark):
        inner = lineage.written(spark.range(5).toDF("n"), "inner")
        assert inner.count() == 5 and len(os.listdir(tmp_path)) == 1
        inner.write.parquet(f"{tmp_path}/result")
    assert os.listdir(tmp_path) == ["result"] and spark.read.parquet(f"{tmp_path}/result").count() == 5
    assert lineage.written(spark.range(2).toDF("n"), "outer").count() == 2 and len(os.listdir(tmp_path)) == 2
