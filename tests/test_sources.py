"""Table, CSV and report sinks."""

import pytest

from daypanel.sources import tables as T


def test_catalog_table_overwrites_schema(spark):
    T.save_table(spark.range(5), "panel_store")
    T.save_table(spark.range(3).selectExpr("id", "id * 2 AS twice"), "panel_store")
    stored = T.load(spark, "panel_store")
    assert stored.columns == ["id", "twice"] and stored.count() == 3
    spark.sql("DROP TABLE panel_store")


def test_bucketed_table_spares_the_exchange(spark):
    T.save_table(spark.range(100).selectExpr("id % 10 AS id", "id AS v"), "bucketed_store", bucket_by="id", buckets=4)
    spark.conf.set("spark.sql.sources.v2.bucketing.enabled", "false")
    plan = T.load(spark, "bucketed_store").groupBy("id").sum("v")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    spark.sql("DROP TABLE bucketed_store")


def test_csv_and_report(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b", 0.5), (2, 'quote "x"', None)], "id long, text string, v double")
    back = T.read_csv(spark, T.save_csv(df, str(tmp_path / "csv")), df.schema)
    assert sorted(back.collect()) == sorted(df.collect())
    report = T.read_report(spark, T.save_report(df, str(tmp_path / "json")), df.schema)
    assert sorted(report.collect()) == sorted(df.collect())


def test_partitioned_orc(spark, tmp_path):
    df = spark.range(10).selectExpr("id", "id % 2 AS part")
    path = T.save_files(df, str(tmp_path / "orc"), "orc")
    assert spark.read.orc(path).count() == 10


def test_lineage_is_cut_in_the_sessions_folder(spark):
    df = T.cut_lineage(spark.range(4))
    assert spark.sparkContext.getCheckpointDir() and df.count() == 4
    assert T.written(spark.range(4)).count() == 4


def test_missing_catalog_table(spark):
    with pytest.raises(Exception):
        T.load(spark, "no_such_table").count()
