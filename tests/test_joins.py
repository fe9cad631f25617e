"""Joins with a hot key give what the plain join gives."""

import pytest
from pyspark.sql import functions as F

from daypanel.operators import cohort as K


@pytest.fixture(scope="module")
def skewed(spark):
    key = F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") == 1, None).otherwise(F.col("id") % 2500)
    df = spark.range(9000).select(key.cast("long").alias("k"), F.col("id").alias("v"))
    side = spark.range(0, 2500, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    return df, side.unionByName(spark.createDataFrame([(7, 70)], "k long, w long"))


@pytest.mark.parametrize("keep, how", [(K.exclude, "left_anti"), (K.restrict, "left_semi")])
def test_exclusion_and_restriction_with_a_hot_key(skewed, keep, how):
    df, side = skewed
    rows = lambda d: sorted(map(repr, d.collect()))
    assert rows(keep(df, side, "k")) == rows(df.join(side, "k", how))


def test_cohort_reads_its_lines_once(spark):
    lines = spark.createDataFrame([], "k long, code string, at int")
    kept = K.exclude(K.restrict(lines, spark.range(5).toDF("k"), "k"), spark.range(3).toDF("k"), "k")
    dim = spark.createDataFrame([("a", 0, 9)], "c string, lo int, hi int")
    plan = K.join_valid(kept, dim, "code", "c", F.col("at"), "lo", "hi")._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("at#") and plan.count("LogicalRDD") <= 2


def test_valid_entries(spark):
    lines = spark.createDataFrame([(1, "a", 5), (2, "a", 50), (3, "b", 5), (4, None, 5)], "id int, code string, at int")
    dim = spark.createDataFrame([("a", 0, 9, "x"), ("a", 4, 6, "y"), ("b", 8, 9, "z")], "c string, lo int, hi int, name string")
    got = K.join_valid(lines, dim, "code", "c", F.col("at"), "lo", "hi").select("id", "name").collect()
    assert sorted((r["id"], r["name"] or "") for r in got) == [(1, "x"), (1, "y"), (2, ""), (3, ""), (4, "")]
