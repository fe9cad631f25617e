"""Panel properties and edge rules."""

import pytest
from pyspark.sql import functions as F

from daypanel.functions import columns as C
from daypanel.operators import panel as P
from daypanel.plans.standins import END, SERIES, START, event_panel, events
from daypanel.sources.spine import date_spine, day_count, entity_sample


def test_panel_has_every_id_and_day(spark, small):
    panel = event_panel(spark, small)
    sizes = panel.select(*[F.size(c).alias(c) for c in SERIES]).distinct().collect()
    assert [set(r.asDict().values()) for r in sizes] == [{day_count(START, END)}]
    assert panel.count() == events(spark, small).select("user_id").distinct().count()


def test_panel_keeps_totals(spark, small):
    long = P.panel_to_long(event_panel(spark, small), "user_id", SERIES)
    inside = events(spark, small).where(F.col("date").between(START, END))
    clicks = inside.where("event_type = 'click'").count()
    assert long.where("kind = 'TS_CLMLINES_CLICK'").agg(F.sum("value")).first()[0] == clicks


def test_interval_rows_equal_range_join(spark, small):
    fills = events(spark, small).withColumn("days", F.pmod("k", F.lit(5)))
    expanded = P.expand_intervals(fills, "user_id", "date", "days", {"v": "value"}, START, END)
    ours = P.interval_totals(expanded, "user_id", ["v"])
    spine = date_spine(spark, START, END).withColumnRenamed("date", "day")
    joined = fills.join(spine, (F.col("day") >= F.col("date")) & (F.col("day") <= F.date_add("date", F.col("days"))))
    theirs = joined.groupBy("user_id", F.col("day").alias("date")).agg(F.sum("value").alias("v"))
    key = lambda df: sorted((r[0], r[1], round(r[2], 6)) for r in df.select("user_id", "date", "v").collect())
    assert key(ours) == key(theirs)


def test_interval_ends(spark):
    df = spark.createDataFrame([(1, "2024-01-23", 3), (2, "2023-12-30", 3), (3, "2024-01-05", 0)], "id long, d string, n int")
    rows = P.expand_intervals(df, "id", "d", "n", {"one": F.lit(1)}, START, END)
    assert {(r["id"], str(r["date"])) for r in rows.collect()} == {
        (1, "2024-01-23"), (1, "2024-01-24"), (2, "2024-01-01"), (2, "2024-01-02"), (3, "2024-01-05")
    }
    left = P.expand_intervals(df, "id", "d", "n", {"one": F.lit(1)}, START, END, closed="left")
    assert {(r["id"], str(r["date"])) for r in left.collect()} == {(1, "2024-01-23"), (1, "2024-01-24"), (2, "2024-01-01")}
    with pytest.raises(ValueError):
        P.expand_intervals(df, "id", "d", "n", {}, START, END, closed="right")


def test_id_outside_the_window_gets_zeros(spark):
    df = spark.createDataFrame([(1, "2030-05-05", 4)], "id long, d string, n int")
    panel = P.build_panel(df, "id", "d", "2024-01-01", "2024-01-03", sums={"n": "n"})
    assert panel.first()["n"] == [0, 0, 0]


def test_carry_maximum(spark):
    df = spark.createDataFrame([(1, [0, 2, 1, 0, 5, 3])], "id long, x array<int>")
    assert P.carry_maximum(df, ["x"]).first()["x"] == [0, 2, 2, 2, 5, 5]


def test_carry_maximum_of_odd_arrays(spark):
    long = [(i * 37) % 101 for i in range(700)]
    rows = [(1, []), (2, None), (3, [None, 4, None, 1]), (4, [7]), (5, long)]
    got = {r["id"]: r["x"] for r in P.carry_maximum(spark.createDataFrame(rows, "id long, x array<int>"), ["x"]).collect()}
    assert got == {1: [], 2: None, 3: [None, 4, 4, 4], 4: [7], 5: [max(long[: i + 1]) for i in range(len(long))]}


def test_sample_is_repeatable_and_whole(spark, small):
    df = events(spark, small)
    one = {r[0] for r in entity_sample(df, "user_id", 0.5, 1).select("user_id").distinct().collect()}
    two = {r[0] for r in entity_sample(df.repartition(5), "user_id", 0.5, 1).select("user_id").distinct().collect()}
    assert one == two and 0 < len(one) < 15
    kept = entity_sample(df, "user_id", 0.5, 1).count()
    assert kept == df.where(F.col("user_id").isin(list(one))).count()


def test_panel_plan_shuffles_sparse_rows_only(spark, small):
    plan = event_panel(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "partial_sum" in plan


def test_unknown_counts_as_not_listed(spark):
    df = spark.createDataFrame([("a", None), (None, None), ("z", "b")], "x string, y string")
    assert [r[0] for r in df.select(C.any_code(["x", "y"], ["a", "b"])).collect()] == [True, False, True]
    both = F.array("x", "y")
    assert [r[0] for r in df.select(C.array_has_code(both, ["a", "b"])).collect()] == [True, False, True]


def test_bad_numbers_do_not_fail(spark):
    df = spark.createDataFrame([("10.5",), ("PH",), ("x",), (None,)], "v string")
    bins = [(0, 10.999, "low"), (11, 20, "high")]
    assert [r[0] for r in df.select(C.bin_labels(F.col("v"), bins, ["PH"])).collect()] == ["high", "PH", "Unassigned", "Unassigned"]


def test_names(spark):
    df = spark.createDataFrame([(1, 2)], "`a.b` int, `a-b` int")
    with pytest.raises(ValueError):
        C.rename_all(df)
    with pytest.raises(ValueError):
        C.drop_listed(df, ["A.B"])
