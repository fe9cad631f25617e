"""Intervals as differences against a row per covered day."""

import datetime
import decimal
import random

import pytest
from pyspark.sql import functions as F

from daypanel.operators import intervals as I
from daypanel.operators import panel as P

LO, HI = "2024-01-01", "2024-01-24"


def odd_intervals(spark, n=400, longest=40):
    draw = random.Random(n)
    rows = []
    for k in range(n):
        start = datetime.date(2023, 12, 10) + datetime.timedelta(days=draw.randrange(60))
        value = None if draw.random() < 0.2 else draw.choice([0.1, 1 / 3, 1e-9, 12345.678, -7.25])
        rows.append((draw.randrange(7) if k % 50 else None, start, draw.randrange(-3, longest), value, k % 5, decimal.Decimal(k) / 100))
    rows += [(9, None, 3, 1.0, 1, None), (9, datetime.date(2024, 1, 3), None, 1.0, 1, None), (8, datetime.date(2030, 1, 1), 2, 1.0, 1, None)]
    return spark.createDataFrame(rows, "id long, day date, n int, v double, k int, d decimal(9,2)")


MEASURES = {"one": "1", "v": "v", "k": "k", "d": "d"}


def rows_of(df):
    return sorted(((r["id"], r["date"], r["one"], None if r["v"] is None else round(r["v"], 9), r["k"], r["d"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("closed", ["both", "left"])
def test_equals_a_row_per_day(spark, closed):
    df = odd_intervals(spark)
    expanded = P.expand_intervals(df, "id", "day", "n", MEASURES, LO, HI, closed)
    want = P.interval_totals(expanded, "id", list(MEASURES))
    got = I.interval_days(df, "id", "day", "n", MEASURES, LO, HI, closed)
    assert got.columns == want.columns and [t for _, t in got.dtypes] == [t for _, t in want.dtypes]
    assert rows_of(got) == rows_of(want)


def test_panel_equals_the_expanded_one(spark):
    df = odd_intervals(spark).where("id IS NOT NULL")
    build = lambda expand: P.build_panel(
        df, "id", "day", LO, HI, sums={"lines": F.lit(1)}, maxes={"top": "k"}, spans={"v": "v", "n1": "1", "d": "d"}, span_days="n", span_filter="k <> 2", expand=expand, carried=["top"]
    )
    one, two = build(False), build(True)
    assert one.dtypes == two.dtypes
    flat = lambda p: sorted((r["id"], r["lines"], r["top"], [round(x, 9) for x in r["v"]], r["n1"], r["d"]) for r in p.collect())
    assert flat(one) == flat(two)


def test_nothing_stays_behind(spark):
    rows = [(1, datetime.date(2024, 1, 2 + i), 3, 0.1 * (i + 1)) for i in range(5)] + [(1, datetime.date(2024, 1, 20), 1, 1e15), (1, datetime.date(2024, 1, 20), 0, 0.1)]
    df = spark.createDataFrame(rows, "id long, day date, n int, v double")
    panel = P.build_panel(df, "id", "day", LO, HI, sums={}, spans={"v": "v"}, span_days="n").first()["v"]
    assert panel[9:19] == [0.0] * 10 and panel[20] == 1e15 and panel[21:] == [0.0] * 3
    assert panel[2] == 0.3


def test_two_rows_an_interval_however_long(spark):
    for days in (1, 200):
        df = spark.range(50).select("id", F.lit("2024-01-02").alias("day"), F.lit(days).alias("n"), F.lit(1.5).alias("v"))
        deltas = I.interval_deltas(df, "id", "day", "n", {"v": "v"}, "2024-01-01", "2024-12-31")
        assert deltas.count() == 100
    assert I.interval_deltas(df, "id", "day", "n", {"v": "v"}, "2024-01-01", "2024-01-24").count() == 50


def test_days_appear_after_the_last_exchange(spark):
    df = odd_intervals(spark)
    plan = I.interval_days(df, "id", "day", "n", MEASURES, LO, HI)._jdf.queryExecution().executedPlan().toString().split("\n")
    exchanges = [i for i, line in enumerate(plan) if "Exchange" in line]
    days = [i for i, line in enumerate(plan) if "Generate explode(sequence" in line]
    assert days and max(days) < min(exchanges) and len(exchanges) == 2
    assert "partial_sum" in "\n".join(plan)


def test_empty_and_bad(spark):
    df = odd_intervals(spark)
    assert I.interval_days(df.where("false"), "id", "day", "n", MEASURES, LO, HI).count() == 0
    with pytest.raises(ValueError):
        I.interval_days(df, "id", "day", "n", MEASURES, LO, HI, closed="right")


def test_carried_maximum_needs_few_steps(spark):
    df = spark.createDataFrame([(1, [0, 2, 1, 0, 5, 3, 9])], "id long, x array<int>")
    short, whole = P.carry_maximum(df, ["x"], days=7), P.carry_maximum(df, ["x"])
    assert short.first() == whole.first()
    size = lambda d: len(d._jdf.queryExecution().optimizedPlan().toString())
    assert size(short) < size(whole) / 5
    assert P.carry_maximum(df, ["x"], days=1).first()["x"] == [0, 2, 1, 0, 5, 3, 9]
