"""Panels merged over windows against panels built at once."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from daypanel.operators import panel as P
from daypanel.operators.growth import merge_panels
from daypanel.sources import tables as T

COLS = ["lines", "top", "rate", "one"]


@pytest.fixture(scope="module")
def lines(spark):
    rng = random.Random(4)
    first = datetime.date(2024, 1, 1)
    rows = [(rng.randrange(12), first + datetime.timedelta(days=rng.randrange(60)), rng.randrange(9), rng.randrange(0, 20), rng.choice([0.1, 2.5, None])) for _ in range(300)]
    rows += [(100, first, 5, 3, 1.0), (101, first + datetime.timedelta(days=50), 7, 30, 1.0)]
    return spark.createDataFrame(rows, "id long, day date, k int, n int, v double").persist()


def built(lines, window):
    return P.build_panel(lines, "id", "day", *window, sums={"lines": F.lit(1)}, maxes={"top": "k"}, spans={"rate": "v", "one": "1"}, span_days="n", carried=["top"])


def rows_of(panel):
    return sorted((r["id"], *[[round(float(x), 9) for x in r[c]] for c in COLS]) for r in panel.collect())


@pytest.mark.parametrize(("old_end", "new_start"), [("2024-01-31", "2024-02-01"), ("2024-02-10", "2024-02-01"), ("2024-01-31", "2024-01-01"), ("2024-02-28", "2024-02-28")])
def test_merged_equals_rebuilt(lines, old_end, new_start):
    old, new = ("2024-01-01", old_end), (new_start, "2024-02-28")
    merged = merge_panels(built(lines, old), built(lines, new), "id", COLS, old, new, carried=["top"])
    whole = built(lines, ("2024-01-01", "2024-02-28"))
    assert merged.dtypes == whole.select(merged.columns).dtypes
    assert rows_of(merged) == rows_of(whole)


def test_entities_of_one_panel_only(spark):
    one = spark.createDataFrame([(1, [3, 1]), (2, [5, 5])], "id long, x array<int>")
    two = spark.createDataFrame([(2, [1, 2]), (3, [4, 9])], "id long, x array<int>")
    old, new = ("2024-01-01", "2024-01-02"), ("2024-01-03", "2024-01-04")
    got = {r["id"]: r["x"] for r in merge_panels(one, two, "id", ["x"], old, new).collect()}
    assert got == {1: [3, 1, 0, 0], 2: [5, 5, 1, 2], 3: [0, 0, 4, 9]}
    carried = {r["id"]: r["x"] for r in merge_panels(one, two, "id", ["x"], old, new, carried=["x"]).collect()}
    assert carried == {1: [3, 1, 1, 1], 2: [5, 5, 5, 5], 3: [0, 0, 4, 9]}
    assert merge_panels(one.where("false"), two.where("false"), "id", ["x"], old, new).count() == 0


def test_windows_must_meet(spark):
    panel = spark.createDataFrame([(1, [1])], "id long, x array<int>")
    for old, new in [
        (("2024-01-01", "2024-01-02"), ("2024-01-04", "2024-01-05")),
        (("2024-01-03", "2024-01-04"), ("2024-01-01", "2024-01-05")),
        (("2024-01-01", "2024-01-09"), ("2024-01-02", "2024-01-05")),
    ]:
        with pytest.raises(ValueError):
            merge_panels(panel, panel, "id", ["x"], old, new)


def test_bucketed_panels_meet_without_an_exchange(spark):
    for name, x in (("grown_old", [1]), ("grown_new", [2])):
        df = spark.createDataFrame([(i, x) for i in range(50)], "id long, x array<int>")
        T.save_table(df, name, bucket_by="id", buckets=4)
    one, two = (T.load(spark, name).hint("merge") for name in ("grown_old", "grown_new"))
    merged = merge_panels(one, two, "id", ["x"], ("2024-01-01", "2024-01-01"), ("2024-01-02", "2024-01-02"))
    assert "Exchange" not in merged._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r["x"]) for r in merged.collect()} == {(1, 2)}
    for name in ("grown_old", "grown_new"):
        spark.sql(f"DROP TABLE {name}")
