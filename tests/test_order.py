"""Orders that repeat, stored intermediates with an owner, bucketed joins."""

import os
import random

import pytest
from pyspark.sql import functions as F

from daypanel.operators import ordered as O
from daypanel.operators import resample as B
from daypanel.plans.source_queries import joined_buckets
from daypanel.sources import tables as T


@pytest.mark.parametrize("files", [1, 3, 7, 40])
def test_shuffled_places_do_not_depend_on_the_partitioning(spark, files):
    df = spark.range(25).withColumn("v", F.col("id") * 2)
    places = lambda d: {r["id"]: (r["file"], r["place"]) for r in O.shuffled_places(d, "id", 5, files).collect()}
    got = places(df)
    assert got == places(df.repartition(9)) == places(df.orderBy(F.desc("id")).coalesce(1))
    sizes = {}
    for file, place in got.values():
        sizes.setdefault(file, []).append(place)
    assert all(sorted(p) == list(range(len(p))) for p in sizes.values())
    assert set(sizes) <= set(range(files)) and max(map(len, sizes.values())) - min(map(len, sizes.values())) <= 1
    assert got != {r["id"]: (r["file"], r["place"]) for r in O.shuffled_places(df, "id", 6, files).collect()}
    assert O.shuffled_places(df.where("false"), "id", 5, files).count() == 0


def test_stored_in_order(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, 1.5, -2.0, 7.0])) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, v double")
    order = [F.desc_nulls_last("v"), F.asc("id")]
    want = {i: n for n, (i, _) in enumerate(sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0])))}
    for n, parts in enumerate((1, 7)):
        stored = O.stored_in_order(df.repartition(parts), order, str(tmp_path / f"ordered-{n}"))
        assert stored.columns == ["id", "v", "place"]
        assert {r["id"]: r["place"] for r in stored.collect()} == want
    assert O.stored_in_order(df.where("false"), order, str(tmp_path / "none")).count() == 0


def test_shuffled_upsample_repeats(spark):
    df = spark.createDataFrame([(i, int(i % 4 == 0), None if i % 3 else "x") for i in range(40)], "id int, y int, `a.b` string")
    run = lambda d, seed: [tuple(r) for r in B.upsample(d, "y", seed).collect()]
    one = run(df, 3)
    assert one == run(df.repartition(5), 3) != run(df, 4)
    assert sorted(map(str, one)) == sorted(str(tuple(r)) for r in B.upsample(df, "y").collect()) and len(one) == 60


def files_in(folder):
    return {os.path.join(d, n) for d, _, names in os.walk(folder.removeprefix("file:")) for n in names if not n.endswith(".crc")}


def test_a_closed_scope_leaves_no_folder(spark):
    folder = T.shared_folder(spark)
    outside = T.written(spark.range(3))
    before = files_in(folder)
    with T.intermediates(spark) as outer:
        one = T.written(spark.range(5))
        with T.intermediates(spark) as inner:
            two = T.cut_lineage(spark.range(7))
            assert (one.count(), two.count()) == (5, 7) and len(inner.paths) == 1
        assert one.count() == 5 and len(outer.paths) == 1
        assert len(files_in(folder)) > len(before)
    assert files_in(folder) == before and outside.count() == 3


def test_a_failed_scope_is_cleared_too(spark):
    folder = T.shared_folder(spark)
    before = files_in(folder)
    with pytest.raises(ZeroDivisionError), T.intermediates(spark):
        T.written(spark.range(5))
        raise ZeroDivisionError
    assert files_in(folder) == before


def test_named_targets_are_not_the_scopes(spark, tmp_path):
    with T.intermediates(spark):
        T.written(spark.range(2), str(tmp_path / "kept"))
    assert spark.read.parquet(str(tmp_path / "kept")).count() == 2


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return "file:/somewhere/warehouse" if "warehouse" in key else default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        T.shared_folder(Session())


def test_bucketed_tables_join_without_an_exchange(spark, small):
    plan = joined_buckets(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan and plan.count("Bucketed: true") == 2
