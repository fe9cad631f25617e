"""Boosted trees: a search by successive halving, the fitted trees as a table, and importances read from it."""

from __future__ import annotations

import math
import random
import uuid
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daypanel.functions.series import let
from daypanel.operators.models import choice, dealt, drawn_trials, log_uniform, positive_weight
from daypanel.sources.tables import shared_folder, written

#: The published space. `gamma` is the loss, summed over rows, that a split must save.
TREE_SPACE = {
    "depth": choice([2, 4, 6, 8, 10]),
    "rate": log_uniform(-3, -1.5),
    "gamma": log_uniform(-2, -0.5),
    "subsample": choice([0.5]),
    "positive": choice([100, 150, 200, 250, 300, 350, 400, 450]),
}
TRIALS, ROUNDS = 300, 100
#: Rows of a partition that trees are fitted on, many fits side by side.
PARTITION_ROWS = 100_000
#: Walks of a row through a tree that a task makes.
WALKS = 200_000


def search_trees(
    train: DataFrame,
    validation: DataFrame,
    label: str,
    cols: Sequence[str],
    trials: int = TRIALS,
    seed: int = 0,
    space: Mapping[str, Callable[[random.Random], object]] = TREE_SPACE,
    rounds: int = ROUNDS,
    shrink: int = 3,
    parallel: int = 8,
    metric: str = "areaUnderPR",
) -> tuple[DataFrame, dict, PipelineModel]:
    """Seeded search by successive halving: (trials table, best parameters, best model).

    All `trials` draws are fitted with few rounds of boosting; the best one in
    `shrink` of them go on to a rung of `shrink` times the rounds, and so on up to
    `rounds`. Both parts are assembled and stored once, and the fits of a rung
    run side by side in `parallel` threads. The table has a row per fit: (trial,
    rung, rounds, score, params); equal scores fall to the earlier trial. The
    same seed and rows give the same table.
    """
    assembler = VectorAssembler(inputCols=list(cols), outputCol="features")
    # Subsamples are drawn row by row, so the rows lie in an order of their own.
    fitted_on, judged_on = (
        dealt(assembler.transform(part.select(label, *cols)), [label, *cols], PARTITION_ROWS, parallel) for part in (train, validation)
    )
    rows = fitted_on.count()
    evaluator = BinaryClassificationEvaluator(rawPredictionCol="rawPrediction", labelCol=label, metricName=metric)
    drawn = drawn_trials(space, trials, seed)

    def fit(number: int, steps: int) -> tuple[float, GBTClassifier]:
        p = drawn[number]
        trees = GBTClassifier(
            labelCol=label,
            featuresCol="features",
            weightCol="weight",
            maxIter=steps,
            maxDepth=p["depth"],
            stepSize=p["rate"],
            # A split's gain is a mean over rows here.
            minInfoGain=p["gamma"] / max(rows, 1),
            subsamplingRate=p["subsample"],
            seed=seed + number,
        )
        model = trees.fit(positive_weight(fitted_on, label, p["positive"]))
        return evaluator.evaluate(model.transform(judged_on)), model

    # As many rungs as the trials allow, the first of them with one round at least.
    rungs = max(1, min(math.ceil(math.log(max(trials, 2), shrink) - 1e-9), math.floor(math.log(rounds, shrink) + 1e-9) + 1))
    table, alive, best = [], list(range(trials)), None
    try:
        with ThreadPoolExecutor(parallel) as pool:
            for rung in range(rungs):
                steps = max(1, rounds // shrink ** (rungs - 1 - rung))
                waiting = [pool.submit(inheritable_thread_target(train.sparkSession)(fit), number, steps) for number in alive]
                scored = sorted((-f.result()[0], number, f.result()[1]) for number, f in zip(alive, waiting, strict=True))
                table += [(number, rung, steps, -loss, {k: str(v) for k, v in drawn[number].items()}) for loss, number, _ in scored]
                best = scored[0]
                alive = sorted(number for _, number, _ in scored[: max(1, math.ceil(len(alive) / shrink))])
    finally:
        fitted_on.unpersist()
        judged_on.unpersist()
    trials_table = train.sparkSession.createDataFrame(table, "trial int, rung int, rounds int, score double, params map<string,string>")
    return trials_table, drawn[best[1]], PipelineModel(stages=[assembler, best[2]])


def tree_table(model: PipelineModel) -> DataFrame:
    """(tree, node, feature, threshold, left, right, gain, prediction) of a fitted ensemble, one row per node.

    `feature` is the column's name; leaves have no feature and children -1. Read
    from the model as Spark stores it, in the folder for intermediate tables.
    """
    ensemble = model.stages[-1]
    names = F.array(*[F.lit(c) for c in model.stages[0].getInputCols()])
    spark = SparkSession.active()
    path = f"{shared_folder(spark)}/trees-{uuid.uuid4().hex}"
    ensemble.write().save(path)
    split = F.col("nodeData.split")
    inner = F.col("nodeData.leftChild") >= 0
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"),
        F.col("nodeData.id").alias("node"),
        F.when(inner, F.get(names, split["featureIndex"])).alias("feature"),
        F.when(inner, F.get(split["leftCategoriesOrThreshold"], F.lit(0))).alias("threshold"),
        F.col("nodeData.leftChild").alias("left"),
        F.col("nodeData.rightChild").alias("right"),
        F.when(inner, F.col("nodeData.gain")).alias("gain"),
        F.col("nodeData.prediction").alias("prediction"),
    )


def walked_paths(df: DataFrame, trees: DataFrame, keep: Sequence[str]) -> DataFrame:
    """(kept columns, tree, path): the nodes of each tree that a row passes, root first.

    A row meets every tree of the model, whose size is that of the model and not
    of the data, and is walked down in an expression over the tree's nodes.
    """
    cols = sorted({r["feature"] for r in trees.select("feature").distinct().collect()} - {None})
    place = F.create_map(*[v for i, c in enumerate(cols) for v in (F.lit(c), F.lit(i))]) if cols else F.create_map().cast("map<string,int>")
    node = F.struct("node", F.try_element_at(place, F.col("feature")).alias("at"), "threshold", "left", "right")
    # Node numbers run from 0 without gaps.
    packed = trees.groupBy("tree").agg(F.sort_array(F.collect_list(node)).alias("nodes"), F.count("*").alias("n"))
    values = F.array(*[F.col(f"`{c}`").cast("double") for c in cols]).alias("values")
    rows = df.select(*keep, values).crossJoin(F.broadcast(packed))

    def down(path: Column, _: Column) -> Column:
        def step(at: Column) -> Column:
            child = F.when(F.get("values", at["at"]) <= at["threshold"], at["left"]).otherwise(at["right"])
            return F.when(at["left"] < 0, path).otherwise(F.concat(path, F.array(child)))

        return let(F.get("nodes", F.element_at(path, -1)), step)

    depth = tree_depth(trees)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(max(depth, 1))), F.array(F.lit(0)), down)
    return rows.select(*keep, "tree", walked.alias("path"))


def tree_depth(trees: DataFrame) -> int:
    """Splits on the longest way down, by following the children level by level."""
    edges = trees.where("left >= 0").select("tree", F.explode(F.array("left", "right")).alias("child"), F.col("node").alias("parent"))
    depth, level = 0, trees.where("node = 0 AND left >= 0").select("tree", F.col("node").alias("parent"))
    while not level.isEmpty():
        depth += 1
        below = edges.join(level, ["tree", "parent"]).select("tree", F.col("child").alias("parent"))
        inner = trees.where("left >= 0").select("tree", F.col("node").alias("parent"))
        level = below.join(inner, ["tree", "parent"])
    return depth


def split_importance(model: PipelineModel, df: DataFrame, top: int | None = None) -> DataFrame:
    """(feature, weight, cover, gain) of the features that the trees split on.

    `weight` is how many splits use a feature, `cover` how many rows of `df` a
    split on it meets on average, `gain` what such a split gains on average.
    """
    trees = written(tree_table(model))
    spread = df.repartition(max(1, math.ceil(df.count() * model.stages[-1].getNumTrees / WALKS)))
    passed = walked_paths(spread, trees, []).select("tree", F.explode("path").alias("node"))
    met = passed.groupBy("tree", "node").agg(F.count("*").alias("rows"))
    splits = trees.where("left >= 0").join(met, ["tree", "node"], "left")
    found = splits.groupBy("feature").agg(
        F.count("*").alias("weight"), F.avg(F.coalesce("rows", F.lit(0))).alias("cover"), F.avg("gain").alias("gain")
    )
    return found if top is None else found.orderBy(F.desc("weight"), "feature").limit(top)
