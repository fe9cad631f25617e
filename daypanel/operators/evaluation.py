"""Threshold curves, confusion metrics, calibration and subgroup scores.

`label` is 0/1, `score` a number; higher scores mean more likely positive.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daypanel.operators.ordered import exact_quantiles, running_sums
from daypanel.operators.panel import melt
from daypanel.sources.tables import written


def _counts(label: str) -> dict[str, Column]:
    positive = F.col(label).cast("double") == 1.0
    return {"pos": F.when(positive, 1).otherwise(0), "neg": F.when(positive, 0).otherwise(1)}


def score_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """Per distinct score: positives and negatives at it and at or above it."""
    return _as_curve(running_sums(df, score, _counts(label), descending=True), score)


def score_sums(df: DataFrame, label: str, score: str) -> DataFrame:
    """Per distinct `score`, null included: what curves, confusion counts and Brier scores are made of.

    `pos` and `neg` as in `score_curve`, `sure_neg` without rows of a null label,
    `squares` the squared distances of score and label and `known` their number.
    """
    gap = F.col(label).cast("double") - F.col(score)
    sums = {k: F.sum(c) for k, c in _counts(label).items()}
    sums["sure_neg"] = F.count_if(F.col(label).cast("double") != 1.0)
    sums |= {"squares": F.sum(gap * gap), "known": F.count(gap)}
    return df.groupBy(F.col(score).alias("score")).agg(*[c.alias(k) for k, c in sums.items()])


def curve_of_sums(sums: DataFrame) -> DataFrame:
    """`score_curve` of the rows behind `score_sums`."""
    return _as_curve(running_sums(sums, "score", {k: F.col(k) for k in ("pos", "neg")}, descending=True), "score")


def _as_curve(sums: DataFrame, score: str) -> DataFrame:
    return sums.select(
        F.col(score).cast("double").alias("threshold"),
        "pos",
        "neg",
        F.col("cum_pos").alias("tp"),
        F.col("cum_neg").alias("fp"),
        F.col("all_pos").alias("positives"),
        F.col("all_neg").alias("negatives"),
    )


def roc_points(df: DataFrame, label: str, score: str, curve: DataFrame | None = None) -> DataFrame:
    """(threshold, fpr, tpr), one point per distinct score."""
    curve = curve if curve is not None else score_curve(df, label, score)
    return curve.select(
        "threshold",
        F.try_divide("fp", "negatives").alias("fpr"),
        F.try_divide("tp", "positives").alias("tpr"),
    )


def pr_points(df: DataFrame, label: str, score: str) -> DataFrame:
    """(threshold, precision, recall), one point per distinct score."""
    return score_curve(df, label, score).select(
        "threshold",
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        F.try_divide("tp", "positives").alias("recall"),
    )


def curve_areas(df: DataFrame, label: str, score: str, curve: DataFrame | None = None) -> DataFrame:
    """One row: area under ROC and PR (trapezoids) and average precision.

    A group of tied scores adds its negatives times the mean of the positives
    before and after it to the ROC area, so no neighbour is needed. The first
    PR trapezoid starts at recall 0 with the precision of the first point.
    """
    curve = curve if curve is not None else score_curve(df, label, score)
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    prior_tp, prior_all = F.col("tp") - F.col("pos"), F.col("tp") + F.col("fp") - F.col("pos") - F.col("neg")
    prior_precision = F.when(prior_all > 0, prior_tp / prior_all).otherwise(precision)
    return curve.agg(
        F.try_divide(
            F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)),
            F.max("positives") * F.max("negatives"),
        ).alias("roc_auc"),
        F.try_divide(F.sum(F.col("pos") * (precision + prior_precision) / 2), F.max("positives")).alias("pr_auc"),
        F.try_divide(F.sum(F.col("pos") * precision), F.max("positives")).alias("average_precision"),
    )


def corner_points(curve: DataFrame) -> DataFrame:
    """The curve without points on a straight line between their neighbours.

    A point is left out when the next lower score brings the same numbers of
    positives and negatives as its own did; the first and the last stay. The
    next point starts where this one ends, so the two meet in a group keyed by
    the cumulative counts and no ordered window is needed.
    """
    own = F.struct("threshold", "pos", "neg", "positives", "negatives")
    following = F.struct("pos", "neg")
    ends = F.struct("tp", "fp", own.alias("own"), F.lit(None).cast("struct<pos:bigint,neg:bigint>").alias("next"))
    starts = F.struct(
        (F.col("tp") - F.col("pos")).alias("tp"),
        (F.col("fp") - F.col("neg")).alias("fp"),
        F.when(F.lit(False), own).alias("own"),
        following.alias("next"),
    )
    met = (
        curve.select(F.explode(F.array(ends, starts)).alias("e"))
        .groupBy("e.tp", "e.fp")
        .agg(F.max("e.own").alias("own"), F.max("e.next").alias("next"))
        .where(F.col("own").isNotNull())
    )
    first = (F.col("tp") == F.col("own.pos")) & (F.col("fp") == F.col("own.neg"))
    turns = (F.col("next.pos") != F.col("own.pos")) | (F.col("next.neg") != F.col("own.neg"))
    return met.where(first | F.col("next").isNull() | turns).select("own.*", "tp", "fp")


def best_threshold(
    df: DataFrame, label: str, score: str, digits: int = 8, corners_only: bool = True, curve: DataFrame | None = None
) -> DataFrame:
    """One row: the threshold with the largest geometric mean of tpr and 1 - fpr.

    Only corners of the curve are tried, unless `corners_only` is off; of equal
    means the highest threshold wins.
    """
    curve = curve if curve is not None else score_curve(df, label, score)
    points = roc_points(df, label, score, corner_points(curve) if corners_only else curve)
    gmean = F.sqrt(F.col("tpr") * (1 - F.col("fpr")))
    ranked = F.struct(F.round(gmean, 12).alias("rounded"), "threshold", gmean.alias("gmean"), "tpr", "fpr")
    best = points.agg(F.max(ranked).alias("b"))
    return best.select(
        F.round("b.threshold", digits).alias("threshold"), F.col("b.gmean"), F.col("b.tpr"), F.col("b.fpr")
    )


def confusion(df: DataFrame, label: str, score: str, threshold: float | str, inclusive: bool = True) -> DataFrame:
    """One row with tn, tp, fn, fp in one pass.

    `threshold` is a number or the name of a column that holds it. A score at
    the threshold is positive when `inclusive`.
    """
    cut = F.col(threshold) if isinstance(threshold, str) else F.lit(float(threshold))
    called = F.col(score) >= cut if inclusive else F.col(score) > cut
    actual = F.col(label).cast("double") == 1.0
    return df.agg(
        F.count_if(~called & ~actual).alias("tn"),
        F.count_if(called & actual).alias("tp"),
        F.count_if(~called & actual).alias("fn"),
        F.count_if(called & ~actual).alias("fp"),
    )


def with_metrics(counts: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, F1 and F2 from tn, tp, fn, fp; 0 where undefined."""

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    tn, tp, fn, fp = (F.col(c) for c in ("tn", "tp", "fn", "fp"))

    def f_beta(beta: int) -> Column:
        return ratio((beta * beta + 1) * tp, (beta * beta + 1) * tp + beta * beta * fn + fp)

    return counts.withColumns(
        {
            "accuracy": ratio(tn + tp, tn + tp + fn + fp),
            "precision": ratio(tp, tp + fp),
            "recall": ratio(tp, tp + fn),
            "f1": f_beta(1),
            "f2": f_beta(2),
        }
    )


def class_report(df: DataFrame, label: str, score: str, threshold: float, inclusive: bool = True) -> DataFrame:
    """Precision, recall, F1 and support for class 0 and class 1."""
    counts = confusion(df, label, score, threshold, inclusive)
    one = F.struct(F.lit(1).alias("class"), "tp", "fp", "fn", (F.col("tp") + F.col("fn")).alias("support"))
    zero = F.struct(
        F.lit(0).alias("class"),
        F.col("tn").alias("tp"),
        F.col("fn").alias("fp"),
        F.col("fp").alias("fn"),
        (F.col("tn") + F.col("fp")).alias("support"),
    )
    per_class = counts.select(F.explode(F.array(zero, one)).alias("c")).select("c.*")
    scored = with_metrics(per_class.withColumn("tn", F.lit(0)))
    return scored.select("class", "precision", "recall", "f1", "support")


def quantile_threshold(df: DataFrame, score: str, q: float) -> DataFrame:
    """One row `threshold`: the score's quantile q in [0, 1], interpolated."""
    return exact_quantiles(df, score, [q]).select(F.col("value").alias("threshold"))


def top_share_threshold(df: DataFrame, score: str, share: float) -> DataFrame:
    """One row `threshold`: the score at 0-based rank round(n * share) from the top."""
    counts = running_sums(df, score, {"n": F.lit(1)}, descending=True)
    place = F.least(F.bround(F.col("all_n") * F.lit(float(share))), F.col("all_n") - 1)
    hit = counts.where(place.between(F.col("cum_n") - F.col("n"), F.col("cum_n") - 1))
    return hit.select(F.col(score).cast("double").alias("threshold"))


def confusion_at(df: DataFrame, label: str, score: str, thresholds: DataFrame, inclusive: bool = True) -> DataFrame:
    """Confusion counts at a threshold that is itself the one-row result of a query."""
    cut = thresholds.first()["threshold"]
    return confusion(df, label, score, cut, inclusive).withColumn("threshold", F.lit(float(cut)))


def brier(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row: mean squared distance of score and label."""
    gap = F.col(label).cast("double") - F.col(score)
    return df.agg(F.avg(gap * gap).alias("brier"))


def brier_by_group(
    df: DataFrame, label: str, score: str, groups: Mapping[str, Column], ratio: str = "group_over_all"
) -> DataFrame:
    """Brier score overall ("all") and for each group's rows, with the ratio of the two.

    `groups` maps a name to a 0/1 indicator; groups without rows do not appear.
    """
    gap = F.col(label).cast("double") - F.col(score)
    member = [F.when(ind == 1, F.lit(name)) for name, ind in groups.items()]
    rows = df.select((gap * gap).alias("_sq"), F.explode(F.array_compact(F.array(F.lit("all"), *member))).alias("group"))
    scores = rows.groupBy("group").agg(F.avg("_sq").alias("brier"), F.count("*").alias("n"))
    # At most one row per group and the overall one, so this window is small.
    whole = F.max(F.when(F.col("group") == "all", F.col("brier"))).over(Window.partitionBy())
    over = F.try_divide(F.col("brier"), whole) if ratio == "group_over_all" else F.try_divide(whole, F.col("brier"))
    return scores.select("group", "n", "brier", over.alias("normalized"))


def calibration(df: DataFrame, label: str, score: str, digits: int = 3) -> DataFrame:
    """Mean of label - score by rounded score."""
    gap = F.col(label).cast("double") - F.col(score)
    return df.groupBy(F.round(score, digits).alias("score_bin")).agg(F.avg(gap).alias("mean_difference"))


def score_histogram(df: DataFrame, label: str, score: str, digits: int = 1) -> DataFrame:
    """Rows by label and rounded score."""
    return df.groupBy(F.col(label), F.round(score, digits).alias("score_bin")).agg(F.count("*").alias("n"))


def fixed_width_histogram(df: DataFrame, score: str, bins: int = 100) -> DataFrame:
    """Rows per bin of width 1 / bins; a score of 1 falls in the last bin."""
    place = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(place.alias("bin")).agg(F.count("*").alias("n"))


def percent_rank_by_label(df: DataFrame, label: str, score: str, digits: int = 2) -> DataFrame:
    """Mean score by label and rounded percent rank of the score within the label."""
    counts = running_sums(df, score, {"n": F.lit(1)}, by=[label])
    rank = F.coalesce(F.try_divide(F.col("cum_n") - F.col("n"), F.col("all_n") - 1), F.lit(0.0))
    return (
        counts.withColumn("percentile", F.round(rank, digits))
        .groupBy(label, "percentile")
        .agg((F.sum(F.col(score) * F.col("n")) / F.sum("n")).alias("mean_score"))
    )


def score_quantiles(
    df: DataFrame, label: str, score: str, points: Sequence[float] = (0.33, 0.66, 0.75, 0.99)
) -> DataFrame:
    """(label, q, value): score quantiles within each label."""
    return exact_quantiles(df, score, points, by=[label], interpolate=False)


def score_correlations(df: DataFrame, score: str, cols: Sequence[str]) -> DataFrame:
    """(feature, correlation) of the score with each column; undefined ones are left out."""
    wide = df.select(F.col(score).cast("double").alias("_score"), *[F.col(c).cast("double").alias(c) for c in cols])
    long = melt(wide, ["_score"], cols, "feature", "value")
    both = long.where(F.col("_score").isNotNull() & F.col("value").isNotNull())
    spread = F.stddev_pop("_score") * F.stddev_pop("value")
    pairs = both.groupBy("feature").agg(F.try_divide(F.covar_pop("_score", "value"), spread).alias("correlation"))
    return pairs.where(F.col("correlation").isNotNull())


def mean_by_epoch(metrics: DataFrame, epoch: str, cols: Sequence[str]) -> DataFrame:
    """Mean of batch metrics per epoch."""
    return metrics.groupBy(epoch).agg(*[F.avg(c).alias(c) for c in cols])


def evaluate_scores(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row with the areas, the best threshold, the confusion metrics at it and the Brier score.

    The scored rows are read once, summed per distinct score, and everything
    else is derived from these stored sums and the one curve over them.
    """
    sums = written(score_sums(df, label, score))
    curve = written(curve_of_sums(sums))
    best = F.lit(best_threshold(df, label, score, curve=curve).first()["threshold"]).cast("double")
    called = F.col("score") >= best
    parts = {"tn": (~called, "sure_neg"), "tp": (called, "pos"), "fn": (~called, "pos"), "fp": (called, "sure_neg")}
    counts = sums.agg(
        *[F.coalesce(F.sum(F.when(side, F.col(n))), F.lit(0)).alias(k) for k, (side, n) in parts.items()],
        F.try_divide(F.sum("squares"), F.sum("known")).alias("brier"),
    )
    areas = curve_areas(df, label, score, curve=curve).withColumn("_row", F.lit(1))
    whole = with_metrics(counts).withColumns({"threshold": best, "_row": F.lit(1)})
    return whole.join(areas, "_row").drop("_row")
