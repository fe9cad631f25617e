"""Curves, thresholds, confusion metrics, calibration and subgroup scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daypanel.functions.columns import yes
from daypanel.operators import evaluation as V
from daypanel.plans.registry import query, rounded
from daypanel.plans.standins import CURVE, SCORED, scored

LANGS = ["en", "fr", "de", "es", "it"]


@query("roc_points", f"WITH {CURVE} SELECT round(threshold, 6) + 0.0 AS threshold, round(fp / q, 6) + 0.0 AS fpr, round(tp / p, 6) + 0.0 AS tpr FROM curve")
def roc_points(spark: SparkSession, where: str) -> DataFrame:
    return rounded(V.roc_points(scored(spark, where), "label", "score"))


@query(
    "pr_points",
    f"WITH {CURVE} SELECT round(threshold, 6) + 0.0 AS threshold, round(tp / (tp + fp), 6) + 0.0 AS precision, round(tp / p, 6) + 0.0 AS recall FROM curve",
)
def pr_points(spark: SparkSession, where: str) -> DataFrame:
    return rounded(V.pr_points(scored(spark, where), "label", "score"))


_STEPS = f"""{CURVE}, steps AS (SELECT *, fp / q AS x, tp / p AS y, tp / (tp + fp) AS prec,
  coalesce(lag(fp / q) OVER (ORDER BY threshold DESC), 0) AS x0, coalesce(lag(tp / p) OVER (ORDER BY threshold DESC), 0) AS y0,
  coalesce(lag(tp / (tp + fp)) OVER (ORDER BY threshold DESC), tp / (tp + fp)) AS prec0 FROM curve)"""


@query("roc_auc", f"WITH {_STEPS} SELECT round(sum((x - x0) * (y + y0) / 2), 6) + 0.0 AS roc_auc FROM steps")
def roc_auc(spark: SparkSession, where: str) -> DataFrame:
    return rounded(V.curve_areas(scored(spark, where), "label", "score").select("roc_auc"))


@query(
    "average_precision",
    f"""WITH {_STEPS} SELECT round(sum((y - y0) * prec), 6) + 0.0 AS average_precision,
    round(sum((y - y0) * (prec + prec0) / 2), 6) + 0.0 AS pr_auc FROM steps""",
)
def average_precision(spark: SparkSession, where: str) -> DataFrame:
    return rounded(V.curve_areas(scored(spark, where), "label", "score").select("average_precision", "pr_auc"))


@query(
    "gmean_threshold",
    f"""WITH {CURVE}, corners AS (SELECT *, lead(pos) OVER w AS np, lead(neg) OVER w AS nn, row_number() OVER w AS rn FROM curve
      WINDOW w AS (ORDER BY threshold DESC)),
    kept AS (SELECT threshold, tp / p AS tpr, fp / q AS fpr FROM corners WHERE rn = 1 OR np IS NULL OR np <> pos OR nn <> neg),
    g AS (SELECT *, sqrt(tpr * (1 - fpr)) AS gmean FROM kept)
    SELECT round(threshold, 8) + 0.0 AS threshold, round(gmean, 6) + 0.0 AS gmean, round(tpr, 6) + 0.0 AS tpr, round(fpr, 6) + 0.0 AS fpr
    FROM g ORDER BY round(gmean, 12) DESC, threshold DESC LIMIT 1""",
)
def gmean_threshold(spark: SparkSession, where: str) -> DataFrame:
    return rounded(V.best_threshold(scored(spark, where), "label", "score"), skip=("threshold",))


_METRICS = """tn, tp, fn, fp, round((tn + tp) / (tn + tp + fn + fp), 6) + 0.0 AS accuracy,
  round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) + 0.0 AS precision,
  round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) + 0.0 AS recall,
  round(CASE WHEN tp > 0 THEN 2.0 * tp / (2.0 * tp + fn + fp) ELSE 0 END, 6) + 0.0 AS f1,
  round(CASE WHEN tp > 0 THEN 5.0 * tp / (5.0 * tp + 4.0 * fn + fp) ELSE 0 END, 6) + 0.0 AS f2"""


def _counts_sql(called: str) -> str:
    return f"""cells AS (SELECT count(*) FILTER (WHERE NOT ({called}) AND label = 0) AS tn, count(*) FILTER (WHERE ({called}) AND label = 1) AS tp,
      count(*) FILTER (WHERE NOT ({called}) AND label = 1) AS fn, count(*) FILTER (WHERE ({called}) AND label = 0) AS fp FROM scored)"""


@query("confusion_metrics", f"WITH {SCORED}, {_counts_sql('score >= 0.2')} SELECT {_METRICS} FROM cells")
def confusion_metrics(spark: SparkSession, where: str) -> DataFrame:
    return rounded(V.with_metrics(V.confusion(scored(spark, where), "label", "score", 0.2)))


@query("fixed_threshold_confusion", f"WITH {SCORED}, {_counts_sql('score > 0.05')} SELECT {_METRICS} FROM cells")
def fixed_threshold_confusion(spark: SparkSession, where: str) -> DataFrame:
    return rounded(V.with_metrics(V.confusion(scored(spark, where), "label", "score", 0.05, inclusive=False)))


@query(
    "quantile_confusion",
    f"""WITH {SCORED}, {_counts_sql("score > (SELECT quantile_cont(score, 0.9) FROM scored)")}
    SELECT {_METRICS}, (SELECT round(quantile_cont(score, 0.9), 6) + 0.0 FROM scored) AS threshold FROM cells""",
)
def quantile_confusion(spark: SparkSession, where: str) -> DataFrame:
    df = scored(spark, where)
    cells = V.confusion_at(df, "label", "score", V.quantile_threshold(df, "score", 0.9), inclusive=False)
    return rounded(V.with_metrics(cells))


@query(
    "top_share_confusion",
    f"""WITH {SCORED}, ranked AS (SELECT score, row_number() OVER (ORDER BY score DESC) - 1 AS place, count(*) OVER () AS n FROM scored),
    cut AS (SELECT score AS c FROM ranked WHERE place = round_even(n * 0.1, 0)), {_counts_sql("score >= (SELECT c FROM cut)")}
    SELECT {_METRICS}, (SELECT round(c, 6) + 0.0 FROM cut) AS threshold FROM cells""",
)
def top_share_confusion(spark: SparkSession, where: str) -> DataFrame:
    df = scored(spark, where)
    cells = V.confusion_at(df, "label", "score", V.top_share_threshold(df, "score", 0.1))
    return rounded(V.with_metrics(cells))


@query(
    "class_report",
    f"""WITH {SCORED}, {_counts_sql("score >= 0.3")}, sides AS (
      SELECT CAST(1 AS INTEGER) AS class, tp, fp, fn FROM cells UNION ALL SELECT CAST(0 AS INTEGER), tn, fn, fp FROM cells)
    SELECT class, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) + 0.0 AS precision,
    round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) + 0.0 AS recall,
    round(CASE WHEN tp > 0 THEN 2.0 * tp / (2.0 * tp + fn + fp) ELSE 0 END, 6) + 0.0 AS f1, tp + fn AS support FROM sides""",
)
def class_report(spark: SparkSession, where: str) -> DataFrame:
    return rounded(V.class_report(scored(spark, where), "label", "score", 0.3))


@query("brier_overall", f"WITH {SCORED} SELECT round(avg((label - score) * (label - score)), 6) + 0.0 AS brier FROM scored")
def brier_overall(spark: SparkSession, where: str) -> DataFrame:
    return rounded(V.brier(scored(spark, where), "label", "score"))


@query(
    "brier_subgroup",
    f"""WITH {SCORED}, sq AS (SELECT lang, toxic, (label - score) * (label - score) AS s FROM scored),
    parts AS (SELECT 'STATIC_lang_' || lang AS "group", count(*) AS n, avg(s) AS b FROM sq GROUP BY 1
      UNION ALL SELECT 'STATIC_toxic', count(*), avg(s) FROM sq WHERE toxic = 1 HAVING count(*) > 0 UNION ALL SELECT 'all', count(*), avg(s) FROM sq)
    SELECT "group", n, round(b, 6) + 0.0 AS brier, round(b / (SELECT avg(s) FROM sq), 6) + 0.0 AS normalized FROM parts""",
)
def brier_subgroup(spark: SparkSession, where: str) -> DataFrame:
    groups = {f"STATIC_lang_{v}": yes(F.col("lang") == v) for v in LANGS}
    groups["STATIC_toxic"] = F.col("toxic")
    return rounded(V.brier_by_group(scored(spark, where), "label", "score", groups))


@query(
    "calibration",
    f"WITH {SCORED} SELECT round(score, 3) + 0.0 AS score_bin, round(avg(label - score), 6) + 0.0 AS mean_difference FROM scored GROUP BY 1",
)
def calibration(spark: SparkSession, where: str) -> DataFrame:
    return rounded(V.calibration(scored(spark, where), "label", "score"))


@query(
    "percent_rank_by_label",
    f"""WITH {SCORED}, ranks AS (SELECT label, score, round(percent_rank() OVER (PARTITION BY label ORDER BY score), 2) + 0.0 AS percentile FROM scored)
    SELECT label, percentile, round(avg(score), 6) + 0.0 AS mean_score FROM ranks GROUP BY 1, 2""",
)
def percent_rank_by_label(spark: SparkSession, where: str) -> DataFrame:
    return rounded(V.percent_rank_by_label(scored(spark, where), "label", "score"))


@query(
    "score_quantiles",
    f"""WITH {SCORED} SELECT label, CAST(q AS DOUBLE) AS q, round(CASE q {" ".join(
        f"WHEN {q} THEN quantile_disc(score, {q})" for q in (0.33, 0.66, 0.75, 0.99))} END, 6) + 0.0 AS value
    FROM scored, (VALUES (0.33), (0.66), (0.75), (0.99)) t(q) GROUP BY label, q""",
)
def score_quantiles(spark: SparkSession, where: str) -> DataFrame:
    return rounded(V.score_quantiles(scored(spark, where), "label", "score"))


@query(
    "score_histogram",
    f"WITH {SCORED} SELECT label, round(score, 1) + 0.0 AS score_bin, count(*) AS n FROM scored GROUP BY 1, 2",
)
def score_histogram(spark: SparkSession, where: str) -> DataFrame:
    return rounded(V.score_histogram(scored(spark, where), "label", "score"))


@query(
    "score_histogram_100",
    f"WITH {SCORED} SELECT CAST(least(floor(score * 100), 99) AS INTEGER) AS bin, count(*) AS n FROM scored GROUP BY 1",
)
def score_histogram_100(spark: SparkSession, where: str) -> DataFrame:
    return V.fixed_width_histogram(scored(spark, where), "score", 100)


@query(
    "score_correlations",
    f"""WITH {SCORED}, pos AS (SELECT *, CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS english, 1 AS constant FROM scored WHERE label = 1),
    c AS (SELECT unnest(['n_chars', 'toxic', 'english']) AS feature,
      unnest([corr(score, n_chars), corr(score, toxic), corr(score, english)]) AS v FROM pos)
    SELECT feature, round(v, 6) + 0.0 AS correlation FROM c WHERE v IS NOT NULL AND NOT isnan(v)""",
)
def score_correlations(spark: SparkSession, where: str) -> DataFrame:
    positives = scored(spark, where).where("label = 1").withColumns(
        {"english": yes(F.col("lang") == "en"), "constant": F.lit(1)}
    )
    return rounded(V.score_correlations(positives, "score", ["n_chars", "toxic", "english", "constant"]))


@query(
    "mean_by_epoch",
    f"""WITH {SCORED} SELECT CAST(doc_id % 5 AS INTEGER) AS epoch, round(avg(score), 6) + 0.0 AS score, round(avg(label), 6) + 0.0 AS label
    FROM scored GROUP BY 1""",
)
def mean_by_epoch(spark: SparkSession, where: str) -> DataFrame:
    batches = scored(spark, where).select((F.col("doc_id") % 5).cast("int").alias("epoch"), "score", "label")
    return rounded(V.mean_by_epoch(batches, "epoch", ["score", "label"]))


_BEST = """corners AS (SELECT *, lead(pos) OVER w AS np, lead(neg) OVER w AS nn, row_number() OVER w AS rn FROM curve
    WINDOW w AS (ORDER BY threshold DESC)),
  best AS (SELECT round(threshold, 8) AS c FROM corners WHERE rn = 1 OR np IS NULL OR np <> pos OR nn <> neg
    ORDER BY round(sqrt(tp / p * (1 - fp / q)), 12) DESC, threshold DESC LIMIT 1)"""


@query(
    "evaluation_summary",
    f"""WITH {_STEPS}, {_BEST}, {_counts_sql("score >= (SELECT c FROM best)")}
    SELECT {_METRICS}, (SELECT round(c, 6) + 0.0 FROM best) AS threshold,
    (SELECT round(sum((x - x0) * (y + y0) / 2), 6) + 0.0 FROM steps) AS roc_auc,
    (SELECT round(sum((y - y0) * prec), 6) + 0.0 FROM steps) AS average_precision,
    (SELECT round(sum((y - y0) * (prec + prec0) / 2), 6) + 0.0 FROM steps) AS pr_auc,
    (SELECT round(avg((label - score) * (label - score)), 6) + 0.0 FROM scored) AS brier FROM cells""",
)
def evaluation_summary(spark: SparkSession, where: str) -> DataFrame:
    return rounded(V.evaluate_scores(scored(spark, where), "label", "score"))
