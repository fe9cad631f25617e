"""Feature selection: constant and null columns, ANOVA, correlated pairs.

Statistics are taken on (feature, value) rows: the wide row is unpivoted in
place and summed up before the exchange, so the plan does not grow with the
number of features and only one row per feature, group and task is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daypanel.functions.tails import f_tail
from daypanel.operators.correlation import correlation_long
from daypanel.operators.panel import melt


def _as_long(df: DataFrame, ids: Sequence[str], cols: Sequence[str]) -> DataFrame:
    doubles = df.select(*ids, *[F.col(f"`{c}`").cast("double").alias(c) for c in cols])
    return melt(doubles, ids, [f"`{c}`" for c in cols], "feature", "value")


def null_report(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column_name, percent_null, number_null), any column types, in one pass."""
    cols = list(cols or df.columns)
    flags = F.array(*[F.struct(F.lit(c).alias("column_name"), F.isnull(f"`{c}`").alias("missing")) for c in cols])
    long = df.select(F.explode(flags).alias("f")).select("f.*")
    return long.groupBy("column_name").agg(
        (F.count_if("missing") / F.count("*")).alias("percent_null"),
        F.count_if("missing").alias("number_null"),
    )


def column_spread(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, variance, number_null) for numeric columns; sample variance."""
    return _as_long(df, [], cols).groupBy("feature").agg(
        F.var_samp("value").alias("variance"),
        F.count_if(F.isnull("value")).alias("number_null"),
    )


def unusable_columns(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """Names of the columns with zero variance or with any null."""
    bad = column_spread(df, cols).where((F.col("variance") == 0) | (F.col("number_null") > 0))
    found = {row["feature"] for row in bad.select("feature").collect()}
    return [c for c in cols if c in found]


def drop_constant_or_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.drop(*unusable_columns(df, cols))


def anova(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    """One-way ANOVA of each column over the groups of `target`.

    Per feature one row with both sums of squares, degrees of freedom, F and p.
    """
    groups = (
        _as_long(df, [target], cols)
        .where(F.col("value").isNotNull())
        .groupBy("feature", target)
        .agg(
            F.count("*").cast("double").alias("n"),
            F.avg("value").alias("m"),
            F.coalesce(F.var_samp("value"), F.lit(0.0)).alias("v"),
        )
    )
    # One row per feature and target value from here on.
    grand = F.sum(F.col("n") * F.col("m")).over(Window.partitionBy("feature")) / F.sum("n").over(
        Window.partitionBy("feature")
    )
    around = F.col("m") - F.col("grand")
    sums = groups.withColumn("grand", grand).groupBy("feature").agg(
        F.sum(F.col("n") * around * around).alias("ss_target"),
        F.sum((F.col("n") - 1) * F.col("v")).alias("ss_residual"),
        (F.count("*") - 1).cast("double").alias("df_target"),
        (F.sum("n") - F.count("*")).alias("df_residual"),
    )
    f_value = F.try_divide(
        F.try_divide("ss_target", "df_target"), F.try_divide("ss_residual", "df_residual")
    )
    tested = sums.withColumn("F", f_value)
    return tested.withColumn(
        "p_value",
        F.when(F.col("F").isNotNull(), f_tail("F", "df_target", "df_residual")),
    )


def anova_table(tests: DataFrame) -> DataFrame:
    """(feature, level, sum_sq, df, F, p_value) with a `target` and a `Residual` row each."""
    rows = F.array(
        F.struct(
            F.lit("target").alias("level"),
            F.col("ss_target").alias("sum_sq"),
            F.col("df_target").alias("df"),
            F.col("F").alias("F"),
            F.col("p_value").alias("p_value"),
        ),
        F.struct(
            F.lit("Residual").alias("level"),
            F.col("ss_residual").alias("sum_sq"),
            F.col("df_residual").alias("df"),
            F.lit(None).cast("double").alias("F"),
            F.lit(None).cast("double").alias("p_value"),
        ),
    )
    return tests.select("feature", F.explode(rows).alias("r")).select("feature", "r.*")


def passing(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Features with p <= alpha; a missing p does not pass."""
    return tests.where(F.col("p_value") <= alpha)


def rank_pairs(pairs: DataFrame) -> DataFrame:
    """Add `rank`: per column, its partners from weakest to strongest correlation."""
    order = Window.partitionBy("index").orderBy(F.abs("value").asc_nulls_last(), "variable")
    return pairs.withColumn("rank", F.row_number().over(order))


def correlated_losers(
    pairs: DataFrame, tests: DataFrame, cutoff: float = 0.8, absolute: bool = False, break_ties: bool = False
) -> DataFrame:
    """Features (column `index`) with a highly correlated partner of smaller p.

    The cutoff is on the signed value unless `absolute`. With equal p both stay,
    unless `break_ties` compares F.
    """
    strength = F.abs("value") if absolute else F.col("value")
    marked = pairs.where(strength >= cutoff)
    p = tests.select("feature", "p_value", "F")
    mine = p.toDF("index", "p_index", "f_index")
    theirs = p.toDF("variable", "p_variable", "f_variable")
    both = marked.join(mine, "index", "left").join(theirs, "variable", "left")
    worse = (F.col("p_index") > F.col("p_variable")) | F.col("p_index").isNull()
    if break_ties:
        weaker = F.col("f_index") < F.col("f_variable")
        worse = worse | ((F.col("p_index") == F.col("p_variable")) & weaker)
    return both.where(worse).select("index").distinct()


def select_features(
    df: DataFrame,
    cols: Sequence[str],
    target: str,
    alpha: float = 0.05,
    cutoff: float = 0.8,
    absolute: bool = False,
    break_ties: bool = False,
) -> tuple[list[str], DataFrame]:
    """Names of the selected features and the ANOVA table they were chosen by.

    Only names and one row of statistics per feature reach the driver.
    """
    dropped = set(unusable_columns(df, cols))
    usable = [c for c in cols if c not in dropped]
    results = anova(df, usable, target).collect()
    tests = df.sparkSession.createDataFrame(
        results,
        "feature string, ss_target double, ss_residual double, df_target double, df_residual double, F double, p_value double",
    )
    good = {r["feature"] for r in results if r["p_value"] is not None and r["p_value"] <= alpha}
    strong = [c for c in usable if c in good]
    if len(strong) < 2:
        return strong, tests
    losers = correlated_losers(correlation_long(df, strong), tests, cutoff, absolute, break_ties)
    gone = {r["index"] for r in losers.collect()}
    return [c for c in strong if c not in gone], tests


def assemble_final(static: DataFrame, features: DataFrame, id: str, selected: Sequence[str]) -> DataFrame:
    """Static columns with the selected features, one row per entity."""
    return static.join(features.select(id, *[f"`{c}`" for c in selected]), id, "left")
