"""Fixed-vocabulary one-hot encoding and the model input table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daypanel.functions.columns import snake_label


def one_hot_names(vocabulary: Mapping[str, Sequence[str]]) -> list[str]:
    """Output columns in order: the vocabulary's order is part of the contract."""
    names = [f"{col}_{snake_label(str(v))}" for col, values in vocabulary.items() for v in values]
    clash = sorted({n for n in names if names.count(n) > 1})
    if clash:
        raise ValueError(f"one-hot names collide: {clash}")
    return names


def one_hot(
    df: DataFrame, vocabulary: Mapping[str, Sequence[str]], unknown: str = "error", keep_source: bool = False
) -> DataFrame:
    """0/1 columns for each listed value, in the order given.

    A value outside the vocabulary (or null) fails the job with
    `unknown="error"` and gives zeros with `"ignore"`.
    """
    if unknown not in ("error", "ignore"):
        raise ValueError("unknown is 'error' or 'ignore'")
    names = iter(one_hot_names(vocabulary))
    flags = []
    for col, values in vocabulary.items():
        text = F.col(col).cast("string")
        if unknown == "error":
            listed = F.coalesce(text.isin([str(v) for v in values]), F.lit(False))
            message = F.concat(F.lit(f"value of {col} is not in the vocabulary: "), F.coalesce(text, F.lit("null")))
            text = F.when(listed, text).otherwise(F.raise_error(message).cast("string"))
        for v in values:
            flags.append(F.coalesce(text == F.lit(str(v)), F.lit(False)).cast("double").alias(next(names)))
    rest = [c for c in df.columns if keep_source or c not in vocabulary]
    return df.select(*rest, *flags)


def encode_table(
    df: DataFrame,
    id: str,
    target: str,
    vocabulary: Mapping[str, Sequence[str]],
    drop: Sequence[str] = (),
    unknown: str = "error",
    label: str = "labels",
) -> DataFrame:
    """Model input: complete rows, numbers as doubles, one-hot columns, label last."""
    rest = [c for c in df.columns if c not in (id, target, *drop, *vocabulary)]
    complete = df.drop(*drop).na.drop()
    numeric = complete.select(
        id,
        *[F.col(f"`{c}`").cast("double").alias(c) for c in rest],
        *vocabulary,
        F.col(target).cast("double").alias(label),
    )
    encoded = one_hot(numeric, vocabulary, unknown)
    ordered = [c for c in encoded.columns if c != label]
    return encoded.select(*ordered, label)


def feature_names(df: DataFrame, without: Sequence[str]) -> list[str]:
    return [c for c in df.columns if c not in without]


def assemble(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=out).transform(df)
