"""Scored answers, condition summaries and paired comparison."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from lontar.functions import text, tokens


_NUMBERS = ("precision", "recall", "f1", "marker_recall", "grounded", "repeated")
_METRICS = T.StructType([*[T.StructField(n, T.DoubleType()) for n in _NUMBERS], T.StructField("abstains", T.BooleanType())])


@F.pandas_udf(_METRICS)
def _measured(answer: pd.Series, reference: pd.Series, context: pd.Series, grounded: pd.Series) -> pd.DataFrame:
    rows = [tokens.answer_metrics(text.key_text(a), text.key_text(r), text.key_text(c) if g else None) for a, r, c, g in zip(answer, reference, context, grounded)]
    return pd.DataFrame(rows, columns=[*_NUMBERS, "abstains"]).astype({n: "float64" for n in _NUMBERS} | {"abstains": "bool"})


def scored(rows: DataFrame, answer: str, reference: str, context: str | None = None) -> DataFrame:
    """Add a struct of metrics of `answer` against `reference` (and `context`), in one pass.

    A null answer scores zeros; metrics without a meaning are null. The JVM has no counting of words
    in linear time and no compatibility form, so the texts go to Python once.
    """
    given = F.col(context) if context else F.lit(None).cast("string")
    m = _measured(answer, reference, given, F.lit(bool(context)))
    cites = tokens.cites(text.plain(answer), "c").alias("cites")
    whole = rows.withColumn("__m", m)
    return whole.withColumn("metrics", F.struct("__m.*", cites)).drop("__m")


def guarded(metrics: Column, error: Column) -> Column:
    """A failed case keeps its row, with null metrics."""
    return F.when(error.isNull() | (error == ""), metrics)


def summary(rows: DataFrame, label: str) -> DataFrame:
    """Means over the answered cases of each condition; rates are null on an empty denominator."""
    return rows.groupBy(label).agg(
        F.count(F.lit(1)).alias("cases"),
        F.count_if(F.col("metrics").isNull()).alias("errors"),
        F.avg("metrics.f1").alias("mean_f1"),
        F.median("metrics.f1").alias("median_f1"),
        F.avg("metrics.marker_recall").alias("mean_marker_recall"),
        F.avg("metrics.repeated").alias("mean_repeated"),
        F.count_if(F.col("metrics.repeated") >= 0.2).alias("repetitive"),
        F.try_divide(F.count_if(F.col("metrics.abstains")), F.count("metrics.abstains")).alias("abstention_rate"),
    )


def paired(first: DataFrame, second: DataFrame, key: str, score: str, epsilon: float = 1e-9) -> DataFrame:
    """(pairs, wins, losses, ties, win_rate, mean_delta, median_delta) of `second` over `first`."""
    joined = first.select(key, F.col(score).alias("a")).join(second.select(key, F.col(score).alias("b")), key).where("a is not null and b is not null")
    d = F.col("b") - F.col("a")
    return joined.agg(
        F.count(F.lit(1)).alias("pairs"),
        F.count_if(d > epsilon).alias("wins"),
        F.count_if(d < -epsilon).alias("losses"),
        F.count_if(F.abs(d) <= epsilon).alias("ties"),
        F.try_divide(F.count_if(d > epsilon), F.count(F.lit(1))).alias("win_rate"),
        F.avg(d).alias("mean_delta"),
        F.median(d).alias("median_delta"),
    )


def extremes(first: DataFrame, second: DataFrame, key: str, score: str, n: int = 5) -> DataFrame:
    """(side, place, key, delta): the `n` best and the `n` worst cases by `second` over `first`; ties go
    to the smaller key."""
    joined = first.select(key, F.col(score).alias("a")).join(second.select(key, F.col(score).alias("b")), key).where("a is not null and b is not null")
    deltas = joined.select(key, (F.col("b") - F.col("a")).alias("delta"))
    parts = []
    for side, order in (("best", F.desc(F.round("delta", 9))), ("worst", F.round("delta", 9))):
        few = deltas.orderBy(order, key).limit(n)
        parts.append(few.select(F.lit(side).alias("side"), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(order, key)).alias("place"), key, "delta"))
    return parts[0].unionByName(parts[1])


def wide(cases: DataFrame, by_label: dict[str, DataFrame], key: str) -> DataFrame:
    """One row per case with each condition's columns behind its label."""
    out = cases
    for label, rows in by_label.items():
        out = out.join(rows.select(key, *[F.col(c).alias(f"{label}_{c}") for c in rows.columns if c != key]), key, "left")
    return out
