"""Problem 1: results per key where a few keys hold most rows.

Value-frequency compression: rows are first grouped by key *and* value, which spreads a heavy key
over its values and combines on the map side; everything per key is then derived exactly from the
weighted values.

Nulls: a null key is a group of its own (it counts towards the total of the table and is never
reported as a key); a null value counts as a row, but not as a distinct value, mode or percentile.
Keys are compared as given; normalise them before. Ties for the mode go to the smallest value.
An empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lontar.operators.ordered import running_sum


def value_frequencies(df: DataFrame, key: Column, value: Column) -> DataFrame:
    """(key, value, n): the compressed form of the table."""
    return df.select(key.alias("key"), value.alias("value")).groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"))


def key_totals(frequencies: DataFrame) -> DataFrame:
    """(key, rows, distinct_values, mode, mode_rows) per key, exactly."""
    known = F.col("value").isNotNull()
    best = F.min(F.when(known, F.struct((-F.col("n")).alias("n"), F.col("value").alias("v"))))
    return (
        frequencies.groupBy("key")
        .agg(F.sum("n").alias("rows"), F.count("value").alias("distinct_values"), best.alias("best"))
        .select("key", "rows", "distinct_values", F.col("best.v").alias("mode"), (-F.col("best.n")).alias("mode_rows"))
    )


def heavy_keys(frequencies: DataFrame, share: float) -> DataFrame:
    """Keys that hold more than `share` of all rows."""
    totals = frequencies.groupBy("key").agg(F.sum("n").alias("rows"))
    everything = totals.agg(F.sum("rows")).scalar()
    return totals.where(F.col("key").isNotNull() & (F.col("rows") > F.lit(share) * everything))


def key_percentiles(frequencies: DataFrame, fractions: dict[str, float]) -> DataFrame:
    """(key, one column per fraction): the smallest value that at least that share of the key's
    non-null values don't exceed. A heavy key with many values spans many partitions."""
    known = frequencies.where(F.col("value").isNotNull())
    cumulated = running_sum(known, ["key"], ["value"], F.col("n"), "upto")
    wanted = {
        name: F.min(F.when(F.col("upto") >= F.ceil(F.lit(f) * F.col("upto_total")), F.col("value"))).alias(name)
        for name, f in fractions.items()
    }
    return cumulated.groupBy("key").agg(*wanted.values())
