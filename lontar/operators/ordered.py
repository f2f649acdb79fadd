"""Ordered sums and ranks without one task per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lontar.runtime import materialize


def running_sum(df: DataFrame, keys: list[str], order: list[str], weight: Column, name: str) -> DataFrame:
    """Add the inclusive running sum of `weight` in `order` within `keys`, and the key's total.

    The rows are range-partitioned by (keys, order), so a key that outweighs all others spans many
    partitions. Each partition sums its own part; the parts of a key (one row per partition and
    key) give the offsets. The work of a task never depends on the size of a key.
    `keys` may be empty. Null keys are a key of their own. Ties in `order` share no sum: give a
    unique order. The columns `name` and `{name}_total` are added; an empty table stays empty.
    """
    part, own = "__part", "__weight"
    ranged = df.withColumn(own, weight).repartitionByRange(*keys, *order).withColumn(part, F.spark_partition_id())
    ranged, _ = materialize(ranged)
    parts = ranged.groupBy(*keys, part).agg(F.sum(own).alias("__sum"))
    by_key = Window.partitionBy(*keys)
    parts = (
        parts.withColumn("__before", F.sum("__sum").over(by_key.orderBy(part)) - F.col("__sum"))
        .withColumn(f"{name}_total", F.sum("__sum").over(by_key))
        .drop("__sum")
    )
    a, b = ranged.alias("a"), parts.alias("b")
    match = F.col(f"a.{part}") == F.col(f"b.{part}")
    for k in keys:
        match &= F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    joined = a.join(b, match).select("a.*", "b.__before", f"b.{name}_total")
    inside = Window.partitionBy(part, *keys).orderBy(*order)
    return joined.withColumn(name, F.col("__before") + F.sum(own).over(inside)).drop(part, own, "__before")
