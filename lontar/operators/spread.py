"""Joins with a table of unique keys where a few keys hold most rows of the other side."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def spread_join(rows: DataFrame, keyed: DataFrame, on: str, weight: str, fraction: float = 0.0005, total: int | None = None) -> DataFrame:
    """Inner join of `rows` with `keyed`, which has one row per `on`; `weight` is a column of `keyed`
    that says how many rows of the other side have the key.

    Keys that hold more than `fraction` of all rows are broadcast, so that their rows stay where they
    are: no more than 1 / `fraction` keys can. All others are shuffled; no task gets more than that
    fraction of the rows by one key. Null keys join nothing; empty sides give no rows. Name the
    columns of both sides apart, but for `on`. `total` is the sum of the weights where it is known.
    """
    if total is None:
        total = keyed.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    least = F.lit(fraction * total)
    heavy = F.broadcast(keyed.where(F.col(weight) > least))
    apart = rows.join(heavy.select(on), on, "left_anti")
    return rows.join(heavy, on).unionByName(apart.join(keyed.where(F.col(weight) <= least), on))


def salted_join(left: DataFrame, rows: DataFrame, on: list[str], salt: str, fraction: float = 0.0005) -> DataFrame:
    """Inner join of `left` with `rows`, of which a few keys may hold most, each `left` row with all
    rows of its key.

    Keys that hold more than `fraction` of `rows` - no more than 1 / `fraction` of them, so that they
    may be broadcast - are cut into pieces of at most about that many rows by the hash of `salt`;
    `left` rows of such a key are repeated for each piece. Null keys join nothing. Name the columns
    of both sides apart, but for `on`.
    """
    sizes = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("__n"))
    total = rows.count()
    most = max(1.0, fraction * total)
    heavy = F.broadcast(sizes.where(F.col("__n") > most).select(*on, F.ceil(F.col("__n") / most).cast("int").alias("__pieces")))
    pieces = F.coalesce("__pieces", F.lit(1))
    a = left.join(heavy, on, "left").withColumn("__piece", F.explode(F.sequence(F.lit(0), pieces - 1))).drop("__pieces")
    b = rows.join(heavy, on, "left").withColumn("__piece", F.pmod(F.xxhash64(salt), pieces).cast("int")).drop("__pieces")
    return a.join(b, [*on, "__piece"]).drop("__piece")
