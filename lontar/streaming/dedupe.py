"""Exact duplicates over a stream: the first row of a key within the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame


def first_of_key(events: DataFrame, keys: list[str], time: str, late: str = "1 day") -> DataFrame:
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
