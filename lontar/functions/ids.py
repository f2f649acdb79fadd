"""Deterministic ids and ranks from SHA-256; the parts are joined by the unit separator."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SEPARATOR = "\x1f"


def _joined(*parts: Column | str) -> Column:
    filled = [F.coalesce(p, F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.concat_ws(SEPARATOR, *filled)


def stable_id(prefix: str, *keys: Column) -> Column:
    """`prefix_` and 16 hex digits; the parts are keys already."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(_joined(*keys), 256), 1, 16))


def rank(*parts: Column | str) -> Column:
    """A hash to order by, the same on every run and partitioning."""
    return F.sha2(_joined(*parts), 256)


def priority(seed: str, *parts: Column | str) -> Column:
    """The first 64 bits of the hash of `seed:part:...`, as hex: ordered like the number."""
    filled = [F.lit(seed), *[F.coalesce(p, F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts]]
    return F.substring(F.sha2(F.concat_ws(":", *filled), 256), 1, 16)
