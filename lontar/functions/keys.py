"""Column-to-column helpers for keys and hashes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: White space as Python's str.strip sees it.
BLANK = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def key(column: Column | str) -> Column:
    """A key trimmed and in lower case; null where nothing is left."""
    c = F.col(column) if isinstance(column, str) else column
    trimmed = F.lower(F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", ""))
    return F.when(trimmed != "", trimmed)
