"""Problem 2: duplicates hidden by formatting differences.

Byte-identical raw rows are collapsed first, with counts; only the distinct survivors are
canonicalised; then the full canonical text is grouped again and the counts are summed.

Canonical form of a field: invisible and look-alike characters made consistent, case folded, and
only letters, digits and combining marks kept, in their order. A missing field equals an empty
one; an entry whose three fields are all empty is a copy of any other such entry. JSON entries are
parsed, so key order, spacing and escapes don't matter; a payload that isn't JSON counts as three
missing fields. Ids needn't be unique across repeated rows; the smallest id is kept. Fields of any
length are compared whole. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lontar.llm.lookalikes import plain_rewriter
from lontar.operators.spread import spread_join
from lontar.runtime import materialize

FIELDS = ("istilah", "pengertian", "undang_undang")
CANONICAL = [f"canonical_{f}" for f in FIELDS]
_DROP = re.compile("[^\\w\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff]|_")


def canonical(text: str | None) -> str:
    """Letters and digits of a text, comparable."""
    if not text:
        return ""
    rewrite = plain_rewriter()
    # letters are made consistent before and after folding: the pairs differ by case
    folded = rewrite(rewrite(text).casefold())
    return _DROP.sub("", unicodedata.normalize("NFC", folded))


@F.pandas_udf(T.StringType())
def _canonical(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(lambda x: canonical(x) if isinstance(x, str) else "")


def from_table(df: DataFrame, entry: str = "entry_id") -> DataFrame:
    return df.select(F.col(entry).alias("entry_id"), *FIELDS)


def from_json(df: DataFrame, entry: str = "entry_id", payload: str = "payload") -> DataFrame:
    parsed = F.from_json(payload, ", ".join(f"{f} string" for f in FIELDS))
    return df.select(F.col(entry).alias("entry_id"), parsed.alias("p")).select("entry_id", *[f"p.{f}" for f in FIELDS])


def survivors(entries: DataFrame) -> DataFrame:
    """Distinct raw rows with their smallest id, how often each occurs, and their canonical fields."""
    raw = entries.groupBy(*FIELDS).agg(F.min("entry_id").alias("first_id"), F.count(F.lit(1)).alias("rows"))
    return raw.select("*", *[_canonical(f).alias(f"canonical_{f}") for f in FIELDS])


def records(distinct: DataFrame) -> DataFrame:
    """One row per record: (canonical fields, keep_id, copies)."""
    return distinct.groupBy(*CANONICAL).agg(F.min("first_id").alias("keep_id"), F.sum("rows").alias("copies"))


def _digest(columns: list[str]) -> Column:
    """SHA-256 over whole texts; nulls are told from empty ones, and lengths keep fields apart."""
    return F.unhex(F.sha2(F.concat_ws("|", *[F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-")) for c in columns]), 256))


def copies(entries: DataFrame) -> DataFrame:
    """(entry_id, keep_id) of every entry that is a copy of one with a smaller id.

    Only records with several copies have members; these find their record by the digest of their
    raw row. Raw rows delivered very often don't gather in one task.
    """
    distinct = survivors(entries).select(*CANONICAL, "first_id", "rows", _digest(list(FIELDS)).alias("raw"))
    distinct, _ = materialize(distinct)
    several = records(distinct).where("copies > 1").select(_digest(CANONICAL).alias("form"), "keep_id")
    raw = distinct.select(_digest(CANONICAL).alias("form"), "raw", "rows")
    kept, _ = materialize(raw.join(several, "form").select("raw", "rows", "keep_id"))
    members = entries.select("entry_id", _digest(list(FIELDS)).alias("raw"))
    return spread_join(members, kept, "raw", "rows").where("entry_id <> keep_id").select("entry_id", "keep_id").distinct()
