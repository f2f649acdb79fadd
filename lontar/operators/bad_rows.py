"""Problem 5: rows that fail to parse.

Each record is cut into cells by RFC 4180 in one linear pass; the cells are exploded into
(row, column, value), joined with a rule table, the violations aggregated per row, and the valid
rows loaded by an anti-join against the failures.

A record is one logical row; line breaks inside quotes belong to the value, one at the end of the
record is dropped, and one outside quotes starts a second record, which fails as `column_count`.
Null records fail as `column_count`, empty ones too. The first reason that applies is given:
`quoting`, `column_count`, `value`. Repeated rows each keep their own result. Extra columns of the
input, whatever their names, are ignored by `parse_cells` and `failures`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lontar.functions.keys import BLANK

COLUMNS = ("istilah", "pengertian", "undang_undang", "uu", "url", "status")


def split_record(line: str | None) -> tuple[list[str], bool]:
    """The cells of a record, and whether its quotes obey RFC 4180."""
    if line is None:
        return [], True
    if line.endswith("\n"):
        line = line[:-1]
    if line.endswith("\r"):
        line = line[:-1]
    cells: list[str] = []
    at, end = 0, len(line)
    while True:
        if at < end and line[at] == '"':
            parts, start = [], at + 1
            while True:
                close = line.find('"', start)
                if close < 0:
                    return cells, False
                parts.append(line[start:close])
                if close + 1 < end and line[close + 1] == '"':
                    parts.append('"')
                    start = close + 2
                    continue
                break
            at = close + 1
            if at < end and line[at] != ",":
                return cells, False
            cells.append("".join(parts))
        else:
            comma = line.find(",", at)
            stop = end if comma < 0 else comma
            cell = line[at:stop]
            if '"' in cell:
                return cells, False
            cells.append(cell)
            if "\n" in cell or "\r" in cell:
                cells.extend([""] * len(COLUMNS))
            at = stop
        if at >= end:
            return cells, True
        at += 1


@F.pandas_udf(T.StructType().add("cells", T.ArrayType(T.StringType())).add("quoted_well", T.BooleanType()))
def _split(lines: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in lines:
        done = [split_record(x if isinstance(x, str) else None) for x in batch]
        yield pd.DataFrame({"cells": [a for a, _ in done], "quoted_well": [b for _, b in done]})


def parse_cells(raw: DataFrame, row: str = "line_no", line: str = "raw_line") -> DataFrame:
    """(row, cells, quoted_well) of each record."""
    return raw.select(F.col(row).alias("row"), _split(F.col(line)).alias("p")).select("row", "p.cells", "p.quoted_well")


#: rule -> predicate that holds for a violation. The values are trimmed of nothing.
LETTERS = r"[\p{L}]"
_SHEET_ERROR = r"(?i)^\s*#(value|ref|name|div/0|n/a|num|null|spill|calc|getting_data|error)[!?]?.*$"
_DATE = (
    r"(?i)^\s*\d{1,4}[\s./-]+(\d{1,2}|januari|februari|maret|april|mei|juni|juli|agustus|september|oktober|november|"
    r"desember|jan|feb|mar|apr|jun|jul|agu|agt|sep|okt|nov|des)[\s./-]+\d{1,4}([ T]\d{1,2}[:.]\d{2}([:.]\d{2})?)?\s*$"
)


def _rules() -> dict[str, Column]:
    v = F.col("value")
    in_words = v.rlike(r"\p{L}{2}") & ~v.rlike(_SHEET_ERROR)
    number = v.rlike(r"^\s*[-+]?[\d.,\s]+([eE][-+]?\d+)?\s*%?\s*$")
    header = F.lower(F.trim(v)) == F.col("column")
    damaged = v.rlike("[\\x00-\\x09\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x84\\x86-\\x9f\\ufffd]")
    return {
        "words": ~in_words | number | header | damaged,
        "title_or_empty": (v != "") & (~in_words | number | header | v.rlike(r"^\s*=") | v.rlike(_DATE)),
        "web_address": ~v.rlike(r"(?i)^https?://(?!:)([^\s/?#@]*@)?([^\s/?#:@\[\]]+|\[[0-9a-f:.]+\])(:\d*)?([/?#]\S*)?\z") | v.rlike(BLANK),
    }


#: The rule table; it has one row per rule and never grows with the data.
RULES = (("pengertian", "words"), ("uu", "title_or_empty"), ("url", "web_address"))


def violations(cells: DataFrame) -> DataFrame:
    """(row, column, rule, value) of every cell that breaks its rule, in rows of the right shape."""
    spark = cells.sparkSession
    rules = spark.createDataFrame(list(RULES), "column string, rule string")
    shaped = cells.where(F.col("quoted_well") & (F.size("cells") == len(COLUMNS)))
    names = F.array(*[F.lit(c) for c in COLUMNS])
    exploded = shaped.select("row", F.posexplode("cells").alias("at", "value")).select("row", names[F.col("at")].alias("column"), "value")
    checked = exploded.join(F.broadcast(rules), "column")
    broken = F.lit(False)
    for rule, predicate in _rules().items():
        broken = F.when(F.col("rule") == rule, predicate).otherwise(broken)
    return checked.where(broken).select("row", "column", "rule", "value")


def failures(cells: DataFrame) -> DataFrame:
    """(row, reason): the first reason of every row that can't be loaded."""
    shape = F.when(~F.col("quoted_well"), "quoting").when(F.size("cells") != len(COLUMNS), "column_count")
    shapeless = cells.select("row", shape.alias("reason")).where(F.col("reason").isNotNull())
    valued = violations(cells).groupBy("row").agg(F.lit("value").alias("reason"))
    return shapeless.unionByName(valued)


def load_valid(cells: DataFrame) -> DataFrame:
    """(row, the six columns) of every valid row."""
    good = cells.join(failures(cells).select("row"), "row", "left_anti")
    return good.select("row", *[F.col("cells")[i].alias(c) for i, c in enumerate(COLUMNS)])
