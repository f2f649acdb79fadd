"""Readers with the source formats' contracts."""

from __future__ import annotations

import csv
import hashlib
import io
import json
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lontar.operators.bad_rows import COLUMNS
from lontar.operators.ordered import running_sum
from lontar.runtime import materialize


def read_csv(spark: SparkSession, path: str, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """A CSV with exactly these headers: missing cells are '', rows with more cells are an error on read.

    `_raw_row_number` counts logical records from 2. A file with line breaks inside quotes can't be
    split, so numbers follow the order of one file; pass files one by one where numbers matter.
    """
    with_extra = T.StructType([T.StructField(c, T.StringType()) for c in (*columns, "_extra")])
    head = spark.read.text(path, wholetext=False).limit(1).collect()
    found = next(csv.reader(io.StringIO(head[0][0].lstrip("﻿"))), []) if head else []
    if tuple(found) != columns:
        raise ValueError(f"unexpected CSV columns {found}; expected {list(columns)}")
    raw = spark.read.csv(path, schema=with_extra, header=True, multiLine=True, escape='"', quote='"', mode="PERMISSIVE", enforceSchema=True, encoding="UTF-8")
    checked = F.when(F.col("_extra").isNotNull(), F.raise_error(F.lit("malformed CSV row: extra values"))).otherwise(F.lit(""))
    cells = [F.concat(F.coalesce(F.col(c), F.lit("")), checked).alias(c) for c in columns]
    # a file is one partition here, so the order is written down before rows move
    kept, _ = materialize(raw.select(*cells, F.monotonically_increasing_id().alias("_order")))
    numbered = running_sum(kept, [], ["_order"], F.lit(1), "_raw_row_number")
    return numbered.select(*columns, (F.col("_raw_row_number") + 1).alias("_raw_row_number"))


def split_files(spark: SparkSession, folder: str, split: str, first_only: bool = False) -> list[str]:
    """The sorted shards `{split}-*.parquet` under data/, else anywhere below; an error if none. Any
    file system that Spark reads will do."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(context._jsc.hadoopConfiguration())
    found = sorted(str(s.getPath()) for s in files.globStatus(path(f"{folder}/data/{split}-*.parquet")) or ())
    if not found and files.exists(path(folder)):
        below = files.listFiles(path(folder), True)
        while below.hasNext():
            one = below.next().getPath()
            if one.getName().startswith(f"{split}-") and one.getName().endswith(".parquet"):
                found.append(str(one))
        found.sort()
    if not found:
        raise FileNotFoundError(f"no shard of {split!r} in {folder}")
    return found[:1] if first_only else found


def read_split(spark: SparkSession, folder: str, split: str, columns: Iterable[str] | None = None, first_only: bool = False) -> DataFrame:
    rows = spark.read.parquet(*split_files(spark, folder, split, first_only)).withColumn("split", F.lit(split))
    return rows.select(*columns, "split") if columns else rows


def split_counts(spark: SparkSession, folder: str, splits: Iterable[str]) -> dict[str, int]:
    """Rows of each split. No column is read: the counts come from the footers."""
    return {s: spark.read.parquet(*split_files(spark, folder, s)).count() for s in splits}


def require_columns(df: DataFrame, wanted: Iterable[str], label: str) -> DataFrame:
    missing = sorted(set(wanted) - set(df.columns))
    if missing:
        raise ValueError(f"{label} is missing columns: {missing}")
    return df


def require_counts(df: DataFrame, expected: dict[str, int], column: str = "split") -> DataFrame:
    """Raise unless every value of `column` has the expected number of rows."""
    counts = {r[0]: r[1] for r in df.where(F.col(column).isin(*expected)).groupBy(column).count().collect()}
    wrong = {k: (n, counts.get(k, 0)) for k, n in expected.items() if counts.get(k, 0) != n}
    if wrong:
        raise ValueError(f"row counts differ (expected, found): {wrong}")
    return df


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; blank lines are skipped, anything else that isn't an object fails, and so does an empty file."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    if not lines.limit(1).count():
        raise ValueError(f"{path} is empty")
    parsed = F.from_json("value", schema, {"mode": "FAILFAST"})
    shaped = F.when(F.col("value").rlike(r"^\s*\{"), parsed).otherwise(F.raise_error(F.concat(F.lit(f"a line of {path} is no object: "), F.substring("value", 1, 80))))
    return lines.select(shaped.alias("x")).select("x.*")


#: Other names that hand-made case files use.
ALIASES = {"prompt": ("prompt", "question"), "reference_answer": ("reference_answer", "completion", "answer")}


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """(case_id, prompt, reference_answer) from jsonl, json or csv; an empty prompt is an error."""
    suffix = Path(path).suffix.lower()
    if suffix == ".csv":
        raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    else:
        raw = spark.read.json(path, multiLine=suffix == ".json")

    def first(name: str):
        known = [F.when(F.trim(F.col(c)) != "", F.col(c)) for c in ALIASES[name] if c in raw.columns]
        return F.coalesce(*known, F.lit("")) if known else F.lit("")

    case = F.coalesce(F.col("case_id").cast("string"), F.lit("")) if "case_id" in raw.columns else F.lit("")
    prompt = F.when(first("prompt") == "", F.raise_error(F.lit(f"{path}: a case without a prompt"))).otherwise(first("prompt"))
    return raw.select(case.alias("case_id"), prompt.alias("prompt"), first("reference_answer").alias("reference_answer"))


def sha256_file(path: str) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as data:
        while block := data.read(1 << 22):
            digest.update(block)
    return digest.hexdigest()


def require_snapshot(path: str, size: int, sha256: str) -> str:
    """Fail before reading unless a pinned file is what it was."""
    if Path(path).stat().st_size != size:
        raise ValueError(f"{path}: the size isn't the pinned one")
    if sha256_file(path) != sha256:
        raise ValueError(f"{path}: the SHA-256 isn't the pinned one")
    return path


@contextmanager
def unchanged(*paths: str) -> Iterator[None]:
    """Fail unless the input files are, at the end of the block, what they were at its beginning."""
    before = {p: sha256_file(p) for p in paths}
    yield
    changed = [p for p, digest in before.items() if not Path(p).is_file() or sha256_file(p) != digest]
    if changed:
        raise ValueError(f"input was changed: {changed}")


def read_config(path: str, required: Iterable[str]) -> dict:
    config = json.loads(Path(path).read_text(encoding="utf-8"))
    missing = sorted(set(required) - set(config))
    if missing:
        raise ValueError(f"{path} is missing fields: {missing}")
    quotas = config.get("quotas")
    if quotas is not None and sum(quotas.values()) != config["target_count"]:
        raise ValueError("the quotas don't add up to target_count")
    return config
