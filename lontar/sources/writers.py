"""Writers, content hashes and manifests."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, functions as F


def write_csv(df: DataFrame, path: str, columns: list[str], single: bool = False) -> None:
    """Header, fixed column order, doubled quotes; `single` for small reports only."""
    out = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns])
    (out.coalesce(1) if single else out).write.mode("overwrite").csv(path, header=True, escape='"', quote='"', emptyValue="")


def write_parquet(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    (df.select(*columns) if columns else df).write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """NaN becomes null, which JSON can hold."""
    cleaned = df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes])
    cleaned.write.mode("overwrite").json(path)


def write_review_csv(df: DataFrame, path: str, columns: list[str], blank: list[str]) -> None:
    """The columns followed by blank ones for reviewers."""
    filled = df.select(*columns, *[F.lit("").alias(b) for b in blank])
    write_csv(filled, path, [*columns, *blank], single=True)


def write_json(path: str, payload: object) -> None:
    """Sorted keys, one final line break, replaced in one step."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    draft = target.with_name(target.name + ".new")
    draft.write_text(json.dumps(payload, ensure_ascii=False, indent=2, sort_keys=True) + "\n", encoding="utf-8")
    os.replace(draft, target)


def content_hash(df: DataFrame) -> str:
    """A fingerprint of the rows in any order and any number of files; repeated rows count."""
    row = F.xxhash64(*[F.col(c) for c in sorted(df.columns)]).cast("decimal(38,0)")
    found = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(row), F.lit(0)).alias("s")).first()
    return f"{found.n}:{found.s}"


def upsert(entries: list[dict], entry: dict, key: str) -> list[dict]:
    """Replace the entry of that key, keeping the place and all others; new ones go last."""
    if any(e[key] == entry[key] for e in entries):
        return [e | entry if e[key] == entry[key] else e for e in entries]
    return [*entries, entry]


def upsert_rows(stored: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """The same on tables."""
    return stored.join(changed.select(key), key, "left_anti").unionByName(changed, allowMissingColumns=True)


def portable(path: str, root: str) -> str:
    full = Path(path).resolve()
    return str(full.relative_to(Path(root).resolve())) if full.is_relative_to(Path(root).resolve()) else full.name


def counts_report(title: str, sections: dict[str, dict]) -> str:
    """A Markdown report from small collected aggregates."""
    lines = [f"# {title}", ""]
    for name, values in sections.items():
        lines += [f"## {name}", "", *[f"- {k or '(missing)'}: {v:,}" if isinstance(v, int) else f"- {k or '(missing)'}: {v}" for k, v in values.items()], ""]
    return "\n".join(lines)
