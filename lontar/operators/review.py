"""Review queues, locked splits, and validation that reports every violation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from lontar.functions import ids, text
from lontar.operators.spread import spread_join
from lontar.runtime import materialize


def set_difference(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Distinct values of `column` on one side only, with the side."""
    a, b = left.select(column).distinct(), right.select(column).distinct()
    return a.join(b, column, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, column, "left_anti").withColumn("side", F.lit("right")))


def require_same(left: DataFrame, right: DataFrame, column: str) -> None:
    """Raise with a few examples unless both sides hold the same values, each once."""
    odd = set_difference(left, right, column).limit(5).collect()
    if odd:
        raise ValueError(f"{column} differs: {[tuple(r) for r in odd]}")
    for side in (left, right):
        twice = side.groupBy(column).count().where("count > 1").limit(5).collect()
        if twice:
            raise ValueError(f"{column} repeats: {[r[0] for r in twice]}")


def with_registry(terms: DataFrame, registry: DataFrame, label: str = "label_key") -> DataFrame:
    """Every term with the registry's entry of its label; labels that the registry lacks are an error."""
    missing = terms.select(label).distinct().join(registry, label, "left_anti").orderBy(label).limit(20).collect()
    if missing:
        raise ValueError(f"the registry lacks {[r[0] for r in missing]}")
    return terms.join(registry, label)


def review_rows(terms: DataFrame, statuses: DataFrame, registry: DataFrame) -> DataFrame:
    """One pending row per term, with its best evidence and its source; `registry` has (label_key, source_id, signal)."""
    joined = with_registry(terms.join(statuses, "term_id"), registry)
    flags = F.concat_ws(
        "|",
        F.lit("official_document_and_definition_required"),
        F.when(F.col("match_status") == "regulation_not_found", "dataset_regulation_unresolved"),
        F.when(F.col("match_status") == "term_not_found_in_regulation", "dataset_term_unresolved"),
        F.when(F.coalesce("metadata_warnings", F.lit("")) != "", "dataset_metadata_warning"),
        F.when(F.col("signal") != "status_not_reviewed", "official_status_signal_requires_review"),
    )
    return joined.select(
        ids.stable_id("source_review", F.col("term_id"), F.col("source_id")).alias("review_id"),
        "pilot_index",
        "term_id",
        "canonical_term",
        "bucket",
        "primary_label",
        "primary_title",
        "source_id",
        "signal",
        "match_status",
        "top_global_id",
        F.coalesce("article", F.lit("")).alias("article"),
        F.coalesce("metadata_warnings", F.lit("")).alias("metadata_warnings"),
        F.lit("pending_human_review").alias("review_status"),
        flags.alias("attention_flags"),
    )


def locked(rows: DataFrame, count: int, seed: str, column: str = "term_id") -> DataFrame:
    """The first `count` values by hash."""
    return rows.select(column).distinct().orderBy(ids.rank(seed, F.col(column)), column).limit(count)


def slots(rows: DataFrame, per_row: int, held: DataFrame) -> DataFrame:
    """`per_row` empty slots for each row, with the split of its term."""
    marked = rows.join(F.broadcast(held.select("term_id", F.lit(True).alias("held"))), "term_id", "left")
    wide = marked.select("term_id", "review_id", F.coalesce("held", F.lit(False)).alias("held"), F.explode(F.sequence(F.lit(1), F.lit(per_row))).alias("query_slot"))
    return wide.select(
        ids.stable_id("gold_query", F.col("term_id"), F.col("query_slot").cast("string")).alias("query_id"),
        "term_id",
        "review_id",
        "query_slot",
        F.when(F.col("held"), "locked_test").otherwise("development").alias("query_split"),
        F.lit("").alias("query_text"),
    )


@dataclass(frozen=True)
class Rule:
    """`broken` holds for a row that violates the rule."""

    code: str
    broken: Column


def violations(df: DataFrame, name: str, row: str, rules: list[Rule]) -> DataFrame:
    """(table_name, row, code) of every violation, in one pass."""
    codes = F.array_compact(F.array(*[F.when(F.coalesce(r.broken, F.lit(False)), F.lit(r.code)) for r in rules]))
    return df.select(F.lit(name).alias("table_name"), F.col(row).cast("string").alias("row"), F.explode(codes).alias("code"))


def repeated(df: DataFrame, name: str, row: str, column: str, code: str) -> DataFrame:
    """Rows whose `column` is empty or already taken by an earlier row, as violations. A value that
    most rows share is compared with its first row where they are."""
    blank = F.col(column).isNull() | (F.col(column).cast("string") == "")
    known = df.where(~blank).select(F.col(row).alias("__row"), column)
    firsts = known.groupBy(column).agg(F.min("__row").alias("__first"), F.count(F.lit(1)).alias("__n")).where("__n > 1")
    firsts, _ = materialize(firsts)
    later = spread_join(known, firsts, column, "__n").where("__row > __first").select("__row")
    bad = df.where(blank).select(F.col(row).alias("__row")).unionByName(later)
    return bad.select(F.lit(name).alias("table_name"), F.col("__row").cast("string").alias("row"), F.lit(code).alias("code"))


def orphans(df: DataFrame, name: str, row: str, column: str, parent: DataFrame, code: str) -> DataFrame:
    """Rows whose `column` isn't in `parent`, as violations."""
    known = parent.select(F.col(parent.columns[0]).alias(column)).distinct()
    return df.join(known, column, "left_anti").select(F.lit(name).alias("table_name"), F.col(row).cast("string").alias("row"), F.lit(code).alias("code"))


def _blank(column: str) -> Column:
    return F.trim(F.coalesce(column, F.lit(""))) == ""


# What a review may say.
SOURCE_STATUSES = ("pending_human_review", "needs_review", "verified", "rejected")
GOLD_STATUSES = ("blocked_unverified_source", "pending_human_review", "approved", "rejected")
COMPARISONS = ("exact", "equivalent")


def source_rules(hosts: tuple[str, ...]) -> list[Rule]:
    """What evidence a verified source must have, column by column."""
    verified = F.col("review_status") == "verified"
    return [
        Rule("status_unknown", ~F.coalesce("review_status", F.lit("")).isin(*SOURCE_STATUSES)),
        Rule("document_url_missing", verified & _blank("document_url")),
        Rule("document_url_not_official", verified & ~_blank("document_url") & ~text.official(F.col("document_url"), hosts)),
        Rule("document_sha256_invalid", verified & ~text.is_sha256(F.coalesce("document_sha256", F.lit("")))),
        Rule("article_missing", verified & _blank("article")),
        Rule("definition_missing", verified & _blank("definition")),
        Rule("comparison_not_accepted", verified & ~F.coalesce("comparison", F.lit("")).isin(*COMPARISONS)),
        Rule("reviewer_missing", verified & _blank("reviewer_id")),
        Rule("reviewed_at_invalid", verified & ~text.is_iso_time(F.col("reviewed_at"))),
    ]


def validate_sources(sources: DataFrame, hosts: tuple[str, ...]) -> DataFrame:
    """(table_name, row, code) of everything wrong with the reviewed sources; the row is its `review_id`."""
    once = repeated(sources, "sources", "review_id", "term_id", "term_repeated")
    return violations(sources, "sources", "review_id", source_rules(hosts)).unionByName(once)


def validate_gold(gold: DataFrame, sources: DataFrame) -> DataFrame:
    """The same for the queries, each against the source it names; the row is its `query_id`."""
    statuses = sources.select(F.col("review_id").alias("__review"), F.col("review_status").alias("__status"))
    terms = sources.select(F.col("term_id").alias("__term")).distinct()
    rows = gold.join(statuses, gold.review_id == F.col("__review"), "left").join(terms, gold.term_id == F.col("__term"), "left")
    rows = rows.withColumns({"__key": text.key("query_text"), "__term_key": text.key("canonical_term")})
    approved = F.col("review_status") == "approved"
    rules = [
        Rule("status_unknown", ~F.coalesce("review_status", F.lit("")).isin(*GOLD_STATUSES)),
        Rule("term_unknown", F.col("__term").isNull()),
        Rule("expected_term_differs", ~F.col("expected_term_id").eqNullSafe(F.col("term_id"))),
        Rule("source_unknown", approved & F.col("__review").isNull()),
        Rule("source_not_verified", approved & F.col("__review").isNotNull() & (F.coalesce("__status", F.lit("")) != "verified")),
        Rule("text_missing", approved & _blank("query_text")),
        Rule("text_leaks_term", approved & leaks_term(F.col("__term_key"), F.col("__key"))),
        Rule("author_missing", approved & _blank("author_id")),
        Rule("reviewer_missing", approved & _blank("reviewer_id")),
        Rule("reviewed_at_invalid", approved & ~text.is_iso_time(F.col("reviewed_at"))),
    ]
    return violations(rows, "gold", "query_id", rules)


def raise_if_any(found: DataFrame, shown: int = 20) -> None:
    rows = found.orderBy("table_name", "row", "code").limit(shown + 1).collect()
    if rows:
        listed = "; ".join(f"{r.table_name} row {r.row}: {r.code}" for r in rows[:shown])
        raise ValueError(f"validation failed: {listed}" + (" ..." if len(rows) > shown else ""))


def leaks_term(term_key: Column, query_key: Column) -> Column:
    """Whether a query holds the term that it should find."""
    return (term_key != "") & F.contains(query_key, term_key)
