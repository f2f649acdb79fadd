"""The raw glossary: exact duplicates, rule-based quarantine, senses, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lontar.functions import ids, text

RAW = ("istilah", "pengertian", "undang_undang", "uu", "url", "status")


def normalised(raw: DataFrame, row: str = "entry_id") -> DataFrame:
    """(row, d_*: display forms, k_*: keys) of the six columns; computed once and reused."""
    shown = raw.select(F.col(row).alias("row"), *[text.display(c).alias(f"d_{c}") for c in RAW])
    return shown.select("*", *[text.key(f"d_{c}").alias(f"k_{c}") for c in RAW])


def exact_groups(rows: DataFrame) -> DataFrame:
    """One row per distinct key of all six columns: (keys, row = smallest, duplicate_count)."""
    return rows.groupBy(*[f"k_{c}" for c in RAW]).agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("duplicate_count"))


def unique_rows(rows: DataFrame) -> DataFrame:
    """The first row of every group, with its duplicate_count."""
    return rows.join(exact_groups(rows).select("row", "duplicate_count"), "row")


def lineage(rows: DataFrame) -> DataFrame:
    """(row, duplicate_of) of every row that repeats an earlier one."""
    keys = [f"k_{c}" for c in RAW]
    return rows.select("row", *keys).join(exact_groups(rows).withColumnRenamed("row", "duplicate_of"), keys).where("row <> duplicate_of").select("row", "duplicate_of")


def missing_list(columns: tuple[str, ...]) -> Column:
    return F.concat_ws(",", *[F.when(F.col(f"k_{c}") == "", F.lit(c)) for c in columns])


def quarantine_reason() -> Column:
    """The first rule that a row breaks, '' for none."""
    missing = missing_list(("istilah", "pengertian", "undang_undang"))
    r = text.regulation(F.col("d_undang_undang"))
    return (
        F.when(missing != "", F.concat(F.lit("missing_required:"), missing))
        .when(F.col("k_status") != "ok", "source_unverified")
        .when(F.col("k_uu") == "", "missing_regulation_title")
        .when((r["number"] == "") | (r["year"] == ""), "unparseable_regulation_identity")
        .otherwise("")
    )


def senses(unique: DataFrame) -> DataFrame:
    """The curated record of every unique row."""
    r = text.regulation(F.col("d_undang_undang"))
    stripped = text.strip_prefix(F.col("d_istilah"), F.col("d_pengertian"))
    built = unique.withColumn("r", r).withColumn("s", stripped).withColumn("quarantine_reason", quarantine_reason())
    return built.select(
        ids.stable_id("term", F.col("k_istilah")).alias("term_id"),
        ids.stable_id("sense", *[F.col(f"k_{c}") for c in ("istilah", "pengertian", "undang_undang", "uu")]).alias("sense_id"),
        ids.stable_id("source", *[F.col(f"k_{c}") for c in ("undang_undang", "uu", "url")]).alias("source_id"),
        F.col("row").alias("raw_row_number"),
        "duplicate_count",
        F.col("d_istilah").alias("canonical_term"),
        F.col("k_istilah").alias("normalized_term"),
        F.col("d_pengertian").alias("source_definition"),
        F.col("s.text").alias("retrieval_text"),
        F.col("s.removed").alias("retrieval_prefix_removed"),
        F.when(F.col("s.removed"), "").otherwise("term_prefix_not_found").alias("normalization_warning"),
        F.col("r.label").alias("regulation_label"),
        F.col("r.type").alias("regulation_type"),
        F.col("r.number").alias("regulation_number"),
        F.col("r.year").alias("regulation_year"),
        F.col("d_uu").alias("regulation_title"),
        F.col("d_url").alias("source_url"),
        text.host(F.col("d_url")).alias("source_host"),
        F.col("d_status").alias("source_status"),
        "quarantine_reason",
    )


def curated(records: DataFrame) -> DataFrame:
    return records.where("quarantine_reason = ''")


def quarantined(records: DataFrame) -> DataFrame:
    return records.where("quarantine_reason <> ''")


def several_senses(records: DataFrame) -> DataFrame:
    """(term_id, senses, canonical_term: the last spelling) of terms with more than one sense."""
    return records.groupBy("term_id").agg(F.countDistinct("sense_id").alias("senses"), F.max_by("canonical_term", "raw_row_number").alias("canonical_term")).where("senses > 1")


def missing_profile(rows: DataFrame) -> DataFrame:
    """(column, missing) over the raw columns."""
    counts = rows.agg(*[F.count_if(F.col(f"k_{c}") == "").alias(c) for c in RAW])
    return counts.unpivot([], list(RAW), "column", "missing")


def fill_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, rate): the share of rows with a non-blank value."""
    rates = df.agg(*[F.avg((F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "").cast("int")).alias(c) for c in columns])
    return rates.unpivot([], columns, "column", "rate")


def frequencies(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("rows"))


def nearest_rank(values: DataFrame, keys: list[str], value: str, fractions: dict[str, float]) -> DataFrame:
    """Per key: n, smallest, largest and the values at index round((n - 1) * f), halves to even.

    Values are compressed to (key, value, n) first and ranked by their running sum, so no task
    holds all values of a key.
    """
    from lontar.operators.ordered import running_sum

    counted = values.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    summed = running_sum(counted, keys, [value], F.col("n"), "upto")
    picks = [F.min(F.when(F.col("upto") > F.bround((F.col("upto_total") - 1) * F.lit(f)), F.col(value))).alias(name) for name, f in fractions.items()]
    return summed.groupBy(*keys).agg(F.sum("n").alias("n"), F.min(value).alias("smallest"), F.max(value).alias("largest"), *picks)


def terms(records: DataFrame, focus: tuple[str, ...] = ()) -> DataFrame:
    """One row per term: its representative record (the first by term, label and sense) and flags."""
    first = F.min_by(
        F.struct("canonical_term", "normalized_term", "regulation_type", "regulation_label", "regulation_title", "source_definition", "retrieval_text"),
        F.struct("canonical_term", "regulation_label", "sense_id"),
    )
    grouped = records.groupBy("term_id").agg(
        first.alias("first"),
        F.count(F.lit(1)).alias("sense_count"),
        F.sort_array(F.collect_set("sense_id")).alias("sense_ids"),
        F.sort_array(F.collect_set("regulation_label")).alias("source_labels"),
        F.max(F.length("source_definition")).alias("longest_definition"),
        F.bool_or(F.col("source_definition").rlike(r"(?iu)\bselanjutnya\s+(?:disebut|disingkat)\b")).alias("has_alias"),
        F.bool_or(F.col("source_definition").rlike(r"(?U)\d")).alias("has_digits"),
        F.bool_or(F.col("normalization_warning") != "").alias("warned"),
    )
    return grouped.select(
        "term_id", F.col("first.canonical_term"), F.col("first.normalized_term"), "sense_count", "sense_ids",
        F.col("first.regulation_type").alias("primary_type"), F.col("first.regulation_label").alias("primary_label"),
        F.col("first.regulation_title").alias("primary_title"), "source_labels", F.col("first.source_definition").alias("definition"),
        F.col("first.retrieval_text").alias("retrieval_text"), F.length("first.source_definition").alias("definition_length"),
        "longest_definition", "has_alias", "has_digits", F.col("first.normalized_term").isin(*focus).alias("in_focus") if focus else F.lit(False).alias("in_focus"),
        "warned",
    )


def repeated_keys(df: DataFrame, column: str) -> DataFrame:
    """(column, rows) of values that should be unique and aren't, or are empty."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("rows")).where((F.col("rows") > 1) | F.col(column).isNull() | (F.col(column).cast("string") == ""))


def dense_index(df: DataFrame, order: list[Column], name: str, by: list[str] | None = None) -> DataFrame:
    """Number small, bounded results; `by` numbers within groups."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*(by or [])).orderBy(*order)))
