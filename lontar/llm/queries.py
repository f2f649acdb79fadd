"""Queries of the text problems, each over its whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lontar.llm import bpe, broken_pairs, copies, grouped_splits, leaks, lookalikes, overlaps, prose
from lontar.operators.spread import spread_join
from lontar.runtime import materialize, table


def _entries(spark: SparkSession, root: str) -> DataFrame:
    return copies.from_table(table(spark, root, "glossary")).unionByName(copies.from_json(table(spark, root, "glossary_feed")))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return copies.copies(_entries(spark, root))


def p2_records(spark: SparkSession, root: str) -> DataFrame:
    """One row per record with the number of its copies."""
    return copies.records(copies.survivors(_entries(spark, root))).select("keep_id", "copies")


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return broken_pairs.defects(table(spark, root, "qa_sft"))


def p3_report(spark: SparkSession, root: str) -> DataFrame:
    """Pairs by defect, with the mean share of their words under each tag."""
    tagged = broken_pairs.tagged(table(spark, root, "qa_sft"))
    return tagged.groupBy(F.coalesce("defect", F.lit("none")).alias("defect")).agg(F.count(F.lit(1)).alias("pairs"), *[F.avg(t).alias(f"mean_{t}") for t in broken_pairs.TAGS])


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return overlaps.overlaps(table(spark, root, "qa_sft"))


def p4_rows(spark: SparkSession, root: str) -> DataFrame:
    """Each evaluation row that overlaps train, with its class and the number of train rows."""
    return overlaps.overlap_counts(table(spark, root, "qa_sft"))


def p4_report(spark: SparkSession, root: str) -> DataFrame:
    """Evaluation rows that also stand in train, and pairs, per split and source."""
    evaluation = table(spark, root, "qa_sft").where("split in ('validation', 'test')").select("id", "split", "source_dataset")
    return p4_rows(spark, root).join(evaluation, "id").groupBy("split", "source_dataset").agg(F.sum("links").alias("pairs"), F.countDistinct("id").alias("rows"))


def _looks(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Both tables and the counts of look-alike characters over all their fields."""
    terms = table(spark, root, "glossary").select(F.col("entry_id").alias("id"), "istilah", "pengertian")
    chunks = table(spark, root, "corpus").select(F.col("global_id").alias("id"), "content")
    return terms, chunks, lookalikes.member_counts([(terms, "istilah"), (terms, "pengertian"), (chunks, "content")])


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    terms, chunks, counts = _looks(spark, root)
    first = lookalikes.same_look(terms, ["istilah", "pengertian"], counts).select(F.lit("glossary").alias("table_name"), "id_a", "id_b")
    return first.unionByName(lookalikes.same_look(chunks, ["content"], counts).select(F.lit("corpus").alias("table_name"), "id_a", "id_b"))


def p6_rows(spark: SparkSession, root: str) -> DataFrame:
    """Each row that is spelt otherwise elsewhere, with its class and the number of such rows."""
    terms, chunks, counts = _looks(spark, root)
    first = lookalikes.same_look_rows(terms, ["istilah", "pengertian"], counts).select(F.lit("glossary").alias("table_name"), "id", "class_id", "links")
    return first.unionByName(lookalikes.same_look_rows(chunks, ["content"], counts).select(F.lit("corpus").alias("table_name"), "id", "class_id", "links"))


def p6_texts(spark: SparkSession, root: str) -> DataFrame:
    """Every value in its one consistent form, the same for a term and its mention."""
    terms, chunks, counts = _looks(spark, root)
    first = terms.select(F.lit("glossary").alias("table_name"), "id", lookalikes.consistent("istilah", counts).alias("istilah"), lookalikes.consistent("pengertian", counts).alias("text"))
    second = chunks.select(F.lit("corpus").alias("table_name"), "id", F.lit(None).cast("string").alias("istilah"), lookalikes.consistent("content", counts).alias("text"))
    return first.unionByName(second)


def _groups(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    rows = grouped_splits.records(table(spark, root, "qa_sft"), table(spark, root, "corpus"))
    pairs = rows.where("table_name = 'qa_sft'").select("key", "answer").distinct()
    return rows, grouped_splits.linked_keys(pairs)


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return _groups(spark, root)[1].select(F.col("key").alias("regulation_key"), "group_key")


def _assigned(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    rows, groups = _groups(spark, root)
    plan = {r.split: r.share for r in table(spark, root, "split_plan").collect()}
    grouped, _ = materialize(grouped_splits.with_groups(rows, groups))
    splits, _ = materialize(grouped_splits.assign(grouped, plan))
    return grouped, splits


def p7_rows(spark: SparkSession, root: str) -> DataFrame:
    """The split of every row of both tables."""
    grouped, splits = _assigned(spark, root)
    return spread_join(grouped, splits, "group_key", "rows").select("table_name", "id", "group_key", "split")


def p7_shares(spark: SparkSession, root: str) -> DataFrame:
    """Rows and groups that each split got, with the share wanted."""
    _, splits = _assigned(spark, root)
    plan = table(spark, root, "split_plan")
    got = splits.groupBy("split").agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("groups"))
    return plan.join(got, "split", "left").select("split", "share", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("groups", F.lit(0)).alias("groups"))


def p7_labels(spark: SparkSession, root: str) -> DataFrame:
    """How far each label's spread over the splits is from the plan."""
    grouped, splits = _assigned(spark, root)
    return grouped_splits.label_shares(grouped, splits, table(spark, root, "split_plan"))


def p8_ids(spark: SparkSession, root: str) -> DataFrame:
    return bpe.encode(table(spark, root, "documents"))


def p9_passages(spark: SparkSession, root: str) -> DataFrame:
    """Every leaked passage with its place in the document."""
    return leaks.leaks(table(spark, root, "documents"), table(spark, root, "eval_cases"))


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    return p9_passages(spark, root).select("doc_id", "case_id").distinct()


def p9_cases(spark: SparkSession, root: str) -> DataFrame:
    """The cases that leaked, with the number of documents that give them away."""
    return p9_found(spark, root).groupBy("case_id").agg(F.count(F.lit(1)).alias("documents"))


def p10_statistics(spark: SparkSession, root: str) -> DataFrame:
    return prose.judged(table(spark, root, "documents"))


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    return p10_statistics(spark, root).where("kind in ('list', 'table', 'junk')").select("doc_id", "kind")


QUERIES = {
    f.__name__: f
    for f in (
        p2_found, p2_records, p3_found, p3_report, p4_found, p4_rows, p4_report, p6_found, p6_rows, p6_texts, p7_found, p7_rows, p7_shares, p7_labels, p8_ids, p9_found,
        p9_passages, p9_cases, p10_found, p10_statistics,
    )
}
