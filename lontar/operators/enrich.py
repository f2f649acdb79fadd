"""Identity join of terms with a regulation corpus, evidence ranking and match status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lontar.functions import text, tokens
from lontar.runtime import materialize


def identities(corpus: DataFrame) -> DataFrame:
    """The corpus with the keys that identify its regulations; short columns only are normalised."""
    return corpus.select(
        "global_id",
        "article",
        "title",
        "content",
        text.kind_key(text.key("regulation_type")).alias("kind_key"),
        text.number_key(text.display("regulation_number")).alias("number_key"),
        text.plain("year").alias("year_key"),
    )


def wanted(terms: DataFrame) -> DataFrame:
    """The same keys for terms, from their primary label."""
    r = text.regulation(F.col("primary_label"))
    return terms.withColumn("r", r).select(
        "term_id",
        "canonical_term",
        text.kind_key(text.key(F.col("r.type"))).alias("kind_key"),
        text.number_key(F.col("r.number")).alias("number_key"),
        F.col("r.year").alias("year_key"),
        F.col("normalized_term").alias("term_key"),
        text.key("definition").alias("definition_key"),
        text.key("primary_title").alias("wanted_title_key"),
    )


def evidence(terms: DataFrame, corpus: DataFrame, titles: bool = True) -> DataFrame:
    """Every corpus row of a term's regulation with its features. `terms` is a bounded selection.

    The corpus is cut down by year before its identities are normalised, and by identity before any
    content is: only rows of the terms' own regulations are read in full.
    """
    asked = F.broadcast(materialize(wanted(terms))[0])
    near = corpus.withColumn("__year", text.plain("year")).join(F.broadcast(asked.select(F.col("year_key").alias("__year")).distinct()), "__year", "left_semi")
    # written out: the optimiser would normalise the content below the join
    found, _ = materialize(identities(near).join(asked, ["kind_key", "number_key", "year_key"]))
    joined = found.select("*", text.key("content").alias("content_key"), text.key("title").alias("title_key"), text.key("article").alias("article_key"))
    similarity = F.round(tokens.matching_ratio("wanted_title_key", "title_key"), 6) if titles else (F.col("wanted_title_key") == F.col("title_key")).cast("double")
    return joined.select(
        "term_id",
        "global_id",
        "article",
        "article_key",
        F.contains("content_key", "term_key").alias("term_present"),
        ((F.col("definition_key") != "") & F.contains("content_key", "definition_key")).alias("exact_definition"),
        tokens.coverage(tokens.text_tokens(F.col("definition_key")), tokens.text_tokens(F.col("content_key"))).alias("coverage"),
        similarity.alias("title_similarity"),
    )


def warnings(least_title: float) -> Column:
    return F.concat_ws(
        "|",
        F.when(F.col("title_similarity") < least_title, "low_title_similarity"),
        F.when(F.col("exact_definition") & ~F.startswith(F.col("article_key"), F.lit("pasal")), "definition_found_in_non_article_metadata"),
    )


def best(features: DataFrame, top: int = 3, least_title: float = 0.6) -> DataFrame:
    """The top rows per term: those that hold the term, else all; ranked by what they prove."""
    by_term = Window.partitionBy("term_id")
    any_present = features.withColumn("any_present", F.max("term_present").over(by_term))
    eligible = any_present.where(F.col("term_present") | ~F.col("any_present"))
    order = by_term.orderBy(
        F.desc("term_present"), F.desc("exact_definition"), F.desc("coverage"), F.desc("title_similarity"),
        F.desc(F.coalesce(F.col("article_key").rlike(r"^pasal\s+1\b"), F.lit(False))), "global_id",
    )
    ranked = eligible.withColumn("candidate_rank", F.row_number().over(order)).where(F.col("candidate_rank") <= top)
    return ranked.select("term_id", "candidate_rank", "global_id", "article", "term_present", "exact_definition", "coverage", "title_similarity", warnings(least_title).alias("metadata_warnings"))


def match_status(terms: DataFrame, features: DataFrame, ranked: DataFrame, high: float = 0.8) -> DataFrame:
    """(term_id, identity_rows, term_rows, status, top row with its article and warnings) of every term."""
    counts = features.groupBy("term_id").agg(F.count(F.lit(1)).alias("identity_rows"), F.count_if("term_present").alias("term_rows"))
    first = ranked.where("candidate_rank = 1").select("term_id", F.col("global_id").alias("top_global_id"), "article", "metadata_warnings", "exact_definition", "coverage")
    full = terms.select("term_id").join(counts, "term_id", "left").join(first, "term_id", "left")
    n, t = F.coalesce("identity_rows", F.lit(0)), F.coalesce("term_rows", F.lit(0))
    status = (
        F.when(n == 0, "regulation_not_found")
        .when(t == 0, "term_not_found_in_regulation")
        .when(F.col("exact_definition"), "candidate_exact_definition")
        .when(F.col("coverage") >= high, "candidate_high_coverage")
        .otherwise("candidate_needs_review")
    )
    return full.select("term_id", n.alias("identity_rows"), t.alias("term_rows"), status.alias("match_status"), "top_global_id", "article", "metadata_warnings")
