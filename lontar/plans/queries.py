"""The registry of the core queries; each is (spark, folder) -> DataFrame over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lontar.functions import ids, text, tokens
from lontar.functions.keys import key
from lontar.operators import bad_rows, compare, curate, enrich, heavy_keys, retrieve, review, select
from lontar.runtime import materialize, table


def _frequencies(spark: SparkSession, root: str, name: str, value: str) -> DataFrame:
    return heavy_keys.value_frequencies(table(spark, root, name), key("regulation_key"), F.col(value))


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """Keys that hold more than 3 % of all rows of their table."""
    parts = [
        heavy_keys.heavy_keys(_frequencies(spark, root, name, "token_count"), 0.03).select(F.lit(name).alias("table_name"), F.col("key").alias("regulation_key"))
        for name in ("qa_sft", "corpus")
    ]
    return parts[0].unionByName(parts[1])


def p1_keys(spark: SparkSession, root: str) -> DataFrame:
    """Rows, distinct sizes, most frequent size and percentiles of the size, per key of either table."""

    def one(name: str) -> DataFrame:
        compressed, _ = materialize(_frequencies(spark, root, name, "token_count"))
        totals = heavy_keys.key_totals(compressed)
        percentiles = heavy_keys.key_percentiles(compressed, {"p50": 0.5, "p90": 0.9})
        joined = totals.alias("t").join(percentiles.alias("q"), F.col("t.key").eqNullSafe(F.col("q.key")), "left")
        return joined.select(F.lit(name).alias("table_name"), F.col("t.key").alias("regulation_key"), "rows", "distinct_values", "mode", "mode_rows", "p50", "p90")

    return one("qa_sft").unionByName(one("corpus"))


def p1_answers(spark: SparkSession, root: str) -> DataFrame:
    """Rows, distinct answers of qa_sft or contents of corpus, and the most frequent one, per key."""

    def one(name: str, value: str) -> DataFrame:
        compressed = heavy_keys.value_frequencies(table(spark, root, name), key("regulation_key"), key(value))
        return heavy_keys.key_totals(compressed).select(F.lit(name).alias("table_name"), F.col("key").alias("regulation_key"), "rows", "distinct_values", "mode", "mode_rows")

    return one("qa_sft", "answer_hash").unionByName(one("corpus", "content_hash"))


def _parsed_cells(spark: SparkSession, root: str) -> DataFrame:
    return bad_rows.parse_cells(table(spark, root, "glossary_raw"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return bad_rows.failures(_parsed_cells(spark, root)).withColumnRenamed("row", "line_no")


def p5_loaded(spark: SparkSession, root: str) -> DataFrame:
    """The rows that can be loaded."""
    return bad_rows.load_valid(_parsed_cells(spark, root)).withColumnRenamed("row", "line_no")


def p5_reasons(spark: SparkSession, root: str) -> DataFrame:
    """Failures by reason."""
    return p5_found(spark, root).groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))


# --- the glossary ---

SEED = "lontar"
QUOTAS = {"anchor": 3, "multi_sense": 8, "domain_focus": 4, "near_neighbor": 6, "alias": 9, "numeric": 9, "long_definition": 5, "typical_fill": 6}
CAP = 3


def _normalised(spark: SparkSession, root: str) -> DataFrame:
    return curate.normalised(table(spark, root, "glossary"))


def _senses(spark: SparkSession, root: str) -> DataFrame:
    return curate.senses(curate.unique_rows(_normalised(spark, root)))


def _terms(spark: SparkSession, root: str) -> DataFrame:
    return curate.terms(curate.curated(_senses(spark, root)))


def normalize_text(spark: SparkSession, root: str) -> DataFrame:
    return _normalised(spark, root).select(F.col("row").alias("entry_id"), "d_istilah", "k_istilah", "d_pengertian", "k_pengertian")


def stable_ids(spark: SparkSession, root: str) -> DataFrame:
    rows = _normalised(spark, root)
    return rows.select(
        F.col("row").alias("entry_id"),
        ids.stable_id("term", F.col("k_istilah")).alias("term_id"),
        ids.stable_id("source", *[F.col(f"k_{c}") for c in ("undang_undang", "uu", "url")]).alias("source_id"),
        ids.rank(SEED, "bucket", F.col("k_istilah")).alias("rank"),
        ids.priority(SEED, "bucket", F.col("k_istilah")).alias("priority"),
    )


def url_hosts(spark: SparkSession, root: str) -> DataFrame:
    rows = _normalised(spark, root)
    return rows.groupBy(text.host(F.col("d_url")).alias("host")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(text.official(F.col("d_url"), ("kamus.example.invalid",))).alias("official")
    )


def regulation_labels(spark: SparkSession, root: str) -> DataFrame:
    labels = _normalised(spark, root).select(F.col("d_undang_undang").alias("label")).distinct()
    r = text.regulation(F.col("label"))
    parsed = labels.select("label", r["type"].alias("type"), r["number"].alias("number"), r["year"].alias("year"))
    return parsed.select("*", text.kind_key(F.lower("type")).alias("kind_key"), text.number_key(F.col("number")).alias("number_key"))


def strip_prefixes(spark: SparkSession, root: str) -> DataFrame:
    s = text.strip_prefix(F.col("d_istilah"), F.col("d_pengertian"))
    return _normalised(spark, root).select(F.col("row").alias("entry_id"), s["text"].alias("retrieval_text"), s["removed"].alias("removed"))


def _delivered(spark: SparkSession, root: str) -> DataFrame:
    """The records of both deliveries: the glossary and its feed of JSON objects."""
    parsed = table(spark, root, "glossary_feed").select("entry_id", F.from_json("payload", ", ".join(f"{c} string" for c in curate.RAW)).alias("p"))
    rows = table(spark, root, "glossary").select("entry_id", *curate.RAW).unionByName(parsed.select("entry_id", "p.*"))
    return materialize(curate.normalised(rows))[0]


def dedupe_exact(spark: SparkSession, root: str) -> DataFrame:
    return curate.exact_groups(_delivered(spark, root)).select(F.col("row").alias("entry_id"), "duplicate_count")


def duplicate_lineage(spark: SparkSession, root: str) -> DataFrame:
    return curate.lineage(_delivered(spark, root))


def quarantine_split(spark: SparkSession, root: str) -> DataFrame:
    return _senses(spark, root).select(F.col("raw_row_number").alias("entry_id"), "sense_id", "quarantine_reason")


def quarantine_counts(spark: SparkSession, root: str) -> DataFrame:
    return curate.frequencies(curate.quarantined(_senses(spark, root)), "quarantine_reason")


def multi_sense(spark: SparkSession, root: str) -> DataFrame:
    return curate.several_senses(_senses(spark, root))


def missing_profile(spark: SparkSession, root: str) -> DataFrame:
    return curate.missing_profile(_normalised(spark, root))


def coverage_profile(spark: SparkSession, root: str) -> DataFrame:
    rates = curate.fill_rates(table(spark, root, "corpus"), ["regulation_key", "title", "chapter", "article", "content", "year", "domain"])
    return rates.select("column", F.round("rate", 4).alias("rate"))


def length_percentiles(spark: SparkSession, root: str) -> DataFrame:
    lengths = table(spark, root, "corpus").select(key("regulation_type").alias("kind"), F.length("content").alias("length"))
    return curate.nearest_rank(lengths, ["kind"], "length", {"median": 0.5, "p90": 0.9})


def frequency_tables(spark: SparkSession, root: str) -> DataFrame:
    corpus = table(spark, root, "corpus")
    parts = [curate.frequencies(corpus, c).select(F.lit(c).alias("column"), F.col(c).alias("value"), "rows") for c in ("domain", "source_dataset", "source_revision")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def aggregate_terms(spark: SparkSession, root: str) -> DataFrame:
    return _terms(spark, root).select(
        "term_id", "canonical_term", "sense_count", F.array_join("sense_ids", "|").alias("sense_ids"), "primary_label",
        F.array_join("source_labels", "|").alias("source_labels"), "definition_length", "longest_definition", "has_alias", "has_digits", "warned",
    )


# --- selection ---


def near_neighbors(spark: SparkSession, root: str) -> DataFrame:
    return select.near_neighbours(_terms(spark, root).where("not warned"), 0.5, SEED).select("left_id", "right_id", "shared", "rank")


def _chosen(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, select.Plan, list[tuple[str, str]], int]:
    """(terms, the selection, its plan, its pairs, the length of a long definition).

    A configuration would name anchors and focus terms; here they are the first by hash: of all
    terms, and of those whose sources neither the anchors nor terms of several senses have.
    """
    terms, _ = materialize(_terms(spark, root))
    eligible = terms.where("not warned")
    lengths = eligible.select(F.lit(1).alias("all"), "longest_definition")
    long_from = (curate.nearest_rank(lengths, ["all"], "longest_definition", {"p90": 0.9}).first() or {"p90": 0})["p90"]
    anchors = eligible.orderBy(ids.rank(SEED, "anchor", F.col("term_id")), "term_id").limit(QUOTAS["anchor"])
    first = select.select_by_quota(eligible, [select.Bucket("multi_sense", QUOTAS["multi_sense"], F.col("sense_count") > 1)], CAP, SEED, forced=anchors)
    free = eligible.join(F.broadcast(first.select(F.col("source").alias("primary_label")).distinct()), "primary_label", "left_anti")
    per_source = free.groupBy("primary_label").agg(F.min(F.struct(ids.rank(SEED, "focus", F.col("term_id")).alias("r"), "term_id", "normalized_term")).alias("t"))
    focus = per_source.select("t.*").orderBy("r", "term_id").limit(QUOTAS["domain_focus"])
    names = lambda df: tuple(r.normalized_term for r in df.select("normalized_term").collect())
    plan = select.Plan(QUOTAS, CAP, SEED, names(anchors), names(focus), strict=False)
    chosen, pairs = select.select_terms(eligible, plan, long_from)
    return terms, chosen, plan, pairs, long_from


def quota_select(spark: SparkSession, root: str) -> DataFrame:
    return _chosen(spark, root)[1].select("term_id", "source", "bucket")


def pair_select(spark: SparkSession, root: str) -> DataFrame:
    """Disjoint near neighbours, taken greedily under the cap, with what relates to what."""
    terms, _ = materialize(_terms(spark, root).where("not warned"))
    pairs = select.disjoint_pairs(select.near_neighbours(terms, 0.5, SEED), terms, 10, CAP)
    return select.related(spark.createDataFrame(pairs, "left_id string, right_id string"), terms)


def _pilot_terms(spark: SparkSession, root: str) -> DataFrame:
    """The chosen terms in bucket order, with all that applies to them and their near neighbours."""
    terms, chosen, plan, pairs, long_from = _chosen(spark, root)
    related = select.related(spark.createDataFrame(pairs, "left_id string, right_id string"), terms)
    picked = terms.join(F.broadcast(chosen.select("term_id", "bucket")), "term_id").join(F.broadcast(related), "term_id", "left")
    tagged = picked.withColumn("related_terms", F.coalesce("related_terms", F.lit(""))).withColumn("tags", select.tags(plan, long_from, F.col("related_terms") != ""))
    order = [F.array_position(F.array(*[F.lit(b) for b in QUOTAS]), F.col("bucket")), F.col("normalized_term"), F.col("term_id")]
    return curate.dense_index(tagged, order, "pilot_index")


def selection_tags(spark: SparkSession, root: str) -> DataFrame:
    return _pilot_terms(spark, root).select("pilot_index", "term_id", "bucket", "tags", "related_terms")


def cap_monitor(spark: SparkSession, root: str) -> DataFrame:
    """How near the selection comes to its cap."""
    counts = _chosen(spark, root)[1].groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.sum("n").alias("selected"), F.max("n").alias("most_of_a_source"), F.count(F.lit(1)).alias("sources"))


# --- evidence ---


def _pilot(spark: SparkSession, root: str) -> DataFrame:
    return materialize(_pilot_terms(spark, root))[0]


def _evidence(spark: SparkSession, root: str, titles: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    pilot = _pilot(spark, root)
    features, _ = materialize(enrich.evidence(pilot, table(spark, root, "corpus"), titles))
    return pilot, features, enrich.best(features)


def evidence_rank(spark: SparkSession, root: str) -> DataFrame:
    return _evidence(spark, root, False)[2].select("term_id", "candidate_rank", "global_id", "term_present", "exact_definition", "coverage", "title_similarity", "metadata_warnings")


def evidence_titles(spark: SparkSession, root: str) -> DataFrame:
    """The same with the similarity of titles."""
    return _evidence(spark, root, True)[2].drop("article")


def match_status(spark: SparkSession, root: str) -> DataFrame:
    return enrich.match_status(*_evidence(spark, root, False)).drop("article", "metadata_warnings")


# --- review ---


HOSTS = ("kamus.example.invalid",)


def _registry(spark: SparkSession, root: str) -> DataFrame:
    """(label_key, source_id, signal) of every regulation that the glossary names; a signal stands
    for what a portal says of a fifth of them."""
    labels = _normalised(spark, root).select(text.key("d_undang_undang").alias("label_key")).distinct()
    known = labels.withColumn("source_id", ids.stable_id("registry", F.col("label_key")))
    return known.withColumn("signal", F.when(F.substring(ids.rank(SEED, "signal", F.col("label_key")), 1, 1) < "3", "amended").otherwise("status_not_reviewed"))


def registry_signals(spark: SparkSession, root: str) -> DataFrame:
    """Registered sources by their signal."""
    return _registry(spark, root).groupBy("signal").agg(F.count(F.lit(1)).alias("sources"))


def _reviews(spark: SparkSession, root: str) -> DataFrame:
    pilot, features, ranked = _evidence(spark, root, False)
    statuses = enrich.match_status(pilot, features, ranked)
    labelled = pilot.withColumn("label_key", text.key("primary_label"))
    return materialize(review.review_rows(labelled, statuses.select("term_id", "match_status", "top_global_id", "article", "metadata_warnings"), _registry(spark, root)))[0]


def review_queue(spark: SparkSession, root: str) -> DataFrame:
    return _reviews(spark, root)


def _digit(column: str, place: int) -> Column:
    return F.substring(F.sha2(column, 256), place, 1)


def _reviewed(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """The queue and its slots as reviewers might return them, with faults by the hash of the row."""
    rows = _reviews(spark, root)
    h, d = F.sha2("review_id", 256), lambda n: _digit("review_id", n)
    sources = rows.select(
        "review_id",
        "term_id",
        "canonical_term",
        F.when(d(1) == "0", "").when(d(1) == "1", "http://kamus.example.invalid/x").when(d(1) == "2", "https://lain.example/x").otherwise(F.concat(F.lit("https://kamus.example.invalid/"), h)).alias("document_url"),
        F.when(d(2) == "0", "").when(d(2) == "1", F.upper(h)).otherwise(h).alias("document_sha256"),
        F.when(d(3) < "2", "").otherwise("Pasal 1").alias("article"),
        F.when(d(4) < "2", " ").otherwise(F.col("canonical_term")).alias("definition"),
        F.when(d(5) < "2", "other").otherwise("exact").alias("comparison"),
        F.when(d(6) < "2", "").otherwise("r1").alias("reviewer_id"),
        F.when(d(7) == "0", "kemarin").when(d(7) == "1", "").otherwise("2024-05-06T07:08:09Z").alias("reviewed_at"),
        F.when(d(8) == "0", "unknown").when(d(8) < "c", "verified").otherwise("pending_human_review").alias("review_status"),
    )
    slots = review.slots(rows, 5, review.locked(rows, 20, SEED)).join(rows.select("term_id", "canonical_term"), "term_id")
    g = lambda n: _digit("query_id", n)
    gold = slots.select(
        "query_id",
        F.when(g(1) == "0", "none").otherwise(F.col("term_id")).alias("term_id"),
        F.when(g(2) == "0", "none").otherwise(F.col("term_id")).alias("expected_term_id"),
        F.when(g(3) == "0", "none").otherwise(F.col("review_id")).alias("review_id"),
        "canonical_term",
        F.when(g(4) == "0", "").when(g(4) == "1", F.concat(F.lit("Apa arti "), F.upper("canonical_term"), F.lit("?"))).otherwise("Apa sebutan hal itu?").alias("query_text"),
        F.when(g(5) == "0", "").otherwise("a1").alias("author_id"),
        F.when(g(6) == "0", "").otherwise("r1").alias("reviewer_id"),
        F.when(g(7) == "0", "besok").otherwise("2024-05-06").alias("reviewed_at"),
        F.when(g(8) == "0", "unknown").when(g(8) < "c", "approved").otherwise("pending_human_review").alias("review_status"),
    )
    return sources, gold


def validate_sources(spark: SparkSession, root: str) -> DataFrame:
    return review.validate_sources(_reviewed(spark, root)[0], HOSTS)


def validate_gold(spark: SparkSession, root: str) -> DataFrame:
    sources, gold = _reviewed(spark, root)
    return review.validate_gold(gold, sources)


def gold_slots(spark: SparkSession, root: str) -> DataFrame:
    rows = _reviews(spark, root)
    return review.slots(rows, 5, review.locked(rows, 20, SEED))


def locked_split(spark: SparkSession, root: str) -> DataFrame:
    return review.locked(_pilot(spark, root), 20, SEED)


def validate_rules(spark: SparkSession, root: str) -> DataFrame:
    corpus, qa = table(spark, root, "corpus"), table(spark, root, "qa_sft")
    blank = lambda c: key(c).isNull()
    a = review.violations(
        corpus,
        "corpus",
        "global_id",
        [
            review.Rule("content_missing", blank("content")),
            review.Rule("key_missing", key("regulation_key").isNull()),
            review.Rule("year_invalid", ~F.coalesce(F.col("year"), F.lit("")).rlike(r"^(19|20)\d{2}\z")),
            review.Rule("chunk_out_of_range", F.col("chunk_index") >= F.col("chunk_count")),
            review.Rule("hash_invalid", ~F.coalesce(F.col("content_hash"), F.lit("")).rlike(r"^[0-9a-f]{32}\z")),
        ],
    )
    b = review.violations(qa, "qa_sft", "id", [review.Rule("prompt_missing", blank("prompt")), review.Rule("completion_missing", blank("completion")), review.Rule("split_unknown", ~F.col("split").isin("train", "validation", "test"))])
    keyed = qa.select("id", key("regulation_key").alias("k")).where("k is not null and not startswith(k, 'answer:')")
    c = review.orphans(keyed, "qa_sft", "id", "k", corpus.select(key("regulation_key").alias("k")).where("k is not null"), "regulation_not_in_corpus")
    d = review.repeated(corpus.select("global_id", "content_hash"), "corpus", "global_id", "content_hash", "content_repeated")
    return a.unionByName(b).unionByName(c).unionByName(d)


def set_ops(spark: SparkSession, root: str) -> DataFrame:
    """Keys that only one of the tables has."""
    a, b = (table(spark, root, t).select(key("regulation_key").alias("k")).where("k is not null") for t in ("qa_sft", "corpus"))
    return review.set_difference(a, b, "k").select(F.col("k").alias("regulation_key"), "side")


def union_queue(spark: SparkSession, root: str) -> DataFrame:
    """One queue of what needs a look: quarantined records and terms with several senses."""
    senses, _ = materialize(_senses(spark, root))
    a = curate.quarantined(senses).select("term_id", F.col("quarantine_reason").alias("queue_reason"))
    return a.unionByName(curate.several_senses(senses).select("term_id", F.lit("several_senses").alias("queue_reason"))).distinct()


# --- cases and retrieval ---

LIMITS = {True: 100, False: 25}


def _available(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    chunks = retrieve.corpus_pairs(table(spark, root, "corpus"))
    asked = retrieve.asked_pairs(table(spark, root, "qa_sft").where("split = 'test'"))
    return retrieve.with_availability(asked, chunks), chunks


def covered_missing(spark: SparkSession, root: str) -> DataFrame:
    return _available(spark, root)[0].groupBy("available").agg(F.count(F.lit(1)).alias("pairs"))


def _cases(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    cases, chunks = _available(spark, root)
    kept, _ = materialize(retrieve.priority_sample(cases, LIMITS, SEED))
    return kept, chunks


def scan_counters(spark: SparkSession, root: str) -> DataFrame:
    """What each gate leaves of the test questions, in one scan."""
    qa = table(spark, root, "qa_sft").where("split = 'test'").select("prompt", "completion", text.key("regulation_key").alias("k"), text.article_number(text.key("prompt")).alias("a"))
    keyed = text.regulation_key(F.col("k")).isNotNull()
    kept = keyed & F.col("a").isNotNull() & (F.length(F.trim("completion")) >= 20)
    return qa.agg(F.count(F.lit(1)).alias("rows"), F.count_if(keyed).alias("with_key"), F.count_if(F.col("a").isNotNull()).alias("with_article"), F.count_if(kept).alias("kept"))


def priority_sample(spark: SparkSession, root: str) -> DataFrame:
    return _cases(spark, root)[0].select("case_id", "id", "pair_key", "pair_article", "available", "priority")


def unique_sample(spark: SparkSession, root: str) -> DataFrame:
    return retrieve.unique_sample(table(spark, root, "qa_sft"), F.coalesce(key("answer_hash"), F.lit("")), 200, SEED)


def retrieve_topk(spark: SparkSession, root: str) -> DataFrame:
    return retrieve.retrieve(*_cases(spark, root)).select("case_id", "place", "id", "overlap", "candidates")


def retrieval_coverage(spark: SparkSession, root: str) -> DataFrame:
    """The share of each sampled case's chunks that were retrieved: those without a chunk of their
    pair are not found and covered by 0."""
    cases, chunks = _cases(spark, root)
    return retrieve.coverage(cases, retrieve.retrieve(cases, chunks))


def _asked_cases(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """The evaluation cases by the regulation and article they expect, and their hits."""
    identity = text.key(F.concat_ws("|", "expected_regulation_type", "expected_regulation_number", F.col("expected_year").cast("string")))
    cases = table(spark, root, "eval_cases").withColumns({"pair_key": identity, "pair_article": text.article_number(text.key("expected_article"))})
    cases, _ = materialize(cases)
    hits, _ = materialize(retrieve.retrieve(cases, retrieve.corpus_pairs(table(spark, root, "corpus"))))
    return cases, hits


def case_prompts(spark: SparkSession, root: str) -> DataFrame:
    """The instruction for each case with the chunks of its expected regulation and article, retrieved and packed."""
    cases, hits = _asked_cases(spark, root)
    contexts = retrieve.with_missing(cases, retrieve.pack(hits))
    return cases.join(contexts, "case_id").select("case_id", retrieve.instruction(F.col("prompt"), F.col("context")).alias("instruction"))


def context_pack(spark: SparkSession, root: str) -> DataFrame:
    cases, chunks = _cases(spark, root)
    return retrieve.with_missing(cases, retrieve.pack(retrieve.retrieve(cases, chunks)))


def context_render(spark: SparkSession, root: str) -> DataFrame:
    cases, chunks = _cases(spark, root)
    return retrieve.with_missing(cases, retrieve.render(retrieve.retrieve(cases, chunks)))


def title_collisions(spark: SparkSession, root: str) -> DataFrame:
    found = retrieve.title_collisions(retrieve.corpus_pairs(table(spark, root, "corpus")))
    return found.select("pair_key", "pair_article", "titles", "chunks", F.array_join("examples", "|").alias("examples"))


def _words(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    cases = table(spark, root, "eval_cases").select(F.col("case_id").alias("query_id"), tokens.content_words(text.key("prompt")).alias("words"))
    return cases, table(spark, root, "corpus").select(F.col("global_id").alias("doc_id"), tokens.content_words(text.key("content")).alias("words"))


def _bm25(spark: SparkSession, root: str, top: int = 5) -> DataFrame:
    cases, chunks = _words(spark, root)
    return retrieve.bm25(cases, chunks, top)


def bm25_topk(spark: SparkSession, root: str) -> DataFrame:
    return _bm25(spark, root).select("query_id", "doc_id", F.round("score", 6).alias("score"))


def vector_topk(spark: SparkSession, root: str) -> DataFrame:
    return retrieve.nearest_vectors(table(spark, root, "embeddings")).select("query_id", "doc_id", F.round("score", 6).alias("score"))


def _gold(spark: SparkSession, root: str) -> DataFrame:
    """The chunks of the regulation and article that each in-scope case expects."""
    cases = table(spark, root, "eval_cases").where("not out_of_scope")
    wanted = cases.select(F.col("case_id").alias("query_id"), F.concat_ws("|", F.lower("expected_regulation_type"), "expected_regulation_number", F.col("expected_year").cast("string")).alias("k"), text.article_number(text.key("expected_article")).alias("a"))
    chunks = table(spark, root, "corpus").select(F.col("global_id").alias("doc_id"), key("regulation_key").alias("k"), text.article_number(text.key("article")).alias("a"))
    return chunks.join(F.broadcast(wanted), ["k", "a"]).select("query_id", "doc_id")


def hybrid_topk(spark: SparkSession, root: str) -> DataFrame:
    """Exact identity and lexical order, both whole, fused by rank."""
    cases, chunks = _words(spark, root)
    lexical = retrieve.ranked(retrieve.bm25_scores(cases, chunks))
    exact = retrieve.ranked(_gold(spark, root).withColumn("score", F.lit(1.0)))
    return retrieve.fuse(lexical, exact).select("query_id", "doc_id", "place", F.round("score", 6).alias("score"))


def ranking_quality(spark: SparkSession, root: str) -> DataFrame:
    """Recall and reciprocal rank of the lexical ranking, and how often it answers what has no answer."""
    ranked, _ = materialize(_bm25(spark, root))
    found = retrieve.ranking_quality(ranked, _gold(spark, root))
    none = table(spark, root, "eval_cases").where("out_of_scope").select(F.col("case_id").alias("query_id"))
    wrong = retrieve.false_answers(ranked, none, 20.0).first()
    return found.select(
        "queries", F.round("recall", 6).alias("recall"), F.round("mrr", 6).alias("mrr"),
        F.lit(wrong.no_answer_queries).alias("no_answer_queries"), F.round(F.lit(wrong.false_positive_rate), 6).alias("false_positive_rate"),
    )


def fuzzy_terms(spark: SparkSession, root: str) -> DataFrame:
    """Near neighbours of which one is at most three edits from the other."""
    terms, _ = materialize(_terms(spark, root).where("not warned"))
    pairs = select.near_neighbours(terms, 0.5, SEED).select("left_id", "right_id")
    a, b = terms.select(F.col("term_id").alias("left_id"), F.col("normalized_term").alias("a")), terms.select(F.col("term_id").alias("right_id"), F.col("normalized_term").alias("b"))
    edits = F.levenshtein("a", "b", 3)
    return pairs.join(a, "left_id").join(b, "right_id").select("left_id", "right_id", edits.alias("edits")).where("edits >= 0")


def fuzzy_pairs(spark: SparkSession, root: str) -> DataFrame:
    """All terms of which one is at most three edits from the other, whatever words they share."""
    return select.within_edits(_terms(spark, root).where("not warned"))


# --- answers ---


def answer_metrics(spark: SparkSession, root: str) -> DataFrame:
    """The completion scored against its prompt, for every pair."""
    rows = table(spark, root, "qa_sft").select("id", "prompt", "completion")
    m = compare.scored(rows, "completion", "prompt", "prompt")
    r6 = lambda c: F.round(f"metrics.{c}", 6).alias(c)
    return m.select("id", r6("precision"), r6("recall"), r6("f1"), r6("marker_recall"), r6("grounded"), r6("repeated"), "metrics.abstains", "metrics.cites")


def anchor_hits(spark: SparkSession, root: str) -> DataFrame:
    cases = table(spark, root, "eval_cases").withColumn("place", F.sequence(F.lit(0), F.greatest(F.size("anchors") - 1, F.lit(0))))
    each = table(spark, root, "eval_cases").select("case_id", F.explode("anchors").alias("a")).select("case_id", text.key("a").alias("a")).groupBy("case_id").agg(F.collect_list("a").alias("anchors"))
    joined = cases.select("case_id", text.key("reference_answer").alias("answer")).join(each, "case_id", "left")
    return joined.select("case_id", F.round(tokens.anchor_recall(F.col("answer"), F.coalesce("anchors", F.array().cast("array<string>"))), 6).alias("anchor_recall"))


def case_scores(spark: SparkSession, root: str) -> DataFrame:
    """Screening and grounding scores of the reference answers, against the prompt and the contents retrieved."""
    cases, hits = _asked_cases(spark, root)
    contents = hits.groupBy("case_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", text.plain("content").alias("t")))), lambda x: x["t"]), "\n").alias("context"))
    joined = cases.join(contents, "case_id", "left").withColumn("hit", F.col("context").isNotNull())
    m = compare.scored(joined, "reference_answer", "prompt", "context").join(anchor_hits(spark, root), "case_id")
    return m.select(
        "case_id",
        "hit",
        tokens.screening_score(F.col("metrics.f1"), F.coalesce("anchor_recall", F.lit(0.0)), F.col("metrics.abstains"), F.col("out_of_scope")).alias("screening"),
        tokens.grounding_score(F.col("metrics.grounded"), F.col("hit"), F.col("metrics.cites"), F.col("metrics.abstains"), F.col("out_of_scope")).alias("grounding"),
    )


def asked_identities(spark: SparkSession, root: str) -> DataFrame:
    """The regulation and article that each prompt names."""
    p = F.col("prompt")
    r = text.asked_regulation(p)
    return table(spark, root, "qa_sft").select("id", r["kind"].alias("kind"), r["number"].alias("number"), r["year"].alias("year"), text.asked_article(p).alias("article"))


def clean_answers(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "qa_sft")
    return rows.select("id", text.clean_answer(F.col("completion")).alias("answer"), text.mark_count(F.col("completion")).alias("marks"))


def chat_messages(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "qa_sft").select("id", F.posexplode(text.messages(F.col("prompt"), F.col("completion"))).alias("place", "m"))
    return rows.select("id", "place", "m.role", "m.content")


def _conditions(spark: SparkSession, root: str) -> DataFrame:
    """Each case answered without and with retrieval: by its prompt, and by the best chunk."""
    cases, chunks = _cases(spark, root)
    hits = retrieve.retrieve(cases, chunks, 1).select("case_id", "content")
    with_hits = cases.select("case_id", "prompt", "reference", "available").join(hits, "case_id", "left")
    both = [with_hits.select("case_id", "reference", "available", F.lit(n).alias("label"), F.coalesce(c, F.lit("")).alias("answer")) for n, c in (("without", "prompt"), ("with", "content"))]
    scored = compare.scored(both[0].unionByName(both[1]), "answer", "reference")
    return materialize(scored)[0]


def condition_summary(spark: SparkSession, root: str) -> DataFrame:
    s = compare.summary(_conditions(spark, root), "label")
    return s.select("label", "cases", "errors", *[F.round(c, 6).alias(c) for c in ("mean_f1", "median_f1", "mean_marker_recall", "mean_repeated", "abstention_rate")], "repetitive")


def paired_delta(spark: SparkSession, root: str) -> DataFrame:
    rows = _conditions(spark, root).where("available").select("case_id", "label", "metrics.f1")
    p = compare.paired(rows.where("label = 'without'"), rows.where("label = 'with'"), "case_id", "f1")
    return p.select("pairs", "wins", "losses", "ties", *[F.round(c, 6).alias(c) for c in ("win_rate", "mean_delta", "median_delta")])


def delta_extremes(spark: SparkSession, root: str) -> DataFrame:
    """The cases that retrieval helps and hurts most."""
    rows = _conditions(spark, root).where("available").select("case_id", "label", "metrics.f1")
    return compare.extremes(rows.where("label = 'without'"), rows.where("label = 'with'"), "case_id", "f1").withColumn("delta", F.round("delta", 6))


def wide_conditions(spark: SparkSession, root: str) -> DataFrame:
    """One row per case with both conditions beside each other."""
    rows = _conditions(spark, root)
    by_label = {n: rows.where(F.col("label") == n).select("case_id", F.round("metrics.f1", 6).alias("f1"), "metrics.abstains") for n in ("without", "with")}
    return compare.wide(rows.select("case_id", "available").distinct(), by_label, "case_id")


def uniqueness(spark: SparkSession, root: str) -> DataFrame:
    """Values that should be unique and aren't."""
    return curate.repeated_keys(table(spark, root, "corpus"), "content_hash").select("content_hash", "rows")


def split_counts(spark: SparkSession, root: str) -> DataFrame:
    """Rows, keys and answers per split."""
    return table(spark, root, "qa_sft").groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(key("regulation_key").isNull()).alias("without_key"), F.countDistinct(key("answer_hash")).alias("answers")
    )


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_keys, p1_answers, p5_found, p5_loaded, p5_reasons, normalize_text, stable_ids, url_hosts, regulation_labels, strip_prefixes,
        dedupe_exact, duplicate_lineage, quarantine_split, quarantine_counts, multi_sense, missing_profile, coverage_profile, length_percentiles,
        frequency_tables, aggregate_terms, near_neighbors, quota_select, selection_tags, cap_monitor, pair_select, evidence_rank, evidence_titles, match_status, review_queue, registry_signals, validate_sources, validate_gold,
        gold_slots, locked_split, validate_rules, set_ops, union_queue, covered_missing, scan_counters, priority_sample, unique_sample, retrieve_topk, retrieval_coverage,
        case_prompts, context_pack,
        context_render, title_collisions, bm25_topk, vector_topk, hybrid_topk, ranking_quality, fuzzy_terms, fuzzy_pairs, answer_metrics, anchor_hits, case_scores,
        asked_identities, clean_answers, chat_messages, condition_summary, paired_delta, delta_extremes, wide_conditions, split_counts, uniqueness,
    )
}
