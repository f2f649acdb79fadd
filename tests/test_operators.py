import random

import pytest
from conftest import SMALL, rows_of
from pyspark.sql import functions as F

from lontar.operators import curate, enrich, retrieve, review, select
from lontar.runtime import table

RAW = "entry_id long, istilah string, pengertian string, undang_undang string, uu string, url string, status string"
LAW = "Undang-Undang Nomor 1 Tahun 2000"


def glossary(spark):
    return spark.createDataFrame(
        [
            (2, "Izin", "Izin adalah surat.", LAW, "Hukum", "https://x.id/a", "OK"),
            (3, " izin ", "IZIN adalah  surat.", LAW, "Hukum", "https://x.id/a", "ok"),
            (4, "Izin", "Izin adalah persetujuan 5 hari.", LAW, "Hukum", "https://x.id/b", "OK"),
            (5, "Pajak", "Pajak, yang selanjutnya disebut P, adalah iuran.", LAW, "Hukum", None, "OK"),
            (6, "Draf", "Draf adalah naskah.", "RUU", "", None, "UU/JUDUL TIDAK DITEMUKAN"),
        ],
        RAW,
    )


def test_audit_counts(spark):
    rows = curate.normalised(glossary(spark))
    records = curate.senses(curate.unique_rows(rows)).cache()
    assert records.count() == 4
    assert rows_of(curate.lineage(rows)) == [(3, 2)]
    assert curate.curated(records).count() == 3
    assert [r.quarantine_reason for r in curate.quarantined(records).collect()] == ["source_unverified"]
    assert [r.canonical_term for r in curate.several_senses(records).collect()] == ["Izin"]
    terms = {r.canonical_term: r for r in curate.terms(curate.curated(records)).collect()}
    assert terms["Izin"].sense_count == 2 and terms["Izin"].has_digits and terms["Pajak"].has_alias


def test_empty_glossary(spark):
    rows = curate.normalised(spark.createDataFrame([], RAW))
    records = curate.senses(curate.unique_rows(rows))
    assert rows_of(records) == [] and rows_of(curate.terms(records)) == [] and rows_of(curate.lineage(rows)) == []


def test_nearest_rank_halves_to_even(spark):
    df = spark.createDataFrame([("a", x) for x in (10, 20, 30, 40)] + [("b", 5)], "k string, v int")
    assert rows_of(curate.nearest_rank(df, ["k"], "v", {"m": 0.5})) == [("a", 4, 10, 40, 30), ("b", 1, 5, 5, 5)]


@pytest.mark.parametrize("seed", range(3))
def test_selection_equals_the_loop(spark, seed):
    import hashlib

    rng = random.Random(seed)
    rows = [(f"t{i}", f"s{rng.randrange(5)}", rng.random() < 0.3, True) for i in range(60)]
    df = spark.createDataFrame(rows, "term_id string, primary_label string, odd boolean, any boolean")
    buckets = [select.Bucket("first", 4, F.col("odd")), select.Bucket("rest", 7, F.col("any"))]
    got = {(r.term_id, r.bucket) for r in select.select_by_quota(df.repartition(5), buckets, 3, "z").collect()}
    chosen, counts = {}, {}
    for name, quota, at in (("first", 4, 2), ("rest", 7, 3)):
        for t in sorted(rows, key=lambda r: hashlib.sha256(f"z\x1f{name}\x1f{r[0]}".encode()).hexdigest()):
            if sum(b == name for b in chosen.values()) < quota and t[at] and t[0] not in chosen and counts.get(t[1], 0) < 3:
                chosen[t[0]] = name
                counts[t[1]] = counts.get(t[1], 0) + 1
    assert got == set(chosen.items())


def test_near_neighbours_lose_nothing(spark):
    from lontar.functions.tokens import TERM_STOPWORDS

    rng = random.Random(4)
    words = "izin pajak gudang lahan dana tarif segel benih yang".split()
    terms = [(f"t{i:03}", " ".join(rng.sample(words, rng.randrange(1, 5)))) for i in range(120)]
    got = {(r.left_id, r.right_id) for r in select.near_neighbours(spark.createDataFrame(terms, "term_id string, normalized_term string"), 0.5, "z").collect()}
    sets = {t: {w for w in x.split() if w not in TERM_STOPWORDS} for t, x in terms}
    wanted = {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])}
    assert got == wanted


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_within_edits_loses_nothing(spark):
    rng = random.Random(6)
    terms = {"".join(rng.choice("abé") for _ in range(rng.randrange(1, 14))) for _ in range(150)} | {"arsip khusus", "tarif khusus", "izin", "izn", "a", "ab"}
    for t in ("surat izin gudang", "pajak bumi"):
        for _ in range(15):
            cut = list(t)
            for _ in range(rng.randrange(1, 5)):
                at = rng.randrange(len(cut))
                cut[at : at + rng.randrange(2)] = rng.choice(("", "x", "y"))
            terms.add("".join(cut))
    rows = [(f"t{i:03}", t) for i, t in enumerate(sorted(terms))]
    wanted = [(a, b, edits(x, y)) for a, x in rows for b, y in rows if a < b and edits(x, y) <= 3]
    df = spark.createDataFrame(rows, "term_id string, normalized_term string").repartition(5)
    assert rows_of(select.within_edits(df)) == sorted(wanted, key=repr)
    names = {t: i for i, t in rows}
    assert len(wanted) > 300 and (names["arsip khusus"], names["tarif khusus"]) in {w[:2] for w in wanted}


def test_disjoint_pairs(spark):
    pairs = spark.createDataFrame([("a", "b", 1.0, "1"), ("b", "c", 0.9, "2"), ("c", "d", 0.8, "3")], "left_id string, right_id string, score double, rank string")
    sources = spark.createDataFrame([(x, "s") for x in "abcd"], "term_id string, primary_label string")
    assert select.disjoint_pairs(pairs, sources, 10, 4) == [("a", "b"), ("c", "d")]
    assert select.disjoint_pairs(pairs, sources, 10, 2) == [("a", "b")]
    assert select.disjoint_pairs(pairs, sources, 2, 4) == [("a", "b")]


TERM = "term_id string, normalized_term string, primary_label string, sense_count int, has_alias boolean, has_digits boolean, longest_definition int"


def chosen_by_loop(terms, plan, long_from, pairs):
    """The selection as one loop over shared state."""
    import hashlib

    sha = lambda *parts: hashlib.sha256("\x1f".join(parts).encode()).hexdigest()
    out, counts = {}, {}

    def add(t, bucket, force=False):
        if t[0] in out or not force and counts.get(t[2], 0) >= plan.cap:
            return False
        out[t[0]] = bucket
        counts[t[2]] = counts.get(t[2], 0) + 1
        return True

    by_name, by_id = {t[1]: t for t in terms}, {t[0]: t for t in terms}
    for a in plan.anchors:
        add(by_name[a], "anchor", True)
    rules = {"multi_sense": lambda t: t[3] > 1, "alias": lambda t: t[4], "numeric": lambda t: t[5], "long_definition": lambda t: t[6] >= long_from, "typical_fill": lambda t: True, "fallback": lambda t: True}

    def fill(bucket, quota, name=None):
        for t in sorted(filter(rules[bucket], terms), key=lambda t: (sha(plan.seed, bucket, t[0]), t[0])):
            if sum(b == bucket for b in out.values()) >= quota:
                break
            add(t, bucket)

    fill("multi_sense", plan.quotas["multi_sense"])
    for f in plan.focus:
        assert add(by_name[f], "domain_focus")
    for _, _, a, b in sorted((-s, sha(plan.seed, "near_neighbor", a + b), a, b) for a, b, s in pairs):
        if sum(x == "near_neighbor" for x in out.values()) >= plan.quotas["near_neighbor"]:
            break
        need = {by_id[a][2]: 1}
        need[by_id[b][2]] = need.get(by_id[b][2], 0) + 1
        if a in out or b in out or any(counts.get(k, 0) + n > plan.cap for k, n in need.items()):
            continue
        add(by_id[a], "near_neighbor")
        add(by_id[b], "near_neighbor")
    for bucket in select.RANKED:
        fill(bucket, plan.quotas[bucket])
    fill("fallback", plan.target - len(out))
    return {t: "typical_fill" if b == "fallback" else b for t, b in out.items()}


def test_whole_selection_equals_the_loop(spark):
    import random

    rng = random.Random(4)
    words = [f"kata{c}" for c in "abcdefghij"]
    terms = [(f"t{i:02}", " ".join(rng.sample(words, 2)) + f" {'x' * (i + 2)}", f"L{rng.randrange(14)}", rng.randrange(1, 3), rng.random() < 0.3, rng.random() < 0.3, rng.randrange(100)) for i in range(60)]
    df = spark.createDataFrame(terms, TERM).repartition(3)
    plan = select.Plan({"anchor": 2, "multi_sense": 4, "domain_focus": 2, "near_neighbor": 6, "alias": 4, "numeric": 4, "long_definition": 3, "typical_fill": 5}, 3, "s", (terms[0][1], terms[1][1]), (), 0.5)
    used = {terms[0][2], terms[1][2]}
    free = [t for t in terms[2:] if t[2] not in used and t[3] == 1]
    plan = select.Plan(plan.quotas, 3, "s", plan.anchors, (free[0][1], next(t[1] for t in free if t[2] != free[0][2])), 0.5)
    chosen, pairs = select.select_terms(df, plan, 80)
    near = [(r.left_id, r.right_id, r.score) for r in select.near_neighbours(df, 0.5, "s").collect()]
    assert {r.term_id: r.bucket for r in chosen.collect()} == chosen_by_loop(terms, plan, 80, near)
    assert len(pairs) == 3
    with pytest.raises(ValueError, match="anchors not available"):
        select.select_terms(df, select.Plan(plan.quotas, 3, "s", ("tiada",)), 80)
    with pytest.raises(ValueError, match="focus term"):
        select.select_terms(df, select.Plan(plan.quotas, 3, "s", plan.anchors, (plan.anchors[0],)), 80)
    with pytest.raises(RuntimeError, match="terms, not"):
        select.select_terms(df, select.Plan(plan.quotas | {"typical_fill": 500}, 3, "s"), 80)
    few, _ = select.select_terms(df.limit(0), select.Plan(plan.quotas, 3, "s", strict=False), 0)
    assert few.count() == 0


def test_registry_and_evidence_rules(spark):
    terms = spark.createDataFrame([("t", "uu 1")], "term_id string, label_key string")
    with pytest.raises(ValueError, match="lacks"):
        review.with_registry(terms, spark.createDataFrame([("uu 2", "s")], "label_key string, source_id string"))
    names = "review_id string, term_id string, document_url string, document_sha256 string, article string, definition string, comparison string, reviewer_id string, reviewed_at string, review_status string"
    good = ("r1", "t1", "https://a.example/x", "0" * 64, "Pasal 1", "arti", "exact", "me", "2024-01-01T00:00:00Z", "verified")
    rows = [good, ("r2", "t2", None, None, None, None, None, None, None, "verified"), ("r3", "t3", None, None, None, None, None, None, None, "pending_human_review"), ("r4", "t2", *good[2:9], "?")]
    sources = spark.createDataFrame(rows, names)
    found = rows_of(review.validate_sources(sources, ("a.example",)).select("row", "code"))
    assert [c for r, c in found if r == "r2"] == ["article_missing", "comparison_not_accepted", "definition_missing", "document_sha256_invalid", "document_url_missing", "reviewed_at_invalid", "reviewer_missing"]
    assert [x for x in found if x[0] != "r2"] == [("r4", "status_unknown"), ("r4", "term_repeated")]
    fields = "query_id string, term_id string, expected_term_id string, review_id string, canonical_term string, query_text string, author_id string, reviewer_id string, reviewed_at string, review_status string"
    gold = spark.createDataFrame([("q1", "t1", "t1", "r1", "Izin", "Apa itu?", "a", "b", "2024-01-01", "approved"), ("q2", "t1", "t2", "r2", "Izin", "apa IZIN itu?", "a", "b", "2024-01-01", "approved"), ("q3", "zz", "zz", "nope", "Izin", None, None, None, None, "approved"), ("q4", "t1", "t1", "r3", "Izin", "x", "a", "b", "2024-01-01", "approved"), ("q5", "t1", "t1", None, "", None, None, None, None, "rejected")], fields)
    found = rows_of(review.validate_gold(gold, sources).select("row", "code"))
    assert found == [("q2", "expected_term_differs"), ("q2", "text_leaks_term"), *[("q3", c) for c in ("author_missing", "reviewed_at_invalid", "reviewer_missing", "source_unknown", "term_unknown", "text_missing")], ("q4", "source_not_verified")]


def test_shared_folder_is_asked_for_on_a_cluster():
    from types import SimpleNamespace

    from lontar.runtime import shared_dir

    def cluster(master, folder):
        conf = SimpleNamespace(get=lambda k, d=None: folder)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: conf))

    assert shared_dir(cluster("spark://x:7077", "hdfs:///shared/")) == "hdfs:///shared"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(cluster("spark://x:7077", None))


def test_statuses(spark):
    records = curate.senses(curate.unique_rows(curate.normalised(glossary(spark))))
    terms = curate.terms(curate.curated(records))
    corpus = spark.createDataFrame([(1, "Pasal 1", "Hukum", "UU", "01", "2000", "Pajak, yang selanjutnya disebut P, adalah iuran.")], "global_id long, article string, title string, regulation_type string, regulation_number string, year string, content string")
    features = enrich.evidence(terms, corpus).cache()
    status = {r.term_id: r.match_status for r in enrich.match_status(terms, features, enrich.best(features)).collect()}
    names = {r.term_id: r.canonical_term for r in terms.collect()}
    assert {names[k]: v for k, v in status.items()} == {"Izin": "term_not_found_in_regulation", "Pajak": "candidate_exact_definition"}


def test_contracts(spark):
    a, b = spark.createDataFrame([("x",), ("y",)], "t string"), spark.createDataFrame([("x",), ("z",)], "t string")
    assert rows_of(review.set_difference(a, b, "t")) == [("y", "left"), ("z", "right")]
    with pytest.raises(ValueError, match="differs"):
        review.require_same(a, b, "t")
    with pytest.raises(ValueError, match="repeats"):
        review.require_same(a.union(a), a, "t")
    bad = review.violations(a, "a", "t", [review.Rule("is_y", F.col("t") == "y")])
    assert rows_of(bad) == [("a", "y", "is_y")]
    with pytest.raises(ValueError, match="row y: is_y"):
        review.raise_if_any(bad)
    assert rows_of(review.repeated(a.union(a).withColumn("n", F.monotonically_increasing_id()), "a", "n", "t", "twice")).__len__() == 2
    assert rows_of(review.orphans(a, "a", "t", "t", b, "lost")) == [("a", "y", "lost")]


def test_pack_cuts_and_stops(spark):
    hits = spark.createDataFrame([("c", i, "x" * 300, "UU", "1", "2000", "T", "Pasal 1", 0, 1) for i in (1, 2, 3)], "case_id string, place int, content string, regulation_type string, regulation_number string, year string, title string, article string, chunk_index int, chunk_count int")
    full = retrieve.pack(hits, 10_000, 5_000).first()
    assert not full.truncated and full.context.count("[C") == 3
    cut = retrieve.pack(hits, 10_000, 100).first()
    assert cut.truncated and cut.context.count("x" * 100) == 3 and cut.context.endswith("[CONTEXT_TRUNCATED]")
    stopped = retrieve.pack(hits, 500, 5_000).first()
    assert stopped.truncated and "[C3]" not in stopped.context
    assert len(stopped.context) <= 500 + len("\n\n[CONTEXT_TRUNCATED]")


def test_contexts_hold_the_whole_hits(spark):
    from lontar.functions import text
    from lontar.plans import queries

    hits = retrieve.retrieve(*queries._cases(spark, SMALL)).select("case_id", text.plain("content").alias("content"))
    rows = hits.join(queries.context_pack(spark, SMALL), "case_id").collect()
    assert any(len(r.content) > 200 for r in rows)
    assert all(r.content in r.context and not r.truncated for r in rows)


def test_cases_without_hits_stay(spark):
    from lontar.plans import queries

    cases = {r.case_id: r.available for r in queries._cases(spark, SMALL)[0].collect()}
    assert not all(cases.values())
    for query in (queries.context_pack, queries.context_render):
        contexts = {r.case_id: r.context for r in query(spark, SMALL).collect()}
        assert {c: not x.startswith("[NO_CONTEXT]") for c, x in contexts.items()} == cases
    status = {r.case_id: tuple(r)[1:] for r in queries.retrieval_coverage(spark, SMALL).collect()}
    assert {c: s[0] == "found" for c, s in status.items()} == cases
    assert all(s == ("not_found", 0, 0, 0.0) for c, s in status.items() if not cases[c])


def test_prompts_hold_their_chunks(spark):
    from lontar.functions import text
    from lontar.plans import queries

    prompts = {r.case_id: r.instruction for r in queries.case_prompts(spark, SMALL).collect()}
    gold = queries._gold(spark, SMALL).join(table(spark, SMALL, "corpus").select(F.col("global_id").alias("doc_id"), text.plain("content").alias("content")), "doc_id").collect()
    held = {}
    for r in gold:
        held.setdefault(r.query_id, []).append(r.content in prompts[r.query_id])
    assert len(prompts) == 120 and held and all(sum(x) >= min(4, len(x)) for x in held.values())
    assert all(("[NO_CONTEXT]" in x) == (c not in held) for c, x in prompts.items())


def test_same_result_under_any_partitioning(spark):
    qa, corpus = table(spark, SMALL, "qa_sft"), table(spark, SMALL, "corpus")

    def sample(n):
        pool = retrieve.with_availability(retrieve.asked_pairs(qa.repartition(n)), retrieve.corpus_pairs(corpus.repartition(n)))
        return rows_of(retrieve.priority_sample(pool, {True: 5, False: 5}, "s").select("case_id", "id"))

    assert sample(1) == sample(7)


def test_nearest_vectors_in_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    m = np.round(rng.normal(size=(60, 4)), 2)
    m[7], m[8] = m[10], 0
    rows = [(i, [float(x) for x in m[i]]) for i in range(60)] + [(60, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    wanted = []
    for q in range(0, 60, 5):
        sims = []
        for d in range(60):
            if d != q and m[d].any():
                sims.append((-round(float(m[q] @ m[d] / np.linalg.norm(m[q]) / np.linalg.norm(m[d])), 9), d))
        wanted += [(q, d) for _, d in sorted(sims)[:3]]
    for block, per_scan in ((2, 1), (2, 3), (100, 16)):
        assert rows_of(retrieve.nearest_vectors(df, 5, 3, block, per_scan).select("query_id", "doc_id")) == sorted(wanted, key=repr)
    assert rows_of(retrieve.nearest_vectors(df.limit(0))) == []


def test_fusion_quality_and_comparison(spark):
    from lontar.operators import compare

    a = spark.createDataFrame([("q", 1, 1), ("q", 2, 2)], "query_id string, doc_id int, place int")
    b = spark.createDataFrame([("q", 2, 1), ("q", 3, 2)], "query_id string, doc_id int, place int")
    fused = retrieve.fuse(a, b, 3)
    assert [r.doc_id for r in fused.orderBy("place").collect()] == [2, 1, 3]
    gold = spark.createDataFrame([("q", 1), ("z", 9)], "query_id string, doc_id int")
    assert tuple(retrieve.ranking_quality(fused, gold).first()) == (2, 0.5, 0.25)
    rows = spark.createDataFrame([("c1", "izin pajak", "izin pajak"), ("c2", "izin", "dana"), ("c3", None, "dana")], "case_id string, answer string, reference string")
    scored = compare.scored(rows, "answer", "reference").withColumn("label", F.lit("x"))
    assert [round(r.f1, 3) for r in scored.select("metrics.f1").collect()] == [1.0, 0.0, 0.0]
    failed = scored.withColumn("metrics", compare.guarded(F.col("metrics"), F.when(F.col("case_id") == "c2", "timeout")))
    s = compare.summary(failed, "label").first()
    assert (s.cases, s.errors, s.mean_f1) == (3, 1, 0.5)
    s = compare.summary(scored, "label").first()
    assert (s.cases, s.errors, s.median_f1, s.mean_marker_recall) == (3, 0, 0.0, None)
    base = scored.select("case_id", F.lit(0.5).alias("f1"))
    p = compare.paired(base, scored.select("case_id", "metrics.f1"), "case_id", "f1").first()
    assert (p["pairs"], p["wins"], p["losses"], p["ties"], p["median_delta"]) == (3, 1, 2, 0, -0.5)
    wide = compare.wide(rows.select("case_id"), {"m": base}, "case_id")
    assert wide.columns == ["case_id", "m_f1"]


def test_hybrid_fuses_whole_rankings(spark, tmp_path):
    from lontar.plans import queries

    names = "case_id string, prompt string, out_of_scope boolean, expected_regulation_type string, expected_regulation_number string, expected_year int, expected_article string"
    spark.createDataFrame([("c", "izin gudang", False, "UU", "1", 2000, "Pasal 1")], names).write.parquet(f"{tmp_path}/eval_cases.parquet")
    # longer chunks rank lower: the 30 of the article are lexically 1st to 30th against their ids
    rows = [(i, "izin gudang" + " lahan" * (31 - i), "uu|1|2000", "Pasal 1") for i in range(1, 31)] + [(i, "izin gudang" + " lahan" * i, "uu|2|2000", "Pasal 1") for i in range(40, 60)]
    spark.createDataFrame(rows, "global_id long, content string, regulation_key string, article string").repartition(4).write.parquet(f"{tmp_path}/corpus.parquet")
    score = {i: 1 / (60 + 31 - i) + 1 / (60 + i) for i in range(1, 31)}
    wanted = sorted(score, key=lambda i: (-round(score[i], 9), i))[:5]
    got = queries.hybrid_topk(spark, str(tmp_path)).orderBy("place").collect()
    assert [r.doc_id for r in got] == wanted and [r.score for r in got] == [round(score[i], 6) for i in wanted]


def test_scores(spark):
    from lontar.functions import tokens

    df = spark.createDataFrame([(0.5, 1.0, None, False), (None, 0.0, True, True), (None, 0.0, False, True)], "f1 double, anchors double, abstained boolean, out boolean")
    got = df.select(tokens.screening_score(F.col("f1"), F.col("anchors"), F.col("abstained"), F.col("out")), tokens.grounding_score(F.col("f1"), ~F.col("out"), F.lit(True), F.col("abstained"), F.col("out")))
    assert [tuple(r) for r in got.collect()] == [(82.5, 77.5), (100.0, 100.0), (0.0, 0.0)]
