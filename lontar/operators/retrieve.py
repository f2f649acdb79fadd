"""Sampling cases, covered and missing pairs, retrieval and context packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lontar.functions import ids, text, tokens
from lontar.operators.ordered import running_sum
from lontar.runtime import materialize


def corpus_pairs(chunks: DataFrame) -> DataFrame:
    """Chunks with their (pair_key, article): keys and articles that parse."""
    k, a = text.key("regulation_key"), text.article_number(text.key("article"))
    keyed = chunks.withColumn("pair_key", k).withColumn("pair_article", a)
    return keyed.where(text.regulation_key(F.col("pair_key")).isNotNull() & F.col("pair_article").isNotNull())


def asked_pairs(questions: DataFrame, least: int = 20) -> DataFrame:
    """Questions that can be cases, with the (pair_key, article) they ask for."""
    q = questions.withColumn("pair_key", text.key("regulation_key")).withColumn("pair_article", text.article_number(text.key("prompt")))
    ok = (F.trim(F.coalesce("prompt", F.lit(""))) != "") & (F.length(F.trim(F.coalesce("completion", F.lit("")))) >= least)
    return q.where(ok & text.regulation_key(F.col("pair_key")).isNotNull() & F.col("pair_article").isNotNull())


def with_availability(asked: DataFrame, pairs: DataFrame) -> DataFrame:
    """The first question (by id) of every pair, and whether the corpus has the pair."""
    first = asked.groupBy("pair_key", "pair_article").agg(F.min_by(F.struct("id", "prompt", "completion"), "id").alias("q"))
    known = pairs.select("pair_key", "pair_article").distinct().withColumn("known", F.lit(True))
    joined = first.join(known, ["pair_key", "pair_article"], "left")
    return joined.select("pair_key", "pair_article", "q.id", "q.prompt", F.col("q.completion").alias("reference"), F.coalesce("known", F.lit(False)).alias("available"))


def priority_sample(cases: DataFrame, limits: dict[bool, int], seed: str) -> DataFrame:
    """The lowest hash priorities of each bucket, numbered from the highest of them down."""
    parts = []
    for available, limit in limits.items():
        bucket = "covered" if available else "missing"
        own = cases.where(F.col("available") == available).withColumn("priority", ids.priority(seed, bucket, F.col("pair_key"), F.col("pair_article")))
        few = own.orderBy("priority", "pair_key", "pair_article").limit(limit)
        number = F.row_number().over(Window.partitionBy("available").orderBy(F.desc("priority"), "pair_key", "pair_article"))
        parts.append(few.withColumn("case_id", F.format_string(f"qa-{bucket}-%04d", number)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def unique_sample(df: DataFrame, column: Column, limit: int, seed: str) -> DataFrame:
    """(value): a uniform sample of distinct values, the same on every run."""
    values = df.select(column.alias("value")).where("value <> ''").distinct()
    return values.orderBy(ids.rank(seed, F.col("value")), "value").limit(limit)


def retrieve(cases: DataFrame, chunks: DataFrame, top: int = 4) -> DataFrame:
    """(case_id, place, id, overlap, candidates, ...): the best chunks of each case's own pair.

    `cases` is a bounded sample: the chunks are reduced to its pairs before their text is read on.
    """
    query = cases.select("case_id", "pair_key", "pair_article", tokens.content_words(text.key("prompt")).alias("asked"))
    kept = chunks.join(F.broadcast(query), ["pair_key", "pair_article"])
    last = kept.groupBy("case_id", "id").agg(F.max_by(F.struct("global_id", "title", "article", "content", "chunk_index", "chunk_count", "regulation_type", "regulation_number", "year", "asked"), "global_id").alias("c"))
    shown = F.concat_ws(" ", text.plain("c.title"), text.plain("c.article"), text.plain("c.content"))
    overlap = F.size(F.array_intersect(F.array_distinct("c.asked"), F.array_distinct(tokens.content_words(text.key(shown)))))
    scored = last.select("case_id", "id", "c.*", overlap.alias("overlap"))
    by_case = Window.partitionBy("case_id")
    place = F.row_number().over(by_case.orderBy(F.desc("overlap"), F.coalesce("chunk_index", F.lit(0)), "id"))
    return scored.withColumn("candidates", F.count(F.lit(1)).over(by_case)).withColumn("place", place).where(F.col("place") <= top).drop("asked", "global_id")


# Fixed value: what a packed context ends with when something was left out.
CUT_MARK = "[CONTEXT_TRUNCATED]"


def pack(hits: DataFrame, budget: int = 14_000, most: int = 5_000) -> DataFrame:
    """(case_id, context, truncated): blocks in order until the characters run out."""
    # How a block names its source.
    prefix = F.concat(
        F.lit("[C"), F.col("place").cast("string"), F.lit("]\nCandidate corpus record: "), text.plain("regulation_type"), F.lit(" Nomor "),
        text.plain("regulation_number"), F.lit(" Tahun "), text.plain("year"), F.lit("\nJudul: "), text.plain("title"), F.lit("\nKetentuan: "),
        text.plain("article"), F.lit("\nChunk: "), text.plain("chunk_index"), F.lit(" dari "), text.plain("chunk_count"), F.lit("\nTeks: "),
    )
    listed = hits.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("place", prefix.alias("prefix"), text.plain("content").alias("text")))).alias("hits"))
    start = F.struct(F.array().cast("array<string>").alias("blocks"), F.lit(budget).alias("left"), F.lit(False).alias("cut"), F.lit(False).alias("stop"))

    def step(s: Column, h: Column) -> Column:
        head = F.length(h["prefix"])
        room = F.least(F.lit(most), s["left"] - head - 2)
        shown = F.substring(h["text"], F.lit(1), room)
        full = s["stop"] | (s["left"] <= head + 20)
        added = F.struct(
            F.concat(s["blocks"], F.array(F.concat(h["prefix"], shown))).alias("blocks"),
            (s["left"] - head - F.length(shown) - 2).alias("left"),
            (s["cut"] | (F.length(shown) < F.length(h["text"]))).alias("cut"),
            F.lit(False).alias("stop"),
        )
        ended = F.struct(s["blocks"].alias("blocks"), s["left"].alias("left"), F.lit(True).alias("cut"), F.lit(True).alias("stop"))
        return F.when(full, ended).otherwise(added)

    packed = listed.withColumn("s", F.aggregate("hits", start, step))
    blocks = F.when(F.col("s.cut"), F.concat("s.blocks", F.array(F.lit(CUT_MARK)))).otherwise(F.col("s.blocks"))
    return packed.select("case_id", F.array_join(blocks, "\n\n").alias("context"), F.col("s.cut").alias("truncated"))


def render(hits: DataFrame) -> DataFrame:
    """(case_id, context): all hits in full, numbered `[S n]`."""
    block = F.concat(F.lit("[S"), F.col("place").cast("string"), F.lit("]\n"), text.plain("title"), F.lit("\n"), text.plain("article"), F.lit("\n"), text.plain("content"))
    listed = hits.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("place", block.alias("b")))).alias("h"))
    return listed.select("case_id", F.array_join(F.transform("h", lambda x: x["b"]), "\n\n").alias("context"))


# Fixed value: the context of a case whose pair has no chunk.
NO_CONTEXT = "[NO_CONTEXT]\nTidak ada chunk dari candidate corpus untuk identitas peraturan dan pasal ini. Jangan menebak isi pasal."


def with_missing(cases: DataFrame, contexts: DataFrame) -> DataFrame:
    """The contexts of all cases: those without hits get `NO_CONTEXT`, which nothing was cut from."""
    filled = cases.select("case_id").join(contexts, "case_id", "left").withColumn("context", F.coalesce("context", F.lit(NO_CONTEXT)))
    return filled.withColumn("truncated", F.coalesce("truncated", F.lit(False))) if "truncated" in contexts.columns else filled


def coverage(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """(case_id, status, hits, candidates, coverage) of all cases, with or without hits."""
    found = hits.groupBy("case_id").agg(F.count(F.lit(1)).alias("hits"), F.max("candidates").alias("candidates"))
    n, of = F.coalesce("hits", F.lit(0)), F.coalesce("candidates", F.lit(0))
    return cases.select("case_id").join(found, "case_id", "left").select(
        "case_id", F.when(n > 0, "found").otherwise("not_found").alias("status"), n.alias("hits"), of.alias("candidates"), F.when(n > 0, F.round(n / of, 6)).otherwise(0.0).alias("coverage")
    )


def instruction(question: Column, context: Column) -> Column:
    """What a model is told: to answer from the context only, or with care where there is none."""
    bare = F.concat(F.lit("Jawab dengan hati-hati; nyatakan bila tidak yakin.\n\nPertanyaan:\n"), text.plain(question))
    given = F.concat(F.lit("Jawab hanya berdasarkan konteks; bila tidak memuat jawabannya, katakan demikian.\n\nKonteks:\n"), context, F.lit("\n\nPertanyaan:\n"), text.plain(question))
    return F.when(F.coalesce(context, F.lit("")) == "", bare).otherwise(given)


def title_collisions(chunks: DataFrame, shown: int = 10) -> DataFrame:
    """(pair_key, pair_article, titles, chunks, examples) of pairs under several titles."""
    titled = chunks.select("pair_key", "pair_article", F.trim("title").alias("title"), text.key("title").alias("title_key"), "global_id").where("title_key <> ''")
    spelt = titled.groupBy("pair_key", "pair_article", "title_key").agg(F.min_by("title", "global_id").alias("title"), F.count(F.lit(1)).alias("n"))
    grouped = spelt.groupBy("pair_key", "pair_article").agg(F.count(F.lit(1)).alias("titles"), F.sum("n").alias("chunks"), F.slice(F.sort_array(F.collect_set("title")), 1, shown).alias("examples"))
    return grouped.where("titles > 1")


# --- ranked retrieval over whole tables ---


def bm25(queries: DataFrame, documents: DataFrame, top: int = 5, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, doc_id, score, place) from (query_id, words) and (doc_id, words)."""
    return best(bm25_scores(queries, documents, k1, b), "query_id", "doc_id", "score", top)


def bm25_scores(queries: DataFrame, documents: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, doc_id, score) of all documents that share a word with a query.

    The queries are a stated set. The documents are read once: of each only its size and the words
    that are asked for are kept.
    """
    asked, _ = materialize(queries.select("query_id", F.explode(F.array_distinct("words")).alias("word")))
    known = [r.word for r in asked.select("word").distinct().collect()]
    kept = F.filter("words", lambda w: w.isin(known)) if known else F.array().cast("array<string>")
    sized, _ = materialize(documents.select("doc_id", F.size("words").alias("size"), kept.alias("words")))
    postings = sized.select("doc_id", "size", F.explode("words").alias("word")).groupBy("word", "doc_id", "size").agg(F.count(F.lit(1)).alias("tf"))
    postings, _ = materialize(postings)
    df = postings.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    stats = sized.agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("mean")).first()
    idf = F.log(1 + (F.lit(stats.n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / F.lit(stats.mean or 1.0)))
    terms = F.broadcast(asked.join(F.broadcast(df), "word"))
    return postings.join(terms, "word").groupBy("query_id", "doc_id").agg(F.sum(weight).alias("score"))


def best(scored: DataFrame, query: str, doc: str, score: str, top: int) -> DataFrame:
    # sums of the same terms may differ in their last bits with the order of summing
    place = F.row_number().over(Window.partitionBy(query).orderBy(F.desc(F.round(score, 9)), doc))
    return scored.withColumn("place", place).where(F.col("place") <= top)


def ranked(scored: DataFrame) -> DataFrame:
    """(query_id, doc_id, place) of every scored document, in the order of `best`; a query may have
    more documents than one task could sort."""
    ordered = scored.select("query_id", "doc_id", (-F.round("score", 9)).alias("worse"))
    return running_sum(ordered, ["query_id"], ["worse", "doc_id"], F.lit(1), "place").select("query_id", "doc_id", "place")


def nearest_vectors(vectors: DataFrame, every: int = 50, top: int = 5, block: int = 4096, per_scan: int = 16) -> DataFrame:
    """(query_id, doc_id, score, place): queries are the rows whose id is divisible by `every`, against all rows.

    The queries go in blocks of at most `block` vectors, `per_scan` blocks to a scan; each block is
    sent to all partitions, which multiply it with their rows and pass on only their own best. Null
    or zero vectors match nothing.
    """
    rows = vectors.select("vec_id", "embedding").where("vec_id is not null and embedding is not null")
    step = every * block
    asked = rows.where(F.col("vec_id") % every == 0)
    blocks = [r[0] for r in asked.select(F.floor(F.col("vec_id") / step).alias("b")).distinct().orderBy("b").toLocalIterator()]
    parts = []
    for at in range(0, len(blocks), per_scan):
        sent = []
        for b in blocks[at : at + per_scan]:
            own = asked.where((F.col("vec_id") >= b * step) & (F.col("vec_id") < (b + 1) * step)).collect()
            sent.append(rows.sparkSession.sparkContext.broadcast(([r.vec_id for r in own], [list(r.embedding) for r in own])))
        parts.append(rows.mapInArrow(_best_of_blocks(sent, top), "query_id long, doc_id long, score double"))
    if not parts:
        return rows.select(F.col("vec_id").cast("long").alias("query_id"), F.col("vec_id").cast("long").alias("doc_id"), F.lit(0.0).alias("score"), F.lit(1).alias("place")).limit(0)
    scored = parts[0]
    for p in parts[1:]:
        scored = scored.unionByName(p)
    return best(scored, "query_id", "doc_id", "score", top)


def _best_of_blocks(sent: list, top: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        def unit(x):
            size = np.linalg.norm(x, axis=1, keepdims=True)
            return np.divide(x, size, out=np.zeros_like(x), where=size > 0)

        known = [(unit(np.array(listed, dtype=np.float64)), np.array(ids)) for ids, listed in (x.value for x in sent)]
        for batch in batches:
            docs = batch.column(0).to_numpy(zero_copy_only=False)
            matrix = unit(np.array(batch.column(1).to_pylist(), dtype=np.float64))
            for queries, query_ids in known:
                scores = queries @ matrix.T
                scores[query_ids[:, None] == docs[None, :]] = -2.0
                scores[:, ~matrix.any(axis=1)] = -2.0
                rounded = np.round(scores, 9)
                # ties go to the lower id, so it is part of the order
                order = np.lexsort((np.broadcast_to(docs, scores.shape), -rounded), axis=1)[:, :top]
                picked = np.take_along_axis(scores, order, axis=1)
                keep = (picked > -2.0) & queries.any(axis=1)[:, None]
                q = np.broadcast_to(query_ids[:, None], order.shape)[keep]
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(docs[order][keep], pa.int64()), pa.array(picked[keep], pa.float64())], names=["query_id", "doc_id", "score"])

    return run


def fuse(a: DataFrame, b: DataFrame, top: int = 5, k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of two rankings of (query_id, doc_id, place)."""
    both = a.select("query_id", "doc_id", "place").unionByName(b.select("query_id", "doc_id", "place"))
    scored = both.groupBy("query_id", "doc_id").agg(F.sum(1.0 / (k + F.col("place"))).alias("score"))
    return best(scored, "query_id", "doc_id", "score", top)


def ranking_quality(ranked: DataFrame, gold: DataFrame, top: int = 5) -> DataFrame:
    """(queries, recall, mrr) of a ranking against (query_id, doc_id) gold pairs."""
    hits = ranked.join(gold, ["query_id", "doc_id"]).groupBy("query_id").agg(F.min("place").alias("place"))
    judged = gold.select("query_id").distinct().join(hits, "query_id", "left")
    found = F.coalesce(F.col("place") <= top, F.lit(False))
    return judged.agg(F.count(F.lit(1)).alias("queries"), F.avg(found.cast("double")).alias("recall"), F.avg(F.when(found, 1.0 / F.col("place")).otherwise(0.0)).alias("mrr"))


def false_answers(ranked: DataFrame, unanswerable: DataFrame, least: float) -> DataFrame:
    """(no_answer_queries, false_positive_rate): the share of the queries that nothing answers for
    which the best result still scores `least`; null without such queries."""
    best_ = ranked.where("place = 1").select("query_id", "score")
    judged = unanswerable.select("query_id").distinct().join(best_, "query_id", "left")
    return judged.agg(F.count(F.lit(1)).alias("no_answer_queries"), F.avg(F.coalesce(F.col("score") >= least, F.lit(False)).cast("double")).alias("false_positive_rate"))
