"""Stratified selection under per-source caps, and near neighbours.

Each bucket takes, in hash order, candidates not chosen yet, at most `cap` per source over all
buckets, until its quota. With a total order that loop equals: number the unchosen candidates
within each source, keep those whose number plus what the source already has doesn't exceed the
cap, and take the first `quota` of them. Every step is a window with a group limit and a top-k; the
chosen rows are as many as the quotas say, so they may be broadcast.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from lontar.functions import ids, tokens
from lontar.runtime import materialize


@dataclass(frozen=True)
class Bucket:
    name: str
    quota: int
    where: Column


def select_by_quota(candidates: DataFrame, buckets: list[Bucket], cap: int, seed: str, source: str = "primary_label", forced: DataFrame | None = None, chosen: DataFrame | None = None) -> DataFrame:
    """(term_id, source, bucket, place): `forced` (term_id) rows come first, ignore the cap and use it up;
    `chosen` goes on with an earlier result of the same form.

    A bucket with too few candidates stays short; the caller compares the counts with the quotas.
    """
    pool = candidates.select("term_id", F.col(source).alias("source"), *[b.where.alias(f"in_{b.name}") for b in buckets])
    pool, _ = materialize(pool)
    spark = candidates.sparkSession
    # what is chosen is as much as the quotas say, so it is kept by the driver
    rows: list[tuple[str, str, str, int]] = []
    if chosen is not None:
        rows = [tuple(r) for r in chosen.select("term_id", "source", "bucket", "place").collect()]
    elif forced is not None:
        kept = pool.join(F.broadcast(forced.select("term_id").distinct()), "term_id", "left_semi").orderBy("term_id").select("term_id", "source").collect()
        rows = [(r.term_id, r.source, "anchor", i) for i, r in enumerate(kept, 1)]
    for b in buckets:
        if not b.quota:
            continue
        counts = Counter(r[1] for r in rows)
        taken = F.broadcast(spark.createDataFrame([(k, n) for k, n in counts.items() if k is not None], "source string, already int"))
        known = F.broadcast(spark.createDataFrame([(r[0],) for r in rows], "term_id string"))
        open_ = pool.where(f"in_{b.name}").join(known, "term_id", "left_anti").withColumn("rank", ids.rank(seed, b.name, F.col("term_id")))
        numbered = open_.withColumn("number", F.row_number().over(Window.partitionBy("source").orderBy("rank", "term_id"))).where(F.col("number") <= cap)
        kept = numbered.join(taken, "source", "left").where(F.col("number") + F.coalesce("already", F.lit(0)) <= cap)
        picked = kept.orderBy("rank", "term_id").limit(b.quota).select("term_id", "source").collect()
        rows += [(r.term_id, r.source, b.name, i) for i, r in enumerate(picked, 1)]
    return spark.createDataFrame(rows, "term_id string, source string, bucket string, place int")


@dataclass(frozen=True)
class Plan:
    """What a selection is made of: normalised terms that must be in it, quotas of the buckets by
    name, at most `cap` terms per source. Anchors and focus terms are short lists of a configuration."""

    quotas: dict[str, int]
    cap: int
    seed: str
    anchors: tuple[str, ...] = ()
    focus: tuple[str, ...] = ()
    least_jaccard: float = 0.5
    #: Whether too few candidates are an error; else the selection stays short.
    strict: bool = True

    @property
    def target(self) -> int:
        return sum(self.quotas.values())


#: The buckets filled by rank, in this order; what they ask for is in `bucket_rules`.
RANKED = ("alias", "numeric", "long_definition", "typical_fill")


def bucket_rules(long_from: int) -> dict[str, Column]:
    return {
        "multi_sense": F.col("sense_count") > 1,
        "alias": F.col("has_alias"),
        "numeric": F.col("has_digits"),
        "long_definition": F.col("longest_definition") >= long_from,
        "typical_fill": F.lit(True),
    }


def require_terms(terms: DataFrame, wanted: tuple[str, ...], label: str) -> DataFrame:
    """The terms that are asked for, in their order (`place`); an error unless all of them exist."""
    listed = terms.sparkSession.createDataFrame([(t, i) for i, t in enumerate(wanted, 1)], "normalized_term string, place int")
    found = terms.join(F.broadcast(listed), "normalized_term")
    missing = listed.join(found.select("normalized_term"), "normalized_term", "left_anti").orderBy("place").collect()
    if missing:
        raise ValueError(f"{label} not available: {[r.normalized_term for r in missing]}")
    return found


def select_terms(candidates: DataFrame, plan: Plan, long_from: int) -> tuple[DataFrame, list[tuple[str, str]]]:
    """((term_id, source, bucket, place), pairs of near neighbours) of a whole selection.

    Anchors come first and ignore the cap; then terms of several senses; the focus terms, which must
    be free and fit; pairs of near neighbours, best first; the other buckets by rank; and any terms
    until the target is met. All share one state. An error if a list or the target can't be met.
    """
    spark = candidates.sparkSession
    rules = bucket_rules(long_from)
    terms, _ = materialize(candidates.select("term_id", "normalized_term", F.col("primary_label"), *[c for c in ("sense_count", "has_alias", "has_digits", "longest_definition")]))
    anchors = require_terms(terms, plan.anchors, "anchors") if plan.anchors else None
    chosen = select_by_quota(terms, [Bucket("multi_sense", plan.quotas.get("multi_sense", 0), rules["multi_sense"])], plan.cap, plan.seed, forced=anchors)
    rows = [tuple(r) for r in chosen.collect()]
    if plan.focus:
        asked = require_terms(terms, plan.focus, "focus terms").select("term_id", "primary_label", "place").orderBy("place").collect()
        for r in asked:
            if any(r.term_id == x[0] for x in rows) or sum(r.primary_label == x[1] for x in rows) >= plan.cap:
                raise ValueError("a focus term is chosen already or its source is full")
            rows.append((r.term_id, r.primary_label, "domain_focus", r.place))
    pairs: list[tuple[str, str]] = []
    if plan.quotas.get("near_neighbor"):
        known = F.broadcast(spark.createDataFrame([(x[0],) for x in rows], "term_id string"))
        free = terms.join(known, "term_id", "left_anti")
        pairs = disjoint_pairs(near_neighbours(free, plan.least_jaccard, plan.seed), free, plan.quotas["near_neighbor"], plan.cap, Counter(x[1] for x in rows))
        places = {t: i for i, t in enumerate((t for p in pairs for t in p), 1)}
        near = free.where(F.col("term_id").isin(*places)).select("term_id", "primary_label").collect() if places else []
        rows += [(r.term_id, r.primary_label, "near_neighbor", places[r.term_id]) for r in near]
    form = "term_id string, source string, bucket string, place int"
    chosen = spark.createDataFrame(rows, form)
    chosen = select_by_quota(terms, [Bucket(b, plan.quotas.get(b, 0), rules[b]) for b in RANKED], plan.cap, plan.seed, chosen=chosen)
    short = plan.target - chosen.count()
    if short > 0:
        filled = select_by_quota(terms, [Bucket("fallback", short, F.lit(True))], plan.cap, plan.seed, chosen=chosen)
        chosen = filled.withColumn("bucket", F.when(F.col("bucket") == "fallback", "typical_fill").otherwise(F.col("bucket")))
    if plan.strict and chosen.count() != plan.target:
        raise RuntimeError(f"the selection has {chosen.count()} terms, not {plan.target}")
    return chosen, pairs


def tags(plan: Plan, long_from: int, paired: Column) -> Column:
    """All that applies to a chosen term, whatever bucket it came by."""
    rules = bucket_rules(long_from)
    return F.concat_ws(
        "|",
        F.when(F.col("normalized_term").isin(*plan.anchors), "anchor"),
        F.when(rules["multi_sense"], "multi_sense"),
        F.when(F.col("normalized_term").isin(*plan.focus), "domain_focus"),
        F.when(rules["alias"], "alias"),
        F.when(rules["numeric"], "numeric"),
        F.when(rules["long_definition"], "long_definition"),
        F.when(paired, "near_neighbor"),
    )


def near_neighbours(candidates: DataFrame, least: float, seed: str) -> DataFrame:
    """(left_id, right_id, shared, score, rank) of terms whose token sets agree to `least` (Jaccard).

    Two sets that agree so far share one of the first n - ceil(least * n) + 1 tokens in any common
    order; with rare tokens first, only those are joined, and frequent tokens hardly ever.
    """
    sized = candidates.select("term_id", tokens.term_tokens(F.col("normalized_term")).alias("tokens")).where(F.size("tokens") > 0)
    sized, _ = materialize(sized)
    spread = sized.select("term_id", F.explode("tokens").alias("token"))
    often = spread.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    ordered = spread.join(often, "token").groupBy("term_id").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("o"))
    n = F.size("o")
    leading = ordered.select("term_id", n.alias("n"), F.explode(F.slice("o", F.lit(1), (n - F.ceil(n * F.lit(least)) + 1).cast("int"))).alias("t")).select("term_id", "n", "t.token")
    a, b = leading.toDF("left_id", "ln", "token"), leading.toDF("right_id", "rn", "token")
    lengths = F.least("ln", "rn") >= F.lit(least) * F.greatest("ln", "rn")
    pairs = a.join(b, "token").where((F.col("left_id") < F.col("right_id")) & lengths).select("left_id", "right_id").distinct()
    left, right = sized.toDF("left_id", "lt"), sized.toDF("right_id", "rt")
    joined = pairs.join(left, "left_id").join(right, "right_id").withColumn("shared", F.size(F.array_intersect("lt", "rt")))
    scored = joined.withColumn("score", tokens.jaccard(F.col("shared"), F.size("lt"), F.size("rt"))).where(F.col("score") >= least)
    return scored.select("left_id", "right_id", "shared", "score", ids.rank(seed, "near_neighbor", F.concat("left_id", "right_id")).alias("rank"))


def within_edits(terms: DataFrame, most: int = 3) -> DataFrame:
    """(left_id, right_id, edits): all pairs of (term_id, normalized_term) at most `most` edits apart.

    The shorter term is cut into `most` + 1 even segments, of which the edits leave one whole; in the
    longer term it begins no further off than the edits before it and those after it allow. So the
    join of segments with the few pieces of equal length, place and text loses no pair. A segment
    of a term shorter than `most` + 1 may be empty, which any term of a fitting length holds.
    """
    sized, _ = materialize(terms.select("term_id", F.col("normalized_term").alias("term"), F.length("normalized_term").alias("n")))

    def segment(n: Column, i: int) -> tuple[Column, Column]:
        """First character (from 0) and length of segment `i` of a term of `n` characters."""
        short, longer = F.floor(n / (most + 1)), n % (most + 1)
        return i * short + F.greatest(F.lit(0), i - (most + 1 - longer)), short + F.when(i >= most + 1 - longer, 1).otherwise(0)

    def piece(n: Column, i: int, shift: int) -> Column:
        at, size = segment(n, i)
        fits = (n >= 0) & (at + shift >= 0) & (at + shift + size <= F.col("n"))
        return F.when(fits, F.struct(n.cast("int").alias("size"), F.lit(i).alias("segment"), F.substring("term", (at + shift + 1).cast("int"), size.cast("int")).alias("piece")))

    own = [piece(F.col("n"), i, 0) for i in range(most + 1)]
    held = [
        piece(F.col("n") - more, i, shift)
        for more in range(most + 1)
        for i in range(most + 1)
        for shift in range(-most, most + 1)
        if abs(shift) <= i and abs(shift - more) <= most - i
    ]
    a = sized.select(F.col("term_id").alias("a_id"), F.col("term").alias("a"), F.inline(F.array(*own)))
    b = sized.select(F.col("term_id").alias("b_id"), F.col("term").alias("b"), F.inline(F.filter(F.array(*held), lambda x: x.isNotNull())))
    # of two terms of one length either may be the shorter: the one with the smaller id
    apart = (F.length("a") < F.length("b")) | (F.col("a_id") < F.col("b_id"))
    near = a.join(b, ["size", "segment", "piece"]).where(apart).withColumn("edits", F.levenshtein("a", "b", most)).where("edits >= 0")
    return near.select(F.least("a_id", "b_id").alias("left_id"), F.greatest("a_id", "b_id").alias("right_id"), "edits").distinct()


def disjoint_pairs(pairs: DataFrame, sources: DataFrame, quota: int, cap: int, already: dict[str, int] | None = None) -> list[tuple[str, str]]:
    """Pairs taken greedily, best first: both terms still free, no source over its cap.

    Sequential by nature, it reads the ordered pairs from one partition after another and stops
    when the quota is met; the state is as large as the quota.
    """
    known = sources.select(F.col("term_id"), F.col("primary_label").alias("source"))
    ordered = (
        pairs.join(known.toDF("left_id", "ls"), "left_id")
        .join(known.toDF("right_id", "rs"), "right_id")
        .orderBy(F.desc("score"), "rank")
        .select("left_id", "right_id", "ls", "rs")
    )
    used, counts, chosen = set(), dict(already or {}), []
    for p in ordered.toLocalIterator():
        if 2 * len(chosen) >= quota:
            break
        need = {p.ls: 1}
        need[p.rs] = need.get(p.rs, 0) + 1
        if p.left_id in used or p.right_id in used or any(counts.get(s, 0) + k > cap for s, k in need.items()):
            continue
        used |= {p.left_id, p.right_id}
        for s, k in need.items():
            counts[s] = counts.get(s, 0) + k
        chosen.append((p.left_id, p.right_id))
    return chosen


def related(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """(term_id, related_terms): both directions of the pairs, sorted and joined by `|`."""
    both = pairs.select(F.col("left_id").alias("term_id"), F.col("right_id").alias("other")).unionByName(pairs.select(F.col("right_id").alias("term_id"), F.col("left_id").alias("other")))
    named = both.join(names.select(F.col("term_id").alias("other"), "canonical_term"), "other")
    return named.groupBy("term_id").agg(F.array_join(F.sort_array(F.collect_set("canonical_term")), "|").alias("related_terms"))
