"""Problem 7: splits that keep related records together.

Keys are linked by the answers they share. Labels are propagated over the bipartite graph of keys
and answers: each answer takes the smallest label of its keys, each key the smallest of its
answers', and every round also jumps to the label of the label, so that long chains close in a
logarithmic number of rounds. Answers of a single key can't link anything and are dropped first.

Groups are then assigned to splits so that the shares of rows are met and every label (the kind of
regulation) is spread like the whole: groups larger than a fixed fraction of all rows - at most the
inverse of that fraction many - are placed one by one, largest first, into the split that lacks
most of the group's label and of rows. For the rest, each label is cut at what the splits still
lack of that label, in hash order along a running sum; where large groups have overfilled a split,
all labels give way in proportion, so that the totals are still met (iterative proportional
fitting of labels against splits; only one factor per split reaches the driver).

A null or empty key or answer is none. A row without either is a group by itself, placed by hash.
Keys are compared after trimming and lower-casing. Repeated rows count as often as they occur. An
empty table gives no rows; columns of any name pass by. Groups are never split, so a group larger
than a split's share overfills it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lontar.functions.keys import key
from lontar.operators.ordered import running_sum
from lontar.operators.spread import spread_join
from lontar.runtime import delete, materialize


def linked_keys(pairs: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(key, group_key) of every key that shares an answer with another, from (key, answer) pairs.

    `max_rounds` only guards against an endless loop; not having converged by then is an error.
    Keys with very many answers, and answers of very many keys, don't gather in one task.
    """
    spark = pairs.sparkSession
    known = pairs.where("key is not null and answer is not null")
    shared = known.groupBy("answer").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low <> high")
    edges = known.join(shared.select("answer"), "answer", "left_semi").distinct()
    edges, edge_path = materialize(edges)
    labels, path = materialize(edges.groupBy("key").agg(F.count(F.lit(1)).alias("degree")).withColumn("label", F.col("key")))
    total = edges.count()
    for _ in range(max_rounds):
        lowest = spread_join(edges, labels, "key", "degree", total=total).groupBy("answer").agg(F.min("label").alias("lowest"), F.count(F.lit(1)).alias("keys"))
        lowest, lowest_path = materialize(lowest)
        near = spread_join(edges, lowest, "answer", "keys", total=total).groupBy("key").agg(F.min("lowest").alias("near"))
        # the label of the label: one step along the tree that the labels form
        beyond = labels.select(F.col("key").alias("near"), F.col("label").alias("far"))
        moved = near.join(beyond, "near", "left").select("key", F.least("near", F.coalesce("far", "near")).alias("label"))
        old = labels.withColumnRenamed("label", "old")
        new, new_path = materialize(moved.join(old, "key"))
        changed = new.where("label <> old").limit(1).count()
        for done in (path, lowest_path):
            delete(spark, done)
        labels, path = new.select("key", "degree", "label"), new_path
        if not changed:
            delete(spark, edge_path)
            return labels.select("key", F.col("label").alias("group_key"))
    raise RuntimeError(f"labels still move after {max_rounds} rounds")


def records(qa: DataFrame, corpus: DataFrame) -> DataFrame:
    """(table_name, id, key, answer) of both tables, keys normalised."""
    none = F.lit(None).cast("string")
    a = qa.select(F.lit("qa_sft").alias("table_name"), F.col("id"), key("regulation_key").alias("key"), key("answer_hash").alias("answer"))
    b = corpus.select(F.lit("corpus").alias("table_name"), F.col("id"), key("regulation_key").alias("key"), none.alias("answer"))
    return a.unionByName(b)


def with_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Add `group_key`: the group of the row's key, else of its answer, else the row's own."""
    columns = ["table_name", "id", "key", "answer", "group_key"]
    keys = rows.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n")).join(groups, "key", "left")
    keys, _ = materialize(keys.select("key", "n", F.coalesce("group_key", "key").alias("group_key")))
    keyed = spread_join(rows.where("key is not null"), keys, "key", "n").select(*columns)
    # an answer without a key of its own belongs to the group of the keys that carry it; all keys
    # of one answer are in one group
    keyless = rows.where("key is null and answer is not null")
    carried = keyed.where("answer is not null").groupBy("answer").agg(F.min("group_key").alias("carried"))
    answers = keyless.groupBy("answer").agg(F.count(F.lit(1)).alias("n")).join(carried, "answer", "left")
    answers, _ = materialize(answers.select("answer", "n", F.coalesce("carried", F.concat(F.lit("answer:"), F.col("answer"))).alias("group_key")))
    by_answer = spread_join(keyless, answers, "answer", "n").select(*columns)
    alone = rows.where("key is null and answer is null").withColumn("group_key", F.concat_ws(":", F.lit("row"), "table_name", "id")).select(*columns)
    every = keyed.unionByName(by_answer).unionByName(alone)
    kind = F.when(F.col("key").startswith("answer:"), "answer").otherwise(F.coalesce(F.split("key", r"\|")[0], F.lit("none")))
    return every.select("table_name", "id", "group_key", kind.alias("kind"))


def assign(grouped: DataFrame, shares: dict[str, float], large: float = 0.0005, seed: str = "lontar", rounds: int = 12) -> DataFrame:
    """(group_key, split, rows): the split of every group. `large`: the fraction of all rows from
    which a group is placed by itself; no more than 1 / large groups reach that. A group's label is
    that of most of its rows."""
    spark = grouped.sparkSession
    per_kind = grouped.groupBy("group_key", F.col("kind").alias("stratum")).agg(F.count(F.lit(1)).alias("n"))
    groups = per_kind.groupBy("group_key").agg(F.sum("n").alias("rows"), F.max(F.struct("n", "stratum"))["stratum"].alias("stratum"))
    groups, _ = materialize(groups)
    total = groups.agg(F.sum("rows")).first()[0] or 0
    splits, whole = sorted(shares), sum(shares.values()) or 1.0
    share = {s: shares[s] / whole for s in splits}
    want = {s: total * share[s] for s in splits}
    strata = groups.groupBy("stratum").agg(F.sum("rows").alias("stratum_rows"), F.sum(F.when(F.col("rows") <= large * total, F.col("rows")).otherwise(0)).alias("light_rows"))
    strata, _ = materialize(strata)
    heavy = groups.where(F.col("rows") > F.lit(large * total)).join(strata, "stratum").orderBy(F.desc("rows"), "group_key").collect()
    placed, got, got_in = [], dict.fromkeys(splits, 0), {}
    for g in heavy:

        def lack(s: str) -> tuple[float, float, str]:
            over = max(0.0, g.rows - (want[s] - got[s]))
            label = g.stratum_rows * share[s] - got_in.get((s, g.stratum), 0)
            return over / max(want[s], 1.0), -label, s

        best = min(splits, key=lack)
        placed.append((g.group_key, best, g.rows))
        got[best] += g.rows
        got_in[best, g.stratum] = got_in.get((best, g.stratum), 0) + g.rows
    first = spark.createDataFrame(placed, "group_key string, split string, rows long")
    # what each split still lacks of each label; the labels of large groups are as few as they
    taken = spark.createDataFrame([(k, s, float(n)) for (s, k), n in got_in.items()], "stratum string, split string, taken double")
    wide = taken.groupBy("stratum").pivot("split", splits).agg(F.sum("taken")) if splits else taken.select("stratum").distinct()
    wide = wide.select("stratum", *[F.col(f"`{s}`").alias(f"taken_{i}") for i, s in enumerate(splits)])
    lacking = [F.greatest(F.col("stratum_rows") * share[s] - F.coalesce(f"taken_{i}", F.lit(0.0)), F.lit(0.0)) + F.col("stratum_rows") * 1e-9 * share[s] for i, s in enumerate(splits)]
    base = strata.where("light_rows > 0").join(F.broadcast(wide), "stratum", "left").select("stratum", "light_rows", *[x.alias(f"b{i}") for i, x in enumerate(lacking)])
    base, _ = materialize(base)
    left = [max(0.0, want[s] - got[s]) for s in splits]
    light_total = sum(left) or 1.0
    light_rows = base.agg(F.sum("light_rows")).first()[0] or 0
    need = [x / light_total * light_rows for x in left]
    factor = [1.0] * len(splits)

    def parts() -> list[Column]:
        weighted = [F.col(f"b{i}") * F.lit(f) for i, f in enumerate(factor)]
        return [F.try_divide(w * F.col("light_rows"), sum(weighted[1:], weighted[0])) for w in weighted]

    for _ in range(rounds if light_rows else 0):
        now = base.agg(*[F.sum(x).alias(f"n{i}") for i, x in enumerate(parts())]).first()
        if all(abs((n or 0.0) - x) <= 1e-4 * light_rows for n, x in zip(now, need)):
            break
        factor = [min(1e9, max(1e-9, f * (x / n if n else 1.0))) for f, n, x in zip(factor, now, need)]
    light = groups.where(F.col("rows") <= F.lit(large * total)).withColumn("__at", F.sha2(F.concat_ws("\x1f", F.lit(seed), "group_key"), 256))
    summed = running_sum(light, ["stratum"], ["__at", "group_key"], F.col("rows"), "upto")
    edges, upto = [], F.lit(0.0)
    for x in parts()[:-1]:
        upto = upto + x / F.col("light_rows")
        edges.append(upto)
    cuts = base.select(F.col("stratum").alias("__stratum"), *[x.alias(f"edge{i}") for i, x in enumerate(edges)])
    cut = summed.join(cuts, F.col("stratum") == F.col("__stratum"))
    # a point within the group decides, another for each label, so that labels of like sizes aren't
    # all rounded the same way
    point = (F.pmod(F.xxhash64(F.lit(seed), "stratum"), F.lit(1000)) + 0.5) / 1000
    middle = (F.col("upto") - F.col("rows") * point) / F.col("upto_total")
    choice = F.lit(splits[-1]) if splits else F.lit(None).cast("string")
    for i in reversed(range(len(edges))):
        choice = F.when(middle <= F.col(f"edge{i}"), splits[i]).otherwise(choice)
    return first.unionByName(cut.select("group_key", choice.alias("split"), "rows"))


def label_shares(grouped: DataFrame, splits: DataFrame, plan: DataFrame) -> DataFrame:
    """(label, split, rows, share, wanted, deviation): how each label is spread; `plan` has (split, share)."""
    placed = grouped.groupBy("group_key", F.col("kind").alias("label")).agg(F.count(F.lit(1)).alias("n")).join(splits.select("group_key", "split"), "group_key")
    got = placed.groupBy("label", "split").agg(F.sum("n").alias("n"))
    whole = got.groupBy("label").agg(F.sum("n").alias("label_rows"))
    wanted = [F.struct(F.lit(r.split).alias("split"), F.lit(r.share).alias("wanted")) for r in plan.collect()]
    every = whole.select("label", "label_rows", F.inline(F.array(*wanted)))
    joined = every.join(got, ["label", "split"], "left")
    share = F.coalesce("n", F.lit(0)) / F.col("label_rows")
    return joined.select("label", "split", F.coalesce("n", F.lit(0)).alias("rows"), share.alias("share"), "wanted", F.abs(share - F.col("wanted")).alias("deviation"))
