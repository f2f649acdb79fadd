import random
from collections import Counter, defaultdict

from conftest import rows_of
from pyspark.sql import functions as F

from lontar.operators import heavy_keys as hk


def test_against_python_with_a_hot_key(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.4 else f"k{rng.randrange(9)}", rng.choice([None, *range(40)])) for _ in range(3000)] + [(None, 1)] * 50
    df = spark.createDataFrame(rows, "a string, b int").repartition(7)
    freq = hk.value_frequencies(df, F.col("a"), F.col("b"))
    totals = {r["key"]: r for r in hk.key_totals(freq).collect()}
    by = defaultdict(list)
    for k, v in rows:
        by[k].append(v)
    assert set(totals) == set(by)
    for k, values in by.items():
        known = Counter(v for v in values if v is not None)
        best = min(known, key=lambda v: (-known[v], v))
        assert (totals[k]["rows"], totals[k]["distinct_values"], totals[k]["mode"], totals[k]["mode_rows"]) == (len(values), len(known), best, known[best])
    q = {r["key"]: (r["p50"], r["p90"]) for r in hk.key_percentiles(freq, {"p50": 0.5, "p90": 0.9}).collect()}
    for k, values in by.items():
        v = sorted(x for x in values if x is not None)
        assert q[k] == tuple(v[-(-len(v) * p // 10) - 1] for p in (5, 9))
    assert [r["key"] for r in hk.heavy_keys(freq, 0.3).collect()] == ["hot"]


def test_empty_and_all_null(spark):
    df = spark.createDataFrame([], "a string, b int, n int, value int")
    assert rows_of(hk.key_totals(hk.value_frequencies(df, F.col("a"), F.col("b")))) == []
    assert rows_of(hk.heavy_keys(hk.value_frequencies(df, F.col("a"), F.col("b")), 0.03)) == []
    nulls = spark.createDataFrame([(None, None)] * 3, "a string, b int")
    freq = hk.value_frequencies(nulls, F.col("a"), F.col("b"))
    assert rows_of(hk.key_totals(freq)) == [(None, 3, 0, None, None)]
    assert rows_of(hk.key_percentiles(freq, {"p": 0.5})) == []


def test_running_sum_ignores_partitioning(spark):
    from lontar.operators.ordered import running_sum

    rows = [("a" if i % 3 else None, i, i % 7) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, o int, w int")
    wanted, seen = [], Counter()
    for k, o, w in rows:
        seen[k] += w
        wanted.append((k, o, w, seen[k]))
    for n in (1, 7):
        got = running_sum(df.repartition(n), ["k"], ["o"], F.col("w"), "s").select("k", "o", "w", "s", "s_total")
        assert rows_of(got.select("k", "o", "w", "s")) == sorted(wanted, key=repr)
        assert all(r.s_total == seen[r.k] for r in got.collect())
