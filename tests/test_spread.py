import random

from conftest import rows_of
from pyspark.sql import functions as F

from lontar.operators.spread import salted_join, spread_join


def test_every_row_finds_its_key(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["hot"] * 30 + [None] + [f"k{n}" for n in range(50)])) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, k string").repartition(4)
    keyed = df.where("k <> 'k7'").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    wanted = sorted(((k, i) for i, k in rows if k is not None and k != "k7"), key=repr)
    for fraction in (0.0005, 0.1, 1.0):
        assert rows_of(spread_join(df, keyed, "k", "n", fraction).select("k", "id")) == wanted
    assert rows_of(spread_join(df.limit(0), keyed.limit(0), "k", "n")) == []


def test_all_pairs_of_a_key(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["hot"] * 20 + [None] + [f"k{n}" for n in range(20)]), "x") for i in range(400)]
    links = [(rng.choice(["hot", "k1", "k2", "none", None]), n) for n in range(12)]
    a, b = spark.createDataFrame(links, "k string, n int"), spark.createDataFrame(rows, "id long, k string, x string").repartition(3)
    wanted = sorted(((k, n, i, "x") for k, n in links for i, o, _ in rows if k is not None and k == o), key=repr)
    for fraction in (0.0005, 0.05, 1.0):
        assert rows_of(salted_join(a, b, ["k"], "id", fraction)) == wanted
    assert rows_of(salted_join(a.limit(0), b, ["k"], "id")) == rows_of(salted_join(a, b.limit(0), ["k"], "id")) == []
