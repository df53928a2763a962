import math
import random
from collections import Counter
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from tallygrid.llm import ranking, together


def test_top_n_equals_sorting(spark):
    rng = random.Random(4)
    rows = [(("hot" if rng.random() < 0.4 else f"g{rng.randrange(60)}"), rng.choice([None, math.nan, -0.0, 0.0, 0.5, 0.25, rng.random()]), rng.randrange(4000)) for _ in range(6000)]
    score = {}
    rows = [(g, score.setdefault(i, s), i) for g, s, i in rows] + [("hot", 0.5, None), ("hot", 0.5, None), (None, 0.9, 5)]
    df = spark.createDataFrame(rows + rows[:300], "g string, s double, i int").withColumn("part", F.lit("x")).withColumn("place", F.lit(0))
    got = {(r.g, r.i, r.place) for r in ranking.top_n(df, {"g": F.col("g")}, "s", "i", 7, salts=3).collect()}
    want = set()
    for g in {r[0] for r in rows}:
        own = {(-s + 0.0, i is None, i or 0, i) for gg, s, i in rows if gg == g and s is not None and not math.isnan(s)}
        want |= {(g, t[3], k) for k, t in enumerate(sorted(own)[:7], 1)}
    assert got == want
    assert ranking.top_n(df.limit(0), {"g": F.col("g")}, "s", "i", 7).count() == 0


def brute(baskets):
    n = Counter()
    for items, w in baskets:
        held = sorted({x for x in items or [] if x is not None})
        n.update({(a, a): w for a in held})
        n.update({p: w for p in combinations(held, 2)})
    return {k: v for k, v in n.items() if v}


def test_pair_counts_equal_brute_force(spark):
    rng = random.Random(5)
    names = [f"i{k}" for k in range(300)]
    baskets = [([rng.choice(names[: 3 if rng.random() < 0.5 else 300]) for _ in range(rng.randrange(12))], rng.randrange(4)) for _ in range(700)]
    baskets += [(None, 2), ([], 1), ([None, "i1", "i1"], 3), ([f"i{k}" for k in range(250)], 1)]
    df = spark.createDataFrame(baskets, "items array<string>, w int").withColumn("n", F.lit(1)).repartition(3)
    for block, entries in ((512, 1 << 21), (7, 90)):
        got = {(r.item_a, r.item_b): r.n for r in together.pair_counts(df, "items", "w", block, entries).collect()}
        assert got.pop((None, None)) == sum(w for _, w in baskets)
        assert got == brute(baskets)
    plain = {(r.item_a, r.item_b): r.n for r in together.pair_counts(df, "items").collect()}
    assert plain.pop((None, None)) == len(baskets) and plain == brute([(x, 1) for x, _ in baskets])


def test_associations(spark):
    df = spark.createDataFrame([(["a", "b"],)] * 3 + [(["a"],), (["c"],), (None,)], "items array<string>")
    got = together.associations(df).collect()
    assert [(r.item_a, r.item_b, r.n, r.n_a, r.n_b, r.n_all) for r in got] == [("a", "b", 3, 4, 3, 6)] and got[0].lift == 1.5
    assert together.associations(df.limit(0)).count() == 0


def test_gram_of_one_block():
    record, item = np.array([0, 0, 1, 2, 2]), np.array([0, 1, 0, 0, 1])
    cells = {(i, j): n for a, b, c in together.gram(record, item, np.array([1.0, 1.0, 2.0]), 2, 1) for i, j, n in zip(a, b, c, strict=True)}
    assert cells == {(0, 0): 4.0, (0, 1): 3.0, (1, 1): 3.0}


def test_slices_of_the_products(monkeypatch):
    """However small the slices are, the cells are the same; a long record of rare items is cut too."""
    rng = np.random.default_rng(6)
    x = (rng.random((120, 60)) < np.linspace(0.5, 0.02, 60)).astype(int)
    x[3] = 1
    w = rng.integers(0, 4, 120).astype(float)
    record, item = np.nonzero(x)
    want = np.triu(x.T @ (x * w[:, None]))
    for block, rows, meetings in ((60, 7, 5), (4, 7, 5), (1, 1000, 1000), (9, 16, 3)):
        monkeypatch.setattr(together, "DENSE_ROWS", rows)
        monkeypatch.setattr(together, "MEETINGS", meetings)
        got = np.zeros((60, 60))
        for i, j, n in together.gram(record, item, w, 60, block):
            np.add.at(got, (i, j), n)
        assert (got == want).all()


def test_support(spark):
    df = spark.createDataFrame([(["a", "b"],)] * 3 + [(["a", "c"],)], "items array<string>")
    assert [(r.item_a, r.item_b, r.n_a) for r in together.associations(df, least=2).collect()] == [("a", "b", 4)]
