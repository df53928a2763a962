import math
from itertools import combinations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygrid.functions import special
from tallygrid.operators import counting as C
from tallygrid.operators.counter import Counter
from tallygrid.operators.counting import Family, Tally
from tallygrid.operators.scoring import Scores, parent_bounds

from .data import branching, mixed, tally


def test_special_functions(spark):
    xs = [0.05, 0.25, 1.0, 1.5, 7.3, 100.0, 12345.6, 6e5]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(special.lgamma(F.col("x"))).collect()]
    assert np.allclose(got, [math.lgamma(x) for x in xs], rtol=1e-13, atol=1e-12)
    assert np.allclose(special.lgamma_np(np.array(xs)), got, rtol=1e-13, atol=1e-12)
    assert special.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05) and special.chi2_isf(0.05, 6) == pytest.approx(12.591587243743977)
    assert special.chi2_sf(-1.0, 3) == 1 and special.chi2_sf(5.0, 0) == 1
    a = np.array([[0.0, 1.0], [-1.0, 0.0]])
    assert np.allclose(special.expm(a), [[math.cos(1), math.sin(1)], [-math.sin(1), math.cos(1)]])
    assert np.allclose(special.norm_cdf(special.norm_ppf(np.array([0.01, 0.5, 0.9]))), [0.01, 0.5, 0.9])


FAMILIES = [Family(v, p) for v in range(6) for k in range(3) for p in combinations([u for u in range(6) if u != v], k)][::4]


def test_frame_scores_equal_driver_scores(spark):
    x, cards = mixed()
    t = tally(spark, x, cards)
    c = Counter(t)
    by = {"bic": C.bic(t, FAMILIES, c.n), "aic": C.aic(t, FAMILIES), "k2": C.k2(t, FAMILIES), "k2_pen": C.k2_penalised(t, FAMILIES, c.n), "ebna": C.ebna(t, FAMILIES, c.n)}
    for kind, frame in by.items():
        s = Scores(c, kind, 1.0 if kind in ("k2", "k2_pen", "ebna") else 0.0)
        got = {r.fam: r.score for r in frame.collect()}
        for i, f in enumerate(FAMILIES):
            assert got[i] == pytest.approx(s.local(f.var, f.parents), abs=1e-8), (kind, f)
    smoothed = {r.fam: r.score for r in C.log_likelihood(t, FAMILIES, 0.5).collect()}
    for i, f in enumerate(FAMILIES):
        rows = c.family(f.var, f.parents) + 0.5
        assert smoothed[i] == pytest.approx(float((rows * np.log(rows / rows.sum(axis=1, keepdims=True))).sum()))


def test_scores_stay_finite_without_some_states(spark):
    t = tally(spark, np.array([[0, 0], [1, 0], [0, 1], [1, 1], [0, 0]]), (3, 2))
    for f in (C.bic(t, [Family(0, (1,)), Family(1, (0,))], 5), C.aic(t, [Family(0), Family(1, (0,))])):
        assert all(math.isfinite(r.score) for r in f.collect())


def test_weights_equal_replication(spark):
    x = branching(200, 0)
    m = np.random.default_rng(0).integers(1, 5, 200)
    one, two = Counter(tally(spark, x, weight=m.astype(float)), n=float(m.sum())), Counter(tally(spark, np.repeat(x, m, axis=0)))
    for kind in ("bic", "k2", "dt", "dg"):
        a, b = Scores(one, kind, 1.0), Scores(two, kind, 1.0)
        assert a.local(2, (0, 1)) == pytest.approx(b.local(2, (0, 1)))


def test_spark_counts_equal_local_counts(spark):
    x, cards = mixed()
    t = tally(spark, x, cards)
    near, far = Counter(t), Counter(t, limit=0, batch=3)
    assert near.local and not far.local
    requests = [(0, 1), (3, 2, 5), (4,), ((1, 2), ((0, 1), (3, 2)))]
    far.prefetch(requests)
    assert far.jobs == 2
    assert np.allclose(near.table((3, 2, 5)), far.table((3, 2, 5)))
    assert np.allclose(near.table((2, 1), ((3, 2), (0, 1))), far.table((2, 1), ((0, 1), (3, 2))))
    assert np.allclose(near.family(5, (3, 0)), far.family(5, (3, 0)))
    assert far.jobs == 3


def test_index_round_trip_and_checks(spark):
    x, cards = mixed(50)
    t = tally(spark, x, cards)
    code = t.code([3, 1, 5])
    rows = t.df.select("x3", "x1", "x5", code.alias("c")).select("*", *[c.alias(f"y{i}") for i, c in enumerate(t.decode(F.col("c"), [3, 1, 5]))]).collect()
    assert all((r.x3, r.x1, r.x5) == (r.y0, r.y1, r.y2) and r.c == r.x3 + 4 * r.x1 + 12 * r.x5 for r in rows)
    bad = spark.createDataFrame([(0, 0), (None, 1), (5, 1)], "a int, b int")
    assert Tally.of(bad, ["a", "b"], (2, 2), strict=False).df.count() == 1
    with pytest.raises(Exception, match="no state"):
        Tally.of(bad, ["a", "b"], (2, 2)).df.collect()
    with pytest.raises(ValueError):
        Tally.of(bad, ["a", "b"], (1, 2))
    assert Tally.infer(spark.createDataFrame([(0, 2), (0, 1)], "a int, b int"), ["a", "b"]).cards == (2, 3)
    assert Tally.of(bad.limit(0), ["a", "b"], (2, 2)).df.count() == 0


def test_tests_and_tables_against_plain_numbers(spark):
    x, cards = mixed()
    t = tally(spark, x, cards)
    got = {r.req: (r.statistic, r.dof) for r in C.chi_square(t, [(0, 1, ()), (0, 2, (1,)), (3, 4, (0, 5))]).collect()}
    from tallygrid.operators.constraint import Tests

    tests = Tests(Counter(t))
    for i, (a, b, z) in enumerate([(0, 1, ()), (0, 2, (1,)), (3, 4, (0, 5))]):
        s, d = tests.statistic(a, b, z)
        assert got[i][0] == pytest.approx(s, abs=1e-6) and got[i][1] == d
    cpd = C.cpds(t, [Family(1, (0, 3)), Family(4)], 1.0)
    assert cpd.count() == 8 * 3 + 2
    sums = cpd.groupBy("var", "pcfg").agg(F.sum("p").alias("s")).collect()
    assert all(r.s == pytest.approx(1) for r in sums)
    none = C.conditional_table(tally(spark, np.array([[0, 0], [0, 1]]), (2, 2)), (0,), (1,), 0.0)
    assert {(r.pcfg, r.ncfg): r.p for r in none.collect()} == {(0, 0): 0.5, (0, 1): 0.5, (1, 0): 0.5, (1, 1): 0.5}


def test_parent_bound_of_the_published_example():
    # seventeen variables of three states, three of four; the one asked for has four
    assert parent_bounds([4] * 3 + [3] * 17, 422, 1.0)[0] == 5


def test_penalty_names(spark):
    with pytest.raises(ValueError):
        C.penalty_factor("what", 10)
    with pytest.raises(ValueError):
        Scores(None, "what")
    assert duckdb.sql("select lgamma(0.5)").fetchall()[0][0] == pytest.approx(math.lgamma(0.5))


def test_row_log_probability_is_one_projection(spark, monkeypatch):
    x, cards = mixed()
    t = tally(spark, x, cards)
    fams = [Family(0), Family(1, (0,)), Family(2, (0, 3)), Family(3), Family(4, (1,)), Family(5)]
    tables = C.cpds(t, fams, 1.0)
    got = C.row_log_probability(t.df, t, fams, tables)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") == t.df._jdf.queryExecution().executedPlan().toString().count("Exchange")
    p = {(r["var"], r.pcfg, r.state): r.p for r in tables.collect()}
    want = {}
    for r in t.df.collect():
        v = [r[f"x{i}"] for i in range(6)]
        want[tuple(v)] = sum(math.log(p[f.var, v[f.parents[0]] + (cards[f.parents[0]] * v[f.parents[1]] if len(f.parents) > 1 else 0) if f.parents else 0, v[f.var]]) for f in fams)
    for written in (20_000, 0):
        monkeypatch.setattr(C, "MOST_WRITTEN", written)
        rows = C.row_log_probability(t.df, t, fams, tables).collect()
        assert len(rows) == len(want) and all(r.logp == pytest.approx(want[tuple(r[f"x{i}"] for i in range(6))]) for r in rows)
    part = C.row_log_probability(t.df, t, fams, tables.filter("var > 0"), floor=1e-3).collect()
    assert all(r.logp < want[tuple(r[f"x{i}"] for i in range(6))] for r in part)


def test_each_once_at_any_share_of_repeats(spark):
    from tallygrid.cluster import each_once

    rows = [(i % 50, i % 7) for i in range(400)] + [(1000 + i, i) for i in range(300)] + [(7, 0)] * 300 + [(None, 3), (None, 3), (60, None), (60, 4)]
    got = sorted(((r.k, r.v) for r in each_once(spark.createDataFrame(rows, "k int, v int").repartition(5), "k", ["v"]).collect()), key=str)
    first = {}
    for k, v in rows:
        if k is not None:
            first.setdefault(k, []).append(v)
    want = [(k, None if None in vs else min(vs)) for k, vs in first.items()] + [(None, 3), (None, 3)]
    assert got == sorted(want, key=str)
    assert each_once(spark.createDataFrame([], "k int, v int"), "k", ["v"]).count() == 0
