import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygrid.network import Network, pdg_nodes
from tallygrid.operators import eda, factors, local_structure, relational, sampling, sparse
from tallygrid.operators import graphs as G
from tallygrid.operators.counter import Counter
from tallygrid.operators.counting import Family, cpds
from tallygrid.operators.factors import Circuit, Tables

from .data import branching, chain, context, counter, mixed, tally

TWO = Tables((2, 2), [(), (0,)], [np.array([0.8, 0.2]), np.array([[0.9, 0.1], [0.2, 0.8]])])


@pytest.fixture(scope="module")
def net(spark):
    x, cards = mixed()
    c = counter(spark, x, cards)
    n = Network(cards)
    n.set_structure(G.adjacency_of(6, [(0, 1), (0, 2), (1, 3), (2, 3), (3, 4), (1, 5), (4, 5)]))
    return n.learn_parameters(c)


def test_two_variables():
    assert factors.most_probable(TWO)[0] == [0, 0] and factors.most_probable(TWO)[1] == pytest.approx(0.72)
    assert [x for x, _ in factors.k_most_probable(TWO, 3)] == [[0, 0], [1, 1], [0, 1]]
    assert factors.most_probable(TWO, {1: 1}, "loopy")[0] == [1, 1]
    with pytest.raises(ValueError):
        factors.most_probable(TWO, {1: 2})
    with pytest.raises(ValueError):
        factors.most_probable(TWO, None, "what")


def test_exact_inference_equals_the_joint(net):
    t = net.tables
    joint = t.joint().values
    assert joint.sum() == pytest.approx(1)
    for evidence in ({}, {3: 2}, {5: 1, 0: 1}):
        f = t.joint().masked(evidence).values
        c = Circuit.compile(t)
        assert c.p_evidence(evidence) == pytest.approx(f.sum())
        for v, (a, b) in enumerate(zip(net.marginals(evidence), c.marginals(evidence), strict=True)):
            want = f.sum(axis=tuple(u for u in range(6) if u != v)) / f.sum()
            assert np.allclose(a, want, atol=1e-9) and np.allclose(b, want, atol=1e-9)
        best = [int(i) for i in np.unravel_index(f.argmax(), f.shape)]
        assert net.most_probable(evidence, "ve")[0] == c.mpe(evidence)[0] == best
        for method in ("partition", "astar"):
            top = net.k_most_probable(12, evidence, method)
            assert np.allclose([p for _, p in top], np.sort(f.ravel())[::-1][:12])
            assert len({tuple(x) for x, _ in top}) == 12
    assert c.size()["cliques"] == len(c.cliques)
    zero = Tables((2, 2), [(), (0,)], [np.array([1.0, 0.0]), np.array([[0.5, 0.5], [0.5, 0.5]])])
    assert np.allclose(factors.marginals(zero, {0: 1})[1], 0.5) and Circuit.compile(zero).p_evidence({0: 1}) == 0
    assert len(factors.k_most_probable(zero, 9)) == 2 and factors.k_most_probable(zero, 0) == []


def test_approximate_inference(spark):
    c = counter(spark, chain(1500, 5, 11, 0.15))
    n = Network(c.cards)
    n.set_structure(G.adjacency_of(5, [(i, i + 1) for i in range(4)]))
    n.learn_parameters(c)
    for m in ("loopy", "mean_field"):
        for a, b in zip(n.marginals({0: 1}, m), n.marginals({0: 1}), strict=True):
            assert int(a.argmax()) == int(b.argmax())
            assert m == "mean_field" or np.allclose(a, b, atol=1e-4)  # exact on trees
    assert n.most_probable({0: 1}, "loopy")[0] == n.most_probable({0: 1}, "srmp")[0] == n.most_probable({0: 1}, "ve")[0]


def test_relational_inference_equals_tables(spark):
    x, cards = mixed()
    t = tally(spark, x, cards)
    fams = [Family(0), Family(1, (0,)), Family(2, (0, 1)), Family(3), Family(4, (3,)), Family(5)]
    fs = relational.relations(t, fams, cpds(t, fams, 1.0))
    n = Network(cards)
    n.set_structure(G.adjacency_of(6, [(0, 1), (0, 2), (1, 2), (3, 4)]))
    n.learn_parameters(Counter(t))
    got = {r.x1: r.p for r in relational.normalised(relational.eliminate(fs, [1], fams, evidence={2: 1})).collect()}
    assert np.allclose([got[i] for i in range(3)], n.marginals({2: 1})[1])
    assert relational.eliminate(fs, range(6), fams).df.count() == np.prod(cards)
    top = relational.eliminate(fs, [], fams, "max").df.collect()[0].p
    assert top == pytest.approx(n.most_probable(None, "ve")[1])
    with pytest.raises(ValueError):
        relational.levels(relational.edge_frame(spark, [(0, 1), (1, 0)]), 2)


def test_factorization(spark, net):
    x, cards = mixed()
    f = net.to_factorization()
    joint = net.tables.joint().values
    for z in np.ndindex(*joint.shape):
        assert f.probability(z) == pytest.approx(joint[z], abs=1e-12)
    g = net.to_factorization(max_size=2, counter=counter(spark, x, cards))
    assert max(len(o) + len(n) for o, n in g.parts) <= 2 and all(np.allclose(t.sum(axis=1), 1) for t in g.tables)


def test_trees_follow_the_context(spark):
    c = counter(spark, context())
    t = local_structure.learn_local(c, 2, (0, 1))
    assert t.n_leaves == 3 and t.dense().shape == (4, 2)
    assert np.allclose(t.dense()[0], t.dense()[2])  # x0 = 0: x1 doesn't matter; the first parent is fastest
    assert local_structure.learn_local(c, 2, (0, 1), max_leaves=1).n_leaves == 1
    g = local_structure.learn_local(c, 2, (0, 1, 3), "dg", 1.0)
    assert g.n_leaves <= 4 and len(t.features()) == 6
    for kind, alpha, by in (("dg", 0.0, None), ("dt", 0.0, "k2"), ("what", 1.0, None), ("dt", 1.0, "what")):
        with pytest.raises(ValueError):
            local_structure.learn_local(c, 2, (0, 1), kind, alpha, by=by)


def test_local_networks_score_and_sample(spark):
    x = context()
    t = tally(spark, x)
    n = Network.fit(t, "k2", local="dg", max_parents=2)
    assert n.has_local_structure and n.n_parameters() <= Network.fit(t, "k2", max_parents=2).n_parameters()
    rows = n.log_probability(t, floor=0.0).collect()
    dense = n.tables
    for r in rows:
        assert r.logp == pytest.approx(np.log(dense.probability([r.x0, r.x1, r.x2, r.x3])))
    drawn = n.sample(spark, 20_000, seed=5).agg(*[F.avg(f"x{i}").alias(f"x{i}") for i in range(4)]).first()
    assert np.allclose([drawn[f"x{i}"] for i in range(4)], x.mean(axis=0), atol=0.03)
    assert len(pdg_nodes(n.local)) <= sum(t.n_leaves for t in n.local.values())


def test_sampling(spark, net):
    a = net.sample(spark, 20_000, seed=1)
    assert a.orderBy("id").limit(50).collect() == net.sample(spark, 20_000, seed=1).orderBy("id").limit(50).collect()
    frame = a.toPandas()
    for v, p in enumerate(net.marginals()):
        assert np.allclose(np.bincount(frame[f"x{v}"], minlength=len(p)) / 20_000, p, atol=0.03)
    given = sampling.conditioned(spark, net.to_circuit(), 20_000, {3: 1}, seed=2).toPandas()
    assert (given.x3 == 1).all()
    for v, p in enumerate(net.marginals({3: 1})):
        assert np.allclose(np.bincount(given[f"x{v}"], minlength=len(p)) / 20_000, p, atol=0.03)
    assert np.allclose(sampling.clean([[-1.0, 0.0], [2.0, 2.0]]), [[0.5, 0.5], [0.5, 0.5]])


def test_copula_keeps_the_correlation(spark):
    rng = np.random.default_rng(0)
    z = rng.multivariate_normal([0, 0, 0], [[1, 0.8, 0], [0.8, 1, 0], [0, 0, 1]], 400)
    x = np.column_stack([np.digitize(z[:, 0], [-0.5, 0.5]), np.digitize(z[:, 1], [-1, 0, 1]), np.digitize(z[:, 2], [-0.5, 0.5])])
    model = sampling.fit_copula(x, rounds=40, warm=10)
    assert model["corr"][0, 1] > 0.6 and abs(model["corr"][0, 2]) < 0.2
    drawn = sampling.sample_copula(spark, model, 3000, seed=1).toPandas()
    assert np.corrcoef(drawn.x0, drawn.x1)[0, 1] > 0.5 and set(drawn.x1) <= {0, 1, 2, 3}
    df = spark.createDataFrame([*map(tuple, x.tolist()), (None, 1, 1)], "a int, b int, c int")
    whole = sampling.fit_copula_frame(df, ["a", "b", "c"])
    assert 0.6 < whole["corr"][0, 1] < 0.9 and abs(whole["corr"][0, 2]) < 0.2
    again = sampling.sample_copula(spark, whole, 4000, seed=1).toPandas()
    for j, name in enumerate(("x0", "x1", "x2")):
        assert np.allclose(np.bincount(again[name].astype(int), minlength=4) / 4000, np.bincount(x[:, j], minlength=4) / 400, atol=0.04)
    with pytest.raises(ValueError):
        sampling.fit_copula_frame(df.limit(0), ["a"])


def test_logistic_tables(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2, (2, 3000))
    c = counter(spark, np.column_stack([a, b, np.where(rng.random(3000) < 0.1, 1 - (a ^ b), a ^ b)]))
    t = sparse.logistic_table(c, 2, (0, 1))
    assert np.allclose(t[:, 1], [0.1, 0.9, 0.9, 0.1], atol=0.05) or np.allclose(t[:, 1].round(), [0, 1, 1, 0])
    assert np.allclose(sparse.logistic_table(c, 0, ()).sum(axis=1), 1)


def test_facade(spark):
    x = branching(500)
    t = tally(spark, x)
    c = Counter(t)
    n = Network.fit(t, "k2")
    assert "4 variables" in repr(n) and n.score(c, "bic") <= n.score(c, "aic")
    s = n.summary(c)
    assert set(s) == {"edges", "score", "parents", "blankets", "degree"} and n.topological_order()[0] == 0
    with pytest.raises(ValueError):
        n.add_edge(3, 0) if n.has_edge(0, 3) else n.add_edge(1, 1)
    n.remove_edge(0, 3)
    assert not n.has_edge(0, 3) and n.children(0) == [1]
    with pytest.raises(ValueError):
        n.marginals()
    n.learn_structure(c, "k2", candidate_parents="mi:1")
    with pytest.raises(ValueError):
        n.learn_structure(c, "k2", candidate_parents="what")

    class Uniform:
        def learn(self, counter, families):
            return [np.full((int(np.prod([2] * len(f.parents))), 2), 0.5) for f in families]

    assert n.learn_parameters(c, Uniform()).marginals()[0].tolist() == [0.5, 0.5]
    with pytest.raises(ValueError):
        n.learn_parameters(c, "what")
    with pytest.raises(ValueError):
        Network((1, 2))
    assert Network.fit(t, "stable_hc", parameters="logistic").tables is not None


def test_optimisation(spark):
    ones = sum((F.col(f"x{i}") for i in range(6)), F.lit(0))
    parts = eda.Components(learning=eda.NetworkLearning("univ_bn"), stop=eda.MaxGenerations(6), replacement=eda.Elitist())
    out = eda.run(spark, (2,) * 6, ones, 120, parts, eda.Kept(models=True, populations=True), seed=3)
    assert out.fitness == 6 and out.best == [1] * 6
    assert [s.generation for s in out.statistics] == list(range(6)) and len(out.models) == 6
    assert all(a.best <= b.best for a, b in zip(out.statistics, out.statistics[1:], strict=False))
    assert eda.Kept.of(eda.Kept(True, False, True, False, True).flags()) == eda.Kept(True, False, True, False, True)
    with pytest.raises(ValueError):
        eda.run(spark, (2,), ones, 10, eda.Components(stop=None))
