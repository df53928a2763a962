from itertools import product

import numpy as np
import pytest

from tallygrid.network import ALIASES, METHODS, Network
from tallygrid.operators import constraint, search, sparse
from tallygrid.operators import graphs as G
from tallygrid.operators.counter import Counter
from tallygrid.operators.counting import Tally
from tallygrid.operators.scoring import Scores
from tallygrid.operators.search import Problem

from .data import branching, chain, collider, counter, mixed, tally


@pytest.fixture(scope="module")
def branch(spark):
    return counter(spark, branching(2000))


@pytest.fixture(scope="module")
def long(spark):
    return counter(spark, chain())


PLANTED = {(0, 1), (1, 2), (0, 3)}


def edges(a):
    return {(min(e), max(e)) for e in G.edges_of(a)}


@pytest.mark.parametrize("method", sorted(set(METHODS) - {"univ_bn"}))
def test_every_method_finds_the_planted_edges(branch, method):
    options = {"target": np.arange(len(branch.w), dtype=float)} if method in ("fi_k2", "rfe_k2") else {}
    net = Network(branch.cards).learn_structure(branch, method, max_parents=2, **options)
    assert net.adjacency.sum(axis=0).max() <= 2
    if method not in ("pc", "stable_pc"):
        assert G.is_dag(net.adjacency)
    need = 2 if method in ("bounded_tw", "k2_mb", "sartre", "gs", "causal_polytree", "binotears") else 3
    assert len(edges(net.adjacency) & PLANTED) >= need, net.edges()


def test_aliases_and_unknown_names(branch):
    for alias in ("rpcd", "exact", "ktree", "polytree", "sheaf", "tree"):
        assert ALIASES[alias] in METHODS
        Network(branch.cards).learn_structure(branch, alias)
    with pytest.raises(ValueError):
        Network(branch.cards).learn_structure(branch, "what")


def test_exact_search_equals_all_graphs(spark):
    c = counter(spark, branching(400, 5, 0.15)[:, :3])
    s = Scores(c, "bic")
    pairs, best = [(0, 1), (0, 2), (1, 2)], -np.inf
    for kinds in product((0, 1, 2), repeat=3):
        a = G.adjacency_of(3, [(x, y) if k == 1 else (y, x) for (x, y), k in zip(pairs, kinds, strict=True) if k])
        if G.is_dag(a):
            best = max(best, s.total(a))
    assert s.total(search.exact_search(Problem(c), s)) == pytest.approx(best, abs=1e-9)
    with pytest.raises(ValueError):
        search.exact_search(Problem(counter(spark, chain(50, 21))), s)


def test_hill_climb_ends_where_no_change_helps(long):
    s = Scores(long, "bic")
    a = search.hill_climb(Problem(long), s)
    base = s.total(a)
    for u in range(8):
        for v in range(8):
            b = a.copy()
            if a[u, v]:
                b[u, v] = 0
                assert s.total(b) <= base + 1e-9
                b[v, u] = 1
            elif u != v:
                b[u, v] = 1
            if G.is_dag(b) and b.sum(axis=0).max() <= Problem(long).cap():
                assert s.total(b) <= base + 1e-9
    assert s.total(search.tabu(Problem(long), s)) >= base - 1e-9


def test_start_is_checked_and_used(long):
    s = Scores(long, "bic")
    p, q = Problem(long), Problem(long)
    cold = search.hill_climb(p, s)
    warm = search.hill_climb(q, s, cold)
    assert (cold == warm).all() and q.notes["iterations"] == 0 < p.notes["iterations"]
    cyc = np.zeros((8, 8), dtype=int)
    cyc[0, 1] = cyc[1, 0] = 1
    for bad in (cyc, np.zeros((3, 3)), np.full((8, 8), 2)):
        with pytest.raises(ValueError):
            search.checked_start(p, bad)
    full = np.triu(np.ones((8, 8), dtype=int), 1)
    mask = np.ones((8, 8))
    mask[0, 7] = mask[7, 0] = 0
    kept = search.checked_start(Problem(long, mask=mask, max_parents=2), full)
    assert kept[:, 7].nonzero()[0].tolist() == [1, 2]


@pytest.mark.parametrize("method", ["k2", "bic", "stable_hc", "tabu", "gs", "rcd", "pc", "lpa", "chow_liu", "causal_polytree", "bounded_tw", "dmbbn", "levelwise", "iterdsla", "dg_ndg", "dt", "sartre"])
def test_masks_orders_and_caps_hold(branch, method):
    mask = np.ones((4, 4))
    mask[0, 1] = mask[1, 0] = 0
    order = [3, 2, 1, 0]
    net = Network(branch.cards).learn_structure(branch, method, mask=mask, permutation=order, max_parents=1)
    assert not net.adjacency[0, 1] and not net.adjacency[1, 0] and net.adjacency.sum(axis=0).max() <= 1
    if method in ("k2", "bic", "stable_hc", "tabu", "gs", "rcd", "dg_ndg", "dt", "bounded_tw", "sartre"):
        assert all(order.index(u) < order.index(v) for u, v in net.edges())
    with pytest.raises(ValueError):
        Network(branch.cards).learn_structure(branch, method, mask=np.triu(np.ones((4, 4))))


def test_penalties(long):
    none, k2 = (Network(long.cards).learn_structure(long, m, **o).adjacency for m, o in (("k2_pen", {"penalty": 0.0, "permutation": range(8)}), ("k2", {})))
    assert (none == k2).all() or none.sum() == k2.sum()
    sums = [Network(long.cards).learn_structure(long, "k2_pen", penalty=f).adjacency.sum() for f in (0.5, 5.0, 500.0)]
    assert sums[0] >= sums[1] >= sums[2] == 0


def test_colliders_are_directed(spark):
    c = counter(spark, collider())
    for m in ("rebane_pearl", "lpa", "pc", "stable_pc"):
        a = Network(c.cards).learn_structure(c, m).adjacency
        assert a[0, 2] and a[1, 2] and not a[2, 0] and not a[2, 1], m
        assert a[4].sum() == a[:, 4].sum() == 0
    for m in ("chow_liu", "rebane_pearl", "lpa", "lpa_marginal", "causal_polytree"):
        a = Network(c.cards).learn_structure(c, m).adjacency
        assert a.sum() == len(edges(a)) and G.skeleton(a).sum() // 2 <= 4  # singly connected at most
        assert len(G.components(G.skeleton(a))) == 5 - a.sum()


def test_both_ways_of_counting_give_one_structure(spark):
    x, cards = mixed(400)
    t = tally(spark, x, cards)
    near, far = Counter(t), Counter(t, limit=0)
    for m in ("k2", "stable_hc", "stable_pc", "chow_liu", "dg_ndg", "sartre"):
        one, two = (Network(cards).learn_structure(c, m, max_parents=2).adjacency for c in (near, far))
        assert (one == two).all(), m
    assert far.jobs < 60


def test_fits_need_no_configurations_in_memory(spark):
    """Masks, weights under acyclicity and importance orders are the same from aggregates as from memory."""
    rng = np.random.default_rng(8)
    x = np.column_stack([branching(600), rng.integers(0, 2, 600)])
    y = np.round(2.0 * x[:, 2] + x[:, 0] * 0.5 + rng.normal(size=600) * 0.1, 1)
    import pandas as pd
    from pyspark.sql import functions as F

    frame = pd.DataFrame(x, columns=[f"x{i}" for i in range(5)]).assign(y=y)
    priced = spark.createDataFrame(frame).groupBy(*[f"x{i}" for i in range(5)]).agg(F.count("*").cast("double").alias("w"), F.avg("y").alias("y"))
    t = Tally(priced.selectExpr(*[f"CAST(x{i} AS INT) AS x{i}" for i in range(5)], "w", "y"), (2,) * 5)
    near, far = Counter(t), Counter(t, limit=0)
    assert near.local and not far.local
    assert (sparse.elastic_mask(near, rounds=25) == sparse.elastic_mask(far, rounds=25)).all()
    for measure in ("corr", "f", "mi"):
        assert np.allclose(sparse.target_importance(near, measure, "y"), sparse.target_importance(far, measure, "y"))
        assert np.allclose(sparse.target_importance(near, measure, near.more["y"]), sparse.target_importance(near, measure, "y"))
    for order in (sparse.importance_order, sparse.redundancy_order, sparse.elimination_ranking):
        assert order(near, "y") == order(far, "y")
        assert order(near, None) == order(far, None)
    assert sparse.elimination_ranking(near, "y")[0] == 2 == sparse.importance_order(near, "y")[0]
    with pytest.raises(ValueError):
        sparse.importance_order(far, near.more["y"])
    small = Counter(tally(spark, x[:, :3]))
    away = Counter(tally(spark, x[:, :3]), limit=0)
    assert (sparse.notears(Problem(small), rounds=1) == sparse.notears(Problem(away), rounds=1)).all()


def test_pair_tables_at_once_and_extensions(spark):
    x, cards = mixed(500)
    a, b = counter(spark, x, cards), counter(spark, x, cards)
    a.pairs()
    for i in range(6):
        for j in range(i + 1, 6):
            assert (a.table((i, j)) == b.table((i, j))).all()
    for var, parents, more in ((2, (), [0, 1, 5]), (3, (1, 4), [0, 2, 5])):
        for u, t in zip(more, b.extensions(var, parents, more), strict=True):
            assert (t == b.family(var, sorted((*parents, u)))).all()
    for kind in ("bic", "aic", "k2", "k2_pen", "ebna"):
        one, two = Scores(a, kind), Scores(b, kind)
        assert one.added(3, (1, 4), [0, 2, 5]).tolist() == [two.local(3, (1, 4, u)) for u in (0, 2, 5)]


def test_treewidth_is_bounded(spark):
    x, cards = mixed()
    p = Problem(counter(spark, x, cards), seed=4)
    a = search.bounded_treewidth(p, Scores(p.counter, "aic"), k=2)
    order, filled = G.elimination_order(G.moral(a))
    assert max(map(len, G.triangulated_cliques(order, filled))) <= 3
    tree, earlier = search.k_tree(7, 2, np.random.default_rng(0))
    assert tree.sum() // 2 == 3 + 2 * 4 and max(map(len, earlier.values())) == 2


def test_clusters_hold_the_dependent_trio(spark):
    rng = np.random.default_rng(37)
    a = rng.integers(0, 2, 2000)
    near = lambda: np.where(rng.random(2000) < 0.05, 1 - a, a)
    c = counter(spark, np.column_stack([a, near(), near(), *rng.integers(0, 2, (3, 2000))]))
    out = search.variable_clusters(c)
    assert sorted(map(sorted, out["clusters"])) == [[0, 1, 2], [3], [4], [5]]
    assert len(search.variable_clusters(c, stop=-np.inf)["merges"]) == 5


def test_orders_from_importance(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, (2000, 8))
    c = counter(spark, x)
    target = 3 * c.x[:, 5] + 1.6 * c.x[:, 2] + rng.normal(0, 0.3, len(c.x))
    for order in (sparse.importance_order(c, target, m) for m in ("mi", "f", "corr")):
        assert order[:2] == [5, 2]
    assert sparse.redundancy_order(c, target)[:2] == [5, 2] and sparse.elimination_ranking(c, target)[:2] == [5, 2]
    assert sorted(sparse.importance_order(c, None)) == sorted(sparse.elimination_ranking(c, np.ones(len(c.x)))) == list(range(8))


def test_notears_recovers_a_chain(spark):
    rng = np.random.default_rng(11)
    cols = [rng.integers(0, 2, 3000)]
    for source in (0, 1, 0):
        cols.append((rng.random(3000) < 1 / (1 + np.exp(-2.5 * (2 * cols[source] - 1)))).astype(int))
    c = counter(spark, np.column_stack(cols))
    a = sparse.notears(Problem(c))
    assert G.is_dag(a) and len(edges(a) & PLANTED) >= 2
    with pytest.raises(ValueError):
        sparse.notears(Problem(counter(spark, *mixed(60))))


def test_markov_trees(branch):
    a, features = search.markov_trees(Problem(branch))
    assert (a == a.T).all() and edges(a) >= PLANTED
    assert all(len({v for v, _ in f}) == len(f) for f in features)


def test_graph_kernels():
    rng = np.random.default_rng(3)
    for n in (5, 8):
        a = np.triu(rng.random((n, n)) < 0.4, 1).astype(int)
        m = G.moral(a)
        for how in ("min_fill", "min_degree", "mcs", "lexm"):
            order, filled = G.elimination_order(m, how)
            assert sorted(order) == list(range(n)) and ((filled - m) >= 0).all()
            cliques = G.triangulated_cliques(order, filled)
            assert set(cliques) <= set(G.maximal_cliques(filled)) | set(cliques)
            assert {v for c in cliques for v in c} == set(range(n))
            tree = G.junction_tree(cliques)
            assert len(tree) == len(cliques) - 1
            for v in range(n):  # running intersection
                inside = [i for i, c in enumerate(cliques) if v in c]
                assert len(G.components(G.skeleton(G.adjacency_of(len(cliques), [(i, j) for i, j, s in tree if v in s])), inside)) == 1
        atoms = G.clique_separators(m)
        assert {v for atom in atoms for v in atom} == set(range(n))
        r = G.closure_of(a)
        assert all(r[u, v] == G.reaches(a, u, v) for u in range(n) for v in range(n))
    assert G.strong_components(G.adjacency_of(4, [(0, 1), (1, 2), (2, 0), (2, 3)])) == [[0, 1, 2], [3]]
    assert G.topological(G.adjacency_of(2, [(0, 1), (1, 0)])) is None
    assert G.ordered_structure([(0, 1), (1, 2)]) == [((), (0, 1)), ((1,), (2,))]
    assert G.structure_matrix([((), (0, 1)), ((1,), (2,))]).tolist() == [[0, 2, 0, 1, 0, 0], [1, 1, 1, 2, 0, 0]]
    assert G.capped_cliques(np.ones((4, 4)) - np.eye(4), 2)[0] == (0, 1)
    assert G.neighbourhoods([(0, 1), (1, 2)], 3) == [[1], [0, 2], [1]] and G.neighbour_cliques([[1], [0]]) == [(0, 1)]
    assert G.clique_graph([(0, 1), (1, 2)]).tolist() == [[0, 1], [1, 0]]
    with pytest.raises(ValueError):
        G.elimination_order(np.zeros((2, 2)), "what")


def test_conditional_information(spark):
    c = counter(spark, collider())
    assert constraint.conditional(c, 0, 1, 2) > search.information(c)[0, 1] + 0.05
