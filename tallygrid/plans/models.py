"""Learners, inference, sampling and the optimisation loop on the planted table and on the sampled states."""

from __future__ import annotations

from itertools import combinations, permutations
from itertools import product as combos

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.cluster import cut, each_once
from tallygrid.functions.special import chi2_isf
from tallygrid.network import METHODS, Network, pdg_nodes
from tallygrid.operators import counting as C
from tallygrid.operators import eda, experiments, local_structure, relational, sampling, search, sparse
from tallygrid.operators.counter import Counter
from tallygrid.operators.counting import Tally
from tallygrid.operators.ordered import first_k
from tallygrid.plans import fixture as X
from tallygrid.plans import statistics as S
from tallygrid.plans.tables import table

STATES = (2, 7, 2, 2, 2, 2, 2)


def counter(spark: SparkSession, d: str) -> Counter:
    return Counter(X.tally(spark, d))


def learnt(spark: SparkSession, d: str, method: str, **options) -> DataFrame:
    """Edges that a method finds in the planted table."""
    c = counter(spark, d)
    net = Network(c.cards).learn_structure(c, method, **options)
    return relational.edge_frame(spark, net.edges())


def mood(spark: SparkSession, d: str) -> Counter:
    """The sampled states, each row once, rows with missing or invalid states left out."""
    columns = [f"c{i}" for i in range(7)]
    once = each_once(table(spark, d, "moodstate_data_n2000"), "row_id", columns)
    return Counter(Tally.of(once, columns, STATES, strict=False))


def _learner(method: str, **options):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return learnt(spark, d, method, **options)

    query.__name__ = f"learn_{method}"
    return query


def importance_target(spark: SparkSession, d: str, method: str, **options) -> DataFrame:
    """Ordered by importance for the mean price of each configuration."""
    priced = X.rows(spark, d).groupBy(*[f"x{i}" for i in range(5)]).agg(F.count("*").cast("double").alias("w"), F.avg("l_extendedprice").alias("price"))
    c = Counter(Tally(priced, X.CARDS))
    net = Network(c.cards).learn_structure(c, method, target="price", **options)
    return relational.edge_frame(spark, net.edges())


def learn_fi_k2(spark, d):
    return importance_target(spark, d, "fi_k2")


def learn_rfe_k2(spark, d):
    return importance_target(spark, d, "rfe_k2", measure="rfe")


def learn_binotears(spark, d):
    c = Counter(Tally(X.tally(spark, d).df.groupBy("x0", "x1", "x2", "x3").agg(F.sum("w").alias("w")), X.CARDS[:4]))
    return relational.edge_frame(spark, Network(c.cards).learn_structure(c, "binotears").edges())


def mood_learners(spark, d):
    """Edges found by many methods in the sampled states."""
    c = mood(spark, d)
    rows = []
    for m in sorted(set(METHODS) - {"binotears", "fi_k2", "rfe_k2", "univ_bn"}):
        net = Network(c.cards).learn_structure(c, m)
        rows += [(m, u, v) for u, v in net.edges()]
    return spark.createDataFrame(rows, "method string, src int, dst int")


def variable_clusters(spark, d):
    """Merges in order, the clusters as masks of their variables."""
    out = search.variable_clusters(counter(spark, d))
    return spark.createDataFrame([(i, sum(1 << v for v in a), sum(1 << v for v in b), round(float(s), 4)) for i, (a, b, s) in enumerate(out["merges"])], "step int, a int, b int, log_bf double")


def markov_structure(spark, d):
    c = counter(spark, d)
    a, features = search.markov_trees(search.Problem(c))
    return spark.createDataFrame([(int(u), int(v), len(features)) for u, v in zip(*np.nonzero(np.triu(a)), strict=True)], "u int, v int, n_features int")


# structures with exact counterparts

K2_SCORES = f"WITH {X.SQL}, {X.families_sql()}, sc AS (SELECT fam, round(sum(lgamma(c.n + 1.0 / c.k) - lgamma(1.0 / c.k) + (lgamma(1.0) - lgamma(t.total + 1.0)) / c.k), 6) AS score FROM cell c JOIN cfgt t USING (fam, pcfg) GROUP BY fam)"


def k2_structure(spark, d):
    """Natural order, at most two parents."""
    return learnt(spark, d, "k2", max_parents=2)


def chow_liu_tree(spark, d):
    """Undirected edges of the tree."""
    return relational.skeleton_edges(learnt(spark, d, "chow_liu"))


def exact_dp_3var(spark, d):
    """The best graph over x0, x1 and x2 by likelihood with penalty, as its total."""
    c = Counter(Tally(X.tally(spark, d).df.groupBy("x0", "x1", "x2").agg(F.sum("w").alias("w")), X.CARDS[:3]))
    net = Network(c.cards).learn_structure(c, "levelwise", alpha=0.0)
    return spark.createDataFrame([(round(net.score(c, "bic"), 3),)], "score double")


def optimal_scores(spark, d):
    """Totals that three searches reach with at most two parents; the SQL is the optimum over all orders of the variables."""
    c = counter(spark, d)
    rows = [(m, round(Network(c.cards).learn_structure(c, m, max_parents=2, alpha=0.0).score(c, "bic"), 3)) for m in ("levelwise", "stable_hc", "tabu")]
    return spark.createDataFrame(rows, "method string, score double")


def bic_addonly(spark, d):
    """At most one parent, natural order."""
    return learnt(spark, d, "bic", permutation=range(5), max_parents=1, alpha=0.0)


# graphs

EDGES = [(0, 1), (1, 2), (0, 3), (2, 4), (3, 4)]


def _edges(spark: SparkSession) -> DataFrame:
    return relational.edge_frame(spark, EDGES)


def markov_blanket(spark, d):
    return relational.blankets(_edges(spark))


def moral_graph(spark, d):
    return relational.moral_edges(_edges(spark))


def skeleton(spark, d):
    return relational.skeleton_edges(_edges(spark))


def ancestor_closure(spark, d):
    return relational.closure(_edges(spark))


def topo_level(spark, d):
    return relational.levels(_edges(spark), 5)


# inference, relational

def _factors(spark, d):
    t = X.tally(spark, d)
    return t, relational.relations(t, X.NETWORK, C.cpds(t, X.NETWORK, 1.0))


def full_joint_enumeration(spark, d):
    _, fs = _factors(spark, d)
    r = relational.eliminate(fs, range(5), X.NETWORK)
    return r.df.select(*[f"x{i}" for i in range(5)], F.round("p", 8).alias("p"))


def joint_probability(spark, d):
    """Of every observed configuration."""
    t, fs = _factors(spark, d)
    r = relational.eliminate(fs, range(5), X.NETWORK)
    return t.df.drop("w").join(r.df, [f"x{i}" for i in range(5)]).select(*[f"x{i}" for i in range(5)], F.round("p", 8).alias("p"))


def ve_marginal(spark, d):
    _, fs = _factors(spark, d)
    return relational.normalised(relational.eliminate(fs, [2], X.NETWORK)).select("x2", F.round("p", 8).alias("p"))


def ve_marginal_evidence(spark, d):
    _, fs = _factors(spark, d)
    return relational.normalised(relational.eliminate(fs, [0], X.NETWORK, evidence={2: 1, 4: 0})).select("x0", F.round("p", 8).alias("p"))


def p_evidence(spark, d):
    _, fs = _factors(spark, d)
    return relational.eliminate(fs, [0], X.NETWORK, evidence={2: 1, 3: 0}).df.agg(F.round(F.sum("p"), 8).alias("p"))


def top_k_configs(spark, d):
    _, fs = _factors(spark, d)
    r = relational.eliminate(fs, range(5), X.NETWORK).df
    return r.select(*[f"x{i}" for i in range(5)], F.round("p", 10).alias("p")).orderBy(F.desc("p"), *[f"x{i}" for i in range(5)]).limit(10)


def map_config(spark, d):
    """Given x4 = 2, by elimination with maxima on the network's tables."""
    c = counter(spark, d)
    net = Network(c.cards)
    net.set_structure(np.array([[1 if (u, v) in [(0, 1), (1, 2), (0, 3)] else 0 for v in range(5)] for u in range(5)]))
    x, p = net.learn_parameters(c).most_probable({4: 2}, "ve")
    return spark.createDataFrame([(*x, round(p, 8))], ", ".join([*[f"x{i} int" for i in range(5)], "p double"]))


def _network(spark, d) -> Network:
    c = counter(spark, d)
    net = Network(c.cards)
    net.set_structure(np.array([[1 if (u, v) in [(0, 1), (1, 2), (0, 3)] else 0 for v in range(5)] for u in range(5)]))
    return net.learn_parameters(c)


def circuit_marginals(spark, d):
    rows = [(v, s, round(float(p), 8)) for v, ps in enumerate(_network(spark, d).to_circuit().marginals({2: 1})) for s, p in enumerate(ps)]
    return spark.createDataFrame(rows, "v int, s int, p double")


def k_best_partition(spark, d):
    return spark.createDataFrame([(*x, round(p, 10)) for x, p in _network(spark, d).k_most_probable(6)], ", ".join([*[f"x{i} int" for i in range(5)], "p double"]))


def _marginal_rows(spark, d, method: str, digits: int) -> DataFrame:
    rows = [(v, s, round(float(p), digits)) for v, ps in enumerate(_network(spark, d).marginals({2: 1}, method)) for s, p in enumerate(ps)]
    return spark.createDataFrame(rows, "v int, s int, p double")


def loopy_marginals(spark, d):
    """Given x2 = 1; exact, as the network is a forest."""
    return _marginal_rows(spark, d, "loopy", 4)


def mean_field_marginals(spark, d):
    return _marginal_rows(spark, d, "mean_field", 6)


def map_by_messages(spark, d):
    """Given x4 = 2, by two kinds of messages; exact, as the network is a forest."""
    net = _network(spark, d)
    rows = [(m, *net.most_probable({4: 2}, m)[0]) for m in ("loopy", "srmp")]
    return spark.createDataFrame(rows, ", ".join(["method string", *[f"x{i} int" for i in range(5)]]))


def factorization_tables(spark, d):
    """Ordered cliques of the planted tree with P(new | overlap)."""
    f = _network(spark, d).to_factorization()
    rows = [(i, q, k, round(float(p), 8)) for i, t in enumerate(f.tables) for q, row in enumerate(t) for k, p in enumerate(row)]
    return spark.createDataFrame(rows, "pos int, ocfg int, ncfg int, p double")


def row_logprob(spark, d):
    t = X.tally(spark, d)
    rows = C.row_log_probability(t.df, t, X.NETWORK, C.cpds(t, X.NETWORK, 1.0))
    return rows.select(*[f"x{i}" for i in range(5)], F.round("logp", 6).alias("logp"))


def mean_ll(spark, d):
    t = X.tally(spark, d)
    rows = C.row_log_probability(t.df, t, X.NETWORK, C.cpds(t, X.NETWORK, 1.0))
    return rows.agg(F.round(F.sum(F.col("logp") * F.col("w")) / F.sum("w"), 6).alias("ll"))


# local structure

TREE_PARENTS = (0, 1, 4)


def _tree(spark, d):
    return local_structure.learn_local(counter(spark, d), 3, TREE_PARENTS)


def decision_tree_route(spark, d):
    """Rows counted by the leaf of the tree of x3; the tree splits on its planted parent."""
    t, tree = X.tally(spark, d), _tree(spark, d)
    return t.df.select(tree.route_column().alias("leaf"), "w").groupBy("leaf").agg(F.sum("w").alias("n"))


def dt_features(spark, d):
    return spark.createDataFrame([(i, v, s) for i, f in enumerate(_tree(spark, d).features()) for v, s in f], "feature int, var int, state int")


def local_dg_logprob(spark, d):
    c = counter(spark, d)
    net = Network(c.cards).learn_structure(c, "dg").learn_local_structure(c, "dg")
    return net.log_probability(X.tally(spark, d)).select(*[f"x{i}" for i in range(5)], F.round("logp", 6).alias("logp"))


def pdg_parameters(spark, d):
    c = counter(spark, d)
    net = Network(c.cards).learn_structure(c, "k2").learn_local_structure(c, "dg")
    return spark.createDataFrame([(v, list(p)) for v, p in pdg_nodes(net.local)], "var int, p array<double>")


def logistic_cpd(spark, d):
    table_ = sparse.logistic_table(counter(spark, d), 1, (0, 3))
    return spark.createDataFrame([(c, s, round(float(p), 4)) for c, row in enumerate(table_) for s, p in enumerate(row)], "pcfg int, state int, p double")


# sampling and optimisation

N_DRAWS = 20_000


def _arithmetic(v: int) -> str:
    a = f"((id * 7919 + {v * 15485863}) % {X.PRIME})"
    return f"(({a} * {a} + 3 * {a} + {v}) % {X.PRIME}) / {float(X.PRIME)!r}D"


def ancestral_sample(spark, d):
    """Counts of rows drawn with arithmetic numbers in place of random ones."""
    net = _network(spark, d)
    drawn = sampling.ancestral(spark, net.tables, N_DRAWS, u=lambda v: f"({_arithmetic(v)})")
    return drawn.groupBy(*[f"x{i}" for i in range(5)]).agg(F.count("*").alias("n"))


def random_sample(spark, d):
    """As many rows as lineitem has, and the shares of each state."""
    drawn = _network(spark, d).sample(spark, X.n_rows(spark, d), seed=7)
    return C.singles(Tally.of(drawn, [f"x{i}" for i in range(5)], X.CARDS)).select("i", "a", "n")


def conditioned_sample(spark, d):
    drawn = sampling.conditioned(spark, _network(spark, d).to_circuit(), N_DRAWS, {2: 1}, seed=3)
    return drawn.groupBy("x0", "x2").agg(F.count("*").alias("n"))


def copula_sample(spark, d):
    """A copula of three measures of all runs, and rows drawn from it."""
    runs = each_once(table(spark, d, "eda_cluster_results"), "run_id", ["f1", "test_sp", "n_selected"])
    return sampling.sample_copula(spark, sampling.fit_copula_frame(runs, ["f1", "test_sp", "n_selected"]), N_DRAWS)


def ones(_: DataFrame):
    """The number of ones in eight bits."""
    return sum((F.col(f"x{i}") for i in range(8)), F.lit(0))


def gen_statistics(spark, d):
    """Best, mean, spread and worst price of each line number's rows as a generation."""
    rows = table(spark, d, "lineitem").select("l_linenumber", F.col("l_extendedprice").alias("f"))
    found = [eda.statistics_of(rows.filter(F.col("l_linenumber") == g), g) for g in sorted(r[0] for r in rows.select("l_linenumber").distinct().collect())]  # seven of them
    return spark.createDataFrame([(s.generation, *[round(float(x), 4) for x in (s.best, s.mean, s.std, s.worst)]) for s in found], "generation int, best double, mean double, std double, worst double")


def truncation_selection(spark, d):
    """The better half of the orders by price, ties by key."""
    o = table(spark, d, "orders")
    n = o.count()
    half = first_k(o.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], n // 2)
    return half.agg(F.count("*").alias("n"), F.min("o_totalprice").alias("least"), F.sum("o_orderkey").alias("keys"))


def eda_generations(spark, d):
    """Counting ones in eight bits with tree models."""
    parts = eda.Components(learning=eda.NetworkLearning("chow_liu"), stop=eda.MaxGenerations(5))
    out = eda.run(spark, (2,) * 8, ones, 200, parts)
    return spark.createDataFrame([(s.generation, s.best, s.mean, s.std, s.worst) for s in out.statistics], "generation int, best double, mean double, std double, worst double")


def evaluation_vector(spark, d):
    """Of three methods on the planted table: line numbers make the splits, the price is the objective."""
    rows = X.rows(spark, d)
    population = rows.select(F.xxhash64("l_orderkey", "l_partkey", "l_linenumber").alias("id"), *[f"x{i}" for i in range(5)], F.col("l_extendedprice").alias("f"), (F.col("l_linenumber") % 3).alias("split"))
    got = experiments.evaluate_each(population, X.CARDS, [(0, 1), (1, 2), (0, 3)], ["k2", "chow_liu", "stable_hc"], 0)
    out = [(m, k, round(float(v), 6)) for m, vector in got.items() for k, v in vector.items() if k != "time"]
    return spark.createDataFrame(out, "method string, measure string, value double")


def learner_comparison(spark, d):
    """Rates of many learners on the planted table and on the sampled states against a K2 graph of them."""
    planted, states = counter(spark, d), mood(spark, d)
    true = np.zeros((5, 5), dtype=int)
    true[0, 1] = true[1, 2] = true[0, 3] = 1
    k2 = Network(states.cards).learn_structure(states, "k2", max_parents=2).adjacency
    got = experiments.compare_learners(spark, {"planted": (planted, true), "moodstate": (states, k2)}, ["k2", "bic", "stable_hc", "pc", "chow_liu", "lpa", "dt", "dg_ndg"])
    return got.drop("time_s")


LEARNERS = {f"learn_{m}": _learner(m) for m in sorted(set(METHODS) - {"binotears", "fi_k2", "rfe_k2", "k2"})}
LEARNERS["learn_rpcd"] = _learner("rpcd")
QUERIES = LEARNERS | {f.__name__: f for f in (learn_fi_k2, learn_rfe_k2, learn_binotears, mood_learners, variable_clusters, markov_structure, k2_structure, chow_liu_tree, exact_dp_3var, optimal_scores, bic_addonly, markov_blanket, moral_graph, skeleton, ancestor_closure, topo_level, full_joint_enumeration, joint_probability, ve_marginal, ve_marginal_evidence, p_evidence, top_k_configs, map_config, circuit_marginals, k_best_partition, loopy_marginals, mean_field_marginals, map_by_messages, factorization_tables, row_logprob, mean_ll, decision_tree_route, dt_features, local_dg_logprob, pdg_parameters, logistic_cpd, ancestral_sample, random_sample, conditioned_sample, copula_sample, gen_statistics, truncation_selection, eda_generations, evaluation_vector, learner_comparison)}

_E = "e AS (SELECT * FROM (VALUES " + ", ".join(map(str, EDGES)) + ") v(src, dst))"
_CPD = f"WITH {X.SQL}, {X.families_sql(X.NETWORK)}, cpd AS (SELECT c.var, c.pcfg, c.state, (c.n + 1.0 / c.k) / (t.total + 1.0) AS p FROM cell c JOIN cfgt t USING (fam, pcfg))"
_JOINT = f"{_CPD}, joint AS (SELECT a.state::INT AS x0, b.state::INT AS x1, c.state::INT AS x2, d.state::INT AS x3, e.state::INT AS x4, a.p * b.p * c.p * d.p * e.p AS p FROM cpd a, cpd b, cpd c, cpd d, cpd e WHERE a.var = 0 AND b.var = 1 AND b.pcfg = a.state AND c.var = 2 AND c.pcfg = b.state AND d.var = 3 AND d.pcfg = a.state AND e.var = 4)"
_MI_EDGES = S.SQL["mi_nats"].rsplit(" SELECT i, j, round", 1)[0]
_CRIT = {k: chi2_isf(0.05, k) for k in (1, 2)}


def _k2_sql() -> str:
    """Greedy by stages: the best single parent of each variable, then the best second one."""
    index = {(f.var, f.parents): i for i, f in enumerate(X.FAMILIES)}
    first = ", ".join(f"({v}, {u}, {index[v, (u,)]})" for v in range(5) for u in range(v))
    second = ", ".join(f"({v}, {a}, {b}, {index[v, tuple(sorted((a, b)))]})" for v in range(5) for a, b in combos(range(v), repeat=2) if a != b)
    empty = ", ".join(f"({v}, {index[v, ()]})" for v in range(5))
    return f"""{K2_SCORES}, b0 AS (SELECT v.v, s.score FROM (VALUES {empty}) v(v, fam) JOIN sc s USING (fam)),
r1 AS (SELECT v.v, v.u, s.score, row_number() OVER (PARTITION BY v.v ORDER BY s.score DESC, v.u) AS r FROM (VALUES {first}) v(v, u, fam) JOIN sc s USING (fam)),
b1 AS (SELECT r1.v, r1.u, r1.score FROM r1 JOIN b0 USING (v) WHERE r = 1 AND r1.score > b0.score),
r2 AS (SELECT v.v, v.b, s.score, row_number() OVER (PARTITION BY v.v ORDER BY s.score DESC, v.b) AS r FROM (VALUES {second}) v(v, a, b, fam) JOIN sc s USING (fam) JOIN b1 ON b1.v = v.v AND b1.u = v.a),
b2 AS (SELECT r2.v, r2.b, r2.score FROM r2 JOIN b1 USING (v) WHERE r = 1 AND r2.score > b1.score)
SELECT u AS src, v AS dst FROM b1 UNION ALL SELECT b, v FROM b2"""


def _dags() -> str:
    """All graphs over three variables as rows of family numbers."""
    index = {(f.var, f.parents): i for i, f in enumerate(X.FAMILIES)}
    pairs = [(0, 1), (0, 2), (1, 2)]
    rows = []
    for kinds in combos((0, 1, 2), repeat=3):
        edges = [(a, b) if k == 1 else (b, a) for (a, b), k in zip(pairs, kinds, strict=True) if k]
        if sorted(edges) in ([(0, 1), (1, 2), (2, 0)], [(0, 2), (1, 0), (2, 1)]):
            continue
        rows.append(tuple(index[v, tuple(sorted(u for u, w in edges if w == v))] for v in range(3)))
    return ", ".join(map(str, rows))


_TREE = f"""WITH RECURSIVE {_MI_EDGES.removeprefix('WITH ')}, ed AS (SELECT i, j, row_number() OVER (ORDER BY mi DESC, i, j) AS k FROM mi WHERE 2 * t * mi > CASE WHEN i = 4 OR j = 4 THEN {_CRIT[2]!r} ELSE {_CRIT[1]!r} END),
both_ AS (SELECT i, j, k FROM ed UNION ALL SELECT j, i, k FROM ed), reach AS (SELECT e.k AS edge, e.i AS at FROM ed e UNION SELECT r.edge, b.j FROM reach r JOIN both_ b ON b.i = r.at AND b.k < r.edge),
tree AS (SELECT i AS u, j AS v FROM ed WHERE NOT EXISTS (SELECT 1 FROM reach r WHERE r.edge = ed.k AND r.at = ed.j))"""


def _rcd_sql() -> str:
    """Pairs that no set of up to two others makes independent, directed by index."""
    tests = [(i, j, z) for i, j in combinations(range(5), 2) for k in range(3) for z in combinations([v for v in range(5) if v not in (i, j)], k)]
    crit = ", ".join(f"({k}, {chi2_isf(0.05, k)!r})" for k in range(1, 25))
    pairs = ", ".join(f"({r}, {i}, {j}, {0 if z else (X.CARDS[i] - 1) * (X.CARDS[j] - 1)})" for r, (i, j, z) in enumerate(tests))
    return f"""{S._triples(tests)}, s AS (SELECT req, z, sum(n * n * nz / (na * nb)) - max(nz) AS s, (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS d FROM m GROUP BY req, z),
t AS (SELECT req, sum(CASE WHEN d > 0 THEN s ELSE 0 END) AS s, sum(d) AS d FROM s GROUP BY req), p AS (SELECT * FROM (VALUES {pairs}) v(req, i, j, f)), c AS (SELECT * FROM (VALUES {crit}) v(d, x)),
r AS (SELECT i, j, coalesce(t.s < c.x, true) AS free FROM p LEFT JOIN t USING (req) LEFT JOIN c ON c.d = CASE WHEN f > 0 THEN f ELSE t.d END)
SELECT i AS src, j AS dst FROM r GROUP BY i, j HAVING NOT bool_or(free)"""


_BIC = S.SQL["bic_local"].replace("SELECT fam, round(", "SELECT fam, (", 1).replace(", 4) AS score", ") AS score", 1)
_BIC_CTE = _BIC.rsplit(" SELECT fam, (", 1)
_BIC_SC = f"{_BIC_CTE[0]}, sc AS (SELECT fam, ({_BIC_CTE[1]})"  # closes the CTE
_ONE = {(f.var, f.parents): i for i, f in enumerate(X.FAMILIES)}
_COLS = ", ".join(f"x{i}" for i in range(5))


def _orders_sql() -> str:
    """The best total over all orders: each variable takes its best family among those before it."""
    orders = list(permutations(range(5)))
    before = ", ".join(f"({o}, {v}, {sum(1 << u for u in order[:k])})" for o, order in enumerate(orders) for k, v in enumerate(order))
    masks = ", ".join(f"({i}, {f.var}, {sum(1 << u for u in f.parents)})" for i, f in enumerate(X.FAMILIES))
    return f"""{_BIC_SC}, o AS (SELECT * FROM (VALUES {before}) v(o, var, seen)), fm AS (SELECT * FROM (VALUES {masks}) v(fam, var, need)),
best AS (SELECT o.o, o.var, max(sc.score) AS s FROM o JOIN fm ON fm.var = o.var AND (fm.need & o.seen) = fm.need JOIN sc ON sc.fam = fm.fam GROUP BY ALL),
top AS (SELECT round(max(t), 3) AS score FROM (SELECT o, sum(s) AS t FROM best GROUP BY o)) SELECT unnest(['levelwise', 'stable_hc', 'tabu']) AS method, score FROM top"""


def _parts_sql() -> str:
    """P(new | overlap) of the cliques of the planted tree, from the joint."""
    parts = [((), (0, 1)), ((0,), (3,)), ((1,), (2,)), ((), (4,))]
    made = []
    for i, (overlap, new) in enumerate(parts):
        o, k = X.index_sql(overlap), X.index_sql(new)
        made.append(f"SELECT {i} AS pos, {o}::INT AS ocfg, {k}::INT AS ncfg, sum(p) AS p FROM joint GROUP BY ALL")
    return f"{_JOINT}, j AS ({' UNION ALL '.join(made)}) SELECT pos, ocfg, ncfg, round(p / sum(p) OVER (PARTITION BY pos, ocfg), 8) AS p FROM j"


_U = lambda v: f"((((id * 7919 + {v * 15485863}) % {X.PRIME}) * ((id * 7919 + {v * 15485863}) % {X.PRIME}) + 3 * ((id * 7919 + {v * 15485863}) % {X.PRIME}) + {v}) % {X.PRIME}) / {X.PRIME}.0::DOUBLE"
SQL = {
    "k2_structure": _k2_sql(),
    "chow_liu_tree": f"""WITH RECURSIVE {_MI_EDGES.removeprefix('WITH ')}, ed AS (SELECT i, j, row_number() OVER (ORDER BY mi DESC, i, j) AS k FROM mi WHERE 2 * t * mi > CASE WHEN i = 4 OR j = 4 THEN {_CRIT[2]!r} ELSE {_CRIT[1]!r} END),
both_ AS (SELECT i, j, k FROM ed UNION ALL SELECT j, i, k FROM ed), reach AS (SELECT e.k AS edge, e.i AS at FROM ed e UNION SELECT r.edge, b.j FROM reach r JOIN both_ b ON b.i = r.at AND b.k < r.edge)
SELECT i AS u, j AS v FROM ed WHERE NOT EXISTS (SELECT 1 FROM reach r WHERE r.edge = ed.k AND r.at = ed.j)""",
    "optimal_scores": _orders_sql(),
    "factorization_tables": _parts_sql(),
    "learn_chow_liu": f"{_TREE}, tb AS (SELECT u, v FROM tree UNION ALL SELECT v, u FROM tree), far AS (SELECT u AS a, u AS b FROM tb UNION SELECT f.a, t.v FROM far f JOIN tb t ON t.u = f.b), root AS (SELECT a, min(b) AS r FROM far GROUP BY a), walk AS (SELECT DISTINCT r AS here, r AS came, 0 AS depth FROM root UNION SELECT t.v, w.here, w.depth + 1 FROM walk w JOIN tb t ON t.u = w.here AND t.v <> w.came WHERE w.depth < 5) SELECT came AS src, here AS dst FROM walk WHERE depth > 0",
    "learn_rcd": _rcd_sql(),
    "learn_rpcd": _rcd_sql(),
    "learn_univ_bn": "SELECT 0 AS src, 0 AS dst WHERE false",
    "loopy_marginals": f"{_JOINT}, m AS (" + " UNION ALL ".join(f"SELECT {v} AS v, x{v} AS s, sum(p) FILTER (x2 = 1) AS p FROM joint GROUP BY ALL" for v in range(5)) + ") SELECT v, s, round(coalesce(p, 0) / (SELECT sum(p) FROM joint WHERE x2 = 1), 4) AS p FROM m",
    "map_by_messages": f"{_JOINT}, b AS (SELECT {_COLS} FROM joint WHERE x4 = 2 ORDER BY joint.p DESC, {_COLS} LIMIT 1) SELECT 'loopy' AS method, {_COLS} FROM b UNION ALL SELECT 'srmp', {_COLS} FROM b",
    "exact_dp_3var": f"{_BIC_SC}, g AS (SELECT * FROM (VALUES {_dags()}) v(a, b, c)) SELECT round(max(x.score + y.score + z.score), 3) AS score FROM g JOIN sc x ON x.fam = a JOIN sc y ON y.fam = b JOIN sc z ON z.fam = c",
    "bic_addonly": f"{_BIC_SC}, r AS (SELECT v.v, v.u, s.score, row_number() OVER (PARTITION BY v.v ORDER BY s.score DESC, v.u) AS r FROM (VALUES {', '.join(f'({v}, {u}, {_ONE[v, (u,)]})' for v in range(5) for u in range(v))}) v(v, u, fam) JOIN sc s USING (fam)), b AS (SELECT v.v, s.score FROM (VALUES {', '.join(f'({v}, {_ONE[v, ()]})' for v in range(5))}) v(v, fam) JOIN sc s USING (fam)) SELECT r.u AS src, r.v AS dst FROM r JOIN b USING (v) WHERE r.r = 1 AND r.score > b.score",
    "markov_blanket": f"WITH {_E} SELECT DISTINCT v, u FROM (SELECT src AS v, dst AS u FROM e UNION ALL SELECT dst, src FROM e UNION ALL SELECT a.src, b.src FROM e a JOIN e b ON a.dst = b.dst AND a.src <> b.src)",
    "moral_graph": f"WITH {_E} SELECT DISTINCT u, v FROM (SELECT least(src, dst) AS u, greatest(src, dst) AS v FROM e UNION ALL SELECT a.src, b.src FROM e a JOIN e b ON a.dst = b.dst AND a.src < b.src)",
    "skeleton": f"WITH {_E} SELECT DISTINCT least(src, dst) AS u, greatest(src, dst) AS v FROM e",
    "ancestor_closure": f"WITH RECURSIVE {_E}, c AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON e.src = c.dst) SELECT * FROM c",
    "topo_level": f"WITH RECURSIVE {_E}, l AS (SELECT v::INT AS v, 0 AS level FROM range(5) r(v) UNION SELECT e.dst, l.level + 1 FROM l JOIN e ON e.src = l.v) SELECT v, max(level)::INT AS level FROM l GROUP BY v",
    "full_joint_enumeration": f"{_JOINT} SELECT {_COLS}, round(p, 8) AS p FROM joint",
    "joint_probability": f"{_JOINT} SELECT {_COLS}, round(joint.p, 8) AS p FROM joint JOIN cfg USING ({_COLS})",
    "ve_marginal": f"{_JOINT} SELECT x2, round(sum(p), 8) AS p FROM joint GROUP BY x2",
    "ve_marginal_evidence": f"{_JOINT} SELECT x0, round(sum(p) / (SELECT sum(p) FROM joint WHERE x2 = 1 AND x4 = 0), 8) AS p FROM joint WHERE x2 = 1 AND x4 = 0 GROUP BY x0",
    "p_evidence": f"{_JOINT} SELECT round(sum(p), 8) AS p FROM joint WHERE x2 = 1 AND x3 = 0",
    "top_k_configs": f"{_JOINT} SELECT {_COLS}, round(p, 10) AS p FROM joint ORDER BY round(p, 10) DESC, {_COLS} LIMIT 10",
    "map_config": f"{_JOINT} SELECT {_COLS}, round(p, 8) AS p FROM joint WHERE x4 = 2 ORDER BY joint.p DESC, {_COLS} LIMIT 1",
    "circuit_marginals": f"{_JOINT}, m AS (" + " UNION ALL ".join(f"SELECT {v} AS v, x{v} AS s, sum(p) FILTER (x2 = 1) AS p FROM joint GROUP BY ALL" for v in range(5)) + ") SELECT v, s, round(coalesce(p, 0) / (SELECT sum(p) FROM joint WHERE x2 = 1), 8) AS p FROM m",
    "k_best_partition": f"{_JOINT} SELECT {_COLS}, round(p, 10) AS p FROM joint ORDER BY joint.p DESC LIMIT 6",
    "row_logprob": f"{_JOINT} SELECT {_COLS}, round(ln(joint.p), 6) AS logp FROM joint JOIN cfg USING ({_COLS})",
    "mean_ll": f"{_JOINT} SELECT round(sum(ln(joint.p) * w) / sum(w), 6) AS ll FROM joint JOIN cfg USING ({_COLS})",
    "ancestral_sample": f"{_CPD}, q AS (SELECT var, pcfg, state, sum(p) OVER (PARTITION BY var, pcfg ORDER BY state) AS c FROM cpd), s AS (SELECT id, " + ", ".join(f"{_U(v)} AS u{v}" for v in range(5)) + f" FROM range({N_DRAWS}) r(id)), y0 AS (SELECT s.*, (SELECT count(*) FROM q WHERE var = 0 AND c <= u0 AND state < 1)::INT AS x0 FROM s), y1 AS (SELECT y0.*, (SELECT count(*) FROM q WHERE var = 1 AND pcfg = x0 AND c <= u1 AND state < 1)::INT AS x1, (SELECT count(*) FROM q WHERE var = 3 AND pcfg = x0 AND c <= u3 AND state < 1)::INT AS x3, (SELECT count(*) FROM q WHERE var = 4 AND c <= u4 AND state < 2)::INT AS x4 FROM y0), y2 AS (SELECT y1.*, (SELECT count(*) FROM q WHERE var = 2 AND pcfg = x1 AND c <= u2 AND state < 1)::INT AS x2 FROM y1) SELECT {_COLS}, count(*) AS n FROM y2 GROUP BY ALL",
    "gen_statistics": "SELECT l_linenumber::INT AS generation, round(max(l_extendedprice), 4) AS best, round(avg(l_extendedprice), 4) AS mean, round(stddev_pop(l_extendedprice), 4) AS std, round(min(l_extendedprice), 4) AS worst FROM lineitem GROUP BY 1",
    "truncation_selection": "WITH s AS (SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT (SELECT count(*) // 2 FROM orders)) SELECT count(*) AS n, min(o_totalprice) AS least, sum(o_orderkey)::BIGINT AS keys FROM s",
}
