"""The facade: learn a network from a tally, then score, query, convert and sample it."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from tallygrid.operators import constraint, drawing, factors, local_structure, sampling, search, sparse
from tallygrid.operators import graphs as G
from tallygrid.operators.counter import Counter
from tallygrid.operators.counting import Family, Tally, cpds, look_up, row_log_probability
from tallygrid.operators.factors import Circuit, Tables
from tallygrid.operators.scoring import Scores
from tallygrid.operators.search import Problem


@dataclass
class Options:
    """What learners take beside the data and the constraints."""

    alpha: float = 1.0
    penalty: str | float = "bic"
    start: np.ndarray | None = None
    max_depth: int | None = None
    max_leaves: int | None = None
    split: str | None = None
    k: int = 2
    trees: int = 20
    rounds: int = 10
    target: np.ndarray | str | None = None
    measure: str = "mi"
    sparsity: float = 0.01
    max_condition: int | None = None
    scorer: Callable[[np.ndarray, float], float] | None = None
    base: str | Callable[[Problem, Scores], np.ndarray] = "stable_hc"

    @property
    def level(self) -> float:
        """Significance of tests: alpha if it is one, else .05."""
        return self.alpha if 0 < self.alpha < 1 else 0.05


def _scores(p: Problem, kind: str, o: Options) -> Scores:
    """Scores of a kind, or by the user's own function in its place."""
    if o.scorer is not None:
        return Scores(p.counter, o.scorer, o.alpha, o.penalty)
    caps = {"max_depth": o.max_depth, "max_leaves": o.max_leaves} if kind in ("dt", "dg") else {}
    if kind == "dg" and o.split:
        caps["by"] = {"bic": "mdl"}.get(o.split, o.split)
    return Scores(p.counter, kind, o.alpha, o.penalty, caps)


def _penalised(p: Problem, o: Options) -> np.ndarray:
    s = _scores(p, "k2_pen", o)
    factor = search_factor(o.penalty, p.counter.n)
    return search.add_only(search.bound_problem(p, factor), s)


def search_factor(penalty: str | float, n: float) -> float:
    from tallygrid.operators.counting import penalty_factor

    return penalty_factor(penalty, n)


def _ordered(order: Callable[[Problem, Options], list[int]]) -> Callable[[Problem, Options], np.ndarray]:
    return lambda p, o: search.k2_search(p, _scores(p, "k2", o), order(p, o))


def _variant(**how) -> Callable[[Problem, Options], np.ndarray]:
    return lambda p, o: search.k2_variant(p, _scores(p, "k2", o), **how)


def _climb(kind: str) -> Callable[[Problem, Options], np.ndarray]:
    return lambda p, o: search.hill_climb(p, _scores(p, kind, o), o.start)


#: Learners that iterated communities can run on their parts.
BASES: dict[str, Callable[[Problem, Scores], np.ndarray]] = {"stable_hc": search.hill_climb, "tabu": search.tabu, "add_only": search.add_only, "k2": search.k2_search, "levelwise": search.exact_search}


def _base(o: Options) -> Callable[[Problem, Scores], np.ndarray]:
    if callable(o.base):
        return o.base
    if o.base not in BASES:
        raise ValueError(f"unknown base learner {o.base!r}; there are {sorted(BASES)}")
    return BASES[o.base]


METHODS: dict[str, Callable[[Problem, Options], np.ndarray]] = {
    "k2": lambda p, o: search.k2_search(p, _scores(p, "k2", o)),
    "boa": lambda p, o: search.k2_search(p if p.max_parents is not None else Problem(p.counter, p.permutation, p.mask, 3, p.seed), _scores(p, "k2", o)),
    "k2_mi": _variant(mask="mi"),
    "k2_mb": _variant(mask="elastic"),
    "k2_refine": _variant(mask="mi", refine=True),
    "k2_plus": _variant(mask="mi", refine=True),
    "k2_ensemble": _variant(ensemble=5),
    "bic": lambda p, o: search.add_only(p, _scores(p, "bic", o)),
    "aic": lambda p, o: search.add_only(p, _scores(p, "aic", o)),
    "ebna": lambda p, o: search.add_only(p if p.max_parents is not None else Problem(p.counter, p.permutation, p.mask, 2, p.seed), _scores(p, "ebna", o)),
    "k2_pen": _penalised,
    "stable_hc": _climb("bic"),
    "dt": _climb("dt"),
    "dg": _climb("dg"),
    "tabu": lambda p, o: search.tabu(p, _scores(p, "bic", o), o.start),
    "gs": lambda p, o: constraint.grow_shrink(p, constraint.Tests(p.counter, o.level), 5 if o.max_condition is None else o.max_condition),
    "rcd": lambda p, o: constraint.recursive_tests(p, constraint.Tests(p.counter, o.level), 2 if o.max_condition is None else o.max_condition),
    "pc": lambda p, o: constraint.pc(p, constraint.Tests(p.counter, o.level), most=o.max_condition),
    "stable_pc": lambda p, o: constraint.pc(p, constraint.Tests(p.counter, o.level), True, o.max_condition),
    "dg_ndg": lambda p, o: search.one_shot_graph(p, o.alpha, o.split or "mdl", o.max_depth, o.max_leaves),
    "dmbbn": lambda p, o: search.rooted_vote(p, _scores(p, "k2", o)),
    "levelwise": lambda p, o: search.exact_search(p, _scores(p, "bic", o)),
    "sartre": lambda p, o: sparse.order_lasso(p),
    "iterdsla": lambda p, o: search.iterated_communities(p, _scores(p, "bic", o), _base(o), o.rounds),
    "binotears": lambda p, o: sparse.notears(p, o.sparsity),
    "bounded_tw": lambda p, o: search.bounded_treewidth(p, _scores(p, "bic", o), o.k, o.trees),
    "univ_bn": lambda p, o: np.zeros((p.n_vars, p.n_vars), dtype=int),
    "fi_k2": _ordered(lambda p, o: sparse.importance_order(p.counter, o.target, o.measure, p.seed)),
    "rfe_k2": _ordered(lambda p, o: (sparse.elimination_ranking if o.measure == "rfe" else sparse.redundancy_order)(p.counter, o.target, p.seed)),
    "chow_liu": lambda p, o: constraint.chow_liu(p, o.level),
    "rebane_pearl": lambda p, o: constraint.rebane_pearl(p, constraint.Tests(p.counter, o.level)),
    "lpa": lambda p, o: constraint.lpa(p, o.level),
    "lpa_marginal": lambda p, o: constraint.lpa(p, o.level, marginal=True),
    "causal_polytree": lambda p, o: constraint.sheaf(p, constraint.Tests(p.counter, o.level)),
}
ALIASES = {
    "ebna_k2": "k2_pen", "rpcd": "rcd", "decision_tree": "dt", "decision_graph": "dg", "ndg": "dg_ndg", "exact": "levelwise", "iter_dsla": "iterdsla", "bounded_treewidth": "bounded_tw", "ktree": "bounded_tw",
    "univ": "univ_bn", "independent": "univ_bn", "fik2": "fi_k2", "rfek2": "rfe_k2", "tree": "chow_liu", "branching": "chow_liu", "polytree": "rebane_pearl", "pada": "lpa", "sheaf": "causal_polytree",
}
#: Learners that take no order.
UNORDERED = {"dmbbn", "levelwise", "iterdsla", "binotears", "fi_k2", "rfe_k2"}


@dataclass
class Network:
    """Structure, dense tables or local ones, and what was noted while learning."""

    cards: tuple[int, ...]
    adjacency: np.ndarray | None = None
    tables: Tables | None = None
    local: dict[int, local_structure.LocalTable] | None = None
    notes: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if any(k < 2 for k in self.cards):
            raise ValueError("every variable needs at least two states")
        if self.adjacency is None:
            self.adjacency = np.zeros((len(self.cards), len(self.cards)), dtype=int)

    @property
    def n_vars(self) -> int:
        return len(self.cards)

    # structure

    def add_edge(self, u: int, v: int) -> None:
        if G.closes_cycle(self.adjacency, u, v):
            raise ValueError(f"{u} -> {v} closes a cycle")
        self.adjacency[u, v] = 1
        self.tables = self.local = None

    def remove_edge(self, u: int, v: int) -> None:
        self.adjacency[u, v] = 0
        self.tables = self.local = None

    def has_edge(self, u: int, v: int) -> bool:
        return bool(self.adjacency[u, v])

    def set_structure(self, adjacency: np.ndarray) -> None:
        """Takes any 0/1 matrix; cycles are found when an order is needed."""
        a = np.asarray(adjacency, dtype=int)
        if a.shape != (self.n_vars, self.n_vars):
            raise ValueError("the structure must be a square over the variables")
        self.adjacency, self.tables, self.local = a.copy(), None, None

    def parents(self, v: int) -> list[int]:
        return G.parents(self.adjacency, v)

    def children(self, v: int) -> list[int]:
        return [int(u) for u in np.flatnonzero(self.adjacency[v])]

    def edges(self) -> list[tuple[int, int]]:
        return G.edges_of(self.adjacency)

    def families(self) -> list[Family]:
        return [Family(v, tuple(self.parents(v))) for v in range(self.n_vars)]

    def topological_order(self) -> list[int]:
        order = G.topological(self.adjacency)
        if order is None:
            raise ValueError("the graph has a cycle")
        return order

    def markov_blanket(self, v: int) -> list[int]:
        return G.markov_blanket(self.adjacency, v)

    # learning

    def learn_structure(self, counter: Counter, method: str = "k2", permutation: Sequence[int] | None = None, ordering: Sequence[int] | None = None, mask: np.ndarray | None = None, candidate_parents: str | None = None, max_parents: int | Sequence[int] | None = None, seed: int | None = 0, **options) -> "Network":
        name = ALIASES.get(method.lower(), method.lower())
        if name not in METHODS:
            raise ValueError(f"unknown method {method!r}; there are {sorted([*METHODS, *ALIASES])}")
        permutation = ordering if permutation is None else permutation
        if mask is not None and not np.array_equal(np.asarray(mask) != 0, (np.asarray(mask) != 0).T):
            raise ValueError("the mask must be symmetric")
        if candidate_parents is not None:
            kind, _, top = candidate_parents.partition(":")
            if kind != "mi" or not top.isdigit():
                raise ValueError("candidate_parents is mi:<number>")
            own = search.information_mask(counter, int(top))
            mask = own if mask is None else own * (np.asarray(mask) != 0)
        problem = Problem(counter, None if name in UNORDERED else permutation, mask, max_parents, seed)
        self.adjacency = METHODS[name](problem, Options(**options))
        self.tables = self.local = None
        self.notes = problem.notes
        return self

    @staticmethod
    def learn_variable_clustering(counter: Counter, alpha: float = 1.0, stop: float = 0.0, max_cells: int | None = None) -> dict:
        """Clusters of variables joined by the largest log Bayes factor while it exceeds ``stop``: ``clusters`` and ``merges``."""
        return search.variable_clusters(counter, alpha, stop, max_cells)

    def learn_parameters(self, counter: Counter, method: str | object = "mle", alpha: float = 1.0, **options) -> "Network":
        """Counts with alpha spread over the states, or ``logistic`` tables, or an object with ``learn(counter, families)``."""
        families = self.families()
        if hasattr(method, "learn"):
            probs = method.learn(counter, families)
        elif method == "logistic":
            probs = [sparse.logistic_table(counter, f.var, f.parents, alpha=alpha, **options) for f in families]
        elif method == "mle":
            counter.prefetch([(f.var, *f.parents) for f in families])
            probs = []
            for f in families:
                rows = counter.family(f.var, f.parents) + alpha / self.cards[f.var]
                total = rows.sum(axis=1, keepdims=True)
                probs.append(np.where(total > 0, rows / np.where(total > 0, total, 1), 1 / self.cards[f.var]))
        else:
            raise ValueError(f"unknown parameter learner {method!r}")
        self.tables, self.local = Tables(self.cards, [f.parents for f in families], probs), None
        return self

    def learn_local_structure(self, counter: Counter, kind: str = "dt", alpha: float = 1.0, **caps) -> "Network":
        families = self.families()
        counter.prefetch([(f.var, *f.parents) for f in families])
        self.local = {f.var: local_structure.learn_local(counter, f.var, f.parents, kind, alpha, **caps) for f in families}
        dense = [self.local[v].dense() for v in range(self.n_vars)]
        self.tables = Tables(self.cards, [f.parents for f in families], dense) if all(x is not None for x in dense) else None
        return self

    @classmethod
    def fit(cls, tally: Tally, method: str = "k2", n: float | None = None, alpha: float = 1.0, local: str | None = None, parameters: str | object = "mle", limit: int = 200_000, **options) -> "Network":
        """Structure, then tables; ``local`` is dt or dg for trees or graphs in place of dense tables."""
        counter = Counter(tally, n, limit)
        out = cls(tally.cards).learn_structure(counter, method, alpha=alpha, **options)
        return out.learn_local_structure(counter, local, alpha) if local else out.learn_parameters(counter, parameters, alpha)

    # numbers

    @property
    def has_local_structure(self) -> bool:
        return self.local is not None

    def n_parameters(self) -> int:
        if self.local:
            return sum(t.n_parameters for t in self.local.values())
        return sum(int(np.prod([self.cards[u] for u in self.parents(v)], dtype=int)) * (k - 1) for v, k in enumerate(self.cards))

    def score(self, counter: Counter, kind: str = "bic", alpha: float = 0.0) -> float:
        return Scores(counter, kind, max(alpha, 1e-12) if kind == "k2" else alpha).total(self.adjacency)

    def summary(self, counter: Counter, kind: str = "bic") -> dict:
        mi = search.information(counter, bits=True)
        return {"edges": [(u, v, float(mi[u, v])) for u, v in self.edges()], "score": self.score(counter, kind), "parents": {v: self.parents(v) for v in range(self.n_vars)}, "blankets": {v: self.markov_blanket(v) for v in range(self.n_vars)}, "degree": {v: int(self.adjacency[v].sum() + self.adjacency[:, v].sum()) for v in range(self.n_vars)}}

    # use

    def _dense(self) -> Tables:
        if self.tables is None:
            raise ValueError("this needs dense tables; learn parameters first")
        return self.tables

    def most_probable(self, evidence=None, method: str = "auto") -> tuple[list[int], float]:
        return factors.most_probable(self._dense(), evidence, method)

    def k_most_probable(self, k: int, evidence=None, method: str = "partition") -> list[tuple[list[int], float]]:
        return factors.k_most_probable(self._dense(), k, evidence, method)

    def marginals(self, evidence=None, method: str = "ve") -> list[np.ndarray]:
        return factors.marginals(self._dense(), evidence, method)

    def to_circuit(self, how: str = "min_fill") -> Circuit:
        return Circuit.compile(self._dense(), how)

    def to_factorization(self, how: str = "min_fill", max_size: int | None = None, counter: Counter | None = None, alpha: float = 0.0) -> "Factorization":
        """Ordered tables P(new | overlap): from counts if a counter is given, else exact marginals of the network."""
        order, filled = G.elimination_order(G.moral(self.adjacency), how)
        cliques = G.triangulated_cliques(order, filled)
        if max_size is not None:
            cliques = G.split_width(cliques, max_size)
        parts = G.ordered_structure([cliques[c] for c, _ in G.sampling_order(cliques, G.junction_tree(cliques))])
        circuit = None if counter is not None else self.to_circuit(how)
        tables = []
        for overlap, new in parts:
            shape = [int(np.prod([self.cards[v] for v in s], dtype=int)) for s in (overlap, new)]
            if counter is not None:
                rows = counter.table((*overlap, *new)).reshape(shape, order="F") + alpha / shape[1]
            else:
                rows = _joint(circuit, (*overlap, *new)).reshape(shape, order="F")
            total = rows.sum(axis=1, keepdims=True)
            tables.append(np.where(total > 0, rows / np.where(total > 0, total, 1), 1 / shape[1]))
        return Factorization(self.cards, parts, tables)

    def sample(self, spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
        if self.local:
            empty = Tables(self.cards, [tuple(self.parents(v)) for v in range(self.n_vars)], [None] * self.n_vars)
            return sampling.ancestral(spark, empty, n, seed, self.local)
        return sampling.ancestral(spark, self._dense(), n, seed)

    def log_probability(self, tally: Tally, alpha_tables: DataFrame | None = None, floor: float = 1e-12) -> DataFrame:
        """Configurations of the tally with ``logp``; local tables by routing, dense ones by lookup."""
        if self.local:
            return local_structure.local_log_probability(tally.df, list(self.local.values()), floor)
        if alpha_tables is not None:
            return row_log_probability(tally.df, tally, self.families(), alpha_tables, floor)
        logs = [np.log(np.maximum(np.atleast_2d(p), floor)).ravel() for p in self._dense().probs]
        return look_up(tally.df, tally, self.families(), logs)

    def plot(self, names: Sequence[str] | None = None) -> str:
        """A drawing as SVG text: variables by level, parents above their children."""
        return drawing.network_svg(self.adjacency, names)

    def plot_tables(self, var: int, names: Sequence[str] | None = None) -> str:
        """Bars of the variable's table as SVG text, a group for each parent configuration."""
        return drawing.bars_svg(np.atleast_2d(self._dense().probs[var]), names[var] if names else f"x{var}")

    def __repr__(self) -> str:
        return f"Network({self.n_vars} variables, {int(self.adjacency.sum())} edges, {'local tables' if self.local else 'tables' if self.tables else 'no tables'})"


def _joint(circuit: Circuit, scope: Sequence[int]) -> np.ndarray:
    """Joint marginal over a few variables, axes in the order given; a clique's belief if one holds them all."""
    for f in circuit.beliefs():
        if set(scope) <= set(f.scope):
            g = f.onto(scope)
            return np.transpose(g.values, [g.scope.index(v) for v in scope])
    t = circuit.tables
    order, _ = factors.plan(t)
    left = t.factors()
    for v in order:
        if v not in scope:
            joined = factors.product([f for f in left if v in f.scope])
            left = [f for f in left if v not in f.scope] + [joined.without(v)]
    g = factors.product(left)
    return np.transpose(g.values, [g.scope.index(v) for v in scope])


@dataclass
class Factorization:
    """Ordered cliques as (overlap, new) and tables P(new | overlap), first variables fastest."""

    cards: tuple[int, ...]
    parts: list[tuple[tuple[int, ...], tuple[int, ...]]]
    tables: list[np.ndarray]

    def structure(self) -> np.ndarray:
        return G.structure_matrix(self.parts)

    def probability(self, x: Sequence[int]) -> float:
        out = 1.0
        for (overlap, new), table in zip(self.parts, self.tables, strict=True):
            out *= float(table[self._at(overlap, x), self._at(new, x)])
        return out

    def _at(self, scope: Sequence[int], x: Sequence[int]) -> int:
        out, stride = 0, 1
        for v in scope:
            out, stride = out + int(x[v]) * stride, stride * self.cards[v]
        return out


def pdg_nodes(local: dict[int, local_structure.LocalTable]) -> list[tuple[int, tuple[float, ...]]]:
    """Parameter nodes of a compact joint: distinct leaf distributions of each variable, equal to 12 digits."""
    return sorted({(v, tuple(round(float(p), 12) for p in row)) for v, t in local.items() for row in t.probs})


def exact_tables(tally: Tally, network: Network, alpha: float = 1.0) -> DataFrame:
    """The network's tables as a DataFrame, counted by Spark in one pass."""
    return cpds(tally, network.families(), alpha)
