"""Score-based structure searches: loops on the driver that ask for scores in batches."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from itertools import combinations
from math import floor, log

import numpy as np

from tallygrid.operators import graphs as G
from tallygrid.operators.counter import Counter
from tallygrid.operators.scoring import Scores, leaf_k2, leaf_likelihood, parent_bounds


@dataclass
class Problem:
    """What a search is given: counts, and the constraints on edges.

    ``permutation``: parents come before their children in it. ``mask``: pairs that may be joined, nonzero entries.
    """

    counter: Counter
    permutation: Sequence[int] | None = None
    mask: np.ndarray | None = None
    max_parents: int | Sequence[int] | None = None
    seed: int | None = 0
    notes: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        n = self.counter.n_vars
        self.place = None
        if self.permutation is not None:
            if sorted(self.permutation) != list(range(n)):
                raise ValueError("the permutation must hold every variable once")
            self.place = np.argsort(np.asarray(self.permutation))
        if self.mask is not None:
            self.mask = (np.asarray(self.mask) != 0).astype(int)
            if self.mask.shape != (n, n):
                raise ValueError("the mask must be a square over the variables")

    @property
    def n_vars(self) -> int:
        return self.counter.n_vars

    @property
    def cards(self) -> tuple[int, ...]:
        return self.counter.cards

    def cap(self, v: int = 0) -> int:
        if self.max_parents is None:
            return default_max_parents(self.cards)
        return int(self.max_parents if np.ndim(self.max_parents) == 0 else self.max_parents[v])

    def joinable(self, u: int, v: int) -> bool:
        return u != v and (self.mask is None or bool(self.mask[u, v]))

    def allowed(self, u: int, v: int) -> bool:
        """Whether u may be a parent of v."""
        return self.joinable(u, v) and (self.place is None or self.place[u] < self.place[v])

    def candidates(self, v: int) -> list[int]:
        return [u for u in range(self.n_vars) if self.allowed(u, v)]

    def order(self) -> list[int]:
        return list(range(self.n_vars)) if self.permutation is None else [int(v) for v in self.permutation]

    def before(self, u: int, v: int) -> bool:
        return (u < v) if self.place is None else bool(self.place[u] < self.place[v])


def default_max_parents(cards: Sequence[int]) -> int:
    return max(1, floor(10 * log(2) / log(max(cards))))


def _greedy(scores: Scores, v: int, candidates: Sequence[int], cap: int, start: Sequence[int] = (), limit: bool = True, ok: Callable[[int], bool] = lambda _: True) -> list[int]:
    """Parents added one at a time, the best first, the first of equals, while the score rises."""
    chosen = list(start)
    now = scores.local(v, chosen)
    while len(chosen) < cap:
        trials = [u for u in candidates if u not in chosen and ok(u) and (not limit or scores.fits(v, [*chosen, u]))]
        if not trials:
            break
        found = scores.added(v, chosen, trials)
        at = int(np.argmax(found))  # the first of equals
        if not found[at] > now:
            break
        chosen.append(trials[at])
        now = float(found[at])
    return chosen


def k2_search(p: Problem, scores: Scores, order: Sequence[int] | None = None, mask: np.ndarray | None = None) -> np.ndarray:
    """Greedy parents along an order. Given the order the variables don't interact, so each round scores all of them in one batch."""
    order = p.order() if order is None else list(order)
    place = np.argsort(order)
    open_ = {v: [u for u in range(p.n_vars) if place[u] < place[v] and p.joinable(u, v) and (mask is None or mask[u, v])] for v in order}
    chosen: dict[int, list[int]] = {v: [] for v in order}
    scores.prefetch([(v, ()) for v in order])
    active = set(order)
    while active:
        trials = {v: [u for u in open_[v] if u not in chosen[v] and scores.fits(v, [*chosen[v], u])] for v in active if len(chosen[v]) < p.cap(v)}
        scores.prefetch([(v, [*chosen[v], u]) for v, us in trials.items() for u in us])
        active = set()
        for v, us in trials.items():
            found = scores.added(v, chosen[v], us)
            if len(us) and found.max() > scores.local(v, chosen[v]):
                chosen[v].append(us[int(np.argmax(found))])
                active.add(v)
    return G.adjacency_of(p.n_vars, [(u, v) for v, us in chosen.items() for u in us])


def add_only(p: Problem, scores: Scores) -> np.ndarray:
    """Variable by variable, parents are added while the score rises; cycles are refused unless an order rules them out."""
    a = np.zeros((p.n_vars, p.n_vars), dtype=int)
    scores.prefetch([(v, (u,)) for v in range(p.n_vars) for u in p.candidates(v)])
    for v in range(p.n_vars):
        below = G.descendants(a, v)  # parents given to v don't change what lies below it
        free = (lambda _: True) if p.place is not None else (lambda u, below=below: u not in below)
        for u in _greedy(scores, v, p.candidates(v), p.cap(v), ok=free):
            a[u, v] = 1
    return a


def checked_start(p: Problem, start: np.ndarray | None) -> np.ndarray:
    """A warm start: wrong shape, other values or cycles are errors; forbidden and surplus edges are dropped."""
    n = p.n_vars
    if start is None:
        return np.zeros((n, n), dtype=int)
    a = np.array(start)
    if a.shape != (n, n) or not np.isin(a, (0, 1)).all():
        raise ValueError("a start must be a 0/1 matrix over the variables")
    a = a.astype(int)
    if not G.is_dag(a):
        raise ValueError("a start must not have cycles")
    for v in range(n):
        kept = [u for u in G.parents(a, v) if p.allowed(u, v)][: p.cap(v)]
        a[:, v] = 0
        a[kept, v] = 1
    return a


#: Operations of the hill climbers and what ties between them are broken by.
ADD, DELETE, REVERSE = 0, 1, 2


class _Climb:
    """A graph under change, with the gain of every addition and deletion kept as matrices.

    A change of v's parents touches only v's column; what closes a cycle is read from the closure of the graph.
    """

    def __init__(self, p: Problem, scores: Scores, a: np.ndarray) -> None:
        self.p, self.scores, self.a, n = p, scores, a, p.n_vars
        self.allowed = np.array([[p.allowed(u, v) for v in range(n)] for u in range(n)])
        self.caps = np.array([p.cap(v) for v in range(n)])
        self.add, self.drop = np.full((n, n), -np.inf), np.full((n, n), -np.inf)
        self.refresh(range(n))

    def refresh(self, columns: Sequence[int]) -> None:
        p, s = self.p, self.scores
        trials: dict[int, tuple[list[int], list[int]]] = {}
        for v in columns:
            now = G.parents(self.a, v)
            room = len(now) < self.caps[v]
            trials[v] = now, [u for u in range(p.n_vars) if room and not self.a[u, v] and self.allowed[u, v] and s.fits(v, [*now, u])]
        s.prefetch([(v, t) for v, (now, more) in trials.items() for t in [now, *[[*now, u] for u in more], *[[x for x in now if x != u] for u in now]]])
        for v, (now, more) in trials.items():
            base = s.local(v, now)
            self.add[:, v] = self.drop[:, v] = -np.inf
            if more:
                self.add[more, v] = s.added(v, now, more) - base
            for u in now:
                self.drop[u, v] = s.local(v, [x for x in now if x != u]) - base

    def gains(self) -> np.ndarray:
        """Gains by operation and edge; minus infinity where a change isn't legal."""
        on = self.a > 0
        reach = G.closure_of(self.a)
        add = np.where(on | on.T | reach.T, -np.inf, self.add)
        other_way = (self.a @ reach.astype(int) - self.a) > 0
        turn = np.where(on & ~other_way, self.drop + self.add.T, -np.inf)
        return np.stack([add, np.where(on, self.drop, -np.inf), turn])

    def apply(self, op: int, u: int, v: int) -> None:
        self.a[u, v] = int(op == ADD)
        if op == REVERSE:
            self.a[v, u] = 1
        self.refresh([v, u] if op == REVERSE else [v])


def _best(gains: np.ndarray) -> tuple[float, int, int, int]:
    """The largest gain; among equals the first operation and the smallest edge, which is the first in memory."""
    op, u, v = np.unravel_index(int(np.argmax(gains)), gains.shape)
    return float(gains[op, u, v]), int(op), int(u), int(v)


def hill_climb(p: Problem, scores: Scores, start: np.ndarray | None = None, max_iter: int = 500, least: float = 0.0) -> np.ndarray:
    """The best change of all each time: additions before deletions before reversals among equals, then the smaller edge."""
    c = _Climb(p, scores, checked_start(p, start))
    steps = 0
    while steps < max_iter:
        gain, op, u, v = _best(c.gains())
        if not gain > least:
            break
        c.apply(op, u, v)
        steps += 1
    p.notes["iterations"] = steps
    return c.a


def tabu(p: Problem, scores: Scores, start: np.ndarray | None = None, length: int = 10, max_iter: int = 500) -> np.ndarray:
    """Best allowed change even if it loses; a change's inverse is barred for a while unless it leads beyond the best seen."""
    c = _Climb(p, scores, checked_start(p, start))
    now = best = scores.total(c.a)
    kept, barred, idle = c.a.copy(), [], 0
    patience = max(5 * length, 50)
    for _ in range(max_iter):
        gains = c.gains()
        for move in barred:
            if not now + gains[move] > best:
                gains[move] = -np.inf
        gain, op, u, v = _best(gains)
        if gain == -np.inf or idle >= patience:
            break
        c.apply(op, u, v)
        now += gain
        barred = [*barred, {ADD: (DELETE, u, v), DELETE: (ADD, u, v), REVERSE: (REVERSE, v, u)}[op]][-length:]
        idle += 1
        if now > best + 1e-12:
            best, kept, idle = now, c.a.copy(), 0
    return kept


def exact_search(p: Problem, scores: Scores) -> np.ndarray:
    """The best graph of all, by dynamic programming over subsets of variables; at most 20 variables."""
    n = p.n_vars
    if n > 20:
        raise ValueError("exact search takes at most 20 variables")
    cap = p.cap()
    families = [(v, c) for v in range(n) for k in range(min(cap, n - 1) + 1) for c in combinations([u for u in range(n) if p.joinable(u, v)], k)]
    scores.prefetch(families)
    best_set: list[dict[int, tuple[float, tuple[int, ...]]]] = [{} for _ in range(n)]
    for v, c in families:
        best_set[v][sum(1 << u for u in c)] = (scores.local(v, c), c)
    top: list[np.ndarray] = []
    pick: list[dict[int, tuple[int, ...]]] = []
    for v in range(n):
        # best parents within every subset of the others, by adding one variable at a time
        value, arg = np.full(1 << n, -np.inf), {}
        for mask in range(1 << n):
            if mask >> v & 1:
                continue
            if mask in best_set[v]:
                value[mask], arg[mask] = best_set[v][mask]
            for u in range(n):
                if mask >> u & 1 and value[mask ^ 1 << u] > value[mask]:
                    value[mask], arg[mask] = value[mask ^ 1 << u], arg[mask ^ 1 << u]
        top.append(value)
        pick.append(arg)
    whole = np.full(1 << n, -np.inf)
    whole[0], sink = 0.0, [-1] * (1 << n)
    for mask in range(1, 1 << n):
        for v in range(n):
            if mask >> v & 1 and (s := whole[mask ^ 1 << v] + top[v][mask ^ 1 << v]) > whole[mask]:
                whole[mask], sink[mask] = s, v
    a, mask = np.zeros((n, n), dtype=int), (1 << n) - 1
    while mask:
        v = sink[mask]
        mask ^= 1 << v
        a[list(pick[v][mask]), v] = 1
    return a


def _insert(p: Problem, ranked: Sequence[tuple[int, int]], caps: bool = True) -> np.ndarray:
    """Edges in order, those that close a cycle or exceed a cap left out."""
    a = np.zeros((p.n_vars, p.n_vars), dtype=int)
    for u, v in ranked:
        if (not caps or a[:, v].sum() < p.cap(v)) and not G.closes_cycle(a, u, v):
            a[u, v] = 1
    return a


def rooted_vote(p: Problem, scores: Scores) -> np.ndarray:
    """One local graph around each variable as root; edges are counted, ties in direction dropped, the rest inserted by count and lead."""
    n = p.n_vars
    votes = np.zeros((n, n), dtype=int)
    scores.prefetch([(v, ()) for v in range(n)] + [(v, (u,)) for v in range(n) for u in range(n) if p.joinable(u, v)])
    for v in range(n):
        scores.added(v, (), [u for u in range(n) if p.joinable(u, v) and scores.fits(v, [u])])
    for root in range(n):
        local = np.zeros((n, n), dtype=int)
        for v in [root, *[x for x in range(n) if x != root]]:
            start = []
            if v != root:
                if not p.joinable(root, v) or not scores.fits(v, [root]) or scores.local(v, [root]) <= scores.local(v, []):
                    continue
                start = [root]
            mine = [u for u in range(n) if p.joinable(u, v)]
            below = G.descendants(local, v)
            for u in _greedy(scores, v, mine, p.cap(v), start, ok=lambda u, below=below: u not in below):
                local[u, v] = 1
        votes += local
    ranked = []
    for u, v in combinations(range(n), 2):
        if votes[u, v] != votes[v, u]:
            a, b = (u, v) if votes[u, v] > votes[v, u] else (v, u)
            ranked.append((votes[u, v] + votes[v, u], abs(votes[u, v] - votes[v, u]), a, b))
    ranked.sort(key=lambda t: (-t[0], -t[1]))
    return _insert(p, [(a, b) for *_, a, b in ranked])


def random_dag(p: Problem, rng: np.random.Generator, chance: float = 0.3) -> np.ndarray:
    order, a = rng.permutation(p.n_vars), np.zeros((p.n_vars, p.n_vars), dtype=int)
    for i, j in combinations(range(p.n_vars), 2):
        u, v = int(order[i]), int(order[j])
        if p.joinable(u, v) and rng.random() < chance and a[:, v].sum() < p.cap(v):
            a[u, v] = 1
    return a


def communities(undirected: np.ndarray, spread: float = 1.0, overlap: float = 0.5) -> list[list[int]]:
    """Overlapping communities of a skeleton.

    From the variables with most neighbours down, a variable that isn't covered along with all its neighbours starts a
    community, which takes in the neighbour that raises its fitness most, the share of its degrees that lie inside, while one
    does. Communities that share at least ``overlap`` of the smaller one are then fused, until no two are.
    """
    n = len(undirected)
    degree = undirected.sum(axis=1)
    near = [set(map(int, np.flatnonzero(undirected[v]))) for v in range(n)]

    def fitness(group: set[int]) -> float:
        on = sorted(group)
        all_ = float(degree[on].sum()) ** spread
        return float(undirected[np.ix_(on, on)].sum()) / all_ if all_ > 0 else 0.0

    covered: set[int] = set()
    groups: list[set[int]] = []
    for seed in sorted(range(n), key=lambda v: (-degree[v], v)):
        if {seed, *near[seed]} <= covered:
            continue
        group, now = {seed}, fitness({seed})
        while edge := set().union(*(near[v] for v in group)) - group:
            best = max(edge, key=lambda u: (fitness(group | {u}), -u))
            if (value := fitness(group | {best})) <= now:
                break
            group.add(best)
            now = value
        groups.append(group)
        covered |= group
    groups += [{v} for v in range(n) if v not in covered]
    while True:
        pair = next(((i, j) for i, j in combinations(range(len(groups)), 2) if (shared := len(groups[i] & groups[j])) and shared >= overlap * min(len(groups[i]), len(groups[j]))), None)
        if pair is None:
            return [sorted(g) for g in groups]
        groups[pair[0]] |= groups.pop(pair[1])


def combine(p: Problem, scores: Scores, parts: Sequence[tuple[list[int], np.ndarray]]) -> np.ndarray:
    """Graphs over parts of the variables as one: edges by the gain each brings alone, without cycles and within the caps."""
    edges = {(nodes[i], nodes[j]) for nodes, a in parts for i, j in G.edges_of(a)}
    scores.prefetch([(v, (u,)) for u, v in edges] + [(v, ()) for _, v in edges])
    ranked = sorted(edges, key=lambda e: (-(scores.local(e[1], [e[0]]) - scores.local(e[1], [])), e[0], e[1]))
    return _insert(p, ranked)


def _sub_scores(scores: Scores, nodes: list[int]) -> "Scores":
    class Part(Scores):
        def __init__(self) -> None:
            self.counter = scores.counter

        def prefetch(self, families) -> None:
            scores.prefetch([(nodes[v], [nodes[u] for u in us]) for v, us in families])

        def local(self, var, parents) -> float:
            return scores.local(nodes[var], [nodes[u] for u in parents])

        def added(self, var, parents, more) -> np.ndarray:
            return scores.added(nodes[var], [nodes[u] for u in parents], [nodes[u] for u in more])

        def fits(self, var, parents) -> bool:
            return scores.fits(nodes[var], [nodes[u] for u in parents])

        def total(self, adjacency) -> float:
            return sum(self.local(v, G.parents(adjacency, v)) for v in range(len(adjacency)))

    return Part()


class _PartProblem(Problem):
    """Some of the variables, under the constraints of the whole."""

    def __init__(self, p: Problem, nodes: list[int]) -> None:
        self.whole, self.nodes = p, nodes
        self.place, self.permutation, self.mask, self.notes = None, None, None, {}

    @property
    def n_vars(self) -> int:
        return len(self.nodes)

    @property
    def cards(self) -> tuple[int, ...]:
        return tuple(self.whole.cards[v] for v in self.nodes)

    def cap(self, v: int = 0) -> int:
        return self.whole.cap(self.nodes[v])

    def joinable(self, u: int, v: int) -> bool:
        return self.whole.joinable(self.nodes[u], self.nodes[v])

    def allowed(self, u: int, v: int) -> bool:
        return self.joinable(u, v)


def iterated_communities(p: Problem, scores: Scores, base: Callable[[Problem, Scores], np.ndarray] = hill_climb, rounds: int = 10) -> np.ndarray:
    """Three graphs are split into communities by their best, common and joint skeletons, relearnt there and joined, again and again."""
    rng = np.random.default_rng(p.seed)
    pool = sorted(((scores.total(a), i, a) for i, a in enumerate(random_dag(p, rng) for _ in range(3))), key=lambda t: -t[0])
    done: dict[tuple[int, ...], np.ndarray] = {}
    for _ in range(rounds):
        skeletons = [G.skeleton(a) for *_, a in pool]
        seeds = [skeletons[0], np.minimum.reduce(skeletons), np.maximum.reduce(skeletons)]
        if p.mask is not None:
            seeds = [s & G.skeleton(p.mask) for s in seeds]
        before = [a.tobytes() for *_, a in pool]
        for seed in seeds:
            parts = []
            for nodes in communities(seed):
                if tuple(nodes) not in done:
                    done[tuple(nodes)] = np.zeros((1, 1), dtype=int) if len(nodes) == 1 else base(_PartProblem(p, nodes), _sub_scores(scores, nodes))
                parts.append((nodes, done[tuple(nodes)]))
            a = combine(p, scores, parts)
            pool.append((scores.total(a), len(pool), a))
        distinct = {a.tobytes(): (s, i, a) for s, i, a in sorted(pool, key=lambda t: t[0])}
        pool = sorted(distinct.values(), key=lambda t: -t[0])[:3]
        if [a.tobytes() for *_, a in pool] == before:
            break
    return pool[0][2]


def k_tree(n: int, k: int, rng: np.random.Generator, order: Sequence[int] | None = None) -> tuple[np.ndarray, dict[int, list[int]]]:
    """A random maximal graph of treewidth k, and for each variable the earlier ones that it is joined to, which form a clique."""
    order = [int(v) for v in (rng.permutation(n) if order is None else order)]
    graph, earlier, cliques = np.zeros((n, n), dtype=int), {}, []
    for i, v in enumerate(order):
        if i <= k:
            near = order[:i]
        else:
            if not cliques:
                cliques = [list(c) for c in combinations(order[: k + 1], k)]
            near = list(cliques[int(rng.integers(len(cliques)))])
            cliques += [sorted([*[x for x in near if x != gone], v]) for gone in near]
        earlier[v] = near
        graph[v, near] = graph[near, v] = 1
    return graph, earlier


def bounded_treewidth(p: Problem, scores: Scores, k: int = 2, trees: int = 20) -> np.ndarray:
    """Greedy parents within random k-trees; the tree with the best total is kept (note ``ktree``)."""
    rng = np.random.default_rng(p.seed)
    k = min(k, max(1, p.n_vars - 1))
    cap = k if p.max_parents is None else min(k, p.cap())
    best, kept = -np.inf, np.zeros((p.n_vars, p.n_vars), dtype=int)
    for _ in range(max(1, trees)):
        tree, earlier = k_tree(p.n_vars, k, rng, p.permutation)
        a = np.zeros_like(kept)
        for v in range(p.n_vars):
            for u in _greedy(scores, v, [u for u in earlier[v] if p.joinable(u, v)], cap):
                a[u, v] = 1
        if (total := scores.total(a)) > best:
            best, kept, p.notes["ktree"] = total, a, tree
    return kept


def split_vars(p: Problem, v: int, candidates: Sequence[int], alpha: float, by: str, max_depth: int | None, max_leaves: int | None) -> dict[int, float]:
    """Variables that a tree for v over all candidates splits on, with their best gains; level by level, each a batch of counts."""
    k, n, c = p.cards[v], p.counter.n, p.counter
    used: dict[int, float] = {}
    leaf_count = 1
    value = (lambda r: leaf_k2(r, alpha)) if by == "k2" else (lambda r: leaf_likelihood(r, alpha / k))
    level: list[tuple[tuple[tuple[int, int], ...], list[int]]] = [((), list(candidates))]
    while level:
        c.prefetch([((u, v), path) for path, free in level for u in free])
        following = []
        for path, free in level:
            if not free or max_depth is not None and len(path) >= max_depth:
                continue
            base, best, pick = None, 0.0, -1
            for u in free:
                if u not in used and len(used) >= p.cap(v) or max_leaves is not None and leaf_count + p.cards[u] - 1 > max_leaves:
                    continue
                rows = c.table((u, v), path)
                if rows.sum() == 0:
                    break
                base = float(value(rows.sum(axis=0))) if base is None else base
                gain = float(value(rows).sum()) - base - (0.0 if by == "k2" else (p.cards[u] - 1) * (k - 1) * log(max(n, 1)) / 2)
                if gain > best:
                    best, pick = gain, u
            if pick >= 0:
                used[pick] = max(used.get(pick, -np.inf), best)
                leaf_count += p.cards[pick] - 1
                following += [((*path, (pick, s)), [u for u in free if u != pick]) for s in range(p.cards[pick])]
        level = following
    return used


def one_shot_graph(p: Problem, alpha: float = 1.0, by: str = "mdl", max_depth: int | None = None, max_leaves: int | None = None) -> np.ndarray:
    """One tree for each variable; its split variables become edges, inserted by gain."""
    by = {"bic": "mdl"}.get(by, by)
    if by not in ("mdl", "k2"):
        raise ValueError("trees split by mdl, bic or k2")
    edges = [(gain, u, v) for v in range(p.n_vars) for u, gain in split_vars(p, v, p.candidates(v), alpha, by, max_depth, max_leaves).items()]
    return _insert(p, [(u, v) for _, u, v in sorted(edges, key=lambda e: (-e[0], e[1], e[2]))])


def variable_clusters(c: Counter, alpha: float = 1.0, stop: float = 0.0, most_cells: int | None = None) -> dict:
    """Clusters joined by the largest log Bayes factor, while above ``stop``: ``clusters`` and ``merges``."""
    most = max(int(c.n), 1000) if most_cells is None else most_cells
    known: dict[tuple[int, ...], float] = {}

    def evidence(s: tuple[int, ...]) -> float:
        key = tuple(sorted(s))
        if key not in known:
            known[key] = float(leaf_k2(c.table(key).reshape(1, -1), alpha)[0])
        return known[key]

    clusters, merges = [(v,) for v in range(c.n_vars)], []
    while len(clusters) > 1:
        pairs = [(i, j) for i, j in combinations(range(len(clusters)), 2) if c.cells(clusters[i] + clusters[j]) <= most]
        c.prefetch([clusters[i] + clusters[j] for i, j in pairs if tuple(sorted(clusters[i] + clusters[j])) not in known])
        scored = [(evidence(clusters[i] + clusters[j]) - evidence(clusters[i]) - evidence(clusters[j]), i, j) for i, j in pairs]
        best = max(scored, key=lambda t: (t[0], -t[1], -t[2]), default=(-np.inf, -1, -1))
        if best[1] < 0 or best[0] <= stop:
            break
        _, i, j = best
        merges.append((list(clusters[i]), list(clusters[j]), best[0]))
        joined = clusters[i] + clusters[j]
        clusters = [x for k, x in enumerate(clusters) if k not in (i, j)] + [joined]
    return {"clusters": [list(x) for x in clusters], "merges": merges}


def information(c: Counter, bits: bool = False) -> np.ndarray:
    """Pairwise mutual information, all pairs in one batch."""
    n = c.n_vars
    c.pairs()
    out = np.zeros((n, n))
    for i, j in combinations(range(n), 2):
        t = c.table((i, j))
        total = max(t.sum(), 1e-300)
        outer = t.sum(axis=1, keepdims=True) * t.sum(axis=0, keepdims=True)
        on = t > 0
        out[i, j] = out[j, i] = max(0.0, float((t[on] / total * np.log(t[on] * total / outer[on])).sum()))
    return out / log(2) if bits else out


def information_order(p: Problem, scores: Scores, top: int | None = None) -> list[int]:
    """Sources first: best single parents, strongly connected parts contracted, hubs first within them."""
    mi, n = information(p.counter), p.n_vars
    top = min(n - 1, max(5, n // 2)) if top is None else top
    near = {v: [int(u) for u in np.argsort(-mi[v], kind="stable") if u != v][:top] for v in range(n)}
    scores.prefetch([(v, ()) for v in range(n)] + [(v, (u,)) for v, us in near.items() for u in us])
    best = np.zeros((n, n), dtype=int)
    for v, us in near.items():
        gains = [(scores.local(v, [u]) - scores.local(v, []), -i, u) for i, u in enumerate(us)]
        if gains and max(gains)[0] > 0:
            best[max(gains)[2], v] = 1
    total = mi.sum(axis=1)
    return [v for part in G.strong_components(best) for v in sorted(part, key=lambda x: -total[x])]


def information_mask(c: Counter, top: int) -> np.ndarray:
    """Pairs in which one is among the other's ``top`` partners by information."""
    mi, n = information(c), c.n_vars
    out = np.zeros((n, n), dtype=int)
    for v in range(n):
        for u in [int(u) for u in np.argsort(-mi[v], kind="stable") if u != v and mi[v, u] > 0][:top]:
            out[u, v] = out[v, u] = 1
    return out


def votes_to_dag(p: Problem, graphs: Sequence[np.ndarray]) -> np.ndarray:
    """Edges found by at least half of the graphs, by votes."""
    votes = np.sum(graphs, axis=0)
    ranked = sorted((-votes[u, v], u, v) for u, v in G.edges_of(votes) if 2 * votes[u, v] >= len(graphs))
    return _insert(p, [(u, v) for _, u, v in ranked])


def k2_variant(p: Problem, scores: Scores, order: str = "mi", mask: str | None = None, refine: bool = False, ensemble: int = 0) -> np.ndarray:
    """K2 with an order and candidates from the data, a final climb, or a vote over several orders."""
    from tallygrid.operators.sparse import elastic_mask

    top = max(5, p.n_vars // 2)
    allowed = {"mi": lambda: information_mask(p.counter, top), "elastic": lambda: elastic_mask(p.counter), None: lambda: None}[mask]()
    first = p.order() if order == "given" else information_order(p, scores)
    if ensemble:
        rng = np.random.default_rng(p.seed)
        orders = [first, first[::-1], *[[int(v) for v in rng.permutation(p.n_vars)] for _ in range(ensemble - 2)]]
        a = votes_to_dag(p, [k2_search(p, scores, o, allowed) for o in orders])
    else:
        a = k2_search(p, scores, first, allowed)
    if refine:
        free = Problem(p.counter, None, p.mask, p.max_parents)
        a = hill_climb(free, scores, a, least=1e-10)
    return a


def bound_problem(p: Problem, factor: float) -> Problem:
    """With a cap for each variable from the data size, if none was given."""
    if p.max_parents is not None:
        return p
    return Problem(p.counter, p.permutation, p.mask, parent_bounds(p.cards, int(p.counter.n), factor), p.seed, p.notes)


def markov_trees(p: Problem, alpha: float = 1.0, max_depth: int | None = None) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
    """Undirected structure and conjunctive features: a tree for each variable over all others."""
    n = p.n_vars
    a, features = np.zeros((n, n), dtype=int), []
    for v in range(n):
        tree, used = _paths(p, v, alpha, max_depth)
        for u in sorted(used)[: p.cap(v)]:
            a[u, v] = a[v, u] = 1
        features += [[*path, (v, s)] for path in tree for s in range(p.cards[v])]
    return a, features


def _paths(p: Problem, v: int, alpha: float, max_depth: int | None) -> tuple[list[tuple[tuple[int, int], ...]], set[int]]:
    """Leaf paths of a tree over all other variables."""
    k, c = p.cards[v], p.counter
    leaves, used = [], set()
    level = [((), [u for u in range(p.n_vars) if u != v])]
    while level:
        c.prefetch([((u, v), path) for path, free in level for u in free])
        following = []
        for path, free in level:
            best, pick = 0.0, -1
            if free and (max_depth is None or len(path) < max_depth):
                for u in free:
                    rows = c.table((u, v), path)
                    if rows.sum() == 0:
                        break
                    gain = float(leaf_likelihood(rows, alpha / k).sum() - leaf_likelihood(rows.sum(axis=0), alpha / k)) - (p.cards[u] - 1) * (k - 1) * log(max(c.n, 1)) / 2
                    if gain > best:
                        best, pick = gain, u
            if pick < 0:
                leaves.append(path)
            else:
                used.add(pick)
                following += [((*path, (pick, s)), [u for u in free if u != pick]) for s in range(p.cards[pick])]
        level = following
    return leaves, used
