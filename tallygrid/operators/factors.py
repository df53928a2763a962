"""Inference on networks of tables: elimination, message passing, best configurations, junction trees.

The tables of a network are small whatever the data were; they live on the driver. For factors kept in Spark see
``relational``.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from math import prod

import numpy as np

from tallygrid.operators import graphs as G


@dataclass(frozen=True)
class Factor:
    """A non-negative table with one axis for each variable of the scope, which is sorted."""

    scope: tuple[int, ...]
    values: np.ndarray

    def aligned(self, scope: Sequence[int]) -> np.ndarray:
        shape = [1] * len(scope)
        for v, k in zip(self.scope, self.values.shape, strict=True):
            shape[scope.index(v)] = k
        return self.values.reshape(shape)

    def __mul__(self, other: "Factor") -> "Factor":
        scope = tuple(sorted({*self.scope, *other.scope}))
        return Factor(scope, self.aligned(scope) * other.aligned(scope))

    def onto(self, keep: Iterable[int], how: str = "sum") -> "Factor":
        """Other variables summed or maximised out."""
        keep = tuple(v for v in self.scope if v in set(keep))
        axes = tuple(i for i, v in enumerate(self.scope) if v not in keep)
        return Factor(keep, getattr(self.values, how)(axis=axes) if axes else self.values)

    def without(self, v: int, how: str = "sum") -> "Factor":
        return self.onto(set(self.scope) - {v}, how)

    def restrict(self, evidence: Mapping[int, int]) -> "Factor":
        """The slice at the evidence, whose variables leave the scope."""
        index = tuple(evidence[v] if v in evidence else slice(None) for v in self.scope)
        return Factor(tuple(v for v in self.scope if v not in evidence), self.values[index])

    def masked(self, evidence: Mapping[int, int]) -> "Factor":
        """Zero where the evidence doesn't hold; the scope stays."""
        out = self
        for v in self.scope:
            if v in evidence:
                out = out * indicator(v, self.values.shape[self.scope.index(v)], evidence[v])
        return out


def indicator(v: int, k: int, states: int | Sequence[int]) -> Factor:
    hot = np.zeros(k)
    hot[states] = 1
    return Factor((v,), hot)


def product(factors: Iterable[Factor]) -> Factor:
    out = Factor((), np.ones(()))
    for f in factors:
        out = out * f
    return out


@dataclass
class Tables:
    """The tables of a network: parents and P(state | parent configuration) of each variable."""

    cards: tuple[int, ...]
    parents: list[tuple[int, ...]]
    probs: list[np.ndarray]

    @property
    def n(self) -> int:
        return len(self.cards)

    def adjacency(self) -> np.ndarray:
        return G.adjacency_of(self.n, [(u, v) for v, us in enumerate(self.parents) for u in us])

    def factor(self, v: int) -> Factor:
        scope = (*self.parents[v], v)
        table = np.asarray(self.probs[v], dtype=float).reshape([self.cards[u] for u in scope], order="F") if self.parents[v] else np.asarray(self.probs[v], dtype=float).reshape(-1)
        order = np.argsort(scope)
        return Factor(tuple(scope[i] for i in order), np.transpose(table, order))

    def factors(self) -> list[Factor]:
        return [self.factor(v) for v in range(self.n)]

    def evidence(self, given) -> dict[int, int]:
        """Checked evidence from a mapping or pairs."""
        out = {int(v): int(s) for v, s in (given.items() if isinstance(given, Mapping) else given or ())}
        for v, s in out.items():
            if not 0 <= v < self.n or not 0 <= s < self.cards[v]:
                raise ValueError(f"variable {v} has no state {s}")
        return out

    def probability(self, x: Sequence[int]) -> float:
        return float(prod(float(f.values[tuple(x[v] for v in f.scope)]) for f in self.factors()))

    def joint(self) -> Factor:
        return product(self.factors())


def plan(t: Tables, how: str = "min_fill") -> tuple[list[int], int]:
    """Elimination order of the moral graph and its treewidth."""
    order, filled = G.elimination_order(G.moral(t.adjacency()), how)
    left, width = set(range(t.n)), 0
    for v in order:
        left.discard(v)
        width = max(width, sum(1 for u in left if filled[v, u]))
    return order, width


def _eliminated(factors: list[Factor], order: Iterable[int], how: str) -> tuple[list[Factor], list[tuple[int, Factor]]]:
    trail = []
    for v in order:
        joined = product([f for f in factors if v in f.scope])
        if v not in joined.scope:
            continue
        factors = [f for f in factors if v not in f.scope] + [joined.without(v, how)]
        trail.append((v, joined))
    return factors, trail


def best_by_elimination(t: Tables, allowed: Mapping[int, Sequence[int]] | None = None) -> tuple[list[int], float]:
    """The most probable configuration with every variable in its allowed states; the lowest state of equals."""
    allowed = allowed or {}
    factors = t.factors() + [indicator(v, t.cards[v], list(s)) for v, s in allowed.items()]
    _, trail = _eliminated(factors, plan(t)[0], "max")
    found: dict[int, int] = {}
    for v, f in reversed(trail):
        found[v] = int(np.argmax(f.restrict({u: found[u] for u in f.scope if u in found}).values))
    x = [found[v] for v in range(t.n)]
    return x, t.probability(x) if all(x[v] in s for v, s in allowed.items()) else 0.0


def _messages(t: Tables, evidence: dict[int, int], how: str, damping: float, rounds: int, tolerance: float) -> list[np.ndarray]:
    """Loopy beliefs of the variables."""
    factors = [f.masked(evidence) for f in t.factors()]
    damping = min(max(damping, 0.0), 0.99)
    up = {(i, v): np.full(t.cards[v], 1 / t.cards[v]) for i, f in enumerate(factors) for v in f.scope}
    around = {v: [i for i, f in enumerate(factors) if v in f.scope] for v in range(t.n)}
    for _ in range(rounds):
        change = 0.0
        for (i, v), old in list(up.items()):
            f = factors[i]
            joined = f
            for u in f.scope:
                if u != v:
                    joined = joined * Factor((u,), np.prod([up[j, u] for j in around[u] if j != i] + [np.ones(t.cards[u])], axis=0))
            new = joined.onto([v], how).values
            new = new / new.sum() if new.sum() > 0 else np.full(t.cards[v], 1 / t.cards[v])
            new = damping * old + (1 - damping) * new
            change = max(change, float(np.abs(new - old).max()))
            up[i, v] = new
        if change < tolerance:
            break
    out = []
    for v in range(t.n):
        b = np.prod([up[i, v] for i in around[v]], axis=0)
        out.append(b / b.sum() if b.sum() > 0 else np.full(t.cards[v], 1 / t.cards[v]))
    return out


def best_by_messages(t: Tables, evidence: dict[int, int], damping: float = 0.5, rounds: int = 100, tolerance: float = 1e-6) -> tuple[list[int], float]:
    beliefs = _messages(t, evidence, "max", damping, rounds, tolerance)
    x = [evidence.get(v, int(np.argmax(b))) for v, b in enumerate(beliefs)]
    return x, t.probability(x)


def best_by_sweeps(t: Tables, evidence: dict[int, int], rounds: int = 50) -> tuple[list[int], float]:
    """Sequential reweighted messages, forward and backward along the variables; the best configuration decoded is kept."""
    tiny = 1e-300
    factors = [Factor(f.scope, np.log(np.maximum(f.values, tiny))) for f in (f.masked(evidence) for f in t.factors())]
    around = {v: [i for i, f in enumerate(factors) if v in f.scope] for v in range(t.n)}
    message = {(i, v): np.zeros(t.cards[v]) for v in range(t.n) for i in around[v]}
    best, kept = -1.0, [evidence.get(v, 0) for v in range(t.n)]

    def reparametrised(i: int) -> Factor:
        f = factors[i]
        values = f.values.copy()
        for u in f.scope:
            values = values + Factor((u,), message[i, u]).aligned(f.scope)
        return Factor(f.scope, values)

    for r in range(rounds):
        order = range(t.n) if r % 2 == 0 else range(t.n - 1, -1, -1)
        x: dict[int, int] = dict(evidence)
        for v in order:
            margins = {i: reparametrised(i).onto([v], "max").values for i in around[v]}
            total = np.sum(list(margins.values()), axis=0)
            for i in around[v]:
                message[i, v] = message[i, v] + total / len(around[v]) - margins[i]
            if v not in x:
                score = sum(reparametrised(i).restrict({u: x[u] for u in factors[i].scope if u in x and u != v}).onto([v], "max").values for i in around[v])
                x[v] = int(np.argmax(score))
        decoded = [x[v] for v in range(t.n)]
        if (p := t.probability(decoded)) > best:
            best, kept = p, decoded
    return kept, best


def most_probable(t: Tables, given=None, method: str = "auto") -> tuple[list[int], float]:
    """``ve`` exact, ``loopy`` and ``srmp`` approximate; ``auto`` is exact up to a treewidth of 8."""
    evidence = t.evidence(given)
    if method == "auto":
        method = "ve" if plan(t)[1] <= 8 else "loopy"
    if method in ("ve", "exact"):
        return best_by_elimination(t, {v: [s] for v, s in evidence.items()})
    if method == "loopy":
        return best_by_messages(t, evidence)
    if method in ("srmp", "trws"):
        return best_by_sweeps(t, evidence)
    raise ValueError(f"unknown method {method!r}")


def k_most_probable(t: Tables, k: int, given=None, method: str = "partition") -> list[tuple[list[int], float]]:
    """The k most probable configurations with positive probability, fewer if there are fewer.

    ``partition`` splits the rest of the space around each solution; ``astar`` extends partial assignments by their best
    completion.
    """
    evidence = t.evidence(given)
    if k <= 0:
        return []
    out: list[tuple[list[int], float]] = []
    if method == "partition":
        start = {v: (evidence[v],) if v in evidence else tuple(range(t.cards[v])) for v in range(t.n)}
        x, p = best_by_elimination(t, start)
        heap = [(-p, x, start)]
        while heap and len(out) < k:
            p, x, space = heapq.heappop(heap)
            if p == 0:
                break
            out.append((x, -p))
            for i in range(t.n):
                rest = tuple(s for s in space[i] if s != x[i])
                if rest:
                    part = {**{j: (x[j],) for j in range(i)}, i: rest, **{j: space[j] for j in range(i + 1, t.n)}}
                    y, q = best_by_elimination(t, part)
                    if q > 0:
                        heapq.heappush(heap, (-q, y, part))
        return out
    if method == "astar":
        x, p = best_by_elimination(t, {v: (s,) for v, s in evidence.items()})
        heap2 = [(-p, 0, ())]
        while heap2 and len(out) < k:
            p, depth, prefix = heapq.heappop(heap2)
            if p == 0:
                break
            if depth == t.n:
                out.append((list(prefix), t.probability(prefix)))
                continue
            for s in [evidence[depth]] if depth in evidence else range(t.cards[depth]):
                fixed = {**{v: (z,) for v, z in evidence.items()}, **{i: (z,) for i, z in enumerate((*prefix, s))}}
                if (q := best_by_elimination(t, fixed)[1]) > 0:
                    heapq.heappush(heap2, (-q, depth + 1, (*prefix, s)))
        return out
    raise ValueError(f"unknown method {method!r}")


def marginals(t: Tables, given=None, method: str = "ve") -> list[np.ndarray]:
    """Of every variable: ``ve``, ``loopy`` or ``mean_field``. Impossible evidence gives uniform ones, evidence itself an indicator."""
    evidence = t.evidence(given)
    if method == "mean_field":
        return _mean_field(t, evidence)
    if method == "loopy":
        return _messages(t, evidence, "sum", 0.5, 100, 1e-6)
    if method != "ve":
        raise ValueError(f"unknown method {method!r}")
    order, _ = plan(t)
    out = []
    for v in range(t.n):
        if v in evidence:
            out.append(indicator(v, t.cards[v], evidence[v]).values)
            continue
        left, _ = _eliminated([f.restrict(evidence) for f in t.factors()], [u for u in order if u != v and u not in evidence], "sum")
        b = product(left).values
        out.append(b / b.sum() if b.sum() > 0 else np.full(t.cards[v], 1 / t.cards[v]))
    return out


def _mean_field(t: Tables, evidence: dict[int, int], rounds: int = 200, tolerance: float = 1e-8) -> list[np.ndarray]:
    logs = [Factor(f.scope, np.log(np.maximum(f.values, 1e-300))) for f in t.factors()]
    q = [indicator(v, k, evidence[v]).values if v in evidence else np.full(k, 1 / k) for v, k in enumerate(t.cards)]
    for _ in range(rounds):
        change = 0.0
        for v in range(t.n):
            if v in evidence:
                continue
            total = np.zeros(t.cards[v])
            for f in logs:
                if v in f.scope:
                    total = total + product([f, *[Factor((u,), q[u]) for u in f.scope if u != v]]).onto([v]).values
            new = np.exp(total - total.max())
            new /= new.sum()
            change = max(change, float(np.abs(new - q[v]).max()))
            q[v] = new
        if change < tolerance:
            break
    return q


@dataclass
class Circuit:
    """A junction tree with its tables: cliques, the parent of each (-1: root), an order from the roots."""

    tables: Tables
    cliques: list[tuple[int, ...]]
    parent: list[int]
    order: list[int]
    psi: list[Factor]
    children: dict[int, list[int]] = field(default_factory=dict)

    @staticmethod
    def compile(t: Tables, how: str = "min_fill") -> "Circuit":
        cliques = G.triangulated_cliques(*G.elimination_order(G.moral(t.adjacency()), how))
        walk = G.sampling_order(cliques, G.junction_tree(cliques))
        parent = [-1] * len(cliques)
        for c, up in walk:
            parent[c] = up
        psi = [Factor(c, np.ones([t.cards[v] for v in c])) for c in cliques]
        for f in t.factors():
            home = next(i for i, c in enumerate(cliques) if set(f.scope) <= set(c))
            psi[home] = psi[home] * f
        out = Circuit(t, cliques, parent, [c for c, _ in walk], psi)
        out.children = {i: [j for j in out.order if parent[j] == i] for i in range(len(cliques))}
        return out

    def size(self) -> dict[str, int]:
        """Numbers of cliques, table cells, sums and products."""
        cells = [f.values.size for f in self.psi]
        seps = [prod(self.tables.cards[v] for v in set(self.cliques[i]) & set(self.cliques[p])) if p >= 0 else 1 for i, p in enumerate(self.parent)]
        return {"cliques": len(cells), "cells": sum(cells), "sums": sum(c - s for c, s in zip(cells, seps, strict=True)), "products": sum(c * len(self.children[i]) for i, c in enumerate(cells)), "width": max(map(len, self.cliques)) - 1}

    def upward(self, evidence: dict[int, int], how: str = "sum") -> tuple[list[Factor], dict[int, Factor]]:
        """Collected clique tables, and the message of each clique to its parent."""
        held, sent = [f.masked(evidence) for f in self.psi], {}
        for i in reversed(self.order):
            for j in self.children[i]:
                held[i] = held[i] * sent[j]
            p = self.parent[i]
            sent[i] = held[i].onto(set(self.cliques[i]) & set(self.cliques[p]) if p >= 0 else (), how)
        return held, sent

    def p_evidence(self, given=None) -> float:
        _, sent = self.upward(self.tables.evidence(given))
        return float(prod(float(sent[i].values) for i in self.order if self.parent[i] < 0))

    def beliefs(self, given=None) -> list[Factor]:
        """Unnormalised clique marginals, by an upward and a downward pass."""
        held, sent = self.upward(self.tables.evidence(given))
        out: list[Factor] = list(held)
        for i in self.order:
            p = self.parent[i]
            if p >= 0:
                shared = set(self.cliques[i]) & set(self.cliques[p])
                above, own = out[p].onto(shared), sent[i]
                ratio = np.divide(above.values, own.values, out=np.zeros_like(above.values), where=own.values > 0)
                out[i] = held[i] * Factor(above.scope, ratio)
        return out

    def marginals(self, given=None) -> list[np.ndarray]:
        beliefs, t = self.beliefs(given), self.tables
        out = []
        for v in range(t.n):
            b = next(f for f in beliefs if v in f.scope).onto([v]).values
            out.append(b / b.sum() if b.sum() > 0 else np.full(t.cards[v], 1 / t.cards[v]))
        return out

    def mpe(self, given=None) -> tuple[list[int], float]:
        held, _ = self.upward(self.tables.evidence(given), "max")
        found: dict[int, int] = {}
        for i in self.order:
            own = held[i].restrict({v: found[v] for v in held[i].scope if v in found})
            if own.scope:
                at = np.unravel_index(int(np.argmax(own.values)), own.values.shape)
                found |= {v: int(s) for v, s in zip(own.scope, at, strict=True)}
        x = [found[v] for v in range(self.tables.n)]
        return x, self.tables.probability(x)

    def clique_conditionals(self, given=None) -> list[tuple[tuple[int, ...], tuple[int, ...], np.ndarray]]:
        """(overlap, new, P(new | overlap)) of the cliques in order; first variables fastest. Rows without mass are uniform."""
        out, done = [], set()
        beliefs, cards = self.beliefs(given), self.tables.cards
        for i in self.order:
            overlap = tuple(v for v in self.cliques[i] if v in done)
            new = tuple(v for v in self.cliques[i] if v not in done)
            done |= set(new)
            if not new:
                continue
            f = beliefs[i]
            table = np.transpose(f.values, [f.scope.index(v) for v in (*overlap, *new)]).reshape((prod(cards[v] for v in overlap), prod(cards[v] for v in new)), order="F")
            total = table.sum(axis=1, keepdims=True)
            out.append((overlap, new, np.where(total > 0, table / np.where(total > 0, total, 1), 1 / table.shape[1])))
        return out
