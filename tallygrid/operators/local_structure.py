"""Conditional tables with local structure: trees whose leaves, for graphs after pooling, share distributions."""

from __future__ import annotations

from dataclasses import dataclass
from math import prod

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrid.operators.counter import Counter
from tallygrid.operators.scoring import Tree, grow, leaf_k2

MOST_CELLS = 65_536


@dataclass
class LocalTable:
    """``leaf_of`` gives each leaf of the tree, left to right, its row of ``probs``; splits are positions in ``parents``."""

    var: int
    parents: tuple[int, ...]
    parent_cards: tuple[int, ...]
    root: Tree
    leaf_of: list[int]
    probs: np.ndarray

    @property
    def n_leaves(self) -> int:
        return len(self.probs)

    @property
    def n_parameters(self) -> int:
        return len(self.probs) * (self.probs.shape[1] - 1)

    def paths(self) -> list[tuple[tuple[tuple[int, int], ...], int]]:
        """(parent position and state, ...) down to each leaf, and its row."""
        out: list[tuple[tuple[tuple[int, int], ...], int]] = []

        def walk(node: Tree, path: tuple[tuple[int, int], ...]) -> None:
            if not node.children:
                out.append((path, self.leaf_of[len(out)]))
            for s, child in enumerate(node.children):
                walk(child, (*path, (node.split, s)))

        walk(self.root, ())
        return out

    def route(self, x: np.ndarray) -> np.ndarray:
        """Rows of ``probs`` for a matrix of all variables."""
        out = np.empty(len(x), dtype=int)
        for path, leaf in self.paths():
            on = np.ones(len(x), dtype=bool)
            for position, state in path:
                on &= x[:, self.parents[position]] == state
            out[on] = leaf
        return out

    def route_sql(self, prefix: str = "x") -> str:
        """The same as one SQL expression, which Spark compiles."""
        numbered = iter(self.leaf_of)

        def build(node: Tree) -> str:
            if not node.children:
                return str(next(numbered))
            cases = " ".join(f"WHEN {s} THEN {build(c)}" for s, c in enumerate(node.children))
            return f"CASE {prefix}{self.parents[node.split]} {cases} END"

        return f"CAST({build(self.root)} AS INT)"

    def route_column(self, prefix: str = "x") -> Column:
        return F.expr(self.route_sql(prefix))

    def dense(self) -> np.ndarray | None:
        """The full table, first parent fastest; None beyond ``MOST_CELLS`` configurations."""
        q = prod(self.parent_cards)
        if q > MOST_CELLS:
            return None
        grid, stride = np.zeros((q, max(self.parents, default=0) + 1), dtype=int), 1
        for u, k in zip(self.parents, self.parent_cards, strict=True):
            grid[:, u] = np.arange(q) // stride % k
            stride *= k
        return self.probs[self.route(grid)]

    def features(self) -> list[list[tuple[int, int]]]:
        """A conjunction of (variable, state) for each leaf and state of the variable."""
        return [[*[(self.parents[p], s) for p, s in path], (self.var, k)] for path, _ in self.paths() for k in range(self.probs.shape[1])]


def pool(leaves: list[np.ndarray], alpha: float) -> list[list[int]]:
    """Groups of leaves: the pair whose pooling raises the Dirichlet score most is pooled first, while any does."""
    groups, counts = [[i] for i in range(len(leaves))], list(leaves)
    while len(groups) > 1:
        own = [float(leaf_k2(c, alpha)) for c in counts]
        best = max(((float(leaf_k2(counts[i] + counts[j], alpha)) - own[i] - own[j], -i, -j) for i in range(len(groups)) for j in range(i + 1, len(groups))))
        if best[0] <= 0:
            break
        i, j = -best[1], -best[2]
        groups[i], counts[i] = groups[i] + groups[j], counts[i] + counts[j]
        del groups[j], counts[j]
    return groups


def learn_local(c: Counter, var: int, parents: tuple[int, ...], kind: str = "dt", alpha: float = 1.0, max_depth: int | None = None, max_leaves: int | None = None, by: str | None = None) -> LocalTable:
    """A tree (``dt``) grown by likelihood gain, or a graph (``dg``) grown by Dirichlet gain whose leaves are then pooled."""
    if kind not in ("dt", "dg"):
        raise ValueError("kind is dt or dg")
    by = {"bic": "mdl"}.get(by or "", by) or ("k2" if kind == "dg" else "mdl")
    if by not in ("mdl", "k2"):
        raise ValueError("split by mdl, bic or k2")
    if alpha <= 0 and (kind == "dg" or by == "k2"):
        raise ValueError("the Dirichlet score needs a positive alpha")
    k = c.cards[var]
    tree = grow(c.table((*parents, var)), alpha, c.n, by, True, max_depth, max_leaves)
    leaves = [x.counts for x in tree.leaves()]
    groups = pool(leaves, alpha) if kind == "dg" else [[i] for i in range(len(leaves))]
    probs, leaf_of = [], [0] * len(leaves)
    for g, members in enumerate(groups):
        total = np.sum([leaves[i] for i in members], axis=0) + alpha / k
        probs.append(total / total.sum() if total.sum() > 0 else np.full(k, 1 / k))
        for i in members:
            leaf_of[i] = g
    return LocalTable(var, tuple(parents), tuple(c.cards[u] for u in parents), tree, leaf_of, np.array(probs))


def local_log_probability(rows: DataFrame, tables: list[LocalTable], floor: float = 0.0) -> DataFrame:
    """``logp`` of each row by compiled routing; minus infinity where a probability is 0."""
    total = F.lit(0.0)
    for t in tables:
        probs = F.array(*[F.array(*[F.lit(float(p)) for p in row]) for row in t.probs])
        p = F.get(F.get(probs, t.route_column()), F.col(f"x{t.var}"))
        total = total + F.when(p > floor, F.log(p)).otherwise(F.lit(float("-inf")) if floor == 0 else F.log(F.lit(floor)))
    return rows.withColumn("logp", total)
