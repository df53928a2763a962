"""Contingency tables for driver loops, asked for in batches.

Searches walk over graphs of a few hundred variables on the driver; what they need from the data are counts. If the
configurations of a tally are few, which is checked, they are fetched once and counted in memory. Otherwise each batch
of requests is one Spark job whose result is the tables asked for. Both ways give the same numbers.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from math import prod

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tallygrid.cluster import cut
from tallygrid.operators.counting import Tally

Path = tuple[tuple[int, int], ...]
Request = tuple[tuple[int, ...], Path]


class Counter:
    """``n`` is the number of rows; weights are rescaled to sum to it.

    Other columns of the tally can be asked for by name. ``held`` are configurations that were fetched before.
    """

    def __init__(self, tally: Tally, n: float | None = None, limit: int = 200_000, most_cells: int = 1 << 22, batch: int = 128, held: pd.DataFrame | None = None) -> None:
        self.tally, self.cards, self.most_cells, self.batch = tally, tally.cards, most_cells, batch
        self.jobs, self._known = 0, {}
        names = [f"x{i}" for i in range(tally.n_vars)]
        held = tally.df.limit(limit + 1).toPandas() if held is None else held
        self.local = len(held) <= limit
        if self.local:
            self.x, self.w = held[names].to_numpy(dtype=np.int64), held["w"].to_numpy(dtype=float)
            self.more = {c: held[c].to_numpy() for c in held.columns if c not in (*names, "w")}
            self.columns = np.ascontiguousarray(self.x.T)
            total = float(self.w.sum())
        else:
            self.tally = Tally(cut(tally.df), tally.cards)  # every batch reads it
            total = float(self.tally.df.agg(F.sum("w")).first()[0])
        self.n = float(total if n is None else n)
        self.scale = self.n / total if total > 0 else 1.0
        if self.local:
            self.w = self.w * self.scale

    @property
    def n_vars(self) -> int:
        return len(self.cards)

    def cells(self, variables: Iterable[int]) -> int:
        return prod(self.cards[v] for v in variables)

    @staticmethod
    def _key(variables: Sequence[int], path: Iterable[tuple[int, int]]) -> Request:
        return tuple(sorted(variables)), tuple(sorted(path))

    def prefetch(self, requests: Iterable[Sequence[int] | Request]) -> None:
        """Counts what isn't known yet; in memory there is nothing to do ahead."""
        if self.local:
            return
        asked = [(self._key(*r) if r and isinstance(r[0], (tuple, list)) else self._key(r, ())) for r in requests]
        new = [k for k in dict.fromkeys(asked) if k not in self._known]
        for at in range(0, len(new), self.batch):
            part = new[at : at + self.batch]
            made = []
            for i, (variables, path) in enumerate(part):
                one = F.struct(F.lit(i).alias("i"), self.tally.code(variables).alias("c"))
                for v, value in path:
                    one = F.when(F.col(f"x{v}") == value, one)
                made.append(one)
            counted = self.tally.df.select(F.explode(F.array_compact(F.array(*made))).alias("r"), "w").groupBy("r.i", "r.c").agg(F.sum("w").alias("n")).toPandas()
            self.jobs += 1
            for i, (variables, path) in enumerate(part):
                own = counted[counted["i"] == i]
                flat = np.zeros(self.cells(variables))
                flat[own["c"].to_numpy(dtype=np.int64)] = own["n"].to_numpy(dtype=float) * self.scale
                self._known[variables, path] = flat.reshape([self.cards[v] for v in reversed(variables)]).T

    def table(self, variables: Sequence[int], path: Iterable[tuple[int, int]] = ()) -> np.ndarray:
        """Weighted counts with one axis for each variable, in the order asked for."""
        key = self._key(variables, path)
        if key not in self._known:
            if self.cells(key[0]) > self.most_cells:
                raise ValueError(f"a table over {key[0]} has too many cells")
            if not self.local:
                self.prefetch([key])
            else:
                rows = slice(None)
                if key[1]:
                    rows = np.all([self.x[:, v] == value for v, value in key[1]], axis=0)
                code, stride = np.zeros(len(self.w[rows]), dtype=np.int64), 1
                for v in key[0]:
                    code, stride = code + self.x[rows, v] * stride, stride * self.cards[v]
                self._known[key] = np.bincount(code, self.w[rows], minlength=stride).reshape([self.cards[v] for v in reversed(key[0])]).T
        found = self._known[key]
        return np.transpose(found, [key[0].index(v) for v in variables]) if variables else found

    def pairs(self) -> None:
        """All pair tables at once: in memory blocks of the product of the states' indicator columns."""
        asked = [(i, j) for i in range(self.n_vars) for j in range(i + 1, self.n_vars)]
        if not self.local:
            return self.prefetch(asked)
        if all(((i, j), ()) in self._known for i, j in asked):
            return None
        ends = np.cumsum([0, *self.cards])
        hot = np.zeros((len(self.w), int(ends[-1])))
        for v, column in enumerate(self.columns):
            hot[np.arange(len(column)), ends[v] + column] = 1.0
        product = hot.T @ (hot * self.w[:, None])
        for i, j in asked:
            self._known.setdefault(((i, j), ()), product[ends[i] : ends[i + 1], ends[j] : ends[j + 1]])
        return None

    def extensions(self, var: int, parents: tuple[int, ...], more: Sequence[int]) -> list[np.ndarray]:
        """The family's counts with each of ``more`` added to the sorted ``parents``, as ``family`` gives them; from memory, in one pass."""
        k = self.cards[var]
        below = np.searchsorted(parents, more)
        # the code of the parents before and after the place of a new one
        low, stride = [np.zeros(len(self.w), dtype=np.int64)], [1]
        for p in parents:
            low.append(low[-1] + self.columns[p] * stride[-1])
            stride.append(stride[-1] * self.cards[p])
        whole, sizes = low[-1], np.array([stride[-1] * self.cards[u] for u in more], dtype=np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes * k)])
        code = np.empty((len(more), len(self.w)), dtype=np.int64)
        own = self.columns[var]
        for r, (u, at) in enumerate(zip(more, below, strict=True)):
            s, before = stride[at], low[at]
            row = before + self.columns[u] * s + (whole - before) * self.cards[u]
            code[r] = (row * k + own) + starts[r]
        flat = np.bincount(code.ravel(), np.broadcast_to(self.w, code.shape).ravel(), minlength=int(starts[-1]))
        return [flat[a:b].reshape(-1, k) for a, b in zip(starts[:-1], starts[1:], strict=True)]

    def family(self, var: int, parents: Sequence[int]) -> np.ndarray:
        """Counts with a row for each parent configuration, the first parent fastest."""
        return self.table((*parents, var)).reshape((self.cells(parents), self.cards[var]), order="F")
