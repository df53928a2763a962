"""Graph kernels on adjacency matrices of a few hundred variables, and edge tables for graphs kept in Spark."""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Iterable, Sequence
from itertools import combinations

import numpy as np


def edges_of(adjacency: np.ndarray) -> list[tuple[int, int]]:
    return [(int(a), int(b)) for a, b in zip(*np.nonzero(adjacency), strict=True)]


def adjacency_of(n: int, edges: Iterable[tuple[int, int]]) -> np.ndarray:
    out = np.zeros((n, n), dtype=int)
    for a, b in edges:
        out[a, b] = 1
    return out


def topological(adjacency: np.ndarray) -> list[int] | None:
    """Kahn's order, first in first out from the lowest index; None if there is a cycle."""
    degree = adjacency.sum(axis=0).astype(int)
    ready, order = deque(int(v) for v in np.flatnonzero(degree == 0)), []
    while ready:
        v = ready.popleft()
        order.append(v)
        for u in np.flatnonzero(adjacency[v]):
            degree[u] -= 1
            if degree[u] == 0:
                ready.append(int(u))
    return order if len(order) == len(adjacency) else None


def is_dag(adjacency: np.ndarray) -> bool:
    return topological(adjacency) is not None


def descendants(adjacency: np.ndarray, a: int) -> set[int]:
    """What is reached from a, itself included."""
    seen, stack = {a}, [a]
    while stack:
        for u in map(int, np.flatnonzero(adjacency[stack.pop()])):
            if u not in seen:
                seen.add(u)
                stack.append(u)
    return seen


def reaches(adjacency: np.ndarray, a: int, b: int) -> bool:
    return b in descendants(adjacency, a)


def closure_of(adjacency: np.ndarray) -> np.ndarray:
    """Which variables are reached from which, themselves included; by squaring."""
    now = (adjacency + np.eye(len(adjacency), dtype=adjacency.dtype)) > 0
    while True:
        longer = now.astype(np.float32) @ now.astype(np.float32) > 0
        if (longer == now).all():
            return now
        now = longer


def closes_cycle(adjacency: np.ndarray, a: int, b: int) -> bool:
    """Whether the edge a -> b would."""
    return a == b or reaches(adjacency, b, a)


def parents(adjacency: np.ndarray, v: int) -> list[int]:
    return [int(p) for p in np.flatnonzero(adjacency[:, v])]


def markov_blanket(adjacency: np.ndarray, v: int) -> list[int]:
    """Parents, children and the children's other parents."""
    children = np.flatnonzero(adjacency[v])
    return sorted({*parents(adjacency, v), *map(int, children), *(p for c in children for p in parents(adjacency, int(c)))} - {v})


def skeleton(adjacency: np.ndarray) -> np.ndarray:
    return ((adjacency + adjacency.T) > 0).astype(int)


def moral(adjacency: np.ndarray) -> np.ndarray:
    """Undirected, with the parents of each variable joined."""
    out = skeleton(adjacency)
    for v in range(len(adjacency)):
        for a, b in combinations(parents(adjacency, v), 2):
            out[a, b] = out[b, a] = 1
    return out


class Forest:
    """Disjoint sets."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, a: int) -> int:
        while self.up[a] != a:
            self.up[a] = a = self.up[self.up[a]]
        return a

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def spanning_forest(n: int, ranked: Iterable[tuple[int, int]]) -> np.ndarray:
    """Edges in order, those that would close a cycle left out."""
    sets, out = Forest(n), np.zeros((n, n), dtype=int)
    for a, b in ranked:
        if sets.join(a, b):
            out[a, b] = out[b, a] = 1
    return out


def components(undirected: np.ndarray, nodes: Sequence[int] | None = None) -> list[list[int]]:
    nodes = list(range(len(undirected))) if nodes is None else list(nodes)
    sets = Forest(len(undirected))
    for a, b in combinations(nodes, 2):
        if undirected[a, b]:
            sets.join(a, b)
    groups: dict[int, list[int]] = {}
    for v in sorted(nodes):
        groups.setdefault(sets.root(v), []).append(v)
    return sorted(groups.values())


def strong_components(adjacency: np.ndarray) -> list[list[int]]:
    """Strongly connected components, sources first: two depth-first passes (Kosaraju)."""
    n = len(adjacency)

    def visit(matrix: np.ndarray, v: int, seen: set[int]) -> list[int]:
        out, stack = [], [(v, iter(np.flatnonzero(matrix[v])))]
        seen.add(v)
        while stack:
            at, rest = stack[-1]
            u = next((int(u) for u in rest if int(u) not in seen), None)
            if u is None:
                stack.pop()
                out.append(at)
            else:
                seen.add(u)
                stack.append((u, iter(np.flatnonzero(matrix[u]))))
        return out

    seen: set[int] = set()
    finished = [v for s in range(n) if s not in seen for v in visit(adjacency, s, seen)]
    seen, out = set(), []
    for v in reversed(finished):
        if v not in seen:
            out.append(sorted(visit(adjacency.T, v, seen)))
    return out


def elimination_order(undirected: np.ndarray, how: str = "min_fill") -> tuple[list[int], np.ndarray]:
    """An order of elimination and the triangulated graph.

    ``min_fill`` and ``min_degree`` are greedy, ties to the lowest index; ``mcs`` is the reverse of a search by the
    number of visited neighbours; ``lexm`` a minimal triangulation by lexicographic search with paths through lower labels.
    """
    graph, n = (undirected > 0).astype(int), len(undirected)
    if how == "mcs":
        weight, left, visited = np.zeros(n), set(range(n)), []
        while left:
            v = max(left, key=lambda u: (weight[u], -u))
            left.remove(v)
            visited.append(v)
            weight[np.flatnonzero(graph[v])] += 1
        order = visited[::-1]
    elif how == "lexm":
        labels: list[list[int]] = [[] for _ in range(n)]
        left, order, fill = set(range(n)), [], graph.copy()
        for step in range(n, 0, -1):
            v = max(left, key=lambda u: (labels[u], -u))
            left.remove(v)
            order.append(v)
            best: dict[int, list[int]] = {}  # the smallest largest label on a path from v
            heap = [([], int(u)) for u in np.flatnonzero(graph[v]) if int(u) in left]
            heapq.heapify(heap)
            while heap:
                through, u = heapq.heappop(heap)
                if u in best:
                    continue
                best[u] = through
                further = max(through, labels[u])
                for x in map(int, np.flatnonzero(graph[u])):
                    if x in left and x not in best:
                        heapq.heappush(heap, (further, x))
            for u in [u for u, through in best.items() if graph[v, u] or through < labels[u]]:
                fill[u, v] = fill[v, u] = 1
                labels[u] = [*labels[u], step]
        return order[::-1], fill
    elif how in ("min_fill", "min_degree"):
        work, left, order = graph.copy(), set(range(n)), []
        while left:

            def cost(v: int) -> int:
                near = [u for u in left if u != v and work[v, u]]
                return len(near) if how == "min_degree" else sum(1 for a, b in combinations(near, 2) if not work[a, b])

            v = min(left, key=lambda u: (cost(u), u))
            near = [u for u in left if u != v and work[v, u]]
            for a, b in combinations(near, 2):
                work[a, b] = work[b, a] = 1
            left.remove(v)
            order.append(v)
        return order, work
    else:
        raise ValueError(f"unknown triangulation {how!r}")
    filled, left = graph.copy(), set(range(n))
    for v in order:
        left.remove(v)
        for a, b in combinations([u for u in left if filled[v, u]], 2):
            filled[a, b] = filled[b, a] = 1
    return order, filled


def maximal_cliques(graph: np.ndarray) -> list[tuple[int, ...]]:
    """All maximal cliques (Bron and Kerbosch, with a pivot), sorted."""
    near = [set(map(int, np.flatnonzero(graph[v]))) - {v} for v in range(len(graph))]
    out: list[tuple[int, ...]] = []
    stack = [(set(), set(range(len(graph))), set())]
    while stack:
        r, p, x = stack.pop()
        if not p and not x:
            out.append(tuple(sorted(r)))
            continue
        pivot = max(p | x, key=lambda u: len(near[u] & p))
        for v in list(p - near[pivot]):
            stack.append((r | {v}, p & near[v], x & near[v]))
            p = p - {v}
            x = x | {v}
    return sorted(out)


def triangulated_cliques(order: Sequence[int], filled: np.ndarray) -> list[tuple[int, ...]]:
    """Maximal cliques of a triangulated graph from its elimination order."""
    left, found = set(order), []
    for v in order:
        left.discard(v)
        found.append({v} | {u for u in left if filled[v, u]})
    return sorted(tuple(sorted(c)) for i, c in enumerate(found) if not any(c < d or c == d and j < i for j, d in enumerate(found) if j != i))


def clique_separators(graph: np.ndarray) -> list[list[int]]:
    """Atoms: the graph is split along clique separators of a minimal triangulation until none is left."""
    order, filled = elimination_order(graph, "lexm")
    left, atoms = set(range(len(graph))), []
    place = {v: i for i, v in enumerate(order)}
    for v in order:
        if v not in left:
            continue
        later = {u for u in left if filled[v, u] and place[u] > place[v]}
        if all(graph[a, b] for a, b in combinations(sorted(later), 2)):
            inside, stack = {v}, [v]
            while stack:
                at = stack.pop()
                for u in left - later - inside:
                    if graph[at, u]:
                        inside.add(u)
                        stack.append(u)
            if len(inside | later) < len(left):
                atoms.append(sorted(inside | later))
                left -= inside
    if left:
        atoms.append(sorted(left))
    return atoms


def split_width(cliques: Sequence[tuple[int, ...]], width: int) -> list[tuple[int, ...]]:
    """Cliques cut to at most so many variables; neighbouring pieces share one, so that dependence across a cut isn't lost."""
    step = max(1, width - 1)
    cut = {c[i : i + width] for c in cliques for i in range(0, max(1, len(c) - (width > 1)), step)}
    return sorted(c for c in cut if not any(set(c) < set(d) for d in cut))


def junction_tree(cliques: Sequence[tuple[int, ...]]) -> list[tuple[int, int, tuple[int, ...]]]:
    """Edges of a spanning tree with the largest separators; unconnected parts are joined by empty ones."""
    ranked = sorted(((len(set(a) & set(b)), i, j) for (i, a), (j, b) in combinations(enumerate(cliques), 2)), key=lambda t: (-t[0], t[1], t[2]))
    tree = spanning_forest(len(cliques), [(i, j) for _, i, j in ranked])
    return [(i, j, tuple(sorted(set(cliques[i]) & set(cliques[j])))) for i, j in edges_of(np.triu(tree))]


def sampling_order(cliques: Sequence[tuple[int, ...]], tree: Sequence[tuple[int, int, tuple[int, ...]]]) -> list[tuple[int, int]]:
    """Cliques breadth first from the largest, each with its parent (-1 for a root)."""
    near: dict[int, list[int]] = {i: [] for i in range(len(cliques))}
    for a, b, _ in tree:
        near[a].append(b)
        near[b].append(a)
    seen: set[int] = set()
    out = []
    for start in sorted(range(len(cliques)), key=lambda i: (-len(cliques[i]), i)):
        queue = deque([(start, -1)] if start not in seen else [])
        while queue:
            v, up = queue.popleft()
            if v in seen:
                continue
            seen.add(v)
            out.append((v, up))
            queue += [(u, v) for u in sorted(near[v]) if u not in seen]
    return out


def capped_cliques(graph: np.ndarray, most: int) -> list[tuple[int, ...]]:
    """Large maximal cliques first, cut to a size, until every variable is covered."""
    covered: set[int] = set()
    out = []
    for c in sorted(maximal_cliques(graph), key=lambda c: (-len(c), c)):
        cut = c[:most]
        if not set(cut) <= covered:
            out.append(cut)
            covered |= set(cut)
    return out + [(v,) for v in range(len(graph)) if v not in covered]


def clique_graph(cliques: Sequence[tuple[int, ...]]) -> np.ndarray:
    """Sizes of overlaps."""
    n = len(cliques)
    return np.array([[len(set(cliques[i]) & set(cliques[j])) if i != j else 0 for j in range(n)] for i in range(n)], dtype=int).reshape(n, n)


def neighbourhoods(cliques: Sequence[tuple[int, ...]], n: int) -> list[list[int]]:
    return [sorted({u for c in cliques if v in c for u in c} - {v}) for v in range(n)]


def neighbour_cliques(near: Sequence[Sequence[int]]) -> list[tuple[int, ...]]:
    """Each variable with its neighbours, once."""
    return sorted({tuple(sorted({v, *ns})) for v, ns in enumerate(near)})


def ordered_structure(cliques: Sequence[tuple[int, ...]]) -> list[tuple[tuple[int, ...], tuple[int, ...]]]:
    """(overlap, new) of each clique, in an order in which the overlap is already there; cliques without new variables are left out."""
    done: set[int] = set()
    out = []
    left = list(range(len(cliques)))
    while left:
        i = max(left, key=lambda i: (len(set(cliques[i]) & done), len(cliques[i]), -i))
        left.remove(i)
        overlap = tuple(v for v in cliques[i] if v in done)
        new = tuple(v for v in cliques[i] if v not in done)
        if new:
            out.append((overlap, new))
            done |= set(new)
    return out


def clique_order(cliques: Sequence[tuple[int, ...]]) -> list[int]:
    """An order for sampling: a clique waits for every one that it overlaps without lying inside it.

    Cliques that wait for nothing more come first in, first out; if some wait for each other, the order is that of the list.
    """
    sets = [set(c) for c in cliques]
    waits = {i: {j for j, b in enumerate(sets) if j != i and a & b and not a <= b} for i, a in enumerate(sets)}
    ready, out = deque(i for i, w in waits.items() if not w), []
    while ready:
        done = ready.popleft()
        out.append(done)
        for i, w in waits.items():
            if done in w:
                w.discard(done)
                if not w:
                    ready.append(i)
    return out if len(out) == len(sets) else list(range(len(sets)))


def structure_rows(cliques: Sequence[tuple[int, ...]], order: Sequence[int] | None = None) -> list[tuple[tuple[int, ...], tuple[int, ...]]]:
    """(overlap, new) of every clique in the order given, or in that of the list; what is new may be nothing."""
    seen: set[int] = set()
    out = []
    for i in range(len(cliques)) if order is None else order:
        c = sorted(set(cliques[i]))
        out.append((tuple(v for v in c if v in seen), tuple(v for v in c if v not in seen)))
        seen |= set(c)
    return out


def structure_matrix(parts: Sequence[tuple[tuple[int, ...], tuple[int, ...]]]) -> np.ndarray:
    """Rows ``n_overlap, n_new, overlap..., new...``, filled up with 0 to twice the largest clique."""
    width = 2 + 2 * max((len(o) + len(n) for o, n in parts), default=0)
    out = np.zeros((len(parts), width), dtype=int)
    for r, (o, n) in enumerate(parts):
        row = [len(o), len(n), *o, *n]
        out[r, : len(row)] = row
    return out


def meek(undirected: np.ndarray, directed: np.ndarray) -> np.ndarray:
    """Orientations that follow from others (rules 1 to 3 of Meek, 1995)."""
    d, n = directed.copy(), len(undirected)
    while True:
        before = d.sum()
        for u in range(n):
            for v in range(n):
                if not undirected[u, v] or d[u, v] or d[v, u]:
                    continue
                into_u, into_v = np.flatnonzero(d[:, u]), np.flatnonzero(d[:, v])
                first = any(not undirected[b, v] for b in into_u)
                second = bool(np.any(d[u] & d[:, v]))
                beside = [c for c in into_v if undirected[u, c]]
                third = any(not undirected[a, b] for a, b in combinations(beside, 2))
                if first or second or third:
                    d[u, v] = 1
        if d.sum() == before:
            return d
