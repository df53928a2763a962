"""Learners by sparse regression on compressed counts: group lasso, elastic net, logistic tables, continuous acyclicity."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tallygrid.cluster import cut
from tallygrid.functions.special import expm
from tallygrid.operators import graphs as G
from tallygrid.operators.counter import Counter
from tallygrid.operators.counting import Tally
from tallygrid.operators.search import Problem


def indicator_spans(cards: Sequence[int]) -> list[np.ndarray]:
    """Columns of each variable's indicators of states above 0."""
    ends = np.cumsum([0, *[k - 1 for k in cards]])
    return [np.arange(ends[i], ends[i + 1]) for i in range(len(cards))]


def gram(c: Counter) -> np.ndarray:
    """Weighted sums of products of the centred indicators, from pair tables: one batch."""
    n, spans = c.n_vars, indicator_spans(c.cards)
    c.prefetch([(i, j) for i in range(n) for j in range(i + 1, n)] + [(i,) for i in range(n)])
    size = int(sum(k - 1 for k in c.cards))
    out, mean = np.zeros((size, size)), np.zeros(size)
    for i in range(n):
        single = c.table((i,))
        mean[spans[i]] = single[1:] / max(c.n, 1e-300)
        out[np.ix_(spans[i], spans[i])] = np.diag(single[1:])
        for j in range(i + 1, n):
            out[np.ix_(spans[i], spans[j])] = c.table((i, j))[1:, 1:]
            out[np.ix_(spans[j], spans[i])] = out[np.ix_(spans[i], spans[j])].T
    return out - c.n * np.outer(mean, mean)


def group_lasso(g: np.ndarray, z: np.ndarray, groups: list[np.ndarray], penalty: float, rounds: int = 200, tolerance: float = 1e-6) -> np.ndarray:
    """Coefficients of ``1/2 |y - X b|^2 + penalty * sum of group norms`` from X'X and X'y; one column for each response.

    A group's own problem is solved on the eigenvectors of its block, its norm by bisection.
    """
    b = np.zeros_like(z)
    blocks = [np.linalg.eigh(g[np.ix_(s, s)]) for s in groups]
    for _ in range(rounds):
        change = 0.0
        for s, (values, vectors) in zip(groups, blocks, strict=True):
            rest = z[s] - g[s] @ b + g[np.ix_(s, s)] @ b[s]
            new = np.zeros_like(rest)
            if np.linalg.norm(rest) > penalty:
                turned = vectors.T @ rest
                low, high = 0.0, np.linalg.norm(rest) / max(values.min(), 1e-9)
                for _ in range(60):  # the norm t solves |(values + penalty / t)^-1 turned| = t
                    t = (low + high) / 2
                    longer = np.linalg.norm(turned / (values[:, None] + penalty / max(t, 1e-300))) > t
                    low, high = (t, high) if longer else (low, t)
                new = vectors @ (turned / (values[:, None] + penalty / max(high, 1e-300)))
            change = max(change, float(np.abs(new - b[s]).max(initial=0.0)))
            b[s] = new
        if change < tolerance:
            break
    return b


def order_lasso(p: Problem, penalty: float = 0.05, tolerance: float = 1e-3) -> np.ndarray:
    """Each variable regressed on those before it by group lasso; of the groups that stay the strongest are its parents."""
    spans, g = indicator_spans(p.cards), gram(p.counter)
    a = np.zeros((p.n_vars, p.n_vars), dtype=int)
    order = p.order()
    for i, v in enumerate(order):
        before = [u for u in order[:i] if p.joinable(u, v)]
        if not before:
            continue
        columns = np.concatenate([spans[u] for u in before])
        ends = np.cumsum([0, *[len(spans[u]) for u in before]])
        groups = [np.arange(ends[j], ends[j + 1]) for j in range(len(before))]
        b = group_lasso(g[np.ix_(columns, columns)], g[np.ix_(columns, spans[v])], groups, penalty * p.counter.n)
        norms = sorted(((float(np.linalg.norm(b[s])), -u) for s, u in zip(groups, before, strict=True)), reverse=True)
        for norm, u in norms[: p.cap(v)]:
            if norm > tolerance:
                a[-u, v] = 1
    return a


def over_configurations(c: Counter, part, size: int) -> np.ndarray:
    """The sum of ``part(states, weights)``, a vector of ``size`` numbers, over all configurations.

    In memory if they are held there, else in one pass of Spark, summed within each task and by place between tasks; so
    what a fit needs of the data is an aggregate for each step, whatever the number of configurations.
    """
    if c.local:
        return part(c.x, c.w)
    names, scale = [f"x{i}" for i in range(c.n_vars)], c.scale

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size)
        for batch in batches:
            x = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(len(names))])
            out += part(x, batch.column(len(names)).to_numpy(zero_copy_only=False) * scale)
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_pydict({"i": pa.array(at, pa.int64()), "v": pa.array(out[at], pa.float64())})

    got = c.tally.df.select(*names, F.col("w").cast("double")).mapInArrow(run, "i bigint, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros(size)
    out[got["i"].to_numpy(dtype=np.int64)] = got["v"]
    return out


def indicators(x: np.ndarray, cards: Sequence[int], first: int) -> np.ndarray:
    """Columns that are 1 where a variable has the state, for states from ``first`` on."""
    return np.hstack([(x[:, [v]] == np.arange(first, k)).astype(float) for v, k in enumerate(cards)])


def softmax_fit(x: np.ndarray, y: np.ndarray, w: np.ndarray, classes: int, l1: float, l2: float, rounds: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial logistic regression with elastic penalty by accelerated proximal steps; the intercept is free."""
    design = np.hstack([np.ones((len(x), 1)), x])
    total = w.sum()
    hot = np.eye(classes)[y]
    step = 1 / (0.5 * np.linalg.norm(design * np.sqrt(w / total)[:, None], 2) ** 2 + l2)
    b = point = np.zeros((design.shape[1], classes))
    momentum = 1.0
    for _ in range(rounds):
        logits = design @ point
        q = np.exp(logits - logits.max(axis=1, keepdims=True))
        q /= q.sum(axis=1, keepdims=True)
        gradient = design.T @ ((q - hot) * w[:, None]) / total
        gradient[1:] += l2 * point[1:]
        new = point - step * gradient
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * l1, 0)
        following = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        point = new + (momentum - 1) / following * (new - b)
        if np.abs(new - b).max() < 1e-7:
            b = new
            break
        b, momentum = new, following
    return b[0], b[1:]


def elastic_mask(c: Counter, ratio: float = 0.5, strength: float = 0.5, rounds: int = 300) -> np.ndarray:
    """Pairs in which one enters the other's elastic-net regression on all variables.

    The multinomial fits of all variables take their accelerated proximal steps together, so a step is one aggregate.
    """
    n, cards, spans = c.n_vars, c.cards, indicator_spans(c.cards)
    ends = np.cumsum([0, *cards])
    rows, columns = 1 + int(sum(k - 1 for k in cards)), int(ends[-1])
    blocks = [slice(int(ends[v]), int(ends[v + 1])) for v in range(n)]
    # sums of products of the design's columns give the length of each variable's steps
    g = gram(c) + c.n * np.outer(*[np.concatenate([c.table((v,))[1:] for v in range(n)]) / c.n] * 2)
    means = np.concatenate([c.table((v,))[1:] for v in range(n)])
    whole = np.block([[np.array([[c.n]]), means[None]], [means[:, None], g]]) / c.n
    total = c.n
    scale = 1 / (strength * total)
    l1, l2 = ratio * scale, (1 - ratio) * scale
    open_ = np.ones((rows, columns), dtype=bool)
    step = np.empty(n)
    for v in range(n):
        open_[1 + spans[v], blocks[v]] = False
        keep = np.setdiff1d(np.arange(rows), 1 + spans[v])
        step[v] = 1 / (0.5 * np.linalg.eigvalsh(whole[np.ix_(keep, keep)])[-1] + l2)
    active = [v for v in range(n) if (c.table((v,)) > 0).sum() > 1]
    b, point, momentum = np.zeros((rows, columns)), np.zeros((rows, columns)), 1.0
    for _ in range(rounds):
        if not active:
            break
        at = point.copy()

        def part(x: np.ndarray, w: np.ndarray, at=at) -> np.ndarray:
            design = np.hstack([np.ones((len(x), 1)), indicators(x, cards, 1)])
            resid = design @ at
            for v in range(n):
                q = np.exp(resid[:, blocks[v]] - resid[:, blocks[v]].max(axis=1, keepdims=True))
                resid[:, blocks[v]] = q / q.sum(axis=1, keepdims=True)
            return (design.T @ ((resid - indicators(x, cards, 0)) * w[:, None])).ravel()

        gradient = over_configurations(c, part, rows * columns).reshape(rows, columns) / total
        gradient[1:] += l2 * point[1:]
        following, still = (1 + (1 + 4 * momentum**2) ** 0.5) / 2, []
        for v in active:
            on = blocks[v]
            new = point[:, on] - step[v] * gradient[:, on]
            new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step[v] * l1, 0)
            new *= open_[:, on]
            point[:, on] = new + (momentum - 1) / following * (new - b[:, on])
            if np.abs(new - b[:, on]).max() >= 1e-7:
                still.append(v)
            b[:, on] = new
        active, momentum = still, following
    out = np.zeros((n, n), dtype=int)
    for v in range(n):
        size = np.abs(b[1:, blocks[v]]).sum(axis=1)
        for u in range(n):
            if u != v and size[spans[u]].sum() > 1e-8:
                out[u, v] = out[v, u] = 1
    return out


def logistic_table(c: Counter, var: int, parents: Sequence[int], strength: float = 1.0, alpha: float = 1.0, xor: bool = True) -> np.ndarray:
    """P(var | parents) from an L1 logistic model of the parents' indicators and, for binary pairs, their exclusive or.

    States that never occur only get their share of alpha; a root or a constant variable is counted instead.
    """
    counts = c.family(var, parents)
    k, q = c.cards[var], counts.shape[0]
    seen = np.flatnonzero(counts.sum(axis=0) > 0)
    if not parents or len(seen) < 2:
        total = counts.sum(axis=1, keepdims=True) + alpha
        return np.where(total > 0, (counts + alpha / k) / np.where(total > 0, total, 1), 1 / k)
    codes = np.arange(q)
    states, stride = [], 1
    for u in parents:
        states.append(codes // stride % c.cards[u])
        stride *= c.cards[u]
    columns = [(s[:, None] == np.arange(1, c.cards[u])).astype(float) for s, u in zip(states, parents, strict=True)]
    if xor:
        binary = [s for s, u in zip(states, parents, strict=True) if c.cards[u] == 2]
        columns += [(a ^ b)[:, None].astype(float) for i, a in enumerate(binary) for b in binary[i + 1 :]]
    design = np.hstack(columns)
    at, y = np.nonzero(counts[:, seen])
    w = counts[:, seen][at, y]
    b0, b = softmax_fit(design[at], y, w, len(seen), 1 / (strength * w.sum()), 0.0)
    logits = b0 + design @ b
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    out = np.zeros((q, k))
    out[:, seen] = p / p.sum(axis=1, keepdims=True)
    out += alpha / k
    return out / out.sum(axis=1, keepdims=True)


def minimise(value, start: np.ndarray, rounds: int = 200, memory: int = 10, tolerance: float = 1e-6) -> np.ndarray:
    """Limited-memory quasi-Newton steps, kept at or above 0; ``value`` returns the function and its gradient."""
    x = start.copy()
    f, g = value(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        free = (x > 0) | (g < 0)
        d = np.where(free, g, 0.0)
        if np.abs(d).max(initial=0.0) < tolerance:
            break
        held = []
        for s, y in reversed(steps):
            r = 1 / (y @ s)
            a = r * (s @ d)
            d = d - a * y
            held.append((a, r, s, y))
        if steps:
            s, y = steps[-1]
            d *= s @ y / (y @ y)
        for a, r, s, y in reversed(held):
            d = d + s * (a - r * (y @ d))
        d = np.where(free, -d, 0.0)
        if d @ g >= 0:
            d, steps = np.where(free, -g, 0.0), []
        t = 1.0
        while t > 1e-12:
            new = np.maximum(x + t * d, 0)
            fn, gn = value(new)
            if fn <= f + 1e-4 * (g @ (new - x)):
                break
            t /= 2
        else:
            break
        s, y = new - x, gn - g
        if s @ y > 1e-12:
            steps = [*steps, (s, y)][-memory:]
        done = abs(f - fn) < 1e-10 * max(1, abs(f))
        x, f, g = new, fn, gn
        if done:
            break
    return x


def notears(p: Problem, sparsity: float = 0.01, threshold: float = 0.3, rounds: int = 20) -> np.ndarray:
    """Logistic weights for binary variables under a smooth acyclicity constraint, by augmented Lagrangian.

    Weak weights are cut, then parents beyond the cap, then the weakest edge until no cycle is left.
    """
    if any(k != 2 for k in p.cards):
        raise ValueError("all variables must be binary")
    c, n = p.counter, p.n_vars
    open_ = np.array([[p.joinable(u, v) for v in range(n)] for u in range(n)])
    mean = np.array([c.table((v,))[1] for v in range(n)]) / c.n

    def unpack(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (z[: n * n] - z[n * n : 2 * n * n]).reshape(n, n), z[2 * n * n : 2 * n * n + n] - z[2 * n * n + n :]

    @np.errstate(over="ignore", invalid="ignore")  # steps that are too long are taken back
    def objective(z: np.ndarray, rho: float, alpha: float) -> tuple[float, np.ndarray]:
        weights, bias = unpack(z)
        weights = weights * open_

        def part(x: np.ndarray, w: np.ndarray) -> np.ndarray:
            with np.errstate(over="ignore", invalid="ignore"):
                x = x.astype(float)
                logits = x @ weights + bias
                loss = (w[:, None] * (np.logaddexp(0, logits) - x * logits)).sum()
                resid = w[:, None] * (1 / (1 + np.exp(-logits)) - x)
                return np.concatenate([[loss], (x.T @ resid).ravel(), resid.sum(axis=0)])

        sums = over_configurations(c, part, 1 + n * n + n) / c.n
        loss, slopes, level = float(sums[0]), sums[1 : 1 + n * n].reshape(n, n), sums[1 + n * n :]
        e = expm(weights * weights)
        h = float(np.trace(e)) - n
        slope = (slopes + (rho * h + alpha) * e.T * 2 * weights) * open_
        flat = slope.ravel()
        value = loss + 0.5 * rho * h * h + alpha * h + sparsity * float(z[: 2 * n * n].sum())
        return value, np.concatenate([flat + sparsity, -flat + sparsity, level, -level])

    z = np.zeros(2 * n * n + 2 * n)
    start = np.log(np.clip(mean, 1e-6, 1 - 1e-6) / (1 - np.clip(mean, 1e-6, 1 - 1e-6)))
    z[2 * n * n : 2 * n * n + n], z[2 * n * n + n :] = np.maximum(start, 0), np.maximum(-start, 0)
    rho, alpha, last = 1.0, 0.0, np.inf
    for _ in range(rounds):
        z = minimise(lambda y, rho=rho, alpha=alpha: objective(y, rho, alpha), z)
        weights = unpack(z)[0] * open_
        h = float(np.trace(expm(weights * weights))) - n
        alpha += rho * h
        if h > 0.25 * last:
            rho = min(rho * 10, 1e12)
        last = h
        if h < 1e-8 or rho >= 1e12:
            break
    size = np.abs(unpack(z)[0] * open_)
    size[size < threshold] = 0
    for v in range(n):
        size[np.argsort(-size[:, v], kind="stable")[p.cap(v) :], v] = 0
    while not G.is_dag((size > 0).astype(int)):
        size[size == size[size > 0].min()] = 0
    return (size > 0).astype(int)


Target = np.ndarray | str | None


def _values(c: Counter, target: np.ndarray | str) -> np.ndarray | None:
    """The target of each configuration that is held in memory: an array, or a column of the tally."""
    if not c.local:
        if not isinstance(target, str):
            raise ValueError("name the column of the tally that holds the target: the configurations aren't in memory")
        return None
    return np.asarray(c.more[target] if isinstance(target, str) else target, dtype=float)


def _varies(c: Counter, target: Target) -> bool:
    if target is None:
        return False
    values = _values(c, target)
    if values is not None:
        return bool(np.ptp(values) > 0)
    low, high = c.tally.df.agg(F.min(target), F.max(target)).first()
    return low is not None and low < high


def _moments(c: Counter, target: np.ndarray | str) -> tuple[np.ndarray, np.ndarray]:
    """Weighted sums of products of (1, indicators of states above 0, target), and of (1, states, target)."""
    n, cards = c.n_vars, c.cards
    y = _values(c, target)
    first, second = 2 + sum(k - 1 for k in cards), 2 + n

    def part(x: np.ndarray, w: np.ndarray, y: np.ndarray) -> np.ndarray:
        made = []
        for middle in (indicators(x, cards, 1), x):
            z = np.hstack([np.ones((len(x), 1)), middle, y[:, None]])
            made.append((z.T @ (z * w[:, None])).ravel())
        return np.concatenate(made)

    size = first * first + second * second
    sums = part(c.x, c.w, y) if y is not None else over_configurations(_with(c, target), lambda x, w: part(x[:, :n].astype(np.int64), w, x[:, n]), size)
    return sums[: first * first].reshape(first, first), sums[first * first :].reshape(second, second)


class _with:
    """A counter's configurations with one more column, as numbers."""

    def __init__(self, c: Counter, column: str) -> None:
        self.c, self.column = c, column
        self.local, self.scale, self.n_vars = False, c.scale, c.n_vars + 1
        names = [F.col(f"x{i}").cast("double").alias(f"x{i}") for i in range(c.n_vars)]
        self.tally = Tally(c.tally.df.select(*names, F.col(f"`{column}`").cast("double").alias(f"x{c.n_vars}"), "w"), (*c.cards, 2))


def _bins(c: Counter, target: np.ndarray | str, bins: int = 10) -> list[np.ndarray]:
    """For each variable its weight by state and by bin of the target; bins hold equal weights, equal values share one."""
    if c.local:
        y = _values(c, target)
        values, place = np.unique(y, return_inverse=True)
        up = np.cumsum(np.bincount(place, c.w)) / c.w.sum()
        bin_ = np.minimum((up * bins - 1e-9).astype(int), bins - 1)[place]
        return [np.bincount(c.x[:, v] * bins + bin_, c.w, minlength=k * bins).reshape(k, bins) for v, k in enumerate(c.cards)]
    from tallygrid.operators.ordered import running

    y = F.col(f"`{target}`").cast("double")
    counts = running(c.tally.df.groupBy(y.alias("y")).agg(F.sum("w").alias("w")).withColumn("_all", F.lit(0)), ["_all"], "y", "w", "up")
    total = c.n / c.scale
    placed = cut(counts.select("y", F.least(F.floor(F.col("up") / total * bins - 1e-9), F.lit(bins - 1)).cast("int").alias("bin")))
    rows = c.tally.df.withColumn("y", y).join(placed, "y")
    cells = rows.select(F.explode(F.array(*[F.struct(F.lit(v).alias("v"), F.col(f"x{v}").alias("s")) for v in range(c.n_vars)])).alias("r"), "bin", "w").groupBy("r.v", "r.s", "bin").agg(F.sum("w").alias("w")).collect()
    out = [np.zeros((k, bins)) for k in c.cards]
    for r in cells:
        out[r["v"]][r["s"], r["bin"]] = r["w"] * c.scale
    return out


def target_importance(c: Counter, measure: str, target: np.ndarray | str) -> np.ndarray:
    """How much each variable tells of a value per configuration: ``corr`` |r|, ``f`` the F of a line, ``mi`` binned information.

    The value is binned by weighted quantiles for ``mi``, in place of a nearest-neighbour estimate. ``target`` is an array
    over the configurations in memory, or a column of the tally, which may then be of any size.
    """
    out = np.zeros(c.n_vars)
    if measure == "mi":
        for v, t2 in enumerate(_bins(c, target)):
            t2 = t2 / t2.sum()
            e, on = t2.sum(axis=1, keepdims=True) * t2.sum(axis=0, keepdims=True), t2 > 0
            out[v] = (t2[on] * np.log(t2[on] / e[on])).sum()
        return out
    _, m = _moments(c, target)
    cov = m / m[0, 0] - np.outer(m[0], m[0]) / m[0, 0] ** 2
    for v in range(c.n_vars):
        r = cov[1 + v, -1] / max((cov[1 + v, 1 + v] * cov[-1, -1]) ** 0.5, 1e-300)
        out[v] = abs(r) if measure == "corr" else r * r / max(1 - r * r, 1e-12) * (c.n - 2)
    return out


def importance_order(c: Counter, target: Target, measure: str = "mi", seed: int | None = 0) -> list[int]:
    """Most important first, ties at random; without a varying target a random order."""
    rng = np.random.default_rng(seed)
    if not _varies(c, target):
        return [int(v) for v in rng.permutation(c.n_vars)]
    value = target_importance(c, measure, target)
    jitter = rng.random(c.n_vars)
    return sorted(range(c.n_vars), key=lambda v: (-value[v], jitter[v]))


def redundancy_order(c: Counter, target: Target, seed: int | None = 0) -> list[int]:
    """Relevance less mean redundancy with what is already chosen, the largest next."""
    from tallygrid.operators.search import information

    if not _varies(c, target):
        return importance_order(c, None, seed=seed)
    relevance, mi = target_importance(c, "mi", target), information(c)
    chosen: list[int] = []
    while len(chosen) < c.n_vars:
        left = [v for v in range(c.n_vars) if v not in chosen]
        chosen.append(max(left, key=lambda v: (relevance[v] - (mi[v, chosen].mean() if chosen else 0.0), -v)))
    return chosen


def elimination_ranking(c: Counter, target: Target, seed: int | None = 0) -> list[int]:
    """Backward elimination: the variable that a linear model of indicators misses least goes first, so the last one leads.

    All fits are solved from one aggregate, the sums of products of indicators and target.
    """
    if not _varies(c, target):
        return importance_order(c, None, seed=seed)
    m, _ = _moments(c, target)
    m = m / m[0, 0]
    m[:, -1] -= m[0, -1] * m[:, 0]  # the target about its mean
    m[-1] -= m[-1, 0] * m[0]
    spans = indicator_spans(c.cards)
    left, gone = list(range(c.n_vars)), []

    def loss(vs: list[int]) -> float:
        on = np.concatenate([[0], *[1 + spans[v] for v in vs]]).astype(int)
        fit, *_ = np.linalg.lstsq(m[np.ix_(on, on)], m[on, -1], rcond=1e-10)
        return float(m[-1, -1] - fit @ m[on, -1])

    while len(left) > 1:
        out = min(left, key=lambda v: (round(loss([u for u in left if u != v]) / max(m[-1, -1], 1e-300), 12), -v))
        left.remove(out)
        gone.append(out)
    return [*left, *reversed(gone)]
