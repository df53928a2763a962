"""Experiments: evaluation of one run, comparison of learners, a guard on time, and benchmark data from definitions."""

from __future__ import annotations

import json
import signal
import threading
import time
from collections.abc import Callable, Sequence
from contextlib import contextmanager
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.cluster import cut
from tallygrid.network import Network
from tallygrid.operators import evaluation as E
from tallygrid.operators.counter import Counter
from tallygrid.operators.counting import Tally
from tallygrid.operators.drawing import layout  # noqa: F401
from tallygrid.operators.ordered import first_k
from tallygrid.operators.sampling import ancestral
from tallygrid.sources.files import write_text
from tallygrid.sources.r_network import Definition

#: The order of an evaluation vector.
VECTOR = ["f1", "time", *[f"{m}_s{i}" for i in range(3) for m in ("ll", "kl", "sp")]]


class OutOfTime(Exception):
    """A run took longer than it may."""


@contextmanager
def guard(spark: SparkSession, seconds: float):
    """Ends what runs inside after so many seconds: its Spark jobs are cancelled, and the driver's own loop is interrupted."""
    sc, group = spark.sparkContext, f"guard-{time.time_ns()}"
    sc.setJobGroup(group, "guarded", interruptOnCancel=True)
    over = threading.Event()

    def stop() -> None:
        over.set()
        sc.cancelJobGroup(group)

    timer = threading.Timer(seconds, stop)
    alarm = threading.current_thread() is threading.main_thread()

    def ring(*_) -> None:
        over.set()
        raise OutOfTime(f"more than {seconds} s")

    before = signal.signal(signal.SIGALRM, ring) if alarm else None
    timer.start()
    if alarm:
        signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    except OutOfTime:
        raise
    except Exception as e:
        if over.is_set():
            raise OutOfTime(f"more than {seconds} s") from e
        raise
    finally:
        timer.cancel()
        if alarm:
            signal.setitimer(signal.ITIMER_REAL, 0)
            signal.signal(signal.SIGALRM, before)
        sc.setLocalProperty("spark.jobGroup.id", None)


def evaluate(population: DataFrame, cards: Sequence[int], true: Sequence[tuple[int, int]], method: str, train: int, temperature: float = 1.0, share: float = 0.8, seed: int = 0, **options) -> dict[str, float]:
    """The evaluation vector of one run over ``id, x0 ..., f, split``.

    A share of the training split, chosen by hash, is weighted by its objective and learnt from. Each split then gives
    mean log-likelihood, divergence of the weights' law from the model's, and rank correlation of objective and model.
    """
    return evaluate_each(population, cards, true, [method], train, temperature, share, seed, **options)[method]


def evaluate_each(population: DataFrame, cards: Sequence[int], true: Sequence[tuple[int, int]], methods: Sequence[str], train: int, temperature: float = 1.0, share: float = 0.8, seed: int = 0, **options) -> dict[str, dict[str, float]]:
    """The vectors of several methods, which learn from the same rows and share every pass over the population.

    The share is found by counting hashes in buckets, so that only the bucket on its edge is ordered; ``time`` of each
    method has the common count. Measures are sums over configurations of a split, and only counts by value are ordered.
    """
    names = [f"x{v}" for v in range(len(cards))]
    f = F.col("f").cast("double")
    known = reduce(Column.__and__, [F.col(c).isNotNull() for c in names])
    rows = population.filter(F.col("split").isin(sorted({0, 1, 2, train})))
    bucket = F.shiftright(F.xxhash64("id", F.lit(seed)), 48)
    at = F.when(F.col("split") == train, bucket).alias("at")
    ends = [F.min(F.when(known, f)).alias("lo"), F.max(F.when(known, f)).alias("hi")]
    # a row for each other split and each of 2^16 buckets
    parts = [r.asDict() for r in rows.groupBy("split", at).agg(F.count("*").alias("n"), *ends).collect()]

    began = time.perf_counter()
    pool = sorted((p for p in parts if p["split"] == train), key=lambda p: p["at"])
    k = int(share * sum(p["n"] for p in pool))
    below, whole = 0, []
    for p in pool:
        if below + p["n"] > k:
            break
        below += p["n"]
        whole.append(p)
    edge = pool[len(whole)]["at"] if len(whole) < len(pool) else 1 << 15
    drawn = rows.filter(F.col("split") == train)
    on_edge = cut(drawn.filter(bucket == edge).withColumn("_h", F.xxhash64("id", F.lit(seed))))
    rest = cut(first_k(on_edge, [F.asc("_h"), F.asc("id")], k - below).select(*names, "f"))
    lo, hi = _ends([*whole, rest.agg(F.min(f).alias("lo"), F.max(f).alias("hi")).first().asDict()])
    used = drawn.filter(bucket < edge).select(*names, "f").unionByName(rest)
    tally = Tally.of(used, names, cards, F.exp(_scaled(f, F.lit(lo), F.lit(hi), temperature)))
    tally = Tally(cut(tally.df), tally.cards)
    counted = time.perf_counter() - began
    nets, truth, out = [], {tuple(sorted(e)) for e in true}, {}
    for m in methods:
        began = time.perf_counter()
        nets.append(Network.fit(tally, m, n=k, **options))
        took = counted + time.perf_counter() - began
        learnt = {tuple(sorted(e)) for e in nets[-1].edges()}
        hit = len(learnt & truth)
        out[m] = {"f1": 1.0 if not learnt and not truth else 2 * hit / (len(learnt) + len(truth)), "time": took}

    limits = {s: _ends([p for p in parts if p["split"] == s]) for s in range(3)}
    low, high = (F.coalesce(*[F.when(F.col("split") == s, F.lit(v[i])) for s, v in limits.items()]) for i in (0, 1))
    z = _scaled(f, low, high, temperature)
    rows = rows.filter(F.col("split").isin(0, 1, 2))
    cells = rows.groupBy("split", *names).agg(F.count("*").alias("n"), F.count(f).alias("nf"), F.sum(F.exp(z)).alias("e"), F.sum(F.exp(z) * z).alias("ez"))
    cells = cut(cells).filter(known)
    for i, net in enumerate(nets):
        cells = net.log_probability(Tally(cells, tuple(cards))).withColumnRenamed("logp", f"logp{i}")
    for r in E.cell_measures(cells, len(nets)).collect():
        for i, m in enumerate(methods):
            out[m] |= {f"ll_s{r['split']}": r[f"ll{i}"], f"kl_s{r['split']}": r[f"kl{i}"]}
    for (s, i), rho in E.cell_correlations(rows.filter(f.isNotNull()).select(*names, "split", f.alias("f")), cells, "f", names, len(nets)).items():
        out[methods[i]][f"sp_s{s}"] = rho
    return {m: {c: np.nan if out[m].get(c) is None else out[m][c] for c in VECTOR} for m in methods}


def _ends(parts: Sequence[dict]) -> tuple[float | None, float | None]:
    """The least and the largest value of parts, as Spark orders them: NaN above all."""
    order = lambda v: (v != v, v)
    return min((p["lo"] for p in parts if p["lo"] is not None), key=order, default=None), max((p["hi"] for p in parts if p["hi"] is not None), key=order, default=None)


def _scaled(value: Column, lo: Column, hi: Column, temperature: float) -> Column:
    """The exponent of a Boltzmann weight; a factor that all weights share, as their sum, makes no difference to a fit."""
    lo, hi = lo.cast("double"), hi.cast("double")
    return (value - lo) / (hi - lo + 1e-12) / temperature


def compare_learners(spark: SparkSession, problems: dict[str, tuple[Counter, np.ndarray]], methods: Sequence[str], seconds: float = 300.0, **options) -> DataFrame:
    """``bn_name, method``, rates, distance and ``time_s`` of each method on each network; null where a method ended or failed, with the reason in ``failure``."""
    rows, learnt, true = [], [], []
    for name, (counter, truth) in problems.items():
        true += [(name, m, int(u), int(v)) for m in methods for u, v in zip(*np.nonzero(truth), strict=True)]
        for m in methods:
            began = time.perf_counter()
            try:
                with guard(spark, seconds):
                    net = Network(counter.cards).learn_structure(counter, m, **options)
            except (OutOfTime, ValueError) as e:
                rows.append((name, m, None, f"{type(e).__name__}: {e}"))
                continue
            rows.append((name, m, time.perf_counter() - began, None))
            learnt += [(name, m, u, v) for u, v in net.edges()]
    schema = "bn_name string, method string, src int, dst int"
    done = spark.createDataFrame(rows, "bn_name string, method string, time_s double, failure string")
    metrics = E.edge_metrics(spark.createDataFrame(learnt, schema), spark.createDataFrame(true, schema), ["bn_name", "method"])
    kept = metrics.join(done.filter("time_s IS NOT NULL"), ["bn_name", "method"])
    return kept.unionByName(done.filter("time_s IS NULL"), allowMissingColumns=True)


def survivors(run: Callable[[str, str, float], float | None], problems: Sequence[str], methods: Sequence[str], temperatures: Sequence[float], base: str = "k2", most: float = 15.0) -> tuple[list[tuple[str, str, float]], list[str]]:
    """A sweep in three phases: time the base method, run all at temperature 1, then the other temperatures with what is fast enough.

    ``run`` gives seconds or None. A method is kept if its median ratio to the base is at most ``most``.
    """
    done = [(p, base, 1.0) for p in problems]
    first = {p: run(p, base, 1.0) for p in problems}
    kept = [base]
    for m in [m for m in methods if m != base]:
        ratios = []
        for p in problems:
            t = run(p, m, 1.0)
            done.append((p, m, 1.0))
            ratios.append(t / first[p] if t is not None and first[p] else np.inf)
        if np.median(ratios) <= most:
            kept.append(m)
    for m in kept:
        for t in temperatures:
            if t != 1.0:
                for p in problems:
                    run(p, m, t)
                    done.append((p, m, t))
    return done, kept


def write_benchmark(spark: SparkSession, d: Definition, folder: str, n: int = 2000, seed: int = 42) -> DataFrame:
    """Rows drawn from a definition, as a headerless table, and its metadata beside it; gives the rows.

    The folder may be on any file system that Spark can write to.
    """
    rows = ancestral(spark, d.tables, n, seed)
    rows.drop("id").write.mode("overwrite").csv(f"{folder}/{d.name}_data_N{n}.csv")
    a = d.adjacency
    meta = {"name": d.name, "n_vars": d.tables.n, "n_edges": int(a.sum()), "n_samples": n, "description": f"drawn with seed {seed}", "var_names": d.variables, "cardinality": list(d.tables.cards), "adjacency": a.tolist(), "var_states": dict(zip(d.variables, d.states, strict=True))}
    write_text(spark, f"{folder}/{d.name}_meta.json", json.dumps(meta))
    return rows


def split_by_cells(cards: Sequence[int], most: int) -> list[list[int]]:
    """Variables in order, in groups whose joint table has at most so many cells; a larger one stands alone."""
    out: list[list[int]] = []
    size = most + 1
    for v, k in enumerate(cards):
        if size * k > most:
            out.append([])
            size = 1
        out[-1].append(v)
        size *= k
    return out


def table_summary(tables: Sequence[np.ndarray]) -> list[tuple[int, int, float, float]]:
    """(variable, state, mean, standard deviation) over parent configurations."""
    return [(v, s, float(np.atleast_2d(t)[:, s].mean()), float(np.atleast_2d(t)[:, s].std())) for v, t in enumerate(tables) for s in range(np.atleast_2d(t).shape[1])]
