"""Learners on a network of 62 variables: 2,000 rows are drawn from it, and the graph learnt is held against the true one."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tallygrid.cluster import cut
from tallygrid.network import Network
from tallygrid.operators import graphs as G
from tallygrid.operators.counter import Counter
from tallygrid.operators.counting import Tally
from tallygrid.operators.factors import Tables
from tallygrid.operators.sampling import ancestral

N_VARS, N_ROWS = 62, 2_000
METHODS = ("k2", "bic", "aic", "stable_hc", "tabu", "pc", "stable_pc", "chow_liu", "rebane_pearl", "lpa", "lpa_marginal", "causal_polytree", "gs", "dg_ndg", "dmbbn", "iterdsla", "sartre", "dt", "dg", "rcd")


def random_network(n: int = N_VARS, seed: int = 3) -> Tables:
    """Two to four states, up to two parents among the twelve variables before, skewed tables."""
    rng = np.random.default_rng(seed)
    cards = tuple(int(k) for k in rng.choice([2, 2, 2, 3, 4], n))
    parents, probs = [], []
    for v in range(n):
        near = tuple(sorted(rng.choice(range(max(0, v - 12), v), size=min(v, int(rng.integers(1, 3))), replace=False).tolist())) if v else ()
        parents.append(near)
        probs.append(rng.dirichlet([0.4] * cards[v], size=int(np.prod([cards[u] for u in near], dtype=int))))
    return Tables(cards, parents, probs)


_DRAWN: dict[tuple[str, int], tuple[Tally, pd.DataFrame]] = {}


def wide_counter(spark: SparkSession, seed: int = 1) -> tuple[Tables, Counter]:
    """The network, and counts on rows that are drawn and fetched once in a session; no table is counted beforehand."""
    t, key = random_network(), (spark.sparkContext.applicationId, seed)
    if key not in _DRAWN:
        rows = cut(Tally.of(ancestral(spark, t, N_ROWS, seed), [f"x{i}" for i in range(t.n)], t.cards).df)
        _DRAWN[key] = Tally(rows, t.cards), rows.toPandas()
    tally, held = _DRAWN[key]
    return t, Counter(tally, N_ROWS, held=held)


def _query(method: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        t, c = wide_counter(spark)
        learnt = G.skeleton(Network(t.cards).learn_structure(c, method).adjacency)
        true = G.skeleton(t.adjacency())
        hit, found, there = int((learnt & true).sum()) // 2, int(learnt.sum()) // 2, int(true.sum()) // 2
        return spark.createDataFrame([(method, found, there, hit, 2 * hit / max(found + there, 1))], "method string, found int, true int, hit int, skeleton_f1 double")

    return query


QUERIES = {f"wide_{m}": _query(m) for m in METHODS}
SQL: dict[str, str] = {}
