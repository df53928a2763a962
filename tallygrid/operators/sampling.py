"""Drawing rows from networks: one derived column per variable, no shuffle, the same rows for the same seed."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallygrid.functions.special import norm_cdf
from tallygrid.operators import graphs as G
from tallygrid.operators.factors import Circuit, Tables
from tallygrid.operators.local_structure import LocalTable


def uniform(seed: int, v: int) -> str:
    """A uniform number in [0, 1) of row ``id`` and variable, as SQL: 53 bits of a hash."""
    return f"shiftrightunsigned(xxhash64(id, {int(v)}, {int(seed)}), 11) / {float(1 << 53)!r}D"


def clean(table: np.ndarray) -> np.ndarray:
    """Rows that sum to 1: negative entries to 0, rows without mass uniform."""
    t = np.clip(np.atleast_2d(np.asarray(table, dtype=float)), 0, None)
    total = t.sum(axis=1, keepdims=True)
    return np.where(total > 0, t / np.where(total > 0, total, 1), 1 / t.shape[1])


def draw(u: str, row: str, table: np.ndarray) -> str:
    """The state whose cumulated probability passes u, as SQL: text needs one call to the JVM, columns one for each number."""
    cuts = np.cumsum(clean(table), axis=1)[:, :-1]
    rows = "array(" + ", ".join("array(" + ", ".join(f"{float(c)!r}D" for c in r) + ")" for r in cuts) + ")"
    return f"size(filter(get({rows}, CAST({row} AS INT)), c -> c <= {u}))"


def _index(cards: tuple[int, ...], parents: tuple[int, ...]) -> str:
    terms, stride = ["0"], 1
    for p in parents:
        terms.append(f"x{p} * {stride}")
        stride *= cards[p]
    return " + ".join(terms)


def ancestral(spark: SparkSession, t: Tables, n: int, seed: int = 0, local: dict[int, LocalTable] | None = None, rows: DataFrame | None = None, u: Callable[[int], str] | None = None) -> DataFrame:
    """``id`` and ``x0`` ...: parents before children. Variables with local structure are routed to their leaf."""
    order = G.topological(t.adjacency())
    if order is None:
        raise ValueError("the graph has a cycle")
    out = spark.range(n) if rows is None else rows
    level: dict[int, int] = {}
    for v in order:
        level[v] = 1 + max((level[p] for p in t.parents[v]), default=-1)
    for depth in range(max(level.values(), default=-1) + 1):  # variables of one level are one projection
        made = []
        for v in [v for v in order if level[v] == depth]:
            if local and v in local:
                row, table = local[v].route_sql(), local[v].probs
            else:
                row, table = _index(t.cards, t.parents[v]), t.probs[v]
            made.append(f"{draw(u(v) if u else uniform(seed, v), row, table)} AS x{v}")
        out = out.selectExpr("*", *made)
    return out.select("id", *[f"x{v}" for v in range(t.n)])


def conditioned(spark: SparkSession, c: Circuit, n: int, given=None, seed: int = 0) -> DataFrame:
    """Rows from the junction tree given evidence: clique by clique, the new variables given the overlap."""
    if c.p_evidence(given) <= 0:
        raise ValueError("the evidence is impossible")
    out, cards = spark.range(n), c.tables.cards
    for overlap, new, table in c.clique_conditionals(given):
        out = out.withColumn("_new", F.expr(draw(uniform(seed, new[0]), _index(cards, overlap), table)))
        stride = 1
        for v in new:
            out = out.withColumn(f"x{v}", (F.floor(F.col("_new") / stride) % cards[v]).cast("int"))
            stride *= cards[v]
        out = out.drop("_new")
    return out.select("id", *[f"x{v}" for v in range(c.tables.n)])


def fit_copula(x: np.ndarray, rounds: int = 100, warm: int = 30, seed: int = 0) -> dict:
    """A Gaussian copula by extended-rank Gibbs sampling: latent values keep the order of each column, correlations are drawn.

    Takes a bounded sample of rows (``x``); gives ``corr``, the mean of the correlation draws, and ``sorted`` columns.
    """
    rng = np.random.default_rng(seed)
    n, d = x.shape
    ranks = np.argsort(np.argsort(x, axis=0, kind="stable"), axis=0, kind="stable")
    from tallygrid.functions.special import norm_ppf

    z = norm_ppf((ranks + 1) / (n + 1))
    corr, total, kept = np.corrcoef(z, rowvar=False).reshape(d, d), np.zeros((d, d)), 0
    codes = [np.unique(x[:, j], return_inverse=True)[1] for j in range(d)]
    for r in range(rounds):
        for j in range(d):
            others = [i for i in range(d) if i != j]
            beta = np.linalg.solve(corr[np.ix_(others, others)] + 1e-9 * np.eye(d - 1), corr[others, j]) if others else np.zeros(0)
            mean = z[:, others] @ beta
            sd = max(float(corr[j, j] - corr[j, others] @ beta), 1e-6) ** 0.5
            for code in range(codes[j].max() + 1):
                on = codes[j] == code
                low = z[codes[j] == code - 1, j].max(initial=-np.inf) if code else -np.inf
                high = z[codes[j] == code + 1, j].min(initial=np.inf)
                a, b = norm_cdf((low - mean[on]) / sd), norm_cdf((high - mean[on]) / sd)
                u = np.clip(a + (b - a) * rng.random(on.sum()), 1e-10, 1 - 1e-10)
                z[on, j] = mean[on] + sd * norm_ppf(u)
        # a draw from the inverse Wishart law: the inverse of a Wishart matrix made of normals
        scale = np.linalg.inv(np.eye(d) * (d + 2) + z.T @ z)
        g = rng.multivariate_normal(np.zeros(d), scale, size=n + d + 2)
        cov = np.linalg.inv(g.T @ g)
        s = np.sqrt(np.diag(cov))
        corr = cov / np.outer(s, s)
        if r >= warm:
            total, kept = total + corr, kept + 1
    return {"corr": total / max(kept, 1), "sorted": np.sort(x, axis=0)}


@F.pandas_udf(T.DoubleType())  # a type, not its name: this module is imported before there is a session
def _normal_score(p):
    import pandas as pd

    from tallygrid.functions.special import norm_ppf

    return pd.Series(norm_ppf(p.to_numpy()))


def fit_copula_frame(df: DataFrame, columns: list[str]) -> dict:
    """A Gaussian copula of all rows: correlations of normal scores, equal values sharing their mean rank.

    Ranks come from counts by value over range partitions. The model is the correlations, the number of ``rows``, and
    for each column a DataFrame ``ranks`` of all its values ``v``, their counts ``n`` and ranks up to them, ``up``. Rows
    with a null or NaN are left out, since they have no place in the joint law.
    """
    from tallygrid.cluster import cut
    from tallygrid.operators.ordered import running

    for c in columns:
        df = df.filter(F.col(f"`{c}`").isNotNull() & ~F.isnan(F.col(f"`{c}`").cast("double")))
    rows = df.select(*[F.col(f"`{c}`").cast("double").alias(f"v{j}") for j, c in enumerate(columns)])
    n = rows.count()
    if n == 0:
        raise ValueError("no whole rows to fit")
    # counts by column and value, ranked in one pass for all columns
    cells = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.col(f"v{j}").alias("v")) for j in range(len(columns))])).alias("c")
    counts = rows.select(cells).groupBy("c.j", "c.v").agg(F.count("*").alias("n"))
    placed = cut(running(counts, ["j"], "v", "n", "up"))
    tables = [placed.filter(F.col("j") == j).select("v", "n", "up") for j in range(len(columns))]
    for j, t in enumerate(tables):
        rows = rows.join(t.select(F.col("v").alias(f"v{j}"), _normal_score((F.col("up") - (F.col("n") - 1) / 2) / (n + 1)).alias(f"z{j}")), f"v{j}")
    d = len(columns)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = rows.agg(*[F.avg(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"s{i}_{j}") for i, j in pairs], *[F.avg(f"z{i}").alias(f"m{i}") for i in range(d)]).first()
    cov = np.zeros((d, d))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = sums[f"s{i}_{j}"] - sums[f"m{i}"] * sums[f"m{j}"]
    s = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    corr = cov / np.outer(s, s)
    np.fill_diagonal(corr, 1.0)
    return {"corr": corr, "rows": n, "ranks": tables}


def _by_rank(df: DataFrame, share: str, ranks: DataFrame, rows: int, out: str) -> DataFrame:
    """``df`` with ``out``: the value at ``share`` of all ``rows`` values in order.

    Ranks are cut into spans, at most about a million or of 64, so that the join has an equality to shuffle by.
    """
    span = max(64, rows >> 20)
    low = F.col("up") - F.col("n")
    spans = ranks.select(F.col("v").alias(out), low.alias("_low"), F.col("up").alias("_up"), F.explode(F.sequence(F.floor(low / span), F.floor((F.col("up") - 1) / span))).alias("_span"))
    placed = df.withColumn("_at", F.least(F.floor(F.col(share) * rows), F.lit(rows - 1))).withColumn("_of", F.floor(F.col("_at") / span))
    return placed.join(spans, (F.col("_of") == F.col("_span")) & (F.col("_at") >= F.col("_low")) & (F.col("_at") < F.col("_up"))).drop("_at", "_of", "_low", "_up", "_span")


def sample_copula(spark: SparkSession, model: dict, n: int, seed: int = 0) -> DataFrame:
    """``id, x0`` ...: normals made dependent by the Cholesky factor, then the empirical quantile of each column."""
    root = np.linalg.cholesky(model["corr"] + 1e-9 * np.eye(len(model["corr"])))
    d = len(root)
    out = spark.range(n)
    for j in range(d):
        u1, u2 = F.expr(uniform(seed, 2 * j)), F.expr(uniform(seed, 2 * j + 1))
        out = out.withColumn(f"_z{j}", F.sqrt(-2 * F.log(1 - u1)) * F.cos(u2 * float(2 * np.pi)))

    @F.pandas_udf("double")
    def cdf(v):
        import pandas as pd

        return pd.Series(norm_cdf(v.to_numpy()))

    for j in range(d):
        latent = sum((F.lit(float(root[j, i])) * F.col(f"_z{i}") for i in range(j + 1)), F.lit(0.0))
        out = out.withColumn(f"_u{j}", cdf(latent))
    for j in range(d):
        if "ranks" in model:
            out = _by_rank(out, f"_u{j}", model["ranks"][j], model["rows"], f"x{j}")
            continue
        values, counts = np.unique(model["sorted"][:, j], return_counts=True)
        shares = np.cumsum(counts) / counts.sum()
        cuts = F.array(*[F.lit(float(c)) for c in shares[:-1]]) if len(values) > 1 else F.array().cast("array<double>")
        out = out.withColumn(f"x{j}", F.get(F.array(*[F.lit(float(v)) for v in values]), F.size(F.filter(cuts, lambda c: c <= F.col(f"_u{j}")))))
    return out.select("id", *[f"x{j}" for j in range(d)])
