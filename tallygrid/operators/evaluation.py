"""Measures of structures and of results, as DataFrames."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallygrid.functions.special import chi2_sf
from tallygrid.cluster import cut
from tallygrid.operators.ordered import running

#: Upper 5 percent points of the studentized range, over root 2, for 2 to 20 groups.
NEMENYI = (1.960, 2.343, 2.569, 2.728, 2.850, 2.949, 3.031, 3.102, 3.164, 3.219, 3.268, 3.313, 3.354, 3.391, 3.426, 3.458, 3.489, 3.517, 3.544)


def _rates(tp: Column, fp: Column, fn: Column, prefix: str) -> list[Column]:
    """Precision is 1 where nothing was learnt and recall where nothing is true."""
    precision = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(1.0)
    recall = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(1.0)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return [precision.alias(f"{prefix}_precision"), recall.alias(f"{prefix}_recall"), f1.alias(f"{prefix}_f1")]


def edge_metrics(learnt: DataFrame, true: DataFrame, by: list[str]) -> DataFrame:
    """Directed and skeleton rates and the structural distance: false and missing edges, a reversed one counted once.

    Both tables have the columns ``by``, ``src`` and ``dst``; graphs without edges in both have no row.
    """
    keys = [*by, "src", "dst"]
    sides = learnt.select(*keys).distinct().withColumn("l", F.lit(1)).join(true.select(*keys).distinct().withColumn("t", F.lit(1)), keys, "full").fillna(0, ["l", "t"])
    pair = sides.withColumn("a", F.least("src", "dst")).withColumn("b", F.greatest("src", "dst"))
    one = lambda c: F.sum(c.cast("int"))
    tp, fp, fn = F.col("l") * F.col("t"), F.col("l") * (1 - F.col("t")), F.col("t") * (1 - F.col("l"))
    per = pair.groupBy(*by, "a", "b").agg(one(tp).alias("tp"), one(fp).alias("fp"), one(fn).alias("fn"), F.max("l").alias("sl"), F.max("t").alias("st"))
    reversed_ = F.least("fp", "fn")
    s = per.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")], F.sum(reversed_).alias("rev"), F.sum(F.col("sl") * F.col("st")).alias("stp"), F.sum(F.col("sl") * (1 - F.col("st"))).alias("sfp"), F.sum(F.col("st") * (1 - F.col("sl"))).alias("sfn"))
    return s.select(*by, *_rates(F.col("tp"), F.col("fp"), F.col("fn"), "directed"), *_rates(F.col("stp"), F.col("sfp"), F.col("sfn"), "skeleton"), (F.col("fp") + F.col("fn") - F.col("rev")).alias("shd"))


def boltzmann(df: DataFrame, value: str, temperature: float, by: list[str]) -> DataFrame:
    """``weight``: exp of the scaled value over the temperature, scaled to sum to 1 within ``by``."""
    if not by:
        df, by = df.withColumn("_all", F.lit(1)), ["_all"]
    limits = df.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    scaled = df.join(limits, by).withColumn("_e", F.exp((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-12) / temperature))
    total = scaled.groupBy(*by).agg(F.sum("_e").alias("_t"))
    return scaled.join(total, by).withColumn("weight", F.col("_e") / F.col("_t")).drop("_lo", "_hi", "_e", "_t", "_all")


def average_ranks(df: DataFrame, value: str, by: list[str], descending: bool = True) -> DataFrame:
    """``rank`` within ``by``; equal values share the mean of their places."""
    order = F.col(value).desc() if descending else F.col(value).asc()
    tied = F.count("*").over(Window.partitionBy(*by, value))
    return df.withColumn("rank", F.rank().over(Window.partitionBy(*by).orderBy(order)) + (tied - 1) / 2)


def spearman(df: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """``rho`` of each group, null if a side is constant. Ranks come from counts by value, so ties are combined first."""

    sides = F.explode(F.array(*[F.struct(F.lit(i).alias("side"), F.col(c).cast("double").alias("v")) for i, c in enumerate((a, b))]))
    counts = df.select(*by, sides.alias("_s")).groupBy(*by, F.col("_s.side").alias("_side"), F.col("_s.v").alias("_v")).agg(F.count("*").alias("n"))
    # both sides are ranked in one pass
    placed = cut(running(counts, [*by, "_side"], "_v", "n", "up").select(*by, "_side", "_v", (F.col("up") - (F.col("n") - 1) / 2).alias("_r")))
    joined = df.select(*by, F.col(a).cast("double").alias("_a"), F.col(b).cast("double").alias("_b"))
    for i, side in enumerate("ab"):
        ranks = placed.filter(F.col("_side") == i).select(*by, F.col("_v").alias(f"_{side}"), F.col("_r").alias(f"_r{side}"))
        joined = joined.join(ranks, [*by, f"_{side}"])
    spread = F.stddev_pop("_ra") * F.stddev_pop("_rb")
    return joined.groupBy(*by).agg(F.when(spread > 0, F.covar_pop("_ra", "_rb") / spread).alias("rho"))


def kl_divergence(df: DataFrame, p: str, q: str, by: list[str]) -> DataFrame:
    """``kl`` of p against q, both scaled to sum to 1 within ``by``; q not below 1e-300."""
    s = df.groupBy(*by).agg(F.sum(p).alias("sp"), F.sum(q).alias("sq"), F.sum(F.when(F.col(p) > 0, F.col(p) * F.log(F.col(p) / F.greatest(F.col(q), F.lit(1e-300))))).alias("e"))
    return s.select(*by, (F.coalesce("e", F.lit(0.0)) / F.col("sp") - F.log(F.col("sp")) + F.log("sq")).alias("kl"))


def cell_measures(cells: DataFrame, models: int) -> DataFrame:
    """``split, ll0, kl0, ...``: mean log-likelihood, and divergence of the weights' law from each model's.

    ``cells`` are configurations of a split: rows ``n``, sums ``e`` of the weights and ``ez`` of weights times their logs, and ``logp0`` ...
    """
    total = cells.groupBy("split").agg(F.sum("e").alias("_t"))
    each, out = F.col("e") / F.col("_t"), []
    for i in range(models):
        logp = F.col(f"logp{i}")
        q = F.exp(logp)
        apart = F.sum((F.col("ez") - F.col("e") * F.log("_t")) / F.col("_t") - each * F.log(F.greatest(q, F.lit(1e-300))))
        out += [(F.sum(F.col("n") * logp) / F.sum(F.when(logp.isNotNull(), F.col("n")))).alias(f"ll{i}"), (F.coalesce(apart, F.lit(0.0)) / F.sum(each) - F.log(F.sum(each)) + F.log(F.sum(F.col("n") * q))).alias(f"kl{i}")]
    return cells.join(total, "split").groupBy("split").agg(*out)


#: Configurations that are broadcast to the rows; with more, Spark joins as it sees fit.
MOST_CELLS = 20_000


def cell_correlations(rows: DataFrame, cells: DataFrame, value: str, names: list[str], models: int) -> dict[tuple[int, int], float | None]:
    """Rank correlation of a value that is never null and ``logp`` of each model, by split and model; None if a side is constant.

    A model's ranks are those of its configurations, so the rows are combined by value, with the sums of their model
    ranks, before anything is ordered. Pieces of that order give sums over ranks within the piece; what lies before is added here.
    """
    sides = F.explode(F.array(*[F.struct(F.lit(i).alias("side"), F.col(f"logp{i}").alias("v")) for i in range(models)]))
    counts = cells.select("split", "n", sides.alias("_s")).groupBy("split", F.col("_s.side").alias("_side"), F.col("_s.v").alias("_v")).agg(F.sum("n").alias("n"))
    whole = counts.groupBy("split", "_side").agg(F.sum("n").alias("_all"))
    # ranks less their mean, which keeps the sums small
    placed = cut(running(counts, ["split", "_side"], "_v", "n", "up").join(whole, ["split", "_side"]).select("split", "_side", "_v", (F.col("up") - (F.col("n") - 1) / 2 - (F.col("_all") + 1) / 2).alias("_r")))
    for i in range(models):
        cells = cells.join(placed.filter(F.col("_side") == i).select("split", F.col("_v").alias(f"logp{i}"), F.col("_r").alias(f"_r{i}")), ["split", f"logp{i}"], "left")
    cells = cut(cells.select("split", *names, "nf", *[f"_r{i}" for i in range(models)]))
    own = {r["split"]: r for r in cells.groupBy("split").agg(*[F.sum(F.col("nf") * F.pow(f"_r{i}", F.lit(p))).alias(f"m{i}_{p}") for i in range(models) for p in (1, 2)]).collect()}

    ranked = cells.drop("nf").withColumn("_one", F.lit(1))
    if cells.limit(MOST_CELLS + 1).count() <= MOST_CELLS:
        ranked = F.broadcast(ranked)
    # rows without a state have no partner and count as none; an inner join would test all states for null at the scan
    byvalue = rows.join(ranked, ["split", *names], "left").groupBy("split", value).agg(F.count("_one").alias("n"), *[F.sum(f"_r{i}").alias(f"t{i}") for i in range(models)])
    byvalue = byvalue.select(F.col("split").cast("long").alias("split"), F.col(value).alias("v"), F.col("n").cast("double").alias("n"), *[F.coalesce(f"t{i}", F.lit(0.0)).alias(f"t{i}") for i in range(models)])
    kept = ["n", "r", "rr", *[f"{c}{i}" for i in range(models) for c in ("t", "rt")]]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            split = batch.column("split").to_numpy()
            for s in np.unique(split):
                part = split == s
                take = lambda c, part=part: batch.column(c).to_numpy()[part]  # noqa: B023, E731
                n = take("n")
                first, so_far = found.setdefault(int(s), [float(take("v")[0]), np.zeros(len(kept))])
                r = so_far[0] + np.cumsum(n) - (n - 1) / 2
                ts = [take(f"t{i}") for i in range(models)]
                so_far += [n.sum(), n @ r, n @ (r * r), *[x for t in ts for x in (t.sum(), r @ t)]]
        yield pa.RecordBatch.from_pydict({"split": pa.array([*found], pa.int64()), "first": pa.array([x[0] for x in found.values()], pa.float64()), **{c: pa.array([x[1][j] for x in found.values()], pa.float64()) for j, c in enumerate(kept)}})

    ordered = byvalue.repartitionByRange("split", "v").sortWithinPartitions("split", "v")
    pieces = [r.asDict() for r in ordered.mapInArrow(sums, "split long, first double, " + ", ".join(f"{c} double" for c in kept)).collect()]
    out: dict[tuple[int, int], float | None] = {}
    for s in {p["split"] for p in pieces}:
        here = sorted((p for p in pieces if p["split"] == s), key=lambda p: (math.isnan(p["first"]), p["first"]))
        n = sum(p["n"] for p in here)
        a1, a2, ab, before = 0.0, 0.0, [0.0] * models, -(n + 1) / 2
        for p in here:
            a1 += p["r"] + before * p["n"]
            a2 += p["rr"] + 2 * before * p["r"] + before * before * p["n"]
            ab = [x + p[f"rt{i}"] + before * p[f"t{i}"] for i, x in enumerate(ab)]
            before += p["n"]
        for i in range(models):
            b1, b2 = (own[s][f"m{i}_{p}"] for p in (1, 2)) if s in own else (None, None)
            if not n or b1 is None:
                out[s, i] = None
                continue
            spread = max(a2 / n - (a1 / n) ** 2, 0.0) * max(b2 / n - (b1 / n) ** 2, 0.0)
            out[s, i] = (ab[i] / n - a1 / n * b1 / n) / math.sqrt(spread) if spread > 0 else None
    return out


def friedman(mean_ranks: list[float], n: int) -> tuple[float, float]:
    """Statistic and p-value from mean ranks of k methods over n problems."""
    k = len(mean_ranks)
    if k < 2 or n < 1:
        return math.nan, math.nan
    s = 12 * n / (k * (k + 1)) * sum((r - (k + 1) / 2) ** 2 for r in mean_ranks)
    return s, chi2_sf(s, k - 1)


def nemenyi(k: int, n: int) -> float:
    """Critical difference of mean ranks at 5 percent, for 2 to 20 methods."""
    if not 2 <= k <= 20:
        raise ValueError("2 to 20 methods")
    return NEMENYI[k - 2] * math.sqrt(k * (k + 1) / (6 * n))


def latex_table(rows: list[dict], columns: list[str], best: str | None = None, digits: int = 3) -> str:
    """Rows with rules above and below, the largest value of a column in bold."""
    top = max((r[best] for r in rows if r.get(best) is not None), default=None) if best else None

    def cell(r: dict, c: str) -> str:
        v = r.get(c)
        text = "--" if v is None or v != v else f"{v:.{digits}f}" if isinstance(v, float) else str(v).replace("_", r"\_")
        return rf"\textbf{{{text}}}" if c == best and v == top and v is not None else text

    body = [" & ".join(cell(r, c) for c in columns) + r" \\" for r in rows]
    head = " & ".join(c.replace("_", r"\_") for c in columns) + r" \\"
    return "\n".join([rf"\begin{{tabular}}{{{'l' * len(columns)}}}", r"\toprule", head, r"\midrule", *body, r"\bottomrule", r"\end{tabular}"])
