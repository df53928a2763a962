"""The statistical core as DataFrame operations: configuration counts, and folds over them.

A ``Tally`` is the base relation: one row for each configuration of the variables with its weight. All statistics are
sums over it. Many families or pairs are counted in one pass: each row is expanded to one code per request, combined
before the shuffle, and folded per group. Cells that never occur are not materialised in scores; their part is known.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations
from math import log, prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallygrid.functions.special import lgamma


@dataclass(frozen=True)
class Tally:
    """Columns ``x0`` ... and the weight ``w``; ``cards`` are the numbers of states."""

    df: DataFrame
    cards: tuple[int, ...]

    @property
    def n_vars(self) -> int:
        return len(self.cards)

    @staticmethod
    def of(df: DataFrame, columns: Sequence[str], cards: Sequence[int], weight: Column | None = None, strict: bool = True) -> "Tally":
        """Compresses rows to configurations. Rows with a null or a value that is no state are dropped or, if strict, an error."""
        cards = tuple(int(k) for k in cards)
        if len(cards) != len(columns) or any(k < 2 for k in cards):
            raise ValueError("every variable needs at least two states")
        xs = [f"CAST(`{c}` AS INT) AS x{i}" for i, c in enumerate(columns)]
        rows = df.select(*map(F.expr, xs), (F.lit(1.0) if weight is None else weight.cast("double")).alias("w"))
        if strict:
            checked = [f"CASE WHEN x{i} BETWEEN 0 AND {k - 1} THEN x{i} ELSE CAST(raise_error('a value of variable {i} is no state') AS INT) END AS x{i}" for i, k in enumerate(cards)]
            rows = rows.selectExpr(*checked, "w")
        else:
            rows = rows.filter(" AND ".join(f"x{i} BETWEEN 0 AND {k - 1}" for i, k in enumerate(cards)))
        return Tally(rows.groupBy(*[f"x{i}" for i in range(len(cards))]).agg(F.sum("w").alias("w")), cards)

    @staticmethod
    def infer(df: DataFrame, columns: Sequence[str], weight: Column | None = None) -> "Tally":
        """Cardinalities from the data: the largest value plus one, at least two."""
        top = df.agg(*[F.max(F.col(f"`{c}`").cast("int")).alias(f"m{i}") for i, c in enumerate(columns)]).first()
        return Tally.of(df, columns, [max((top[i] or 0) + 1, 2) for i in range(len(columns))], weight)

    def code(self, variables: Sequence[int]) -> Column:
        """Mixed-radix index of the variables, the first one fastest."""
        out, stride = F.lit(0).cast("bigint"), 1
        for v in variables:
            out = out + F.col(f"x{v}").cast("bigint") * F.lit(stride).cast("bigint")
            stride *= self.cards[v]
        # states are never null; saying so keeps the optimizer from testing the whole expression for null at the scan
        return F.coalesce(out, F.lit(-1).cast("bigint"))

    def decode(self, code: Column, variables: Sequence[int]) -> list[Column]:
        """The states in an index."""
        out, stride = [], 1
        for v in variables:
            out.append((F.floor(code / F.lit(stride)) % self.cards[v]).cast("int"))
            stride *= self.cards[v]
        return out


@dataclass(frozen=True)
class Family:
    """A variable and its parents."""

    var: int
    parents: tuple[int, ...] = ()


def family_counts(t: Tally, families: Sequence[Family]) -> DataFrame:
    """``fam, pcfg, state, n`` of all families, in one pass."""
    requests = [F.struct(F.lit(i).alias("fam"), t.code(f.parents).alias("pcfg"), F.col(f"x{f.var}").alias("state")) for i, f in enumerate(families)]
    return t.df.select(F.explode(F.array(*requests)).alias("r"), "w").groupBy("r.fam", "r.pcfg", "r.state").agg(F.sum("w").alias("n"))


def _sizes(t: Tally, families: Sequence[Family], of: str) -> Column:
    """k or q of the family in column ``fam``."""
    values = [t.cards[f.var] if of == "k" else prod(t.cards[p] for p in f.parents) for f in families]
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.col("fam") + 1)


def log_likelihood(t: Tally, families: Sequence[Family], alpha: float = 0.0, empty: bool = True) -> DataFrame:
    """``fam, score``: sum of c ln(c / total) with c = n + alpha in every cell.

    With ``alpha`` the parent configurations that never occur count too, unless ``empty`` is false.
    """
    k, q = _sizes(t, families, "k"), _sizes(t, families, "q")
    cell = (F.col("n") + alpha) * F.log(F.col("n") + F.lit(alpha))
    per = family_counts(t, families).filter("n > 0").groupBy("fam", "pcfg").agg(F.sum(cell).alias("s"), F.sum("n").alias("total"), F.count("*").alias("seen"))
    total = F.col("total") + k * alpha
    unseen = (k - F.col("seen")) * (alpha * log(alpha) if alpha > 0 else 0.0)
    per = per.withColumn("ll", F.col("s") + unseen - total * F.log(total))
    rest = (q - F.col("c")) * k * F.lit(-alpha) * F.log(k) if alpha > 0 and empty else F.lit(0.0)
    return per.groupBy("fam").agg(F.sum("ll").alias("ll"), F.count("*").alias("c")).select("fam", (F.col("ll") + rest).alias("score"))


def _penalised(scores: DataFrame, t: Tally, families: Sequence[Family], factor: float) -> DataFrame:
    return scores.withColumn("score", F.col("score") - factor * _sizes(t, families, "q") * (_sizes(t, families, "k") - 1))


def bic(t: Tally, families: Sequence[Family], n: float, alpha: float = 0.0) -> DataFrame:
    """Log-likelihood less half ln(n) for each free parameter; n is the number of rows."""
    return _penalised(log_likelihood(t, families, alpha), t, families, 0.5 * log(n))


def aic(t: Tally, families: Sequence[Family], alpha: float = 0.0) -> DataFrame:
    return _penalised(log_likelihood(t, families, alpha), t, families, 1.0)


def k2(t: Tally, families: Sequence[Family], alpha: float = 1.0) -> DataFrame:
    """Dirichlet score with alpha spread over the states of a parent configuration; empty ones add nothing."""
    share = F.lit(alpha) / _sizes(t, families, "k")
    cells = family_counts(t, families).withColumn("s", lgamma(F.col("n") + share) - lgamma(share))
    per = cells.groupBy("fam", "pcfg").agg(F.sum("s").alias("s"), F.sum("n").alias("total"))
    return per.groupBy("fam").agg(F.sum(F.col("s") + lgamma(F.lit(alpha)) - lgamma(F.col("total") + alpha)).alias("score"))


def k2_penalised(t: Tally, families: Sequence[Family], n: float, penalty: str | float = "bic", alpha: float = 1.0) -> DataFrame:
    """K2 less a factor, half ln(n) for ``bic``, 1 for ``aic`` or a number, for each free parameter."""
    return _penalised(k2(t, families, alpha), t, families, penalty_factor(penalty, n))


def penalty_factor(penalty: str | float, n: float) -> float:
    if isinstance(penalty, (int, float)):
        return float(penalty)
    try:
        return {"bic": 0.5 * log(n), "aic": 1.0, "none": 0.0}[penalty]
    except KeyError:
        raise ValueError(f"unknown penalty {penalty!r}") from None


def ebna(t: Tally, families: Sequence[Family], n: float, alpha: float = 1.0, penalty: str = "bic") -> DataFrame:
    """Smoothed log-likelihood in which empty parent configurations are skipped, with the penalty named or none."""
    scores = log_likelihood(t, families, alpha, empty=False)
    return _penalised(scores, t, families, {"bic": 0.5 * log(n), "aic": 1.0}.get(penalty, 0.0))


def set_evidence(t: Tally, sets: Sequence[tuple[int, ...]], alpha: float = 1.0) -> DataFrame:
    """Dirichlet-multinomial log marginal likelihood of the joint of each set; alpha is spread over its configurations."""
    requests = [F.struct(F.lit(i).alias("fam"), t.code(s).alias("cfg")) for i, s in enumerate(sets)]
    counts = t.df.select(F.explode(F.array(*requests)).alias("r"), "w").groupBy("r.fam", "r.cfg").agg(F.sum("w").alias("n"))
    size = F.element_at(F.array(*[F.lit(float(prod(t.cards[v] for v in s))) for s in sets]), F.col("fam") + 1)
    share = F.lit(alpha) / size
    return counts.withColumn("s", lgamma(F.col("n") + share) - lgamma(share)).groupBy("fam").agg((F.sum("s") + lgamma(F.lit(alpha)) - lgamma(F.sum("n") + alpha)).alias("score"))


def singles(t: Tally) -> DataFrame:
    """``i, a, n, p``: empirical marginals."""
    cells = t.df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"x{i}").alias("a")) for i in range(t.n_vars)])).alias("r"), "w")
    return cells.groupBy("r.i", "r.a").agg(F.sum("w").alias("n")).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("i")))


def pair_table(t: Tally, pairs: Sequence[tuple[int, int]] | None = None) -> DataFrame:
    """``i, j, a, b, n, n_a, n_b, total``: joint counts of the pairs with their marginals."""
    pairs = list(combinations(range(t.n_vars), 2)) if pairs is None else pairs
    cells = t.df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"x{i}").alias("a"), F.col(f"x{j}").alias("b")) for i, j in pairs])).alias("r"), "w")
    n = cells.groupBy("r.i", "r.j", "r.a", "r.b").agg(F.sum("w").alias("n")).filter("n > 0")
    of = lambda *k: F.sum("n").over(Window.partitionBy("i", "j", *k))
    return n.select("*", of("a").alias("n_a"), of("b").alias("n_b"), of().alias("total"))


def mutual_information(t: Tally, bits: bool = False, pairs: Sequence[tuple[int, int]] | None = None) -> DataFrame:
    """``i, j, mi, total``, not below 0."""
    p = F.col("n") / F.col("total")
    term = p * F.log(F.col("n") * F.col("total") / (F.col("n_a") * F.col("n_b")))
    return pair_table(t, pairs).groupBy("i", "j").agg(F.greatest(F.sum(term) / (log(2) if bits else 1.0), F.lit(0.0)).alias("mi"), F.first("total").alias("total"))


def triple_table(t: Tally, triples: Sequence[tuple[int, int, tuple[int, ...]]]) -> DataFrame:
    """``req, z, a, b, n`` with marginals within the stratum z, the configuration of the third entry."""
    cells = t.df.select(F.explode(F.array(*[F.struct(F.lit(r).alias("req"), t.code(z).alias("z"), F.col(f"x{i}").alias("a"), F.col(f"x{j}").alias("b")) for r, (i, j, z) in enumerate(triples)])).alias("r"), "w")
    n = cells.groupBy("r.req", "r.z", "r.a", "r.b").agg(F.sum("w").alias("n")).filter("n > 0")
    of = lambda *k: F.sum("n").over(Window.partitionBy("req", *k))
    return n.select("*", of("z", "a").alias("n_a"), of("z", "b").alias("n_b"), of("z").alias("n_z"), of().alias("total"))


def conditional_information(t: Tally, triples: Sequence[tuple[int, int, tuple[int, ...]]], bits: bool = False, least: float = 0.0) -> DataFrame:
    """``req, cmi``; strata with a weight of ``least`` or less are skipped."""
    term = F.col("n") / F.col("total") * F.log(F.col("n") * F.col("n_z") / (F.col("n_a") * F.col("n_b")))
    return triple_table(t, triples).groupBy("req").agg(F.greatest(F.sum(F.when(F.col("n_z") > least, term).otherwise(0.0)) / (log(2) if bits else 1.0), F.lit(0.0)).alias("cmi"))


def chi_square(t: Tally, tests: Sequence[tuple[int, int, tuple[int, ...]]]) -> DataFrame:
    """``req, statistic, dof``. Degrees of freedom are of the full table without strata, of occupied rows and columns with them."""
    term = F.col("n") * F.col("n") * F.col("n_z") / (F.col("n_a") * F.col("n_b"))
    per = triple_table(t, tests).groupBy("req", "z").agg((F.sum(term) - F.first("n_z")).alias("s"), ((F.count_distinct("a") - 1) * (F.count_distinct("b") - 1)).alias("d"))
    summed = per.filter("d > 0").groupBy("req").agg(F.sum("s").alias("s"), F.sum("d").alias("d"))
    full = F.element_at(F.array(*[F.lit(0 if z else (t.cards[i] - 1) * (t.cards[j] - 1)) for i, j, z in tests]), F.col("req") + 1)
    base = per.select("req").distinct().join(summed, "req", "left")
    return base.select("req", F.coalesce("s", F.lit(0.0)).alias("statistic"), F.when(full > 0, full).otherwise(F.coalesce("d", F.lit(0))).cast("int").alias("dof"))


def g_test(t: Tally, n: float) -> DataFrame:
    """``i, j, g``: 2 n ln 2 times the mutual information in bits."""
    return mutual_information(t, bits=True).select("i", "j", (F.lit(2 * n * log(2)) * F.col("mi")).alias("g"))


def _grid(t: Tally, first: Sequence[int], second: Sequence[int]) -> DataFrame:
    """All combinations of two groups of variables as two indices; small by the table-size rule, checked here."""
    a, b = prod(t.cards[v] for v in first), prod(t.cards[v] for v in second)
    if a * b > 1 << 24:
        raise ValueError(f"a table of {a} x {b} cells is too large to fill")
    spark = t.df.sparkSession
    return spark.range(a * b).select((F.col("id") % a).alias("pcfg"), F.floor(F.col("id") / a).cast("bigint").alias("ncfg"))


def conditional_table(t: Tally, given: Sequence[int], new: Sequence[int], alpha: float, spread: bool = True) -> DataFrame:
    """``pcfg, ncfg, n, p``: P(new | given), every cell filled.

    ``alpha`` is spread over the cells of a row, or added to each if not ``spread``. Rows without counts are uniform.
    """
    k = prod(t.cards[v] for v in new)
    add = alpha / k if spread else alpha
    counts = t.df.groupBy(t.code(given).alias("pcfg"), t.code(new).alias("ncfg")).agg(F.sum("w").alias("n"))
    full = _grid(t, given, new).join(counts, ["pcfg", "ncfg"], "left").withColumn("n", F.coalesce("n", F.lit(0.0)))
    total = F.sum("n").over(Window.partitionBy("pcfg")) + add * k
    return full.select("pcfg", "ncfg", "n", F.when(total > 0, (F.col("n") + add) / total).otherwise(1.0 / k).alias("p"))


def cpds(t: Tally, families: Sequence[Family], alpha: float = 1.0) -> DataFrame:
    """``var, pcfg, state, p`` of all families in one pass, alpha spread over the states; unseen configurations uniform if alpha is 0."""
    sizes = [(i, f.var, prod(t.cards[p] for p in f.parents), t.cards[f.var]) for i, f in enumerate(families)]
    if sum(q * k for *_, q, k in sizes) > 1 << 24:
        raise ValueError("the tables are too large to fill")
    meta = t.df.sparkSession.createDataFrame(sizes, "fam int, var int, q bigint, k int")
    grid = meta.select("fam", "var", "k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("q") - 1)).alias("pcfg")).select("*", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("state"))
    full = grid.join(family_counts(t, families), ["fam", "pcfg", "state"], "left").withColumn("n", F.coalesce("n", F.lit(0.0)))
    total = F.sum("n").over(Window.partitionBy("fam", "pcfg")) + alpha
    return full.select("var", "pcfg", "state", F.when(total > 0, (F.col("n") + F.lit(alpha) / F.col("k")) / total).otherwise(F.lit(1.0) / F.col("k")).alias("p"))


#: Tables of up to this number of cells are written into the query, larger ones are broadcast as arrays.
MOST_WRITTEN = 20_000


def row_log_probability(rows: DataFrame, t: Tally, families: Sequence[Family], tables: DataFrame, floor: float = 1e-12) -> DataFrame:
    """Each configuration with ``logp``, the sum over variables of the log of ``tables`` (``var, pcfg, state, p``).

    One projection, without a shuffle of the rows: each variable's term is looked up in its table, by index. Tables
    are fetched, which the table-size rule bounds and is checked; cells that they don't have count as ``floor``.
    """
    sizes = {f.var: prod(t.cards[p] for p in f.parents) * t.cards[f.var] for f in families}
    if sum(sizes.values()) > 1 << 24:
        raise ValueError("the tables are too large to look up")
    got = tables.select("var", "pcfg", "state", "p").toPandas()
    logs = []
    for f in families:
        own, flat = got[got["var"] == f.var], np.full(sizes[f.var], log(floor))
        flat[own["pcfg"].to_numpy(dtype=np.int64) * t.cards[f.var] + own["state"].to_numpy(dtype=np.int64)] = np.log(np.maximum(own["p"].to_numpy(dtype=float), floor))
        logs.append(flat)
    return look_up(rows, t, families, logs)


def look_up(rows: DataFrame, t: Tally, families: Sequence[Family], logs: Sequence[np.ndarray]) -> DataFrame:
    """The rows with ``logp``, the sum of an entry of each family's flat table, states fastest."""
    at = [(t.code(f.parents) * t.cards[f.var] + F.col(f"x{f.var}")).cast("int") for f in families]
    if sum(map(len, logs)) <= MOST_WRITTEN:
        terms = [F.get(F.expr("array(" + ", ".join(f"{float(x)!r}D" for x in flat) + ")"), i) for flat, i in zip(logs, at, strict=True)]
        return rows.withColumn("logp", sum(terms[1:], terms[0]))
    sent, names = rows.sparkSession.sparkContext.broadcast([np.asarray(x, dtype=float) for x in logs]), rows.columns

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.zeros(batch.num_rows)
            for j, flat in enumerate(sent.value):
                total += flat[batch.column(f"_at{j}").to_numpy(zero_copy_only=False)]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(total)], names=[*names, "logp"])

    schema = T.StructType([*rows.schema.fields, T.StructField("logp", T.DoubleType())])
    return rows.select("*", *[i.alias(f"_at{j}") for j, i in enumerate(at)]).mapInArrow(add, schema)
