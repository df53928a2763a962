"""A table with planted dependence: integer arithmetic on lineitem's keys, the same in both engines.

x0 -> x1 -> x2 and x0 -> x3 with a tenth of the values flipped; x4 is independent.
"""

from __future__ import annotations

from itertools import combinations
from math import prod

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.operators.counting import Family, Tally
from tallygrid.plans.tables import table

CARDS = (2, 2, 2, 2, 3)
PRIME, HALF, TENTH = 1_000_003, 500_001, 100_000
NETWORK = [Family(0), Family(1, (0,)), Family(2, (1,)), Family(3, (0,)), Family(4)]
FAMILIES = [Family(v, p) for v in range(5) for k in range(3) for p in combinations([u for u in range(5) if u != v], k)]


def _uniform(s: int) -> str:
    a = f"((l_orderkey * 7919 + l_partkey * 104729 + l_linenumber * 31 + {s * 15485863}) % {PRIME})"
    b = f"(({a} * {a} + {s * 7}) % {PRIME})"
    return f"(({b} * {b} + 3 * {b} + {s}) % {PRIME})"


X = [f"CASE WHEN {_uniform(1)} < {HALF} THEN 0 ELSE 1 END", f"CASE WHEN {_uniform(2)} < {TENTH} THEN 1 - x0 ELSE x0 END", f"CASE WHEN {_uniform(3)} < {TENTH} THEN 1 - x1 ELSE x1 END", f"CASE WHEN {_uniform(4)} < {TENTH} THEN 1 - x0 ELSE x0 END", f"CAST({_uniform(5)} % 3 AS INT)"]
#: Rows, then configurations with their weight, then with Boltzmann weights of the price.
ROWS_SQL = f"f0 AS (SELECT *, {X[0]} AS x0 FROM lineitem), f1 AS (SELECT *, {X[1]} AS x1 FROM f0), fx AS (SELECT *, {X[2]} AS x2, {X[3]} AS x3, {X[4]} AS x4 FROM f1)"
SQL = ROWS_SQL + ", cfg AS (SELECT x0, x1, x2, x3, x4, count(*)::DOUBLE AS w FROM fx GROUP BY ALL)"
WEIGHTED_SQL = ROWS_SQL + ", lim AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, count(*) AS n FROM lineitem), bw AS (SELECT fx.*, exp((l_extendedprice - lo) / (hi - lo + 1e-12)) AS b FROM fx, lim), cfg AS (SELECT x0, x1, x2, x3, x4, sum(b) * (SELECT n FROM lim) / (SELECT sum(b) FROM bw) AS w FROM bw GROUP BY ALL)"


def rows(spark: SparkSession, d: str) -> DataFrame:
    """The same by steps that the optimizer keeps apart, since each is used more than once."""
    raw = table(spark, d, "lineitem")
    kept = raw.columns
    key = F.col("l_orderkey") * 7919 + F.col("l_partkey") * 104729 + F.col("l_linenumber") * 31
    out = raw.withColumns({f"_a{s}": (key + s * 15485863) % PRIME for s in range(1, 6)})
    out = out.withColumns({f"_b{s}": (F.col(f"_a{s}") * F.col(f"_a{s}") + s * 7) % PRIME for s in range(1, 6)})
    out = out.withColumns({f"_u{s}": (F.col(f"_b{s}") * F.col(f"_b{s}") + 3 * F.col(f"_b{s}") + s) % PRIME for s in range(1, 6)})
    flip = {s: (F.col(f"_u{s}") < TENTH).cast("int") for s in (2, 3, 4)}
    out = out.withColumn("x0", (F.col("_u1") >= HALF).cast("int")).withColumn("x1", F.col("x0").bitwiseXOR(flip[2]))
    out = out.withColumns({"x2": F.col("x1").bitwiseXOR(flip[3]), "x3": F.col("x0").bitwiseXOR(flip[4]), "x4": (F.col("_u5") % 3).cast("int")})
    return out.select(*kept, "x0", "x1", "x2", "x3", "x4")


def tally(spark: SparkSession, d: str) -> Tally:
    return Tally.of(rows(spark, d), [f"x{i}" for i in range(5)], CARDS)


def n_rows(spark: SparkSession, d: str) -> int:
    """From the file's footer."""
    return table(spark, d, "lineitem").count()


def boltzmann_tally(spark: SparkSession, d: str) -> Tally:
    """Rows weighted by exp of the scaled price, the weights rescaled to sum to the number of rows."""
    data = rows(spark, d)
    lim = data.agg(F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"), F.count("*").alias("n")).first()
    b = F.exp((F.col("l_extendedprice") - lim["lo"]) / (lim["hi"] - lim["lo"] + 1e-12))
    t = Tally.of(data.withColumn("b", b), [f"x{i}" for i in range(5)], CARDS, F.col("b"))
    total = t.df.agg(F.sum("w")).first()[0]
    return Tally(t.df.withColumn("w", F.col("w") * lim["n"] / total), CARDS)


def index_sql(variables: tuple[int, ...], prefix: str = "x") -> str:
    out, stride = ["0"], 1
    for v in variables:
        out.append(f"{prefix}{v} * {stride}")
        stride *= CARDS[v]
    return "(" + " + ".join(out) + ")::BIGINT"


def size(variables: tuple[int, ...]) -> int:
    return prod(CARDS[v] for v in variables)


def families_sql(families: list[Family] = FAMILIES) -> str:
    """CTEs: ``cnt`` with observed cells, ``fam`` with k and q, ``cell`` with every cell."""
    counts = " UNION ALL ".join(f"SELECT {i} AS fam, {index_sql(f.parents)} AS pcfg, x{f.var} AS state, sum(w) AS n FROM cfg GROUP BY ALL" for i, f in enumerate(families))
    meta = ", ".join(f"({i}, {f.var}, {CARDS[f.var]}, {size(f.parents)})" for i, f in enumerate(families))
    return f"cnt AS ({counts}), fam AS (SELECT * FROM (VALUES {meta}) v(fam, var, k, q)), pc AS (SELECT *, unnest(range(q)) AS pcfg FROM fam), cell0 AS (SELECT *, unnest(range(k)) AS state FROM pc), cell AS (SELECT c.*, coalesce(n, 0) AS n FROM cell0 c LEFT JOIN cnt USING (fam, pcfg, state)), cfgt AS (SELECT fam, var, k, q, pcfg, sum(n) AS total FROM cell GROUP BY ALL)"
