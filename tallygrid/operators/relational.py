"""Factors as DataFrames: product is a natural join, summing out a group-by, evidence a filter.

The plan follows an elimination order made on the driver, each sum taken before the next product. Spark broadcasts
factors that are small by its own statistics and joins the others by shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallygrid.operators import graphs as G
from tallygrid.operators.counting import Family, Tally


@dataclass(frozen=True)
class Relation:
    """Columns ``x<v>`` for the variables of the scope, and ``p``."""

    df: DataFrame
    scope: tuple[int, ...]
    cards: tuple[int, ...]

    def __mul__(self, other: "Relation") -> "Relation":
        """Joined on what they share. Without that, the states of the other are written out and its numbers looked up."""
        left, right = self.df, other.df.withColumnRenamed("p", "_q")
        shared = [v for v in self.scope if v in other.scope]
        if not shared and other.scope:
            shared = list(other.scope)
            for v in shared:
                left = left.withColumn(f"x{v}", F.explode(F.sequence(F.lit(0), F.lit(self.cards[v] - 1))))
        elif not shared:
            left, right, shared = left.withColumn("_one", F.lit(1)), right.withColumn("_one", F.lit(1)), []
        on = [f"x{v}" for v in shared] or ["_one"]
        scope = tuple(sorted({*self.scope, *other.scope}))
        return Relation(left.join(right, on).select(*[f"x{v}" for v in scope], (F.col("p") * F.col("_q")).alias("p")), scope, self.cards)

    def out(self, v: int, how: str = "sum") -> "Relation":
        rest = tuple(u for u in self.scope if u != v)
        return Relation(self.df.groupBy(*[f"x{u}" for u in rest]).agg(getattr(F, how)("p").alias("p")), rest, self.cards)

    def given(self, evidence: Mapping[int, int]) -> "Relation":
        df = self.df
        for v in self.scope:
            if v in evidence:
                df = df.filter(F.col(f"x{v}") == evidence[v]).drop(f"x{v}")
        return Relation(df, tuple(v for v in self.scope if v not in evidence), self.cards)


def relations(t: Tally, families: Sequence[Family], cpds: DataFrame) -> list[Relation]:
    """The factor of each family from ``var, pcfg, state, p``."""
    out = []
    for f in families:
        own = cpds.filter(F.col("var") == f.var)
        scope = tuple(sorted((*f.parents, f.var)))
        states = {f.var: F.col("state").cast("int"), **dict(zip(f.parents, t.decode(F.col("pcfg"), f.parents), strict=True))}
        out.append(Relation(own.select(*[states[v].alias(f"x{v}") for v in scope], "p"), scope, t.cards))
    return out


def eliminate(factors: Sequence[Relation], keep: Sequence[int], families: Sequence[Family], how: str = "sum", evidence: Mapping[int, int] | None = None) -> Relation:
    """The product of all factors with every variable outside ``keep`` summed or maximised out."""
    evidence = evidence or {}
    left = [f.given(evidence) for f in factors]
    a = G.adjacency_of(len(families), [(u, f.var) for f in families for u in f.parents])
    order, _ = G.elimination_order(G.moral(a))
    for v in order:
        if v in keep or v in evidence:
            continue
        touched = [f for f in left if v in f.scope]
        if touched:
            left = [f for f in left if v not in f.scope] + [reduce(lambda x, y: x * y, touched).out(v, how)]
    return reduce(lambda x, y: x * y, left)


def normalised(r: Relation) -> DataFrame:
    """A single small distribution scaled to 1."""
    return r.df.withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy()))


def edge_frame(spark: SparkSession, edges: Sequence[tuple[int, int]]) -> DataFrame:
    return spark.createDataFrame([(int(a), int(b)) for a, b in edges], "src int, dst int")


def blankets(edges: DataFrame) -> DataFrame:
    """``v, u``: u is in the Markov blanket of v."""
    down = edges.select(F.col("src").alias("v"), F.col("dst").alias("u"))
    up = edges.select(F.col("dst").alias("v"), F.col("src").alias("u"))
    mates = edges.alias("a").join(edges.alias("b"), F.col("a.dst") == F.col("b.dst")).filter("a.src <> b.src").select(F.col("a.src").alias("v"), F.col("b.src").alias("u"))
    return down.union(up).union(mates).distinct()


def moral_edges(edges: DataFrame) -> DataFrame:
    """``u, v`` with u < v: edges without direction, and parents of one child."""
    married = edges.alias("a").join(edges.alias("b"), F.col("a.dst") == F.col("b.dst")).filter("a.src < b.src").select(F.col("a.src").alias("u"), F.col("b.src").alias("v"))
    return skeleton_edges(edges).union(married).distinct()


def skeleton_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()


def closure(edges: DataFrame) -> DataFrame:
    """``src, dst``: all ancestors, by doubling paths until nothing is new."""
    from tallygrid.cluster import cut

    now = cut(edges.select("src", "dst").distinct())
    size = now.count()
    while True:
        longer = now.alias("a").join(now.alias("b"), F.col("a.dst") == F.col("b.src")).select(F.col("a.src").alias("src"), F.col("b.dst").alias("dst"))
        now = cut(now.union(longer).distinct())
        if (grown := now.count()) == size:
            return now
        size = grown


def levels(edges: DataFrame, n: int) -> DataFrame:
    """``v, level``: the longest path that leads to each variable."""
    pairs = [(r["src"], r["dst"]) for r in edges.collect()]  # a graph over variables, not data
    a = G.adjacency_of(n, pairs)
    order = G.topological(a)
    if order is None:
        raise ValueError("the graph has a cycle")
    level: dict[int, int] = {}
    for v in order:
        level[v] = 1 + max((level[u] for u in G.parents(a, v)), default=-1)
    return edges.sparkSession.createDataFrame(sorted(level.items()), "v int, level int")
