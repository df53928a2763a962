"""The N best items of every group, by salted two-stage ranking.

Each group is hashed by identifier into subgroups; N are kept in each, then the survivors, at most N times the number of
subgroups, are ranked by score (descending) and identifier (ascending). The optimizer limits groups before the first
shuffle as well, so of a group with a third of all rows each task sends only N rows a subgroup.

Edge cases, as tested: null and NaN scores are left out; null groups form groups of their own unless filtered before;
rows equal in group, score and identifier count once (copies share a subgroup, so no shuffle is needed to tell); an
identifier with several scores is ranked with each; a null identifier comes after the others of its score; empty tables
give an empty result; clashing extra columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, groups: dict[str, Column], score: str, ident: str, n: int, salts: int = 16) -> DataFrame:
    """The group columns, ``ident``, ``score`` and ``place`` from 1."""
    names = [f"g{i}" for i in range(len(groups))]
    rows = df.select(*[c.alias(k) for k, c in zip(names, groups.values(), strict=True)], F.col(f"`{score}`").cast("double").alias("s"), F.col(f"`{ident}`").alias("i"))
    rows = rows.filter(F.col("s").isNotNull() & ~F.isnan("s")).withColumn("part", F.pmod(F.xxhash64("i"), F.lit(salts)).cast("int"))
    best = [F.col("s").desc(), F.col("i").asc_nulls_last()]
    first = rows.withColumn("r", F.dense_rank().over(Window.partitionBy(*names, "part").orderBy(*best))).filter(F.col("r") <= n)
    once = first.dropDuplicates([*names, "part", "s", "i"])
    ranked = once.withColumn("place", F.row_number().over(Window.partitionBy(*names).orderBy(*best))).filter(F.col("place") <= n)
    return ranked.select(*[F.col(k).alias(name) for k, name in zip(names, groups, strict=True)], F.col("i").alias(ident), F.col("s").alias(score), "place")
