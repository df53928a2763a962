"""The row before, running sums and the first k rows, without one task per key or for all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallygrid.cluster import cut


def before(df: DataFrame, key: str, order: list[str], value: str, out: str) -> DataFrame:
    """``df`` with ``out``: the ``value`` of the row before in the same key, null for the first.

    The rows are range-partitioned by key and order, so a key with a third of all rows covers many partitions. Inside a
    partition a window finds the row before; for the first row of a key in a partition it is the last row of the key in
    an earlier partition, looked up in a summary with one row for each key and partition.
    """
    by = [F.col(c).asc_nulls_first() for c in order]
    ranged = cut(df.repartitionByRange(F.col(key).asc_nulls_first(), *by).withColumn("_range", F.spark_partition_id()))
    inner = Window.partitionBy(key, "_range").orderBy(*by)
    known = ranged.withColumn("_here", F.lag(F.struct(value)).over(inner))
    last = ranged.groupBy(key, "_range").agg(F.max_by(F.struct(value), F.struct(*order)).alias("_last"))
    earlier = last.withColumn("_earlier", F.lag("_last").over(Window.partitionBy(key).orderBy("_range"))).select(F.col(key).alias("_k"), F.col("_range").alias("_r"), "_earlier")
    joined = known.join(earlier, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_range") == F.col("_r")), "left")
    return joined.withColumn(out, F.coalesce("_here", "_earlier")[value]).drop("_here", "_earlier", "_k", "_r", "_range")


def running(df: DataFrame, keys: list[str], order: str, amount: str, out: str) -> DataFrame:
    """``df`` with ``out``: the sum of ``amount`` over the rows of the key up to this one; ``order`` is distinct within a key.

    Range-partitioned as above: a window sums within a partition, and the sums of earlier partitions of the key, of which
    there is one row each, are added.
    """
    by = [F.col(c).asc_nulls_first() for c in (*keys, order)]
    ranged = cut(df.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()))
    inner = ranged.withColumn("_own", F.sum(amount).over(Window.partitionBy(*keys, "_range").orderBy(F.col(order).asc_nulls_first())))
    total = ranged.groupBy(*keys, "_range").agg(F.sum(amount).alias("_t"))
    up = total.withColumn("_before", F.sum("_t").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)))
    offsets = up.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_range").alias("_r"), F.coalesce("_before", F.lit(0)).alias("_before"))
    same = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return inner.join(offsets, same).withColumn(out, F.col("_own") + F.col("_before")).drop("_own", "_before", "_range", "_r", *[f"_k{i}" for i in range(len(keys))])


def first_k(df: DataFrame, order: list, k: int) -> DataFrame:
    """The first ``k`` rows in an order (columns with their direction) that tells all rows apart.

    A limit after a sort would bring k rows into one task. Here rows are range-partitioned by the order, partitions are
    counted, and a partition keeps its rows up to what earlier ones leave of k.
    """
    ranged = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    total = ranged.groupBy("_range").agg(F.count("*").alias("_t"))
    # one row for each partition
    offsets = total.withColumn("_before", F.coalesce(F.sum("_t").over(Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_t").filter(F.col("_before") < k)
    placed = ranged.join(offsets, "_range").withColumn("_place", F.row_number().over(Window.partitionBy("_range").orderBy(*order)) + F.col("_before"))
    return placed.filter(F.col("_place") <= k).drop("_range", "_before", "_place")
