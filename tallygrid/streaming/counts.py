"""Counts over streams: sufficient statistics are sums, so a network's families can be counted as rows arrive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrid.operators.counting import Family, Tally, family_counts


def streaming_family_counts(stream: DataFrame, columns: Sequence[str], cards: Sequence[int], families: Sequence[Family], time: str | None = None, window: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts by family, parent configuration and state, for update mode; with ``time`` by window, closed by a watermark.

    Rows with a null or a value that is no state are dropped.
    """
    xs = [F.col(f"`{c}`").cast("int").alias(f"x{i}") for i, c in enumerate(columns)]
    rows = stream.select(*xs, *([F.col(time).alias("_time")] if time else []), F.lit(1.0).alias("w"))
    for i, k in enumerate(cards):
        rows = rows.filter(F.col(f"x{i}").between(0, k - 1))
    if not time:
        return family_counts(Tally(rows, tuple(cards)), families)
    t = Tally(rows, tuple(cards))
    made = [F.struct(F.lit(i).alias("fam"), t.code(f.parents).alias("pcfg"), F.col(f"x{f.var}").alias("state")) for i, f in enumerate(families)]
    cells = rows.withWatermark("_time", late).select(F.explode(F.array(*made)).alias("r"), "w", "_time")
    return cells.groupBy(F.window("_time", window or "1 day"), "r.fam", "r.pcfg", "r.state").agg(F.sum("w").alias("n"))
