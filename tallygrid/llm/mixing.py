"""Mixing sources to target weights by hash thresholds.

Tokens are summed by source and hash bucket. A source gives its budget by whole repeats of all its documents and, for
the rest, by the documents whose hash lies below a threshold. The threshold is found in the cumulated histogram; only
the bucket that the budget ends in is refined, by the next bits of the hash, until the bits are used up. Documents are
then filtered by comparison with the threshold: nothing is sorted, and thresholds of smaller budgets are nested in
those of larger ones.

Edge cases, as tested: a source without documents is short and gives nothing; documents of other or null sources and of
null ids take no part or are hashed by text; empty and null texts have no tokens; a repeat cap of null or below 1
counts as 0; documents with one and the same hash are taken or left together; an empty table gives shares of null.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallygrid.cluster import cut
from tallygrid.llm.tokens import VOCABULARY, sizes

BITS, ROUNDS = 12, 5
RANGE = 1 << BITS * ROUNDS


def hashed(docs: DataFrame, ident: str = "doc_id", source: str = "source", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """``ident, source, n_tokens, h`` of every document, written once; h has 60 bits."""
    h = F.when(F.col(f"`{ident}`").isNull(), F.xxhash64(F.coalesce(text, F.lit("")))).otherwise(F.xxhash64(F.col(f"`{ident}`").cast("string")))
    rows = docs.select(F.col(f"`{ident}`").alias(ident), F.col(f"`{source}`").alias("source"), F.shiftrightunsigned(h, 64 - BITS * ROUNDS).alias("h"), F.col(f"`{text}`").alias("text"))
    return cut(sizes(rows, [ident, "source", "h"], "text", path))


def _prefix(h, level: int):
    return F.shiftright(h, BITS * (ROUNDS - 1 - level))


def histogram(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Tokens of each target's source by the first bits of the hash. Combined before the shuffle: a row per task, source and bucket."""
    return sized.join(targets.select("source"), "source", "left_semi").groupBy("source", _prefix(F.col("h"), 0).alias("bucket")).agg(F.sum("n_tokens").alias("tokens"))


def budgets(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, target_share, max_repeats, tokens, total, budget, full, rest, short``, one row for each target.

    The total is that of all documents of the targets' sources. ``full`` is how often all documents of the source are
    taken, ``rest`` the tokens still wanted, ``short`` whether the source can't give its budget within its repeats.
    """
    per = counts.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    joined = targets.join(per, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    # one row for each target: a table of configuration, not of data
    wanted = joined.withColumn("total", F.sum("tokens").over(Window.partitionBy())).withColumn("budget", F.col("target_share") * F.col("total"))
    cap = F.greatest(F.coalesce(F.col("max_repeats"), F.lit(0)), F.lit(0)).cast("bigint")
    full = F.when(F.col("tokens") > 0, F.least(cap, F.floor(F.col("budget") / F.col("tokens")))).otherwise(F.lit(0)).cast("bigint")
    more = F.when(full < cap, F.col("budget") - full * F.col("tokens")).otherwise(F.lit(0.0))
    return wanted.select("source", "target_share", "max_repeats", "tokens", "total", "budget", full.alias("full"), more.alias("rest"), (F.col("tokens") * cap < F.col("budget")).alias("short"))


def thresholds(sized: DataFrame, counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``source, threshold, reached``: documents with a hash below the threshold have ``reached`` tokens, at most the rest."""
    state = wanted.filter("tokens > 0").select("source", F.col("rest").alias("left"), F.lit(0).cast("bigint").alias("prefix"), F.lit(0).cast("bigint").alias("reached"))
    level_counts = counts
    done = None
    for level in range(ROUNDS):
        if level:
            inside = sized.join(F.broadcast(state.select("source", F.col("prefix").alias("boundary"))), "source")
            inside = inside.filter(_prefix(F.col("h"), level - 1) == F.col("boundary"))
            level_counts = inside.groupBy("source", _prefix(F.col("h"), level).alias("bucket")).agg(F.sum("n_tokens").alias("tokens"))
        up = level_counts.withColumn("up", F.sum("tokens").over(Window.partitionBy("source").orderBy("bucket")))
        # the state has one row for each target, a table of configuration; the buckets stay where they are
        joined = up.join(F.broadcast(state), "source")
        fits = F.col("up") <= F.col("left")
        ends = joined.groupBy("source").agg(F.max(F.when(fits, F.col("up"))).alias("took"), F.min(F.when(~fits, F.col("bucket"))).alias("boundary"))
        found = state.join(F.broadcast(ends), "source", "left").withColumn("took", F.coalesce("took", F.lit(0)))
        # without a bucket that doesn't fit, all that is inside is taken: the threshold is the end of the prefix
        ended = found.filter(F.col("boundary").isNull()).select("source", F.when(F.lit(level == 0), F.lit(RANGE)).otherwise(F.shiftleft(F.col("prefix") + 1, BITS * (ROUNDS - level))).cast("bigint").alias("threshold"), (F.col("reached") + F.col("took")).alias("reached"))
        state = cut(found.filter(F.col("boundary").isNotNull()).select("source", (F.col("left") - F.col("took")).alias("left"), F.col("boundary").alias("prefix"), (F.col("reached") + F.col("took")).alias("reached")))
        done = ended if done is None else done.unionByName(ended)
    return done.unionByName(state.select("source", F.col("prefix").alias("threshold"), "reached"))


@dataclass
class Mixture:
    """``report`` has a row for each target, ``chosen`` each document that is taken, with its number of copies."""

    report: DataFrame
    chosen: DataFrame


def mix(docs: DataFrame, targets: DataFrame, ident: str = "doc_id", path: str = VOCABULARY) -> Mixture:
    """A mixture as large as all documents of the targets' sources, as far as the repeats allow."""
    targets = targets.select("source", "target_share", "max_repeats").dropDuplicates(["source"])
    sized = hashed(docs, ident, path=path)
    counts = histogram(sized, targets)
    wanted = budgets(counts, targets)
    limits = cut(thresholds(sized, counts, wanted))
    plan = wanted.join(limits, "source", "left").withColumn("given", F.col("full") * F.col("tokens") + F.coalesce("reached", F.lit(0)))
    share = F.col("given") / F.nullif(F.sum("given").over(Window.partitionBy()), F.lit(0))
    report = plan.select("source", "target_share", "max_repeats", "tokens", "budget", "given", share.alias("actual_share"), "short")
    copies = F.col("full") + F.when(F.col("h") < F.coalesce("threshold", F.lit(0)), 1).otherwise(0)
    chosen = sized.join(plan.select("source", "full", "threshold"), "source").withColumn("copies", copies).filter("copies > 0").select(ident, "source", "n_tokens", "copies")
    return Mixture(report, chosen)
