"""Queries of problems 3 and 5 to 9."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.cluster import each_once, label
from tallygrid.llm import mixing, percentiles, ranking, reading, together, tokens
from tallygrid.llm.sql import SQL  # noqa: F401
from tallygrid.plans.tables import table

STATES = (2, 7, 2, 2, 2, 2, 2)
#: Percentiles that the cases of problem 3 rest on.
ASKED = {"time": [50.0, 95.0], "test_sp": [10.0, 90.0]}
CELL = ["size_group", "algorithm"]
LEAST = 20


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """Each run once: its cell and the two metrics, where they count."""
    once = each_once(table(spark, d, "eda_cluster_results"), "run_id", ["group", "algorithm", "time", "test_sp"])
    t, s = F.col("time"), F.col("test_sp")
    finite = t.isNotNull() & ~F.isnan(t) & (t >= 0) & (t < float("inf"))
    return once.select(label("group").alias("size_group"), label("algorithm").alias("algorithm"), F.when(finite, t).alias("time"), F.when(~F.isnan(s), s).alias("test_sp")).filter("size_group IS NOT NULL AND algorithm IS NOT NULL")


def _sketches(runs: DataFrame) -> DataFrame:
    return percentiles.sketches(runs, {c: F.col(c) for c in CELL}, {m: F.col(m) for m in ASKED})


def _wide(long: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each cell and metric: the columns of its lower and its upper percentile."""
    upper = F.col("p").isin(90.0, 95.0)
    return long.groupBy(*CELL, "metric").agg(*[F.max(F.when(upper if at else ~upper, F.col(c))).alias(f"{c}_{at}") for c in columns for at in (0, 1)])


def _case(low: str, high: str) -> Column:
    return F.when(F.col("metric") == "time", F.col(high) >= 20 * F.col(low)).otherwise(F.col(high) - F.col(low) >= 0.9)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Cells are decided by the sketches' brackets; those whose brackets leave it open, by counting."""
    runs = percentiles.cut(_runs(spark, d))
    rough = percentiles.cut(percentiles.percentiles(_sketches(runs), CELL, ASKED).filter(F.col("n") >= LEAST))
    wide = _wide(rough, ["low", "high"])
    judged = wide.withColumn("surely", _case("high_0", "low_1")).withColumn("maybe", _case("low_0", "high_1"))
    open_ = rough.join(judged.filter("maybe AND NOT surely").select(*CELL, "metric"), [*CELL, "metric"], "left_semi")
    long = runs.select(*CELL, F.explode(F.create_map(*[x for m in ASKED for x in (F.lit(m), F.col(m) + 0.0)])).alias("metric", "value")).filter("value IS NOT NULL")
    counted = _wide(percentiles.exact(long, open_, CELL), ["value"])
    return judged.filter("surely").select(*CELL, "metric").unionByName(counted.filter(_case("value_0", "value_1")).select(*CELL, "metric"))


def p3_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Estimates with their brackets, from sketches made for each day of each partition and then combined."""
    once = each_once(table(spark, d, "eda_cluster_results"), "run_id", ["group", "algorithm", "time", "test_sp", "finished_at"])
    groups = {"size_group": label("group"), "algorithm": label("algorithm"), "day": F.to_date("finished_at")}
    days = percentiles.partial(once, groups, {m: F.col(m) for m in ASKED})
    return percentiles.percentiles(percentiles.merged(days, CELL), CELL, {m: [10.0, 50.0, 90.0, 95.0, 99.0, 99.9] for m in ASKED})


def p3_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles counted within the brackets of the sketches, and whether each lies within its own."""
    runs = percentiles.cut(_runs(spark, d))
    rough = percentiles.cut(percentiles.percentiles(_sketches(runs), CELL, {m: [10.0, 50.0, 90.0, 95.0, 99.0] for m in ASKED}))
    long = runs.select(*CELL, F.explode(F.create_map(*[x for m in ASKED for x in (F.lit(m), F.col(m) + 0.0)])).alias("metric", "value")).filter("value IS NOT NULL")
    keys = [*CELL, "metric", "p"]
    found = percentiles.exact(long, rough, CELL).withColumnRenamed("value", "counted")
    within = F.coalesce(F.col("counted").between(F.col("low"), F.col("high")), F.lit(False))
    return rough.join(found, keys, "left").select(*keys, "n", F.col("counted").alias("value"), within.alias("within"))


def _baskets(spark: SparkSession, d: str) -> DataFrame:
    """The states of each row, each row once, equal baskets counted before the product."""
    columns = [f"c{i}" for i in range(len(STATES))]
    once = each_once(table(spark, d, "moodstate_data_n2000"), "row_id", columns)
    items = F.array_compact(F.array(*[F.when(F.col(c).between(0, k - 1), F.concat(F.lit(f"{c}="), F.col(c).cast("string"))) for c, k in zip(columns, STATES, strict=True)]))
    return once.groupBy(*columns).agg(F.count("*").alias("w")).select(items.alias("items"), "w")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = together.associations(_baskets(spark, d), weight="w")
    exact = [F.col(c).cast("decimal(18,0)") for c in ("n", "n_all", "n_a", "n_b")]
    n, total, a, b = exact
    return pairs.filter((F.col("n") * 200 >= F.col("n_all")) & (n * total * 2 >= a * b * 3)).select("item_a", "item_b")


def p5_pairs(spark: SparkSession, d: str) -> DataFrame:
    return together.associations(_baskets(spark, d), weight="w").select("item_a", "item_b", "n", "n_a", "n_b", "n_all", F.round("lift", 6).alias("lift"))


def _ranked(spark: SparkSession, d: str, n: int) -> DataFrame:
    runs = table(spark, d, "eda_cluster_results").filter("family IS NOT NULL AND algorithm IS NOT NULL")
    return ranking.top_n(runs, {"family": label("family"), "algorithm": label("algorithm")}, "test_sp", "run_id", n)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d, 3).select("run_id", "place")


def p6_top10(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d, 10)


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_targets")
    counts = mixing.histogram(mixing.hashed(table(spark, d, "documents")), targets)
    return mixing.budgets(counts, targets).filter("short").select("source")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets")).report


def p8_chosen(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets")).chosen


def _levels(spark: SparkSession, d: str) -> DataFrame:
    return reading.reading_levels(table(spark, d, "documents"), table(spark, d, "reading_labels"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """English documents that have a level by the model and whose index, an exact check, is 14 or more."""
    return _levels(spark, d).filter("level IS NOT NULL AND lang = 'en' AND n_words >= 5 AND ari >= 14").select("doc_id")


def p9_levels(spark: SparkSession, d: str) -> DataFrame:
    return _levels(spark, d)


#: Graded documents below which a rank correlation says nothing.
LEAST_GRADED = 20


def p9_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Levels against grades that the fit hasn't seen (of odd documents): whether their ranks agree, null for few grades."""
    labels = table(spark, d, "reading_labels")
    levels = reading.reading_levels(table(spark, d, "documents"), labels.filter("doc_id % 2 = 0"))
    n, level, _ = reading.agreement(levels, labels.filter("doc_id % 2 = 1"))
    return spark.createDataFrame([(n, level >= 0.65 if n >= LEAST_GRADED else None)], "n_graded bigint, agrees boolean")


def p9_profile(spark: SparkSession, d: str) -> DataFrame:
    """Documents by source, language and grade."""
    graded = _levels(spark, d).select("doc_id", F.round("grade").cast("int").alias("grade"))
    docs = table(spark, d, "documents").select("doc_id", "source", "lang")
    return docs.join(graded, "doc_id").groupBy("source", "lang", "grade").agg(F.count("*").alias("n_documents"))


QUERIES = {f.__name__: f for f in (p3_found, p3_percentiles, p3_bounds, p5_found, p5_pairs, p6_found, p6_top10, p7_ids, p8_found, p8_shares, p8_chosen, p9_found, p9_levels, p9_agreement, p9_profile)}
