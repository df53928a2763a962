"""Evaluation of structures and of runs: metrics, ranks, tests, summaries, and the readers they rest on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallygrid.cluster import each_once, label
from tallygrid.operators import evaluation as E
from tallygrid.operators.counting import Family
from tallygrid.plans.tables import table
from tallygrid.sources import files
from tallygrid.streaming.counts import streaming_family_counts

MEASURES = ["family", "group", "algorithm", "problem", "temperature", "train_set", "time", "f1", "train_sp", "test_sp", "sp_s0", "sp_s1", "sp_s2", "test_ll", "test_kl"]


def _num(c: str) -> Column:
    """NaN as null."""
    return F.when(~F.isnan(c), F.col(c))


def runs(spark: SparkSession, d: str) -> DataFrame:
    """Each run once, labels in lower case without outer blanks, NaN as null."""
    once = each_once(table(spark, d, "eda_cluster_results"), "run_id", MEASURES)
    numbers = ("time", "f1", "train_sp", "test_sp", "sp_s0", "sp_s1", "sp_s2", "test_ll", "test_kl")
    return once.select("problem", label("family").alias("family"), label("group").alias("size_group"), label("algorithm").alias("algorithm"), "temperature", "train_set", *[_num(c).alias(c) for c in numbers])


def _by_problem(spark, d, value: str = "test_sp") -> DataFrame:
    """Mean of each problem and algorithm."""
    return runs(spark, d).filter("problem IS NOT NULL AND algorithm IS NOT NULL").groupBy("problem", "algorithm").agg(F.round(F.avg(value), 9).alias("v")).filter("v IS NOT NULL")


def _ranked(spark, d) -> DataFrame:
    return E.average_ranks(_by_problem(spark, d), "v", ["problem"])


def avg_rank(spark, d):
    return _ranked(spark, d).groupBy("algorithm").agg(F.round(F.avg("rank"), 6).alias("mean_rank"), F.count("*").alias("problems"))


def macro_mean_pivot(spark, d):
    names = ["small", "medium", "large"]
    p = runs(spark, d).filter("algorithm IS NOT NULL").groupBy("algorithm").pivot("size_group", names).agg(F.round(F.avg("test_sp"), 6))
    return p.select("algorithm", *names)


def _complete(spark, d) -> tuple[list[float], int]:
    """Mean ranks over the problems that every algorithm has, among the algorithms."""
    v = _by_problem(spark, d)
    k = v.select("algorithm").distinct().count()
    full = v.withColumn("c", F.count("*").over(Window.partitionBy("problem"))).filter(F.col("c") == k)
    ranked = E.average_ranks(full, "v", ["problem"]).groupBy("algorithm").agg(F.avg("rank").alias("r"), F.count("*").alias("n")).orderBy("algorithm").collect()
    return [r["r"] for r in ranked], ranked[0]["n"] if ranked else 0


def friedman(spark, d):
    ranks, n = _complete(spark, d)
    s, _ = E.friedman(ranks, n)
    return spark.createDataFrame([(len(ranks), n, round(s, 4))], "methods int, problems int, statistic double")


def nemenyi_cd(spark, d):
    ranks, n = _complete(spark, d)
    return spark.createDataFrame([(len(ranks), n, round(E.nemenyi(len(ranks), n), 6))], "methods int, problems int, cd double")


def best_per_problem(spark, d):
    """The best and the second of each problem; ties by name."""
    w = Window.partitionBy("problem").orderBy(F.desc("v"), "algorithm")
    return _by_problem(spark, d).withColumn("place", F.row_number().over(w)).filter("place <= 2").select("problem", "place", "algorithm", "v")


def win_counts(spark, d):
    """Problems that each algorithm leads; shared leads count for all."""
    return _by_problem(spark, d).withColumn("top", F.max("v").over(Window.partitionBy("problem"))).filter("v = top").groupBy("algorithm").agg(F.count("*").alias("wins"))


def time_ratio_filter(spark, d):
    """Median over problems of the mean time relative to k2; above 15 an algorithm is left out."""
    t = runs(spark, d).filter("time >= 0 AND problem IS NOT NULL AND algorithm IS NOT NULL").groupBy("problem", "algorithm").agg(F.avg("time").alias("t"))
    base = t.filter("algorithm = 'k2' AND t > 0").select("problem", F.col("t").alias("b"))
    r = t.join(base, "problem").groupBy("algorithm").agg(F.percentile(F.col("t") / F.col("b"), F.lit(0.5)).alias("m"), F.max(F.col("t") / F.col("b")).alias("x"))
    return r.select("algorithm", F.round("m", 6).alias("median_ratio"), F.round("x", 6).alias("max_ratio"), (F.col("m") <= 15).alias("kept"))


def generalisation_matrix(spark, d):
    return runs(spark, d).groupBy("train_set").agg(*[F.round(F.avg(f"sp_s{i}"), 6).alias(f"s{i}") for i in range(3)])


def summary_by_method(spark, d):
    """Means by algorithm and temperature, with totals, in one pass."""
    g = runs(spark, d).filter("algorithm IS NOT NULL AND temperature IS NOT NULL").rollup("algorithm", "temperature")
    return g.agg(F.count("*").alias("n"), F.round(F.avg("f1"), 6).alias("f1"), F.round(F.avg("test_ll"), 6).alias("test_ll"), F.round(F.avg("test_kl"), 6).alias("test_kl"))


def grouped_means(spark, d):
    """By size, family and temperature as grouping sets."""
    r = runs(spark, d).filter("algorithm IS NOT NULL AND size_group IS NOT NULL AND family IS NOT NULL AND temperature IS NOT NULL")
    g = r.groupingSets([["algorithm", "size_group"], ["algorithm", "family"], ["algorithm", "temperature"]], "algorithm", "size_group", "family", "temperature")
    return g.agg(F.round(F.avg("test_sp"), 6).alias("mean_sp"), F.count("test_sp").alias("n")).select("algorithm", "size_group", "family", "temperature", "mean_sp", "n")


def distributions(spark, d):
    """Quartiles over problems of the mean result."""
    return _by_problem(spark, d).groupBy("algorithm").agg(*[F.round(F.percentile("v", F.lit(q)), 6).alias(n) for n, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))])


def train_vs_test(spark, d):
    return runs(spark, d).filter("algorithm IS NOT NULL").groupBy("algorithm").agg(F.round(F.avg("train_sp") - F.avg("test_sp"), 6).alias("gap"))


def learner_means(spark, d):
    """Means of each learner over the networks, with the spread of its seconds."""
    c = table(spark, d, "comparison_results")
    return c.groupBy("method").agg(F.count("*").alias("networks"), *[F.round(F.avg(_num(k)), 6).alias(k) for k in ("directed_f1", "skeleton_f1", "shd", "time_s")], F.round(F.max(_num("time_s")), 6).alias("max_s"))


_KEEP, _TURN, _MORE = "(i * 7 + j * 3) % 5 <> 0", "(i * 11 + j) % 7 = 0", "(i + 2 * j) % 9 = 0"


def _learnt_and_true(spark, d) -> tuple[DataFrame, DataFrame]:
    """True edges, and a disturbed copy: a fifth missing, a seventh turned, some added."""
    true = table(spark, d, "problem_structures").select("problem", "i", "j").distinct()
    turned = F.expr(_TURN)
    kept = true.filter(_KEEP).select("problem", F.when(turned, F.col("j")).otherwise(F.col("i")).alias("src"), F.when(turned, F.col("i")).otherwise(F.col("j")).alias("dst"))
    more = true.filter(_MORE).select("problem", F.col("i").alias("src"), (F.col("j") + 1).alias("dst"))
    return kept.union(more).distinct(), true.select("problem", F.col("i").alias("src"), F.col("j").alias("dst"))


def edge_metrics(spark, d):
    m = E.edge_metrics(*_learnt_and_true(spark, d), ["problem"])
    return m.select("problem", *[F.round(c, 8).alias(c) for c in m.columns if c not in ("problem", "shd")], F.col("shd").cast("bigint").alias("shd"))


def skeleton_f1(spark, d):
    return edge_metrics(spark, d).select("problem", "skeleton_f1")


def boltzmann_weights(spark, d):
    """Weights of the orders by price within each status."""
    o = E.boltzmann(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), "o_totalprice", 0.5, ["o_orderstatus"])
    return o.select("o_orderkey", F.round("weight", 10).alias("weight"))


def spearman(spark, d):
    r = E.spearman(table(spark, d, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice"), "l_quantity", "l_extendedprice", ["l_returnflag"])
    return r.select("l_returnflag", F.round("rho", 8).alias("rho"))


def kl_divergence(spark, d):
    r = E.kl_divergence(table(spark, d, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice"), "l_quantity", "l_extendedprice", ["l_returnflag"])
    return r.select("l_returnflag", F.round("kl", 8).alias("kl"))


def tidy_results(spark, d):
    """Tidy rows of the result files, each listing once."""
    f = table(spark, d, "result_files").select("file_id", "path", "content").distinct()
    t = files.tidy_results(f)
    return t.groupBy("family", "algorithm", "train_set", "group").agg(F.count("*").alias("n"), F.round(F.avg(_num("test_sp")), 6).alias("test_sp"), F.count("edges").alias("with_edges"))


def size_groups(spark, d):
    n = table(spark, d, "eda_cluster_results").select("n").distinct()
    return n.select("n", files.size_group(F.col("n")).alias("by_size"), files.size_group_by_gaps(F.col("n")).alias("by_gaps"))


def experiment_grid(spark, d):
    return files.experiment_grid(spark, problem=["Ridge_64", "Gorse_48"], algorithm=["k2", "pc", "dt"], train=[0, 1, 2], temperature=[0.1, 1.0], seed=[1, 2])


def streamed_counts(spark, d):
    """Family counts of the states kept up to date over a stream of their files, here read to its end."""
    import uuid

    source = table(spark, d, "moodstate_data_n2000")
    stream = spark.readStream.schema(source.schema).parquet(f"{d}/moodstate_data_n2000.parquet") if _is_folder(spark, f"{d}/moodstate_data_n2000.parquet") else spark.readStream.schema(source.schema).option("pathGlobFilter", "moodstate_data_n2000.parquet").parquet(d)
    counts = streaming_family_counts(stream, [f"c{i}" for i in range(7)], (2, 7, 2, 2, 2, 2, 2), [Family(1, (0,)), Family(2, (0, 3))])
    name = f"counts_{uuid.uuid4().hex}"
    q = counts.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def _is_folder(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


QUERIES = {f.__name__: f for f in (avg_rank, macro_mean_pivot, friedman, nemenyi_cd, best_per_problem, win_counts, time_ratio_filter, generalisation_matrix, summary_by_method, grouped_means, distributions, train_vs_test, learner_means, edge_metrics, skeleton_f1, boltzmann_weights, spearman, kl_divergence, tidy_results, size_groups, experiment_grid, streamed_counts)}

_B = "' ' || chr(9)"
# By its text: with isnan, DuckDB's statistics of a column may hide its NaN values.
_NUM = lambda c: f"CASE WHEN {c}::VARCHAR <> 'nan' THEN {c} END"
_RUNS = f"""WITH once AS (SELECT DISTINCT ON (run_id) * FROM eda_cluster_results ORDER BY run_id, ingested_at),
runs AS (SELECT problem, lower(trim(family, {_B})) AS family, lower(trim("group", {_B})) AS size_group, lower(trim(algorithm, {_B})) AS algorithm, temperature, train_set, {", ".join(f'{_NUM(c)} AS {c}' for c in ('"time"', "f1", "train_sp", "test_sp", "sp_s0", "sp_s1", "sp_s2", "test_ll", "test_kl"))} FROM once)"""
_BYP = f"{_RUNS}, bp AS (SELECT problem, algorithm, round(avg(test_sp), 9) AS v FROM runs WHERE problem IS NOT NULL AND algorithm IS NOT NULL GROUP BY ALL HAVING avg(test_sp) IS NOT NULL)"
_RANK = "rank() OVER (PARTITION BY problem ORDER BY v DESC) + (count(*) OVER (PARTITION BY problem, v) - 1) / 2.0"
_FULL = f"{_BYP}, k AS (SELECT count(DISTINCT algorithm) AS k FROM bp), fu AS (SELECT * FROM bp WHERE problem IN (SELECT problem FROM bp GROUP BY 1 HAVING count(*) = (SELECT k FROM k))), rk AS (SELECT algorithm, {_RANK} AS r FROM fu), mr AS (SELECT algorithm, avg(r) AS r, count(*) AS n FROM rk GROUP BY 1), z AS (SELECT count(*)::INT AS methods, max(n)::INT AS problems, sum((r - ((SELECT k FROM k) + 1) / 2.0) ** 2) AS s FROM mr)"
_LT = f"tr AS (SELECT DISTINCT problem, i, j FROM problem_structures), le AS (SELECT problem, CASE WHEN {_TURN} THEN j ELSE i END AS src, CASE WHEN {_TURN} THEN i ELSE j END AS dst FROM tr WHERE {_KEEP} UNION SELECT problem, i, j + 1 FROM tr WHERE {_MORE})"
_EM = f"""WITH {_LT}, d AS (SELECT coalesce(l.problem, t.problem) AS problem, count(*) FILTER (l.src IS NOT NULL AND t.i IS NOT NULL) AS tp, count(*) FILTER (t.i IS NULL) AS fp, count(*) FILTER (l.src IS NULL) AS fn FROM le l FULL JOIN tr t ON l.problem = t.problem AND l.src = t.i AND l.dst = t.j GROUP BY 1),
sl AS (SELECT DISTINCT problem, least(src, dst) AS a, greatest(src, dst) AS b FROM le), st AS (SELECT DISTINCT problem, least(i, j) AS a, greatest(i, j) AS b FROM tr),
s AS (SELECT coalesce(l.problem, t.problem) AS problem, count(*) FILTER (l.a IS NOT NULL AND t.a IS NOT NULL) AS tp, count(*) FILTER (t.a IS NULL) AS fp, count(*) FILTER (l.a IS NULL) AS fn FROM sl l FULL JOIN st t ON l.problem = t.problem AND l.a = t.a AND l.b = t.b GROUP BY 1),
rv AS (SELECT problem, count(*) AS n FROM le l WHERE NOT EXISTS (SELECT 1 FROM tr t WHERE t.problem = l.problem AND t.i = l.src AND t.j = l.dst) AND EXISTS (SELECT 1 FROM tr t WHERE t.problem = l.problem AND t.i = l.dst AND t.j = l.src) AND NOT EXISTS (SELECT 1 FROM le m WHERE m.problem = l.problem AND m.src = l.dst AND m.dst = l.src) GROUP BY 1)"""


def _prf(t: str, p: str) -> str:
    pr, rc = f"CASE WHEN {t}.tp + {t}.fp > 0 THEN {t}.tp / ({t}.tp + {t}.fp) ELSE 1 END", f"CASE WHEN {t}.tp + {t}.fn > 0 THEN {t}.tp / ({t}.tp + {t}.fn) ELSE 1 END"
    return f"round({pr}, 8) AS {p}_precision, round({rc}, 8) AS {p}_recall, round(CASE WHEN {t}.tp > 0 THEN 2.0 * {t}.tp / (2 * {t}.tp + {t}.fp + {t}.fn) WHEN {t}.fp + {t}.fn = 0 THEN 1 ELSE 0 END, 8) AS {p}_f1"


_AVG_RANK_OF = lambda c: f"rank() OVER (PARTITION BY l_returnflag ORDER BY {c}) + (count(*) OVER (PARTITION BY l_returnflag, {c}) - 1) / 2.0"
_MOOD = "ok AS (SELECT * FROM moodstate_data_n2000 WHERE c1 BETWEEN 0 AND 6" + "".join(f" AND c{i} BETWEEN 0 AND 1" for i in (0, 2, 3, 4, 5, 6)) + ")"
SQL = {
    "avg_rank": f"{_BYP}, r AS (SELECT algorithm, {_RANK} AS r FROM bp) SELECT algorithm, round(avg(r), 6) AS mean_rank, count(*) AS problems FROM r GROUP BY 1",
    "macro_mean_pivot": f"{_RUNS} SELECT algorithm, " + ", ".join(f"round(avg(test_sp) FILTER (size_group = '{g}'), 6) AS {g}" for g in ("small", "medium", "large")) + " FROM runs WHERE algorithm IS NOT NULL GROUP BY 1",
    "friedman": f"{_FULL} SELECT methods, problems, round(12.0 * problems / (methods * (methods + 1)) * s, 4) AS statistic FROM z",
    "nemenyi_cd": f"{_FULL} SELECT methods, problems, round([{', '.join(map(str, E.NEMENYI))}][methods - 1]::DOUBLE * sqrt(methods * (methods + 1) / (6.0 * problems)), 6) AS cd FROM z",
    "best_per_problem": f"{_BYP} SELECT problem, place, algorithm, v FROM (SELECT *, row_number() OVER (PARTITION BY problem ORDER BY v DESC, algorithm)::INT AS place FROM bp) WHERE place <= 2",
    "win_counts": f"{_BYP} SELECT algorithm, count(*) AS wins FROM (SELECT *, max(v) OVER (PARTITION BY problem) AS top FROM bp) WHERE v = top GROUP BY 1",
    "time_ratio_filter": f"""{_RUNS}, t AS (SELECT problem, algorithm, avg("time") AS t FROM runs WHERE "time" >= 0 AND problem IS NOT NULL AND algorithm IS NOT NULL GROUP BY ALL), r AS (SELECT t.algorithm, t.t / b.t AS r FROM t JOIN t b ON b.problem = t.problem AND b.algorithm = 'k2' AND b.t > 0) SELECT algorithm, round(median(r), 6) AS median_ratio, round(max(r), 6) AS max_ratio, median(r) <= 15 AS kept FROM r GROUP BY 1""",
    "generalisation_matrix": f"{_RUNS} SELECT train_set, " + ", ".join(f"round(avg(sp_s{i}), 6) AS s{i}" for i in range(3)) + " FROM runs GROUP BY 1",
    "summary_by_method": f"{_RUNS} SELECT algorithm, temperature, count(*) AS n, round(avg(f1), 6) AS f1, round(avg(test_ll), 6) AS test_ll, round(avg(test_kl), 6) AS test_kl FROM runs WHERE algorithm IS NOT NULL AND temperature IS NOT NULL GROUP BY ROLLUP (algorithm, temperature)",
    "grouped_means": f"{_RUNS} SELECT algorithm, size_group, family, temperature, round(avg(test_sp), 6) AS mean_sp, count(test_sp) AS n FROM runs WHERE algorithm IS NOT NULL AND size_group IS NOT NULL AND family IS NOT NULL AND temperature IS NOT NULL GROUP BY GROUPING SETS ((algorithm, size_group), (algorithm, family), (algorithm, temperature))",
    "distributions": f"{_BYP} SELECT algorithm, " + ", ".join(f"round(quantile_cont(v, {q}), 6) AS {n}" for n, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))) + " FROM bp GROUP BY 1",
    "train_vs_test": f"{_RUNS} SELECT algorithm, round(avg(train_sp) - avg(test_sp), 6) AS gap FROM runs WHERE algorithm IS NOT NULL GROUP BY 1",
    "learner_means": "SELECT method, count(*) AS networks, " + ", ".join(f"round(avg({_NUM(k)}), 6) AS {k}" for k in ("directed_f1", "skeleton_f1", "shd", "time_s")) + f", round(max({_NUM('time_s')}), 6) AS max_s FROM comparison_results GROUP BY 1",
    "edge_metrics": f"{_EM} SELECT d.problem, {_prf('d', 'directed')}, {_prf('s', 'skeleton')}, d.fp + d.fn - coalesce(rv.n, 0) AS shd FROM d JOIN s USING (problem) LEFT JOIN rv USING (problem)",
    "skeleton_f1": f"{_EM} SELECT problem, round(CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) WHEN fp + fn = 0 THEN 1 ELSE 0 END, 8) AS skeleton_f1 FROM s",
    "boltzmann_weights": "WITH s AS (SELECT *, min(o_totalprice) OVER w AS lo, max(o_totalprice) OVER w AS hi FROM orders WINDOW w AS (PARTITION BY o_orderstatus)), e AS (SELECT *, exp((o_totalprice - lo) / (hi - lo + 1e-12) / 0.5) AS e FROM s) SELECT o_orderkey, round(e / sum(e) OVER (PARTITION BY o_orderstatus), 10) AS weight FROM e",
    "spearman": f"WITH r AS (SELECT l_returnflag, {_AVG_RANK_OF('l_quantity')} AS a, {_AVG_RANK_OF('l_extendedprice')} AS b FROM lineitem) SELECT l_returnflag, round(corr(a, b), 8) AS rho FROM r GROUP BY 1",
    "kl_divergence": "WITH s AS (SELECT l_returnflag, l_quantity / sum(l_quantity) OVER w AS p, l_extendedprice / sum(l_extendedprice) OVER w AS q FROM lineitem WINDOW w AS (PARTITION BY l_returnflag)) SELECT l_returnflag, round(sum(p * ln(p / greatest(q, 1e-300))), 8) AS kl FROM s WHERE p > 0 GROUP BY 1",
    "tidy_results": r"""WITH f AS (SELECT DISTINCT file_id, path, content FROM result_files), n AS (SELECT *, regexp_extract(path, 'eval_([^/]+)_tr([0-9]+)_([^/]+)_T([0-9.]+)_s([0-9]+)\.dat', ['problem', 'tr', 'algorithm', 'temp', 'seed']) AS r FROM f),
l AS (SELECT file_id, path, r, string_split_regex(content, '\r?\n') AS ls FROM n WHERE r.problem <> ''), p AS (SELECT *, list_filter(ls, lambda x: starts_with(x, '#')) AS notes, list_filter(list_transform(list_filter(ls, lambda x: NOT starts_with(x, '#')), lambda x: string_split(trim(regexp_replace(x, '\s+', ' ', 'g')), ' ')), lambda v: len(v) = 11) AS recs FROM l),
q AS (SELECT r, array_to_string(notes, ' ') AS note, unnest(recs) AS v, r.tr::INT AS tr FROM p),
t AS (SELECT regexp_replace(r.problem, '_[0-9]+$', '') AS family, r.algorithm AS algorithm, tr AS train_set, coalesce(try_cast(nullif(regexp_extract(note, '(?:^|\s)n=([^\s]+)', 1), '') AS INT), try_cast(nullif(regexp_extract(r.problem, '_([0-9]+)$', 1), '') AS INT), -1) AS n, try_cast(nullif(regexp_extract(note, '(?:^|\s)edges=([^\s]+)', 1), '') AS DOUBLE) AS edges,
  [try_cast(v[5] AS DOUBLE), try_cast(v[8] AS DOUBLE), try_cast(v[11] AS DOUBLE)] AS sp FROM q), u AS (SELECT *, CASE tr_ WHEN 0 THEN (sp[2] + sp[3]) / 2 WHEN 1 THEN (sp[1] + sp[3]) / 2 WHEN 2 THEN (sp[1] + sp[2]) / 2 END AS test_sp FROM (SELECT *, train_set AS tr_ FROM t))
SELECT family, algorithm, train_set, CASE WHEN n < 50 THEN 'small' WHEN n < 100 THEN 'medium' ELSE 'large' END AS "group", count(*) AS n, round(avg(CASE WHEN test_sp::VARCHAR <> 'nan' THEN test_sp END), 6) AS test_sp, count(edges) AS with_edges FROM u GROUP BY ALL""",
    "size_groups": "SELECT DISTINCT n, CASE WHEN n < 50 THEN 'small' WHEN n < 100 THEN 'medium' ELSE 'large' END AS by_size, CASE WHEN n <= 40 THEN 'small' WHEN n > 50 AND n < 100 THEN 'medium' WHEN n >= 100 THEN 'large' END AS by_gaps FROM eda_cluster_results",
    "experiment_grid": "SELECT * FROM (SELECT unnest(['Ridge_64', 'Gorse_48']) AS problem), (SELECT unnest(['k2', 'pc', 'dt']) AS algorithm), (SELECT unnest([0, 1, 2]) AS train), (SELECT unnest([0.1, 1.0])::DOUBLE AS temperature), (SELECT unnest([1, 2]) AS seed)",
    "streamed_counts": f"WITH {_MOOD} SELECT 0 AS fam, c0::BIGINT AS pcfg, c1 AS state, count(*)::DOUBLE AS n FROM ok GROUP BY ALL UNION ALL SELECT 1, (c0 + 2 * c3)::BIGINT, c2, count(*)::DOUBLE FROM ok GROUP BY ALL",
}
