"""Counts, scores, information and tests on the planted table."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallygrid.functions.special import chi2_isf
from tallygrid.operators import counting as C
from tallygrid.plans import fixture as X
from tallygrid.plans.tables import table

F0 = X.FAMILIES
TRIPLES = [(i, j, (z,)) for i, j in combinations(range(5), 2) for z in range(5) if z not in (i, j)]
SETS = [(i, j, tuple(sorted({0, 1, 2, 3, 4} - {i, j}))[:2]) for i, j in combinations(range(5), 2)]
CLUSTERS = [(i,) for i in range(5)] + list(combinations(range(5), 2))


def _named(scores: DataFrame, places: int = 4) -> DataFrame:
    return scores.select("fam", F.round("score", places).alias("score"))


def encode_lineitem(spark: SparkSession, d: str) -> DataFrame:
    """Sorted distinct labels to codes from 0, by a small dictionary."""
    rows = table(spark, d, "lineitem")
    codes = rows.select("l_returnflag").distinct().withColumn("flag", F.row_number().over(Window.orderBy("l_returnflag")) - 1)
    return rows.join(codes, "l_returnflag").groupBy("flag", (F.year("l_shipdate")).alias("year"), F.least(F.floor(F.col("l_quantity") / 10), F.lit(4)).cast("int").alias("qty")).agg(F.count("*").alias("n"))


def compress_configs(spark, d):
    return X.tally(spark, d).df


def joint_config_index(spark, d):
    t = X.tally(spark, d)
    return t.df.select(t.code(range(5)).alias("idx"), "w")


def decode_config(spark, d):
    t = X.tally(spark, d)
    return t.df.select(t.code(range(5)).alias("idx")).select("idx", *[c.alias(f"x{i}") for i, c in enumerate(t.decode(F.col("idx"), range(5)))])


def family_counts(spark, d):
    return C.family_counts(X.tally(spark, d), F0)


def log_likelihood(spark, d):
    return _named(C.log_likelihood(X.tally(spark, d), F0, 1.0))


def bic_local(spark, d):
    return _named(C.bic(X.tally(spark, d), F0, X.n_rows(spark, d)))


def aic_local(spark, d):
    return _named(C.aic(X.tally(spark, d), F0))


def k2_local(spark, d):
    return _named(C.k2(X.tally(spark, d), F0))


def k2pen_bic(spark, d):
    return _named(C.k2_penalised(X.tally(spark, d), F0, X.n_rows(spark, d)))


def k2pen_aic(spark, d):
    return _named(C.k2_penalised(X.tally(spark, d), F0, X.n_rows(spark, d), "aic"))


def ebna_score(spark, d):
    return _named(C.ebna(X.tally(spark, d), F0, X.n_rows(spark, d)))


def structure_score(spark, d):
    return C.bic(X.tally(spark, d), X.NETWORK, X.n_rows(spark, d)).agg(F.round(F.sum("score"), 3).alias("score"))


def weighted_k2_local(spark, d):
    return _named(C.k2(X.boltzmann_tally(spark, d), F0), 3)


def dirichlet_ml(spark, d):
    return _named(C.set_evidence(X.tally(spark, d), CLUSTERS))


def bdeu_variable_clusters_first_merge(spark, d):
    """The pair with the largest log Bayes factor against being apart."""
    scores = C.set_evidence(X.tally(spark, d), CLUSTERS)
    names = spark.createDataFrame([(i, s[0], s[-1]) for i, s in enumerate(CLUSTERS)], "fam int, i int, j int")
    named = scores.join(names, "fam")
    one = named.filter("i = j").select(F.col("i").alias("v"), F.col("score").alias("own"))
    pairs = named.filter("i < j").join(one.withColumnsRenamed({"v": "i", "own": "si"}), "i").join(one.withColumnsRenamed({"v": "j", "own": "sj"}), "j")
    return pairs.select("i", "j", F.round(F.col("score") - F.col("si") - F.col("sj"), 3).alias("log_bf")).orderBy(F.desc("log_bf"), "i", "j").limit(1)


def marginals_uni(spark, d):
    return C.singles(X.tally(spark, d)).select("i", "a", F.round("p", 6).alias("p"))


def marginals_bi(spark, d):
    """Joint shares of every pair with one count added to each of all its cells."""
    t = X.tally(spark, d)
    sizes = spark.createDataFrame([(i, j, a, b) for i, j in combinations(range(5), 2) for a in range(X.CARDS[i]) for b in range(X.CARDS[j])], "i int, j int, a int, b int")
    full = sizes.join(C.pair_table(t).select("i", "j", "a", "b", "n"), ["i", "j", "a", "b"], "left").withColumn("n", F.coalesce("n", F.lit(0.0)) + 1)
    return full.select("i", "j", "a", "b", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("i", "j")), 6).alias("p"))


def mi_nats(spark, d):
    return C.mutual_information(X.tally(spark, d)).select("i", "j", F.round("mi", 6).alias("mi"))


def mi_bits(spark, d):
    return C.mutual_information(X.tally(spark, d), bits=True).select("i", "j", F.round("mi", 6).alias("mi"))


def cmi_single(spark, d):
    return C.conditional_information(X.tally(spark, d), TRIPLES).select("req", F.round("cmi", 6).alias("cmi"))


def cmi_set(spark, d):
    return C.conditional_information(X.tally(spark, d), SETS, bits=True, least=1.0).select("req", F.round("cmi", 6).alias("cmi"))


def chi2_marginal(spark, d):
    tests = [(i, j, ()) for i, j in combinations(range(5), 2)]
    crit = F.element_at(F.array(*[F.lit(chi2_isf(0.05, k)) for k in (1, 2)]), F.col("dof"))
    return C.chi_square(X.tally(spark, d), tests).select("req", F.round("statistic", 3).alias("statistic"), "dof", (F.col("statistic") < crit).alias("independent"))


def chi2_conditional(spark, d):
    return C.chi_square(X.tally(spark, d), TRIPLES).select("req", F.round("statistic", 3).alias("statistic"), "dof")


def g_test(spark, d):
    return C.g_test(X.tally(spark, d), X.n_rows(spark, d)).select("i", "j", F.round("g", 3).alias("g"))


def chi2_df1(spark, d):
    """Pairs whose 2 n times information passes the 5 percent value of one degree of freedom."""
    n = X.n_rows(spark, d)
    return C.mutual_information(X.tally(spark, d)).select("i", "j", (2 * n * F.col("mi") > chi2_isf(0.05, 1)).alias("dependent"))


def mi_threshold_pairs(spark, d):
    """Pairs whose information exceeds the chi-square threshold over 2 n."""
    crit = F.when((F.col("i") == 4) | (F.col("j") == 4), chi2_isf(0.05, 2)).otherwise(chi2_isf(0.05, 1)) / (2 * F.col("total"))
    return C.mutual_information(X.tally(spark, d)).filter(F.col("mi") > crit).select("i", "j")


def mi_topk_mask(spark, d):
    """Pairs in which one variable is among the two most informative partners of the other."""
    mi = C.mutual_information(X.tally(spark, d)).filter("mi > 0").select("i", "j", F.round("mi", 9).alias("mi"))
    both = mi.unionByName(mi.select(F.col("j").alias("i"), F.col("i").alias("j"), "mi"))
    top = both.withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("mi"), "j"))).filter("r <= 2")
    return top.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct()


def k_neighbors(spark, d):
    """Up to two partners of each variable above 1.5 times the mean positive information."""
    mi = C.mutual_information(X.tally(spark, d), bits=True).select("i", "j", F.round("mi", 9).alias("mi"))
    mean = mi.filter("mi > 0").agg(F.avg("mi").alias("m")).first()["m"] or 0.0
    both = mi.unionByName(mi.select(F.col("j").alias("i"), F.col("i").alias("j"), "mi")).filter(F.col("mi") >= 1.5 * mean)
    return both.withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("mi"), "j"))).filter("r <= 2").select("i", "j", "r")


def dependency_graph(spark, d):
    """Adjacency by information above .05 bits; the diagonal is set."""
    t = X.tally(spark, d)
    mi = C.mutual_information(t, bits=True)
    pairs = mi.select("i", "j", (F.col("mi") > 0.05).cast("int").alias("edge"))
    diagonal = spark.range(5).select(F.col("id").cast("int").alias("i"), F.col("id").cast("int").alias("j"), F.lit(1).alias("edge"))
    return pairs.unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "edge")).unionByName(diagonal)


def mle_cpd(spark, d):
    return C.cpds(X.tally(spark, d), X.NETWORK, 1.0).select("var", "pcfg", "state", F.round("p", 6).alias("p"))


def mle_cpd_weighted(spark, d):
    return C.cpds(X.boltzmann_tally(spark, d), X.NETWORK, 1.0).select("var", "pcfg", "state", F.round("p", 6).alias("p"))


def clique_table(spark, d):
    """P(x2, x4 | x1)."""
    return C.conditional_table(X.tally(spark, d), (1,), (2, 4), 1.0).select("pcfg", "ncfg", F.round("p", 6).alias("p"))


def fda_table(spark, d):
    """P(x3 | x0, x4) with a count added to every cell."""
    return C.conditional_table(X.tally(spark, d), (0, 4), (3,), 1.0, spread=False).select("pcfg", "ncfg", F.round("p", 6).alias("p"))


def moa_table(spark, d):
    """P(variable | its strongest two neighbours) with Laplace counts, for x1 given x0 and x2."""
    return C.conditional_table(X.tally(spark, d), (0, 2), (1,), 1.0, spread=False).select("pcfg", "ncfg", F.round("p", 6).alias("p"))


def gram_matrix(spark, d):
    """Sums of products of the indicator columns of states above 0."""
    t = X.tally(spark, d)
    cols = [(v, s) for v in range(5) for s in range(1, X.CARDS[v])]
    hot = F.array_compact(F.array(*[F.when(F.col(f"x{v}") == s, F.lit(i)) for i, (v, s) in enumerate(cols)]))
    rows = t.df.select(hot.alias("h"), "w")
    return rows.select(F.explode_outer("h").alias("i"), "h", "w").select("i", F.explode_outer("h").alias("j"), "w").filter("i IS NOT NULL").groupBy("i", "j").agg(F.sum("w").alias("g"))


def smoothness_laplacian(spark, d, alpha: float = 0.4, beta: float = 0.9):
    """Weights max(0, beta - Z / 2 alpha), Z the mean squared distance of two columns, and their Laplacian."""
    t = X.tally(spark, d)
    if alpha <= 0:
        raise ValueError("alpha must be positive")
    z = t.df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.pow(F.col(f"x{i}") - F.col(f"x{j}"), 2).alias("z")) for i in range(5) for j in range(5) if i != j])).alias("r"), "w").groupBy("r.i", "r.j").agg((F.sum(F.col("r.z") * F.col("w")) / F.sum("w")).alias("z"))
    w = z.select("i", "j", F.greatest(F.lit(0.0), beta - F.col("z") / (2 * alpha)).alias("w"))
    diagonal = w.groupBy("i").agg(F.sum("w").alias("l")).select("i", F.col("i").alias("j"), "l")
    return w.select("i", "j", (-F.col("w")).alias("l")).unionByName(diagonal).select("i", "j", (F.round("l", 6) + 0.0).alias("l"))


QUERIES = {f.__name__: f for f in (encode_lineitem, compress_configs, joint_config_index, decode_config, family_counts, log_likelihood, bic_local, aic_local, k2_local, k2pen_bic, k2pen_aic, ebna_score, structure_score, weighted_k2_local, dirichlet_ml, bdeu_variable_clusters_first_merge, marginals_uni, marginals_bi, mi_nats, mi_bits, cmi_single, cmi_set, chi2_marginal, chi2_conditional, g_test, chi2_df1, mi_threshold_pairs, mi_topk_mask, k_neighbors, dependency_graph, mle_cpd, mle_cpd_weighted, clique_table, fda_table, moa_table, gram_matrix, smoothness_laplacian)}

_FAM = f"WITH {X.SQL}, {X.families_sql()}"
_NET = f"WITH {X.SQL}, {X.families_sql(X.NETWORK)}"
_N = "(SELECT sum(w) FROM cfg)"
_LL = "sum(CASE WHEN c.n + {a} > 0 THEN (c.n + {a}) * ln((c.n + {a}) / (t.total + c.k * {a})) ELSE 0 END)"
_FROM = "FROM cell c JOIN cfgt t USING (fam, pcfg)"
_K2 = "sum(lgamma(c.n + 1.0 / c.k) - lgamma(1.0 / c.k) + (lgamma(1.0) - lgamma(t.total + 1.0)) / c.k)"
_PAIR = " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, x{i} AS a, x{j} AS b, sum(w) AS n FROM cfg GROUP BY ALL" for i, j in combinations(range(5), 2))
_MI = f"WITH {X.SQL}, pr AS ({_PAIR}), m AS (SELECT *, sum(n) OVER (PARTITION BY i, j, a) AS na, sum(n) OVER (PARTITION BY i, j, b) AS nb, sum(n) OVER (PARTITION BY i, j) AS t FROM pr), mi AS (SELECT i, j, greatest(0, sum(n / t * ln(n * t / (na * nb)))) AS mi, max(t) AS t FROM m GROUP BY i, j)"


def _triples(tests) -> str:
    cells = " UNION ALL ".join(f"SELECT {r} AS req, {X.index_sql(z)} AS z, x{i} AS a, x{j} AS b, sum(w) AS n FROM cfg GROUP BY ALL" for r, (i, j, z) in enumerate(tests))
    return f"WITH {X.SQL}, tr AS ({cells}), m AS (SELECT *, sum(n) OVER (PARTITION BY req, z, a) AS na, sum(n) OVER (PARTITION BY req, z, b) AS nb, sum(n) OVER (PARTITION BY req, z) AS nz, sum(n) OVER (PARTITION BY req) AS t FROM tr)"


def _table(given: tuple[int, ...], new: tuple[int, ...], add: float) -> str:
    q, k = X.size(given), X.size(new)
    return f"WITH {X.SQL}, g AS (SELECT a.p AS pcfg, b.c AS ncfg FROM range({q}) a(p), range({k}) b(c)), n AS (SELECT {X.index_sql(given)} AS pcfg, {X.index_sql(new)} AS ncfg, sum(w) AS n FROM cfg GROUP BY ALL), f AS (SELECT pcfg, ncfg, coalesce(n, 0) + {add} AS n FROM g LEFT JOIN n USING (pcfg, ncfg)) SELECT pcfg, ncfg, round(n / sum(n) OVER (PARTITION BY pcfg), 6) AS p FROM f"


def _score(body: str) -> str:
    return f"{_FAM} SELECT fam, round({body}, 4) AS score {_FROM} GROUP BY fam"


_PAR = "max(c.q) * (max(c.k) - 1)"
_CRIT = {k: chi2_isf(0.05, k) for k in (1, 2)}
_HOT = [(v, s) for v in range(5) for s in range(1, X.CARDS[v])]
_SET = " UNION ALL ".join(f"SELECT {f} AS fam, {X.index_sql(s)} AS c, sum(w) AS n, {X.size(s)} AS q FROM cfg GROUP BY ALL" for f, s in enumerate(CLUSTERS))
_DM = f"WITH {X.SQL}, s AS ({_SET}), dm AS (SELECT fam, sum(lgamma(n + 1.0 / q) - lgamma(1.0 / q)) + lgamma(1.0) - lgamma(sum(n) + 1.0) AS score FROM s GROUP BY fam)"
_BOTH = "both_ AS (SELECT i, j, round(mi, 9) AS mi FROM mi UNION ALL SELECT j, i, round(mi, 9) FROM mi)"
_CPD = "SELECT c.var, c.pcfg, c.state, round((c.n + 1.0 / c.k) / (t.total + 1.0), 6) AS p FROM cell c JOIN cfgt t USING (fam, pcfg)"

SQL = {
    "encode_lineitem": "WITH c AS (SELECT f, row_number() OVER (ORDER BY f) - 1 AS flag FROM (SELECT DISTINCT l_returnflag AS f FROM lineitem)) SELECT flag::INT AS flag, year(l_shipdate)::INT AS year, least(floor(l_quantity / 10), 4)::INT AS qty, count(*) AS n FROM lineitem JOIN c ON f = l_returnflag GROUP BY ALL",
    "compress_configs": f"WITH {X.SQL} SELECT * FROM cfg",
    "joint_config_index": f"WITH {X.SQL} SELECT {X.index_sql(tuple(range(5)))} AS idx, w FROM cfg",
    "decode_config": f"WITH {X.SQL} SELECT {X.index_sql(tuple(range(5)))} AS idx, x0, x1, x2, x3, x4 FROM cfg",
    "family_counts": f"{_FAM} SELECT fam, pcfg, state, n FROM cnt",
    "log_likelihood": _score(_LL.format(a=1.0)),
    "bic_local": _score(f"{_LL.format(a=0.0)} - 0.5 * ln({_N}) * {_PAR}"),
    "aic_local": _score(f"{_LL.format(a=0.0)} - {_PAR}"),
    "k2_local": _score(_K2),
    "k2pen_bic": _score(f"{_K2} - 0.5 * ln({_N}) * {_PAR}"),
    "k2pen_aic": _score(f"{_K2} - {_PAR}"),
    "ebna_score": f"{_FAM} SELECT fam, round({_LL.format(a=1.0)} - 0.5 * ln({_N}) * {_PAR}, 4) AS score {_FROM} WHERE t.total > 0 GROUP BY fam",
    "structure_score": f"{_NET}, s AS (SELECT fam, {_LL.format(a=0.0)} - 0.5 * ln({_N}) * {_PAR} AS score {_FROM} GROUP BY fam) SELECT round(sum(score), 3) AS score FROM s",
    "weighted_k2_local": f"WITH {X.WEIGHTED_SQL}, {X.families_sql()} SELECT fam, round({_K2}, 3) AS score {_FROM} GROUP BY fam",
    "dirichlet_ml": f"{_DM} SELECT fam, round(score, 4) AS score FROM dm",
    "bdeu_variable_clusters_first_merge": f"{_DM}, nm AS (SELECT * FROM (VALUES {', '.join(f'({f}, {s[0]}, {s[-1]})' for f, s in enumerate(CLUSTERS))}) v(fam, i, j)), s2 AS (SELECT * FROM dm JOIN nm USING (fam)) SELECT p.i, p.j, round(p.score - a.score - b.score, 3) AS log_bf FROM s2 p JOIN s2 a ON a.i = p.i AND a.j = p.i JOIN s2 b ON b.i = p.j AND b.j = p.j WHERE p.i < p.j ORDER BY 3 DESC, 1, 2 LIMIT 1",
    "marginals_uni": f"WITH {X.SQL}, u AS (" + " UNION ALL ".join(f"SELECT {i} AS i, x{i} AS a, sum(w) AS n FROM cfg GROUP BY ALL" for i in range(5)) + ") SELECT i, a, round(n / sum(n) OVER (PARTITION BY i), 6) AS p FROM u",
    "marginals_bi": f"{_MI}, g AS (SELECT * FROM (VALUES {', '.join(f'({i}, {j}, {a}, {b})' for i, j in combinations(range(5), 2) for a in range(X.CARDS[i]) for b in range(X.CARDS[j]))}) v(i, j, a, b)), f AS (SELECT i, j, a, b, coalesce(n, 0) + 1 AS n FROM g LEFT JOIN pr USING (i, j, a, b)) SELECT i, j, a, b, round(n / sum(n) OVER (PARTITION BY i, j), 6) AS p FROM f",
    "mi_nats": f"{_MI} SELECT i, j, round(mi, 6) AS mi FROM mi",
    "mi_bits": f"{_MI} SELECT i, j, round(mi / ln(2), 6) AS mi FROM mi",
    "cmi_single": f"{_triples(TRIPLES)} SELECT req, round(greatest(0, sum(n / t * ln(n * nz / (na * nb)))), 6) AS cmi FROM m GROUP BY req",
    "cmi_set": f"{_triples(SETS)} SELECT req, round(greatest(0, sum(CASE WHEN nz > 1 THEN n / t * log2(n * nz / (na * nb)) ELSE 0 END)), 6) AS cmi FROM m GROUP BY req",
    "chi2_marginal": f"{_triples([(i, j, ()) for i, j in combinations(range(5), 2)])}, s AS (SELECT req, sum(n * n * t / (na * nb)) - max(t) AS s FROM m GROUP BY req), k AS (SELECT * FROM (VALUES {', '.join(f'({r}, {(X.CARDS[i] - 1) * (X.CARDS[j] - 1)})' for r, (i, j) in enumerate(combinations(range(5), 2)))}) v(req, dof)) SELECT req, round(s, 3) AS statistic, dof, s < CASE dof WHEN 1 THEN {_CRIT[1]!r} ELSE {_CRIT[2]!r} END AS independent FROM s JOIN k USING (req)",
    "chi2_conditional": f"{_triples(TRIPLES)}, s AS (SELECT req, z, sum(n * n * nz / (na * nb)) - max(nz) AS s, (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS d FROM m GROUP BY req, z) SELECT req, round(sum(CASE WHEN d > 0 THEN s ELSE 0 END), 3) AS statistic, sum(d)::INT AS dof FROM s GROUP BY req",
    "g_test": f"{_MI} SELECT i, j, round(2 * t * mi, 3) AS g FROM mi",
    "chi2_df1": f"{_MI} SELECT i, j, 2 * t * mi > {_CRIT[1]!r} AS dependent FROM mi",
    "mi_threshold_pairs": f"{_MI} SELECT i, j FROM mi WHERE 2 * t * mi > CASE WHEN i = 4 OR j = 4 THEN {_CRIT[2]!r} ELSE {_CRIT[1]!r} END",
    "mi_topk_mask": f"{_MI}, {_BOTH}, r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY mi DESC, j) AS r FROM both_ WHERE mi > 0) SELECT DISTINCT least(i, j) AS i, greatest(i, j) AS j FROM r WHERE r <= 2",
    "k_neighbors": f"{_MI.replace('ln(n * t', 'log2(n * t')}, {_BOTH}, mn AS (SELECT avg(round(mi, 9)) AS m FROM mi WHERE round(mi, 9) > 0), r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY mi DESC, j)::INT AS r FROM both_ WHERE mi >= 1.5 * (SELECT m FROM mn)) SELECT i, j, r FROM r WHERE r <= 2",
    "dependency_graph": f"{_MI}, e AS (SELECT i, j, (mi / ln(2) > 0.05)::INT AS edge FROM mi) SELECT i, j, edge FROM e UNION ALL SELECT j, i, edge FROM e UNION ALL SELECT v::INT, v::INT, 1 FROM range(5) r(v)",
    "mle_cpd": f"{_NET} {_CPD}",
    "mle_cpd_weighted": f"WITH {X.WEIGHTED_SQL}, {X.families_sql(X.NETWORK)} {_CPD}",
    "clique_table": _table((1,), (2, 4), 1 / 6),
    "fda_table": _table((0, 4), (3,), 1.0),
    "moa_table": _table((0, 2), (1,), 1.0),
    "gram_matrix": f"WITH {X.SQL}, h AS (SELECT w, [" + ", ".join(f"x{v} = {s}" for v, s in _HOT) + f"] AS h FROM cfg), p AS (SELECT a.v AS i, b.v AS j FROM range({len(_HOT)}) a(v), range({len(_HOT)}) b(v)) SELECT i::INT AS i, j::INT AS j, sum(w) AS g FROM h, p WHERE h[i + 1] AND h[j + 1] GROUP BY ALL",
    "smoothness_laplacian": f"WITH {X.SQL}, z AS (" + " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, sum(w * (x{i} - x{j}) * (x{i} - x{j})) / sum(w) AS z FROM cfg" for i in range(5) for j in range(5) if i != j) + "), wt AS (SELECT i, j, greatest(0, 0.9 - z / 0.8) AS w FROM z) SELECT i, j, round(-w, 6) + 0.0 AS l FROM wt UNION ALL SELECT i, i, round(sum(w), 6) FROM wt GROUP BY i",
}
