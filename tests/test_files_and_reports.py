import math

import pytest
from pyspark.sql import functions as F

from tallygrid.operators import evaluation as E
from tallygrid.operators.counting import Family
from tallygrid.sources import files, r_network
from tallygrid.streaming.counts import streaming_family_counts

SOURCE = '''
# a small network
n_states <- c("no", "yes")   # states
p <- c(0.2, 0.8)
Rain.lv <- rep(c("no", "yes"), 1)
Rain <- array(p, dim = 2, dimnames = list(Rain = n_states))
Wet.Grass <- array(c(round(0.9 * 1, 2), 1/10, 2 - 1.75, 3 * 0.25,
    NA, 0, 1, 3), dim = c(2, 2, 2),
    dimnames = list(`Wet Grass` = n_states, Rain = Rain.lv, Sprinkler = c("a", "b")))
model <- model2network("[Rain][Sprinkler|Rain][Wet Grass|Rain:Sprinkler][Alone]")
cpt <- custom.fit(model, list(Rain = Rain))
'''


def test_network_source():
    d = r_network.parse_network(SOURCE, "rain")
    assert d.variables == ["Rain", "Sprinkler", "Wet Grass", "Alone"] and d.tables.cards == (2, 2, 2, 2)
    assert d.tables.probs[0].tolist() == [[0.2, 0.8]] and d.tables.probs[1].tolist() == [[0.5, 0.5]] * 2
    assert d.tables.parents[2] == (0, 1)
    assert [[pytest.approx(x) for x in row] for row in d.tables.probs[2]] == [[0.9, 0.1], [0.25, 0.75], [0.5, 0.5], [0.25, 0.75]]
    with pytest.raises(ValueError):
        r_network.parse_network("x <- 1")
    with pytest.raises(ValueError):
        r_network.parse_network('model2network("[A|B][B|A]")')
    assert r_network._Reader("sum(c(1, 2:4)) / 2 - -1", {}).whole().tolist() == [6.0]
    with pytest.raises(r_network.NotUnderstood):
        r_network._Reader("system('x')", {}).whole()


def test_network_sources_as_rows(spark):
    rows = r_network.network_rows(spark.createDataFrame([("rain", SOURCE), ("bad", "x"), ("none", None)], "name string, text string"))
    assert rows.count() == 2 + 4 + 8 + 2
    assert rows.groupBy("var", "pcfg").agg(F.sum("p").alias("s")).filter("abs(s - 1) > 1e-9").count() == 0


def test_readers(spark, tmp_path):
    (tmp_path / "net_data_N20.csv").write_text("0,1,2\n1,x,0\n1,1\n 1 , 0,1\n\n")
    got = files.read_states(spark, files.find_data(str(tmp_path), "net", 99), 3)
    assert sorted((r.x0, r.x1, r.x2) for r in got.collect()) == [(0, 1, 2), (1, 0, 1)]
    assert files.read_states(spark, str(tmp_path / "net_data_N20.csv"), 3, 1).count() == 1
    assert files.find_data(str(tmp_path), "other", 1) is None and files.find_data(str(tmp_path), "net", 20).endswith("N20.csv")
    (tmp_path / "m.json").write_text('{"name": "n", "n_vars": 2, "n_edges": 1, "n_samples": 5, "description": "d",\n "var_names": ["a", "b"], "cardinality": [2], "adjacency": [[0, 1], [0, 0]], "var_states": {"a": ["x", "y"]}}')
    meta = files.read_metadata(spark, str(tmp_path / "m.json"))
    assert [tuple(r) for r in files.metadata_edges(meta).collect()] == [("n", 0, 1)]
    assert sorted(tuple(r) for r in files.metadata_schema(meta).collect()) == [("n", 0, "a", 2, ["x", "y"]), ("n", 1, "b", 2, None)]
    (tmp_path / "p.dat").write_text("0 1 1 3.5 0\n1 0 0  -2e0 2\nbad line here\n")
    assert sorted((r.x, r.f, r.split) for r in files.read_population(spark, str(tmp_path / "p.dat")).collect()) == [([0, 1, 1], 3.5, 0), ([1, 0, 0], -2.0, 2)]
    (tmp_path / "Trap_4_structure.dat").write_text("2\n0 1\n2 3\n")
    assert sorted(tuple(r) for r in files.read_structure(spark, str(tmp_path / "Trap_4_structure.dat")).collect()) == [("Trap_4", 0, 1), ("Trap_4", 1, 0), ("Trap_4", 2, 3), ("Trap_4", 3, 2)]
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    files.write_table(df, str(tmp_path / "out"), ["c", "a"])
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "out"), header=True).collect()] == [("3", "1")]


def test_tidy_rows(spark):
    text = "# problem=P_60 n=60 edges=? n_selected=480\n# f1 time\n0.5 1 -1 2 0.1 -3 4 0.3 -5 nan 0.5\n"
    rows = files.tidy_results(spark.createDataFrame([("x/eval_P_60_tr1_k2_pen_T0.5_s7.dat", text), ("log", text), ("eval_Q_tr0_k2_T1_s1.dat", "# nothing\n"), (None, None)], "path string, content string")).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.problem, r.family, r.n, r.group, r.algorithm, r.temperature, r.train_set, r.seed, r.edges, r.n_selected) == ("P_60", "P", 60, "medium", "k2_pen", 0.5, 1, 7, None, 480.0)
    assert (r.train_sp, r.test1_sp, r.test2_sp) == (0.3, 0.1, 0.5) and r.test_sp == pytest.approx(0.3) and math.isnan(r.test2_kl)


def test_edge_measures(spark):
    learnt = spark.createDataFrame([("a", 0, 1), ("a", 2, 1), ("a", 3, 4), ("c", 0, 1)], "g string, src int, dst int")
    true = spark.createDataFrame([("a", 0, 1), ("a", 1, 2), ("a", 0, 5), ("b", 0, 1), ("c", 0, 1)], "g string, src int, dst int")
    got = {r.g: r for r in E.edge_metrics(learnt, true, ["g"]).collect()}
    assert (got["a"].directed_precision, got["a"].directed_recall) == (pytest.approx(1 / 3), pytest.approx(1 / 3))
    assert got["a"].skeleton_f1 == pytest.approx(2 / 3) and got["a"].shd == 3
    assert (got["b"].directed_precision, got["b"].directed_recall, got["b"].shd) == (1.0, 0.0, 1) and got["c"].directed_f1 == 1.0


def test_rank_statistics(spark):
    df = spark.createDataFrame([("g", 1.0, 1.0), ("g", 2.0, 4.0), ("g", 2.0, 9.0), ("g", 5.0, 16.0), ("k", 1.0, 1.0), ("k", 1.0, 2.0)], "g string, a double, b double")
    got = {r.g: r.rho for r in E.spearman(df, "a", "b", ["g"]).collect()}
    assert got["g"] == pytest.approx(0.9486832980505138) and (got["k"] is None or math.isnan(got["k"]))
    assert sorted(r["rank"] for r in E.average_ranks(df.filter("g = 'g'"), "a", ["g"]).collect()) == [1.0, 2.5, 2.5, 4.0]
    s, p = E.friedman([1.0, 2.0, 3.0], 10)
    assert s == pytest.approx(20) and p == pytest.approx(math.exp(-10))
    assert E.nemenyi(4, 24) == pytest.approx(2.569 * math.sqrt(20 / 144))
    with pytest.raises(ValueError):
        E.nemenyi(21, 5)
    w = E.boltzmann(df, "b", 1.0, []).agg(F.sum("weight").alias("s"), F.max("weight") / F.min("weight")).first()
    assert w[0] == pytest.approx(1) and w[1] == pytest.approx(math.e)
    assert r"\textbf{0.500}" in E.latex_table([{"m": "a_b", "v": 0.5}, {"m": "c", "v": None}], ["m", "v"], "v")


def test_counts_over_a_stream(spark, tmp_path):
    rows = [(0, 1, "2024-01-01 00:10:00"), (1, 1, "2024-01-01 00:20:00"), (1, 9, "2024-01-01 00:30:00"), (1, 0, "2024-01-02 05:00:00"), (None, 0, "2024-01-02 05:00:00")]
    df = spark.createDataFrame(rows, "a int, b int, t string").withColumn("t", F.to_timestamp("t"))
    df.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streaming_family_counts(stream, ["a", "b"], (2, 2), [Family(1, (0,))]).writeStream.outputMode("complete").format("memory").queryName("plain").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(tuple(r) for r in spark.table("plain").collect()) == [(0, 0, 1, 1.0), (0, 1, 0, 1.0), (0, 1, 1, 1.0)]
    q = streaming_family_counts(stream, ["a", "b"], (2, 2), [Family(0)], "t", "1 day").writeStream.outputMode("update").format("memory").queryName("windowed").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("windowed").groupBy("window").agg(F.max("n")).count() == 2
