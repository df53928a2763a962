"""Queries give whole results: no cell, value or record is left out."""

import numpy as np

from tallygrid.operators import sampling
from tallygrid.plans import hygiene
from tallygrid.sources import files


def test_unified_table_keeps_every_cell(spark, tmp_path):
    for name, rows, schema in (
        ("tidy_batches", [(1, "s", ",", "nsel,f1,z"), (2, "s", ";", "f1;edges;q")], "batch_id bigint, stream string, delimiter string, header string"),
        ("tidy_lines", [(1, 1, "352k,0.5,u"), (1, 1, "352k,0.5,u"), (1, 2, "4,NA,?"), (2, 1, ' bad ;"0x48";w')], "batch_id bigint, line_no int, line string"),
        ("field_names", [("nsel", "n_selected")], "known_name string, field string"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    got = sorted((r.batch_id, r.line_no, r.n_selected, r.f1, r.edges, r.raw, r.other_cells, r.others) for r in hygiene.p2_unified(spark, str(tmp_path)).collect())
    assert got == [
        (1, 1, None, 0.5, None, {"n_selected": "352k"}, {"z": "u"}, 1),
        (1, 2, 4.0, None, None, {}, {"z": None}, 1),
        (2, 1, None, None, None, {"f1": "bad", "edges": "0x48"}, {"q": "w"}, 1),
    ]


def test_copula_draws_from_the_whole_column(spark):
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.normal(size=500), np.where(rng.random(500) < 0.5, 0.0, rng.normal(size=500))])
    model = sampling.fit_copula_frame(spark.createDataFrame(x.tolist(), "a double, b double"), ["a", "b"])
    got = sampling.sample_copula(spark, model, 4000, seed=2).orderBy("id").toPandas()
    assert len(got) == 4000 and got.x0.nunique() > 450 and got.x0.min() < np.sort(x[:, 0])[3]
    same = sampling.sample_copula(spark, {"corr": model["corr"], "sorted": np.sort(x, axis=0)}, 4000, seed=2).orderBy("id").toPandas()
    assert got.equals(same)


def test_tidy_rows_of_all_records_of_a_file(spark):
    one, two = "0.5 1 -1 2 0.1 -3 4 0.3 -5 6 0.5", "0.6 1 -1 2 0.2 -3 4 0.4 -5 6 0.8"
    rows = [("eval_P_60_tr1_k2_T0.5_s7.dat", f"# edges=4\n{one}\n1 2\n\n{two}\r\n{two}"), ("eval_P_60_tr0_k2_T0.5_s7.dat", "# none\n"), ("log", one)]
    got = sorted((r.line_no, r.edges, r.f1, r.train_sp, round(r.test_sp, 9)) for r in files.tidy_results(spark.createDataFrame(rows, "path string, content string")).collect())
    assert got == [(2, 4.0, 0.5, 0.3, 0.3), (5, 4.0, 0.6, 0.4, 0.5), (6, 4.0, 0.6, 0.4, 0.5)]


def test_changes_around_a_null_header(spark, tmp_path):
    for name, rows, schema in (
        ("tidy_batches", [(1, "t", 1, ",", "f1"), (2, "t", 2, ",", None), (3, "t", 3, ",", "g"), (4, "u", 1, ",", None), (5, "u", 2, ",", "h")], "batch_id bigint, stream string, exported_at int, delimiter string, header string"),
        ("tidy_lines", [(1, 1, "0.5")], "batch_id bigint, line_no int, line string"),
        ("field_names", [("f1", "f1")], "known_name string, field string"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert {tuple(r) for r in hygiene.p2_found(spark, str(tmp_path)).collect()} == {(2, "f1", "removed"), (3, "g", "added"), (5, "h", "added")}
