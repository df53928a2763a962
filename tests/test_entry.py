import importlib
import sys

import pytest

import __spark_entry__ as entry


def test_queries_and_their_sql():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 100
    assert all(callable(f) for f in queries.values())


def test_names_can_be_read_without_a_session():
    import subprocess

    code = "import __spark_entry__ as e; assert len(e.queries()) > 100 and e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], cwd=entry.__file__.rsplit("/", 1)[0], capture_output=True, timeout=120).returncode == 0


def test_the_rest_stands_without_the_optional_subpackage(monkeypatch):
    class Absent:
        def find_spec(self, name, path=None, target=None):
            if name.startswith("tallygrid.llm"):
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    for name in [m for m in sys.modules if m.startswith("tallygrid.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(sys, "meta_path", [Absent(), *sys.meta_path])
    assert "p1_found" in entry.queries() and "p6_found" not in entry.queries()


@pytest.mark.parametrize("name", ["p1_found", "p2_found", "p4_found", "k2_local", "chow_liu_tree", "edge_metrics"])
def test_queries_equal_their_sql(spark, name):
    from collections import Counter

    import duckdb

    compare = importlib.import_module("compare")
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("lineitem", "result_files", "tidy_batches", "tidy_lines", "field_names", "raw_lines", "problem_structures"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    df = entry.queries()[name](spark, d)
    ask = con.execute(entry.oracle_sql()[name])
    names = [x[0] for x in ask.description]
    assert Counter(tuple(compare.cell(r[c]) for c in names) for r in df.collect()) == Counter(tuple(map(compare.cell, r)) for r in ask.fetchall())


@pytest.mark.parametrize("kept, n_rows", [("x4 = x0", 5), ("x0 = 0 AND x1 = 0 AND x2 = 0 AND x3 = 0", 0)])
def test_edges_of_a_tree_that_reaches_x4_or_has_none(spark, tmp_path, kept, n_rows):
    from collections import Counter

    import duckdb

    from tallygrid.plans import fixture

    spark.range(6000).selectExpr("id AS l_orderkey", "id * 3 AS l_partkey", "CAST(1 AS INT) AS l_linenumber").write.parquet(str(tmp_path / "all" / "lineitem.parquet"))
    fixture.rows(spark, str(tmp_path / "all")).filter(kept).select("l_orderkey", "l_partkey", "l_linenumber").write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.execute(entry.oracle_sql()["edge_operations"]).fetchall()
    got = entry.queries()["edge_operations"](spark, str(tmp_path)).collect()
    assert len(got) == n_rows and Counter(map(tuple, got)) == Counter(want)
