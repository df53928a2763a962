from functools import lru_cache

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from tallygrid.operators import schema_drift as D
from tallygrid.operators.ordered import before


def flat(*fields):
    return D.Node("", "", "struct", tuple(D.Node(n, i, k) for n, i, k in fields))


def kinds(old, new):
    return [(c.kind, c.identity) for c in D.edit_script(old, new)]


def test_flat_scripts():
    a = flat(("n", "n", "whole"), ("f1", "f1", "decimal"), ("x", "x", None))
    assert kinds(a, a) == []
    assert kinds(a, flat(("N", "n", "decimal"), ("f1", "f1", None), ("y", "y", "text"))) == [("added", "y"), ("removed", "x"), ("renamed", "n"), ("retyped", "n")]
    assert kinds(flat(), a) == [("added", "f1"), ("added", "n"), ("added", "x")]
    assert kinds(flat(), flat()) == []
    assert kinds(flat(("a", "a", "1"), ("b", "b", "1"), ("c", "c", "1")), flat(("c", "c", "1"), ("a", "a", "1"), ("b", "b", "1"))) == [("moved", "c")]


def test_nested_scripts(spark):
    s = lambda t: D.node_of("", T._parse_datatype_string(t))
    assert kinds(s("struct<a:int,b:struct<c:int,d:string>>"), s("struct<a:bigint,b:struct<d:string>>")) == [("removed", "c"), ("retyped", "a")]
    assert ("moved", "c") in kinds(s("struct<a:int,b:struct<c:int,d:string>>"), s("struct<a:int,c:int,b:struct<d:string>>"))
    assert kinds(s("struct<a:struct<b:int>>"), s("struct<a:string>")) == [("removed", "b"), ("retyped", "a")]


trees = st.recursive(st.builds(lambda n, k: (n, k, ()), st.sampled_from("abc"), st.sampled_from("xy")), lambda c: st.builds(lambda n, k, cs: (n, k, tuple(cs)), st.sampled_from("abcd"), st.sampled_from("xy"), st.lists(c, max_size=3, unique_by=lambda t: t[0])), max_leaves=5)


@settings(max_examples=150, deadline=None)
@given(trees, trees)
def test_distance_equals_the_plain_recursion(one, two):
    """Against the recursion over forests that has no tricks."""

    def size(f):
        return sum(1 + size(t[2]) for t in f)

    @lru_cache(None)
    def d(f, g):
        if not f or not g:
            return size(f) + size(g)
        (n1, k1, c1), (n2, k2, c2) = f[-1], g[-1]
        return min(d(f[:-1] + c1, g) + 1, d(f, g[:-1] + c2) + 1, d(c1, c2) + d(f[:-1], g[:-1]) + (3 if n1 != n2 else int(k1 != k2)))

    def sort(t):
        return t[0], t[1], tuple(sorted((sort(c) for c in t[2]), key=lambda c: c[0]))

    def node(t):
        return D.Node(t[0], t[0], t[1], tuple(map(node, t[2])))

    assert D.distance(node(one), node(two)) == d((sort(one),), (sort(two),))


def test_before_spans_partitions(spark):
    rows = [("hot" if i % 3 else f"k{i % 7}", i * 17 % 1009, i) for i in range(900)]
    got = {r.v: r.p for r in before(spark.createDataFrame(rows, "k string, o int, v int"), "k", ["o"], "v", "p").collect()}
    want = {}
    for k in {r[0] for r in rows}:
        own = sorted((o, v) for kk, o, v in rows if kk == k)
        want |= {v: (own[i - 1][1] if i else None) for i, (_, v) in enumerate(own)}
    assert got == want


def test_running_sums_span_partitions(spark):
    from tallygrid.operators.ordered import running

    rows = [("hot" if i % 3 else f"k{i % 7}", i * 17 % 1009, i % 5) for i in range(900)]
    got = {(r.k, r.o): r.up for r in running(spark.createDataFrame(rows, "k string, o int, n int"), ["k"], "o", "n", "up").collect()}
    assert got == {(k, o): sum(n for kk, oo, n in rows if kk == k and oo <= o) for k, o, _ in rows}


def test_first_rows_are_those_of_a_sort(spark):
    from pyspark.sql import functions as F

    from tallygrid.operators.ordered import first_k

    df = spark.createDataFrame([(i * 37 % 50, i) for i in range(500)], "f int, id int").repartition(6)
    for k in (0, 1, 123, 900):
        got = sorted((r.f, r.id) for r in first_k(df, [F.desc("f"), F.asc("id")], k).collect())
        assert got == sorted(sorted(((i * 37 % 50, i) for i in range(500)), key=lambda t: (-t[0], t[1]))[:k])


BATCHES = "batch_id bigint, stream string, exported_at timestamp, delimiter string, header string, n_lines int"
LINES = "batch_id bigint, line_no int, line string"


def frames(spark, batches, lines, names=(("nsel", "n_selected"), ("n_selected", "n_selected"))):
    from datetime import datetime

    made = [(b, s, datetime(2024, 1, day), d, h, 0) for b, s, day, d, h in batches]
    return spark.createDataFrame(made, BATCHES), spark.createDataFrame(lines, LINES), spark.createDataFrame(list(names), "known_name string, field string")


def test_batches_against_the_one_before(spark):
    f = frames(
        spark,
        [(1, "s", 2, ",", ' "nsel" ,f1,z'), (2, "s", 1, ";", "n_selected;f1"), (3, "s", 3, "\t", "f1\tnsel"), (4, "t", 1, ",", "f1"), (5, "t", 2, ",", None), (6, "t", 3, ",", "g")],
        [(1, 1, '1,"2", '), (1, 2, "3,NA,x"), (2, 1, "1.5;7"), (2, 1, "1.5;7"), (3, 1, "1e3\t?"), (4, 1, None), (4, 2, "a")],
    )
    got = {(r.batch_id, r.field, r.change_kind) for r in D.batch_changes(D.batch_schemas(*f)).collect() if r.change_kind != "moved"}
    assert got == {(1, "n_selected", "renamed"), (1, "n_selected", "retyped"), (1, "z", "added"), (3, "f1", "retyped"), (3, "z", "removed")}


def test_one_table_from_all_batches(spark):
    f = frames(spark, [(1, "s", 1, ",", "nsel,f1,z"), (2, "s", 2, ";", "f1;n_selected")], [(1, 1, "4,0.5,q"), (1, 1, "4,0.5,q"), (2, 1, "bad;5"), (2, 2, None)])
    got = sorted(tuple(r) for r in D.unified_lines(*f, {"n_selected": "bigint", "f1": "double"}).collect())
    assert got == [(1, 1, 4, 0.5, {"z": "q"}), (2, 1, 5, None, {}), (2, 2, None, None, {})]


def test_empty_batches(spark):
    f = frames(spark, [], [])
    assert D.batch_changes(D.batch_schemas(*f)).count() == 0
    assert D.unified_lines(*f, {"a": "string"}).count() == 0


def test_files_with_drifting_schemas(spark, tmp_path):
    spark.createDataFrame([(1, ("a", 2))], "id int, s struct<name:string,n:int>").write.parquet(str(tmp_path / "a"))
    spark.createDataFrame([(("b",), 5.5, 3)], "S struct<name:string>, extra double, id bigint").write.parquet(str(tmp_path / "b"))
    table, changes = D.read_consistent(spark, [[str(tmp_path / "a")], [str(tmp_path / "b")]], str.lower)
    assert sorted(map(tuple, table.collect()), key=str) == [(1, ("a", 2), None), (3, ("b", None), 5.5)]
    assert {(c.kind, c.identity) for c in changes[0]} >= {("added", "extra"), ("removed", "n"), ("renamed", "s"), ("retyped", "id")}


def test_rows_follow_the_script(spark):
    """Without a step of the script the rows are others: the projection is what the script compiles to."""
    f = frames(spark, [(1, "s", 1, ",", "nsel,f1,z")], [(1, 1, "4,0.5,q")])
    target = {"n_selected": "bigint", "f1": "double", "edges": "double"}

    def rows(*left_out):
        script = lambda a, b: [c for c in D.edit_script(a, b) if c.kind not in left_out]
        return [tuple(r) for r in D.unified_lines(*f, target, script=script).collect()]

    assert rows() == [(1, 1, 4, 0.5, None, {"z": "q"})]
    assert rows("renamed") == [(1, 1, None, 0.5, None, {"z": "q"})]
    assert rows("retyped") == [(1, 1, None, None, None, {"z": "q"})]
    assert rows("removed") == [(1, 1, 4, 0.5, None, {})]


def test_compiled_scripts(spark):
    have = T._parse_datatype_string("a:int,s:struct<b:string,c:struct<d:int>,gone:int>,l:array<struct<x:int,y:string>>,m:map<string,int>,big:struct<q:int>")
    want = T._parse_datatype_string("d:bigint,s:struct<c:struct<a:int>,b:string,fresh:struct<n:int>>,l:array<struct<y:string,x:string,z:int>>,m:map<string,string>,big:string")
    df = spark.createDataFrame([(1, ("u", (2,), 3), [(4, "v"), None], {"k": 5}, (6,)), (None, None, None, None, None), (7, None, [], {}, (None,))], have)
    got = df.select(*D.projection(have, want))
    assert [f.dataType.simpleString() for f in got.schema.fields] == [f.dataType.simpleString() for f in want.fields] and got.columns == want.names
    rows = [tuple(r) for r in got.collect()]
    assert rows[0] == (2, ((1,), "u", None), [("v", "4", None), None], {"k": "5"}, '{"q":6}')
    assert rows[1] == (None, None, None, None, None)
    # a field that was moved into a struct which isn't there brings the struct about
    assert rows[2] == (None, ((7,), None, None), [], {}, "{}")


def test_repeated_identities_at_several_places(spark):
    s = lambda t: D.node_of("", T._parse_datatype_string(t))
    old, new = s("struct<a:struct<n:int,k:int>,b:struct<n:int,k:int>>"), s("struct<a:struct<k:int>,b:struct<k:int>>")
    assert [(c.kind, c.at) for c in D.edit_script(old, new)] == [("removed", ("a", "n")), ("removed", ("b", "n"))]


def planned(f):
    return (f.name, f.kind, tuple(map(planned, f.children)))


@settings(max_examples=200, deadline=None)
@given(trees, trees)
def test_applied_scripts_give_the_new_tree(one, two):
    def node(t):
        return D.Node(t[0].upper() if t[1] == "y" else t[0], t[0], t[1], tuple(map(node, t[2])))

    def plain(n):
        return (n.name, n.kind, tuple(map(plain, n.children)))

    a, b = D.Node("", "", "struct", (node(one),)), D.Node("", "", "struct", (node(two),))
    assert planned(D.apply_script(a, D.edit_script(a, b))) == plain(b)
