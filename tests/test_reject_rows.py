import csv

from hypothesis import given, settings
from hypothesis import strategies as st

from tallygrid.operators import reject_rows as R


def by_characters(line):
    """The quoting rules told character by character."""
    fields, i = [], 0
    while True:
        if i < len(line) and line[i] == '"':
            i, text = i + 1, ""
            while True:
                if i >= len(line):
                    return None
                if line[i] == '"':
                    if line[i + 1 : i + 2] == '"':
                        text, i = text + '"', i + 2
                        continue
                    i += 1
                    break
                text, i = text + line[i], i + 1
            if i < len(line) and line[i] != ",":
                return None
        else:
            end = line.find(",", i)
            text = line[i:] if end < 0 else line[i:end]
            if '"' in text:
                return None
            i += len(text)
        fields.append(text)
        if i >= len(line):
            return fields
        i += 1


@settings(max_examples=600, deadline=None)
@given(st.lists(st.text(alphabet='",a 1\r\n\x00é', max_size=12), min_size=1, max_size=5))
def test_fields_equal_the_character_rules(lines):
    assert list(R.read_batch(lines)) == [by_characters(x) for x in lines]


def reason(line, layout):
    return R.judge(next(R.read_batch([R.bare(line)])), R.LAYOUTS.get(layout))[0]


def test_reasons():
    mood = {"0,1,0,0,0,0,1": None, "0,6,0,0,0,0,1\r": None, "﻿0, 1 ,\t0,0,0,0,1": None, '"0","1",0,0,0,0,01': None, "0,7,0,0,0,0,1": "invalid_value", "0,1,0,0,0,0": "column_count", "": "column_count", "+1,1,0,0,0,0,1": "invalid_value", "٣,1,0,0,0,0,1": "invalid_value", '0,"1,0,0,0,0,1': "quoting", '0,"1"x,0,0,0,0,1': "quoting", '0,1 "a",0': "quoting", "9" * 60 + ",1,0,0,0,0,1": "invalid_value"}
    runs = {"p,a,1,0.5,2,n": None, 'p,a,1,1,.5e1,"x, ""y"""': None, " ,a,1,0.5,2,n": "invalid_value", "p,a,-1,0.5,2,n": "invalid_value", "p,a,1,1.01,2,n": "invalid_value", "p,a,1,nan,2,n": "invalid_value", "p,a,1,0.5,inf,n": "invalid_value", "p,a,1,0.5,1e999,n": "invalid_value", "p,a,1,0.5,-0,n": None, "p,a,1,0.5,.,n": "invalid_value", "p,a,1,0.5,2": "column_count", "p,a," + "9" * 40 + ",0.5,2,n": None}
    for lines, layout in ((mood, "mood"), (runs, "runs")):
        assert {x: reason(x, layout) for x in lines} == lines


def test_assembled_records():
    lines = ["a,b", '1,"x', "y", 'z",2', '"open', "end"]
    got = list(R.assemble(lines))
    assert got == [(0, "a,b"), (1, '1,"x\ny\nz",2'), (4, '"open\nend')]
    assert R.split_strict(got[1][1]) == ["1", "x\ny\nz", "2"]
    try:
        R.split_strict(got[2][1])
    except csv.Error:
        return
    raise AssertionError


def test_table(spark):
    rows = [(1, "mood", "0,1,0,0,0,0,1", 7), (1, "mood", "0,1,0,0,0,0,1", 7), (2, "runs", "p,a,1,0.5,2,n", None), (3, None, "x", 1), (4, "mood", None, 1), (5, "runs", "x" * 300_000, 1), (6, "what", "x", 1)]
    df = spark.createDataFrame(rows, "line_id bigint, layout string, line string, reason int")
    parsed = R.parse_lines(df, keep=["line_id"]).cache()
    assert sorted((r.line_id, r.reason) for r in R.rejected(parsed).collect()) == [(3, "unknown_layout"), (4, "column_count"), (5, "column_count"), (6, "unknown_layout")]
    assert [tuple(r) for r in R.loaded(parsed, "mood", ["line_id"]).collect()] == [(1, 0, 1, 0, 0, 0, 0, 1)] * 2
    assert [tuple(r) for r in R.loaded(parsed, "runs", ["line_id"]).collect()] == [(2, "p", "a", "1", 0.5, 2.0, "n")]
    assert R.rejected(R.parse_lines(df.limit(0), keep=["line_id"])).count() == 0


def test_seeds_of_any_length_stay_what_they_are(spark, tmp_path):
    seeds = ["0", "007", str(10**18), "1234567890123456789", str(2**63 - 1), str(2**63), "98765432109876543210", "9" * 60]
    lines = [(i, "runs", f"P,k2,{s},0.5,1,n") for i, s in enumerate(seeds)]
    spark.createDataFrame(lines, "line_id bigint, layout string, line string").write.parquet(str(tmp_path / "raw_lines.parquet"))
    from tallygrid.plans import hygiene

    got = hygiene.p4_runs(spark, str(tmp_path)).orderBy("line_id").collect()
    assert [r.seed_digits for r in got] == [s.lstrip("0") or "0" for s in seeds]
    assert [r.seed for r in got] == [int(s) if int(s) < 2**63 else None for s in seeds]
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW raw_lines AS SELECT * FROM '{tmp_path}/raw_lines.parquet/*.parquet'")
    assert sorted(con.execute(f"SELECT seed, seed_digits FROM ({hygiene.SQL['p4_runs']})").fetchall(), key=str) == sorted([(r.seed, r.seed_digits) for r in got], key=str)
