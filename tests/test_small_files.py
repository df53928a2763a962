import random
import zlib

import pytest
import zstandard

from tallygrid.operators import run_records, small_files

SCHEMA = "file_id bigint, path string, content binary"
NUMBERS = "1 2 3 4 5 6 7 8 9 10 11"
RUN = "a/eval_P_8_tr0_k2_T1.0_s1.dat"


def pack(spark, rows, **options):
    return small_files.pack_files(spark.createDataFrame(rows, SCHEMA), **options)


def test_every_file_comes_out_once_and_unchanged(spark):
    rng = random.Random(1)
    rows = [(i, f"p{i}", bytes(rng.randrange(256) for _ in range(rng.randrange(400)))) for i in range(300)]
    rows += [(300, "none", None), (301, "empty", b""), (302, "open", b"no end"), (None, "x", b"1\n"), (None, "y", b"1\n"), (None, "x", b"1\n"), (5, "p5", rows[5][2]), (5, "p5", b"other bytes")]
    bundles = pack(spark, rows, target_bytes=4000).cache()
    got = small_files.members(bundles).collect()
    want = {(i, p, c or b"") for i, p, c in rows}
    assert len(got) == len(want)
    assert {(r.file_id, r.path, bytes(r.content)) for r in got} == want
    assert all(r.intact for r in got)
    sizes = [r.n_bytes for r in bundles.collect()]
    assert len(sizes) < 40 and max(sizes) < 6000


def test_a_changed_byte_is_noticed(spark):
    bundles = pack(spark, [(1, "a", b"abc\n"), (2, "b", b"def\n")])
    from pyspark.sql import functions as F

    bad = bundles.withColumn("payload", F.overlay("payload", F.lit(b"X"), F.lit(1)))
    assert not all(r.intact for r in small_files.members(bad).collect())


def test_headers_are_written_once_for_each_kind(spark):
    rows = [(i, f"p{i}", b"h1,h2\n%d,%d\n" % (i, i)) for i in range(20)] + [(100 + i, f"q{i}", b"other\n%d" % i) for i in range(5)]
    for b in pack(spark, rows, header_lines=1).collect():
        assert bytes(b.payload).count(bytes(b.header)) == 1 and bytes(b.payload).startswith(bytes(b.header))


@pytest.mark.parametrize("kind", ["lines", "zstd"])
def test_written_files_hold_the_bytes(spark, tmp_path, kind):
    bodies = [b"line %d\nlast of %d" % (i, i) + b"\n" * (i % 2) for i in range(50)]
    content = bodies if kind == "lines" else [zstandard.compress(b) for b in bodies]
    bundles = pack(spark, [(i, f"p{i}", c) for i, c in enumerate(content)], target_bytes=500).cache()
    out = str(tmp_path / "out")
    small_files.write_bundles(bundles, out, kind)
    assert small_files.check_written(spark, bundles, out, kind).count() == 0
    files = sorted((tmp_path / "out").glob("part-*"))
    assert len(files) == bundles.count() > 1
    if kind == "zstd":
        whole = b"".join(zstandard.ZstdDecompressor().stream_reader(f.read_bytes(), read_across_frames=True).read() for f in files)
        assert sorted(whole) == sorted(b"".join(bodies))
    else:
        assert sorted(zlib.crc32(f.read_bytes()) for f in files) == sorted(r.crc for r in bundles.collect())


def test_empty_table_and_clashing_columns(spark):
    assert pack(spark, []).count() == 0
    df = spark.createDataFrame([(1, "p", b"x\n", "k", 3)], SCHEMA + ", _key string, crc int")
    assert small_files.members(small_files.pack_files(df)).collect()[0].content == b"x\n"


def test_records_and_their_surplus(spark):
    same = "+1 2.0 3 4e0 5 6 7 8. 9 1.0E1 11\r"
    rows = [
        (3, RUN, f"# c\n{NUMBERS}\n"), (2, "b/" + RUN, f"{same}\n\n{NUMBERS}"), (4, RUN.replace("s1", "s2"), NUMBERS), (5, "log/x.out", NUMBERS),
        (6, RUN, "1 2 3 4 5 6 7 8 9 10\nnan 2 3 4 5 6 7 8 9 10 11\n1 2 3 4 5 6 7 8 9 10 x"), (7, RUN + ".tmp", "NaN\t2 3 4 5 6 7 8 9 10 11"), (8, RUN, None), (3, RUN, f"# c\n{NUMBERS}\n"),
    ]
    bundles = pack(spark, [(i, p, c.encode() if c else None) for i, p, c in rows])
    assert run_records.records(bundles).count() == 6
    got = run_records.surplus(run_records.record_keys(bundles), "key", ["file_id", "line_no"]).collect()
    assert {(r.file_id, r.line_no) for r in got} == {(2, 3), (3, 2), (7, 1)}


def test_surplus_of_a_hot_key_equals_brute_force(spark):
    rng = random.Random(2)
    rows = [(rng.choice("aaab") if i % 3 else f"k{rng.randrange(40)}", rng.randrange(300), i) for i in range(2000)]
    got = {r.n for r in run_records.surplus(spark.createDataFrame(rows, "key string, o int, n int"), "key", ["o", "n"], salts=5).collect()}
    first = {}
    for k, o, n in rows:
        first[k] = min(first.get(k, (o, n)), (o, n))
    assert got == {n for k, o, n in rows if (o, n) != first[k]}


def test_repeated_listings_are_packed_once_at_any_share(spark):
    rows = [(7, "hot", b"7\n")] * 400 + [(i, f"p{i}", b"%d\n" % i) for i in range(200)] * 2 + [(None, "n", b"1\n")] * 50
    got = [(r.file_id, r.path, bytes(r.content)) for r in small_files.members(small_files.pack_files(spark.createDataFrame(rows, SCHEMA).repartition(6))).collect()]
    assert len(got) == len(set(got)) and set(got) == set(rows)


def test_contents_are_not_shuffled(spark, tmp_path):
    spark.createDataFrame([(i, f"p{i}", b"x" * 50) for i in range(100)], SCHEMA).write.parquet(str(tmp_path / "f"))
    once, _ = small_files._told_apart(spark.read.parquet(str(tmp_path / "f")))
    assert "hashpartitioning" not in once._jdf.queryExecution().executedPlan().toString()


def test_damaged_bundles_are_not_parsed(spark):
    from pyspark.sql import functions as F

    bundles = pack(spark, [(1, RUN, NUMBERS.encode()), (2, RUN, NUMBERS.encode())])
    bad = bundles.withColumn("payload", F.overlay("payload", F.lit(b"9"), F.lit(1)))
    with pytest.raises(Exception, match="damaged"):
        run_records.record_keys(bad).collect()


def test_the_run_begins_at_the_first_eval_of_the_path():
    assert run_records.RUN.search("eda_eval_cluster/retry/eval_P_8_tr0_k2_T1.0_s1.dat.tmp")[0] == "eval_cluster/retry/eval_P_8_tr0_k2_T1.0_s1.dat"
