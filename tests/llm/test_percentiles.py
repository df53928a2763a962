import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygrid.llm import percentiles as P


@pytest.mark.parametrize("shape", ["random", "sorted", "reversed", "ties"])
def test_rank_error_is_as_stated(shape):
    rng = np.random.default_rng(1)
    x = rng.lognormal(size=60_000)
    x = {"random": x, "sorted": np.sort(x), "reversed": np.sort(x)[::-1], "ties": np.round(x, 1)}[shape]
    s = P.Sketch(64, 3)
    for part in np.array_split(x, 37):
        s.update(part)
    values, up = s.weighted()
    assert up[-1] == len(x) == s.n and len(values) < len(x) / 10
    ordered = np.sort(x)
    for q in (0.1, 0.5, 0.9, 0.95, 0.99, 0.999, 0.9999):
        r = P.target_rank(len(x), 100 * q)
        v = values[np.searchsorted(up, r)]
        low, high = np.searchsorted(ordered, v, "left") + 1, np.searchsorted(ordered, v, "right")
        off = max(low - r, r - high, 0)
        assert off <= P.SURE * s.error(r) + 1, (q, off)
    assert s.error(0.9999 * len(x)) < s.error(0.9 * len(x)) < 0.01 * len(x)


def test_merging_days_is_like_one_sketch():
    rng = np.random.default_rng(2)
    x = rng.normal(size=50_000)
    total = P.Sketch(64)
    for i, part in enumerate(np.array_split(x, 200)):
        one = P.Sketch(64, i)
        one.update(part)
        total.merge(P.Sketch.loads(one.dumps()))
    values, up = total.weighted()
    assert total.n == up[-1] == 50_000
    for q in (0.5, 0.95, 0.999):
        v = values[np.searchsorted(up, q * 50_000)]
        assert abs((x <= v).sum() - q * 50_000) <= P.SURE * total.error(q * 50_000) + 1


def test_small_sketches_are_exact():
    s = P.Sketch(64)
    s.update(np.array([3.0, 1.0, 2.0]))
    assert s.exact and s.error(2) == 0 and s.weighted()[0].tolist() == [1.0, 2.0, 3.0]
    assert [P.target_rank(20, p) for p in (50, 95, 0, 100, 99.9)] == [10, 19, 1, 20, 20]


def groups():
    return {"g": F.col("g"), "group": F.col("h")}


def test_frames_against_sorting(spark):
    rng = np.random.default_rng(3)
    rows = [("hot" if i % 3 else f"k{i % 5}", None if i % 11 == 0 else "h", float(rng.choice([math.nan, -0.0, math.inf, rng.normal(), 0.25], p=[0.02, 0.02, 0.02, 0.84, 0.1])) if i % 13 else None, i) for i in range(20_000)]
    df = spark.createDataFrame(rows, "g string, h string, v double, metric int").repartition(5)
    sk = P.sketches(df, groups(), {"m": F.col("v")}, k=16)
    got = P.percentiles(sk, ["g", "group"], {"m": [10.0, 50.0, 95.0]}).cache()
    values = df.filter("v IS NOT NULL AND NOT isnan(v)").select("g", F.col("h").alias("group"), F.lit("m").alias("metric"), F.col("v").alias("value")).filter("group IS NOT NULL")
    counted = {(r.g, r.p): r.value for r in P.exact(values, got.filter("group IS NOT NULL"), ["g", "group"], bins=16).collect()}
    seen = 0
    for r in got.collect():
        own = np.sort([v for g, h, v, _ in rows if g == r.g and h == r.group and v is not None and not math.isnan(v)])
        true = own[r.target - 1]
        assert r.n == len(own) and r.low <= true <= r.high
        if r.group is not None:
            seen += 1
            assert counted[r.g, r.p] == true
    assert seen == len(counted) == 6 * 3


def test_nothing_and_only_nulls(spark):
    df = spark.createDataFrame([("a", "b", None), ("a", "b", math.nan)], "g string, h string, v double")
    for d in (df, df.limit(0)):
        assert P.percentiles(P.sketches(d, groups(), {"m": F.col("v")}), ["g", "group"], {"m": [50.0]}).count() == 0


def test_small_and_large_groups_in_any_number_of_pieces(spark, monkeypatch):
    """Bare values and sketches, several days, bundles of partitions, and what is sent on early: the brackets hold."""
    rng = np.random.default_rng(9)
    rows = [("hot" if i % 2 else f"k{i % 40}", i % 5, float(rng.normal()), float(i)) for i in range(12_000)]
    df = spark.createDataFrame(rows, "g string, day int, v double, w double").repartition(6)
    monkeypatch.setattr(P, "ROWS_AT_ONCE", 700)
    monkeypatch.setattr(P, "MOST_GROUPS", 50)
    for salts in (1, 3):
        days = P.partial(df, {"g": F.col("g"), "day": F.col("day")}, {"v": F.col("v"), "w": F.col("w")}, k=16)
        got = P.percentiles(P.merged(days, ["g"], 16, salts), ["g"], {"v": [50.0, 99.0], "w": [50.0]}).collect()
        assert len(got) == len({r[0] for r in rows}) * 3
        for r in got:
            own = sorted(x[2 if r.metric == "v" else 3] for x in rows if x[0] == r.g)
            assert r.n == len(own) and r.low <= own[r.target - 1] <= r.high
            if len(own) < 90:
                assert r.low == r.high == r.value


def test_pieces_are_told_apart():
    bare = np.arange(10.0).astype("<f8").tobytes()
    big = P.joined([bare] * 100, 16, 0)
    assert P.size_of(bare) == 10 and P.size_of(big) == 1000 and len(big) % 8 == 4 and len(P.joined([bare, bare], 64, 0)) == 160
    assert P.Sketch.loads(P.joined([big, bare], 16, 1)).n == 1010 and P.joined([], 64, 0) == b""
