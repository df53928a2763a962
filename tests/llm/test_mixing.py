import random

import pytest

from tallygrid.llm import mixing

DOCS = "doc_id bigint, source string, text string, h int, tokens int"


def docs(spark, n=1500):
    rng = random.Random(7)
    words = ["red", "boat", "tree", "house", "and", "the"]
    source = lambda: rng.choice(["big"] * 6 + ["mid"] * 3 + ["small"])
    rows = [(i, source(), " ".join(rng.choice(words) for _ in range(rng.randrange(30))), 0, 0) for i in range(n)]
    return spark.createDataFrame(rows + [(None, "mid", "a null id", 1, 1), (n, None, "no source", 1, 1), (n + 1, "other", "not wanted", 1, 1), (n + 2, "mid", None, 1, 1)], DOCS)


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def test_shares_are_met_as_far_as_repeats_allow(spark):
    m = mixing.mix(docs(spark), targets(spark, [("big", 0.3, 1), ("mid", 0.5, 3), ("small", 0.15, 2), ("none", 0.05, 9)]))
    report = {r.source: r for r in m.report.collect()}
    chosen = m.chosen.collect()
    total = sum(r.tokens for r in report.values())
    for s, r in report.items():
        own = [c for c in chosen if c.source == s]
        assert r.given == sum(c.n_tokens * c.copies for c in own) <= r.budget + 1e-6
        assert max((c.copies for c in own), default=0) <= r.max_repeats
        assert r.short == (r.tokens * r.max_repeats < r.target_share * total)
        if r.short:
            assert r.given == r.tokens * r.max_repeats
        else:
            assert r.budget - r.given < 30  # less than a document
        copies = {c.copies for c in own}
        assert len(copies) <= 2 and (not copies or max(copies) - min(copies) <= 1)
    assert report["none"].short and report["none"].given == 0 and not report["big"].short
    assert sum(r.actual_share for r in report.values()) == pytest.approx(1)


def test_the_threshold_is_the_best_prefix_by_hash(spark):
    d, t = docs(spark, 400), targets(spark, [("big", 0.37, 1), ("mid", 0.6, 2)])
    sized = mixing.hashed(d)
    counts = mixing.histogram(sized, t)
    wanted = mixing.budgets(counts, t)
    got = {r.source: (r.threshold, r.reached) for r in mixing.thresholds(sized, counts, wanted).collect()}
    rows = sized.collect()
    for r in wanted.collect():
        own = sorted((x.h, x.n_tokens) for x in rows if x.source == r.source)
        taken = 0
        for h, n in own:
            if taken + n > r.rest:
                break
            taken += n
        assert got[r.source][1] == taken == sum(n for h, n in own if h < got[r.source][0])


def test_smaller_mixtures_are_nested(spark):
    d = docs(spark, 600)
    few, many = (mixing.mix(d, targets(spark, [("big", share, 1), ("mid", 0.1, 1)])).chosen for share in (0.1, 0.3))
    assert few.filter("source = 'big'").select("doc_id").exceptAll(many.select("doc_id")).count() == 0


def test_edges(spark):
    none = docs(spark, 5).limit(0)
    t = targets(spark, [("a", 0.5, 2), ("b", 0.5, None)])
    m = mixing.mix(none, t)
    assert m.chosen.count() == 0 and [r.actual_share for r in m.report.collect()] == [None, None]
    same = spark.createDataFrame([(1, "a", "x y z", 0, 0)] * 8 + [(2, "b", "", 0, 0)], DOCS)
    m = mixing.mix(same, targets(spark, [("a", 0.5, 1)]))
    assert m.chosen.count() in (0, 8)  # one id, one hash: all or none
    assert mixing.mix(same, targets(spark, [("b", 1.0, 3)])).report.collect()[0].given == 0
    assert mixing.mix(same, t).report.filter("source = 'b'").collect()[0].given == 0
