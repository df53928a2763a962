import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygrid.llm import reading

D = "/root/testdata/sf0.01"
DOCS = "doc_id bigint, text string, lang string, level int, terms string"


def test_counts_and_index(spark):
    texts = {1: "The cat sat. It purred!", 2: "One—two 3 ... ?! x", 3: "", 4: None, 5: " \t　", 6: "?!", 7: "a.b c.", 8: "日本の橋。歩く"}
    df = spark.createDataFrame([(i, t, "en", 1, "x") for i, t in texts.items()], DOCS)
    got = {r.doc_id: r for r in reading.apply(reading.features(df), reading.Model([], np.zeros(reading.BINS), np.zeros((1, len(reading.GRID))))).collect()}
    for i, t in texts.items():
        t = t or ""
        words = [w for w in t.split() if any(c.isalnum() for c in w)]
        letters, ends = sum(c.isalnum() for c in t), max(1, len(re.findall(r"[.!?]+(?=\s|$)", t)))
        assert (got[i].n_letters, got[i].n_words, got[i].n_sentences) == (letters, len(words), ends), i
        if words:
            assert got[i].ari == pytest.approx(4.71 * letters / len(words) + 0.5 * len(words) / ends - 21.43)
        assert (got[i].level is None) == (not words)
        assert got[i].grade is None


def test_levels_agree_with_held_out_grades(spark):
    """Grades of half of the graded documents calibrate; the level must order the others."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/reading_labels.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    levels = reading.reading_levels(docs, labels.filter(~held))
    given = labels.filter(held).distinct().groupBy("doc_id").agg(F.avg("reading_level").alias("given"))
    both = levels.join(given, "doc_id").filter("level IS NOT NULL").toPandas()
    rank = both[["level", "given"]].rank()
    assert len(both) > 100 and rank["level"].corr(rank["given"]) > 0.75
    assert (both.grade - both.given).abs().mean() < 0.85 and both.grade.between(1, 5).all()
    for _, own in both.groupby("lang"):
        if len(own) >= 15:
            assert own[["level", "given"]].rank().corr().iloc[0, 1] > 0.5


def test_repeats_long_texts_and_odd_languages(spark):
    easy, hard = "the cat sat on the mat and ran. ", "notwithstanding interdependent jurisdictions characterise infrastructures. "
    rows = [(i, easy * (1 + i % 3), "en", 1, "x") for i in range(40)] + [(100 + i, hard * (1 + i % 3), "en", 1, "x") for i in range(40)]
    rows += [(700, easy * 9000 + hard, None, 1, "x"), (700, easy * 9000 + hard, None, 1, "x"), (8, "1 2 3", "zz", 1, "x"), (None, hard, "en", 1, "x")]
    got = reading.reading_levels(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    level = {r.doc_id: r.level for r in got}
    assert min(level[100 + i] for i in range(40)) > max(level[i] for i in range(1, 7))
    assert len({r.level for r in got if r.doc_id == 700}) == 1 and level[8] is not None and level[None] is not None


def test_empty_and_many_languages(spark):
    none = spark.createDataFrame([], DOCS)
    assert reading.reading_levels(none, spark.createDataFrame([], "doc_id bigint, grader string, reading_level int")).count() == 0
    rows = [(i, f"word{i} other", f"l{i}", 1, "x") for i in range(reading.LANGUAGES + 9)]
    assert reading.reading_levels(spark.createDataFrame(rows, DOCS), rounds=1).filter("level IS NULL").count() == 0


def test_the_fit_raises_the_likelihood(spark):
    """More rounds of alternation fit the documents' words better, beside the words' shares, which hardly change."""
    feats = reading.features(spark.read.parquet(f"{D}/documents.parquet"))
    rows = feats.select("lang", "terms").toArrow().combine_chunks().to_batches()[0]

    def fitness(m):
        index, sizes, lang = reading._words(rows, m)
        ends = np.cumsum(sizes)
        sums = np.concatenate([[0.0], np.cumsum(m.difficulty[index])])
        value = (sums[ends] - sums[ends - sizes])[:, None] * reading.GRID - sizes[:, None] * m.log_z[lang] - reading.GRID**2 / 2
        return value.max(axis=1).sum()

    one, six = (fitness(reading.fit(feats, rounds=r)) for r in (1, 6))
    assert six > one


def test_agreement_counts_graded_documents(spark):
    levels = spark.createDataFrame([(1, -1.0, 3.0), (2, 0.0, 9.0), (3, 1.0, 5.0), (4, None, 1.0), (5, 2.0, None)], "doc_id bigint, level double, ari double")
    labels = spark.createDataFrame([(1, "a", 1), (1, "a", 1), (2, "a", 2), (2, "b", 3), (3, "a", 5), (4, "a", 5), (9, "a", 1), (5, "a", None)], "doc_id bigint, grader string, reading_level int")
    n, level, index = reading.agreement(levels, labels)
    assert n == 3 and level == pytest.approx(1.0) and index == pytest.approx(0.5)
    assert reading.agreement(levels.limit(0), labels)[0] == 0


def test_difficulties_do_not_depend_on_the_number_of_tasks(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 23}" for j in range(1, 9)) + (" notwithstanding" if i % 3 else " cat"), "en" if i % 2 else None, 1, "x") for i in range(90)], DOCS)
    one, many = (reading.fit(reading.features(docs.repartition(k)), rounds=2) for k in (1, 7))
    assert np.allclose(one.difficulty, many.difficulty, atol=1e-9) and np.allclose(one.log_z, many.log_z, atol=1e-9)
