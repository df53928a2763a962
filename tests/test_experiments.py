import time

import numpy as np
import pandas as pd
import pytest

from tallygrid.operators import experiments as X
from tallygrid.sources import files, r_network

from .data import branching, counter
from .test_files_and_reports import SOURCE


def test_guard_ends_jobs_and_loops(spark):
    with pytest.raises(X.OutOfTime), X.guard(spark, 1.0):
        while True:
            time.sleep(0.01)
    with pytest.raises(X.OutOfTime), X.guard(spark, 1.0):
        spark.range(4, numPartitions=4).mapInPandas(lambda it: (time.sleep(60), it)[1], "id bigint").count()
    with X.guard(spark, 60.0):
        assert spark.range(5).count() == 5
    with pytest.raises(KeyError), X.guard(spark, 60.0):
        raise KeyError


def test_evaluation_vector(spark):
    x = branching(900)
    rng = np.random.default_rng(0)
    rows = [(i, *map(int, r), float(r.sum() + rng.normal()), i % 3) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, x0 int, x1 int, x2 int, x3 int, f double, split int")
    got = X.evaluate(df, (2, 2, 2, 2), [(0, 1), (2, 1), (0, 3)], "chow_liu", 1)
    assert list(got) == X.VECTOR and got["f1"] > 0.6
    assert all(got[f"ll_s{i}"] < 0 < got[f"kl_s{i}"] and -1 <= got[f"sp_s{i}"] <= 1 for i in range(3))


def test_evaluation_of_one_model_by_hand(spark):
    """Ties, rows without an objective, and rows without a state, which count nowhere, whatever their objective."""
    x = branching(900).astype(float)
    rng = np.random.default_rng(1)
    f = np.round(x.sum(axis=1) + rng.normal(size=900), 1)
    split = np.arange(900) % 3
    f[5:300:15] = np.nan  # none of the training split 1
    x[6:300:15, 2], f[6:300:15] = np.nan, 99.0
    rows = [(i, *[None if v != v else int(v) for v in r], None if g != g else float(g), int(s)) for i, (r, g, s) in enumerate(zip(x, f, split, strict=True))]
    got = X.evaluate(spark.createDataFrame(rows, "id long, x0 int, x1 int, x2 int, x3 int, f double, split int"), (2, 2, 2, 2), [], "univ_bn", 1, share=1.0)

    all_ = pd.DataFrame(x, columns=list("abcd")).assign(f=f, split=split).dropna(subset=list("abcd"))
    train = all_[all_["split"] == 1]
    e = np.exp((train["f"] - train["f"].min()) / (train["f"].max() - train["f"].min() + 1e-12))
    ones = [((e * train[c]).sum() / e.sum() * len(train) + 0.5) / (len(train) + 1) for c in "abcd"]
    all_["logp"] = sum(np.log(np.where(all_[c] == 1, p, 1 - p)) for c, p in zip("abcd", ones, strict=True))
    for s, g in all_.groupby("split"):
        with_f = g.dropna(subset=["f"])
        w = np.exp((with_f["f"] - with_f["f"].min()) / (with_f["f"].max() - with_f["f"].min() + 1e-12))
        p, q = w / w.sum(), np.exp(g["logp"]) / np.exp(g["logp"]).sum()
        rho = np.corrcoef(with_f["f"].rank(), g["logp"].round(12).rank()[with_f.index])[0, 1]
        assert [got[f"{m}_s{s}"] for m in ("ll", "kl", "sp")] == pytest.approx([g["logp"].mean(), (p * np.log(p / q[with_f.index])).sum(), rho], abs=1e-9)


def test_evaluation_writes_no_rows_between_steps(spark, monkeypatch):
    from tallygrid.operators import evaluation, ordered

    held = []
    for module in (X, evaluation, ordered):
        monkeypatch.setattr(module, "cut", lambda df, do=module.cut: (kept := do(df), held.append(kept.count()))[0])
    x = np.vstack([branching(900)] * 4)
    rows = [(i, *map(int, r), float(i % 50), i % 3) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, x0 int, x1 int, x2 int, x3 int, f double, split int")
    alone = {m: X.evaluate(df, (2, 2, 2, 2), [(0, 1)], m, 1) for m in ("chow_liu", "k2")}
    assert held and max(held) < 100
    together = X.evaluate_each(df, (2, 2, 2, 2), [(0, 1)], ["chow_liu", "k2"], 1)
    for m, vector in alone.items():
        assert [together[m][c] for c in X.VECTOR if c != "time"] == pytest.approx([vector[c] for c in X.VECTOR if c != "time"])


def test_learners_side_by_side(spark):
    c = counter(spark, branching(600))
    true = np.zeros((4, 4), dtype=int)
    true[0, 1] = true[1, 2] = true[0, 3] = 1
    rows = {r.method: r for r in X.compare_learners(spark, {"b": (c, true)}, ["k2", "chow_liu", "levelwise", "univ_bn"]).collect()}
    assert rows["k2"].skeleton_f1 == rows["chow_liu"].directed_f1 == 1.0 and rows["univ_bn"].directed_precision == 1.0 and rows["univ_bn"].shd == 3


def test_sweep_keeps_what_is_fast():
    seconds = {"k2": 1.0, "slow": 40.0, "fast": 3.0, "fails": None}
    calls = []
    done, kept = X.survivors(lambda p, m, t: (calls.append((p, m, t)), seconds[m])[1], ["a", "b"], list(seconds), [0.1, 1.0])
    assert kept == ["k2", "fast"] and done == calls and ("a", "slow", 0.1) not in done and ("b", "fast", 0.1) in done


def test_benchmark_data(spark, tmp_path):
    d = r_network.parse_network(SOURCE, "rain")
    rows = X.write_benchmark(spark, d, str(tmp_path), 300)
    back = files.read_states(spark, str(tmp_path / "rain_data_N300.csv"), 4)
    assert back.count() == 300 and back.drop("row_id").exceptAll(rows.drop("id")).count() == 0
    meta = files.read_metadata(spark, str(tmp_path / "rain_meta.json"))
    assert files.metadata_edges(meta).count() == 3 and meta.first().n_samples == 300


def test_small_helpers():
    assert X.split_by_cells([2, 3, 4, 100, 2], 12) == [[0, 1], [2], [3], [4]] and X.split_by_cells([], 5) == []
    assert [v for v, _, y in X.layout(np.array([[0, 1], [0, 0]])) if y == 0] == [0]
    assert X.table_summary([np.array([0.25, 0.75]), np.array([[1.0, 0.0], [0.0, 1.0]])])[2] == (1, 0, 0.5, 0.5)
