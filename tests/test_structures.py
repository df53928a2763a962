import numpy as np
import pytest

from tallygrid.network import Network
from tallygrid.operators import drawing, eda, search
from tallygrid.operators import graphs as G
from tallygrid.operators.scoring import Scores, leaf_likelihood
from tallygrid.sources import files

from .data import branching, counter


def test_pieces_of_a_clique_hang_together():
    assert G.split_width([(0, 1, 2, 3, 4, 5)], 3) == [(0, 1, 2), (2, 3, 4), (4, 5)]
    assert G.split_width([(0, 1), (4,)], 3) == [(0, 1), (4,)] and G.split_width([(0, 1)], 1) == [(0,), (1,)]
    for n in range(1, 9):
        for width in range(2, 5):
            pieces = G.split_width([tuple(range(n))], width)
            assert {v for c in pieces for v in c} == set(range(n)) and max(map(len, pieces)) <= width
            assert all(set(a) & set(b) for a, b in zip(pieces, pieces[1:], strict=False))


def test_clique_order():
    assert G.clique_order([(0, 1, 2), (1, 2)]) == [1, 0]  # what lies inside another waits for nothing
    assert G.clique_order([(0, 1), (1, 2), (5,)]) == [0, 1, 2]  # two that wait for each other: as listed
    assert G.clique_order([(0, 1, 2), (3, 4), (1,), (3,)]) == [2, 3, 0, 1]
    parts = G.structure_rows([(0, 1), (1, 2), (1,)], [0, 2, 1])
    assert parts == [((), (0, 1)), ((1,), ()), ((1,), (2,))]
    assert G.structure_matrix(parts).tolist() == [[0, 2, 0, 1, 0, 0], [1, 0, 1, 0, 0, 0], [1, 1, 1, 2, 0, 0]]
    assert G.structure_matrix([]).shape == (0, 2)


def test_communities_cover_and_fuse():
    a = np.zeros((7, 7), dtype=int)
    for u, v in [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (2, 3)]:
        a[u, v] = a[v, u] = 1
    found = search.communities(a, overlap=0.9)
    assert {v for c in found for v in c} == set(range(7)) and [6] in found
    pairs = [(set(x), set(y)) for i, x in enumerate(found) for y in found[i + 1 :]]
    assert all(len(x & y) < 0.9 * min(len(x), len(y)) for x, y in pairs)
    assert search.communities(np.zeros((2, 2), dtype=int)) == [[0], [1]]


def test_scores_and_base_learners_of_ones_own(spark):
    c = counter(spark, branching(1500))
    score = lambda rows, n: float(leaf_likelihood(rows, 0.0).sum()) - 0.5 * np.log(n) * rows.shape[0] * (rows.shape[1] - 1)
    for method in ("bic", "stable_hc", "tabu", "iterdsla"):
        own = Network(c.cards).learn_structure(c, method, scorer=score).adjacency
        assert (own == Network(c.cards).learn_structure(c, method, alpha=0.0).adjacency).all()
    seen = []

    def base(p, s):
        seen.append(p.n_vars)
        return search.hill_climb(p, s)

    a = Network(c.cards).learn_structure(c, "iterdsla", base=base).adjacency
    assert seen and (a == Network(c.cards).learn_structure(c, "iterdsla", base="stable_hc").adjacency).all()
    with pytest.raises(ValueError):
        Network(c.cards).learn_structure(c, "iterdsla", base="none")
    assert Network.learn_variable_clustering(c)["clusters"]
    assert Scores(c, score).local(1, (0,)) == pytest.approx(Scores(c, "bic").local(1, (0,)))


def test_several_objectives(spark):
    from pyspark.sql import functions as F

    ones = sum((F.col(f"x{i}") for i in range(6)), F.lit(0))
    parts = eda.Components(learning=eda.NetworkLearning("univ_bn"), stop=eda.MaxGenerations(3))
    out = eda.run(spark, (2,) * 6, [ones, 2 * ones - F.col("x0")], 60, parts)
    assert len(out.statistics) == 3 and all(len(s.best) == len(s.worst) == 2 for s in out.statistics)
    assert out.statistics[-1].mean[0] > out.statistics[0].mean[0]
    assert isinstance(eda.run(spark, (2,) * 3, F.col("x0") + 0, 10, eda.Components(stop=eda.MaxGenerations(1))).statistics[0].best, float)


def test_drawings_are_well_formed():
    from xml.etree import ElementTree

    a = G.adjacency_of(4, [(0, 1), (1, 2), (0, 3)])
    page = ElementTree.fromstring(drawing.network_svg(a, ["a<b", "b", "c", "d"]))
    assert len([x for x in page.iter() if x.tag.endswith("circle")]) == 4 and len([x for x in page.iter() if x.tag.endswith("line")]) == 3
    bars = ElementTree.fromstring(drawing.bars_svg(np.array([[0.25, 0.75], [1.0, 0.0]]), "x & y"))
    assert [float(x.get("height")) for x in bars.iter() if x.tag.endswith("rect")] == [30.0, 90.0, 120.0, 0.0]
    ElementTree.fromstring(drawing.network_svg(np.zeros((0, 0), dtype=int)))


def test_text_is_put_in_place_whole(spark, tmp_path):
    path = tmp_path / "deep" / "a.json"
    files.write_text(spark, f"file://{path}", "one\né")
    files.write_text(spark, str(path), "two")
    assert path.read_text() == "two" and [p.name for p in path.parent.iterdir() if not p.name.endswith(".crc")] == ["a.json"]


def test_first_rows_of_several_files(spark, tmp_path):
    for name, first in (("b.csv", 5), ("a.csv", 0)):
        (tmp_path / name).write_text("".join(f"{first + i},0\n" for i in range(5)))
    got = files.read_states(spark, str(tmp_path / "*.csv"), 2, 7).collect()
    assert sorted(r.x0 for r in got) == list(range(7))
