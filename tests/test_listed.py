import numpy as np
import pytest

from vecatlas.operators import listed
from vecatlas.operators.search import knn

SCHEMA = "id long, vec array<double>"


def grouped(spark, n=600, groups=25, seed=3):
    r = np.random.default_rng(seed)
    centre = r.normal(size=(groups, 12)) * 3
    x = centre[np.arange(n) % groups] + r.normal(size=(n, 12)) * 0.4
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(n, x[0].tolist()), (n + 1, x[0].tolist()), (n + 2, [0.0] * 12)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("block", [8192, 11])
def test_bounds_give_the_exact_result_from_few_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(listed, "BLOCK", block)
    df = grouped(spark).repartition(3)
    got, share = listed.knn_listed(df, 6, lists=25)
    cols = ["id", "other", "score", "rank"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, knn(df, 6).select(cols).collect()))
    assert share < 0.2


def test_few_probes_keep_recall(spark):
    df = grouped(spark, 1500, 40)
    exact = {(r["id"], r["other"]) for r in knn(df, 20).collect()}
    got, share = listed.knn_listed(df, 20, lists=40, probes=3)
    assert len(exact & {(r["id"], r["other"]) for r in got.collect()}) >= 0.95 * len(exact) and share < 0.1


def test_few_rows(spark):
    assert listed.knn_listed(grouped(spark).limit(0), 3)[0].collect() == []
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0])], SCHEMA)
    assert {(r["id"], r["rank"]): r["other"] for r in listed.knn_listed(df, 5)[0].collect()} == {(1, 1): 3, (1, 2): 2, (2, 1): 1, (2, 2): 3, (3, 1): 1, (3, 2): 2}


def test_a_row_goes_once_to_a_box_however_many_lists_it_opens(spark, monkeypatch):
    r, asked = np.random.default_rng(5), []
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(r.normal(size=(400, 24)))], SCHEMA)  # falls into no groups, so nearly all lists are opened
    met = listed._met
    monkeypatch.setattr(listed, "_met", lambda *a, **b: asked.append(a[0].count()) or met(*a, **b))
    got, share = listed.knn_listed(df, 4, lists=20)
    cols = ["id", "other", "score", "rank"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, knn(df, 4).select(cols).collect()))
    assert share > 0.8 and sum(asked) <= 400 * 6


def test_boxes_are_bounded():
    where = listed.boxes({0: 3, 1: 4, 2: 9, 3: 25, 4: 1}, 10)
    assert where == {0: [0], 1: [0], 2: [1], 3: [2, 3, 4], 4: [5]}
