import random

from vecatlas.operators.graph import components, stars
from vecatlas.operators.plans_and_moves import reweight
from vecatlas.operators.scoring import balanced, compared, concentration, key_groups
from vecatlas.operators.store import signature


def test_signature_knows_rows_but_not_their_order(spark):
    rows = [("a", 1), ("b", 2), (None, 3), ("b", 2)]
    sig = lambda r: signature(spark.createDataFrame(r, "path string, id int"), ["path", "id"]).first()[0]
    assert sig(rows) == sig(rows[::-1]) and len({sig(rows), sig(rows[:3]), sig([("a", 1), ("b", 2), ("b", 3), (None, 2)]), sig([])}) == 4


def test_concentration_leaves_unknown_artists_out(spark):
    rows = spark.createDataFrame([(1, "x", "r"), (2, "x", None), (3, "", "r"), (4, None, "q")], "id long, artist string, release string")
    near = spark.createDataFrame([(1, 2), (1, 3), (2, 1), (2, 4), (3, 1), (3, 4), (4, 3), (4, 1)], "id long, other long")
    r = concentration(near, rows).first()
    assert (r["artist_share"], r["artist_queries"], r["artist_coverage"]) == (0.5, 2, 0.5)
    assert (r["release_share"], r["release_queries"], r["release_coverage"]) == (round(1 / 3, 6), 3, 0.75)


def test_compared_models(spark):
    a = spark.createDataFrame([("p", [1.0, 0.0]), ("q", [0.0, 1.0])], "class string, centroid array<double>")
    b = spark.createDataFrame([("q", [0.6, 0.8]), ("s", [1.0, 0.0])], "class string, centroid array<double>")
    got = {r["class"]: (r["side"], r["cosine"], r["mean_cosine"]) for r in compared(a, b).collect()}
    assert got == {"p": ("left", None, 0.8), "q": ("both", 0.8, 0.8), "s": ("right", None, 0.8)}


def test_key_groups(spark):
    fifths = [0] * 5 + [1] * 4 + [2] * 6 + [11] + [7] * 2 + [None]
    rows = key_groups(spark.createDataFrame([(f,) for f in fifths], "fifth int"), "fifth", 1).collect()
    assert {r["fifth"]: r["centre"] for r in rows} == {2: 2, 1: 2, 0: 0, 11: 0, 7: 7, None: None}
    assert key_groups(spark.createDataFrame([], "fifth int"), "fifth", 1).count() == 0


def test_balanced_sample_shares(spark):
    rnd = random.Random(1)
    rows = [(i, "abc"[i % 3], rnd.choice(["dev", "heldout"])) for i in range(600)] + [(1000 + i, "few", "dev") for i in range(4)] + [(2000 + i, "out", "heldout") for i in range(40)]
    got = balanced(spark.createDataFrame(rows, "id long, label string, split string"), 154).collect()
    by = {k: [r for r in got if r["label"] == k] for k in ("a", "b", "c", "few", "out")}
    assert len(got) == 154 and len(by["few"]) == 4 and max(len(by[k]) for k in ("a", "b", "c", "out")) - min(len(by[k]) for k in ("a", "b", "c", "out")) <= 1
    for k in "abc":
        assert 0.6 <= sum(r["split"] == "dev" for r in by[k]) / len(by[k]) <= 0.8
    for k, some in by.items():
        assert sorted(r["turn"] for r in some) == list(range(1, len(some) + 1)), k


def test_reweighting_is_the_sum_over_directions(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [0.0, 1.0, 0.0])], "id long, vec array<double>")
    directions = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 0.6, 0.8])], "exponent int, direction array<double>")
    got = {r["id"]: [round(x, 9) for x in r["vec"]] for r in reweight(rows, directions, 2.0, 3.0).collect()}
    assert got[1] == [1 + 6 * 1, 2 + round(18 * 3.6 * 0.6, 9), round(3 + 18 * 3.6 * 0.8, 9)]
    assert reweight(rows, directions.limit(0), 2.0, 3.0).count() == 2


def test_stars_join_what_shares_an_identity(spark):
    items = spark.createDataFrame([(1, "x", None), (2, "x", "r"), (3, "", "r"), (4, None, None), (5, "", None)], "id long, artist string, release string")
    got = {r["v"]: r["label"] for r in components(stars(items, "id", ["artist", "release"])).collect()}
    assert got == {1: 1, 2: 1, 3: 1}
