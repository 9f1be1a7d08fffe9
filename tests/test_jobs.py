import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecatlas.functions.udf import embedded, payload
from vecatlas.operators import scoring as sc
from vecatlas.operators import sensitivity as se
from vecatlas.operators import supervised as su
from vecatlas.operators import whole_jobs as wj
from vecatlas.operators.layout import affinities
from vecatlas.streaming import jobs

W = {"main": 0.6, "text": 0.4}


def library(spark, n=160, seed=3):
    """Gathered items: four folders that differ in two dimensions only, under louder noise in the others."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        c = i % 4
        loud = [r.gauss(0, 3) for _ in range(4)]
        rows.append((i, f"lib/f{c}", f"fp{i}", [math.cos(c * 1.57) + r.gauss(0, 0.1), math.sin(c * 1.57) + r.gauss(0, 0.1), *loud], [r.gauss(0, 1) for _ in range(3)]))
    rows.append((n, "lib/thin", f"fp{n}", [1.0] * 6, [1.0] * 3))
    return spark.createDataFrame(rows, "id long, folder string, fingerprint string, main array<double>, text array<double>")


@pytest.fixture(scope="module")
def trained(spark, tmp_path_factory):
    items = library(spark)
    segments = spark.createDataFrame([(f"fp{i}", s, [1.0, 0.1 * s * (i % 3)]) for i in range(0, 160, 2) for s in range(3)], "fingerprint string, seg int, vec array<double>")
    out = str(tmp_path_factory.mktemp("runs"))
    return items, out, su.train(items, ["main", "text"], W, segments, out)


def test_projection_separates_what_vectors_do_not(spark):
    rows = library(spark).where("folder <> 'lib/thin'").select("id", F.substring("folder", 6, 1).cast("int").alias("class"), F.col("main").alias("vec"))
    right = lambda df: sc.assign(df, sc.centroids(df)).where("pred = class").count()
    mean, basis = su.fit(rows, dims=4)
    head = su.projected(rows, mean, basis)
    assert basis.shape == (6, 3)  # four classes span three directions
    assert right(head) >= 155 > right(rows) + 20
    assert all(abs(sum(x * x for x in r["vec"]) - 1) < 1e-9 for r in head.collect())


def test_weights_and_pairs_count(spark):
    rows = library(spark).where("folder <> 'lib/thin'").select("id", F.substring("folder", 6, 1).cast("int").alias("class"), F.col("main").alias("vec"))
    twice = rows.unionAll(rows.where("id < 40").withColumn("id", F.col("id") + 1000))
    weighted = rows.withColumn("w", F.when(F.col("id") < 40, 2.0).otherwise(1.0))
    a, b = su.fit(twice, dims=2), su.fit(weighted, weight="w", dims=2)
    assert np.allclose(a[0], b[0]) and np.allclose(a[1], b[1])
    pairs = spark.createDataFrame([(0, 1), (4, 5)], "a long, b long")
    assert not np.allclose(su.fit(rows, pairs=pairs, dims=2)[1], su.fit(rows, dims=2)[1])
    assert np.allclose(su.fit(rows, pairs=pairs.limit(0), dims=2)[1], su.fit(rows, dims=2)[1])


def test_train_writes_a_run(spark, trained):
    items, out, run = trained
    p = spark.read.parquet(f"{run['path']}/predictions")
    assert run["status"] == "trained" and p.count() == items.count()
    assert p.where("class >= 0 AND pred = class").count() >= 150
    assert p.where("class = -1").count() == 1  # the thin folder's row is scored without a class
    few = items.where("folder = 'lib/f0' OR folder = 'lib/thin'")
    assert su.train(few, ["main", "text"], W, spark.createDataFrame([], "fingerprint string, seg int, vec array<double>"), out)["status"] == "skipped"


def test_stream_of_rows_equals_the_batch(spark, trained, tmp_path):
    items, _, run = trained
    for i in range(3):
        items.where(F.col("id") % 3 == i).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    stream = spark.readStream.schema(items.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.each_batch(stream, jobs.score_step(run["path"], ["main", "text"], W, str(tmp_path / "out")), str(tmp_path / "cp")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).select("id", "pred", "sim", "is_match")
    want = spark.read.parquet(f"{run['path']}/predictions").select("id", "pred", "sim", "is_match")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_assign_by_blocks_of_classes(spark, monkeypatch):
    r = random.Random(5)
    rows = spark.createDataFrame([(i, [r.gauss(0, 1) for _ in range(3)]) for i in range(50)] + [(90, None), (91, [1.0]), (92, [0.0, 0.0, 0.0])], "id long, vec array<double>")
    cents = [(c, [r.gauss(0, 1) for _ in range(3)]) for c in range(11)]
    cents = spark.createDataFrame(cents + [(11, cents[4][1])], "class int, vec array<double>").groupBy("class").agg(F.first("vec").alias("vec"))
    cents = sc.centroids(cents)
    whole = sorted(map(tuple, sc.assign(rows, cents).select("id", "pred", "sim").collect()))
    monkeypatch.setattr(sc, "CLASSES", 4)
    assert sorted(map(tuple, sc.assign(rows, cents).select("id", "pred", "sim").collect())) == whole
    grid = {x["class"]: np.array(x["centroid"]) for x in cents.collect()}
    for i, v in ((x["id"], np.array(x["vec"])) for x in rows.where("id < 50").collect()):
        sims = {c: round(float(v @ g / np.linalg.norm(v)), 6) for c, g in grid.items()}
        best = min(sims, key=lambda c: (-sims[c], c))
        assert (best, sims[best]) == pytest.approx(next((p, s) for k, p, s in whole if k == i))
    assert [w for w in whole if w[0] > 50] == [(92, 0, 0.0)]
    assert sc.assign(rows, cents.limit(0)).count() == 0 and sc.assign(rows.limit(0), cents).count() == 0


def at_weights(spark, deltas, weights, c, tau):
    df = spark.createDataFrame([(i, d["p"], d["q"]) for i, d in enumerate(deltas)], "id long, delta_p array<double>, delta_q array<double>")
    return se.derivatives(affinities(se.weighted_delta(df, ["p", "q"], weights), tau), ["p", "q"], c, tau)


def test_derivatives_equal_finite_differences(spark):
    r = np.random.default_rng(2)
    deltas = [{s: r.random(5).tolist() for s in "pq"} for _ in range(12)]
    c, w = r.random((5, 2)), {"p": 0.7, "q": 0.3}
    got = {(x["id"], x["s"]): x for x in at_weights(spark, deltas, w, c, 0.4).collect()}
    for s in "pq":
        lo, hi = ({(x["id"]): x for x in at_weights(spark, deltas, {**w, s: w[s] + h}, c, 0.4).where(F.col("s") == "p").collect()} for h in (-1e-4, 1e-4))
        for i in range(12):
            assert got[i, s]["dx"] == pytest.approx((hi[i]["x"] - lo[i]["x"]) / 2e-4, abs=1e-6)
            assert got[i, s]["dy"] == pytest.approx((hi[i]["y"] - lo[i]["y"]) / 2e-4, abs=1e-6)


def test_gauge_takes_shift_and_zoom_only(spark):
    r = np.random.default_rng(4)
    xy, rest = r.random((9, 2)), r.random((9, 2))
    rows = [(i, *map(float, xy[i]), "zoom", *map(float, 2 * xy[i] + [3, -1])) for i in range(9)] + [(i, *map(float, xy[i]), "any", *map(float, rest[i])) for i in range(9)]
    got = se.without_gauge(spark.createDataFrame(rows, "id long, x double, y double, s string, dx double, dy double")).collect()
    assert max(abs(v) for x in got if x["s"] == "zoom" for v in (x["dx"], x["dy"])) < 1e-12
    o = xy - xy.mean(axis=0)
    a = np.vstack([np.column_stack([np.eye(2)[k][None].repeat(9, 0), o[:, k]]) for k in (0, 1)])
    t = np.concatenate([rest[:, 0], rest[:, 1]])
    want = (t - a @ np.linalg.lstsq(a, t, rcond=None)[0]).reshape(2, 9).T
    for x in got:
        if x["s"] == "any":
            assert (x["dx"], x["dy"]) == pytest.approx(tuple(want[x["id"]]))


def test_preview_keeps_extent_and_no_step_is_identity(spark):
    moves = spark.createDataFrame([(i, float(i), float(i * i), s, float(d), 1.0) for i in range(5) for s, d in (("p", i), ("q", 7))], "id long, x double, y double, s string, dx double, dy double")
    same = {r["id"]: (r["x"], r["y"]) for r in se.preview(moves, {"p": 0.0}).collect()}
    assert same == {i: (float(i), float(i * i)) for i in range(5)}
    got = {r["id"]: (r["x"], r["y"]) for r in se.preview(moves, {"p": 1.0, "q": 0.5}).collect()}
    for i in range(5):
        assert got[i] == pytest.approx((float(i), float(i * i)))  # twice the width and a shift: scaled back
    bent = {r["id"]: r["x"] for r in se.preview(moves.withColumn("dx", F.col("dx") * F.col("dx")), {"p": 1.0}).collect()}
    assert bent == pytest.approx({i: (i + i * i) / 5 for i in range(5)})
    assert se.preview(moves.limit(0), {"p": 1.0}).count() == 0


def test_head_on(spark):
    r = np.random.default_rng(6)
    flat, depth = r.normal(size=(20, 2)), r.normal(size=20)
    q, _ = np.linalg.qr(r.normal(size=(3, 3)))
    cloud = np.column_stack([flat, depth]) / 2.5 @ q + [4, 5, 6]
    c = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(cloud)], "id long, x double, y double, z double")
    ref = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(flat) if i < 15], "id long, x double, y double")
    for pin in (0, 1, 17):
        got = {x["id"]: x for x in se.head_on(c, ref, pin).collect()}
        assert got[pin]["z"] >= 0
        for i in range(20):
            assert (got[i]["x"], got[i]["y"]) == pytest.approx(tuple(flat[i]))
        assert abs(abs(got[3]["z"] - got[5]["z"]) - abs(depth[3] - depth[5])) < 1e-9
    assert se.head_on(c, ref.limit(3)).collect() == c.collect()  # too few shared rows
    line = ref.withColumn("y", F.col("x") * 2)
    assert sorted(se.head_on(c.withColumn("y", F.col("x")).withColumn("z", F.lit(0.0)), line).collect()) == sorted(c.withColumn("y", F.col("x")).withColumn("z", F.lit(0.0)).collect())


def test_clustering_job_is_done_once(spark, tmp_path, monkeypatch):
    r = random.Random(9)
    rows = spark.createDataFrame([(i, [5.0 * (i % 3 == c) + r.gauss(0, 0.2) for c in range(3)]) for i in range(60)], "id long, vec array<double>").coalesce(2)
    name, levels = wj.cluster(rows, str(tmp_path), dims=3, k=5, resolutions=(0.5, 1.0))
    got = {r["id"]: r["community"] for r in levels.where("resolution = 1.0").collect()}
    assert {tuple(sorted({i % 3 for i in got if got[i] == c})) for c in set(got.values())} <= {(0,), (1,), (2,)}
    of = {x["resolution"]: x for x in wj.levels_of(levels).collect()}
    assert of[0.5]["communities"] <= of[1.0]["communities"] and sum(x["n"] for x in wj.membership(levels, 7).collect()) >= 2
    monkeypatch.setattr(wj, "pca", None)  # a second run must not get that far
    assert wj.cluster(rows.repartition(3), str(tmp_path), dims=3, k=5, resolutions=(0.5, 1.0))[0] == name


def test_clusters_reach_over_more_than_512_components(spark, tmp_path):
    """Each of 520 groups of copies was a community of its own; what was stored then has another revision."""
    r = random.Random(10)
    groups = [[r.gauss(0, 1) for _ in range(4)] for _ in range(520)]
    rows = spark.createDataFrame([(3 * i + c, x) for i, x in enumerate(groups) for c in range(3)], "id long, vec array<double>").coalesce(2)
    name, levels = wj.cluster(rows, str(tmp_path), dims=4, k=2, resolutions=(0.5,))
    of = wj.levels_of(levels).first()
    assert levels.count() == 1560 and of["communities"] < 260 and of["greatest"] > 3
    assert name != wj.revision(rows, {"job": "cluster", "dims": 4, "k": 2, "resolutions": (0.5,)})


def test_layouts_and_warm_up(spark, tmp_path):
    r = random.Random(8)
    rows = spark.createDataFrame([(i, f"lib/f{i % 3}", [4.0 * (i % 3), 2.0 * (i % 2), r.random(), r.random()]) for i in range(50)], "id long, folder string, vec array<double>")
    lenses = {"a": (rows, {"method": "linear"}), "b": (rows, {"marks": 8, "dims": 3, "boost": 0.5})}
    first = {x["lens"]: x for x in wj.warm_up(lenses, str(tmp_path)).collect()}
    assert all(x["ran"] for x in first.values()) and first["a"]["revision"] != first["b"]["revision"]
    again = {x["lens"]: x for x in wj.warm_up({**lenses, "c": (rows.where("id < 40"), {"method": "linear"})}, str(tmp_path)).collect()}
    assert {k: x["ran"] for k, x in again.items()} == {"a": False, "b": False, "c": True}
    for x in first.values():
        box = spark.read.parquet(f"{tmp_path}/{x['revision']}").agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count("*")).first()
        assert tuple(box) == pytest.approx((0, 1, 0, 1, 50))


def test_revisions_tell_folders_and_half_written_results_are_not_done(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"lib/f{i % 2}", [float(i % 3), float(i % 5), 1.0]) for i in range(12)], "id long, folder string, vec array<double>")
    moved = rows.withColumn("folder", F.when(F.col("id") == 3, "lib/f9").otherwise(F.col("folder")))
    of = lambda df, **kw: wj.layout_revision(df, **{**wj.DEFAULTS, **kw})
    assert of(rows, boost=0.5) != of(moved, boost=0.5) and of(rows) == of(moved) and of(rows, boost=0.5) == of(rows.repartition(3), boost=0.5)
    path = str(tmp_path / "t")
    assert wj.stored(spark, path) is None
    rows.write.parquet(path)  # a job that was cut off before its manifest
    assert wj.stored(spark, path) is None
    assert wj.publish(rows, path).count() == 12 and wj.stored(spark, path).count() == 12
    rows.limit(5).write.mode("overwrite").parquet(path)  # or while it was written anew
    assert wj.stored(spark, path) is None


def test_injected_functions(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "boom"), (3, "c")], "id long, text string")

    def encode(texts):
        if "boom" in texts:
            raise ValueError("no")
        return [[len(t)] for t in texts]

    assert {r["id"]: r["vec"] for r in embedded(df, encode, "text").collect()} == {1: [2.0], 2: None, 3: [1.0]}
    assert {r["vec"] for r in embedded(df, None, "text").collect()} == {None}
    items = spark.createDataFrame([("p", "a"), ("q", None)], "path string, fingerprint string")
    got = payload(items, spark.createDataFrame([("a", 0.5)], "fingerprint string, t double"), display={"bpm": lambda d: d["t"] * 100, "up": lambda d: F.upper(d["path"])})
    assert sorted(map(str, map(tuple, got.collect()))) == ["('p', 'a', 50.0, 'P')", "('q', None, None, 'Q')"]
