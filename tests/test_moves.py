import random
import re

import numpy as np
from pyspark.sql import functions as F

from vecatlas.operators import moves as mv
from vecatlas.operators import plans_and_moves as pm

ITEMS = "id long, path string, fingerprint string, is_match boolean, class string, style string"


def shelf(spark, seed=2):
    rnd = random.Random(seed)
    names = ["a.dat", "a (1).dat", "a (2).dat", "a (4).dat", "b", "b (1)", "c.x.dat", "a (1) (1).dat", "a (0).dat"]
    paths = sorted({f"lib/{rnd.choice(['p', 'q/r', 'Top', 'x'])}/{rnd.choice(names)}" for _ in range(200)})
    rows = [(i, p, f"f{i // 2}" if i % 5 else None, rnd.random() < 0.4, rnd.choice(["lib/x", "lib", "ext/x"]), rnd.choice(["Top", "To:p---", None])) for i, p in enumerate(paths)]
    return spark.createDataFrame(rows, ITEMS), rows


def test_targets_are_free_and_lowest(spark):
    df, rows = shelf(spark)
    plan = {r["id"]: r for r in mv.sort_plan(df, df.where("style IS NOT NULL")).collect()}
    taken, moved = {r[1] for r in rows}, [r for r in plan.values() if r["source"] != r["target"]]
    targets = [r["target"] for r in moved]
    assert len(moved) > 10 and len(set(targets)) == len(targets) and not set(targets) & taken
    names = {"lib/" + f + "/" + p.rsplit("/", 1)[1] for _, p, *_ in rows for f in ("x", "Top", "To_p")} | {"lib/" + p.rsplit("/", 1)[1] for _, p, *_ in rows}
    for r in moved:  # every lower number of the family is taken, given, or a name that another row claims as it stands
        m = re.match(r"^(.*) \(([0-9]+)\)(\.[^./]*)?$", r["target"])
        plain = r["target"].rsplit("/", 1)[0] + "/" + r["source"].rsplit("/", 1)[1]
        if r["target"] != plain:
            stem, n, ext = m[1], int(m[2]), m[3] or ""
            lower = [stem + ext] + [f"{stem} ({k}){ext}" for k in range(1, n)]
            assert all(x in taken or x in targets or x in names for x in lower)
    assert all(r["source"] == r["target"] for r in plan.values() if r["reason"] in ("unmatched", "in-place"))


def test_apply_undo_and_apply_again(spark):
    df, rows = shelf(spark)
    again = lambda items: mv.sort_plan(items, items.where("style IS NOT NULL"))
    plan = again(df)
    there = mv.applied(df, plan)
    journal = mv.moves_of(plan, df, "b1", 1)
    back, outcomes, journal = mv.undone(there, journal, 2)
    assert {r["outcome"] for r in outcomes.collect()} == {"restored"}
    assert sorted(map(tuple, back.select("id", "path").collect())) == sorted((r[0], r[1]) for r in rows)
    assert sorted(map(tuple, again(back).collect())) == sorted(map(tuple, plan.collect()))
    nothing, none, grown = mv.undone(back, journal, 3)
    assert none.count() == 0 and nothing.count() == df.count() and grown.count() == journal.count()
    moved = there.withColumn("path", F.when(F.col("id") == plan.where("source <> target").agg(F.min("id")).first()[0], "lib/elsewhere").otherwise(F.col("path")))
    first = plan.where("source <> target").orderBy(F.desc("id")).first()
    blocked = moved.unionByName(df.limit(1).withColumn("id", F.lit(999).cast("long")).withColumn("path", F.lit(first["source"])))
    _, outcomes, _ = mv.undone(blocked, mv.moves_of(plan, df, "b1", 1), 2)
    counts = {r["outcome"]: r["count"] for r in outcomes.groupBy("outcome").count().collect()}
    assert counts["skipped"] == 1 and counts["occupied"] == 1


def test_counts_and_origins(spark):
    rows = [(1, "lib/old/deep/a", "f1", True, "lib/new", None), (2, "lib/b", "f2", False, "lib", None), (3, "lib/new/c", None, True, "lib/new", None), (4, "lib/old2/d", "f1", True, "lib/new", None)]
    df = spark.createDataFrame(rows, ITEMS)
    plan = mv.sort_plan(df, df.where("style IS NOT NULL"))
    assert {r["what"]: r["n"] for r in mv.counts(plan).collect()} == {"class": 2, "unmatched": 1, "in-place": 1, "emptied": 3}
    known = spark.createDataFrame([("f1", "before", 0), ("f9", "kept", 0)], "fingerprint string, origin string, recorded long")
    got = {r["fingerprint"]: (r["origin"], r["recorded"]) for r in mv.remembered(known, mv.moves_of(plan, df, "b", 7)).collect()}
    assert got == {"f1": ("old/deep", 7), "f9": ("kept", 0)}
    empty = df.limit(0)
    assert mv.sort_plan(empty, empty).collect() == [] and {r["what"]: r["n"] for r in mv.counts(mv.sort_plan(empty, empty)).collect()} == {"emptied": 0}


def test_folder_components_against_numpy(spark):
    r = np.random.default_rng(4)
    folders = ["lib/a/x"] * 12 + ["lib/a/y"] * 9 + ["lib/b"] * 5 + ["ext/c"] * 30
    x = r.normal(size=(len(folders), 6)) @ np.diag([3, 2, 1, 1, 0.5, 0.2]) + r.normal(size=6)
    rows = [(i, f, v.tolist()) for i, (f, v) in enumerate(zip(folders, x, strict=True))]
    df = spark.createDataFrame([*rows, (900, None, [1.0] * 6)], "id long, folder string, vec array<double>").repartition(5)
    directions = pm.folder_directions(df.where("folder IS NOT NULL"))
    got = {(c["node"], c["component"]): c for c in pm.folder_components(df, directions).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {}
    for d in directions.collect():
        own = unit[[f == d["node"] or f.startswith(d["node"] + "/") for f in folders]]
        if len(own) < 8:
            continue
        t = np.array(d["direction"])
        dev = own - own.mean(axis=0)
        _, s, vt = np.linalg.svd(dev - np.outer(dev @ t, t))
        for k in range(2):
            if k and s[k] < 0.18 * s[0]:
                break
            v = vt[k] - (vt[k] @ t) * t
            want[d["node"], k + 1] = v / np.linalg.norm(v) * np.sign(v[np.abs(v).argmax()])
    assert set(got) == set(want) and ("lib/b", 1) not in got
    for key, v in want.items():
        assert np.allclose(got[key]["direction"], v, atol=1e-8)
    assert {(r["node"], r["name"]) for r in pm.thin_folders(spark.createDataFrame([(1, "lib/a/x"), (2, "lib/a/y"), (3, "lib/a/y")], "id long, folder string")).collect()} == {("lib/a/x", "x")}
    assert pm.folder_components(df.limit(0), directions).count() == 0
