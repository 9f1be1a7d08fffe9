import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecatlas.operators import cohort as co
from vecatlas.operators import retrieval as rt


def fold(sizes, seed=42):
    dev, total, out = 0, 0, {}
    for g in sorted(sizes, key=lambda g: hashlib.md5(f"{seed}:{g}".encode()).hexdigest()):
        n = sizes[g]
        out[g] = "dev" if 10 * dev < 7 * (total + n) else "heldout"
        dev, total = dev + n * (out[g] == "dev"), total + n
    return out


@pytest.mark.parametrize(("per_range", "states"), [(10_000, 10_000), (7, 10_000), (7, 20), (1, 3)])
def test_running_split_does_not_depend_on_ranges(spark, per_range, states):
    rnd = random.Random(per_range)
    sizes = {g: rnd.choice([1, 1, 1, 2, 3, 7]) for g in range(60)} | {99: 150}
    df = spark.createDataFrame(list(sizes.items()), "group long, n long").repartition(3)
    got = {r["group"]: r["split"] for r in co.running_split(df, per_range=per_range, states=states).collect()}
    assert got == fold(sizes)


def test_running_split_without_groups(spark):
    assert co.running_split(spark.createDataFrame([], "group long, n long")).collect() == []


def test_reasons_groups_and_diagnostics(spark):
    rows = [
        (1, "lib/a/1", "lib", "a", "x", "r", "f1"), (2, "lib/a/2", "lib", "a", "x", None, "f2"), (3, "lib/b/3", "lib", "b", None, "r", "f3"), (4, "ext/4", "ext", "a", "x", "r", "f4"),
        (5, "lib/a/5", "lib", "a", "y", "", None), (6, "lib/a/6", "lib", None, "y", "", "f6"), (7, "lib/a/7", "lib", "a", "y", "", "f7"), (8, "lib/b/8", "lib", "b", "y", "", "f7"), (9, "lib/a/9", "lib", "a", "", "", "f1"), (10, "lib/c/10", "lib", "c", "", None, "f10"), (11, None, None, "c", "", None, "f11"),
    ]
    items = spark.createDataFrame(rows, "id long, path string, root_id string, label string, artist string, release string, fingerprint string")
    got = {r["id"]: r for r in co.cohort(items, "lib").collect()}
    assert {i: r["reject_reason"] for i, r in got.items()} == {1: None, 2: None, 3: None, 4: "outside_root", 5: "missing_fingerprint", 6: "no_label", 7: "fingerprint_conflict", 8: "fingerprint_conflict", 9: "fingerprint_duplicate", 10: None, 11: "outside_root"}
    assert got[1]["group"] == got[2]["group"] == got[3]["group"] == 1 and got[10]["group"] == 10 and got[4]["group"] is None
    assert {got[1]["split"], got[10]["split"]} <= {"dev", "heldout"} and got[1]["split"] == got[3]["split"]
    said = {tuple(r) for r in co.diagnostics(co.cohort(items, "lib")).collect()}
    assert ("rejected", "outside_root", "", 2) in said and ("label", "a", got[1]["split"], 2) in said
    other = {"dev": "heldout", "heldout": "dev"}
    assert ("lacking", "a", other[got[1]["split"]], 0) in said
    assert co.diagnostics(co.cohort(items.limit(0), "lib")).collect() == []


RECIPES = {"p": ("p", {"p": 1.0}), "p+q": ("p", {"p": 0.6, "q": 0.4}), "q": ("q", {"q": 2.0})}


def members(spark, n=60, seed=1):
    r = np.random.default_rng(seed)
    out = []
    for i in range(n):
        c = i % 3
        p, q = r.normal(size=5) + 2 * np.eye(5)[c], r.normal(size=4) + np.eye(4)[c]
        out.append((i, f"L{c}", "dev" if i % 4 else "heldout", [None, "", "x", "y"][i % 4] if i % 2 else f"a{i // 6}", f"r{i // 4}" if i % 5 else None, p.tolist(), q.tolist()))
    return out


SCHEMA = "id long, label string, split string, artist string, release string, p array<double>, q array<double>"


def brute(rows, k, dims):
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    by = {"p": unit(np.array([r[5] for r in rows])), "q": unit(np.array([r[6] for r in rows]))}
    dev = np.array([r[2] == "dev" for r in rows])
    out = {}
    for name, (_, w) in RECIPES.items():
        t = sum(w.values())
        whole = np.hstack([np.sqrt(w[c] / t) * by[c] for c in sorted(w)])
        mean = whole[dev].mean(axis=0)
        _, _, vt = np.linalg.svd(whole[dev] - mean, full_matrices=False)
        d = min(dims, whole.shape[1] - 1, dev.sum() - 1)
        for geometry, x in (("raw", whole), (f"pca{dims}", (whole - mean) @ vt[:d].T)):
            s = np.round(unit(x) @ unit(x).T, 6)
            for mode in ("all", "unrelated"):
                for split in ("dev", "heldout"):
                    per, k_min = {}, 99
                    for i, a in enumerate(rows):
                        if a[2] != split:
                            continue
                        kin = lambda b, a=a: any(a[c] and a[c] == b[c] for c in (3, 4))
                        best = sorted((j for j, b in enumerate(rows) if j != i and not (mode == "unrelated" and kin(b))), key=lambda j: (-s[i, j], j))[:k]
                        per.setdefault(a[1], []).append(np.mean([rows[j][1] == a[1] for j in best]))
                        k_min = min(k_min, len(best))
                    out[name, geometry, split, mode] = (round(float(np.mean([np.mean(v) for v in per.values()])), 5), k_min)
    return out


@pytest.mark.parametrize("k", [5, 58])
def test_recipes_against_brute_force(spark, k):
    rows = members(spark)
    df = spark.createDataFrame([*rows, (500, "L0", "dev", None, None, None, [1.0] * 4), (501, "L0", "dev", None, None, [0.0] * 5, [1.0] * 4), (502, "L0", "dev", None, None, [float("nan")] * 5, [1.0] * 4)], SCHEMA)
    got = rt.compare_recipes(df.repartition(3), RECIPES, k, pca_dims=3).collect()
    want = brute(rows, k, 3)
    assert {(r["recipe"], r["geometry"], r["split"], r["mode"]): (round(r["macro"], 5), r["k_min"]) for r in got} == want
    for family in ("p", "q"):
        names = {n for n, (f, _) in RECIPES.items() if f == family}
        best = min(((n, g) for n in names for g in ("raw", "pca3")), key=lambda x: (-want[x[0], x[1], "dev", "all"][0], *x))
        assert {(r["recipe"], r["geometry"]) for r in got if r["picked"] and r["family"] == family} == {best}


def test_blocks_do_not_matter_and_every_row_gets_what_there_is(spark):
    df = spark.createDataFrame(members(spark), SCHEMA)
    views = [rt.View("p", "raw", {"p": 1.0})]
    one, many = (sorted(map(tuple, rt.ranked(df, views, 40, blocks=b).collect())) for b in (1, 5))
    assert one == many
    left = {r["id"]: r["n"] for r in rt.ranked(df, views, 59).where("mode = 'unrelated'").groupBy("id").agg(F.count("*").alias("n")).collect()}
    rows = members(spark)
    assert left == {a[0]: sum(b[0] != a[0] and not any(a[c] and a[c] == b[c] for c in (3, 4)) for b in rows) for a in rows}


def test_both_splits_are_needed(spark):
    with pytest.raises(ValueError):
        rt.compare_recipes(spark.createDataFrame(members(spark), SCHEMA).where("split = 'dev'"), RECIPES, 3)
