import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecatlas.functions import paths as p
from vecatlas.functions.udf import apply_encoder
from vecatlas.functions.vectors import is_valid, normal_cdf
from vecatlas.operators import filters, gather, graph, layout, ledger, scoring, search, series, store


def test_weights():
    assert gather.complete_weights({"main": 1}) == {**gather.WEIGHTS, "main": 1.0}
    for bad in ({"main": -1}, {"main": float("nan")}, {"other": 1}, dict.fromkeys(gather.WEIGHTS, 0)):
        with pytest.raises(ValueError):
            gather.complete_weights(bad)
    assert gather.required_sources(["text"]) == ["text"] and gather.required_sources(["text", "main"]) == ["main"]


def test_missing_source_is_filled_before_standardising(spark):
    items = spark.createDataFrame([(i, f"p{i}", f"f{i}") for i in range(4)], "id long, path string, fingerprint string")
    rows = [("main", f"f{i}", 2, 2, [float(i), 1.0]) for i in range(4)] + [("logits", f"f{i}", 2, 1, [1.0]) for i in range(4)] + [("text", f"f{i}", 2, 1, [float(i)]) for i in range(1, 3)]
    features = spark.createDataFrame(rows, "source string, fingerprint string, version int, n_dims int, vec array<float>")
    both, used = gather.gather(items, features)
    assert used == ["main", "logits", "text"]
    got = {r["id"]: r["vec"] for r in gather.composite(both, used).collect()}
    assert got[0][3] == pytest.approx(-math.sqrt(0.15)) and got[0][1] == 0.0


def test_ties_and_zero_vectors_in_knn(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, [-1.0, 0.0])], "id long, vec array<double>")
    rows = search.knn(df, 2, blocks=3).collect()
    assert {(r["id"], r["rank"]): r["other"] for r in rows if r["id"] < 3} == {(0, 1): 1, (0, 2): 2, (1, 1): 0, (1, 2): 2, (2, 1): 0, (2, 2): 1}
    assert len(rows) == 10 and len(search.knn(df, 9).collect()) == 20


@pytest.mark.parametrize("partitions", ["1", "7", "64"])
def test_knn_does_not_depend_on_partitions(spark, partitions):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(i, rng.normal(size=5).tolist()) for i in range(60)], "id long, vec array<double>")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = sorted((r["id"], r["other"]) for r in search.knn(df, 3).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    v = np.array([r["vec"] for r in df.orderBy("id").collect()])
    s = np.round((v / np.linalg.norm(v, axis=1, keepdims=True)) @ (v / np.linalg.norm(v, axis=1, keepdims=True)).T, 6)
    np.fill_diagonal(s, -9)
    assert got == sorted((i, int(j)) for i in range(60) for j in np.argsort(-s[i], kind="stable")[:3])


def test_segments_without_position_never_win(spark):
    df = spark.createDataFrame([("a", 0, None, [1.0, 0.0]), ("a", 1, 0.5, [0.0, 1.0]), ("b", 0, None, [1.0, 0.0])], "fingerprint string, seg int, pos double, vec array<double>")
    rows = search.best_segments(df, [1.0, 0.0], 5).collect()
    assert [(r["fingerprint"], r["score"], r["pos"]) for r in rows] == [("a", 0.0, 0.5), ("b", None, None)]


def test_paths(spark):
    df = spark.createDataFrame([("a/b/c",), ("a",), ("a//./b/",), ("../x",), ("a/../..",), ("a/b/../c",)], "path string")
    assert [r[0] for r in df.select(p.resolve("path")).collect()] == ["a/b/c", "a", "a/b", None, None, "a/c"]
    roots = spark.createDataFrame([("/m",), ("/m/a",), ("/n",), ("/nn",)], "root string")
    assert sorted(r["root"] for r in p.maximal_roots(roots).collect()) == ["/m", "/n", "/nn"]
    names = spark.createDataFrame([("x%y/_",), ("x%y",), ("xzy/q",)], "path string")
    assert sorted(r["path"] for r in store.remap_prefix(names, "x%y", "n").collect()) == ["n", "n/_", "xzy/q"]
    assert spark.createDataFrame([("a𝄞",)], "f string").select(p.folder_hash("f")).first()[0] == (97 * 31 + ord("𝄞")) & 262143


def test_unknown_is_not_related(spark):
    rows = spark.createDataFrame([(0, 1, None, None, [1.0, 0.0]), (1, 1, "", None, [1.0, 0.1]), (2, 2, "x", "r", [1.0, 0.2]), (3, 2, "x", None, [1.0, 0.3])], "id long, label int, artist string, release string, vec array<double>")
    got = {(r["id"], r["other"]) for r in scoring.neighbours(rows, 3, exclude_related=True).collect()}
    assert (0, 1) in got and (2, 3) not in got and (2, 0) in got


def test_series(spark):
    flat = [(1, i, 0.0) for i in range(30)]
    dip = [(2, i, 0.0 if i in (0, 1, 5, 6, 10, 11, 12, 28, 29) else 1.0) for i in range(30)]
    df = spark.createDataFrame(flat + dip, "id long, frame long, level double")
    assert [tuple(r) for r in series.longest_dip(df.where("id = 2"), F.col("level") <= 0.5, 2).collect()] == [(2, 10, 12, 3)]
    rows = {r["id"]: r for r in series.sections(df).collect()}
    assert rows[1]["intro_start"] is None and rows[1]["drop_start"] is None and rows[2]["intro_start"] is not None
    assert series.sections(df.limit(0)).count() == 0
    assert series.best_window(df.where("id = 2 and frame < 4"), 10).first()["start"] == 0


def test_ledger(spark):
    rows = [(1, "k", "a", False, True, "E"), (2, "k", "a", False, True, "E"), (3, "k", "a", False, True, "E"), (1, "k", "b", False, False, "X"), (1, "k", "c", False, True, "E"), (2, "k", "c", True, True, None), (3, "k", "c", False, True, "E2")]
    log = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "event_id long, t int, kind string, dedupe_key string, ok boolean, retryable boolean, error string").withColumn("ts", F.timestamp_seconds("t").cast("timestamp_ntz"))
    got = {r["dedupe_key"]: (r["state"], r["attempts"], r["error"]) for r in ledger.fold(log).collect()}
    assert got == {"a": ("failed", 3, "E"), "b": ("failed", 1, "X"), "c": ("pending", 1, "E2")}


def test_components_of_a_chain_and_communities(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {r["label"] for r in graph.components(chain).collect()} == {0, 100}
    cliques = [(a, b, 1.0) for base in (0, 10) for a in range(base, base + 6) for b in range(a + 1, base + 6)] + [(0, 10, 0.1)]
    edges = spark.createDataFrame(cliques, "src long, dst long, weight double")
    got = {r["v"]: r["community"] for r in graph.communities(edges).collect()}
    assert {frozenset(v for v in got if got[v] == c) for c in set(got.values())} == {frozenset(range(6)), frozenset(range(10, 16))}
    whole = graph.modularity(edges, edges.select(F.col("src").alias("v")).union(edges.select("dst")).distinct().withColumn("community", F.lit(0))).first()[0]
    assert graph.modularity(edges, spark.createDataFrame(list(got.items()), "v long, community long")).first()[0] > whole


def test_layouts(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 2)) @ rng.normal(size=(2, 6)) + 3
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    got = np.array([r["reduced"] for r in layout.pca(df, 3).orderBy("id").collect()])
    assert np.allclose(np.linalg.norm(got, axis=1), np.linalg.norm(x - x.mean(axis=0), axis=1)) and np.abs(got[:, 2]).max() < 1e-6
    a = spark.createDataFrame([(i, float(v[0]), float(v[1])) for i, v in enumerate(x[:5])], "id long, x double, y double")
    assert layout.similarity_transform(a, a) is None and layout.align(a, a) is a
    with pytest.raises(ValueError):
        layout.affine_map(a.withColumn("y", F.col("x")), a)
    rows = layout.affinities(layout.landmark_distances(df, layout.landmarks(df, 20)), 5.0)
    known = df.where("id < 150").select("id", F.col("vec")[0].alias("x"), F.col("vec")[1].alias("y"))
    placed = np.array([(r["x"], r["y"]) for r in layout.place(rows, known, layout.landmark_map(rows, known)).orderBy("id").collect()])
    assert (placed[:150] == x[:150, :2]).all() and np.abs(placed[150:] - x[150:, :2]).mean() < 0.6


def test_validity_cdf_and_regions(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [0.0]), (2, [float("nan")]), (3, [float("inf")])], "id long, v array<double>")
    assert [r["id"] for r in df.where(is_valid("v")).collect()] == [0]
    z = spark.createDataFrame([(-3.0,), (0.0,), (1.5,)], "z double").select(normal_cdf("z")).collect()
    assert [r[0] for r in z] == pytest.approx([0.5 * (1 + math.erf(v / math.sqrt(2))) for v in (-3, 0, 1.5)], abs=1e-7)
    pts = spark.createDataFrame([(0.0, 0.0), (1.0, 0.0), (0.9, 0.9)], "x double, y double")
    assert pts.where(filters.in_region("circle", 0, 0, 1)).count() == 2 and pts.where(filters.in_region("box", 0, 0, 1)).count() == 3


def test_encoder_errors_mark_their_rows(spark):
    def encode(values):
        if "bad" in values:
            raise OSError("no")
        return [[len(v)] for v in values]

    rows = {r["id"]: r for r in apply_encoder(spark.createDataFrame([(0, "abc"), (1, "bad"), (2, "x")], "id long, text string"), encode, "text").collect()}
    assert rows[0]["vec"] == [3.0] and rows[2]["ok"] and not rows[1]["ok"] and rows[1]["retryable"]


def test_signature_ignores_order(spark):
    a = spark.createDataFrame([(i, f"p{i}") for i in range(50)], "m long, path string")
    assert store.signature(a, ["path", "m"]).first() == store.signature(a.orderBy(F.desc("m")).repartition(3), ["path", "m"]).first()
    assert store.signature(a, ["path", "m"]).first() != store.signature(a.where("m > 0"), ["path", "m"]).first()


def test_bridges_are_a_maximum_spanning_tree(spark):
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(size=(6, 4)) * 0.1 + rng.normal(size=4) for _ in range(5)] + [rng.normal(size=(2, 4))])
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vec array<double>")
    inner = [(6 * c + i, 6 * c + i + 1, 1.0) for c in range(5) for i in range(5)]  # five chains and two rows without an edge
    edges = spark.createDataFrame(inner, "src long, dst long, weight double")
    got = {(r["src"], r["dst"]): r["weight"] for r in graph.bridged(edges, rows).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    of, tree = [min(i // 6, 5) if i < 31 else 6 for i in range(32)], {}
    for score, i, j in sorted(((-round(float(u[i] @ u[j]), 6), i, j) for i in range(32) for j in range(i + 1, 32))):
        if of[i] != of[j]:
            tree[i, j], of = max(0.0, -score), [of[i] if c == of[j] else c for c in of]
    assert {k: w for k, w in got.items() if k not in {(a, b) for a, b, _ in inner}} == pytest.approx(tree) and len(tree) == 6
    assert graph.bridged(edges, rows, most=6).count() == len(inner)


def test_more_than_512_components_are_bridged_too(spark):
    """They were left apart. Three copies of each row are a component, with ties between copies; a row without a cosine stays alone."""
    v = np.random.default_rng(5).normal(size=(530, 4))
    rows = spark.createDataFrame([(3 * i + c, x.tolist()) for i, x in enumerate(v) for c in range(3)] + [(1590, [float("nan")] * 4)], "id long, vec array<double>")
    inner = [(3 * i, 3 * i + c, 1.0) for i in range(530) for c in (1, 2)]
    edges = spark.createDataFrame(inner, "src long, dst long, weight double")
    got = {(r["src"], r["dst"]): r["weight"] for r in graph.bridged(edges, rows).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s, at, tree = np.round(u @ u.T, 6), np.triu_indices(530, 1), {}
    of = np.arange(530)
    for place in np.lexsort((at[1], at[0], -s[at])):
        i, j = int(at[0][place]), int(at[1][place])
        if of[i] != of[j]:
            tree[3 * i, 3 * j] = max(0.0, float(s[i, j]))
            of[of == of[i]] = of[j]
    assert {k: w for k, w in got.items() if k not in {(a, b) for a, b, _ in inner}} == pytest.approx(tree) and len(tree) == 529 and len(got) == 1060 + 529


def test_rank_correlation_of_distances(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 2))
    high = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(x)], "id long, vec array<double>")
    low = spark.createDataFrame([(i, float(3 * a[0]), float(3 * a[1])) for i, a in enumerate(x)], "id long, x double, y double")
    one = spark.createDataFrame([(i, 0.0, 0.0) for i in range(40)], "id long, x double, y double")
    assert layout.broad_spearman(high, low).first()["rho"] == 1.0
    assert layout.broad_spearman(high, one).first()["rho"] is None and layout.broad_spearman(high.limit(2), low).first()["rho"] is None
    assert layout.broad_spearman(high.limit(0), low).first()["rho"] is None


def test_levels_go_on_until_nothing_merges(spark):
    """Four levels left a long chain in pieces; how many there must be depends on the graph's size."""
    chain = spark.createDataFrame([(i, i + 1, 1.0) for i in range(60)], "src long, dst long, weight double").coalesce(1)
    some, every = (graph.communities(chain, gamma=0.0, rounds=2, levels=n).groupBy("community").agg(F.min("v"), F.max("v"), F.count("*")).collect() for n in (4, None))
    assert 2 * len(every) <= len(some) and all(hi - lo + 1 == n and lo == c for c, lo, hi, n in every) and sum(r[3] for r in every) == 61


def test_best_columns_against_a_whole_sort():
    r = np.random.default_rng(2)
    s = r.integers(0, 40, size=(50, 3000)) / 40  # many ties
    s[0], s[1, 5] = np.nan, 2.0
    own = lambda i, j: i == j
    odd = lambda i, j: (i == j) | (j % 2 == 1)
    for least in (None, np.full(50, 0.975)):
        for (i, j, v), no in zip(search.best_columns(lambda a, b: s[:, a:b], 50, 3000, 7, [own, odd], least), (own, odd), strict=True):
            want = []
            for x in range(50):
                ok = [y for y in range(3000) if s[x, y] == s[x, y] and not no(x, y) and (least is None or s[x, y] >= least[x])]
                want += [(x, y, round(s[x, y], 6)) for y in sorted(ok, key=lambda y: (-s[x, y], y))[:7]]
            assert list(zip(i.tolist(), j.tolist(), v.tolist(), strict=True)) == want


@pytest.mark.parametrize("tile", [8, 1024])
def test_two_blocks_meet_once_for_both(monkeypatch, tile):
    """Against a whole sort: copies, ties, null vectors, NaN, barred pairs, more asked for than there are; tiles that end anywhere."""
    monkeypatch.setattr(search, "COLUMNS", tile)
    monkeypatch.setattr(search, "ROWS", min(search.ROWS, tile // 2))
    r = np.random.default_rng(8)
    for n, m, d, k in ((61, 83, 8, 5), (40, 90, 2, 7), (5, 30, 3, 10)):
        x, y = r.normal(size=(n, d)), r.normal(size=(m, d))
        if d == 2:
            x, y = np.round(x), np.round(y)
        x, y = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12) for v in (x, y))
        x[3], y[4, 1] = 0.0, np.nan
        barred = lambda i, j: (i % 3 == j % 3) | (i == j)
        mine, theirs = search.meet(x, y, k, barred, both=True)
        for (i, j, v), a, b, no in ((mine, x, y, barred), (theirs, y, x, lambda i, j: barred(j, i)), (search.meet(x, y, k, barred)[0], x, y, barred)):
            s, want = np.round(a @ b.T, 6), []
            for own in range(len(a)):
                ok = [o for o in range(len(b)) if s[own, o] == s[own, o] and not no(own, o)]
                want += [(own, o, s[own, o]) for o in sorted(ok, key=lambda o: (-s[own, o], o))[:k]]
            assert list(zip(i.tolist(), j.tolist(), v.tolist(), strict=True)) == want


def test_each_pair_of_rows_is_in_one_group(spark):
    """It was in two, one for each row."""
    df = spark.createDataFrame([(i, [1.0, float(i)], 0) for i in range(30)], "id long, vec array<double>, label int")
    groups = {}
    for r in search.paired(df, ["vec"], blocks=4).collect():
        groups.setdefault((r["a"], r["b"]), []).append((r["side"], r["id"]))
    seen = []
    for (a, b), rows in groups.items():
        assert a <= b
        ids = [[i for s, i in rows if s == side] for side in (0, 1)]
        seen += [frozenset((i, j)) for i in ids[0] for j in (ids[0] if a == b else ids[1]) if a != b or i < j]
    assert len(seen) == len(set(seen)) == 30 * 29 // 2


def counted(df):
    """df and an accumulator of the rows that were made of it."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return df.mapInArrow(run, df.schema), seen


def test_moments_read_their_rows_once(spark):
    df, seen = counted(spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "id long, vec array<double>"))
    n, s, p = layout.moments(df, ["vec"])
    assert (n, s.tolist(), p.tolist()) == (20, [190.0, 20.0], [[2470.0, 190.0], [190.0, 20.0]]) and seen.value == 20
    n, s, p = layout.moments(df.limit(0), ["vec"])
    assert n == 0 and s.shape == (0,) and p.shape == (0, 0)


def test_graph_operators_make_their_edges_once(spark):
    links = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (4, 5, 1.0)], "src long, dst long, weight double")
    rows = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(1, 6)], "id long, vec array<double>")
    for run in (lambda e: graph.bridged(e, rows, most=1), lambda e: graph.communities(e, rounds=2, levels=1), lambda e: graph.modularity(e, rows.select(F.col("id").alias("v"), F.lit(1).alias("community")))):
        edges, seen = counted(links)
        run(edges).collect()
        assert seen.value == 3


def test_a_batch_is_projected_without_python_numbers():
    import tracemalloc

    import pyarrow as pa

    x, basis = np.arange(640_000, dtype=np.float64).reshape(10_000, 64), np.eye(64)[:, :3]
    b = pa.RecordBatch.from_arrays([search.lists(x)], ["vec"])
    tracemalloc.start()
    got = layout.projected_batch(b, np.ones(64), basis, "out")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got["out"].to_pylist() == (x[:, :3] - 1).tolist() and got["vec"].equals(b["vec"]) and peak < 12e6
