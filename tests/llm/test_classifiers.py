import random
import zlib

import numpy as np

from vecatlas.llm import quality, toxicity
from vecatlas.llm.common import fold
from vecatlas.llm.linear import auc

WORDS = [f"w{i}" for i in range(300)]
BAD = ["vile", "nasty", "awful"]


def corpus(n=900):
    rnd = random.Random(8)
    docs, labels = [], []
    for i in range(n):
        words = rnd.choices(WORDS, k=rnd.randint(5, 80))
        toxic, good = rnd.random() < 0.2, rnd.random() < 0.7
        if toxic:
            for _ in range(3):
                words.insert(rnd.randrange(len(words)), rnd.choice(BAD) + rnd.choice(["", ",", "!"]))
        text = " ".join(words) if good else " ".join(f"{w.upper()}%%" for w in words)
        docs.append((i, text, "en", "good.org" if good == (rnd.random() < 0.8) else "bad.org", len(text), 0.5))
        if i % 2 == 0:
            labels.append((i, int(good), int(toxic)))
    docs += [(n, None, None, None, None, 0.1), (n + 1, "", "en", "x", 0, 0.1), (None, "a null id", "en", "x", 9, 0.1), (5, "a repeated id", "en", "x", 3, 0.1), (n + 2, "word " * 60000, "en", "x", 300000, 0.1)]
    return docs, labels + [(0, None, None), (None, 1, 1)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double"


def tables(spark):
    docs, labels = corpus()
    return spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def test_toxicity_on_held_out_rows(spark):
    docs, labels, known = tables(spark)
    model = toxicity.fit(docs, labels, fold("doc_id", 3) != 1)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    truth = {i: t for i, _, t in known if i and t is not None and zlib.crc32(str(i).encode()) % 3 == 1}
    held = [(r["score"], truth[r["doc_id"]], r["predicted"]) for r in rows if r["doc_id"] in truth]
    score, y, p = map(np.array, zip(*held))
    assert auc(score, y) > 0.97 and p[y == 1].mean() > 0.85 and p[y == 0].mean() < 0.03
    empty = [r for r in rows if r["doc_id"] in (900, 901)]
    assert empty[0]["score"] == empty[1]["score"] < 0.5


def test_held_out_labels_do_not_matter(spark):
    docs, labels, _ = tables(spark)
    flipped = labels.selectExpr("doc_id", "quality", "if(crc32(coalesce(cast(doc_id as string), '')) % 3 = 1, 1 - toxic, toxic) as toxic")
    a, b = (toxicity.fit(docs, x, fold("doc_id", 3) != 1) for x in (labels, flipped))
    assert a.prior == b.prior and a.weights.keys() == b.weights.keys()
    assert all(abs(w - b.weights[k]) < 1e-6 for k, w in a.weights.items()) and abs(a.slope - b.slope) < 1e-6


def test_risk_and_gradient_against_brute_force():
    """One step with a tiny rate goes down the risk as written in the docstring, or up its second part where that is negative."""
    rng = np.random.default_rng(6)
    for prior in (0.05, 0.9):  # with the second most second parts are negative
        pos, unl = ([rng.integers(0, 5, rng.integers(0, 4)) for _ in range(n)] for n in (30, 80))
        start = (rng.normal(size=5) * 2, 0.3)
        w, b = toxicity.nn_pu(pos, unl, 5, prior, start, steps=1, rate=1e-3, l2=0)

        def parts(w, b):
            z = [np.array([sum(w[i] for i in r) + b for r in rows]) for rows in (pos, unl)]
            loss = lambda z: np.log1p(np.exp(-z))
            return prior * loss(z[0]).mean(), loss(-z[1]).mean() - prior * loss(-z[0]).mean()

        eps = 1e-6
        grad = []
        for i in range(6):
            hi, lo = (parts(start[0] + s * eps * (np.arange(5) == i), start[1] + s * eps * (i == 5)) for s in (1, -1))
            a, c = ((hi[k] - lo[k]) / (2 * eps) for k in (0, 1))
            grad.append(a + c if parts(*start)[1] >= 0 else -c)
        assert (np.sign(np.append(w - start[0], b - start[1])) == -np.sign(grad)).all()  # the first step of Adam is the gradient's sign


def test_calibration_needs_no_confirmed_harmless_texts():
    rng = np.random.default_rng(7)
    toxic = rng.random(40_000) < 0.2
    z = rng.normal(size=40_000) + 3 * toxic
    slope, offset = toxicity.calibrated(3 + rng.normal(size=3000), *np.unique(np.round(z, 2), return_counts=True), 0.2)
    p = 1 / (1 + np.exp(-(slope * z + offset)))
    assert abs(p.mean() - 0.2) < 0.03 and abs(toxic[(p > 0.4) & (p < 0.6)].mean() - 0.5) < 0.1


def test_toxicity_without_teachers(spark):
    docs, labels, _ = tables(spark)
    rows = toxicity.score(docs, toxicity.fit(docs, labels.limit(0), fold("doc_id", 3) != 1)).collect()
    assert {r["score"] for r in rows} == {0.0}
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), labels, fold("doc_id", 3) != 1)).count() == 0


def test_non_negative_step_keeps_the_risk_up():
    rng = np.random.default_rng(1)
    pos = [np.array([0]) for _ in range(50)]
    unl = [np.array([0]) if rng.random() < 0.3 else np.array([1]) for _ in range(300)]
    w, b = toxicity.nn_pu(pos, unl, 2, 0.3)
    assert w[0] + b > 0 > w[1] + b


def test_quality_on_held_out_rows(spark):
    docs, labels, known = tables(spark)
    model = quality.fit(docs, labels, fold("doc_id", 3) != 1)
    rows = quality.score(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    truth = {i: q for i, q, _ in known if i and q is not None and zlib.crc32(str(i).encode()) % 3 == 1}
    score, y = map(np.array, zip(*[(r["score"], truth[r["doc_id"]]) for r in rows if r["doc_id"] in truth]))
    assert auc(score, y) > 0.98 and ((score >= 0.5) == y).mean() > 0.95


def test_views_teach_each_other():
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 2000)
    x, m = (y[:, None] * 1.5 + rng.normal(size=(2000, k)) * [1.0] + 0 for k in (1, 1))
    x, m = np.hstack([x, rng.normal(size=(2000, 30))]).astype(np.float32), np.hstack([m, rng.normal(size=(2000, 30))]).astype(np.float32)
    pool = quality.in_memory(x[60:], m[60:])
    alone, taught = (quality.co_train(x[:60], m[:60], y[:60], pool, rounds=n, confident=100) for n in (0, 8))
    assert auc(taught.score(x[60:], m[60:]), y[60:]) > auc(alone.score(x[60:], m[60:]), y[60:]) + 0.01


def test_stored_pool_names_what_the_one_in_memory_does(spark):
    rng = np.random.default_rng(4)
    x, m = rng.normal(size=(300, quality.CONTENT)).astype(np.float16), rng.normal(size=(300, quality.META)).astype(np.float16)
    rows = spark.createDataFrame([(i, x[i].tobytes(), m[i].tobytes()) for i in range(300)], "row long, x binary, m binary").repartition(3)
    fits = [rng.normal(size=quality.CONTENT + 1), rng.normal(size=quality.META + 1)]
    for named in (set(), set(range(0, 300, 2)), set(range(300))):
        a, b = quality._stored(rows)(fits, named, 20, 30), quality.in_memory(x, m)(fits, named, 20, 30)
        assert a[0] == b[0] and list(a[3]) == list(b[3]) and a[4] == b[4]
        assert not a[0] or ((a[1] == b[1]).all() and (a[2] == b[2]).all())


def test_quality_without_labels_or_rows(spark):
    docs, labels, _ = tables(spark)
    assert {r["score"] for r in quality.score(docs, quality.fit(docs, labels.limit(0))).collect()} == {0.5}
    assert quality.score(docs.limit(0), quality.fit(docs.limit(0), labels)).count() == 0


def test_every_unlabelled_text_takes_part():
    for n in range(60):
        parts = list(toxicity.chunks(range(n), 8))
        assert [x for p in parts for x in p] == list(range(n))
        assert all(len(p) == 8 for p in parts[:-1]) and (n < 2 or len(parts[-1]) >= 2)
