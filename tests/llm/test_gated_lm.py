import math
import random
import zlib
from collections import Counter
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vecatlas.llm import gated_lm as lm
from vecatlas.llm.common import fold

LANG = {k: [f"{k}{''.join(random.Random(i).choices('abcdefgh', k=4))}" for i in range(60)] for k in "xyz"}


def corpus(n=300):
    rnd, docs = random.Random(3), []
    for i in range(n):
        words = rnd.choices(LANG[rnd.choice("xyz")], weights=[1 / (j + 1) for j in range(60)], k=rnd.randint(1, 150))
        if i % 10 == 0:
            words.append(f"Rare{i}é")
        docs.append((i, " ".join(words)))
    return docs + [(n, None), (n + 1, " \t\n"), (None, "Xa xb"), (4, "twice the id"), (n + 2, "far " * 4000)]


def test_gradient_against_differences():
    rng = np.random.Generator(np.random.PCG64(0))
    model = lm.Gru(lm.HEAD + lm.GROUPS + 1, lm.CLASSES + lm.GROUPS + 1)
    model = model.like(model.flat.astype(np.float64))
    h = rng.normal(size=(40, lm.STATE))
    cls, word = rng.integers(0, lm.CLASSES + 4, 40), rng.integers(0, 32, 40)
    grads, dh = model.like(np.zeros_like(model.flat)), np.zeros_like(h)
    model.log_probs(h, cls, word, grads, dh)
    for a, d in ((model.wc, grads.wc), (model.wv, grads.wv), (h, dh)):
        at = tuple(rng.integers(0, s) for s in a.shape) if a is not model.wv else (int(cls[cls < lm.CLASSES][0]), 3, 2)
        was, eps = a[at], 1e-5
        a[at] = was + eps
        up = -model.log_probs(h, cls, word).mean()
        a[at] = was - eps
        down = -model.log_probs(h, cls, word).mean()
        a[at] = was
        assert abs((up - down) / (2 * eps) - d[at]) < 1e-6


def test_counts_base_and_gain(spark, monkeypatch):
    monkeypatch.setattr(lm, "MID", 2000)
    docs = corpus()
    held = {i for i, _ in docs if zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2}
    rows = lm.score(spark.createDataFrame([(i, t, 1.0) for i, t in docs], "doc_id long, text string, score double"), fold("doc_id", 7) != 2).collect()
    assert len(rows) == len(docs)
    seen = Counter(w for i, t in docs if i not in held for w in lm.tokens((t or "").encode()))
    total, distinct = sum(seen.values()), len(seen)
    want = Counter()
    for i, t in docs:
        words = lm.tokens((t or "").encode())
        base = sum(math.log10((seen[w] + 1) / (total + distinct + 1)) for w in words)
        want[i, len(words), sum(seen[w] > 0 for w in words), total, round(base, 6)] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows) == want
    tested = [r for r in rows if r["doc_id"] in held and r["doc_id"] is not None and r["doc_id"] < 300]
    assert sum(r["score"] for r in tested) > sum(r["base_score"] for r in tested)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in rows)


def test_windows_do_not_matter():
    docs = [t or "" for _, t in corpus(40)]
    seen = Counter(w for t in docs for w in lm.tokens(t.encode()))
    words = sorted(seen, key=lambda w: (w != lm.END, -seen[w], w))
    n = np.array([seen[w] for w in words], dtype=float)
    size = len(words)
    voc = lm.Vocabulary({w: i for i, w in enumerate(words)}, np.append(np.arange(size), lm.HEAD + lm.GROUPS), np.append(np.arange(size) % lm.CLASSES, lm.CLASSES + lm.GROUPS), np.append(np.arange(size) // lm.CLASSES, 0), np.zeros(size), np.log10((n + 1) / (n.sum() + size + 1)), int(n.sum()), size, 0, 0.0, 1.0, 0.1)
    model = lm.start(voc, n)
    got = lm._scored([t.encode() for t in docs], voc, model)[3]
    for t, s in zip(docs, got, strict=True):
        h, total = np.zeros((1, lm.STATE), dtype=np.float32), 0.0
        for w in lm.tokens(t.encode()):
            i = voc.index[w]
            total += model.log_probs(h, voc.cls[i : i + 1], voc.word[i : i + 1])[0]
            h = model.step(h, np.array([i]))[0]
        assert s == pytest.approx(total / math.log(10), rel=1e-4)


def test_nothing_to_learn_from(spark):
    none = lm.score(spark.createDataFrame([], "doc_id long, text string"), fold("doc_id", 7) != 2)
    assert none.count() == 0
    rows = lm.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), fold("doc_id", 7) == 99).collect()
    assert rows[0]["n_tokens"] == 3 and rows[0]["n_known"] == 0 and rows[0]["train_tokens"] == 0 and math.isfinite(rows[0]["score"])


def test_every_training_text_teaches(spark):
    docs = corpus()
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "coalesce(text, '') as text")
    voc = lm.vocabulary(lm.count(frame.where(fold("doc_id", 7) != 2)))
    large = replace(voc, total=40 * lm.HEAD * 100_000)  # as of a corpus of which a bounded sample would be a small part
    assert lm.fit(frame, fold("doc_id", 7) != 2, large).taught == voc.total


def test_stream_of_texts_is_gone_through_to_its_end():
    rng = np.random.Generator(np.random.PCG64(1))
    held, most = 0, 0

    def stream():
        nonlocal held, most
        for i in range(50):
            n = int(rng.integers(1, 200))
            held += n
            yield np.full(n, 1 + i, dtype=np.int32), np.full(n, i % lm.CLASSES, dtype=np.int32), np.zeros(n, dtype=np.int32)

    first = lm.Gru(lm.HEAD + lm.GROUPS + 1, lm.CLASSES + lm.GROUPS + 1)
    model, n = lm.train(first, stream(), 0, chunk=500)
    assert n == held
    moved = np.abs(model.e - first.e).sum(axis=1) > 0
    assert moved[1:51].sum() >= 48  # a text of one token has no later one to teach its input for
    one, n = lm.train(first, iter([(np.arange(1, 131, dtype=np.int32), np.full(130, 5, dtype=np.int32), np.arange(130, dtype=np.int32) % 32)]), 0, chunk=1)
    assert n == 130
    assert (one.e - first.e)[1:131].any(axis=1).sum() >= 130 - lm.LANES and one.bv[5].any()


def test_brute_force_score_with_rare_words(spark, monkeypatch):
    """Word by word, with the vocabulary's shares counted anew: named, grouped, rare and unseen words."""
    monkeypatch.setattr(lm, "MID", 400)
    rnd = random.Random(12)
    vocab = ["".join(rnd.choices("abcdefgh", k=5)) for _ in range(6000)]
    docs = [(i, " ".join(rnd.choices(vocab, weights=[1 / (j + 50) for j in range(6000)], k=rnd.randint(0, 300)))) for i in range(120)]
    train = F.col("doc_id") < 100
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    counts = lm.count(frame.where(train))
    voc = lm.vocabulary(counts)
    model = lm.fit(frame, train, voc)
    monkeypatch.setattr(lm, "fit", lambda *a: model)  # the sums of floats differ from run to run
    monkeypatch.setattr(lm, "vocabulary", lambda c: voc)
    got = {r["doc_id"]: r["score"] for r in lm.score(frame, train).collect()}
    seen = Counter(w for i, t in docs if i < 100 for w in lm.tokens(t.encode()))
    rare = {w: c for w, c in seen.items() if w not in voc.index}
    once, twice = (sum(c == k for c in seen.values()) for k in (1, 2))
    unseen = max(1.0, once * (once - 1) / (2 * (twice + 1)))
    in_group = Counter()
    for w, i in voc.index.items():
        in_group[voc.symbol[i]] += seen[w]
    kinds = set()
    for d, t in docs[90:110]:
        h, total = np.zeros((1, lm.STATE), dtype=np.float32), 0.0
        for w in lm.tokens(t.encode()):
            i = voc.index.get(w)
            cls, word, x = (voc.cls[i], voc.word[i], voc.symbol[i]) if i is not None else (lm.CLASSES + lm.GROUPS, 0, voc.rest)
            total += float(model.log_probs(h, np.array([cls]), np.array([word]))[0]) / math.log(10)
            if i is not None and cls >= lm.CLASSES:
                total += math.log10(seen[w] / in_group[x])
            if i is None:
                total += math.log10(voc.known_share * rare[w] / sum(rare.values()) if w in rare else (1 - voc.known_share) / unseen)
            kinds.add((i is None, w in rare, cls < lm.CLASSES))
            h = model.step(h, np.array([x]))[0]
        assert got[d] == pytest.approx(total, rel=1e-4)
    assert len(kinds) == 4
    assert voc.known_share * sum(rare.values()) / sum(rare.values()) + unseen * (1 - voc.known_share) / unseen == pytest.approx(1)


def test_held_out_documents_score_above_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = lm.score(docs, fold("doc_id", 7) != 2).where(fold("doc_id", 7) == 2).select("n_tokens", "base_score", "score").collect()
    n = sum(r["n_tokens"] for r in rows)
    assert sum(r["score"] for r in rows) / n > sum(r["base_score"] for r in rows) / n + 0.1
    assert sum(r["score"] > r["base_score"] for r in rows) > 0.9 * len(rows)


def test_columns_split_as_tokens_do():
    odd = [*(f"{chr(i)}A{chr(i)}b{chr(i)}" for i in [*range(1, 65), 127, 133, 160, 8232]), "", " ", "\r\n\t", " \x0b Straße\x1cÉ  x", "ÀB\x00c d" * 50]
    words, lengths = lm.split(pa.array(odd))
    own = [lm.tokens(t.encode())[:-1] for t in odd]
    assert words.to_pylist() == [w for ws in own for w in ws] and lengths.tolist() == [len(ws) for ws in own]
    words, lengths = lm.split(pa.array(["-", " x ", "y"]).slice(1))
    assert words.to_pylist() == [b"x", b"y"] and lengths.tolist() == [1, 1]


def test_states_are_compared_with_the_classes_many_at_once(monkeypatch):
    """A long text beside short ones had a call, of all classes, for 16 of its tokens."""
    calls, plain = [], lm.Gru.log_probs
    monkeypatch.setattr(lm.Gru, "log_probs", lambda self, h, *a: (calls.append(len(h)), plain(self, h, *a))[1])
    names = [lm.END, b"a", b"b"]
    voc = lm.Vocabulary({w: i for i, w in enumerate(names)}, np.array([0, 1, 2, lm.HEAD + lm.GROUPS]), np.array([0, 0, 1, lm.CLASSES + lm.GROUPS]), np.array([0, 1, 0, 0]), np.zeros(3), np.log10([0.1, 0.5, 0.4]), 100, 3, 0, 0.0, 1.0, 0.1)
    n, known, base, score, rare = lm._scored([b"A b " * 5000, b"", b"z A z y", b"b"], voc, lm.start(voc, np.array([10.0, 50.0, 40.0])))
    assert n.tolist() == [10001, 1, 5, 2] and known.tolist() == [10001, 1, 2, 2] and sum(calls) == 10009 and len(calls) == 1
    assert base[2] == pytest.approx(math.log10(0.5) + math.log10(0.1)) and np.isfinite(score).all()
    assert [{r["word"]: r["times"] for r in rs} for rs in rare.to_pylist()] == [{}, {}, {b"z": 2, b"y": 1}, {}]
