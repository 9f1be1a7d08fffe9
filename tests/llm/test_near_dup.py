import random
from collections import Counter

import numpy as np
import pytest

from vecatlas.llm import common, graph, near_dup
from vecatlas.llm.near_dup import bag_signatures, classes
from vecatlas.llm.shingles import WordHashes, multiset, similarity


def grams(text):
    words = (text or "").lower().split()
    k = min(5, len(words))
    return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if k else Counter()


def brute(texts):
    bags, up = [grams(t) for t in texts], list(range(len(texts)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            total = sum((bags[i] | bags[j]).values())
            if not total or sum((bags[i] & bags[j]).values()) / total >= 0.8:
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return [top(i) for i in range(len(texts))]


def test_signature_is_unbiased_for_weights():
    rng = np.random.default_rng(3)
    n, m = 300, 2048
    h = rng.integers(0, 2**63, n).astype(np.uint64)
    a, b = rng.integers(0, 9, n), rng.integers(0, 9, n)
    a[:5], b[:5] = (100, 1, 64, 65, 1000), (90, 2, 65, 64, 900)
    pick = [(h[c > 0], c[c > 0]) for c in (a, b)]
    doc = np.repeat([0, 1], [len(p[0]) for p in pick])
    sig = bag_signatures(np.concatenate([p[0] for p in pick]), np.concatenate([p[1] for p in pick]), doc, 2, m)
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((sig[0] == sig[1]).mean() - true) < 4 * np.sqrt(true * (1 - true) / m)


def test_similarity_counts_repeats():
    w = WordHashes()
    assert similarity(multiset(b"a a a a a a", w), multiset(b"a A a a a a a", w)) == 2 / 3
    assert similarity(multiset(b"", w), multiset(b" \n", w)) == 1.0


@pytest.mark.parametrize("bound", [None, 0])  # with 0 nothing is broadcast and hot keys are salted
def test_classes_against_brute_force(spark, bound, monkeypatch):
    if bound is not None:
        monkeypatch.setattr(common, "BROADCAST_IDS", bound)
        monkeypatch.setattr(near_dup, "BROADCAST_IDS", bound)
    rnd = random.Random(11)
    vocab = [f"v{i}" for i in range(400)]
    texts = [None, "", "  ", "one", "One", "one two three", "one two", "z " * 3000, "z " * 2500]
    for i in range(25):
        base = rnd.choices(vocab, k=rnd.randint(30, 300))
        texts.append(" ".join(base))
        for j in range(rnd.randint(0, 6)):
            edit = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 35))):
                edit[rnd.randrange(len(edit))] = rnd.choice(vocab)
            texts.append(" ".join(edit))
    chain = rnd.choices(vocab, k=200)  # each like the next, the ends unlike
    for i in range(12):
        chain = list(chain)
        chain[15 * i : 15 * i + 3] = rnd.choices(vocab, k=3)
        texts.append(" ".join(chain))
    hub = rnd.choices(vocab, k=120)
    for i in range(60):  # like a hub, hardly like each other
        edit = list(hub)
        edit[2 * i] = f"own{i}"
        texts.append(" ".join(edit))
    texts.append(" ".join(hub))
    texts += [texts[20], texts[20].upper()]
    frame = spark.createDataFrame([(1000 - i, t, 5, b"x") for i, t in enumerate(texts)] + [(None, texts[21], 5, b"x"), (980, texts[20], 5, b"x")], "doc_id long, text string, row int, sig binary")
    rows = classes(frame).collect()
    assert len(rows) == len(texts) + 2
    want = brute(texts)
    least = {}
    for i, c in enumerate(want):
        least[c] = min(least.get(c, 10**9), 1000 - i)
    got = {r["doc_id"]: r["class_id"] for r in rows}
    assert {1000 - i: least[c] for i, c in enumerate(want)} == {k: v for k, v in got.items() if k is not None}
    assert got[None] == got[1000 - 21]
    kept = Counter(r["class_id"] for r in rows if r["is_kept"])
    assert set(kept.values()) == {1} and len(kept) == len(set(want))


def test_empty_table(spark):
    assert classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def reordered(frame):
    """The rows in another order at every scan, as when files are split in another way."""

    def run(batches):
        import os

        import pyarrow as pa

        whole = pa.Table.from_batches(list(batches))
        if whole.num_rows:
            yield from whole.take(sorted(range(whole.num_rows), key=lambda i: os.urandom(8))).to_batches()

    return frame.coalesce(1).mapInArrow(run, frame.schema)


def test_order_of_scans_does_not_matter(spark):
    rnd = random.Random(5)
    texts = [" ".join(rnd.choices([f"v{i}" for i in range(400)], k=100)) for _ in range(60)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(100 + i, t + " end") for i, t in enumerate(texts)]
    rows = classes(reordered(spark.createDataFrame(docs, "doc_id long, text string"))).collect()
    assert {r["doc_id"]: r["class_id"] for r in rows} == {i: i % 100 for i, _ in docs}


def test_recall_on_documents(spark):
    """All pairs of 0.8 and more of a table of documents share a class, and classes hold nothing else."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    bags, places = [grams(t) for _, t in rows], {}
    for i, bag in enumerate(bags):
        for g in bag:
            places.setdefault(g, []).append(i)
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    pairs = {(i, j) for some in places.values() for i in some[:50] for j in some if i < j} | {(i, j) for i in range(len(rows)) for j in range(i) if not bags[i] and not bags[j]}
    links = {(i, j) for i, j in pairs if not bags[i] or sum((bags[i] & bags[j]).values()) >= 0.8 * sum((bags[i] | bags[j]).values())}
    for i, j in links:
        up[max(top(i), top(j))] = min(top(i), top(j))
    got = {r["doc_id"]: r["class_id"] for r in classes(docs).collect()}
    found = sum(got[rows[i][0]] == got[rows[j][0]] for i, j in links)
    assert len(links) > 20 and found >= 0.99 * len(links)
    want = {}
    for i in range(len(rows)):
        want.setdefault(top(i), set()).add(rows[i][0])
    mine = {}
    for d, c in got.items():
        mine.setdefault(c, set()).add(d)
    assert all(any(m <= w for w in want.values()) for m in mine.values())


def test_meetings_lose_no_link(spark):
    """Texts of one origin, most of them less alike than 0.8: all links meet, and of the other pairs few do."""
    rnd = random.Random(2)
    vocab = [f"v{i}" for i in range(3000)]
    base, texts = rnd.choices(vocab, k=150), []
    for _ in range(500):
        words = list(base)
        for at in rnd.sample(range(150), rnd.choice([1, 3, 6, 9, 12])):
            words[at] = rnd.choice(vocab[:40])
        texts.append(" ".join(words))
    frame = spark.createDataFrame([(i, t.encode(), i) for i, t in enumerate(texts)], "row long, text binary, label long")
    met = graph.meetings(common.stash(frame.select("row", "text"), "t"), common.stash(frame.select("row", "label"), "l"), near_dup._overlap()).collect()
    bags = [grams(t) for t in texts]
    like = {(i, j) for j in range(500) for i in range(j) if sum((bags[i] & bags[j]).values()) >= 0.8 * sum((bags[i] | bags[j]).values())}
    pairs = {(min(r), max(r)) for r in met}
    assert like <= pairs and 100 < len(like) and len(pairs) == len(met) < 0.6 * 500 * 499 / 2


def test_large_bucket_of_loosely_alike_texts(spark):
    rnd = random.Random(3)
    vocab = [f"v{i}" for i in range(3000)]
    base, texts = rnd.choices(vocab, k=150), []
    for _ in range(5000):
        words = list(base)
        for at in rnd.sample(range(150), rnd.choice([1, 4, 5, 6, 7])):
            words[at] = rnd.choice(vocab)
        texts.append(" ".join(words))
    rows = classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    of = {r["doc_id"]: r["class_id"] for r in rows}
    sample = rnd.sample(range(5000), 300)
    bags = {i: grams(texts[i]) for i in sample}
    links = [(i, j) for i in sample for j in sample if i < j and sum((bags[i] & bags[j]).values()) >= 0.8 * sum((bags[i] | bags[j]).values())]
    assert len(links) > 100 and sum(of[i] == of[j] for i, j in links) >= 0.99 * len(links)
