import random
import re
import zlib
from collections import Counter

import pytest

from vecatlas.llm.common import stash
from vecatlas.llm.spelling import groups, variants, with_roots

SCHEMA = "doc_id long, text string, word string, n int, key int"


def edits(word, letters):
    for i in range(len(word) + 1):
        for c in letters:
            yield word[:i] + c + word[i:]
        if i < len(word):
            yield word[:i] + word[i + 1 :]
            yield from (word[:i] + c + word[i + 1 :] for c in letters)


def near_words(n):
    letters = sorted(set("".join(n)))
    return {w: {v for v in edits(w, letters) if v in n and v != w} for w in n}


def expected(n):
    form = {}
    for w, others in near_words(n).items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = (len(others), best if best is not None and n[best] >= 2 * n[w] else None)
    out = {}
    for w in n:
        root = w
        while form[root][1] is not None:
            root = form[root][1]
        out[w] = (form[w][1], root, n[w], form[w][0], n.get(form[w][1]))
    return out


def counted(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def shown(df):
    rows = df.collect()
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(out) == len(rows)
    return out


def of(vocabulary, spark, **kw):
    df = stash(spark.createDataFrame(list(vocabulary.items()), "word string, n long"), "words")
    return shown(with_roots(stash(variants(df, **kw), "forms")))


@pytest.fixture(scope="module")
def vocabulary():
    rnd = random.Random(8)
    words = {"".join(rnd.choices("abé", k=rnd.randint(5, 8))) for _ in range(900)} | {"a" * k for k in range(5, 40)} | {"abc" * 300, "abc" * 300 + "d", "x" + "abc" * 300, "abcdeé", "abcdeè"}
    return {w: rnd.choice([3, 5, 5, 9, 20, 90, 1000]) for w in sorted(words)}


@pytest.mark.parametrize(("holes", "split"), [(3, 4096), (2, 20), (4, 7)])
def test_every_near_word_is_counted_once(spark, vocabulary, holes, split):
    assert of(vocabulary, spark, holes=holes, split=split) == expected(vocabulary)


def test_whole_texts(spark):
    rnd = random.Random(9)
    kinds = ["".join(rnd.choices("abcdÀéü÷", k=rnd.randint(4, 9))) for _ in range(60)]
    kinds += [k[:3] + rnd.choice("abÀ") + k[4:] for k in kinds]
    rows = [(rnd.choice([None, *range(300)]), rnd.choice([" ", ", ", "1", "\n"]).join(k.upper() if rnd.random() < 0.2 else k for k in rnd.choices(kinds, k=60))) for _ in range(400)]
    rows += [(1, None), (2, ""), (3, "q" * 100_000), (3, "q" * 100_000), (4, "q" * 100_000), (5, "Grün grün GRÜN GRÜN wort"), *[(7, "same same again again")] * 5]
    docs = spark.createDataFrame([(i, t, "w", 1, 2) for i, t in rows], SCHEMA).repartition(5)
    n = counted(rows)
    assert len(n) > 100 and shown(groups(docs)) == expected(n)


def test_chains_and_ties(spark):
    n = {"aaaaa" + "b" * k: 2**k for k in range(2, 30)} | {"zebra": 4, "zebre": 8, "zebrc": 8, "zabra": 7, "other": 5, "othes": 9}
    out = of(n, spark)
    assert out == expected(n)
    assert out["aaaaabb"][1] == "aaaaa" + "b" * 29 and out["zebra"][0] == "zebrc" and out["other"][:2] == (None, "other")


def test_no_words(spark):
    assert groups(spark.createDataFrame([], SCHEMA)).collect() == []
    assert groups(spark.createDataFrame([(1, None, "", 1, 2), (2, "a b c 12 !!", "", 1, 2)], SCHEMA)).collect() == []
