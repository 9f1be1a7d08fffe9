import random
import re
from collections import Counter

import numpy as np

from vecatlas.llm.weak_rules import COUNTS, PRIOR, RULES, START, counts, estimate, judge

SCHEMA = "doc_id long, text string, n_words int, at int, h int, votes int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t in rows], SCHEMA)


def counted(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    times = Counter(windows)
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len({i + j for i, x in enumerate(windows) if times[x] > 1 for j in range(5)}), "n_lines": len(lines), "n_letters": sum(c.isalpha() for c in text), "n_capitals": sum(c.isupper() for c in text),
        "n_ends": sum(x[-1] in ".!?" for x in w), "n_runs": len(re.findall(r"[^\w\x20\x09-\x0D]{2,}", text)),
    }


def em(votes, rounds):
    """Dawid and Skene's steps on a matrix of votes, one row a text."""
    v = np.array(votes)
    yes, no, (right, wrong) = v == 1, v == -1, PRIOR
    p, g, b = START[0], np.full(v.shape[1], START[1]), np.full(v.shape[1], START[2])
    q = None
    for _ in range(rounds + 1):
        good = p * np.prod(np.where(yes, g, np.where(no, 1 - g, 1)), axis=1)
        bad = (1 - p) * np.prod(np.where(yes, 1 - b, np.where(no, b, 1)), axis=1)
        q, old = good / (good + bad), (p, g, b)
        p = (q.sum() + right) / (len(q) + right + wrong)
        g = ((q[:, None] * yes).sum(axis=0) + right) / ((q[:, None] * (yes | no)).sum(axis=0) + right + wrong)
        b = (((1 - q)[:, None] * no).sum(axis=0) + right) / (((1 - q)[:, None] * (yes | no)).sum(axis=0) + right + wrong)
    return q, old


def texts():
    rnd = random.Random(4)
    kinds = ["the", "house", "Grün", "été", "stone.", "walks,", "over", "a", "wide", "river", "and", "home!", "again"]
    out = []
    for k in range(300):
        words = [rnd.choice(kinds) + rnd.choice(["", "", "s", "ed", str(k % 7)]) for _ in range(rnd.choice([3, 12, 60, 200]))]
        if k % 10 == 1:
            words = [x + "###" for x in words]
        if k % 10 == 2:
            words = [x.upper() + "!!" for x in words]
        if k % 10 == 3:
            words = words[:9] * 12
        text = "".join(x + rnd.choice([" ", " ", "\n", "\t ", "\r\n"]) for x in words)
        out.append((k if k % 4 else None, text * (3 if k % 10 == 4 else 1)))
    return [*out, (5, None), (6, ""), (6, " \n\t "), (7, "x " * 60_000), (8, " ".join(f"w{i}" for i in range(60_000))), (8, " ".join(f"w{i % 30_000}" for i in range(60_000))), out[3], out[3]]


def test_counts_and_verdicts_against_brute_force(spark):
    rows = texts()
    got = judge(frame(spark, [(k, t) for k, (_, t) in enumerate(rows)])).collect()
    for r, (_, t) in zip(sorted(got, key=lambda r: r["doc_id"]), rows, strict=True):
        own = counted(t)
        assert {c: r[c] for c in COUNTS} == own, (t or "")[:80]
        assert r["base_failed"] == (own["n_words"] < 10 or 100 * own["n_repeat_words"] > 20 * own["n_words"])
    votes = [[{"+": 1, "-": -1, "0": 0}[c] for c in r["votes"]] for r in got]
    q, _ = em(votes, 40)
    assert np.allclose([r["posterior"] for r in got], q, atol=1e-9)
    assert all(r["kept"] == (not r["base_failed"] and p >= 0.5) for r, p in zip(got, q, strict=True))


def test_clean_texts_stay_and_junk_goes(spark):
    rows = [(k, t) for k, (_, t) in enumerate(texts()[:300])]
    kept = {r["doc_id"]: r["kept"] for r in judge(frame(spark, rows)).collect()}
    long = [k for k, t in rows if len(t.split()) >= 60]
    assert all(kept[k] for k in long if k % 10 in (0, 5, 6, 7, 8, 9))
    assert not any(kept[k] for k in long if k % 10 in (1, 2, 3))


def test_estimates_do_not_depend_on_partitions_or_order():
    patterns = [([1, 1, -1], 40), ([1, 0, 1], 500), ([-1, -1, 0], 30), ([0, 0, 0], 3)]
    whole = estimate(patterns, 3)
    votes = [v for v, n in patterns for _ in range(n)]
    q, (p, g, b) = em(votes, 40)
    assert abs(whole.good - p) < 1e-9 and np.allclose(whole.on_good, g) and np.allclose(whole.on_bad, b)
    assert np.allclose(estimate(patterns[::-1], 3).on_bad, whole.on_bad)


def test_no_rows_and_ties(spark):
    assert judge(frame(spark, [])).collect() == []
    assert counts(frame(spark, [])).count() == 0
    rows = judge(frame(spark, [(1, "same words here")] * 3 + [(None, None)])).collect()
    assert len(rows) == 4 and not any(r["kept"] for r in rows) and len({r["votes"] for r in rows if r["doc_id"] == 1}) == 1
    assert len(rows[0]["votes"]) == len(RULES)
