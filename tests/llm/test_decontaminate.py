import random
from collections import Counter

from pyspark.sql import functions as F

from vecatlas.llm import decontaminate as dc
from vecatlas.llm.decontaminate import leaks, without_leaks


def grams(words):
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(docs, items):
    found = {}
    for d, text in docs:
        words = (text or "").lower().split()
        for i, item in items:
            want = (item or "").lower().split()
            if not want:
                continue
            if len(want) < 5:
                at = [j for j in range(len(words) - len(want) + 1) if words[j : j + len(want)] == want]
                if at:
                    found[d, i] = (at[0], 1.0)
                continue
            b = grams(want)
            for s in range(max(1, len(words) - len(want) + 1)):
                a = grams(words[s : s + len(want)])
                common = sum((a & b).values())
                sim = common / max(1, sum((a | b).values()))
                if sim >= 0.8 and sim > found.get((d, i), (0, 0))[1]:
                    found[d, i] = (s, sim)
    return found


def test_against_brute_force(spark):
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rnd.choices(vocab, k=rnd.randint(15, 50)))) for i in range(12)]
    items += [(50, "a a a a a a a a a a a a a a a b b b b b b"), (60, "too few words here"), (70, None), (80, ""), (12, items[0][1])]
    docs = []
    for d in range(60):
        words = rnd.choices(vocab, k=rnd.randint(0, 120))
        if d % 2:
            put = items[d % 12][1].split()
            for _ in range(d % 4):
                put[rnd.randrange(len(put))] = "edit"
            if d % 5 == 0:
                put.insert(3, "more")
            at = rnd.randint(0, len(words))
            words[at:at] = put
        docs.append((d, ("  \n" if d % 3 else "") + " ".join(words).upper()))
    docs += [(100, "x " + items[50 - 38][1] + " y"), (101, items[3][1]), (102, None), (103, ""), (104, " ".join(items[4][1].split()[:-2]))]
    docs += [(None, items[5][1]), (101, items[3][1]), (105, "some too few words here, and Too few words here too few words here"), (106, "too few words")]
    frame = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], "doc_id long, text string, item_id int, start int")
    rows = leaks(frame, spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute(docs, items)
    assert Counter((r["doc_id"], r["item_id"]) for r in rows) == Counter({k: 2 if k[0] == 101 else 1 for k in want})
    for r in rows:
        assert abs(want[r["doc_id"], r["item_id"]][1] - r["similarity"]) < 1e-12


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    bench = some.withColumnRenamed("doc_id", "item_id")
    assert leaks(none, bench).count() == 0
    assert leaks(some, bench.limit(0)).count() == 0
    assert leaks(some, bench).count() == 1


def test_very_long_items_and_repeats(spark):
    """More equal shingles than 16 bits count, and an item of 70,000 words."""
    rnd = random.Random(9)
    long_ = " ".join(rnd.choices([f"w{i}" for i in range(3000)], k=70_000))
    items = [(1, "z " * 70_000), (2, long_)]
    docs = [(1, "z " * 140_000), (2, "before " + long_ + " after"), (3, "z " * 100), (4, "z " * 60_000)]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["start"], r["words"]) for r in leaks(frame, bench).collect()}
    assert got == {(1, 1): (0, 70_000), (2, 2): (1, 70_000), (4, 1): (0, 70_000)}


def test_recall_and_rows_judged_by_their_text(spark):
    """Windows of 0.8 and more at random places are found; rows of one id with two fates go apart."""
    rnd = random.Random(10)
    vocab = [f"v{i}" for i in range(3000)]
    items = [(i, " ".join(rnd.choices(vocab, k=60))) for i in range(8)]
    docs = []
    for d in range(120):
        put = items[d % 8][1].split()
        for at in rnd.sample(range(60), 1 + d % 2):
            put[at] = "edit"
        docs.append((d, " ".join(rnd.choices(vocab, k=100) + put + rnd.choices(vocab, k=50))))
    frame = spark.createDataFrame([*docs, (0, "a clean text that has the id of another one"), (7, None)], "doc_id long, text string")
    want = {k: v for k, v in brute(docs, items).items() if v[1] >= 0.8}
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leaks(frame, bench).collect()}
    assert len(want) > 60 and got <= set(want) and len(got) >= 0.99 * len(want)
    rows = without_leaks(frame, bench).collect()
    assert {r["doc_id"] for r in rows} == {d for d, _ in docs if (d, d % 8) not in got} | {0, 7} and len(rows) == 122 - len({d for d, _ in got})


def test_what_many_items_share_makes_no_candidates(spark):
    rnd = random.Random(11)
    phrase = " ".join(f"p{i}" for i in range(40))
    word = lambda: f"v{rnd.randrange(10**6)}"
    items = [(i, " ".join([word() for _ in range(30)] + [phrase] + [word() for _ in range(30)])) for i in range(300)]
    docs = [(i, items[i][1] if i % 10 == 0 else " ".join([word() for _ in range(50)] + [phrase] + [word() for _ in range(50)])) for i in range(300)]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item long, text string")
    of = lambda df, *keys: dc._words(df.select("text", *keys))
    listed = of(bench, "item").select("item", F.size("h").alias("n"), F.expr(dc._rows_of(5)).alias("sh"))
    assert dc._candidates(of(frame, *dc.keyed("text")), dc._filed(listed)).count() == 30
    rows = leaks(frame, bench, item_col="item").collect()
    assert {(r["doc_id"], r["item_id"], r["start"], r["similarity"]) for r in rows} == {(i, i, 0, 1.0) for i in range(0, 300, 10)}
