from collections import Counter, defaultdict

from vecatlas.llm.sharding import shard


def check(rows, shards, slack):
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    assert all(0 <= s < shards for s in by)
    for part in by.values():
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
    sizes = [sum(r["size"] for r in by.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= slack


def test_near_equal_bytes_and_whole_groups(spark):
    texts = [f"text {i // 3} " + "x" * (i * 37 % 211) for i in range(3000)] + [f"same {i // 2}" for i in range(40)]
    rows = shard(spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, size int"), 6).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(range(len(texts)))
    check(rows, 6, 1200)
    assert all(r["size"] == len(texts[r["doc_id"]]) + 8 for r in rows)
    at = {r["doc_id"]: r["shard"] for r in rows}
    assert all(at[3000 + 2 * i] == at[3001 + 2 * i] for i in range(20))


def test_hot_text_is_divided(spark):
    texts = ["hot"] * 2000 + [f"t{i}" for i in range(2000)]
    rows = shard(spark.createDataFrame([(i % 3500, t) for i, t in enumerate(texts)], "doc_id long, text string"), 8).collect()
    assert len(rows) == 4000
    check(rows, 8, 100)


def test_nulls_and_empty(spark):
    rows = shard(spark.createDataFrame([(None, None), (1, ""), (2, None), (None, "é")], "doc_id long, text string"), 3).collect()
    assert sorted(r["size"] for r in rows) == [8, 8, 8, 10]
    assert shard(spark.createDataFrame([], "doc_id long, text string"), 3).count() == 0
