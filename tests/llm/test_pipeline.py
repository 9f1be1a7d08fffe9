import random
from collections import defaultdict

import corpus_pipeline as p
from tokenizers import Tokenizer

from vecatlas.llm.packing import unpack_ids
from vecatlas.llm.queries import tokenizer_path

WORDS = [f"word{i}" for i in range(500)]


def tables(path, spark):
    rnd = random.Random(6)
    docs, labels, fate = [], [], {}
    bench = [(i, " ".join(rnd.choices(WORDS, k=30))) for i in range(5)]
    for i in range(400):
        words = rnd.choices(WORDS, k=rnd.randint(80, 120))
        what = rnd.choices(["clean", "toxic", "junk", "leak"], [6, 1, 1, 1])[0]
        if what == "toxic":
            for _ in range(5):
                words.insert(rnd.randrange(len(words)), rnd.choice(["vile", "nasty"]))
        if what == "leak":
            words[10:10] = bench[i % 5][1].split()
        text = " ".join(words)
        if what == "junk":
            text = " ".join(f"%%{w.upper()}!!" for w in words)
        fate[i] = what
        docs.append((i, text, "en", "src", len(text)))
        if i % 2 == 0 or what == "leak":
            labels.append((i, int(what != "junk"), int(what == "toxic")))
    clean = [i for i, w in fate.items() if w == "clean"]
    for k, i in enumerate(clean[:30]):
        words = docs[i][1].split()
        if k % 2:
            words[len(words) // 2] = "edited"
        docs.append((1000 + k, " ".join(words), "en", "src", 5))
        fate[1000 + k] = "copy"
    docs.append((clean[40], docs[clean[40]][1], "en", "src", 5))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return {d[0]: d[1] for d in docs}, fate


def test_planted_cases(spark, tmp_path):
    texts, fate = tables(str(tmp_path), spark)
    assert [n for n, _ in p.STAGES] == ["toxicity", "quality classifier", "MinHash near-dedup", "benchmark decontamination", "packing"]
    rows = p.run(spark, str(tmp_path)).collect()
    pieces = defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
    wrong = {i for i, w in fate.items() if (i in pieces) != (w == "clean")}
    assert len(wrong) <= 6 and not any(fate[i] in ("copy", "leak") for i in wrong)
    tokenizer = Tokenizer.from_file(tokenizer_path())
    for i, own in list(pieces.items())[:20]:
        ids = [x for r in sorted(own, key=lambda r: r["start"]) for x in unpack_ids(r["ids"])]
        assert ids == tokenizer.encode(texts[i], add_special_tokens=False).ids + [1]


def test_filtering_stages_return_documents(spark, tmp_path):
    tables(str(tmp_path), spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").selectExpr("*", "1 as score", "2 as row", "'x' as item_id")
    for _, stage in p.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def reordered(frame):
    """The rows in another order at every scan, as when files are split in another way."""

    def run(batches):
        import os

        import pyarrow as pa

        whole = pa.Table.from_batches(list(batches))
        if whole.num_rows:
            yield from whole.take(sorted(range(whole.num_rows), key=lambda i: os.urandom(8))).to_batches()

    return frame.coalesce(1).mapInArrow(run, frame.schema)


def test_near_duplicates_go_in_any_order_of_scans(spark, tmp_path):
    rnd = random.Random(5)
    texts = [" ".join(rnd.choices(WORDS, k=100)) for _ in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = p.drop_near_duplicates(spark, reordered(docs), str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in rows) == list(enumerate(texts))
