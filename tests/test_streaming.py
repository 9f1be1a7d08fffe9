import random

import pytest
from pyspark.sql import functions as F

from vecatlas.streaming import jobs, watch


def source(spark, tmp_path, parts, schema):
    folder = tmp_path / "in"
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder / f"p{i}"))
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_upsert_equals_batch(spark, tmp_path):
    stream = source(spark, tmp_path, [[("a", 1, 1), ("b", 1, 1)], [("a", 2, 9)]], "path string, seq int, v int")
    jobs.each_batch(stream, jobs.upsert_table(str(tmp_path / "t"), ["path"], "seq"), str(tmp_path / "cp")).awaitTermination(60)
    last = max(p.name for p in (tmp_path / "t").iterdir())
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "t" / last)).select("path", "seq", "v").collect())) == [("a", 2, 9), ("b", 1, 1)]


def test_distinct_work(spark, tmp_path):
    stream = source(spark, tmp_path, [[("k", "a", 1), ("k", "a", 2), ("k", "b", 3)]], "kind string, dedupe_key string, t long").withColumn("ts", F.timestamp_seconds("t"))
    q = jobs.distinct_work(stream).writeStream.format("memory").queryName("work").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r["dedupe_key"] for r in spark.table("work").collect()) == ["a", "b"]


def replay(rows, polls=3, wait=3000, last=None):
    """What settled_files says, one observation after the other."""
    files, out = {}, []

    def ring(until):
        for path, f in files.items():
            if f["waits"] and f["deadline"] <= until:
                out.append((path, f["size"], f["deadline"], "timer"))
                f["waits"] = False

    for path, size, ms in sorted(rows, key=lambda r: (r[2], r[1] or 0)):
        ring(ms)
        f = files.get(path)
        if size is None:
            files.pop(path, None)
        elif f is None or (not f["waits"] and f["size"] != size):
            files[path] = {"size": size, "equal": 1, "deadline": ms + wait, "waits": True}
        elif f["waits"]:
            f["equal"] = f["equal"] + 1 if f["size"] == size else 1
            f["size"] = size
            if f["equal"] >= polls:
                out.append((path, size, ms, "equal"))
                f["waits"] = False
    ring(last)
    return sorted(out)


@pytest.mark.parametrize("cuts", [1, 4])
def test_settled_files_across_restarts(spark, tmp_path, cuts):
    rnd = random.Random(3)
    rows = [(f"f{rnd.randrange(6)}", None if rnd.random() < 0.05 else rnd.randrange(2), 1000 * i + rnd.randrange(900)) for i in range(60)]
    rows += [("done", 7, 500), ("done", 7, 900), ("done", 7, 1500), ("grows", 1, 100), ("grows", 2, 800), ("never", 5, 59_999)]
    rows.sort(key=lambda r: r[2])
    size = -(-len(rows) // cuts)
    schema = "path string, size long, t long"
    for i in range(cuts):  # the query is started anew for each part
        spark.createDataFrame(rows[i * size : (i + 1) * size], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).withColumn("ts", F.timestamp_millis("t"))
        watch.until_done(watch.settled_files(stream, watermark="2 seconds"), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("path", "size", "seen_ms", "why").collect()))
    assert got == replay(rows, last=rows[-1][2] - 2000)
    assert ("done", 7, 1500, "equal") in got and ("grows", 2, 3100, "timer") in got and not any(g[0] == "never" for g in got)


def in_turn(paths, renames):
    out = []
    for p in paths:
        for old, new in renames:
            if p == old or p.startswith(old + "/"):
                p = new + p[len(old) :]
        out.append(p)
    return out


def test_composed_renames_equal_one_after_the_other(spark):
    rnd = random.Random(5)
    names = ["a", "b", "c"]
    any_path = lambda: "/".join(rnd.choices(names, k=rnd.randint(1, 4)))
    paths = sorted({any_path() for _ in range(60)})
    for _ in range(300):
        renames = [(o, n) for o, n in ((any_path(), any_path()) for _ in range(rnd.randint(1, 7))) if o != n]
        at = dict(watch.composed(renames))
        got = []
        for p in paths:
            before = max((a for a in at if p == a or p.startswith(a + "/")), key=len, default=None)
            got.append(p if before is None else at[before] + p[len(before) :])
        assert got == in_turn(paths, renames), renames


def test_renames_apply_in_event_order_across_batches(spark, tmp_path):
    paths = [f"{r}/x/{i}.dat" for r in ("lib", "ext") for i in range(3)] + ["lib/y/1.dat", "lib/xx/1.dat"]
    renames = [("lib/x", "lib/z"), ("lib/z", "ext/q"), ("ext/x/1.dat", "ext/one.dat"), ("ext/q", "ext/r"), ("lib/y", "lib/x"), ("lib/x/1.dat", "lib/w.dat"), ("none/a", "none/b"), ("ext/r/0.dat", "lib/zero.dat")]
    spark.createDataFrame([(p, i) for i, p in enumerate(paths)], "path string, n long").write.parquet(str(tmp_path / "t" / "v=0"))
    rows = [(o, n, 1000 + 10 * k, k) for k, (o, n) in enumerate(renames)] + [("end", "end2", 99_000, 99)]
    late = [rows[1], rows[0], rows[3], rows[2], *rows[4:]]  # out of order, within the watermark
    schema = "old string, new string, t long, seq long"
    with watch.state_store(spark):
        for i in range(3):
            spark.createDataFrame(late[3 * i : 3 * i + 3], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).withColumn("ts", F.timestamp_seconds("t"))
            jobs.each_batch(watch.ordered_renames(stream, "60 seconds"), watch.rename_table(str(tmp_path / "t")), str(tmp_path / "cp")).awaitTermination(120)
    last = max(int(p.name[2:]) for p in (tmp_path / "t").iterdir())
    got = [r["path"] for r in spark.read.parquet(str(tmp_path / "t" / f"v={last}")).orderBy("n").collect()]
    assert got == in_turn(paths, renames)
    assert spark.conf.get(watch.PROVIDER, None) != watch.ROCKS


def test_scan_progress_in_chunks(spark, tmp_path):
    events = [("s", f"p{i}", i % 7 != 0, 250) for i in range(250)] + [("t", f"q{i}", True, 30) for i in range(20)] + [("u", "r", False, 1)]
    random.Random(1).shuffle(events)
    stream = source(spark, tmp_path, [events[:100], events[100:130], events[130:]], "scan string, path string, ok boolean, total long")
    jobs.each_batch(stream, watch.scan_step(str(tmp_path / "p"), 100), str(tmp_path / "cp")).awaitTermination(120)
    rows = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "p" / "progress")).collect()
    assert sorted((r["scan"], r["done"], r["finished"]) for r in rows) == [("s", 100, False), ("s", 200, False), ("s", 250, True), ("u", 1, True)]
    counts = spark.read.parquet(str(tmp_path / "p" / "counts" / "v=2"))
    assert {r["scan"]: (r["done"], r["errors"]) for r in counts.collect()} == {"s": (250, 36), "t": (20, 0), "u": (1, 1)}
    assert not watch.drained(counts).first()[0] and watch.drained(counts.where("scan <> 't'")).first()[0] and watch.drained(counts.limit(0)).first()[0]


class Kept:
    """A state and its timers, with the calls that a store would be asked."""

    def __init__(self):
        self.value, self.timers, self.asked = None, set(), 0

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def registerTimer(self, at):
        self.timers.add(at)
        self.asked += 1

    def deleteTimer(self, at):
        self.timers.remove(at)
        self.asked += 1


def test_timers_are_told_once_a_batch():
    import pandas as pd

    file, kept = watch._Settle(3, 50), Kept()
    file.init(kept)
    batch = lambda *seen: [tuple(r) for f in file.handleInputRows(("a",), iter([pd.DataFrame(seen, columns=["ms", "size"])]), None) for r in f.values.tolist()]
    assert batch(*((100 * i, float(i)) for i in range(40))) == [("a", i, 100 * i + 50, "timer") for i in range(39)]
    assert kept.timers == {3950} and kept.asked == 1  # 79 before
    assert batch((3960, None)) == [("a", 39, 3950, "timer")] and not kept.timers and kept.asked == 2
    assert batch((4000, 7.0), (4010, 7.0)) == [] and kept.timers == {4050}
    assert batch((4020, 7.0)) == [("a", 7, 4020, "equal")] and not kept.timers
