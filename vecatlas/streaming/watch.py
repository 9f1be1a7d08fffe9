"""Watching a library's folders: files that have settled, renames in event order, progress of scans. State and timers belong to keys, so streams resume where they stopped."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from vecatlas.operators.graph import components
from vecatlas.operators.store import remap_many

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep their state in RocksDB, which timers need; the session's own setting comes back afterwards."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


class _Settle(StatefulProcessor):
    """For each path the size last seen, how often in a row, the deadline in ms, and whether the file still waits."""

    def __init__(self, polls: int, wait_ms: int):
        self.polls, self.wait = polls, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.file = handle.getValueState("file", "size long, equal int, deadline long, waits boolean")

    def handleInputRows(self, key, rows, timerValues):
        path, out = key[0], []
        seen = sorted(((ms, None if pd.isna(new) else int(new)) for some in rows for ms, new in zip(some["ms"], some["size"], strict=True)), key=lambda x: (x[0], x[1] is not None, x[1] or 0))
        known = self.file.exists()
        size, equal, deadline, waits = self.file.get() if known else (None, 0, 0, False)
        timer = deadline if waits else None
        for ms, new in seen:
            if waits and ms >= deadline:
                out.append((path, size, deadline, "timer"))
                waits = False
            if new is None:  # the file is gone
                known, waits = False, False
            elif not known or (not waits and new != size):
                known, waits, size, equal, deadline = True, True, new, 1, int(ms) + self.wait
            elif waits:
                size, equal = new, equal + 1 if new == size else 1
            if waits and equal >= self.polls:
                out.append((path, size, int(ms), "equal"))
                waits = False
        # each of these asks the store, and no timer fires within a batch, so only what is left of it is told
        if timer is not None and not (waits and deadline == timer):
            self.handle.deleteTimer(timer)
        if waits and deadline != timer:
            self.handle.registerTimer(deadline)
        if known:
            self.file.update((size, equal, deadline, waits))
        else:
            self.file.clear()
        if out:
            yield pd.DataFrame(out, columns=["path", "size", "seen_ms", "why"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        out = []
        if self.file.exists():
            size, equal, deadline, waits = self.file.get()
            if waits and deadline == expiredTimerInfo.getExpiryTimeInMs():
                out.append((key[0], size, deadline, "timer"))
                self.file.update((size, equal, deadline, False))
        yield pd.DataFrame(out, columns=["path", "size", "seen_ms", "why"])

    def close(self) -> None:
        pass


def settled_files(observations: DataFrame, *, polls: int = 3, wait: float = 3.0, watermark: str = "10 seconds") -> DataFrame:
    """(path, size, seen_ms, why) of files that are ready to be read, from a stream of observations (path, size, ts); a null size says that the file is gone.

    A file waits from its first observation on. It is released at the observation that shows one size for the polls-th time in a row ("equal"), or when event time reaches ``wait`` seconds
    after the first one ("timer"), whichever comes first; so cutting the stream into other batches changes nothing. A released file waits anew when its size changes.
    Observations behind the watermark are dropped; what a file observes in one batch is put in order of time. Start the query within :func:`state_store`.
    """
    rows = observations.select("path", F.col("size").cast("long").alias("size"), "ts").withWatermark("ts", watermark).withColumn("ms", F.unix_millis("ts"))
    return rows.groupBy("path").transformWithStateInPandas(_Settle(polls, int(wait * 1000)), "path string, size long, seen_ms long, why string", "Append", "EventTime")


class _InOrder(StatefulProcessor):
    """For each root its renames that the watermark has not passed yet, and how many went before."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "ms long, seq long, old string, new string")
        self.gone = handle.getValueState("gone", "turn long")

    def handleInputRows(self, key, rows, timerValues):
        for part in rows:
            self.held.appendList([(int(m), int(q), o, n) for m, q, o, n in zip(part["ms"], part["seq"], part["old"], part["new"], strict=True)])
            for ms in set(part["ms"]):
                self.handle.registerTimer(int(ms))
        yield pd.DataFrame([], columns=["root", "turn", "ms", "seq", "old", "new"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = expiredTimerInfo.getExpiryTimeInMs()
        held = sorted(self.held.get()) if self.held.exists() else []
        due, later = [r for r in held if r[0] <= now], [r for r in held if r[0] > now]
        turn = self.gone.get()[0] if self.gone.exists() else 0
        self.held.put(later) if later else self.held.clear()
        self.gone.update((turn + len(due),))
        yield pd.DataFrame([(key[0], turn + i, *r) for i, r in enumerate(due)], columns=["root", "turn", "ms", "seq", "old", "new"])

    def close(self) -> None:
        pass


def ordered_renames(renames: DataFrame, watermark: str = "10 seconds") -> DataFrame:
    """(root, turn, ms, seq, old, new): the renames (old, new, ts, seq) of each root folder in order of (ts, seq), each as soon as the watermark has passed it, numbered from 0 across batches. Start the query within :func:`state_store`."""
    rows = renames.withWatermark("ts", watermark).select(F.split_part("old", F.lit("/"), F.lit(1)).alias("root"), F.unix_millis("ts").alias("ms"), "seq", "old", "new", "ts")
    return rows.groupBy("root").transformWithStateInPandas(_InOrder(), "root string, turn long, ms long, seq long, old string, new string", "Append", "EventTime")


def _under(path: str, prefix: str) -> bool:
    return path == prefix or path.startswith(prefix + "/")


def composed(renames: Iterable[tuple[str, str]]) -> list[tuple[str, str]]:
    """(before, after) prefixes that say at once what the renames do one after the other; of several that fit a path the longest ``before`` holds."""
    now: dict[str, str] = {}

    def longest(path: str) -> str | None:
        parts = path.split("/")
        return next((p for i in range(len(parts), 0, -1) if (p := "/".join(parts[:i])) in now), None)

    for old, new in renames:
        came = {a + old[len(b) :]: new for a, b in now.items() if b != old and _under(old, b) and longest(a + old[len(b) :]) == a}  # what an earlier move of a folder above has brought there
        if longest(old) is None:
            came[old] = new
        now |= {a: new + b[len(old) :] for a, b in now.items() if _under(b, old)} | came
    return list(now.items())


def rename_batch(rows: DataFrame, renames: DataFrame, column: str = "path") -> DataFrame:
    """rows with ``column`` after renames (ms, seq, old, new) that apply one after the other; folders and single files alike.

    Renames are folded by groups of root folders that moves connect; rows then meet the folded ones by their own prefixes.
    """
    root = lambda c: F.xxhash64(F.split_part(c, F.lit("/"), F.lit(1)))
    events = renames.select("ms", "seq", "old", "new", root(F.col("old")).alias("a"), root(F.col("new")).alias("b"))
    groups = components(events.select("a", "b").where("a <> b"))
    events = events.join(groups.withColumnRenamed("v", "a"), "a", "left").withColumn("label", F.coalesce("label", "a"))

    def fold(table: pd.DataFrame) -> pd.DataFrame:
        inorder = table.sort_values(["ms", "seq", "old"])
        return pd.DataFrame(composed(zip(inorder["old"], inorder["new"], strict=True)), columns=["old", "new"])

    moves = events.groupBy("label").applyInPandas(fold, "old string, new string")
    return remap_many(rows, moves, column)


def rename_table(path: str, column: str = "path") -> Callable[[DataFrame, int], None]:
    """A step for batches of :func:`ordered_renames` on a table of snapshots; ``path/v=0`` is the table before the stream. A repeated batch overwrites its own snapshot, and snapshots that no repeated batch can need are emptied."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        table = spark.read.parquet(f"{path}/v={number}")
        rename_batch(table, batch, column).write.mode("overwrite").parquet(f"{path}/v={number + 1}")
        if number > 0:
            table.limit(0).write.mode("overwrite").parquet(f"{path}/v={number - 1}")

    return step


def scan_step(path: str, chunk: int = 100) -> Callable[[DataFrame, int], None]:
    """A step that counts a batch of scan events (scan, path, ok, total) and adds the progress that it made below ``path/progress/batch=N``.

    Progress is a row (scan, done, errors, total, finished) at every chunk of files that is complete and at the last file. Counts are partial sums, so that a
    scan of any size is no single task's work; errors are those known when the batch ends. The running counts are a table of snapshots ``path/counts/v=N``.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark, schema = batch.sparkSession, "scan string, done long, errors long, total long"
        before = spark.read.schema(schema).parquet(f"{path}/counts/v={number - 1}") if number else spark.createDataFrame([], schema)
        new = batch.groupBy("scan").agg(F.count("*").alias("done"), F.count_if(~F.col("ok")).alias("errors"), F.max("total").cast("long").alias("total"))
        both = before.withColumn("was", F.col("done")).unionByName(new.withColumn("was", F.lit(0).cast("long")))
        now = both.groupBy("scan").agg(F.sum("done").alias("done"), F.sum("errors").alias("errors"), F.max("total").alias("total"), F.sum("was").alias("was"))
        now.select("scan", "done", "errors", "total").write.mode("overwrite").parquet(f"{path}/counts/v={number}")
        full = F.expr(f"if(done div {chunk} > was div {chunk}, sequence(was div {chunk} + 1, done div {chunk}), array())")
        marks = F.array_distinct(F.concat(F.transform(full, lambda k: k * chunk), F.when((F.col("done") >= F.col("total")) & (F.col("was") < F.col("total")), F.array("total")).otherwise(F.array().cast("array<bigint>"))))
        rows = now.select("scan", F.explode(marks).alias("done"), "errors", "total").withColumn("finished", F.col("done") >= F.col("total"))  # of the mark, not of the batch
        rows.write.mode("overwrite").parquet(f"{path}/progress/batch={number}")

    return step


def drained(counts: DataFrame) -> DataFrame:
    """One row: whether every scan of the counts has seen all its files; true without any scan."""
    return counts.agg(F.coalesce(F.bool_and(F.col("done") >= F.col("total")), F.lit(True)).alias("drained"))


def until_done(stream: DataFrame, out: str, checkpoint: str, seconds: int = 600) -> StreamingQuery:
    """Append a stream to Parquet until the input at hand is used up."""
    with state_store(stream.sparkSession):
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination(seconds)
    return query
