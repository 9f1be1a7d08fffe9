"""Job attempts folded into the current state of each job."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_ATTEMPTS, ERROR_CHARS = 3, 2000


def fold(log: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """(kind, dedupe_key, state, attempts, error, updated): attempts since the last success; failed at the cap or when the last error can't be retried."""
    w = Window.partitionBy("kind", "dedupe_key")
    last_ok = log.withColumn("__ok", F.max(F.when(F.col("ok"), F.struct("ts", "event_id"))).over(w))
    since = F.coalesce(F.struct("ts", "event_id") > F.col("__ok"), F.lit(True))
    per = last_ok.groupBy("kind", "dedupe_key").agg(F.max(F.struct("ts", "event_id", "ok", "retryable", "error")).alias("last"), F.count_if(since).alias("attempts"))
    state = F.when(F.col("last.ok"), "done").when(~F.col("last.retryable") | (F.col("attempts") >= max_attempts), "failed").otherwise("pending")
    return per.select("kind", "dedupe_key", state.alias("state"), F.col("attempts").cast("long").alias("attempts"), F.substring("last.error", 1, ERROR_CHARS).alias("error"), F.col("last.ts").alias("updated"))


def statistics(ledger: DataFrame) -> DataFrame:
    """Counts by kind and for all kinds (kind null), with those finished and outstanding."""
    n = lambda s: F.count_if(F.col("state") == s)
    out = ledger.rollup("kind").agg(F.count("*").alias("total"), n("done").alias("done"), n("failed").alias("failed"), n("pending").alias("pending"))
    return out.select("kind", "total", "done", "failed", "pending", (F.col("done") + F.col("failed")).alias("finished"), F.col("pending").alias("outstanding"))


def failures(ledger: DataFrame, limit: int = 20) -> DataFrame:
    return ledger.where("state = 'failed'").orderBy(F.desc("updated"), "kind", "dedupe_key").limit(limit)


def problems(log: DataFrame) -> DataFrame:
    """(dedupe_key, errors): distinct kind and error of each key, newest first."""
    bad = log.where(~F.col("ok")).groupBy("dedupe_key", "kind", "error").agg(F.max("ts").alias("ts"))
    return bad.groupBy("dedupe_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.unix_micros(F.col("ts").cast("timestamp"))).alias("t"), "kind", "error"))), lambda x: F.concat_ws(":", x["kind"], x["error"])), "|").alias("errors"))


def progress(stats: DataFrame, stages: list[str]) -> DataFrame:
    """One row: the first stage in order with outstanding work (null when none), and the share finished."""
    order = F.array_position(F.array(*map(F.lit, stages)), F.col("kind"))
    own = stats.where(F.col("kind").isin(stages))
    return own.agg(F.min_by("kind", F.when(F.col("outstanding") > 0, order)).alias("s"), F.sum("outstanding").alias("left"), F.sum("finished").alias("finished"), F.sum("total").alias("total")).select(F.when(F.col("left") > 0, F.col("s")).alias("stage"), "finished", "total")


def purge(ledger: DataFrame, before: str) -> DataFrame:
    """Without done jobs older than a time."""
    return ledger.where(~((F.col("state") == "done") & (F.col("updated") < F.lit(before).cast("timestamp_ntz"))))
