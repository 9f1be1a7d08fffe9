"""The job ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecatlas.operators import ledger as led
from vecatlas.plans.book import Book

book = Book()
_L = """o AS (SELECT *, max(CASE WHEN ok THEN {'ts': ts, 'e': event_id} END) OVER (PARTITION BY kind, dedupe_key) AS lok FROM job_log),
p AS (SELECT kind, dedupe_key, arg_max({'ok': ok, 'retryable': retryable, 'error': error, 'ts': ts}, {'ts': ts, 'e': event_id}) AS last, count(*) FILTER (WHERE lok IS NULL OR {'ts': ts, 'e': event_id} > lok) AS attempts FROM o GROUP BY kind, dedupe_key),
l AS (SELECT kind, dedupe_key, CASE WHEN last.ok THEN 'done' WHEN NOT last.retryable OR attempts >= 3 THEN 'failed' ELSE 'pending' END AS state, attempts, last.error AS error, last.ts AS updated FROM p)"""
_STATS = "count(*) AS total, count(*) FILTER (WHERE state = 'done') AS done, count(*) FILTER (WHERE state = 'failed') AS failed, count(*) FILTER (WHERE state = 'pending') AS pending, count(*) FILTER (WHERE state <> 'pending') AS finished, count(*) FILTER (WHERE state = 'pending') AS outstanding"


@book.query(f"WITH {_L} SELECT * FROM l")
def r4_attempt_ledger(t):
    return led.fold(t.job_log)


@book.query(f"WITH {_L} SELECT kind, {_STATS} FROM l GROUP BY ROLLUP (kind)")
def a11_job_statistics(t):
    return led.statistics(led.fold(t.job_log))


@book.query("WITH d AS (SELECT dedupe_key, kind, error, max(ts) AS ts FROM job_log WHERE NOT ok GROUP BY ALL) SELECT dedupe_key, string_agg(kind || ':' || error, '|' ORDER BY ts DESC, kind, error) AS errors FROM d GROUP BY dedupe_key")
def a12_problems(t):
    return led.problems(t.job_log)


@book.query(f"WITH {_L}, s AS (SELECT kind, {_STATS} FROM l GROUP BY kind) SELECT min_by(kind, CASE WHEN outstanding > 0 THEN CASE kind WHEN 'features' THEN 1 WHEN 'main' THEN 2 ELSE 3 END END) AS stage, sum(finished)::BIGINT AS finished, sum(total)::BIGINT AS total FROM s")
def a31_progress(t):
    return led.progress(led.statistics(led.fold(t.job_log)).where("kind IS NOT NULL"), ["features", "main", "text"])


@book.query(f"WITH {_L} SELECT * FROM l WHERE NOT (state = 'done' AND updated < TIMESTAMP '2024-01-15')")
def r6_retention(t):
    return led.purge(led.fold(t.job_log), "2024-01-15")


@book.query(f"WITH {_L} SELECT kind, dedupe_key, updated FROM l WHERE state = 'failed' ORDER BY updated DESC, kind, dedupe_key LIMIT 20")
def t7_failed_jobs(t):
    return led.failures(led.fold(t.job_log)).select("kind", "dedupe_key", "updated")


@book.query("SELECT kind, count(*) AS events, count(DISTINCT dedupe_key) AS keys FROM job_log GROUP BY kind")
def r3_distinct_work(t):
    return t.job_log.groupBy("kind").agg(F.count("*").alias("events"), F.countDistinct("dedupe_key").alias("keys"))
