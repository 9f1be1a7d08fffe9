"""Streams over the events table, run until their input is used up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecatlas.plans.book import Book, Tables
from vecatlas.sources.scratch import folder
from vecatlas.streaming import jobs, watch

book = Book()
WAIT, DELAY, CHUNK, FILES = 21_600, 10, 100, 1_500


def arriving(t: Tables) -> DataFrame:
    return t.spark.readStream.schema(t.events.schema).parquet(f"{t._dir}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))  # as a pattern, the table may be a file or a folder


_SETTLED = f"""WITH RECURSIVE o AS (SELECT concat('f', CAST(user_id AS VARCHAR)) AS path, CASE WHEN event_type <> 'error' THEN CAST(floor(value / 20) AS BIGINT) END AS size, epoch_us(ts) // 1000 AS ms FROM events),
n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ms, size NULLS FIRST) AS rn FROM o),
s AS (SELECT path, 0::BIGINT AS rn, NULL::BIGINT AS size, 0 AS equal, 0::BIGINT AS deadline, false AS waits, false AS known, NULL::BIGINT AS out_size, NULL::BIGINT AS out_ms, NULL::VARCHAR AS why FROM (SELECT DISTINCT path FROM n)
  UNION ALL
  SELECT path, rn, CASE WHEN begins OR (w AND new IS NOT NULL) THEN new ELSE size END, CASE WHEN begins THEN 1 WHEN w THEN again ELSE equal END, CASE WHEN begins THEN ms + {WAIT * 1000} ELSE deadline END,
    coalesce(new IS NOT NULL AND (begins OR (w AND again < 3)), false), new IS NOT NULL, CASE WHEN fired THEN size WHEN w AND new IS NOT NULL AND again >= 3 THEN new END, CASE WHEN fired THEN deadline WHEN w AND new IS NOT NULL AND again >= 3 THEN ms END, CASE WHEN fired THEN 'timer' WHEN w AND new IS NOT NULL AND again >= 3 THEN 'equal' END
  FROM (SELECT *, coalesce(new IS NOT NULL AND (NOT known OR (NOT w AND new <> size)), false) AS begins, CASE WHEN new = size THEN equal + 1 ELSE 1 END AS again
    FROM (SELECT s.path, n.rn, s.size, s.equal, s.deadline, s.known, n.size AS new, n.ms, s.waits AND n.ms >= s.deadline AS fired, s.waits AND n.ms < s.deadline AS w FROM s JOIN n ON n.path = s.path AND n.rn = s.rn + 1))),
e AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY rn DESC) AS back FROM s)
SELECT path, out_size AS size, out_ms AS seen_ms, why FROM s WHERE out_ms IS NOT NULL
UNION ALL SELECT path, size, deadline, 'timer' FROM e WHERE back = 1 AND waits AND deadline <= (SELECT max(epoch_us(ts) // 1000) - {DELAY * 1000} FROM events)"""


@book.query(_SETTLED)
def r1_settled_files(t):
    """Users stand for files, their events for observations; an error means that the file is gone."""
    seen = arriving(t).select(F.concat(F.lit("f"), "user_id").alias("path"), F.when(F.col("event_type") != "error", F.floor(F.col("value") / 20)).alias("size"), "ts")
    out = folder(t.spark, "settled")
    watch.until_done(watch.settled_files(seen, wait=WAIT, watermark=f"{DELAY} seconds"), out, folder(t.spark, "settled-state"))
    return t.spark.read.parquet(out)


@book.query(f"""WITH c AS (SELECT event_type AS scan, count(*) AS n, count(*) FILTER (WHERE value < 5) AS errors FROM events GROUP BY 1),
m AS (SELECT scan, unnest(range({CHUNK}, n + 1, {CHUNK})) AS done, errors FROM c UNION SELECT scan, {FILES}, errors FROM c WHERE n >= {FILES})
SELECT scan, done, errors, CAST({FILES} AS BIGINT) AS total, done >= {FILES} AS finished FROM m""")
def r5_scan_progress(t):
    """Event types stand for scans."""
    files = arriving(t).select(F.col("event_type").alias("scan"), F.col("event_id").cast("string").alias("path"), (F.col("value") >= 5).alias("ok"), F.lit(FILES).alias("total"))
    out = folder(t.spark, "progress")
    jobs.each_batch(files, watch.scan_step(out, CHUNK), folder(t.spark, "progress-state")).awaitTermination(600)
    return t.spark.read.option("recursiveFileLookup", "true").parquet(f"{out}/progress")
