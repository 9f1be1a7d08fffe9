"""Metric series."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecatlas.operators import series as s
from vecatlas.plans.book import Book

book = Book()
_W = "OVER (PARTITION BY id ORDER BY frame {0})"
_SMOOTH = f"SELECT id, frame, level, avg(level) {_W.format('ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING')} AS smooth FROM series"
_BEST = f"""SELECT id, min(frame) AS start, round(max(top), 6) AS mean FROM (SELECT *, max(m) FILTER (WHERE n = least({{w}}, len)) OVER (PARTITION BY id) AS top FROM (
SELECT id, frame, avg({{c}}) {_W.format('ROWS BETWEEN CURRENT ROW AND {v} FOLLOWING')} AS m, count(*) {_W.format('ROWS BETWEEN CURRENT ROW AND {v} FOLLOWING')} AS n, count(*) OVER (PARTITION BY id) AS len FROM {{f}})) WHERE n = least({{w}}, len) AND m >= top - 1e-9 GROUP BY id"""
_DIP = """SELECT id, start, e AS "end", n FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, round(m, 9), start) AS rn FROM (
SELECT id, min(frame) AS start, max(frame) AS e, count(*) AS n, avg({c}) AS m, any_value(lo) AS lo, any_value(hi) AS hi FROM (
SELECT *, frame - row_number() OVER (PARTITION BY id, b ORDER BY frame) AS isl, min(frame) OVER (PARTITION BY id) AS lo, max(frame) OVER (PARTITION BY id) AS hi FROM (SELECT *, {b} AS b FROM {f})) WHERE b GROUP BY id, isl)
WHERE start > lo AND e < hi AND n >= {least}) WHERE rn = 1"""


@book.query(f"SELECT id, frame, round(smooth, 6) AS smooth FROM ({_SMOOTH})")
def w2_moving_average(t):
    return s.moving_average(t.series, 3).select("id", "frame", F.round("smooth", 6).alias("smooth"))


@book.query(f"SELECT id, min(frame) AS frame FROM (SELECT id, frame, avg((level > 0)::INT) {_W.format('ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING')} AS m FROM series) WHERE m >= 0.999 GROUP BY id")
def w3_first_sustained(t):
    return s.first_sustained(t.series, F.col("level") > 0, 3)


@book.query(_BEST.format(w=30, v=29, c="level", f="series"))
def w4_best_window(t):
    return s.best_window(t.series, 30)


@book.query(_DIP.format(c="level", b="level <= 60", f="series", least=2))
def w5_longest_dip(t):
    return s.longest_dip(t.series, F.col("level") <= 60, 2)


@book.query(f"""WITH sm AS ({_SMOOTH}), pk AS (SELECT id, quantile_cont(smooth, 0.95) AS peak FROM sm GROUP BY id), s AS (SELECT sm.*, peak FROM sm JOIN pk USING (id) WHERE peak > 1e-9),
b AS (SELECT id, min(frame) AS intro_start FROM s WHERE smooth >= 0.05 * peak GROUP BY id),
e AS (SELECT id, min(frame) AS intro_end FROM (SELECT id, frame, avg((smooth >= 0.8 * peak)::INT) {_W.format('ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING')} AS m FROM s) WHERE m >= 0.999 GROUP BY id),
d AS ({_BEST.format(w=30, v=29, c='smooth', f='s')}), k AS ({_DIP.format(c='smooth', b='smooth <= 0.6 * peak', f='s', least=8)})
SELECT id, round(peak, 6) AS peak, intro_start, intro_end, d.start AS drop_start, k.start AS break_start, k."end" AS break_end FROM pk LEFT JOIN b USING (id) LEFT JOIN e USING (id) LEFT JOIN d USING (id) LEFT JOIN k USING (id)""")
def w6_sections(t):
    return s.sections(t.series)


@book.query("""WITH RECURSIVE b AS (SELECT DISTINCT CAST(round(60 + tempo_norm * 190) AS INT) AS bpm FROM item_features6), c(centre) AS (SELECT min(bpm) FROM b UNION ALL SELECT (SELECT min(bpm) FROM b WHERE bpm > c.centre * 1.08) FROM c WHERE c.centre IS NOT NULL)
SELECT bpm, max(centre) AS centre FROM b, c WHERE centre <= bpm GROUP BY bpm""")
def w12_tempo_groups(t):
    return s.tempo_groups(t.item_features6.select((60 + F.col("tempo_norm") * 190).alias("bpm")), 0.08)


@book.query("SELECT fingerprint, CAST(round_even(60 + tempo_norm * 190, 0) AS INT) AS bpm, CAST(((round_even(atan2(key_sin, key_cos) / (2 * pi()) * 12, 0) % 12) + 12) % 12 AS INT) AS key FROM item_features6")
def x5_bpm_key(t):
    key = F.pmod(F.rint(F.atan2("key_sin", "key_cos") / (2 * F.pi()) * 12), F.lit(12))
    return t.item_features6.select("fingerprint", F.rint(60 + F.col("tempo_norm") * 190).cast("int").alias("bpm"), key.cast("int").alias("key"))


@book.query("""SELECT fingerprint, round((CASE WHEN mode = 1 THEN 0.82 ELSE 0.45 END) * cos(atan2(key_sin, key_cos)), 6) AS kx, round((CASE WHEN mode = 1 THEN 0.82 ELSE 0.45 END) * sin(atan2(key_sin, key_cos)), 6) AS ky,
round((0.18 + 0.68 * least(greatest(tempo_norm, 0), 1)) * cos(2 * pi() * log2((60 + tempo_norm * 190) / 60)), 6) AS tx FROM item_features6""")
def x6_wheel_and_spiral(t):
    r, a = F.when(F.col("mode") == 1, 0.82).otherwise(0.45), F.atan2("key_sin", "key_cos")
    tr = 0.18 + 0.68 * F.least(F.greatest(F.col("tempo_norm"), F.lit(0.0)), F.lit(1.0))
    return t.item_features6.select("fingerprint", F.round(r * F.cos(a), 6).alias("kx"), F.round(r * F.sin(a), 6).alias("ky"), F.round(tr * F.cos(2 * F.pi() * F.log2((60 + F.col("tempo_norm") * 190) / 60)), 6).alias("tx"))


@book.query("WITH b AS (SELECT fingerprint, 60 + tempo_norm * 190 AS b, 60 + energy * 190 AS r FROM item_features6) SELECT fingerprint, round(CASE WHEN abs(b - 2 * r) <= 0.03 * 2 * r OR abs(b - r / 2) <= 0.03 * r / 2 THEN r ELSE b END, 6) AS bpm FROM b")
def x7_octave_repair(t):
    b, r = 60 + F.col("tempo_norm") * 190, 60 + F.col("energy") * 190
    near = lambda m: F.abs(b - m) <= 0.03 * m
    return t.item_features6.select("fingerprint", F.round(F.when(near(2 * r) | near(r / 2), r).otherwise(b), 6).alias("bpm"))
