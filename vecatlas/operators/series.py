"""Ordered scans over metric series (id, frame, level)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def line(lo: int | None = None, hi: int | None = None):
    w = Window.partitionBy("id").orderBy("frame")
    return w if lo is None else w.rowsBetween(lo, hi)


def moving_average(series: DataFrame, window: int, column: str = "level", out: str = "smooth") -> DataFrame:
    """Centred mean; at the ends over the rows there are. Even windows take one row less behind."""
    return series.withColumn(out, F.avg(column).over(line(-(window // 2), window - 1 - window // 2)))


def first_sustained(series: DataFrame, above: Column, hold: int) -> DataFrame:
    """(id, frame): first frame where the condition holds over the centred window."""
    held = moving_average(series.withColumn("__a", above.cast("double")), hold, "__a", "__m") if hold > 1 else series.withColumn("__m", above.cast("double"))
    return held.where("__m >= 0.999").groupBy("id").agg(F.min("frame").alias("frame"))


def best_window(series: DataFrame, w: int, column: str = "level") -> DataFrame:
    """(id, start, mean): first full window whose mean is the greatest to within 1e-9; the whole of a shorter series."""
    s = series.withColumn("m", F.avg(column).over(line(0, w - 1))).withColumn("n", F.count("*").over(line(0, w - 1))).withColumn("len", F.count("*").over(Window.partitionBy("id")))
    full = s.where(F.col("n") == F.least(F.lit(w), F.col("len"))).withColumn("top", F.max("m").over(Window.partitionBy("id")))
    return full.where(F.col("m") >= F.col("top") - 1e-9).groupBy("id").agg(F.min("frame").alias("start"), F.round(F.max("top"), 6).alias("mean"))


def longest_dip(series: DataFrame, below: Column, least: int, column: str = "level") -> DataFrame:
    """(id, start, end, n): longest run below that touches neither end; ties by the lower mean, then the earlier one."""
    s = series.withColumn("__b", below)
    s = s.withColumn("__i", F.col("frame") - F.row_number().over(Window.partitionBy("id", "__b").orderBy("frame"))).withColumn("__lo", F.min("frame").over(Window.partitionBy("id"))).withColumn("__hi", F.max("frame").over(Window.partitionBy("id")))
    runs = s.where("__b").groupBy("id", "__i").agg(F.min("frame").alias("start"), F.max("frame").alias("end"), F.count("*").alias("n"), F.avg(column).alias("m"), F.first("__lo").alias("lo"), F.first("__hi").alias("hi"))
    inner = runs.where((F.col("start") > F.col("lo")) & (F.col("end") < F.col("hi")) & (F.col("n") >= least))
    best = inner.groupBy("id").agg(F.max(F.struct("n", (-F.round("m", 9)).alias("depth"), (-F.col("start")).alias("back"), "end")).alias("b"))
    return best.select("id", (-F.col("b.back")).alias("start"), F.col("b.end").alias("end"), F.col("b.n").alias("n"))


def sections(series: DataFrame, smooth: int = 3, peak_window: int = 30, start_share: float = 0.05, full_share: float = 0.8, hold: int = 3, break_share: float = 0.6, break_frames: int = 8) -> DataFrame:
    """(id, peak, intro_start, intro_end, drop_start, break_start, break_end): smoothing, 95th percentile as peak, sustained crossings, the loudest window and the longest dip. A silent series has nulls."""
    s = moving_average(series, smooth)
    peak = s.groupBy("id").agg(F.percentile("smooth", 0.95).alias("peak"))
    s = s.join(peak.where("peak > 1e-9"), "id")
    begin = first_sustained(s, F.col("smooth") >= start_share * F.col("peak"), 1).withColumnRenamed("frame", "intro_start")
    full = first_sustained(s, F.col("smooth") >= full_share * F.col("peak"), hold).withColumnRenamed("frame", "intro_end")
    drop = best_window(s, peak_window, "smooth").select("id", F.col("start").alias("drop_start"))
    dip = longest_dip(s, F.col("smooth") <= break_share * F.col("peak"), break_frames, "smooth").select("id", F.col("start").alias("break_start"), F.col("end").alias("break_end"))
    out = peak.withColumn("peak", F.round("peak", 6))
    for part in (begin, full, drop, dip):
        out = out.join(part, "id", "left")
    return out


def tempo_groups(bpms: DataFrame, share: float) -> DataFrame:
    """(bpm, centre): the lowest remaining whole tempo is a centre and takes what lies within share of it. There are a few hundred whole tempos, so the fold is over one array."""
    distinct = bpms.select(F.round("bpm").cast("int").alias("bpm")).where("bpm IS NOT NULL").distinct()
    fold = F.expr(f"aggregate(b, CAST(array() AS ARRAY<STRUCT<bpm: INT, centre: INT>>), (s, x) -> concat(s, array(struct(x AS bpm, IF(size(s) > 0 AND x <= element_at(s, -1).centre * {1 + share}, element_at(s, -1).centre, x) AS centre))))")
    return distinct.agg(F.sort_array(F.collect_set("bpm")).alias("b")).select(F.explode(fold).alias("g")).select("g.*")
