"""Predicates over items, tags, folders and positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecatlas.functions.paths import ancestors, climb, in_subtree


def within(value: Column, lo: float, hi: float) -> Column:
    """A missing value passes."""
    return value.isNull() | value.between(lo, hi)


def axis_value(feature: str, tag: str) -> Column:
    return F.coalesce(F.col(feature), F.col(tag), F.lit(0.5))


def matches(*, folder: str | None = None, cluster: int | None = None, key: str | None = None, bpm: float | None = None, paths: list[str] | None = None) -> Column:
    """One target; bpm within 2 either way."""
    if folder is not None:
        return in_subtree("folder", folder)
    if cluster is not None:
        return F.col("cluster") == cluster
    if key is not None:
        return (F.col("musical_key") == key) & (F.length("musical_key") > 0)
    if bpm is not None:
        return F.abs(F.col("bpm") - bpm) <= 2
    return F.col("path").isin(paths or [])


def exclude(items: DataFrame, hidden_paths: DataFrame, hidden_folders: DataFrame) -> DataFrame:
    """Items neither hidden themselves nor below a hidden folder; an empty folder hides all. An item meets its own ancestors only."""
    up = items.select("path", F.explode(F.concat(F.array(F.lit("")), ancestors("folder"))).alias("folder"))
    below = up.join(hidden_folders.select("folder"), "folder", "left_semi").select("path").distinct()
    return items.join(hidden_paths.select("path"), "path", "left_anti").join(below, "path", "left_anti")


def in_region(shape: str, cx: float, cy: float, r: float, hw: float | None = None, hh: float | None = None) -> Column:
    box = F.col("x").between(cx - (hw or r), cx + (hw or r)) & F.col("y").between(cy - (hh or r), cy + (hh or r))
    return box if shape == "box" else box & (F.hypot(F.col("x") - cx, F.col("y") - cy) <= r)


def in_polygon(points: list[tuple[float, float]]) -> Column:
    """Even-odd rule: the number of edges to the right of a point is odd."""
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    ring = list(zip(points, points[1:] + points[:1], strict=True))
    crossings = sum((F.when(((F.lit(a[1]) > F.col("y")) != (F.lit(b[1]) > F.col("y"))) & (F.col("x") < (b[0] - a[0]) * (F.col("y") - a[1]) / F.lit(b[1] - a[1]) + a[0]), 1).otherwise(0) for a, b in ring if a[1] != b[1]), F.lit(0))
    return F.col("x").between(min(xs), max(xs)) & F.col("y").between(min(ys), max(ys)) & (crossings % 2 == 1)


def eligible(items: DataFrame, present: DataFrame, required: list[str]) -> DataFrame:
    met = F.lit(True)
    for s in required:
        met = met & F.col(s)
    return items.join(present.where(met).select("fingerprint"), "fingerprint", "left_semi")


def class_labels(items: DataFrame, least: int = 8) -> DataFrame:
    """items with class = place of the leaf folder among those of at least so many rows, by name; -1 for the rest."""
    from pyspark.sql import Window

    sizes = items.groupBy("folder").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    # one row per class: the ranking is over folders, not rows
    classes = sizes.withColumn("class", F.row_number().over(Window.orderBy("folder")) - 1).select("folder", "class")
    return items.join(F.broadcast(classes), "folder", "left").na.fill(-1, ["class"])


def hidden_subtrees(items: DataFrame, hidden: Column) -> DataFrame:
    """(prefix, n, all_hidden) of every folder with rows below it."""
    return items.select(F.explode(ancestors("folder")).alias("prefix"), hidden.alias("h")).groupBy("prefix").agg(F.count("*").alias("n"), F.bool_and("h").alias("all_hidden"))


def blooms_folder(items: DataFrame, ref_id: int, levels: int) -> DataFrame:
    """Rows that share the reference's folder after both climb so many levels."""
    ref = items.where(F.col("id") == ref_id).select(climb("folder", levels).alias("top"))
    return items.withColumn("top", climb("folder", levels)).join(F.broadcast(ref), "top", "left_semi").drop("top")


def selection_breakdown(items: DataFrame, selected: DataFrame) -> DataFrame:
    """Counts of the selected rows by folder and by label in one pass."""
    chosen = items.join(selected.select("path"), "path", "left_semi")
    sets = chosen.groupingSets([["folder"], ["label"]], "folder", "label").agg(F.grouping("folder").alias("g"), F.count("*").alias("n"))
    return sets.select(F.when(F.col("g") == 0, "folder").otherwise("label").alias("kind"), F.when(F.col("g") == 0, F.col("folder")).otherwise(F.col("label").cast("string")).alias("key"), "n")
