"""Sorting rows into folders: the plan, its counts, an append-only journal with undo, and the memory of where rows came from."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecatlas.functions.paths import ancestors, below_root, root
from vecatlas.operators.store import latest_batch, upsert
from vecatlas.sources.scratch import stash

JOURNAL = "batch_id string, created long, fingerprint string, source string, target string, undone boolean"
_NUMBERED = r"^(.*) \(([1-9][0-9]{0,8})\)(\.[^./]*)?$"


def _folder(path: str):
    return F.regexp_replace(path, "/?[^/]*$", "")


def free_names(claims: DataFrame, taken: DataFrame) -> DataFrame:
    """(id, name) for claims (id, raw, turn): the claims of one raw path get, in order of turn, the first names that no taken path has: the path itself, then "stem (1).ext", "stem (2).ext" and so on.

    taken (path) are filed under the path itself (number 0) and, if they are numbered, under the path without its number. A numbered path that is claimed as it stands is
    no free name for others either, so all names differ. The i-th free number is i plus the taken ones before it, which one ordered pass over
    taken and claims tells; no name is tried.
    """
    number = F.regexp_extract("path", _NUMBERED, 2)
    plain = taken.select(F.col("path").alias("raw"), F.lit(0).cast("long").alias("k"))
    suffixed = taken.select("path").unionByName(claims.select(F.col("raw").alias("path"))).where(number != "").select(F.concat(F.regexp_extract("path", _NUMBERED, 1), F.regexp_extract("path", _NUMBERED, 3)).alias("raw"), number.cast("long").alias("k"))
    used = plain.unionByName(suffixed).join(claims.select("raw").distinct(), "raw", "left_semi").distinct()
    gaps = used.withColumn("at", F.col("k") - F.row_number().over(Window.partitionBy("raw").orderBy("k")) + 1)
    turns = claims.withColumn("at", F.row_number().over(Window.partitionBy("raw").orderBy("turn", "id")) - 1)
    both = gaps.select("raw", "at", F.lit(0).alias("claim"), F.lit(None).cast(claims.schema["id"].dataType).alias("id")).unionByName(turns.select("raw", F.col("at").cast("long").alias("at"), F.lit(1).alias("claim"), "id"))
    before = F.sum(1 - F.col("claim")).over(Window.partitionBy("raw").orderBy("at", "claim").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    n = both.withColumn("n", F.col("at") + before).where("claim = 1")
    stem, ext = F.regexp_replace("raw", r"\.[^./]*$", ""), F.regexp_extract("raw", r"\.[^./]*$", 0)
    return n.select("id", F.when(F.col("n") == 0, F.col("raw")).otherwise(F.concat(stem, F.lit(" ("), F.col("n"), F.lit(")"), ext)).alias("name"))


def sort_plan(predictions: DataFrame, styles: DataFrame, *, fallback: bool = True, taken: DataFrame | None = None) -> DataFrame:
    """(id, source, target, reason): where each row of (id, path, is_match, class) goes: below its class's folder (class), else to the folder of its first style (id, style) (style), else nowhere (unmatched).

    A row that is there already is in-place. Names that rows have now, and those of taken (path), count as taken whatever moves first, so applying a plan in any order overwrites nothing.
    """
    name = F.substring_index("path", "/", -1)
    plan = predictions.select("id", "path", "is_match", "class").join(styles.select("id", "style"), "id", "left")
    style = F.array_join(F.filter(F.transform(F.split("style", "---"), lambda s: F.btrim(F.regexp_replace(s, r'[<>:"/\\|?*]', "_"), F.lit(" ."))), lambda s: s != ""), "/")
    folder = F.when(F.col("is_match"), below_root("class")).when(F.lit(fallback) & F.col("style").isNotNull() & (style != ""), style)
    plan = plan.withColumn("folder", folder).withColumn("place", F.concat_ws("/", root("path"), F.when(F.col("folder") != "", F.col("folder"))))
    stays = F.col("folder").isNotNull() & (_folder("path") == F.col("place"))
    plan = plan.withColumn("reason", F.when(F.col("folder").isNull(), "unmatched").when(stays, "in-place").when(F.col("is_match"), "class").otherwise("style"))
    plan = stash(plan.select("id", "path", "reason", F.concat_ws("/", "place", name).alias("raw")), "sort-plan")
    held = plan.select("path") if taken is None else plan.select("path").unionByName(taken.select("path"))
    names = free_names(plan.where("reason IN ('class', 'style')").select("id", "raw", F.col("path").alias("turn")), held)
    return plan.join(names, "id", "left").select("id", F.col("path").alias("source"), F.coalesce("name", "path").alias("target"), "reason")


def counts(plan: DataFrame) -> DataFrame:
    """(what, n): rows by reason, and "emptied": folders that hold rows in or below them before the plan and none afterwards."""
    reasons = plan.groupBy(F.col("reason").alias("what")).agg(F.count("*").alias("n"))
    holding = lambda c: plan.select(_folder(c).alias("folder")).distinct().select(F.explode(ancestors("folder")).alias("folder")).distinct()
    emptied = holding("source").join(holding("target"), "folder", "left_anti").agg(F.count("*").alias("n")).select(F.lit("emptied").alias("what"), "n")
    return reasons.unionByName(emptied)


def moves_of(plan: DataFrame, items: DataFrame, batch_id: str, created: int) -> DataFrame:
    """Journal rows of the rows that a plan moves."""
    moved = plan.where("source <> target").join(items.select("id", "fingerprint"), "id")
    return moved.select(F.lit(batch_id).alias("batch_id"), F.lit(created).cast("long").alias("created"), "fingerprint", "source", "target", F.lit(False).alias("undone"))


def applied(items: DataFrame, plan: DataFrame) -> DataFrame:
    """items (id, path, ...) at their targets."""
    return items.join(plan.select("id", "target"), "id", "left").withColumn("path", F.coalesce("target", "path")).select(*items.columns)


def undone(items: DataFrame, journal: DataFrame, created: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """items, outcomes and journal after the latest batch that stands is reversed.

    Outcomes are (source, target, outcome): restored; skipped, if no row is at the target any more; occupied, if another row has the old place. The journal only grows: a tombstone marks the batch, whatever the outcomes.
    """
    batch = stash(latest_batch(journal).where("source IS NOT NULL"), "batch")
    here, there = items.select(F.col("path").alias("target"), F.lit(True).alias("here")).distinct(), items.select(F.col("path").alias("source"), F.lit(True).alias("there")).distinct()
    outcome = F.when(F.col("here").isNull(), "skipped").when(F.col("there").isNotNull(), "occupied").otherwise("restored")
    outcomes = stash(batch.join(here, "target", "left").join(there, "source", "left").select("source", "target", outcome.alias("outcome")), "outcomes")
    back = outcomes.where("outcome = 'restored'").select(F.col("target").alias("path"), "source")
    out = items.join(back, "path", "left").withColumn("path", F.coalesce("source", "path")).select(*items.columns)
    mark = batch.select("batch_id").distinct().select("batch_id", F.lit(created).cast("long").alias("created"), *(F.lit(None).cast("string").alias(c) for c in ("fingerprint", "source", "target")), F.lit(True).alias("undone"))
    return out, outcomes, journal.unionByName(mark)


def remembered(origins: DataFrame, moves: DataFrame) -> DataFrame:
    """origins (fingerprint, origin, recorded) after journal rows: the folder that each known fingerprint last left; of one batch the least."""
    new = moves.where("coalesce(fingerprint, '') <> '' AND NOT undone").groupBy("fingerprint", "created").agg(F.min(below_root_folder("source")).alias("origin"))
    return upsert(origins, new.select("fingerprint", "origin", F.col("created").alias("recorded")), ["fingerprint"], F.col("recorded"))


def below_root_folder(path: str):
    """The folder of a path below its root."""
    return F.regexp_replace(F.regexp_replace(path, "^[^/]*/?", ""), "/?[^/]*$", "")
