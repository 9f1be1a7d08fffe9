"""Labelled cohorts: reasons for rejects, whole groups of shared identities, and a running dev / held-out split."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecatlas.operators.graph import components, stars
from vecatlas.sources.scratch import stash

DEV = (7, 10)  # the share of rows that goes to dev
RANGE, STATES = 50_000, 10_000  # groups that one task folds, and states that it folds them for


def with_reasons(items: DataFrame, root: str) -> DataFrame:
    """items with reject_reason, null for those that stay: the first that holds of outside_root, missing_fingerprint, no_label, fingerprint_conflict (one fingerprint under several labels), fingerprint_duplicate (all but the least path)."""
    candidate = (F.col("root_id") == root) & (F.coalesce("fingerprint", F.lit("")) != "") & F.col("label").isNotNull()
    per = items.where(candidate).groupBy("fingerprint").agg(F.countDistinct("label").alias("__labels"), F.min("path").alias("__first"))
    reason = (
        F.when(~F.coalesce(F.col("root_id") == root, F.lit(False)), "outside_root")
        .when(F.coalesce("fingerprint", F.lit("")) == "", "missing_fingerprint")
        .when(F.col("label").isNull(), "no_label")
        .when(F.col("__labels") > 1, "fingerprint_conflict")
        .when(F.col("path") > F.col("__first"), "fingerprint_duplicate")
    )
    return items.join(per, "fingerprint", "left").withColumn("reject_reason", reason).select(*items.columns, "reject_reason")


def identity_groups(rows: DataFrame, identities: list[str]) -> DataFrame:
    """(id, group): rows that share an identity, or are linked by others that do, have one group, named by its least id."""
    parts = components(stars(rows, "id", identities))
    return rows.select("id").join(parts.withColumnRenamed("v", "id"), "id", "left").select("id", F.coalesce("label", "id").alias("group"))


def _step(state, n, dev: int, whole: int):
    """The state after a group of n rows, and whether it went to dev. The state is whole times the dev rows minus dev times all rows so far."""
    taken = state < dev * n
    return np.where(taken, state + (whole - dev) * n, state - dev * n), taken


def running_split(groups: DataFrame, seed: int = 42, share: tuple[int, int] = DEV, per_range: int = RANGE, states: int = STATES) -> DataFrame:
    """(group, split): groups (group, n) in order of the MD5 of "seed:group" go to dev while dev rows are less than the share of all rows so far, their own with them; else to heldout.

    The rule runs through all groups one after the other, yet no task sees them all. It has one state, a whole number from 0 to a multiple of the largest group: so each range of groups is folded, by its own
    task, into a table from every state below ``states`` to the state at its end; the tables are composed in order, which gives each range its first state, and ranges then split their groups side by
    side. Where a very large group leaves a greater state than the tables know, that one range is folded anew from it.
    """
    dev, whole = share
    spark = groups.sparkSession
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col("group").cast("string")).cast("binary"))
    ranges = max(1, -(-groups.count() // per_range))
    placed = groups.select("group", F.col("n").cast("long").alias("n"), order.alias("turn")).repartitionByRange(ranges, "turn")
    placed = stash(placed.withColumn("range", F.spark_partition_id()), "turns")
    if placed.isEmpty():
        return placed.select("group", F.lit("dev").alias("split"))
    most = placed.agg(F.max("n")).first()[0]
    states = min(states, whole * most)

    def folded(table: pd.DataFrame) -> pd.DataFrame:
        state = np.arange(states, dtype=np.int64)
        for n in table.sort_values("turn")["n"]:
            state = _step(state, n, dev, whole)[0]
        return pd.DataFrame({"range": [table["range"].iloc[0]], "ends": [state.tolist()]})

    tables = {r["range"]: r["ends"] for r in placed.groupBy("range").applyInPandas(folded, "range int, ends array<long>").toLocalIterator()} if ranges > 1 else {}
    first, state = [], 0
    for r in sorted(tables or [x["range"] for x in placed.select("range").distinct().collect()]):
        first.append((r, state))
        if r in tables and state < states:
            state = tables[r][state]
        elif ranges > 1:  # beyond the table
            from_ = state

            def ends(table: pd.DataFrame) -> pd.DataFrame:
                at = from_  # noqa: B023  the job runs within this turn of the loop
                for n in table.sort_values("turn")["n"]:
                    at = int(_step(at, n, dev, whole)[0])
                return pd.DataFrame({"range": [table["range"].iloc[0]], "ends": [[at]]})

            state = placed.where(F.col("range") == r).groupBy("range").applyInPandas(ends, "range int, ends array<long>").first()["ends"][0]

    def split(table: pd.DataFrame) -> pd.DataFrame:
        state, out = int(table["state"].iloc[0]), []
        table = table.sort_values("turn")
        for n in table["n"]:
            state, taken = _step(state, n, dev, whole)
            out.append("dev" if taken else "heldout")
        return pd.DataFrame({"group": table["group"], "split": out})

    known = placed.join(F.broadcast(spark.createDataFrame(first, "range int, state long")), "range")  # a row per range
    kind = groups.schema["group"].dataType.simpleString()
    return known.groupBy("range").applyInPandas(split, f"group {kind}, split string")


def cohort(items: DataFrame, root: str, identities: tuple[str, ...] = ("artist", "release"), seed: int = 42) -> DataFrame:
    """items with reject_reason, group and split; the last two are null for rejected rows."""
    judged = stash(with_reasons(items, root), "judged")
    stay = judged.where("reject_reason IS NULL")
    groups = stash(identity_groups(stay, list(identities)), "groups")
    split = running_split(groups.groupBy("group").agg(F.count("*").alias("n")), seed)
    return judged.join(groups.join(split, "group"), "id", "left")


def diagnostics(cohorts: DataFrame) -> DataFrame:
    """(kind, name, split, n) of a cohort: rejects by reason ("rejected"), rows by label and split ("label"), labels without a row in a split ("lacking", n 0), and groups by split ("groups")."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    stay = cohorts.where("reject_reason IS NULL")
    rejected = cohorts.where("reject_reason IS NOT NULL").groupBy(F.lit("rejected").alias("kind"), F.col("reject_reason").alias("name"), F.lit("").alias("split")).agg(F.count("*").alias("n"))
    counts = stay.groupBy(text("label").alias("name"), "split").agg(F.count("*").alias("n"))
    wide = counts.groupBy("name").pivot("split", ["dev", "heldout"]).agg(F.sum("n"))
    lacking = wide.select(F.lit("lacking").alias("kind"), "name", F.explode(F.array_compact(F.array(F.when(F.col("dev").isNull(), "dev"), F.when(F.col("heldout").isNull(), "heldout")))).alias("split"), F.lit(0).cast("long").alias("n"))
    groups = stay.groupBy(F.lit("groups").alias("kind"), F.lit("").alias("name"), "split").agg(F.countDistinct("group").alias("n"))
    return rejected.unionByName(counts.select(F.lit("label").alias("kind"), "name", "split", "n")).unionByName(lacking).unionByName(groups)
