"""Retrieval reports of many recipes at once: a pair of blocks meets once and is ranked in every recipe, geometry and candidate mode."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecatlas.functions.vectors import is_valid, scaled, unit
from vecatlas.operators.layout import pca
from vecatlas.operators.search import ROWS, best_columns, dealt, matrix
from vecatlas.sources.scratch import stash

MODES = ("all", "unrelated")


@dataclass(frozen=True)
class View:
    """A way to compare rows: the mean of the cosines of vector columns, by weight."""

    recipe: str
    geometry: str
    weights: dict[str, float]


def _codes(*sides: list) -> list[np.ndarray]:
    """Equal known strings as equal numbers, over both sides; unknown ones (null or empty) as -1."""
    known = {v: i for i, v in enumerate(sorted({v for side in sides for v in side if v}))}
    return [np.array([known.get(v, -1) for v in side], dtype=np.int64) for side in sides]


def ranked(rows: DataFrame, views: list[View], k: int, *, modes: tuple[str, ...] = MODES, blocks: int | None = None) -> DataFrame:
    """(recipe, geometry, mode, id, other, score, rank, ql, nl): for each row (id, label, artist, release, vector columns) its k best others in every view and mode; ties by least id.

    "unrelated" leaves out candidates of the row's own known artist or release; they are masked before ranking, so k candidates remain wherever so many exist. Rows are dealt to blocks; a pair of blocks
    is one task's work and sends k rows per query, view and mode; labels travel along, so nothing is joined afterwards.
    """
    columns = sorted({c for v in views for c in v.weights})
    base = rows
    for c in columns:
        base = unit(base, c, c)
    base = base.select("id", "label", "artist", "release", *columns)
    kind = rows.schema["label"].dataType.simpleString()

    def best(key, table):
        side = np.array(table["side"])
        q, d = table.filter(pa.array(side == 0)), table.filter(pa.array(side == 1)).sort_by("id")
        names = [("view", pa.int32()), ("id", pa.int64()), ("other", pa.int64()), ("score", pa.float64()), ("ql", table["label"].type), ("nl", table["label"].type)]
        parts = [pa.schema(names).empty_table()]
        if not (q.num_rows and d.num_rows):
            return parts[0]
        qi, di = np.array(q["id"]), np.array(d["id"])
        (qa, da), (qr, dr) = (_codes(q[c].to_pylist(), d[c].to_pylist()) for c in ("artist", "release"))
        for n, v in enumerate(views):
            total = sum(v.weights.values())
            x, y = (np.hstack([matrix(t[c]) * math.sqrt(w / total) for c, w in v.weights.items()]) for t in (q, d))
            for lo in range(0, len(qi), ROWS):
                own = lambda i, j: qi[lo + i] == di[j]  # noqa: E731, B023
                kin = lambda i, j: own(i, j) | ((qa[lo + i] == da[j]) & (da[j] >= 0)) | ((qr[lo + i] == dr[j]) & (dr[j] >= 0))  # noqa: E731, B023
                some = x[lo : lo + ROWS]
                found = best_columns(lambda first, end: some @ y[first:end].T, len(some), len(di), k, [kin if mode == "unrelated" else own for mode in modes])  # noqa: B023
                for m, (i, j, s) in enumerate(found):
                    i += lo
                    parts.append(pa.table([np.full(len(i), n * len(modes) + m, dtype=np.int32), qi[i], di[j], s, q["label"].take(pa.array(i)), d["label"].take(pa.array(j))], pa.schema(names)))
        return pa.concat_tables(parts)

    local = dealt(base, base, columns, blocks).groupBy("a", "b").applyInArrow(best, f"view int, id long, other long, score double, ql {kind}, nl {kind}")
    w = Window.partitionBy("view", "id").orderBy(F.desc("score"), "other")
    told = F.array(*(F.struct(F.lit(v.recipe).alias("recipe"), F.lit(v.geometry).alias("geometry"), F.lit(mode).alias("mode")) for v in views for mode in modes))
    return local.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(told[F.col("view")].alias("v"), "*").select("v.*", "id", "other", "score", "rank", "ql", "nl")


def report(best: DataFrame, splits: DataFrame) -> DataFrame:
    """(recipe, geometry, split, mode, micro, macro, queries, k_min, k_max) over the queries of each split (id, split): the share of neighbours of the query's label, of all and as a mean over labels."""
    keys = ["recipe", "geometry", "split", "mode"]
    per = best.join(splits.select("id", "split"), "id").groupBy(*keys, "ql", "id").agg(F.count_if(F.col("ql") == F.col("nl")).alias("hits"), F.count("*").alias("k"))
    label = per.groupBy(*keys, "ql").agg(F.sum("hits").alias("hits"), F.sum("k").alias("ks"), F.avg(F.col("hits") / F.col("k")).alias("p"), F.count("*").alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi"))
    return label.groupBy(*keys).agg(F.round(F.sum("hits") / F.sum("ks"), 6).alias("micro"), F.round(F.avg("p"), 6).alias("macro"), F.sum("n").alias("queries"), F.min("lo").alias("k_min"), F.max("hi").alias("k_max"))


def picked(reports: DataFrame, families: dict[str, str]) -> DataFrame:
    """reports with family and picked: of each family the recipe and geometry of the greatest macro precision on dev queries among all candidates; ties by recipe, then geometry. Held-out queries have no say."""
    named = reports.join(F.broadcast(reports.sparkSession.createDataFrame(sorted(families.items()), "recipe string, family string")), "recipe")  # a row per recipe
    w = Window.partitionBy("family").orderBy(F.desc("macro"), "recipe", "geometry")
    best = named.where("split = 'dev' AND mode = 'all'").withColumn("r", F.row_number().over(w)).where("r = 1").select("recipe", "geometry", F.lit(True).alias("picked"))
    return named.join(F.broadcast(best), ["recipe", "geometry"], "left").withColumn("picked", F.coalesce("picked", F.lit(False)))


def compare_recipes(rows: DataFrame, recipes: dict[str, tuple[str, dict[str, float]]], k: int = 10, *, pca_dims: int | None = 50) -> DataFrame:
    """Every recipe (name -> family and weights of vector columns), raw and after PCA fitted to dev rows, for dev and held-out queries, among all and among unrelated candidates; with each family's pick.

    rows are (id, label, split, artist, release, vector columns); rows with a null, not finite or zero vector in any used column take no part, and both splits must be left. A recipe's PCA keeps at most
    pca_dims, dev rows - 1 and width - 1 components; without pca_dims only raw geometry is compared.
    """
    used = sorted({c for _, w in recipes.values() for c in w})
    good = rows
    for c in used:
        good = good.where(F.col(c).isNotNull() & is_valid(c))
    good = stash(good.select("id", "label", "split", "artist", "release", *used), "cohort")
    counts = {r["split"]: r["count"] for r in good.groupBy("split").count().collect()}
    if not (counts.get("dev") and counts.get("heldout")):
        raise ValueError(f"both splits must have rows in every source: {counts}")
    views = [View(name, "raw", weights) for name, (_, weights) in sorted(recipes.items())]
    if pca_dims:
        for i, (name, (_, weights)) in enumerate(sorted(recipes.items())):
            blocks = good
            total = sum(weights.values())
            for c in weights:
                blocks = unit(blocks, c, f"u_{c}")
            parts = (scaled(f"u_{c}", f"{math.sqrt(w / total)!r}D") for c, w in sorted(weights.items()))
            whole = blocks.select("id", "split", F.concat(*parts).alias("vec"))
            width = whole.select(F.size("vec")).first()[0]
            reduced = pca(whole, min(pca_dims, max(1, width - 1)), whole.where("split = 'dev'"))
            good = good.join(reduced.select("id", F.col("reduced").alias(f"pca_{i}")), "id")
            views.append(View(name, f"pca{pca_dims}", {f"pca_{i}": 1.0}))
        good = stash(good, "cohort-pca")
    return picked(stash(report(ranked(good, views, k), good), "report"), {name: family for name, (family, _) in recipes.items()})

