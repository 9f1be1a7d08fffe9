"""A learned projection that pulls rows of a class together, and the run from labels to predictions."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecatlas.functions.vectors import unit
from vecatlas.operators.filters import class_labels
from vecatlas.operators.gather import composite
from vecatlas.operators.layout import moments, project
from vecatlas.operators.scoring import assign, centroids, dispersion, floors, matched
from vecatlas.operators.search import hard_negatives
from vecatlas.sources.scratch import stash


def weighted_moments(df: DataFrame, vec: str, weight: str) -> tuple[float, np.ndarray, np.ndarray]:
    """Sum of the weights, weighted sum and weighted products of a vector column, added up by tasks."""
    root = df.select(F.col(vec).alias("__v"), F.sqrt(F.col(weight).cast("double")).alias("__r"))
    _, _, p = moments(root.select(F.expr("transform(__v, x -> CAST(x AS DOUBLE) * __r)").alias("v"), F.array("__r").alias("r")), ["v", "r"])
    return float(p[-1, -1]), p[:-1, -1], p[:-1, :-1]


def fit(rows: DataFrame, label: str = "class", *, weight: str | None = None, pairs: DataFrame | None = None, push: float = 0.5, dims: int = 32, ridge: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Mean and basis of a regularised discriminant of rows (id, vec, label): spread between classes against spread within them.

    Rows count by their weight (1 if none is named; it is not negative, null is 1). pairs (a, b) are rows of unlike classes that lie close; the spread of their differences
    counts as spread between classes, times push. The within-class spread is drawn towards a multiple of the identity by ridge. Directions of no
    spread between classes are left out, so there may be fewer than dims. Only width x width numbers reach the driver.
    """
    base = rows.select("id", "vec", F.col(label).alias("c"), (F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight else F.lit(1.0)).alias("w"))
    total, s, p = weighted_moments(base, "vec", "w")
    sums = base.select("c", "w", F.posexplode("vec").alias("d", "x")).groupBy("c", "d").agg(F.sum(F.col("x") * F.col("w")).alias("s"), F.sum("w").alias("w"))
    means = sums.where("w > 0").groupBy("c").agg(F.max("w").alias("w"), F.transform(F.sort_array(F.collect_list(F.struct("d", (F.col("s") / F.col("w")).alias("m")))), lambda v: v["m"]).alias("m"))
    _, _, between = weighted_moments(means, "m", "w")
    mean = s / total
    inner, outer = (p - between) / total, between / total - np.outer(mean, mean)
    if pairs is not None:
        left, right = base.select(F.col("id").alias("a"), F.col("vec").alias("x")), base.select(F.col("id").alias("b"), F.col("vec").alias("y"))
        apart = stash(pairs.join(left, "a").join(right, "b").select(F.expr("zip_with(x, y, (p, q) -> CAST(p AS DOUBLE) - q)").alias("v"), F.lit(1.0).alias("w")), "apart")
        if not apart.isEmpty():
            n, _, q = weighted_moments(apart, "v", "w")
            outer = outer + push * q / n * (np.trace(outer) / max(np.trace(q / n), 1e-12))
    width = len(mean)
    within = (1 - ridge) * inner + ridge * max(np.trace(inner) / width, 1e-9) * np.eye(width)
    half = np.linalg.inv(np.linalg.cholesky(within))
    values, vectors = np.linalg.eigh(half @ outer @ half.T)
    best = [i for i in np.argsort(values)[::-1][:dims] if values[i] > 1e-9 * values.max()]
    basis = half.T @ vectors[:, best]
    return mean, basis * np.sign(basis[np.abs(basis).argmax(axis=0), np.arange(basis.shape[1])])


def projected(rows: DataFrame, mean: np.ndarray, basis: np.ndarray) -> DataFrame:
    """rows with vec = its unit image under the learned map, in a narrow step."""
    moved = project(rows, mean, basis, "__head")
    return unit(moved, "__head", "vec").drop("__head")


def save_map(spark: SparkSession, mean: np.ndarray, basis: np.ndarray, path: str) -> None:
    """The map as a table: row 0 is the mean, the others are the basis row by row."""
    rows = [(0, mean.tolist())] + [(i + 1, r.tolist()) for i, r in enumerate(basis)]
    spark.createDataFrame(rows, "place int, numbers array<double>").coalesce(1).write.mode("overwrite").parquet(path)


def load_map(spark: SparkSession, path: str) -> tuple[np.ndarray, np.ndarray]:
    rows = [r["numbers"] for r in spark.read.parquet(path).orderBy("place").collect()]
    return np.array(rows[0]), np.array(rows[1:])


def train(items: DataFrame, used: list[str], weights: dict[str, float], segments: DataFrame, out: str, *, least: int = 8, near: int = 3, dims: int = 32) -> dict[str, str]:
    """Fit and score a whole library of gathered items (id, folder, fingerprint, a column per source), under a new run.

    Classes are leaf folders of enough rows; a row counts by the confidence of its segments (1 without any). Below ``out/run`` are then the tables map,
    centroids, floors and predictions (id, class, pred, sim, is_match) of all rows, those without a class too. Fewer than two classes: nothing is written and the reason is returned.
    """
    spark = items.sparkSession
    labelled = class_labels(items, least)
    if labelled.where("class >= 0").select("class").distinct().count() < 2:
        return {"status": "skipped", "reason": "fewer than two folders of enough rows"}
    trust = dispersion(segments).select("fingerprint", "confidence")
    rows = composite(labelled, used, weights, standard=False).join(trust, "fingerprint", "left").select("id", "class", "vec", F.coalesce("confidence", F.lit(1.0)).alias("confidence"))
    rows = stash(rows, "composite")
    known = rows.where("class >= 0")
    mean, basis = fit(known, weight="confidence", pairs=hard_negatives(known, "class", near), dims=dims)
    run = uuid.uuid4().hex
    base = f"{out}/{run}"
    save_map(spark, mean, basis, f"{base}/map")
    head = stash(projected(rows, mean, basis), "projected")
    known = head.where("class >= 0")
    centroids(known).write.parquet(f"{base}/centroids")
    cents = spark.read.parquet(f"{base}/centroids")
    floors(known, cents).write.parquet(f"{base}/floors")
    predictions(spark, base, head).select("id", "class", "pred", "sim", "is_match").write.parquet(f"{base}/predictions")
    return {"status": "trained", "run": run, "path": base}


def predictions(spark: SparkSession, run_path: str, head: DataFrame) -> DataFrame:
    """Projected rows with the class, likeness and match of a stored run."""
    return matched(assign(head, spark.read.parquet(f"{run_path}/centroids")), spark.read.parquet(f"{run_path}/floors"))


def score_missing(items: DataFrame, used: list[str], weights: dict[str, float], run_path: str) -> DataFrame:
    """(id, pred, sim, is_match) of gathered items by a stored run, without fitting anything anew; as good for one row as for all."""
    spark = items.sparkSession
    mean, basis = load_map(spark, f"{run_path}/map")
    rows = composite(items, used, weights, standard=False).select("id", "vec")
    return predictions(spark, run_path, projected(rows, mean, basis)).select("id", "pred", "sim", "is_match")
