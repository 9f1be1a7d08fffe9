"""Linear maps between vectors and layouts: PCA, landmarks, alignment. Tasks add up small moment matrices; only those reach the driver."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecatlas.operators.search import lists, literal, matrix


def moments(df: DataFrame, columns: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, sums and products of the concatenated vector columns: one matrix per task, added by Spark."""
    both = df.select(F.concat(*(F.transform(c, lambda x: x.cast("double")) for c in columns)).alias("v"))

    def add(batches):
        n, s, p = 0, None, None
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(0))
                n += len(x)
                s, p = (x.sum(axis=0), x.T @ x) if s is None else (s + x.sum(axis=0), p + x.T @ x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([[float(n), *s, *p.ravel()]], pa.list_(pa.float64()))], ["m"])

    # one job, as what comes before may be costly
    parts = both.mapInArrow(add, "m array<double>").select(F.posexplode("m").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"))
    m = np.array([r["x"] for r in parts.orderBy("i").collect()])
    if not len(m):
        return 0, np.zeros(0), np.zeros((0, 0))
    width = (math.isqrt(4 * len(m) - 3) - 1) // 2  # of 1 + width + width^2 numbers
    return int(m[0]), m[1 : width + 1], m[width + 1 :].reshape(width, width)


def pca(df: DataFrame, dims: int, fit_on: DataFrame | None = None) -> DataFrame:
    """df with reduced = at most dims, width and (fitted rows - 1) leading components of vec; each component's greatest loading is positive. fit_on are the rows to fit."""
    n, s, p = moments(df if fit_on is None else fit_on, ["vec"])
    if n < 2:
        raise ValueError("fewer than two rows to fit")
    mean = s / n
    values, vectors = np.linalg.eigh(p / n - np.outer(mean, mean))
    basis = vectors[:, np.argsort(values)[::-1][: min(dims, len(s), n - 1)]]
    basis = basis * np.sign(basis[np.abs(basis).argmax(axis=0), np.arange(basis.shape[1])])
    return project(df, mean, basis, "reduced")


def project(df: DataFrame, mean: np.ndarray, basis: np.ndarray, out: str) -> DataFrame:
    """df with out = (vec - mean) basis, in one narrow step."""
    schema = df.schema

    def run(batches):
        for b in batches:
            yield projected_batch(b, mean, basis, out)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return df.mapInArrow(run, f"{fields}, {out} array<double>")


def projected_batch(b: pa.RecordBatch, mean: np.ndarray, basis: np.ndarray, out: str) -> pa.RecordBatch:
    x = matrix(b.column(b.schema.get_field_index("vec"))).reshape(b.num_rows, len(mean))
    return pa.RecordBatch.from_arrays([*b.columns, lists((x - mean) @ basis)], [*b.schema.names, out])


def similarity_transform(a: DataFrame, b: DataFrame, *, least: int = 8, scale: bool = True) -> tuple[np.ndarray, float, np.ndarray, np.ndarray] | None:
    """Rotation or reflection, scale and centroids that carry the shared ids of a onto b; None when too few are shared."""
    both = a.select("id", F.array("x", "y").alias("p")).join(b.select("id", F.array("x", "y").alias("q")), "id")
    n, s, p = moments(both, ["p", "q"])
    if n < least:
        return None
    mean = s / n
    c = p / n - np.outer(mean, mean)
    u, d, vt = np.linalg.svd(c[:2, 2:])
    return u @ vt, float(d.sum() / np.trace(c[:2, :2])) if scale else 1.0, mean[:2], mean[2:]


def align(layout: DataFrame, reference: DataFrame, *, least: int = 8, scale: bool = True) -> DataFrame:
    """The layout turned (and scaled) onto the reference; unchanged when fewer than least ids are shared."""
    t = similarity_transform(layout, reference, least=least, scale=scale)
    if t is None:
        return layout
    r, k, a, b = t
    x, y = F.col("x") - float(a[0]), F.col("y") - float(a[1])
    return layout.select("id", (k * (x * float(r[0, 0]) + y * float(r[1, 0])) + float(b[0])).alias("x"), (k * (x * float(r[0, 1]) + y * float(r[1, 1])) + float(b[1])).alias("y"))


def affine_map(a: DataFrame, b: DataFrame) -> np.ndarray:
    """3 x 2 least-squares matrix from (1, x, y) of a to (x, y) of b on shared ids; needs three and full rank."""
    both = a.select("id", F.array(F.lit(1.0), F.col("x"), F.col("y")).alias("p")).join(b.select("id", F.array("x", "y").alias("q")), "id")
    n, _, p = moments(both, ["p", "q"])
    if n < 3 or np.linalg.matrix_rank(p[:3, :3]) < 3:
        raise ValueError("too few shared rows, or all on one line")
    return np.linalg.solve(p[:3, :3], p[:3, 3:])


def normalise(layout: DataFrame) -> DataFrame:
    """Each axis to 0..1; an axis without extent to 0.5. The extent is one aggregate of one row."""
    lo_x, hi_x, lo_y, hi_y = layout.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    unit = lambda c, lo, hi: F.lit(0.5) if lo is None or hi == lo else (F.col(c) - F.lit(lo)) / F.lit(hi - lo)
    return layout.select("id", unit("x", lo_x, hi_x).alias("x"), unit("y", lo_y, hi_y).alias("y"))


def landmarks(df: DataFrame, m: int = 128, seed: int = 1) -> DataFrame:
    """The real rows nearest to each of m seeded k-means centres; all rows when there are no more than m."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    if df.limit(m + 1).count() <= m:
        return df.select("id", "vec")
    feats = df.select("id", "vec", array_to_vector(F.transform("vec", lambda x: x.cast("double"))).alias("f"))
    model = KMeans(k=m, seed=seed, featuresCol="f", predictionCol="c", maxIter=10).fit(feats)
    centres = df.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(model.clusterCenters())], "c int, centre array<double>")
    near = model.transform(feats).drop("f").join(F.broadcast(centres), "c").withColumn("d", F.round(F.expr("aggregate(zip_with(vec, centre, (x, y) -> (x - y) * (x - y)), 0D, (s, v) -> s + v)"), 9))
    return near.groupBy("c").agg(F.min(F.struct("d", "id", "vec")).alias("b")).select("b.id", "b.vec")


def representatives(df: DataFrame, by: str, most: int = 128) -> DataFrame:
    """(id): the least id of each class of by, of the first so many classes; a row without a class represents nothing."""
    return df.where(F.col(by).isNotNull()).groupBy(by).agg(F.min("id").alias("id")).orderBy(by).limit(most).select("id")


def among(df: DataFrame, marks: DataFrame) -> DataFrame:
    """The rows of df whose ids are marks, which are a few hundred at most."""
    return df.join(F.broadcast(marks), "id", "left_semi")


def broad_spearman(high: DataFrame, low: DataFrame, pairs: int = 2048, seed: int = 0) -> DataFrame:
    """(rho): rank correlation of distances between rows in two spaces, high (id, vec) and low (id, x, y); null for less than three pairs or a constant side.

    Rows of both spaces are drawn by the least hash of seed and id, at most so many, and each is paired with the next in that order, the last
    with the first; pairs at no distance in the high space are left out. What is ranked in one place is thus of bounded size. Ties have their average rank.
    """
    drawn = high.select("id", "vec").join(low.select("id", "x", "y"), "id").withColumn("h", F.sha1(F.concat_ws("-", F.lit(seed), F.col("id")))).orderBy("h", "id").limit(pairs)
    order, whole = Window.orderBy("h", "id"), Window.orderBy("h", "id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    here = F.struct("id", "vec", "x", "y")
    both = drawn.select(here.alias("a"), F.coalesce(F.lead(here).over(order), F.first(here).over(whole)).alias("b")).where("a.id <> b.id")
    far = F.expr("sqrt(aggregate(zip_with(a.vec, b.vec, (p, q) -> (CAST(p AS DOUBLE) - q) * (CAST(p AS DOUBLE) - q)), 0D, (s, v) -> s + v))")
    near = F.expr("sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))")
    apart = both.select(F.round(far, 9).alias("dh"), F.round(near, 9).alias("dl")).where("dh > 0")
    rank = lambda c: F.rank().over(Window.orderBy(c)) + (F.count("*").over(Window.partitionBy(c)) - 1) / 2.0
    rho = F.try_divide(F.covar_pop("rh", "rl"), F.stddev_pop("rh") * F.stddev_pop("rl"))  # null for a constant side
    return apart.select(rank("dh").alias("rh"), rank("dl").alias("rl")).agg(F.when(F.count("*") >= 3, F.round(rho, 6)).alias("rho"))


def landmark_distances(df: DataFrame, marks: DataFrame) -> DataFrame:
    """df with delta = squared distances to the landmarks (at most a few hundred, by id)."""
    rows = [r["vec"] for r in marks.orderBy("id").collect()]
    grid = f"array({','.join(literal(r) for r in rows)})"
    return df.withColumn("delta", F.expr(f"transform({grid}, l -> aggregate(zip_with(vec, l, (x, y) -> (CAST(x AS DOUBLE) - y) * (CAST(x AS DOUBLE) - y)), 0D, (s, v) -> s + v))"))


def affinities(df: DataFrame, tau: float) -> DataFrame:
    """df with affinity = softmax(-delta / tau), the greatest subtracted first."""
    shifted = df.withColumn("__least", F.array_min("delta")).withColumn("__e", F.expr(f"transform(delta, d -> exp((__least - d) / {tau!r}D))"))
    summed = shifted.withColumn("__t", F.expr("aggregate(__e, 0D, (s, x) -> s + x)"))
    return summed.withColumn("affinity", F.expr("transform(__e, x -> x / __t)")).drop("__least", "__e", "__t")


def landmark_map(df: DataFrame, layout: DataFrame, ridge: float = 1e-3) -> np.ndarray:
    """Ridge coefficients from affinities to the layout's coordinates; tasks add the products, the driver solves."""
    both = df.select("id", "affinity").join(layout.select("id", F.array("x", "y").alias("xy")), "id")
    _, _, p = moments(both, ["affinity", "xy"])
    m = len(p) - 2
    return np.linalg.solve(p[:m, :m] + ridge * np.eye(m), p[:m, m:])


def place(df: DataFrame, layout: DataFrame, coefficients: np.ndarray) -> DataFrame:
    """Rows of the layout keep their coordinates; others get those that the map says."""
    dotted = lambda k: F.expr(f"aggregate(zip_with(affinity, {literal(coefficients[:, k])}, (a, c) -> a * c), 0D, (s, v) -> s + v)")
    placed = df.select("id", dotted(0).alias("px"), dotted(1).alias("py"))
    return placed.join(layout.select("id", "x", "y"), "id", "left").select("id", F.coalesce("x", "px").alias("x"), F.coalesce("y", "py").alias("y"))


def p80_disc(layout: DataFrame) -> DataFrame:
    """One row: centroid, nearest-rank 80th percentile of the distance to it, and the box of the rows within."""
    cx, cy = layout.agg(F.avg("x"), F.avg("y")).first()
    d = layout.withColumn("d", F.round(F.hypot(F.col("x") - F.lit(cx), F.col("y") - F.lit(cy)), 9))
    r = d.agg(F.expr("percentile_disc(0.8) WITHIN GROUP (ORDER BY d)")).first()[0]
    box = d.where(F.col("d") <= F.lit(r)).agg(*(F.round(g(c), 6).alias(f"{n}_{c}") for c in "xy" for g, n in ((F.min, "lo"), (F.max, "hi"))))
    return box.select(F.round(F.lit(cx), 6).alias("cx"), F.round(F.lit(cy), 6).alias("cy"), F.round(F.lit(r), 6).alias("r"), "*")
