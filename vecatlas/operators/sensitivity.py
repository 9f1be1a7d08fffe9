"""How a landmark layout moves with the weights of its sources, previews of such moves, and 3-D layouts seen head-on."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecatlas.operators.layout import moments
from vecatlas.operators.search import literal


def weighted_delta(df: DataFrame, sources: list[str], weights: dict[str, float]) -> DataFrame:
    """df with delta = the weighted sum of its columns delta_<source> (squared distances to the landmarks)."""
    parts = ", ".join(f"{float(weights[s])!r}D * delta_{s}[i]" for s in sources).replace(", ", " + ")
    return df.withColumn("delta", F.expr(f"transform(sequence(0, size(delta_{sources[0]}) - 1), i -> {parts})"))


def derivatives(df: DataFrame, sources: list[str], coefficients: np.ndarray, tau: float) -> DataFrame:
    """(id, x, y, s, dx, dy): the placed coordinates and their derivative by the weight of each source, from columns affinity and delta_<source>.

    The derivative is minus the covariance, under a row's affinities, of a source's distances and the landmarks' coefficients, over tau. A narrow step.
    """
    cx, cy = literal(coefficients[:, 0]), literal(coefficients[:, 1])
    mean = lambda a, b: f"aggregate(zip_with({a}, {b}, (p, q) -> p * q), 0D, (s, v) -> s + v)"
    out = df.withColumn("x", F.expr(mean("affinity", cx))).withColumn("y", F.expr(mean("affinity", cy)))
    each = []
    for s in sources:
        out = out.withColumn(f"__{s}", F.expr(f"zip_with(affinity, delta_{s}, (a, d) -> a * d)"))
        total = f"aggregate(__{s}, 0D, (s, v) -> s + v)"
        each.append(F.struct(F.lit(s).alias("s"), F.expr(f"({total} * x - {mean(f'__{s}', cx)}) / {tau!r}D").alias("dx"), F.expr(f"({total} * y - {mean(f'__{s}', cy)}) / {tau!r}D").alias("dy")))
    return out.select("id", "x", "y", F.explode(F.array(*each)).alias("e")).select("id", "x", "y", "e.*")


def without_gauge(moves: DataFrame) -> DataFrame:
    """The derivatives (id, x, y, s, dx, dy) less what only shifts or zooms the whole map: per source one shift an axis and one zoom, by least squares. Fewer than four rows stay as they are."""
    m = lambda c: F.avg(c)
    sums = moves.groupBy("s").agg(F.count("*").alias("n"), *(m(c).alias(f"m_{c}") for c in ("x", "y", "dx", "dy")), (F.var_pop("x") + F.var_pop("y")).alias("spread"), (F.covar_pop("x", "dx") + F.covar_pop("y", "dy")).alias("along"))
    fits = sums.withColumn("zoom", F.when(F.col("spread") > 0, F.col("along") / F.col("spread")).otherwise(0.0)).drop("spread", "along")
    rest = lambda c: F.when(F.col("n") < 4, F.col(f"d{c}")).otherwise(F.col(f"d{c}") - F.col(f"m_d{c}") - F.col("zoom") * (F.col(c) - F.col(f"m_{c}")))
    return moves.join(F.broadcast(fits), "s").select("id", "x", "y", "s", rest("x").alias("dx"), rest("y").alias("dy"))  # a row per source


def preview(moves: DataFrame, step: dict[str, float]) -> DataFrame:
    """(id, x, y) of the layout after a step of weights, to first order, scaled to the extent that it had on each axis; no step leaves it as it is."""
    base = lambda c: F.first(c).alias(c)  # noqa: E731  x and y are the same in all rows of an id
    by = F.lit(0.0)
    for s, d in step.items():
        by = F.when(F.col("s") == s, float(d)).otherwise(by)
    sums = moves.groupBy("id").agg(base("x"), base("y"), F.sum(F.col("dx") * by).alias("dx"), F.sum(F.col("dy") * by).alias("dy"))
    if not any(step.values()):
        return sums.select("id", "x", "y")
    moved = sums.withColumn("mx", F.col("x") + F.col("dx")).withColumn("my", F.col("y") + F.col("dy"))
    box = moved.agg(*(g(c).alias(f"{n}_{c}") for c in ("x", "y", "mx", "my") for n, g in (("lo", F.min), ("hi", F.max)))).first()

    def back(c: str):
        if box["lo_x"] is None:
            return F.col(f"m{c}")
        old, new = box[f"hi_{c}"] - box[f"lo_{c}"], box[f"hi_m{c}"] - box[f"lo_m{c}"]
        zoom = 1.0 if new <= 1e-9 else (old if old > 1e-9 else 1.0) / new
        return (box[f"lo_{c}"] + box[f"hi_{c}"]) / 2 + (F.col(f"m{c}") - (box[f"lo_m{c}"] + box[f"hi_m{c}"]) / 2) * zoom

    return moved.select("id", back("x").alias("x"), back("y").alias("y"))


def head_on(cloud: DataFrame, reference: DataFrame, anchor: str | int | None = None, *, least: int = 8) -> DataFrame:
    """The 3-D layout (id, x, y, z) turned and scaled so that x and y lie on the 2-D reference (id, x, y); z completes the frame, and its sign is such that the anchor's z is not negative.

    Without an anchor (or where it is missing) the frame is a proper rotation. Unchanged when fewer than least ids are shared or these lie on one line.
    """
    both = cloud.select("id", F.array("x", "y", "z").alias("p")).join(reference.select("id", F.array("x", "y").alias("q")), "id")
    n, s, p = moments(both, ["p", "q"])
    if n < least:
        return cloud
    mean = s / n
    c = p / n - np.outer(mean, mean)
    d = np.linalg.svd(c[:3, 3:], compute_uv=False)
    if not np.isfinite(d).all() or d[1] <= 1e-9 * max(d[0], 1e-3):
        return cloud
    u, _, vt = np.linalg.svd(c[3:, :3] @ np.linalg.pinv(c[:3, :3]), full_matrices=False)
    plane = u @ vt
    scale = float(np.trace(plane @ c[:3, 3:]) / np.trace(plane @ c[:3, :3] @ plane.T))
    if not scale > 0:
        return cloud
    frame = scale * np.vstack([plane, np.cross(plane[0], plane[1])])
    to = [*mean[3:], 0.0]
    along = lambda k: sum(((F.col(a) - float(mean[i])) * float(frame[k, i]) for i, a in enumerate("xyz")), F.lit(float(to[k])))
    out = cloud.select("id", along(0).alias("x"), along(1).alias("y"), along(2).alias("z"))
    pinned = None if anchor is None else out.where(F.col("id") == anchor).select("z").first()
    return out.withColumn("z", -F.col("z")) if pinned and (pinned["z"] or 0) < 0 else out
