"""Folder anchors, directions and components, incremental placement and region layouts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecatlas.functions.paths import ancestors, parent, root
from vecatlas.functions.vectors import dot, norm, unit
from vecatlas.operators.layout import project
from vecatlas.operators.scoring import ancestor_centroids
from vecatlas.operators.search import matrix

# A folder's anchor needs four rows, and inherits above this cosine.
ANCHOR_ROWS, ANCHOR_COSINE = 4, 0.6
# A folder's components need eight rows, are two at most, and the second needs 0.18 of the first's singular value.
COMPONENT_ROWS, COMPONENTS, SECOND_SHARE = 8, 2, 0.18


def folder_anchors(rows: DataFrame, external: list[str]) -> DataFrame:
    """(node, n, anchor): the folder whose centroid stands for a node. Depth 1 and less: itself. Deeper: with enough rows on both sides the
    parent's anchor if the centroids are alike, else its own; a thin folder inherits under a library root only. Folders are as deep as paths, so levels are few."""
    c = ancestor_centroids(rows).select("node", "n", "centroid").withColumn("depth", F.size(F.split("node", "/"))).withColumn("up", parent("node"))
    up = c.select(F.col("node").alias("up"), F.col("n").alias("pn"), F.col("centroid").alias("pc"))
    like = F.round(dot("centroid", "pc"), 6)
    both = (F.col("n") >= ANCHOR_ROWS) & (F.col("pn") >= ANCHOR_ROWS)
    inherits = F.when(F.col("depth") <= 2, F.lit(False)).when(both, like >= ANCHOR_COSINE).otherwise(~root("node").isin(external))
    links = c.join(up, "up", "left").select("node", "n", "depth", "up", F.coalesce(inherits, F.lit(False)).alias("inherits"))
    deepest = links.agg(F.max("depth")).first()[0] or 0
    done = links.where("depth <= 2").select("node", "n", F.col("node").alias("anchor"))
    for d in range(3, deepest + 1):
        here = links.where(F.col("depth") == d).join(done.select(F.col("node").alias("up"), F.col("anchor").alias("above")), "up", "left")
        done = done.unionByName(here.select("node", "n", F.when(F.col("inherits"), F.coalesce("above", "node")).otherwise(F.col("node")).alias("anchor")))
    return done


def folder_directions(rows: DataFrame, least: int = 2) -> DataFrame:
    """(node, n, exponent, direction): unit difference of a folder's mean from its parent's, for folders of enough rows whose difference isn't nothing."""
    c = ancestor_centroids(rows).where(F.col("n") >= least).withColumn("up", parent("node"))
    up = c.select(F.col("node").alias("up"), F.col("centroid").alias("pc"))
    d = c.join(up, "up").withColumn("d", F.expr("zip_with(centroid, pc, (x, y) -> x - y)")).withColumn("len", norm("d")).where("len > 1e-6")
    return d.select("node", "n", (F.size(F.split("node", "/")) - 1).alias("exponent"), F.expr("transform(d, x -> x / greatest(len, 1e-6D))").alias("direction"))


def thin_folders(rows: DataFrame, least: int = 2) -> DataFrame:
    """(node, name, n, exponent): folders below a root with fewer rows than a direction needs; their names stand in for them."""
    n = rows.select(F.explode(ancestors("folder")).alias("node")).groupBy("node").agg(F.count("*").alias("n"))
    return n.where((F.col("n") < least) & F.col("node").contains("/")).select("node", F.substring_index("node", "/", -1).alias("name"), "n", (F.size(F.split("node", "/")) - 1).alias("exponent"))


def folder_components(rows: DataFrame, directions: DataFrame, least: int = COMPONENT_ROWS, most: int = COMPONENTS, ratio: float = SECOND_SHARE) -> DataFrame:
    """(node, n, exponent, component, direction): how the unit rows of a folder of enough rows vary at right angles to the folder's own direction.

    At most so many components; a later one counts only if its singular value reaches the ratio of the first. Tasks add up sums of products by folder, these are added up over
    ancestors entry by entry (so no folder, not even a root, is one task's work), and the eigen-step runs on batches of dim x dim matrices. The greatest loading of a component is positive.
    """
    u = unit(rows, "vec", "u").select("folder", "u")

    def add(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            folders, x = b.column(0).to_pylist(), np.array(b.column(1).to_pylist(), dtype=np.float64)
            for name in sorted(set(folders)):
                own = x[[f == name for f in folders]]
                part = np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
                sums[name] = sums[name] + part if name in sums else part
            if len(sums) > 64:
                yield _told(sums)
                sums = {}
        if sums:
            yield _told(sums)

    parts = u.where("folder IS NOT NULL").mapInArrow(add, "folder string, m array<double>").select("folder", F.posexplode("m").alias("i", "x")).groupBy("folder", "i").agg(F.sum("x").alias("x"))
    entries = parts.select(F.explode(ancestors("folder")).alias("node"), "i", "x").groupBy("node", "i").agg(F.sum("x").alias("x"))
    enough = entries.where(f"i = 0 AND x >= {least}").select("node")
    whole = entries.join(enough, "node", "left_semi").groupBy("node").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("m"))
    whole = whole.join(directions.select("node", "exponent", "direction"), "node")

    def turn(batches):
        for b in batches:
            out = ([], [], [], [], [])
            for node, m, exponent, direction in zip(*(c.to_pylist() for c in b.columns), strict=True):
                d = np.array(direction)
                n, mean, product = m[0], np.array(m[1 : len(d) + 1]) / m[0], np.array(m[len(d) + 1 :]).reshape(len(d), len(d))
                across = np.eye(len(d)) - np.outer(d, d)
                values, vectors = np.linalg.eigh(across @ (product - n * np.outer(mean, mean)) @ across)
                s = np.sqrt(np.maximum(values[::-1], 0))
                for k in range(min(most, len(d))):
                    if s[0] < 1e-6 or (k and s[k] < ratio * s[0]):
                        break
                    v = across @ vectors[:, -1 - k]
                    v /= np.linalg.norm(v)
                    for c, value in zip(out, (node, int(n), exponent, k + 1, (v * np.sign(v[np.abs(v).argmax()])).tolist()), strict=True):
                        c.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.float64())), strict=True)], ["node", "n", "exponent", "component", "direction"])

    return whole.mapInArrow(turn, "node string, n long, exponent int, component int, direction array<double>")


def _told(sums: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], ["folder", "m"])


def reweight(rows: DataFrame, directions: DataFrame, boost: float, depth_boost: float) -> DataFrame:
    """vec + sum over directions of w (vec . t) t with w = depth_boost^exponent boost, that is vec (I + sum w t t'): tasks add up the matrix, whatever the number of directions, and it is broadcast."""
    d = directions.select((F.lit(float(boost)) * F.pow(F.lit(float(depth_boost)), "exponent")).alias("w"), "direction")

    def add(batches):
        total = None
        for b in batches:
            if b.num_rows:
                t = matrix(b.column(1))
                part = (t * np.array(b.column(0).to_pylist())[:, None]).T @ t
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["m"])

    cells = d.mapInArrow(add, "m array<double>").select(F.posexplode("m").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()
    if not cells:
        return rows
    size = round(len(cells) ** 0.5)
    moved = project(rows, np.zeros(size), np.eye(size) + np.array([c["x"] for c in cells]).reshape(size, size), "__moved")
    return moved.withColumn("vec", F.col("__moved")).drop("__moved")


def incremental(rows: DataFrame, layout: DataFrame, refit_share: float = 0.3) -> tuple[str, DataFrame, DataFrame]:
    """(place or refit, rows with coordinates, new rows); refit when new rows exceed the share of the fitted ones."""
    known, new = rows.join(layout, "id", "left_semi"), rows.join(layout, "id", "left_anti")
    fitted = layout.count()
    return ("refit" if new.count() > refit_share * fitted else "place"), known, new


def region_layout(base: DataFrame, other: DataFrame, cx: float, cy: float, half: float, *, disc: bool = False) -> DataFrame:
    """Rows of a region take the other layout's coordinates, scaled to fill the box, or bent onto the disc."""
    inside = base.where(F.col("x").between(cx - half, cx + half) & F.col("y").between(cy - half, cy + half)).select("id")
    moved = other.join(inside, "id", "left_semi")
    lo_x, hi_x, lo_y, hi_y = moved.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    unit = lambda c, lo, hi: 2 * (F.col(c) - F.lit(lo)) / F.lit((hi - lo) or 1.0 if lo is not None else 1.0) - 1
    uv = moved.select("id", unit("x", lo_x, hi_x).alias("u"), unit("y", lo_y, hi_y).alias("v"))
    x, y = (F.col("u") * F.sqrt(1 - F.col("v") * F.col("v") / 2), F.col("v") * F.sqrt(1 - F.col("u") * F.col("u") / 2)) if disc else (F.col("u"), F.col("v"))
    return uv.select("id", (cx + half * x).alias("x"), (cy + half * y).alias("y"))


