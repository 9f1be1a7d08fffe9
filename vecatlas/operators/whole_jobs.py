"""Clustering and layout from vectors to stored tables. Results lie under their revision, a digest of rows and parameters, so a job that is done isn't run again."""

from __future__ import annotations

import hashlib
import json
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecatlas.operators.graph import bridged, communities
from vecatlas.operators.layout import affinities, align, landmark_distances, landmark_map, landmarks, normalise, pca, place
from vecatlas.operators.plans_and_moves import folder_directions, reweight
from vecatlas.operators.search import edges, knn
from vecatlas.operators.store import signature
from vecatlas.sources.scratch import stash


def revision(rows: DataFrame, parameters: dict, columns: tuple[str, ...] = ()) -> str:
    """Digest of a job's rows (id, vec and the further columns that it reads) and its parameters."""
    of = signature(rows.select("id", F.sha2(F.concat_ws(",", F.transform("vec", lambda x: x.cast("string"))), 256).alias("v"), *columns), ["id", "v", *columns]).first()[0]
    return hashlib.sha256(f"{of}|{json.dumps(parameters, sort_keys=True)}".encode()).hexdigest()[:32]


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """A table that an earlier job has published, or None: its manifest is written after it, and must tell the rows that are there."""
    try:
        told = spark.read.schema("rows long").parquet(f"{path}.done").first()
        table = spark.read.parquet(path)
    except AnalysisException:  # no such folder, or a job that was cut off before its manifest
        return None
    return table if told is not None and table.count() == told["rows"] else None


def publish(df: DataFrame, path: str) -> DataFrame:
    """Write a table, then its manifest. What a job leaves that is cut off in between is written anew by the next one."""
    df.write.mode("overwrite").parquet(path)
    spark = df.sparkSession
    table = spark.read.parquet(path)
    table.agg(F.count("*").alias("rows")).coalesce(1).write.mode("overwrite").parquet(f"{path}.done")
    return table


def cluster(rows: DataFrame, out: str, *, dims: int = 16, k: int = 10, resolutions: tuple[float, ...] = (0.5, 1.0, 2.0)) -> tuple[str, DataFrame]:
    """(revision, (resolution, id, community)): communities of the kNN graph of the reduced rows (id, vec), made one by bridges, at each resolution."""
    spark = rows.sparkSession
    name = revision(rows, {"job": "cluster", "dims": dims, "k": k, "resolutions": resolutions, "bridges": "all", "levels": "all"})
    path = f"{out}/{name}"
    if (done := stored(spark, path)) is not None:
        return name, done
    reduced = stash(pca(rows.select("id", "vec"), dims).select("id", F.col("reduced").alias("vec")), "reduced")
    graph = stash(bridged(edges(knn(reduced, k)), reduced), "graph")
    with ThreadPoolExecutor(len(resolutions)) as side:  # independent chains of jobs, so one's small rounds don't wait for another's
        found = list(side.map(lambda gamma: communities(graph, gamma, levels=None), resolutions))
    level = lambda gamma, df: df.select(F.lit(float(gamma)).alias("resolution"), F.col("v").alias("id"), "community")
    levels = reduce(DataFrame.unionByName, map(level, resolutions, found))
    return name, publish(levels, path)


def levels_of(levels: DataFrame) -> DataFrame:
    """(resolution, communities, least, greatest): number and sizes of the communities at each resolution."""
    return levels.groupBy("resolution", "community").agg(F.count("*").alias("n")).groupBy("resolution").agg(F.count("*").alias("communities"), F.min("n").alias("least"), F.max("n").alias("greatest"))


def membership(levels: DataFrame, item: int) -> DataFrame:
    """(resolution, community, n): the communities of one item over the levels, with their sizes."""
    here = levels.where(F.col("id") == item).select("resolution", "community")
    return levels.join(F.broadcast(here), ["resolution", "community"]).groupBy("resolution", "community").agg(F.count("*").alias("n"))  # a row per resolution


def layout(rows: DataFrame, out: str, *, method: str = "landmark", marks: int = 64, dims: int = 16, boost: float = 0.0, depth_boost: float = 1.0, tau: float = 0.5, reference: DataFrame | None = None, lens: str = "") -> tuple[str, DataFrame]:
    """(revision, (id, x, y)): rows (id, folder, vec) drawn along their folders' directions by boost, reduced, mapped linearly or by landmarks, turned onto the reference (id, x, y), and brought to 0..1."""
    spark = rows.sparkSession
    name = layout_revision(rows, method=method, marks=marks, dims=dims, boost=boost, depth_boost=depth_boost, tau=tau, lens=lens, reference=reference)
    path = f"{out}/{name}"
    if (done := stored(spark, path)) is not None:
        return name, done
    drawn = reweight(rows, folder_directions(rows), boost, depth_boost) if boost else rows
    reduced = stash(pca(drawn.select("id", "vec"), dims).select("id", F.col("reduced").alias("vec")), "reduced")
    flat = lambda df: df.select("id", F.col("vec")[0].alias("x"), F.coalesce(F.get("vec", F.lit(1)), F.lit(0.0)).alias("y"))
    if method == "linear":
        placed = flat(reduced)
    else:
        chosen = stash(landmarks(reduced, marks), "marks")
        near = affinities(landmark_distances(reduced, chosen), tau)
        known = flat(chosen)
        placed = place(near, known, landmark_map(near, known))
    placed = stash(placed, "placed")
    turned = placed if reference is None else align(placed, reference)
    return name, publish(normalise(turned), path)


def layout_revision(rows: DataFrame, *, reference: DataFrame | None = None, **parameters) -> str:
    """The revision that layout stores its result under."""
    met = "" if reference is None else signature(reference.select("id", "x", "y"), ["id", "x", "y"]).first()[0]
    return revision(rows, {"job": "layout", "reference": met, **parameters}, ("folder",) if parameters.get("boost") else ())


DEFAULTS = {"method": "landmark", "marks": 64, "dims": 16, "boost": 0.0, "depth_boost": 1.0, "tau": 0.5, "reference": None}


def warm_up(lenses: dict[str, tuple[DataFrame, dict]], out: str) -> DataFrame:
    """(lens, revision, ran): each lens (name -> rows and parameters of layout) gets its layout, unless its current revision is stored already."""
    spark, told = None, []
    for name, (rows, given) in sorted(lenses.items()):
        spark, parameters = rows.sparkSession, {**DEFAULTS, **given, "lens": name}
        fresh = stored(spark, f"{out}/{layout_revision(rows, **parameters)}") is None
        told.append((name, layout(rows, out, **parameters)[0], fresh))
    if spark is None:
        raise ValueError("no lens")
    return spark.createDataFrame(told, "lens string, revision string, ran boolean")
