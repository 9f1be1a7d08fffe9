"""Nearest neighbours through an inverted index: rows are listed under coarse centroids, and a search opens only the lists that can hold something better."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecatlas.functions.vectors import unit
from vecatlas.operators.search import NUMBERS, ROWS, best_columns, matrix
from vecatlas.sources.scratch import stash

MOST_LISTS, SAMPLE = 4096, 50_000
BLOCK = 65_536  # rows of a box at most
SLICE = 1024  # rows that meet all centroids at once
PAIRS = "id long, other long, score double"


def coarse(sample: np.ndarray, lists: int, rounds: int = 10) -> np.ndarray:
    """Unit centroids of a bounded sample of unit rows, by k-means on the sphere; started from rows that lie evenly in it."""
    centre = sample[np.linspace(0, len(sample) - 1, min(lists, len(sample))).astype(int)].copy()
    for _ in range(rounds):
        own = np.concatenate([(sample[lo : lo + SLICE] @ centre.T).argmax(axis=1) for lo in range(0, len(sample), SLICE)])
        sums = np.zeros_like(centre)
        np.add.at(sums, own, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centre = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), centre)
    return centre


def boxes(told: dict[int, int], most: int) -> dict[int, list[int]]:
    """The boxes of each list: small lists share one, a list of more than most rows is dealt to several."""
    out, box, filled = {}, 0, 0
    for name, n in sorted(told.items()):
        parts = max(1, -(-n // most))
        if filled and (parts > 1 or filled + n > most):
            box, filled = box + 1, 0
        out[name] = list(range(box, box + parts))
        box, filled = (box + parts, 0) if parts > 1 else (box, filled + n)
    return out


def _met(asked: DataFrame, members: DataFrame, pairs: set[tuple[int, int]], k: int) -> DataFrame:
    """The k best members for each asked row (id, vec, least, a, b, lists) among the given lists of box b, from its least score on; pairs are those of a and b that occur."""
    spark = members.sparkSession
    met = F.broadcast(spark.createDataFrame(sorted(pairs), "a int, b int"))  # a row per pair of boxes
    right = members.withColumnRenamed("box", "b").join(met, "b").select("a", "b", "id", "vec", F.lit(None).cast("double").alias("least"), F.array("list").alias("lists"), F.lit(1).alias("side"))

    def nearest(key, table):
        side = np.array(table["side"])
        q, d = table.filter(pa.array(side == 0)), table.filter(pa.array(side == 1)).sort_by("id")
        out = []
        if q.num_rows and d.num_rows:
            of = matrix(d["lists"])[:, 0].astype(int)
            order = np.argsort(of, kind="stable")
            of, di, dv, qi, qv = of[order], np.array(d["id"])[order], matrix(d["vec"])[order], np.array(q["id"]), matrix(q["vec"])
            least = np.nan_to_num(np.array(q["least"].to_pylist(), dtype=np.float64), nan=-np.inf)
            flat = q["lists"].combine_chunks()
            wants, rows = flat.flatten().to_numpy(), np.repeat(np.arange(len(qi)), flat.value_lengths().to_numpy())
            for name in np.unique(of):
                first, end = np.searchsorted(of, [name, name + 1])
                here, some, open_ = dv[first:end], di[first:end], rows[wants == name]
                for lo in range(0, len(open_), ROWS):
                    r = open_[lo : lo + ROWS]
                    x = qv[r]
                    [(i, j, v)] = best_columns(lambda f, e: x @ here[f:e].T, len(r), len(some), k, [lambda i, j: qi[r[i]] == some[j]], least[r])  # noqa: B023
                    out.append((qi[r[i]], some[j], v))
        arrays = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0)] * 3
        if len(arrays[0]):  # k of all lists together
            order = np.lexsort((arrays[1], -arrays[2], arrays[0]))
            i, j, v = (c[order] for c in arrays)
            arrays = [c[np.arange(len(i)) - np.searchsorted(i, i) < k] for c in (i, j, v)]
        return pa.table([pa.array(a, t) for a, t in zip(arrays, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["id", "other", "score"])

    return asked.select("a", "b", "id", "vec", "least", "lists", F.lit(0).alias("side")).unionByName(right).groupBy("a", "b").applyInArrow(nearest, PAIRS)


def knn_listed(df: DataFrame, k: int, *, lists: int | None = None, probes: int | None = None, seed: int = 7) -> tuple[DataFrame, float]:
    """((id, other, score, rank), share): the k most alike other rows by cosine of vec, ties by least id, and which share of all pairs was compared.

    Centroids come from at most SAMPLE rows (by hash of the id); every row is listed under its nearest one. A row first meets its own list. Its k-th score there, and the
    angle between the farthest member of a list and its centroid, tell which other lists can hold a better row: the angle to a member is at least the angle to the
    centroid less that radius. Without ``probes`` all of these are opened, so the result is that of the exact search; with it, only the nearest of them, up to so many lists in all, so it may miss some.
    Lists lie in boxes of bounded size, and so do the rows that ask; a row goes once to each box in which it opens a list, and nothing is compared outside its lists. How much is saved depends on how well the rows fall into groups.
    """
    spark = df.sparkSession
    base = stash(unit(df, "vec", "vec").select("id", "vec"), "unit-rows")
    n, width = base.agg(F.count("*"), F.max(F.size("vec"))).first()
    lists = min(MOST_LISTS, lists or max(1, round(n**0.5)))
    drawn = base.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(SAMPLE).select("vec").toArrow()
    if not n:
        return base.select("id", F.col("id").alias("other"), F.lit(0.0).alias("score"), F.lit(1).alias("rank")), 0.0
    centre = spark.sparkContext.broadcast(coarse(matrix(drawn["vec"]), lists))
    slices = lambda batches: (b.slice(lo, SLICE) for b in batches for lo in range(0, b.num_rows, SLICE))

    def listed(batches):
        for b in slices(batches):
            s = matrix(b.column(1)) @ centre.value.T
            at = s.argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at.astype(np.int32)), pa.array(s[np.arange(len(at)), at])], ["id", "vec", "list", "cosine"])

    members = stash(base.mapInArrow(listed, "id long, vec array<double>, list int, cosine double"), "listed")
    told = members.groupBy("list").agg(F.count("*").alias("n"), F.min("cosine").alias("least")).collect()  # MOST_LISTS rows at most
    sizes, radius = np.zeros(len(centre.value)), np.full(len(centre.value), -np.inf)
    for r in told:
        sizes[r["list"]], radius[r["list"]] = r["n"], np.arccos(np.clip(r["least"], -1, 1))
    side = max(1, round(int(spark.conf.get("spark.sql.shuffle.partitions")) ** 0.5))
    where = boxes({r["list"]: r["n"] for r in told}, max(1, min(BLOCK, NUMBERS // max(1, width), -(-n // side))))
    own = F.broadcast(spark.createDataFrame(sorted(where.items()), "list int, boxes array<int>"))  # a row per list
    box = F.element_at("boxes", F.pmod(F.xxhash64("id"), F.size("boxes")).cast("int") + 1)
    members = stash(members.join(own, "list").select("id", "vec", "list", box.alias("box")), "boxed")
    nearby = members.join(own, "list").select("id", "vec", F.lit(None).cast("double").alias("least"), F.col("box").alias("a"), F.explode("boxes").alias("b"), F.array("list").alias("lists"))
    first = stash(_met(nearby, members, {(a, b) for all_ in where.values() for a in all_ for b in all_}, k), "own-list")
    floor = first.groupBy("id").agg(F.try_element_at(F.sort_array(F.collect_list("score"), asc=False), F.lit(k)).alias("least"))  # k scores of each box
    known = spark.sparkContext.broadcast(radius)

    def opens(b) -> np.ndarray:
        angle = np.arccos(np.clip(matrix(b.column(1)) @ centre.value.T, -1, 1))
        own, least = np.array(b.column(2)), np.array([-2.0 if v is None else v for v in b.column(4).to_pylist()])
        can = np.cos(np.maximum(0.0, angle - known.value)) >= least[:, None] - 1e-5  # scores are rounded
        can &= np.isfinite(known.value)[None, :]
        can[np.arange(len(own)), own] = False
        if probes is not None:
            order = np.argsort(np.argsort(np.where(can, angle, np.inf), axis=1, kind="stable"), axis=1)
            can &= order < probes - 1
        return can

    def counted(batches):
        for b in slices(batches):
            i, j = np.nonzero(opens(b))
            at, n = np.unique(np.stack([np.array(b.column(3))[i], j]), axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(at[0].astype(np.int32)), pa.array(at[1].astype(np.int32)), pa.array(n)], ["box", "list", "n"])

    def opened(batches):
        for b in slices(batches):
            can = opens(b)
            for name, inside in lying.items():
                rows, of = np.nonzero(can[:, inside])
                if len(rows):
                    at, n = np.unique(rows, return_counts=True)
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(np.array(inside, dtype=np.int32)[of]))
                    take = lambda c, at=at: b.column(c).take(pa.array(at))  # noqa: E731, B023
                    yield pa.RecordBatch.from_arrays([take(0), take(1), take(4), take(3), pa.array(np.full(len(at), name, dtype=np.int32)), lists], ["id", "vec", "least", "a", "b", "lists"])

    lying: dict[int, list[int]] = {}
    for name, all_ in sorted(where.items()):
        for b in all_:
            lying.setdefault(b, []).append(name)
    asking = stash(members.join(floor, "id", "left").select("id", "vec", "list", "box", "least"), "asking")
    open_ = asking.mapInArrow(counted, "box int, list int, n long").groupBy("box", "list").agg(F.sum("n").alias("n")).collect()  # a row per box and list
    compared = float((sizes * sizes).sum()) + sum(r["n"] * sizes[r["list"]] for r in open_)
    asked = asking.mapInArrow(opened, "id long, vec array<double>, least double, a int, b int, lists array<int>")
    both = first.unionByName(_met(asked, members, {(r["box"], b) for r in open_ for b in where[r["list"]]}, k))
    w = Window.partitionBy("id").orderBy(F.desc("score"), "other")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k), float(compared / (n * n))
