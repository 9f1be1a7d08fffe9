"""Retrieval reports, predictions by centroid and cohort building."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecatlas.functions.paths import ancestors
from vecatlas.functions.vectors import dot, unit
from vecatlas.operators.retrieval import View, ranked
from vecatlas.sources.scratch import stash


def neighbours(rows: DataFrame, k: int, *, exclude_related: bool = False) -> DataFrame:
    """(id, other, score, rank, ql, nl) of each row's k nearest; with exclude_related, those of the row's own known artist or release are no candidates."""
    mode = "unrelated" if exclude_related else "all"
    return ranked(rows, [View("vec", "raw", {"vec": 1.0})], k, modes=(mode,)).drop("recipe", "geometry", "mode")


def precision(ranked: DataFrame) -> DataFrame:
    """One row: micro and macro precision, queries, least and greatest number of neighbours."""
    per = ranked.groupBy("id", "ql").agg(F.sum((F.col("ql") == F.col("nl")).cast("int")).alias("hits"), F.count("*").alias("k"))
    label = per.groupBy("ql").agg(F.sum("hits").alias("hits"), F.sum("k").alias("ks"), F.avg(F.col("hits") / F.col("k")).alias("p"), F.count("*").alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi"))
    return label.agg(F.round(F.sum("hits") / F.sum("ks"), 6).alias("micro"), F.round(F.avg("p"), 6).alias("macro"), F.sum("n").alias("queries"), F.min("lo").alias("k_min"), F.max("hi").alias("k_max"))


def confusion(ranked: DataFrame) -> DataFrame:
    pairs = ranked.groupBy("ql", "nl").agg(F.count("*").alias("n"))
    return pairs.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("ql")), 6))


def centroids(rows: DataFrame, label: str = "class") -> DataFrame:
    """(class, n, centroid): unit mean of the rows' vectors. Sums are partial per dimension, so a large class costs no task more than its width."""
    sums = rows.select(label, F.posexplode("vec").alias("d", "x")).groupBy(label, "d").agg(F.avg("x").alias("m"), F.count("*").alias("n"))
    means = sums.groupBy(label).agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("d", "m"))), lambda s: s["m"]).alias("c"))
    return unit(means, "c", "centroid").drop("c")


CLASSES = 4096  # centroids of a block


def assign(rows: DataFrame, cents: DataFrame, label: str = "class") -> DataFrame:
    """rows with (pred, sim): the most alike centroid, the least class on ties; rows of no or another width than the centroids have none and are left out.

    Centroids reach the tasks in blocks of CLASSES, one matrix product per batch, so pairs of row and class never arise as rows. Beyond one block the best so far is written between blocks.
    """
    kind = cents.schema[label].dataType.simpleString()
    table = cents.select(F.col(label).alias("pred"), "centroid").where("pred IS NOT NULL AND centroid IS NOT NULL").orderBy("pred")
    out = rows.withColumn("pred", F.lit(None).cast(kind)).withColumn("sim", F.lit(None).cast("double"))
    block = table.limit(CLASSES).collect()
    while block:
        out = _better(out, [r["pred"] for r in block], np.array([r["centroid"] for r in block], dtype=np.float64))
        if len(block) < CLASSES:
            break
        out, block = stash(out, "assigned"), table.where(F.col("pred") > F.lit(block[-1]["pred"])).limit(CLASSES).collect()
    return out.where("pred IS NOT NULL")


def _better(df: DataFrame, names: list, grid: np.ndarray) -> DataFrame:
    """df with pred and sim where one of the centroids is more alike than what is there. Names ascend."""
    width = grid.shape[1]

    def run(batches):
        for b in batches:
            vecs = b.column(b.schema.get_field_index("vec")).to_pylist()
            fits = np.array([v is not None and len(v) == width for v in vecs], dtype=bool)
            x = np.array([v if ok else [0.0] * width for v, ok in zip(vecs, fits, strict=True)], dtype=np.float64).reshape(len(vecs), width)
            sims = np.round(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9) @ grid.T, 6)
            at = sims.argmax(axis=1)
            top, had = sims[np.arange(len(vecs)), at], b.column(b.schema.get_field_index("sim")).to_pylist()
            pred = b.column(b.schema.get_field_index("pred"))
            wins = [bool(ok) and t == t and (h is None or t > h) for ok, t, h in zip(fits, top, had, strict=True)]
            new = {"pred": pa.array([names[i] if w else p for i, w, p in zip(at, wins, pred.to_pylist(), strict=True)], pred.type), "sim": pa.array([float(t) if w else h for t, w, h in zip(top, wins, had, strict=True)], pa.float64())}
            yield pa.RecordBatch.from_arrays([new.get(n, c) for n, c in zip(b.schema.names, b.columns, strict=True)], b.schema.names)

    return df.mapInArrow(run, df.schema)


def floors(rows: DataFrame, cents: DataFrame, percentile: float = 0.05, label: str = "class") -> DataFrame:
    """(class, floor): interpolated percentile of the rows' likeness to their own centroid; -2 for a class without rows."""
    u = unit(rows, "vec", "u").select(label, "u")
    own = u.join(F.broadcast(cents.select(label, "centroid")), label).groupBy(label).agg(F.round(F.percentile(F.round(dot("u", "centroid"), 6), percentile), 6).alias("floor"))
    return cents.select(label).join(own, label, "left").na.fill(-2.0, ["floor"])


def matched(pred: DataFrame, floor: DataFrame) -> DataFrame:
    """Predictions with a flag for those that clear their class's floor."""
    return pred.join(F.broadcast(floor.withColumnRenamed("class", "pred")), "pred", "left").withColumn("is_match", (F.col("pred") >= 0) & F.coalesce(F.col("sim") >= F.col("floor"), F.lit(True)))


def ancestor_centroids(rows: DataFrame) -> DataFrame:
    """(node, n, centroid) of every folder and those above it, from unit rows."""
    u = unit(rows, "vec", "u").select("folder", F.posexplode("u").alias("d", "x"))
    leaf = u.groupBy("folder", "d").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    node = leaf.select(F.explode(ancestors("folder")).alias("node"), "d", "s", "n").groupBy("node", "d").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    sums = node.groupBy("node").agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("d", "s"))), lambda v: v["s"]).alias("c"))
    return unit(sums, "c", "centroid").drop("c")


def dispersion(segments: DataFrame, alpha: float = 2.0, spanning: float = 0.25) -> DataFrame:
    """Per fingerprint 1 - mean cosine over pairs of segments, from the sum of the unit vectors, so no pairs arise."""
    u = unit(segments, "vec", "u").select("fingerprint", "seg", F.posexplode("u").alias("d", "x"))
    dims = u.groupBy("fingerprint", "d").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count("*").alias("m"))
    all_ = dims.groupBy("fingerprint").agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum("q").alias("q"), F.max("m").alias("m"))
    mean = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("ss") - F.col("q")) / (F.col("m") * (F.col("m") - 1))))
    out = all_.withColumn("dispersion", F.round(F.when(F.col("m") >= 2, 1 - mean), 6))
    return out.select("fingerprint", "dispersion", F.round(F.when(F.col("dispersion").isNull(), 1.0).otherwise(F.exp(-alpha * F.col("dispersion"))), 6).alias("confidence"), F.coalesce(F.col("dispersion") >= spanning, F.lit(False)).alias("is_spanning"))


def dedup(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row (the least path) per fingerprint; fingerprints under several labels are returned apart and dropped."""
    per = items.where("fingerprint IS NOT NULL").groupBy("fingerprint").agg(F.min("path").alias("path"), F.countDistinct("label").alias("labels"))
    return items.join(per.where("labels = 1").select("fingerprint", "path"), ["fingerprint", "path"], "left_semi"), per.where("labels > 1").select("fingerprint", "labels")


def windows(duration: str):
    """Excerpts of 30 s: the whole when short, the middle up to 45 s, else three; null for no duration."""
    d = F.col(duration)
    make = lambda s, n: F.struct(F.round(s, 6).alias("start"), F.round(n, 6).alias("duration"))
    three = F.array(*(make(F.greatest(F.lit(0.0), F.least(d - 30, d * c - 15)), F.lit(30.0)) for c in (0.2, 0.5, 0.8)))
    return F.when(d.isNull() | F.isnan(d) | (d <= 0), None).when(d <= 30, F.array(make(F.lit(0.0), d))).when(d <= 45, F.array(make((d - 30) / 2, F.lit(30.0)))).otherwise(three)


def largest_remainder(df: DataFrame, budget: int, fraction: str, order: str) -> DataFrame:
    """budget split over the rows (few: one per level) by inverse root of their fraction: one each, the rest by share, remainders to the largest fractional part."""
    w = df.withColumn("__w", 1 / F.sqrt(fraction))
    total = w.agg(F.sum("__w").alias("t"), F.count("*").alias("n")).first()
    share = w.withColumn("__s", F.lit(budget - total["n"]) * F.col("__w") / F.lit(total["t"])).withColumn("__f", F.floor("__s"))
    left = budget - total["n"] - share.agg(F.sum("__f")).first()[0]
    ranked = share.withColumn("__r", F.row_number().over(Window.orderBy(F.desc(F.round(F.col("__s") - F.col("__f"), 9)), order)))
    return ranked.withColumn("allocated", (1 + F.col("__f") + (F.col("__r") <= left).cast("int")).cast("long")).drop("__w", "__s", "__f", "__r")


def concentration(ranked: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: for artist and release, the mean share of neighbours that have the query's own, over queries where it is known; how many these are, and which share of all."""
    meta = rows.select("id", *(F.nullif(F.col(c), F.lit("")).alias(c) for c in ("artist", "release")))
    q, o = meta.alias("q"), meta.toDF("other", "artist", "release").alias("o")
    both = ranked.select("id", "other").join(q, "id").join(o, "other")
    same = lambda c: F.avg(F.coalesce(F.col(f"q.{c}") == F.col(f"o.{c}"), F.lit(False)).cast("int"))
    per = both.groupBy("id").agg(*(f for c in ("artist", "release") for f in (same(c).alias(f"s_{c}"), (F.count(f"q.{c}") > 0).alias(f"k_{c}"))))
    told = lambda c: (F.round(F.avg(F.when(F.col(f"k_{c}"), F.col(f"s_{c}"))), 6).alias(f"{c}_share"), F.count_if(F.col(f"k_{c}")).alias(f"{c}_queries"), F.round(F.count_if(F.col(f"k_{c}")) / F.count("*"), 6).alias(f"{c}_coverage"))
    return per.agg(*told("artist"), *told("release"))


def compared(a: DataFrame, b: DataFrame, label: str = "class") -> DataFrame:
    """(class, side, cosine, mean_cosine): the classes of two models by who has them, the cosine of shared classes' centroids, and its mean on every row. Models of other widths give no cosine."""
    both = a.select(label, F.col("centroid").alias("x")).join(b.select(label, F.col("centroid").alias("y")), label, "full")
    side = F.when(F.col("y").isNull(), "left").when(F.col("x").isNull(), "right").otherwise("both")
    out = both.select(label, side.alias("side"), F.when(F.size("x") == F.size("y"), F.round(dot("x", "y"), 6)).alias("cosine"))
    mean = out.agg(F.round(F.avg("cosine"), 6)).first()[0]
    return out.withColumn("mean_cosine", F.lit(mean).cast("double"))


def key_groups(rows: DataFrame, column: str, reach: int) -> DataFrame:
    """rows with centre: again and again the most common fifth left (the lowest of equals) takes all that are left within so many steps of the wheel. Only 12 counts reach the driver."""
    left = {r[column]: r["count"] for r in rows.where(F.col(column).isNotNull()).groupBy(column).count().collect()}
    centre: dict[int, int] = {}
    while left:
        c = min(left, key=lambda k: (-left[k], k))
        for k in [k for k in left if min((k - c) % 12, (c - k) % 12) <= reach]:
            centre[k] = c
            del left[k]
    if not centre:
        return rows.withColumn("centre", F.lit(None).cast("int"))
    return rows.withColumn("centre", F.create_map(*(F.lit(x) for kv in sorted(centre.items()) for x in kv))[F.col(column)])


def balanced(rows: DataFrame, limit: int, dev: float = 0.7, seed: int = 11) -> DataFrame:
    """(id, label, split, turn) of at most limit rows: in each turn every label that has rows left gives one, from the split that its share so far asks for, or the other if that is used up.

    The turn of a label's i-th row of a split follows from i, the share and the two splits' sizes, so it is a column and needs no loop over rows.
    """
    w = Window.partitionBy("label", "split").orderBy(F.xxhash64("id", F.lit(seed)), "id")
    sizes = rows.groupBy("label").agg(F.count_if(F.col("split") == "dev").alias("n_dev"), F.count("*").alias("n"))
    at = rows.withColumn("i", F.row_number().over(w)).where(F.col("i") <= limit).join(sizes, "label")
    # as long as both splits last, dev's i-th row comes in turn floor((i - 1) / dev) + 1 and the other's i-th in ceil(i / (1 - dev)); one used up leaves the rest of the turns to the other
    n_out = F.col("n") - F.col("n_dev")
    free = F.when(F.col("split") == "dev", F.floor((F.col("i") - 1) / dev + 1e-9) + 1).otherwise(F.ceil(F.col("i") / (1 - dev) - 1e-9))
    crowd = F.when(F.col("split") == "dev", F.col("i") + n_out).otherwise(F.col("i") + F.col("n_dev"))
    turn = F.least(free, crowd)
    return at.select("id", "label", "split", turn.cast("int").alias("turn")).orderBy("turn", F.xxhash64("label", F.lit(seed)), "label", "id").limit(limit)
