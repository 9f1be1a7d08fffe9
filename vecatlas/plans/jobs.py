"""Supervised runs, weight sensitivity, head-on fits and whole jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecatlas.functions.udf import embedded, payload
from vecatlas.operators import gather as g
from vecatlas.operators import layout as lay
from vecatlas.operators import sensitivity as se
from vecatlas.operators import supervised as su
from vecatlas.operators import whole_jobs as wj
from vecatlas.plans.book import Book
from vecatlas.plans.layout import marked
from vecatlas.plans.scoring import labelled, rows
from vecatlas.sources.scratch import folder, stash

book = Book()
TAU = 0.5


def gathered(t):
    """Items with a unit column per source, one row per id."""
    return g.gather(t.items.where("fingerprint IS NOT NULL"), t.features)


def moves(t):
    """(id, x, y, s, dx, dy) of the landmark layout that is fitted to layout_a, at the library's weights."""
    both, used = gathered(t)
    both = stash(both.select("id", *used), "sources")
    marks = lay.among(both, marked(t))
    for s in used:
        both = lay.landmark_distances(both.withColumn("vec", F.col(s)), marks.select("id", F.col(s).alias("vec"))).withColumnRenamed("delta", f"delta_{s}").drop("vec", s)
    at = stash(lay.affinities(se.weighted_delta(both, used, g.WEIGHTS), TAU), "affinities")
    return se.without_gauge(se.derivatives(at, used, lay.landmark_map(at, t.layout_a), TAU))


@book.query()
def m9_weight_sensitivity(t):
    return moves(t)


@book.query()
def m10_weight_preview(t):
    return se.preview(stash(moves(t), "moves"), {"main": 0.1, "text": -0.05})


@book.query("SELECT id, round(cos(0.7) * x - sin(0.7) * y + 3, 5) AS x, round(sin(0.7) * x + cos(0.7) * y - 1, 5) AS y, round(CAST(embedding[3] AS DOUBLE) - avg(CAST(embedding[3] AS DOUBLE)) FILTER (WHERE id % 4 <> 0) OVER (), 5) AS z FROM layout_a JOIN embeddings ON vec_id = id")
def m13_head_on(t):
    cloud = t.layout_a.join(t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding")[2].cast("double").alias("z")), "id")
    return se.head_on(cloud, t.layout_b).select("id", *(F.round(c, 5).alias(c) for c in "xyz"))


@book.query()
def m17_projection(t):
    known = labelled(t).where("class >= 0")
    return su.projected(labelled(t), *su.fit(known, dims=16)).select("id", "class", "vec")


@book.query()
def m18_train_and_score(t):
    both, used = gathered(t)
    run = su.train(both, used, g.WEIGHTS, t.segments, folder(t.spark, "runs"))
    return t.spark.read.parquet(f"{run['path']}/predictions")


@book.query()
def r7_score_missing(t):
    """A run that is fitted without every tenth row scores these."""
    both, used = gathered(t)
    new = F.pmod(F.xxhash64("fingerprint"), F.lit(10)) == 0
    run = su.train(both.where(~new), used, g.WEIGHTS, t.segments, folder(t.spark, "runs"))
    return su.score_missing(both.where(new), used, g.WEIGHTS, run["path"])


@book.query()
def m21_clustering_job(t):
    return wj.cluster(rows(t).select("id", "vec"), folder(t.spark, "clusters"))[1]


@book.query()
def a20_levels(t):
    return wj.levels_of(wj.cluster(rows(t).select("id", "vec"), folder(t.spark, "clusters"))[1])


@book.query()
def m22_layout_job(t):
    return wj.layout(rows(t), folder(t.spark, "layouts"), boost=0.5, depth_boost=0.8, reference=t.layout_b)[1]


@book.query()
def m23_warm_up(t):
    lenses = {"whole": (rows(t), {}), "folders": (rows(t), {"method": "linear", "boost": 0.5})}
    return wj.warm_up(lenses, folder(t.spark, "layouts"))


@book.query("SELECT vec_id AS id, len(text)::DOUBLE AS chars, len(regexp_replace(text, '[^ ]', '', 'g'))::DOUBLE AS blanks FROM (SELECT doc_id AS vec_id, text FROM documents)")
def v2_injected_encoder(t):
    docs = t.documents.select(F.col("doc_id").cast("long").alias("id"), "text")
    e = embedded(docs, lambda texts: [(len(x), x.count(" ")) for x in texts], "text")
    return e.select("id", F.col("vec")[0].alias("chars"), F.col("vec")[1].alias("blanks"))


@book.query("SELECT id, path, concat('/', folder) AS place, round(60 + 140 * tempo_norm) AS bpm FROM items LEFT JOIN item_features6 USING (fingerprint)")
def v3_injected_display(t):
    bpm = lambda d: F.round(60 + 140 * d["tempo_norm"])
    place = lambda d: F.concat(F.lit("/"), d["folder"])
    return payload(t.items, t.item_features6, display={"place": place, "bpm": bpm}).select("id", "path", "place", "bpm")
