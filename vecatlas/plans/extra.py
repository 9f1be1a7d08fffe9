"""Reports, ids and simple layouts."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from vecatlas.operators import gather as g
from vecatlas.operators import layout as lay
from vecatlas.operators import scoring as sc
from vecatlas.operators import search as s
from vecatlas.operators import store as st
from vecatlas.plans.book import Book
from vecatlas.plans.layout import marked, vectors
from vecatlas.plans.scoring import _NEAR, rows
from vecatlas.plans.search import PLAIN

book = Book()


@book.query(f"WITH {PLAIN} SELECT id, max(n) AS n, round(sum(v * v), 6) AS squares FROM (SELECT c.id, c.v, count(*) OVER (PARTITION BY c.id) AS n FROM c) GROUP BY id")
def j2_projection_composite(t):
    both, used = g.gather(t.items, t.features)
    vec = g.composite(both, used, standard=False)
    return vec.select("id", F.size("vec").cast("long").alias("n"), F.round(F.expr("aggregate(vec, 0D, (a, x) -> a + x * x)"), 6).alias("squares"))


@book.query(f"WITH {_NEAR} SELECT id AS query, ql AS label, rank, other AS neighbour, nl AS neighbour_label, score AS cosine FROM n")
def s21_neighbour_report(t):
    return sc.neighbours(rows(t), 5).select(F.col("id").alias("query"), F.col("ql").alias("label"), "rank", F.col("other").alias("neighbour"), F.col("nl").alias("neighbour_label"), F.col("score").alias("cosine"))


@book.query("SELECT revision, count(*) AS n FROM (SELECT id, id % 4 AS revision, x, y FROM layout_a) l JOIN (SELECT id % 4 AS revision, count(*) AS n_rows FROM layout_a WHERE id % 4 <> 3 GROUP BY 1) m USING (revision) GROUP BY revision, n_rows HAVING count(*) = n_rows AND bool_and(isfinite(x) AND isfinite(y))")
def s25_artefact_gate(t):
    stored = t.layout_a.withColumn("revision", F.col("id") % 4)
    manifest = stored.where("revision <> 3").groupBy("revision").agg(F.count("*").alias("n_rows"))
    fine = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    return stored.join(manifest, "revision").groupBy("revision", "n_rows").agg(F.count("*").alias("n"), F.bool_and(fine("x") & fine("y")).alias("fine")).where("fine AND n = n_rows").select("revision", "n")


@book.query("SELECT count(*) FILTER (WHERE b.id IS NOT NULL) AS loaded, count(*) FILTER (WHERE b.id IS NULL) AS unavailable FROM layout_a a LEFT JOIN layout_b b USING (id)")
def f14_universe(t):
    marked = t.layout_a.select("id").join(t.layout_b.select("id", F.lit(1).alias("b")), "id", "left")
    return marked.agg(F.count("b").alias("loaded"), F.count_if(F.col("b").isNull()).alias("unavailable"))


@book.query("SELECT label AS map, count(*) FILTER (WHERE id % 3 = 0) AS rated, count(*) AS total FROM items GROUP BY label")
def a28_ratings(t):
    return t.items.groupBy(F.col("label").alias("map")).agg(F.count_if(F.col("id") % 3 == 0).alias("rated"), F.count("*").alias("total"))


@book.query("""SELECT sha256(concat_ws('|', signature, 'logits=0.25,main=0.4,rhythm=0.2,text=0.15')) AS revision FROM (SELECT sha256(concat_ws('|', CAST(count(*) AS VARCHAR), CAST(sum(('0x' || substr(h, 1, 15))::BIGINT) AS VARCHAR), CAST(sum(('0x' || substr(h, 16, 15))::BIGINT) AS VARCHAR), CAST(sum(('0x' || substr(h, 31, 15))::BIGINT) AS VARCHAR), CAST(sum(('0x' || substr(h, 46, 15))::BIGINT) AS VARCHAR))) AS signature FROM (SELECT sha256(concat_ws('|', coalesce(CAST(source AS VARCHAR), '~'), coalesce(CAST(fingerprint AS VARCHAR), '~'), coalesce(CAST(version AS VARCHAR), '~'))) AS h FROM features))""")
def a29_revision_digest(t):
    """The digest of rows, weights (6 significant digits) and versions; the order of rows doesn't matter."""
    config = ",".join(f"{k}={v:.6g}" for k, v in sorted(g.WEIGHTS.items()))
    return st.signature(t.features.select("source", "fingerprint", "version"), ["source", "fingerprint", "version"]).select(F.sha2(F.concat_ws("|", "signature", F.lit(config)), 256).alias("revision"))


@book.query("""WITH q AS (SELECT embedding[1:16] AS q FROM embeddings WHERE vec_id = 7), sc AS (SELECT fingerprint, max(round(list_dot_product(vec::DOUBLE[], q::DOUBLE[]) / greatest(sqrt(list_dot_product(vec::DOUBLE[], vec::DOUBLE[])) * sqrt(list_dot_product(q::DOUBLE[], q::DOUBLE[])), 1e-12), 6)) AS score FROM segments, q WHERE pos IS NOT NULL GROUP BY fingerprint),
l AS (SELECT * FROM sc WHERE fingerprint IN (SELECT concat('fp', CAST(min(vec_id) AS VARCHAR)) FROM embeddings WHERE label IS NOT NULL GROUP BY label)), m AS (SELECT min(score) AS lo, max(score) AS hi FROM l)
SELECT fingerprint, score, round(0.05 + 0.35 * ((score - lo) / (hi - lo)) * ((score - lo) / (hi - lo)), 5) AS strength FROM l, m""")
def t3_search_field(t):
    q = t.embeddings.where("vec_id = 7").select(F.slice("embedding", 1, 16).alias("q")).first()["q"]
    some = marked(t).select(F.concat(F.lit("fp"), F.col("id").cast("string")).alias("fingerprint"))
    scored = s.best_segments(t.segments.join(F.broadcast(some), "fingerprint", "left_semi"), q, 128).where("score IS NOT NULL")
    lo, hi = scored.agg(F.min("score"), F.max("score")).first()
    w = (F.col("score") - F.lit(lo)) / F.lit((hi - lo) or 1.0)
    return scored.select("fingerprint", "score", F.round(0.05 + 0.35 * w * w, 5).alias("strength"))


@book.query("SELECT DISTINCT folder, regexp_replace(lower(folder), '[^a-z0-9]+', '-', 'g') || '-' || substr(sha1(folder), 1, 6) AS safe_id FROM items")
def x4_safe_ids(t):
    return t.items.select("folder").distinct().select("folder", F.concat_ws("-", F.regexp_replace(F.lower("folder"), "[^a-z0-9]+", "-"), F.substring(F.sha1("folder"), 1, 6)).alias("safe_id"))


# How well each step of the scale fits a major and a minor key.
_MAJOR = [6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88]
_MINOR = [6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17]


def _profiles() -> list[tuple[int, int, int, float]]:
    """(mode, key, bin, standardised value) of the 24 turned profiles."""
    out = []
    for mode, p in ((1, _MAJOR), (0, _MINOR)):
        m = sum(p) / 12
        d = math.sqrt(sum((x - m) ** 2 for x in p))
        out += [(mode, k, (i + k) % 12, (p[i] - m) / d) for k in range(12) for i in range(12)]
    return out


_VALUES = ", ".join(f"({m}, {k}, {b}, {v!r}::DOUBLE)" for m, k, b, v in _profiles())


@book.query(f"""WITH p(mode, key, bin, v) AS (VALUES {_VALUES}), c AS (SELECT vec_id AS id, generate_subscripts(embedding[1:12], 1) - 1 AS bin, unnest(embedding[1:12])::DOUBLE AS x FROM embeddings), z AS (SELECT id, bin, x - avg(x) OVER (PARTITION BY id) AS x FROM c), q AS (SELECT id, sqrt(sum(x * x)) AS q FROM z GROUP BY id),
r AS (SELECT z.id, mode, key, round(sum(x * v) / any_value(q), 6) AS r FROM z JOIN p USING (bin) JOIN q USING (id) GROUP BY z.id, mode, key), b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY r DESC, mode DESC, key) AS rn FROM r) SELECT id, mode, key, r AS fit FROM b WHERE rn = 1""")
def x8_key_from_chroma(t):
    p = t.spark.createDataFrame(_profiles(), "mode int, key int, bin int, v double")
    c = t.embeddings.select(F.col("vec_id").alias("id"), F.posexplode(F.slice("embedding", 1, 12)).alias("bin", "x"))
    z = c.withColumn("x", F.col("x").cast("double") - F.avg(F.col("x").cast("double")).over(Window.partitionBy("id")))
    sums = z.withColumn("q", F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("id")))).join(F.broadcast(p), "bin").groupBy("id", "mode", "key").agg(F.round(F.sum(F.col("x") * F.col("v")) / F.first("q"), 6).alias("fit"))
    best = F.max(F.struct("fit", "mode", (-F.col("key")).alias("back"))).alias("b")
    return sums.groupBy("id").agg(best).select("id", F.col("b.mode").alias("mode"), (-F.col("b.back")).alias("key"), F.col("b.fit").alias("fit"))


@book.query()
def m11_linear_layout(t):
    flat = lay.pca(vectors(t), 2).select("id", F.col("reduced")[0].alias("x"), F.col("reduced")[1].alias("y"))
    return lay.align(flat, t.layout_b, least=2, scale=False)


@book.query()
def m5_fallback_clusters(t):
    """Cosine k-means with as many clusters as the resolution asks for."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n, resolution = t.embeddings.count(), 0.8
    k = int(min(max(round(resolution * 12), 2), max(2, n // 4)))
    feats = vectors(t).select("id", array_to_vector(F.transform("vec", lambda x: x.cast("double"))).alias("features"))
    return KMeans(k=k, seed=1, distanceMeasure="cosine", maxIter=10).fit(feats).transform(feats).select("id", F.col("prediction").alias("cluster"))
