"""Layouts, landmarks, graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecatlas.operators import graph as gr
from vecatlas.operators import layout as lay
from vecatlas.operators import search as s
from vecatlas.plans.book import Book
from vecatlas.plans.search import KNN_SQL

book = Book()
_V = "v AS (SELECT vec_id AS id, embedding AS vec FROM embeddings)"
_EDGES = f"{_V}, {KNN_SQL}, e AS (SELECT least(id, other) AS src, greatest(id, other) AS dst, greatest(max(score), 0.0) AS weight FROM r WHERE rank <= 5 GROUP BY 1, 2)"


def vectors(t):
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def marked(t):
    """(id): a representative of each label, as a landmark."""
    return lay.representatives(t.embeddings.select(F.col("vec_id").alias("id"), "label"), "label")


def named(ids):
    """The landmark's id by its place ``at`` among the landmarks."""
    return F.element_at(F.array(*(F.lit(r["id"]).cast("long") for r in ids.orderBy("id").collect())), F.col("at") + 1)


@book.query("SELECT a.id, round(a.x, 6) AS x, round(b.x, 6) AS bx FROM layout_a a JOIN layout_b b USING (id)")
def j9_matched_layouts(t):
    return t.layout_a.join(t.layout_b.select("id", F.col("x").alias("bx")), "id").select("id", F.round("x", 6).alias("x"), F.round("bx", 6).alias("bx"))


@book.query("SELECT id, round(x, 5) AS x, round(y, 5) AS y FROM (SELECT id, cos(0.7) * x - sin(0.7) * y + 3 AS x, sin(0.7) * x + cos(0.7) * y - 1 AS y FROM layout_a)")
def m12_procrustes(t):
    return lay.align(t.layout_a, t.layout_b).select("id", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


@book.query("SELECT 'x' AS axis, 3.0 AS c0, round(cos(0.7), 5) AS c1, round(-sin(0.7), 5) AS c2 UNION ALL SELECT 'y', -1.0, round(sin(0.7), 5), round(cos(0.7), 5)")
def m14_affine_map(t):
    c = lay.affine_map(t.layout_a, t.layout_b)
    return t.spark.createDataFrame([(a, *(round(float(v), 5) for v in c[:, i])) for i, a in enumerate("xy")], "axis string, c0 double, c1 double, c2 double")


@book.query("SELECT id, round((x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()), 6) AS x, round((y - min(y) OVER ()) / (max(y) OVER () - min(y) OVER ()), 6) AS y FROM layout_a")
def a25_extent(t):
    return lay.normalise(t.layout_a).select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@book.query("""WITH c AS (SELECT avg(x) AS cx, avg(y) AS cy FROM layout_a), d AS (SELECT x, y, cx, cy, round(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)), 9) AS d FROM layout_a, c), r AS (SELECT quantile_disc(d, 0.8) AS r FROM d)
SELECT round(any_value(cx), 6) AS cx, round(any_value(cy), 6) AS cy, round(any_value(r), 6) AS r, round(min(x), 6) AS lo_x, round(max(x), 6) AS hi_x, round(min(y), 6) AS lo_y, round(max(y), 6) AS hi_y FROM d, r WHERE d <= r""")
def a33_p80_disc(t):
    return lay.p80_disc(t.layout_a)


_LM = "l AS (SELECT vec_id AS lid, unnest(embedding)::DOUBLE AS y, generate_subscripts(embedding, 1) AS k FROM embeddings WHERE vec_id IN (SELECT min(vec_id) FROM embeddings WHERE label IS NOT NULL GROUP BY label)), x AS (SELECT vec_id AS id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS k FROM embeddings), dl AS (SELECT id, lid, sum((x - y) * (x - y)) AS d FROM x JOIN l USING (k) GROUP BY id, lid)"


@book.query(f"WITH {_LM} SELECT id, lid, round(d, 5) AS delta FROM dl")
def j12_landmark_distances(t):
    ids = marked(t)
    out = lay.landmark_distances(vectors(t), lay.among(vectors(t), ids))
    return out.select("id", F.posexplode("delta").alias("at", "d")).select("id", named(ids).alias("lid"), F.round("d", 5).alias("delta"))


@book.query(f"WITH {_LM} SELECT id, lid, round(exp(-d / 0.5) / sum(exp(-d / 0.5)) OVER (PARTITION BY id), 5) AS affinity FROM dl")
def m7_landmark_affinities(t):
    ids = marked(t)
    out = lay.affinities(lay.landmark_distances(vectors(t), lay.among(vectors(t), ids)), 0.5)
    return out.select("id", F.posexplode("affinity").alias("at", "a")).select("id", named(ids).alias("lid"), F.round("a", 5).alias("affinity"))


@book.query()
def m8_landmark_layout(t):
    marks = lay.landmarks(vectors(t), 32)
    rows = lay.affinities(lay.landmark_distances(vectors(t), marks), 0.5)
    known = t.layout_a.where("id % 5 <> 0")
    return lay.place(rows, known, lay.landmark_map(rows, known))


@book.query()
def m6_landmarks(t):
    return lay.landmarks(vectors(t), 32).select("id")


@book.query()
def m1_pca(t):
    return lay.pca(vectors(t), 8).select("id", "reduced")


@book.query()
def m2_pca_dev(t):
    return lay.pca(vectors(t), 8, vectors(t).where("id % 10 < 7")).select("id", "reduced")


@book.query("""WITH RECURSIVE b AS (SELECT vec_id AS a, (vec_id * 7) % (SELECT count(*) FROM embeddings) AS b FROM embeddings WHERE vec_id % 3 = 0), u AS (SELECT a, b FROM b WHERE a <> b UNION SELECT b, a FROM b WHERE a <> b),
r(v, w) AS (SELECT a, a FROM u UNION SELECT r.v, u.b FROM r JOIN u ON u.a = r.w) SELECT v, min(w) AS label FROM r GROUP BY v""")
def u4_components(t):
    n = t.embeddings.count()
    return gr.components(t.embeddings.where("vec_id % 3 = 0").select(F.col("vec_id").alias("a"), (F.col("vec_id") * 7 % n).alias("b")))


@book.query(f"""WITH {_EDGES}, m AS (SELECT vec_id AS v, label AS c FROM embeddings), w AS (SELECT sum(weight) AS m FROM e),
x AS (SELECT a.c AS ca, b.c AS cb, weight FROM e JOIN m a ON a.v = src JOIN m b ON b.v = dst), d AS (SELECT c, sum(weight) AS k FROM (SELECT ca AS c, weight FROM x UNION ALL SELECT cb, weight FROM x) GROUP BY c),
i AS (SELECT ca AS c, sum(weight) AS n FROM x WHERE ca = cb GROUP BY ca) SELECT round(sum(coalesce(n, 0) / w.m - (k / (2 * w.m)) * (k / (2 * w.m))), 6) AS modularity FROM d LEFT JOIN i USING (c), w""")
def a22_modularity(t):
    return gr.modularity(s.edges(s.knn(vectors(t), 5)), t.embeddings.select(F.col("vec_id").alias("v"), F.col("label").alias("community")))


@book.query()
def m3_bridged(t):
    return gr.bridged(s.edges(s.knn(vectors(t), 2)), vectors(t))


@book.query()
def m4_communities(t):
    return gr.communities(s.edges(s.knn(vectors(t), 10)))


@book.query("SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def a20_cluster_sizes(t):
    return t.embeddings.groupBy("label").agg(F.count("*").alias("n"))


@book.query("""WITH l AS (SELECT fingerprint, unnest(vec)::DOUBLE AS x, generate_subscripts(vec, 1) - 1 AS style FROM features WHERE source = 'logits' AND version = 2), v AS (SELECT concat('fp', CAST(vec_id AS VARCHAR(20))) AS fingerprint, label FROM embeddings),
a AS (SELECT style, avg(x) AS m FROM l GROUP BY style), c AS (SELECT label AS community, style, round(avg(x) - any_value(m), 6) AS lift FROM l JOIN v USING (fingerprint) JOIN a USING (style) GROUP BY label, style),
r AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY lift DESC, style) AS rank FROM c)
SELECT community, string_agg(CASE WHEN rank <= 2 THEN CAST(style AS VARCHAR) END, ' / ' ORDER BY rank) AS name FROM r WHERE rank <= 3 GROUP BY community""")
def a21_cluster_names(t):
    styles = t.features.where("source = 'logits' AND version = 2").select(F.col("fingerprint").alias("v"), F.posexplode("vec").alias("style", "score")).withColumn("score", F.col("score").cast("double"))
    return gr.cluster_names(t.embeddings.select(F.expr("concat('fp', vec_id)").alias("v"), F.col("label").alias("community")), styles).select("community", "name")


@book.query(f"""WITH {_V}, {KNN_SQL}, hi AS (SELECT id, other FROM r WHERE rank <= 10),
lp AS (SELECT a.id, b.id AS other, row_number() OVER (PARTITION BY a.id ORDER BY round(list_dot_product(a.u, b.u), 6) DESC, b.id) AS rank FROM (SELECT vec_id AS id, {"[x / greatest(sqrt(list_sum([y::DOUBLE * y FOR y IN embedding[1:8]])), 1e-9) FOR x IN embedding[1:8]::DOUBLE[]]"} AS u FROM embeddings) a JOIN (SELECT vec_id AS id, {"[x / greatest(sqrt(list_sum([y::DOUBLE * y FOR y IN embedding[1:8]])), 1e-9) FOR x IN embedding[1:8]::DOUBLE[]]"} AS u FROM embeddings) b ON a.id <> b.id)
SELECT round(count(*) / (10.0 * (SELECT count(*) FROM embeddings)), 6) AS recall FROM hi JOIN lp USING (id, other) WHERE lp.rank <= 10""")
def a17_neighbourhood_recall(t):
    high = s.knn(vectors(t), 10).select("id", "other")
    low = s.knn(t.embeddings.select(F.col("vec_id").alias("id"), F.slice("embedding", 1, 8).alias("vec")), 10).select("id", "other")
    n = t.embeddings.count()
    return high.join(low, ["id", "other"]).agg(F.round(F.count("*") / F.lit(10.0 * n), 6).alias("recall"))
