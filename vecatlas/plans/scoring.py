"""Retrieval reports, centroids, predictions, cohorts."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecatlas.operators import filters as f
from vecatlas.operators import scoring as sc
from vecatlas.plans.book import Book
from vecatlas.plans.search import KNN_SQL

book = Book()
_U = "[x / greatest(sqrt(list_sum([y::DOUBLE * y FOR y IN {0}])), 1e-9) FOR x IN {0}::DOUBLE[]]"
_ROWS = "w AS (SELECT i.id, i.label, i.artist, i.release, e.embedding AS vec FROM items i JOIN embeddings e ON e.vec_id = i.id)"
_NEAR = f"{_ROWS}, v AS (SELECT id, vec FROM w), {KNN_SQL}, n AS (SELECT r.id, rank, score, other, a.label AS ql, b.label AS nl FROM r JOIN w a ON a.id = r.id JOIN w b ON b.id = r.other WHERE rank <= 5)"
_UNRELATED = f"""{_ROWS}, v AS (SELECT id, vec FROM w), {KNN_SQL}, n0 AS (SELECT p.id, score, other, a.label AS ql, b.label AS nl FROM p JOIN w a ON a.id = p.id JOIN w b ON b.id = p.other
WHERE NOT coalesce(nullif(a.artist, '') = nullif(b.artist, ''), false) AND NOT coalesce(nullif(a.release, '') = nullif(b.release, ''), false)),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, other) AS rank FROM n0) WHERE rank <= 5)"""
_PREC = """q AS (SELECT id, ql, sum((ql = nl)::INT) AS hits, count(*) AS k FROM n GROUP BY id, ql), l AS (SELECT ql, sum(hits) AS hits, sum(k) AS ks, avg(hits / k) AS p, count(*) AS n, min(k) AS lo, max(k) AS hi FROM q GROUP BY ql)
SELECT round(sum(hits) / sum(ks), 6) AS micro, round(avg(p), 6) AS macro, CAST(sum(n) AS BIGINT) AS queries, min(lo) AS k_min, max(hi) AS k_max FROM l"""
_LAB = f"""cl AS (SELECT folder, row_number() OVER (ORDER BY folder) - 1 AS class FROM items GROUP BY folder HAVING count(*) >= 8),
w AS (SELECT i.id, coalesce(class, -1) AS class, e.embedding AS vec FROM items i JOIN embeddings e ON e.vec_id = i.id LEFT JOIN cl USING (folder)),
lx AS (SELECT class, unnest(vec)::DOUBLE AS x, generate_subscripts(vec, 1) AS d FROM w WHERE class >= 0), m AS (SELECT class, d, avg(x) AS m, count(*) AS n FROM lx GROUP BY class, d),
ce AS (SELECT class, max(n) AS n, list(m ORDER BY d) AS c FROM m GROUP BY class), cu AS (SELECT class, n, {_U.format('c')} AS c FROM ce),
sim AS (SELECT w.id, cu.class AS pred, w.class, round(list_dot_product({_U.format('w.vec')}, cu.c), 6) AS sim FROM w, cu),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, pred) AS rn FROM sim) WHERE rn = 1),
fl AS (SELECT class, round(quantile_cont(sim, 0.05), 6) AS floor FROM sim WHERE pred = class GROUP BY class)"""


def rows(t):
    return t.items.join(t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), "id")


def labelled(t):
    return f.class_labels(rows(t))


@book.query(f"WITH {_NEAR}, {_PREC}")
def a13_retrieval_precision(t):
    return sc.precision(sc.neighbours(rows(t), 5))


@book.query(f"WITH {_UNRELATED}, {_PREC}")
def j6_unrelated_precision(t):
    return sc.precision(sc.neighbours(rows(t), 5, exclude_related=True))


@book.query(f"WITH {_NEAR} SELECT ql, nl, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY ql), 6) AS share FROM n GROUP BY ql, nl")
def a14_confusion(t):
    return sc.confusion(sc.neighbours(rows(t), 5))


@book.query(f"WITH {_LAB} SELECT class, n, round(list_sum(c), 6) AS total, round(c[1], 6) AS first FROM cu")
def a5_class_centroids(t):
    c = sc.centroids(labelled(t).where("class >= 0"))
    return c.select(F.col("class").cast("long").alias("class"), "n", F.round(F.expr("aggregate(centroid, 0D, (s, x) -> s + x)"), 6).alias("total"), F.round(F.col("centroid")[0], 6).alias("first"))


@book.query(f"WITH {_LAB} SELECT id, pred, sim FROM best")
def j8_nearest_centroid(t):
    r = labelled(t)
    return sc.assign(r, sc.centroids(r.where("class >= 0"))).select("id", F.col("pred").cast("long").alias("pred"), "sim")


@book.query(f"WITH {_LAB} SELECT class, floor FROM fl")
def a8_class_floors(t):
    r = labelled(t).where("class >= 0")
    return sc.floors(r, sc.centroids(r)).select(F.col("class").cast("long").alias("class"), "floor")


@book.query(f"WITH {_LAB} SELECT id, pred, sim, sim >= floor AS is_match FROM best JOIN fl ON fl.class = best.pred")
def m19_predictions(t):
    r = labelled(t)
    c = sc.centroids(r.where("class >= 0"))
    return sc.matched(sc.assign(r, c), sc.floors(r.where("class >= 0"), c)).select("id", F.col("pred").cast("long").alias("pred"), "sim", "is_match")


@book.query(f"""WITH w AS (SELECT i.folder, {_U.format('e.embedding')} AS u FROM items i JOIN embeddings e ON e.vec_id = i.id),
a AS (SELECT unnest([array_to_string(string_split(folder, '/')[1:i], '/') FOR i IN range(1, len(string_split(folder, '/')) + 1)]) AS node, u FROM w),
lx AS (SELECT node, unnest(u) AS x, generate_subscripts(u, 1) AS d FROM a), s AS (SELECT node, d, sum(x) AS s, count(*) AS n FROM lx GROUP BY node, d), q AS (SELECT node, sqrt(sum(s * s)) AS q FROM s GROUP BY node)
SELECT node, n, round(s / q, 6) AS first FROM s JOIN q USING (node) WHERE d = 1""")
def a6_ancestor_centroids(t):
    return sc.ancestor_centroids(rows(t)).select("node", "n", F.round(F.col("centroid")[0], 6).alias("first"))


@book.query(f"""WITH u AS (SELECT fingerprint, seg, {_U.format('vec')} AS u FROM segments), p AS (SELECT a.fingerprint, 1 - greatest(-1, least(1, avg(list_dot_product(a.u, b.u)))) AS d FROM u a JOIN u b ON a.fingerprint = b.fingerprint AND a.seg <> b.seg GROUP BY a.fingerprint)
SELECT fingerprint, round(d, 6) AS dispersion, round(exp(-2 * round(d, 6)), 6) AS confidence, round(d, 6) >= 0.25 AS is_spanning FROM p""")
def a23_excerpt_dispersion(t):
    return sc.dispersion(t.segments)


@book.query("""SELECT id, w.start AS start, w.duration AS duration FROM (SELECT vec_id AS id, unnest(CASE WHEN d <= 0 THEN [] WHEN d <= 30 THEN [{'start': 0.0::DOUBLE, 'duration': d}] WHEN d <= 45 THEN [{'start': (d - 30) / 2, 'duration': 30.0::DOUBLE}]
ELSE [{'start': round(greatest(0, least(d - 30, d * 0.2 - 15)), 6), 'duration': 30.0::DOUBLE}, {'start': round(greatest(0, least(d - 30, d * 0.5 - 15)), 6), 'duration': 30.0::DOUBLE}, {'start': round(greatest(0, least(d - 30, d * 0.8 - 15)), 6), 'duration': 30.0::DOUBLE}] END) AS w
FROM (SELECT vec_id, (vec_id % 120)::DOUBLE AS d FROM embeddings))""")
def w11_excerpt_windows(t):
    d = t.embeddings.select(F.col("vec_id").alias("id"), (F.col("vec_id") % 120).cast("double").alias("d"))
    return d.select("id", F.explode(sc.windows("d")).alias("w")).select("id", "w.start", "w.duration")


@book.query("""WITH l AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label), w AS (SELECT label, 90 * (1 / sqrt(n)) / sum(1 / sqrt(n)) OVER () AS s FROM l),
r AS (SELECT label, floor(s) AS f, row_number() OVER (ORDER BY round(s - floor(s), 9) DESC, label) AS rk, 90 - sum(floor(s)) OVER () AS extra FROM w) SELECT label, CAST(1 + f + (rk <= extra)::INT AS BIGINT) AS allocated FROM r""")
def w10_budget_split(t):
    sizes = t.embeddings.groupBy("label").agg(F.count("*").alias("n"))
    return sc.largest_remainder(sizes, 90 + sizes.count(), "n", "label").select("label", "allocated")


@book.query("SELECT id FROM (SELECT id, row_number() OVER (ORDER BY md5(concat('7', CAST(id AS VARCHAR))), id) AS rn FROM items) WHERE rn <= 100")
def w7_nested_sample(t):
    return t.items.select("id", F.md5(F.concat(F.lit("7"), F.col("id").cast("string")).cast("binary")).alias("h")).orderBy("h", "id").limit(100).select("id")
