"""Composites and searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecatlas.operators import gather as g
from vecatlas.operators import search as s
from vecatlas.operators.listed import knn_listed
from vecatlas.plans.book import Book, Tables

book = Book()
QUERY_ID, K = 5, 10

_F = "(SELECT fingerprint, vec FROM features WHERE version = 2 AND len(vec) > 0 AND source = '{}')"
GATHERED = f"""g AS (SELECT i.id, i.path, i.folder, i.label, i.artist, i.release, m.vec AS main, l.vec AS logits, coalesce(r.vec, [0 FOR z IN range(14)]) AS rhythm, coalesce(t.vec, [0 FOR z IN range(8)]) AS text
  FROM items i JOIN {_F.format('main')} m USING (fingerprint) JOIN {_F.format('logits')} l USING (fingerprint) LEFT JOIN {_F.format('rhythm')} r USING (fingerprint) LEFT JOIN {_F.format('text')} t USING (fingerprint))"""
_LONG = " UNION ALL ".join(f"SELECT id, '{n}' AS source, {w}::DOUBLE AS w, {o} + generate_subscripts({n}, 1) AS d, unnest({n})::DOUBLE AS x FROM g" for n, w, o in (("main", 0.4, 0), ("logits", 0.25, 32), ("rhythm", 0.2, 42), ("text", 0.15, 56)))
STANDARD = f"""{GATHERED}, lng AS ({_LONG}),
st AS (SELECT d, avg(x) AS mu, CASE WHEN stddev_pop(x) < 1e-9 THEN 1 ELSE stddev_pop(x) END AS sd FROM lng GROUP BY d),
z AS (SELECT id, source, w, d, (x - mu) / sd AS z FROM lng JOIN st USING (d)),
nn AS (SELECT id, source, greatest(sqrt(sum(z * z)), 1e-9) AS n FROM z GROUP BY ALL),
c AS (SELECT id, d, z / n * sqrt(w) AS v FROM z JOIN nn USING (id, source)),
cn AS (SELECT id, greatest(sqrt(sum(v * v)), 1e-12) AS n FROM c GROUP BY id)"""
PLAIN = f"""{GATHERED}, lng AS ({_LONG}),
nn AS (SELECT id, source, greatest(sqrt(sum(x * x)), 1e-9) AS n FROM lng GROUP BY ALL),
c AS (SELECT id, d, x / n * sqrt(w) AS v FROM lng JOIN nn USING (id, source)),
cn AS (SELECT id, greatest(sqrt(sum(v * v)), 1e-9) AS n FROM c GROUP BY id)"""


def composite(t: Tables, standard: bool = True):
    rows, used = g.gather(t.items, t.features)
    return g.composite(rows, used, standard=standard)


def _similar(order: str) -> str:
    return f"""WITH {STANDARD}, q AS (SELECT d, v / n AS v FROM c JOIN cn USING (id) WHERE id = {QUERY_ID})
SELECT g.id, g.path, round(sum(c.v / cn.n * q.v), 6) AS score FROM c JOIN q USING (d) JOIN cn ON cn.id = c.id JOIN g ON g.id = c.id WHERE c.id <> {QUERY_ID} GROUP BY g.id, g.path ORDER BY score {order}, path LIMIT {K}"""


@book.query(_similar("DESC"))
def t1_similar_near(t):
    return s.similar(composite(t), QUERY_ID, K)


@book.query(_similar("ASC"))
def t1_similar_far(t):
    return s.similar(composite(t), QUERY_ID, K, "far")


@book.query(f"WITH {GATHERED} SELECT id, len(main) + len(logits) + len(rhythm) + len(text) AS width, round(list_sum(main)::DOUBLE, 4) AS s_main, round(list_sum(rhythm)::DOUBLE, 4) AS s_rhythm, round(list_sum(text)::DOUBLE, 4) AS s_text FROM g")
def j1_gather(t):
    rows, used = g.gather(t.items, t.features)
    total = lambda c: F.round(F.expr(f"aggregate({c}, CAST(0 AS DOUBLE), (s, x) -> s + x)"), 4)
    return rows.select("id", sum((F.size(u) for u in used), F.lit(0)).cast("long").alias("width"), total("main").alias("s_main"), total("rhythm").alias("s_rhythm"), total("text").alias("s_text"))


@book.query(f"WITH {STANDARD} SELECT id, round(sum(v), 6) AS total, round(sum(v * v), 6) AS squares, round(sum(v * d), 5) AS moment FROM c GROUP BY id")
def a2_weighted_composite(t):
    return _sums(composite(t))


@book.query(f"WITH {PLAIN} SELECT id, round(sum(v), 6) AS total, round(sum(v * v), 6) AS squares, round(sum(v * d), 5) AS moment FROM c GROUP BY id")
def a3_stateless_composite(t):
    return _sums(composite(t, standard=False))


def _sums(df):
    fold = lambda e: F.expr(f"aggregate(transform(vec, (x, i) -> {e}), CAST(0 AS DOUBLE), (s, x) -> s + x)")
    return df.select("id", F.round(fold("x"), 6).alias("total"), F.round(fold("x * x"), 6).alias("squares"), F.round(fold("x * (i + 1)"), 5).alias("moment"))


@book.query("SELECT d, round(avg(x::DOUBLE), 6) AS mu, round(stddev_pop(x::DOUBLE), 6) AS sd FROM (SELECT generate_subscripts(vec, 1) - 1 AS d, unnest(vec) AS x FROM features WHERE version = 2 AND source = 'main') GROUP BY d")
def a1_column_statistics(t):
    mu, sd = g.statistics(g.read_features(t.features, "main"), ["vec"])["vec"]
    return t.spark.createDataFrame([(d, round(m, 6), round(v, 6)) for d, (m, v) in enumerate(zip(mu, sd, strict=True))], "d long, mu double, sd double")


KNN_SQL = """u AS (SELECT id, [x / greatest(sqrt(list_sum([y::DOUBLE * y FOR y IN vec])), 1e-9) FOR x IN vec::DOUBLE[]] AS u FROM v),
p AS (SELECT a.id, b.id AS other, round(list_dot_product(a.u, b.u), 6) AS score FROM u a JOIN u b ON a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, other) AS rank FROM p)"""


@book.query(f"WITH v AS (SELECT vec_id AS id, embedding AS vec FROM embeddings), {KNN_SQL} SELECT id, other, score, rank FROM r WHERE rank <= 5")
def j4_exact_knn(t):
    return s.knn(t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), 5)


@book.query(f"WITH v AS (SELECT vec_id AS id, embedding AS vec FROM embeddings), {KNN_SQL} SELECT id, other, score, rank FROM r WHERE rank <= 5")
def j4_listed_knn(t):
    """The same through the inverted index, which opens every list that can matter."""
    return knn_listed(t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), 5)[0]


@book.query(f"WITH v AS (SELECT vec_id AS id, embedding AS vec FROM embeddings), {KNN_SQL} SELECT least(id, other) AS src, greatest(id, other) AS dst, greatest(max(score), 0.0) AS weight FROM r WHERE rank <= 5 GROUP BY 1, 2")
def j5_knn_edges(t):
    return s.edges(j4_exact_knn(t))


@book.query(f"""WITH v AS (SELECT vec_id AS id, embedding AS vec, label FROM embeddings), {KNN_SQL.replace("b ON a.id <> b.id)", "b ON a.id <> b.id JOIN v va ON va.id = a.id JOIN v vb ON vb.id = b.id AND va.label <> vb.label)")}
SELECT DISTINCT least(id, other) AS a, greatest(id, other) AS b FROM r WHERE rank <= 3""")
def j7_hard_negatives(t):
    return s.hard_negatives(t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label"), "label", 3)


@book.query("""WITH q AS (SELECT embedding[1:16] AS q FROM embeddings WHERE vec_id = 7),
sc AS (SELECT fingerprint, seg, pos, CASE WHEN pos IS NOT NULL THEN round(list_dot_product(vec::DOUBLE[], q::DOUBLE[]) / greatest(sqrt(list_dot_product(vec::DOUBLE[], vec::DOUBLE[])) * sqrt(list_dot_product(q::DOUBLE[], q::DOUBLE[])), 1e-12), 6) END AS score FROM segments, q),
r AS (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY score DESC NULLS LAST, seg) AS rn FROM sc)
SELECT fingerprint, score, pos FROM r WHERE rn = 1 ORDER BY score DESC NULLS LAST, fingerprint LIMIT 50""")
def t2_best_segment(t):
    q = t.embeddings.where("vec_id = 7").select(F.slice("embedding", 1, 16).alias("q")).first()["q"]
    return s.best_segments(t.segments, q, 50)


_UNIT = "[x / greatest(sqrt(list_sum([y::DOUBLE * y FOR y IN {0}])), 1e-9) FOR x IN {0}::DOUBLE[]]"


@book.query(f"""WITH p AS (SELECT prompt_id, text, {_UNIT.format('vec')} AS u FROM prompts), v AS (SELECT vec_id AS id, {_UNIT.format('embedding[57:64]')} AS u FROM embeddings),
r AS (SELECT id, prompt_id, text, round(list_dot_product(v.u, p.u), 6) AS score, row_number() OVER (PARTITION BY id ORDER BY round(list_dot_product(v.u, p.u), 6) DESC, prompt_id) AS rank FROM v, p)
SELECT * FROM r WHERE rank <= 3 AND (rank = 1 OR score >= 0.35)""")
def t4_prompt_ranking(t):
    return s.rank_prompts(t.embeddings.select(F.col("vec_id").alias("id"), F.slice("embedding", 57, 8).alias("vec")), t.prompts, 3)


_T = "(1 / (1 + 0.2316419 * abs(z)))"
_TAIL = f"exp(-z * z / 2) / 2.5066282746310002 * ({_T} * (0.319381530 + {_T} * (-0.356563782 + {_T} * (1.781477937 + {_T} * (-1.821255978 + {_T} * 1.330274429)))))"


@book.query(f"""WITH d0 AS (SELECT axis_id, mean, std, reliability, unnest(pos_vec)::DOUBLE - unnest(neg_vec)::DOUBLE AS x, generate_subscripts(pos_vec, 1) AS k FROM axes),
d AS (SELECT *, x / greatest(sqrt(sum(x * x) OVER (PARTITION BY axis_id)), 1e-9) AS u FROM d0),
v AS (SELECT id, k, x / greatest(sqrt(sum(x * x) OVER (PARTITION BY id)), 1e-9) AS u FROM (SELECT vec_id AS id, unnest(embedding[57:64])::DOUBLE AS x, generate_subscripts(embedding[57:64], 1) AS k FROM embeddings)),
s AS (SELECT id, axis_id, reliability, (sum(v.u * d.u) - mean) / std AS z FROM v JOIN d USING (k) GROUP BY id, axis_id, reliability, mean, std),
f AS (SELECT id, axis_id, z, round(abs(z) * reliability, 4) AS strength, round(CASE WHEN z >= 0 THEN 1 - {_TAIL} ELSE {_TAIL} END, 4) AS percentile FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY strength DESC, axis_id) AS rank FROM f)
SELECT id, axis_id, round(z, 4) AS z, percentile, CASE WHEN percentile >= 0.5 THEN 'pos' ELSE 'neg' END AS pole, rank FROM r WHERE rank <= 6""")
def t5_axis_coordinates(t):
    return s.axis_coordinates(t.embeddings.select(F.col("vec_id").alias("id"), F.slice("embedding", 57, 8).alias("vec")), t.axes)


@book.query("""WITH l AS (SELECT fingerprint, unnest(vec)::DOUBLE AS x, generate_subscripts(vec, 1) - 1 AS style FROM features WHERE source = 'logits' AND version = 2),
r AS (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY x DESC, style) AS rank FROM l) SELECT fingerprint, rank, style, round(x, 6) AS score FROM r WHERE rank <= 3""")
def t6_top_styles(t):
    return s.top_styles(g.read_features(t.features, "logits"), "vec", 3)
