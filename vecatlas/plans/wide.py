"""Concentration, whole vectors, gates and scalar helpers."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from vecatlas.functions.vectors import dot, normal_cdf, unit
from vecatlas.operators import gather as g
from vecatlas.operators import graph as gr
from vecatlas.operators import plans_and_moves as pm
from vecatlas.operators import scoring as sc
from vecatlas.operators import search as s
from vecatlas.operators.filters import axis_value
from vecatlas.plans.book import Book
from vecatlas.plans.layout import vectors
from vecatlas.plans.scoring import _LAB, _NEAR, labelled, rows
from vecatlas.plans.search import KNN_SQL, PLAIN

book = Book()


def _share(what: str) -> str:
    return f"round(avg(s_{what}) FILTER (WHERE k_{what}), 6) AS {what}_share, count(*) FILTER (WHERE k_{what}) AS {what}_queries, round(count(*) FILTER (WHERE k_{what}) / count(*), 6) AS {what}_coverage"


def _one(what: str) -> str:
    return f"avg(coalesce((nullif(a.{what}, '') = nullif(b.{what}, ''))::INT, 0)) AS s_{what}, any_value(nullif(a.{what}, '')) IS NOT NULL AS k_{what}"


@book.query(f"WITH {_NEAR}, per AS (SELECT n.id, {_one('artist')}, {_one('release')} FROM n JOIN w a ON a.id = n.id JOIN w b ON b.id = n.other GROUP BY n.id) SELECT {_share('artist')}, {_share('release')} FROM per")
def a15_related_concentration(t):
    r = rows(t)
    return sc.concentration(sc.neighbours(r, 5), r)


@book.query(f"WITH v AS (SELECT vec_id AS id, embedding AS vec FROM embeddings), {KNN_SQL} SELECT id, CAST(rank AS INT) AS rank, other, score FROM r WHERE rank <= 7")
def w1_top_k(t):
    return s.knn(vectors(t), 7).select("id", F.col("rank").cast("int").alias("rank"), "other", "score")


@book.query("SELECT i.id, coalesce(f.tempo_norm, g.value, 0.5) AS value FROM items i LEFT JOIN item_features6 f ON f.fingerprint = i.fingerprint AND i.id % 2 = 0 LEFT JOIN (SELECT path, value FROM tags WHERE tag = 'mood') g ON g.path = i.path")
def f2_axis_value(t):
    known = t.item_features6.select("fingerprint", "tempo_norm")
    tag = t.tags.where("tag = 'mood'").select("path", F.col("value").alias("mood"))
    both = t.items.join(known, "fingerprint", "left").join(tag, "path", "left")
    return both.withColumn("tempo_norm", F.when(F.col("id") % 2 == 0, F.col("tempo_norm"))).select("id", axis_value("tempo_norm", "mood").alias("value"))


@book.query(f"WITH {_LAB} SELECT id, pred, sim, coalesce(sim >= floor, true) AND pred >= 0 AS is_match FROM best LEFT JOIN (SELECT * FROM fl WHERE class % 2 = 0) f ON f.class = best.pred")
def f13_match_gate(t):
    """Classes of odd number have no floor, so all of theirs match."""
    r = labelled(t)
    c = sc.centroids(r.where("class >= 0"))
    floors = sc.floors(r.where("class >= 0"), c).where("class % 2 = 0").select(F.col("class").alias("pred"), "floor")
    both = sc.assign(r, c).join(floors, "pred", "left")
    return both.select("id", F.col("pred").cast("long").alias("pred"), "sim", (F.coalesce(F.col("sim") >= F.col("floor"), F.lit(True)) & (F.col("pred") >= 0)).alias("is_match"))


@book.query(f"WITH {PLAIN} SELECT id, round(sum(v * v), 6) AS squares, round(sum(v * d), 5) AS moment FROM (SELECT id, v, row_number() OVER (PARTITION BY id ORDER BY d) AS d FROM (SELECT lng.id, lng.d, x / n * sqrt(CASE source WHEN 'main' THEN 0.4 / 0.65 ELSE 0.25 / 0.65 END) AS v FROM lng JOIN nn USING (id, source) WHERE source IN ('main', 'logits'))) GROUP BY id")
def a4_strict_composite(t):
    both, _ = g.gather(t.items, t.features)
    good, _ = g.composite_strict(both, ["main", "logits"], g.WEIGHTS)
    # the oracle has main before logits, name order is the other way round
    vec = F.concat(F.slice("vec", 11, 32), F.slice("vec", 1, 10))
    return good.select("id", vec.alias("vec")).select("id", F.round(dot("vec", "vec"), 6).alias("squares"), F.round(F.expr("aggregate(transform(vec, (x, i) -> x * (i + 1)), 0D, (a, x) -> a + x)"), 5).alias("moment"))


@book.query("SELECT vec_id AS id, generate_subscripts(embedding, 1) - 1 AS d, round(unnest(embedding)::DOUBLE / greatest(sqrt(list_sum([y::DOUBLE * y FOR y IN embedding])), 1e-9), 6) AS x FROM embeddings")
def x1_unit_vectors(t):
    u = unit(vectors(t), "vec", "u")
    return u.select("id", F.posexplode("u").alias("d", "x")).select("id", F.col("d").cast("long").alias("d"), F.round("x", 6).alias("x"))


_Z = "(embedding[1]::DOUBLE * 8)"
_T = f"(1 / (1 + 0.2316419 * abs({_Z})))"


@book.query(f"""SELECT vec_id AS id, round(CASE WHEN {_Z} >= 0 THEN 1 - tail ELSE tail END, 6) AS p FROM (SELECT *, exp(-{_Z} * {_Z} / 2) / sqrt(2 * pi()) * (0.319381530 * {_T} - 0.356563782 * {_T} ** 2 + 1.781477937 * {_T} ** 3 - 1.821255978 * {_T} ** 4 + 1.330274429 * {_T} ** 5) AS tail FROM embeddings)""")
def x9_normal_cdf(t):
    return t.embeddings.select(F.col("vec_id").alias("id"), (F.col("embedding")[0].cast("double") * 8).alias("z")).select("id", F.round(normal_cdf("z"), 6).alias("p"))


@book.query("SELECT id, round(0.03 * sqrt(u) * cos(2 * pi() * v), 6) AS dx, round(0.03 * sqrt(u) * sin(2 * pi() * v), 6) AS dy FROM (SELECT id, ('0x' || substr(md5(path), 1, 8))::BIGINT / 4294967296 AS u, ('0x' || substr(md5(path), 9, 8))::BIGINT / 4294967296 AS v FROM items)")
def x11_jitter(t):
    """A shift within a small disc that depends on the path only."""
    part = lambda at: F.conv(F.substring(F.md5(F.col("path").cast("binary")), at, 8), 16, 10).cast("long") / 4294967296.0
    r, angle = 0.03 * F.sqrt(F.col("u")), F.lit(2 * math.pi) * F.col("v")
    return t.items.select("id", part(1).alias("u"), part(9).alias("v")).select("id", F.round(r * F.cos(angle), 6).alias("dx"), F.round(r * F.sin(angle), 6).alias("dy"))


@book.query("""WITH m AS (SELECT fingerprint, d, avg(x) AS x FROM (SELECT fingerprint, generate_subscripts(vec, 1) AS d, unnest(vec)::DOUBLE AS x FROM segments WHERE pos IS NOT NULL) GROUP BY fingerprint, d),
f AS (SELECT fingerprint, generate_subscripts(vec, 1) AS d, unnest(vec)::DOUBLE AS x FROM features WHERE source = 'main' AND version = 2 AND fingerprint NOT IN (SELECT fingerprint FROM m))
SELECT i.id, v.d, round(v.x, 6) AS x FROM items i JOIN (SELECT * FROM m UNION ALL SELECT * FROM f) v ON v.fingerprint = i.fingerprint""")
def a24_mining_vectors(t):
    """The mean of an item's excerpts in all dimensions, else its pooled vector."""
    mean = t.segments.where("pos IS NOT NULL").select("fingerprint", F.posexplode("vec").alias("d", "x")).groupBy("fingerprint", "d").agg(F.avg("x").alias("m"))
    mean = mean.groupBy("fingerprint").agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "m"))), lambda e: e["m"]).alias("mean"))
    pooled = g.read_features(t.features, "main").select("fingerprint", F.transform("vec", lambda x: x.cast("double")).alias("pooled"))
    both = t.items.select("id", "fingerprint").join(mean, "fingerprint", "left").join(pooled, "fingerprint", "left").select("id", F.posexplode(F.coalesce("mean", "pooled")).alias("d", "x"))
    return both.select("id", (F.col("d") + 1).cast("long").alias("d"), F.round("x", 6).alias("x"))


@book.query("SELECT fingerprint, d, round(avg(x), 6) AS pooled FROM (SELECT fingerprint, generate_subscripts(vec, 1) AS d, unnest(vec)::DOUBLE AS x FROM segments WHERE pos IS NOT NULL) GROUP BY 1, 2")
def x14_masked_means(t):
    dims = t.segments.where("pos IS NOT NULL").select("fingerprint", F.posexplode("vec").alias("d", "x")).groupBy("fingerprint", "d").agg(F.round(F.avg("x"), 6).alias("pooled"))
    return dims.select("fingerprint", (F.col("d") + 1).cast("long").alias("d"), "pooled")


@book.query("SELECT vec_id AS id, (d - 1) // 16 AS row, (d - 1) % 16 AS col, round(x, 6) AS x FROM (SELECT vec_id, generate_subscripts(embedding, 1) AS d, unnest(embedding)::DOUBLE AS x FROM embeddings)")
def x13_matrices(t):
    matrix = F.expr("transform(sequence(0, size(embedding) div 16 - 1), i -> slice(embedding, i * 16 + 1, 16))")
    cells = t.embeddings.select(F.col("vec_id").alias("id"), F.posexplode(matrix).alias("row", "v")).select("id", "row", F.posexplode("v").alias("col", "x"))
    return cells.select("id", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.round(F.col("x").cast("double"), 6).alias("x"))


_SIDE = "SELECT folder, d, s / sqrt(sum(s * s) OVER (PARTITION BY folder)) AS c FROM (SELECT folder, d, avg(x) AS s FROM (SELECT i.folder, generate_subscripts(e.embedding, 1) AS d, unnest(e.embedding)::DOUBLE AS x FROM items i JOIN embeddings e ON e.vec_id = i.id WHERE {}) GROUP BY folder, d)"


@book.query(f"WITH a AS ({_SIDE.format('i.label < 7')}), b AS ({_SIDE.format('i.label > 3')}), c AS (SELECT a.folder, round(sum(a.c * b.c), 6) AS cosine FROM a JOIN b ON a.folder = b.folder AND a.d = b.d GROUP BY a.folder) SELECT f.folder, CASE WHEN c.folder IS NOT NULL THEN 'both' WHEN f.l THEN 'left' ELSE 'right' END AS side, cosine, (SELECT round(avg(cosine), 6) FROM c) AS mean_cosine FROM (SELECT folder, bool_or(l) AS l FROM (SELECT folder, true AS l FROM a UNION ALL SELECT folder, false FROM b) GROUP BY folder) f LEFT JOIN c ON c.folder = f.folder")
def j15_compared_models(t):
    r = rows(t)
    return sc.compared(sc.centroids(r.where("label < 7"), "folder"), sc.centroids(r.where("label > 3"), "folder"), "folder")


_NODES = """w AS (SELECT i.folder, [x / greatest(sqrt(list_sum([y::DOUBLE * y FOR y IN e.embedding])), 1e-9) FOR x IN e.embedding::DOUBLE[]] AS u FROM items i JOIN embeddings e ON e.vec_id = i.id),
a AS (SELECT unnest([array_to_string(string_split(folder, '/')[1:i], '/') FOR i IN range(1, len(string_split(folder, '/')) + 1)]) AS node, u FROM w),
lx AS (SELECT node, unnest(u) AS x, generate_subscripts(u, 1) AS d FROM a), s AS (SELECT node, d, sum(x) AS s, count(*) AS n FROM lx GROUP BY node, d), c AS (SELECT node, d, n, s / sqrt(sum(s * s) OVER (PARTITION BY node)) AS c FROM s),
df AS (SELECT x.node, x.n, x.d, x.c - y.c AS v FROM c x JOIN c y ON x.node LIKE '%/%' AND y.node = regexp_replace(x.node, '/[^/]*$', '') AND y.d = x.d WHERE x.n >= 2 AND y.n >= 2),
t AS (SELECT node, n, len(string_split(node, '/')) - 1 AS exponent, d, v / l AS t FROM (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY node)) AS l FROM df) WHERE l > 1e-6)"""


@book.query(f"WITH {_NODES} SELECT node, n, exponent, d, round(t, 5) AS t FROM t")
def m15_whole_directions(t):
    d = pm.folder_directions(rows(t))
    return d.select("node", "n", F.col("exponent").cast("long").alias("exponent"), F.posexplode("direction").alias("d", "t")).select("node", "n", "exponent", (F.col("d") + 1).cast("long").alias("d"), F.round("t", 5).alias("t"))


@book.query(f"WITH {_NODES}, m AS (SELECT a.d AS i, b.d AS j, sum(power(3.0, a.exponent) * 2.4 * a.t * b.t) AS m FROM t a JOIN t b ON a.node = b.node GROUP BY 1, 2), x AS (SELECT vec_id AS id, generate_subscripts(embedding, 1) AS d, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT x.id, m.j AS d, round(sum(x.x * m.m) + any_value(o.x), 3) AS x FROM x JOIN m ON m.i = x.d JOIN x o ON o.id = x.id AND o.d = m.j GROUP BY x.id, m.j")
def m16_whole_reweighted(t):
    r = rows(t)
    moved = pm.reweight(r, pm.folder_directions(r), 2.4, 3.0).select("id", F.posexplode("vec").alias("d", "x"))
    return moved.select("id", (F.col("d") + 1).cast("long").alias("d"), F.round("x", 3).alias("x"))


_SHARED = "SELECT id, min(id) OVER (PARTITION BY {0}) AS b FROM items WHERE {0} IS NOT NULL"


@book.query(f"""WITH RECURSIVE l AS (SELECT id AS a, b FROM ({_SHARED.format('artist')}) UNION SELECT id, b FROM ({_SHARED.format('fingerprint')})), u AS (SELECT a, b FROM l WHERE a <> b UNION SELECT b, a FROM l WHERE a <> b),
r(v, w) AS (SELECT a, a FROM u UNION SELECT r.v, u.b FROM r JOIN u ON u.a = r.w) SELECT v, min(w) AS label FROM r GROUP BY v""")
def u4_shared_identities(t):
    """Items joined by an artist or by content that they share; each identity is a star around its least item."""
    return gr.components(gr.stars(t.items, "id", ["artist", "fingerprint"]))


@book.query()
def w13_key_groups(t):
    keys = t.item_features6.select("fingerprint", F.pmod(F.round(F.atan2("key_sin", "key_cos") * 12 / (2 * math.pi)).cast("int"), F.lit(12)).alias("fifth"))
    return sc.key_groups(keys, "fifth", 1)


@book.query()
def w8_balanced_sample(t):
    split = F.when(F.pmod(F.xxhash64("artist", F.lit(3)), F.lit(10)) < 7, "dev").otherwise("heldout")
    return sc.balanced(t.items.select("id", "label", split.alias("split")), 200)
