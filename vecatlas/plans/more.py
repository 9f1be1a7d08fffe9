"""Alignment, summaries, validation, moves and scalar helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecatlas.functions.vectors import is_valid
from vecatlas.operators import layout as lay
from vecatlas.operators import plans_and_moves as pm
from vecatlas.operators import store as st
from vecatlas.operators.filters import class_labels
from vecatlas.plans.book import Book
from vecatlas.plans.layout import marked, vectors
from vecatlas.plans.scoring import rows

book = Book()


@book.query("SELECT fingerprint FROM features WHERE version = 2 GROUP BY fingerprint HAVING count(DISTINCT source) = 4")
def j3_complete_case(t):
    f = t.features.where("version = 2")
    out = f.where("source = 'main'").select("fingerprint").distinct()
    for s in ("logits", "rhythm", "text"):
        out = out.join(f.where(F.col("source") == s).select("fingerprint"), "fingerprint", "left_semi")
    return out


@book.query("SELECT source, count(*) AS n, count(DISTINCT fingerprint) = count(*) AS is_unique, min(len(vec)) = max(len(vec)) AS one_width FROM features GROUP BY source")
def s20_vector_artefacts(t):
    good = t.features.where(is_valid("vec"))
    return good.groupBy("source").agg(F.count("*").alias("n"), (F.countDistinct("fingerprint") == F.count("*")).alias("is_unique"), (F.min(F.size("vec")) == F.max(F.size("vec"))).alias("one_width"))


@book.query("SELECT source, min(version)::BIGINT AS trained, max(version)::BIGINT AS current FROM features GROUP BY source HAVING min(version) <> max(version)")
def s24_version_differences(t):
    by = t.features.groupBy("source")
    trained, current = by.agg(F.min("version").cast("long").alias("trained")), by.agg(F.max("version").cast("long").alias("current"))
    return trained.join(current, "source").where("trained <> current")


@book.query("""SELECT sha256(concat_ws('|', CAST(count(*) AS VARCHAR), CAST(sum(('0x' || substr(h, 1, 15))::BIGINT) AS VARCHAR), CAST(sum(('0x' || substr(h, 16, 15))::BIGINT) AS VARCHAR), CAST(sum(('0x' || substr(h, 31, 15))::BIGINT) AS VARCHAR), CAST(sum(('0x' || substr(h, 46, 15))::BIGINT) AS VARCHAR))) AS signature FROM (SELECT sha256(concat_ws('|', coalesce(CAST(path AS VARCHAR), '~'), coalesce(CAST(id AS VARCHAR), '~'))) AS h FROM items)""")
def s9_library_signature(t):
    return st.signature(t.items, ["path", "id"])


@book.query("""WITH l AS (SELECT id AS lid, x AS lx, y AS ly FROM layout_a WHERE id IN (SELECT min(vec_id) FROM embeddings WHERE label IS NOT NULL GROUP BY label)), d AS (SELECT a.id, lid, row_number() OVER (PARTITION BY a.id ORDER BY round((a.x - lx) * (a.x - lx) + (a.y - ly) * (a.y - ly), 9), lid) AS rn FROM layout_a a, l)
SELECT id, lid FROM d WHERE rn = 1""")
def j13_nearest_landmark(t):
    marks = lay.among(t.layout_a, marked(t)).orderBy("id").collect()
    each = F.array(*(F.struct(F.round((F.col("x") - m["x"]) * (F.col("x") - m["x"]) + (F.col("y") - m["y"]) * (F.col("y") - m["y"]), 9).alias("d"), F.lit(m["id"]).alias("lid")) for m in marks))
    return t.layout_a.select("id", F.array_min(each)["lid"].alias("lid"))


@book.query("""WITH a AS (SELECT folder, count(*) AS n FROM items WHERE label < 7 GROUP BY folder), b AS (SELECT folder, count(*) AS m FROM items WHERE label > 3 GROUP BY folder)
SELECT coalesce(a.folder, b.folder) AS folder, CASE WHEN m IS NULL THEN 'left' WHEN n IS NULL THEN 'right' ELSE 'both' END AS side FROM a FULL JOIN b ON a.folder = b.folder""")
def j15_shared_classes(t):
    a, b = t.items.where("label < 7").groupBy("folder").agg(F.count("*").alias("n")), t.items.where("label > 3").groupBy("folder").agg(F.count("*").alias("m"))
    return a.join(b, "folder", "full").select("folder", F.when(F.col("m").isNull(), "left").when(F.col("n").isNull(), "right").otherwise("both").alias("side"))


@book.query("""WITH s AS (SELECT fingerprint, count(*) AS n FROM segments WHERE pos IS NOT NULL GROUP BY fingerprint), m AS (SELECT fingerprint FROM features WHERE source = 'main' AND version = 2)
SELECT i.id, CASE WHEN s.n > 0 THEN 'segments' WHEN m.fingerprint IS NOT NULL THEN 'mean' END AS kind, coalesce(s.n, 0) AS n FROM items i LEFT JOIN s USING (fingerprint) LEFT JOIN m USING (fingerprint) WHERE s.n > 0 OR m.fingerprint IS NOT NULL""")
def j16_search_corpus(t):
    s = t.segments.where("pos IS NOT NULL").groupBy("fingerprint").agg(F.count("*").alias("n"))
    m = t.features.where("source = 'main' AND version = 2").select("fingerprint", F.lit(True).alias("m"))
    both = t.items.join(s, "fingerprint", "left").join(m, "fingerprint", "left").where("n > 0 OR m")
    return both.select("id", F.when(F.col("n") > 0, "segments").otherwise("mean").alias("kind"), F.coalesce("n", F.lit(0)).alias("n"))


@book.query()
def a7_folder_anchors(t):
    return pm.folder_anchors(rows(t), ["ext"])


@book.query("""WITH d AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec, x, y, sha1(concat_ws('-', '0', CAST(vec_id AS VARCHAR))) AS h FROM embeddings JOIN layout_a a ON a.id = vec_id ORDER BY h, vec_id LIMIT 2048),
n AS (SELECT id, coalesce(lead(id) OVER (ORDER BY h, id), first_value(id) OVER (ORDER BY h, id)) AS other FROM d),
p AS (SELECT round(list_distance(a.vec, b.vec), 9) AS dh, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 9) AS dl FROM n JOIN d a ON a.id = n.id JOIN d b ON b.id = n.other WHERE n.id <> n.other),
r AS (SELECT rank() OVER (ORDER BY dh) + (count(*) OVER (PARTITION BY dh) - 1) / 2.0 AS rh, rank() OVER (ORDER BY dl) + (count(*) OVER (PARTITION BY dl) - 1) / 2.0 AS rl FROM p WHERE dh > 0)
SELECT CASE WHEN count(*) >= 3 AND stddev_pop(rh) > 0 AND stddev_pop(rl) > 0 THEN round(corr(rh, rl), 6) END AS rho FROM r""")
def a18_spearman(t):
    return lay.broad_spearman(vectors(t), t.layout_a)


@book.query("SELECT source, round(median(list_sum(vec)::DOUBLE), 4) AS median, round(min(list_sum(vec)::DOUBLE), 4) AS least, round(max(list_sum(vec)::DOUBLE), 4) AS most FROM features GROUP BY source")
def a19_summary(t):
    v = t.features.select("source", F.expr("aggregate(vec, CAST(0 AS DOUBLE), (s, x) -> s + x)").alias("v"))
    return v.groupBy("source").agg(F.round(F.median("v"), 4).alias("median"), F.round(F.min("v"), 4).alias("least"), F.round(F.max("v"), 4).alias("most"))


@book.query("SELECT fingerprint, round(avg(vec[1]::DOUBLE), 6) AS first, count(*) AS n FROM segments GROUP BY fingerprint")
def a24_mining_vector(t):
    dims = t.segments.select("fingerprint", F.posexplode("vec").alias("d", "x")).groupBy("fingerprint", "d").agg(F.avg("x").alias("m"), F.count("*").alias("n"))
    return dims.where("d = 0").select("fingerprint", F.round("m", 6).alias("first"), "n")


@book.query("SELECT round(greatest(quantile_cont(d, 0.5), 1e-6), 6) AS tau FROM (SELECT round((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), 9) AS d FROM layout_a a, layout_a b WHERE b.id IN (SELECT min(vec_id) FROM embeddings WHERE label IS NOT NULL GROUP BY label))")
def a26_bandwidth(t):
    marks = lay.among(t.layout_a, marked(t)).orderBy("id").collect()
    each = F.explode(F.array(*(F.round((F.col("x") - m["x"]) * (F.col("x") - m["x"]) + (F.col("y") - m["y"]) * (F.col("y") - m["y"]), 9) for m in marks)))
    return t.layout_a.select(each.alias("d")).agg(F.round(F.greatest(F.percentile("d", 0.5), F.lit(1e-6)), 6).alias("tau"))


@book.query("SELECT folder FROM items WHERE split_part(folder, '/', 1) = 'lib' GROUP BY folder HAVING count(*) >= 8")
def f12_library_classes(t):
    libs = t.spark.createDataFrame([("lib",)], "root_id string")
    return class_labels(t.items).where("class >= 0").join(F.broadcast(libs), "root_id", "left_semi").select("folder").distinct()


@book.query("SELECT id FROM (SELECT id, row_number() OVER (ORDER BY round(x * x + y * y, 9), id) AS rn, count(*) OVER () AS n FROM layout_a) WHERE rn <= ceil(0.2 * n)")
def f17_proximity_keep(t):
    n = t.layout_a.count()
    return t.layout_a.select("id", F.round(F.col("x") * F.col("x") + F.col("y") * F.col("y"), 9).alias("d")).orderBy("d", "id").limit(-(-n // 5)).select("id")


@book.query("SELECT fingerprint, seg, CAST(floor(s / 60) AS BIGINT)::VARCHAR || ':' || lpad(CAST(CAST(floor(s) AS BIGINT) % 60 AS VARCHAR), 2, '0') AS text FROM (SELECT fingerprint, seg, coalesce(pos, 0) * 600 AS s FROM segments)")
def x12_time_text(t):
    s = F.floor(F.coalesce("pos", F.lit(0.0)) * 600)
    return t.segments.select("fingerprint", "seg", F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0")).alias("text"))


@book.query("SELECT vec_id AS id, i - 1 AS row, round(embedding[(i - 1) * 16 + 1]::DOUBLE, 6) AS first FROM embeddings, (SELECT unnest(range(1, 5)) AS i)")
def x13_blob_to_matrix(t):
    matrix = F.expr("transform(sequence(0, size(embedding) div 16 - 1), i -> slice(embedding, i * 16 + 1, 16))")
    return t.embeddings.select(F.col("vec_id").alias("id"), F.posexplode(matrix).alias("row", "v")).select("id", F.col("row").cast("long").alias("row"), F.round(F.col("v")[0].cast("double"), 6).alias("first"))


@book.query("SELECT fingerprint, round(avg(vec[2]::DOUBLE) FILTER (WHERE pos IS NOT NULL), 6) AS pooled FROM segments GROUP BY fingerprint HAVING count(pos) > 0")
def x14_masked_mean(t):
    dims = t.segments.where("pos IS NOT NULL").select("fingerprint", F.posexplode("vec").alias("d", "x")).groupBy("fingerprint", "d").agg(F.avg("x").alias("m"))
    return dims.where("d = 1").select("fingerprint", F.round("m", 6).alias("pooled"))


@book.query("SELECT CASE WHEN n > 0.3 * k THEN 'refit' ELSE 'place' END AS step, k AS known, n AS new FROM (SELECT (SELECT count(*) FROM layout_b) AS k, (SELECT count(*) FROM layout_a WHERE id NOT IN (SELECT id FROM layout_b)) AS n)")
def w14_incremental(t):
    step, known, new = pm.incremental(t.layout_a, t.layout_b)
    sides = known.select(F.lit(1).alias("k")).unionAll(new.select(F.lit(0).alias("k")))
    return sides.agg(F.lit(step).alias("step"), F.count_if(F.col("k") == 1).alias("known"), F.count_if(F.col("k") == 0).alias("new"))


@book.query("""SELECT 'fingerprint twice' AS rule, fingerprint AS detail FROM items WHERE fingerprint IS NOT NULL GROUP BY fingerprint HAVING count(*) > 1
UNION ALL SELECT 'no fingerprint', path FROM items WHERE fingerprint IS NULL UNION ALL SELECT 'artist in two splits', artist FROM items WHERE artist IS NOT NULL GROUP BY artist HAVING count(DISTINCT id % 10 < 7) > 1""")
def u5_manifest_problems(t):
    i = t.items
    twice = i.where("fingerprint IS NOT NULL").groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("fingerprint twice").alias("rule"), F.col("fingerprint").alias("detail"))
    none = i.where("fingerprint IS NULL").select(F.lit("no fingerprint").alias("rule"), F.col("path").alias("detail"))
    split = i.where("artist IS NOT NULL").groupBy("artist").agg(F.countDistinct(F.col("id") % 10 < 7).alias("n")).where("n > 1").select(F.lit("artist in two splits").alias("rule"), F.col("artist").alias("detail"))
    return twice.unionByName(none).unionByName(split)


@book.query("SELECT a.id, round(a.x + 0.1 * (b.x - a.x), 6) AS x, round(a.y + 0.1 * (b.y - a.y), 6) AS y FROM layout_a a JOIN layout_b b USING (id)")
def m10_first_order_preview(t):
    b = t.layout_b.select("id", F.col("x").alias("bx"), F.col("y").alias("by"))
    return t.layout_a.join(b, "id").select("id", F.round(F.col("x") + 0.1 * (F.col("bx") - F.col("x")), 6).alias("x"), F.round(F.col("y") + 0.1 * (F.col("by") - F.col("y")), 6).alias("y"))


@book.query()
def m15_folder_directions(t):
    d = pm.folder_directions(rows(t))
    return d.select("node", "n", "exponent", F.round(F.col("direction")[0], 6).alias("first"))


@book.query()
def m16_reweighted(t):
    r = rows(t)
    return pm.reweight(r, pm.folder_directions(r), 2.4, 3.0).select("id", F.round(F.col("vec")[0], 5).alias("first"))


@book.query("""WITH m AS (SELECT b.* FROM layout_b b JOIN layout_a a USING (id) WHERE a.x BETWEEN -0.1 AND 0.1 AND a.y BETWEEN -0.1 AND 0.1), u AS (SELECT id, 2 * (x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()) - 1 AS u, 2 * (y - min(y) OVER ()) / (max(y) OVER () - min(y) OVER ()) - 1 AS v FROM m)
SELECT id, round(0.1 * u * sqrt(1 - v * v / 2), 6) AS x, round(0.1 * v * sqrt(1 - u * u / 2), 6) AS y FROM u""")
def m24_region_layout(t):
    return pm.region_layout(t.layout_a, t.layout_b, 0.0, 0.0, 0.1, disc=True).select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))
