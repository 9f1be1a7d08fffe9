"""The library's tables: paths, store, tags, coverage, filters, sets (S, F, J10, J11, A9, A10, A27, A30, A32, U)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecatlas.functions import paths as p
from vecatlas.operators import filters as f
from vecatlas.operators import store as st
from vecatlas.operators.scoring import dedup
from vecatlas.plans.book import Book

book = Book()
SOURCES = ["main", "logits", "rhythm", "text"]
_ANC = "[array_to_string(string_split(folder, '/')[1:i], '/') FOR i IN range(1, len(string_split(folder, '/')) + 1)]"
_HAS = "bool_or(source = '{0}' AND n_dims > 0) AS {0}"
_PRESENT = f"SELECT fingerprint, {', '.join(_HAS.format(s) for s in SOURCES)} FROM features WHERE version = 2 GROUP BY fingerprint"


@book.query("SELECT path FROM items WHERE folder LIKE 'lib/%' AND lower(path) LIKE '%.dat'")
def s1_catalogue_scan(t):
    return t.items.where(p.in_subtree("folder", "lib") & F.lower("path").endswith(".dat")).select("path")


@book.query("SELECT '/mnt/' || path AS path, CASE WHEN path LIKE 'lib/g1/%' THEN 'one' || substr('/mnt/' || path, 12) ELSE 'all' || substr('/mnt/' || path, 5) END AS virtual FROM items")
def s2_virtual_path(t):
    roots = t.spark.createDataFrame([("/mnt", "all"), ("/mnt/lib/g1", "one"), ("/other", "none")], "root string, root_id string")
    return p.virtual_paths(t.items.select(F.concat(F.lit("/mnt/"), "path").alias("path")), roots)[0]


@book.query("SELECT id, CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN root_id || '/x' ELSE folder END AS resolved FROM items")
def s3_resolve_path(t):
    raw = F.when(F.col("id") % 3 == 0, F.concat(F.lit("a/../../"), "path")).when(F.col("id") % 3 == 1, F.concat(F.col("root_id"), F.lit("//./y/../x"))).otherwise(F.concat("path", F.lit("/..")))
    return t.items.withColumn("raw", raw).select("id", p.resolve("raw").alias("resolved"))


@book.query("""WITH r AS (SELECT DISTINCT '/' || folder AS root FROM items) SELECT root, CASE WHEN row_number() OVER (PARTITION BY substr(sha1(root), 1, 8) ORDER BY root) = 1 THEN substr(sha1(root), 1, 8) END AS root_id
FROM r WHERE NOT EXISTS (SELECT 1 FROM r b WHERE r.root LIKE b.root || '/%')""")
def s4_roots(t):
    return p.maximal_roots(t.items.select(F.concat(F.lit("/"), "folder").alias("root")))


@book.query("SELECT i.path, i.id AS mtime, o.label FROM items i JOIN items o ON i.path = o.path AND i.id = o.id + CASE WHEN o.id % 4 = 0 THEN 1 ELSE 0 END")
def s5_metadata_lookup(t):
    cached = t.items.select("path", (F.col("id") + (F.col("id") % 4 == 0).cast("int")).alias("mtime"), "label")
    return t.items.select("path", F.col("id").alias("mtime")).join(cached, ["path", "mtime"])


@book.query("SELECT path, CASE WHEN id % 2 = 0 THEN label + 100 ELSE label END AS label, CASE WHEN id % 2 = 0 THEN 2 ELSE 1 END AS seen FROM items")
def s6_metadata_upsert(t):
    old = t.items.select("path", "label", F.lit(1).alias("seen"))
    return st.upsert(old, t.items.where("id % 2 = 0").select("path", (F.col("label") + 100).alias("label"), F.lit(2).alias("seen")), ["path"], F.col("seen"))


@book.query("SELECT id, CASE WHEN path LIKE 'lib/g1/s1/deep/%' THEN 'deep2/' || substr(path, 16) WHEN path LIKE 'lib/g1/%' THEN 'moved/' || substr(path, 8) ELSE path END AS path FROM items")
def s7_remap(t):
    renames = t.spark.createDataFrame([("lib/g1", "moved"), ("lib/g1/s1/deep", "deep2"), ("lib/g", "no"), ("%", "no")], "old string, new string")
    return st.remap_many(t.items.select("id", "path"), renames)


@book.query("SELECT count(*) FILTER (WHERE id % 5 <> 0) AS kept, count(*) FILTER (WHERE id % 5 = 0) AS gone FROM items")
def s8_prune_missing(t):
    kept, gone = st.prune(t.items, t.items.where("id % 5 <> 0"))
    return kept.select(F.lit(1).alias("k")).unionAll(gone.select(F.lit(0).alias("k"))).agg(F.count_if(F.col("k") == 1).alias("kept"), F.count_if(F.col("k") == 0).alias("gone"))


@book.query(f"""WITH n AS (SELECT unnest({_ANC}) AS path FROM items), c AS (SELECT path, count(*) AS n_items FROM n GROUP BY path),
k AS (SELECT regexp_replace(path, '/[^/]*$', '') AS path, string_agg(regexp_extract(path, '[^/]*$'), ',' ORDER BY regexp_extract(path, '[^/]*$')) AS children FROM c WHERE contains(path, '/') GROUP BY 1)
SELECT path, regexp_extract(path, '[^/]*$') AS name, split_part(path, '/', 1) AS root_id, n_items, coalesce(children, '') AS children FROM c LEFT JOIN k USING (path)""")
def s11_folder_tree(t):
    return p.folder_tree(t.items)


@book.query("""SELECT i.id, f.fingerprint IS NOT NULL AS has_features, round(60 + f.tempo_norm * 190, 4) AS bpm, round(f.energy, 6) AS energy, round(((atan2(f.key_sin, f.key_cos) / (2 * pi()) + 0.5) % 1 + 1) % 1, 6) AS key
FROM items i LEFT JOIN item_features6 f USING (fingerprint)""")
def s10_track_payload(t):
    both = t.items.join(t.item_features6.withColumn("has", F.lit(True)), "fingerprint", "left")
    key = F.pmod(F.atan2("key_sin", "key_cos") / (2 * F.pi()) + 0.5, F.lit(1.0))
    return both.select("id", F.coalesce("has", F.lit(False)).alias("has_features"), F.round(60 + F.col("tempo_norm") * 190, 4).alias("bpm"), F.round("energy", 6).alias("energy"), F.round(key, 6).alias("key"))


@book.query("SELECT fingerprint, len(vec) AS n, round(list_sum(vec)::DOUBLE, 4) AS total FROM features WHERE source = 'rhythm' AND version = 2 AND fingerprint IN (SELECT fingerprint FROM items WHERE fingerprint IS NOT NULL)")
def s12_feature_read(t):
    from vecatlas.operators.gather import read_features

    vecs = read_features(t.features, "rhythm").join(t.items.select("fingerprint"), "fingerprint", "left_semi")
    return vecs.select("fingerprint", F.size("vec").cast("long").alias("n"), F.round(F.expr("aggregate(vec, CAST(0 AS DOUBLE), (s, x) -> s + x)"), 4).alias("total"))


@book.query(_PRESENT)
def s13_presence(t):
    return st.presence(t.features, SOURCES)


@book.query("SELECT source, version, count(DISTINCT fingerprint) AS n_rows FROM features WHERE n_dims > 0 GROUP BY source, version")
def s14_counts(t):
    return st.counts(t.features)


@book.query("SELECT id, coalesce(CASE WHEN id % 2 = 0 THEN label END, label) AS label, CASE WHEN id % 2 = 0 THEN 'new' ELSE artist END AS artist FROM items")
def s15_feature_upsert(t):
    old = t.items.select("id", "label", "artist")
    return st.upsert_family(old, t.items.where("id % 2 = 0").select("id", F.lit(None).cast("int").alias("label"), F.lit("new").alias("artist")), ["id"])


@book.query("SELECT source, count(*) AS n_purged FROM features WHERE source IN ('main', 'text') AND version < 2 GROUP BY source")
def s16_purge_versions(t):
    return st.purge_old(t.features, ["main", "text"], 2)[1]


@book.query("SELECT source, count(*) AS n FROM features WHERE source IN ('main', 'rhythm') GROUP BY source")
def s17_reconcile(t):
    meta = t.spark.createDataFrame([("main", "a"), ("logits", "a"), ("rhythm", "b"), ("text", "c")], "source string, identity string")
    given = t.spark.createDataFrame([("main", "a"), ("logits", "z"), ("rhythm", "b")], "source string, identity string")
    return st.reconcile(t.features, meta, given).groupBy("source").agg(F.count("*").alias("n"))


@book.query("SELECT id, id % 50 AS revision FROM layout_a WHERE id % 50 >= 18")
def s19_retention(t):
    return st.retain(t.layout_a.select("id", (F.col("id") % 50).alias("revision"), (F.col("id") % 50).alias("created")), "revision", "created", 32).select("id", "revision")


@book.query("""WITH c AS (SELECT path, 'energy' AS tag, id / 100.0 AS value FROM items WHERE id % 3 = 0 AND id % 6 <> 0 UNION ALL SELECT path, 'energy', NULL FROM items WHERE id % 6 = 0)
SELECT path, tag, round(CASE WHEN c.path IS NULL THEN t.value ELSE least(greatest(c.value, 0), 1) END, 6) AS value FROM tags t FULL JOIN c USING (path, tag) WHERE c.path IS NULL OR c.value IS NOT NULL""")
def s22_tag_merge(t):
    c = t.items.where("id % 3 = 0").select("path", F.lit("energy").alias("tag"), F.when(F.col("id") % 6 != 0, F.col("id") / 100.0).alias("value"), F.col("id").alias("seq"))
    return st.merge_tags(t.tags, c)[0].withColumn("value", F.round("value", 6))


@book.query("SELECT DISTINCT tag FROM tags WHERE path LIKE 'lib/%'")
def s23_tag_names(t):
    return t.tags.where(F.startswith("path", F.lit("lib/"))).select("tag").distinct()


@book.query("""SELECT path, round(coalesce(v, 0.5), 6) AS axis FROM (SELECT i.path, coalesce(f.energy, t.value) AS v FROM items i LEFT JOIN (SELECT * FROM item_features6 WHERE mode = 0) f USING (fingerprint)
LEFT JOIN (SELECT path, value FROM tags WHERE tag = 'mood') t USING (path)) WHERE v IS NULL OR v BETWEEN 0.3 AND 0.7""")
def f1_range_filter(t):
    both = t.items.join(t.item_features6.where("mode = 0").select("fingerprint", "energy"), "fingerprint", "left").join(t.tags.where("tag = 'mood'").select("path", "value"), "path", "left")
    return both.where(f.within(F.coalesce("energy", "value"), 0.3, 0.7)).select("path", F.round(f.axis_value("energy", "value"), 6).alias("axis"))


@book.query("SELECT id FROM items WHERE folder = 'lib/g1' OR folder LIKE 'lib/g1/%'")
def f3_folder_target(t):
    return t.items.where(f.matches(folder="lib/g1")).select("id")


@book.query("SELECT id FROM items WHERE id % 10 <> 0 AND NOT (folder = 'lib/g2' OR folder LIKE 'lib/g2/%')")
def f4_exclusions(t):
    folders = t.spark.createDataFrame([("lib/g2",), ("lib/g",)], "folder string")
    return f.exclude(t.items, t.items.where("id % 10 = 0"), folders).select("id")


@book.query("SELECT id FROM items WHERE split_part(folder, '/', 1) NOT IN ('ext')")
def f5_role_filter(t):
    external = t.spark.createDataFrame([("ext",)], "root string")
    return t.items.withColumn("root", p.root("folder")).join(F.broadcast(external), "root", "left_anti").select("id")


@book.query("SELECT id FROM items WHERE split_part(folder, '/', 1) <> 'ext' AND id % 10 <> 0 AND (folder = 'lib/g1' OR folder LIKE 'lib/g1/%' OR label % 2 = 0)")
def f6_visibility(t):
    rule = f.matches(folder="lib/g1") | (F.col("label") % 2 == 0)
    return t.items.where((p.root("folder") != "ext") & (F.col("id") % 10 != 0) & rule).select("id")


@book.query("SELECT id FROM layout_a WHERE x BETWEEN -0.15 AND 0.15 AND y BETWEEN -0.15 AND 0.15 AND sqrt(x * x + y * y) <= 0.15")
def f7_region(t):
    return t.layout_a.where(f.in_region("circle", 0.0, 0.0, 0.15)).select("id")


@book.query(f"SELECT i.id FROM items i JOIN ({_PRESENT}) p USING (fingerprint) WHERE main AND logits")
def f8_eligible(t):
    return f.eligible(t.items, st.presence(t.features, SOURCES), ["main", "logits"]).select("id")


@book.query("SELECT DISTINCT vec_id AS id FROM embeddings WHERE list_sum([x::DOUBLE * x FOR x IN embedding]) > 0")
def f10_row_validity(t):
    from vecatlas.functions.vectors import is_valid

    return t.embeddings.where(is_valid("embedding")).select(F.col("vec_id").alias("id"))


@book.query("WITH c AS (SELECT folder, row_number() OVER (ORDER BY folder) - 1 AS class FROM items GROUP BY folder HAVING count(*) >= 8) SELECT id, coalesce(class, -1) AS class FROM items LEFT JOIN c USING (folder)")
def f11_class_labels(t):
    return f.class_labels(t.items).select("id", "class")


@book.query("SELECT id, CASE WHEN split_part(folder, '/', 1) = 'ext' THEN 'place' ELSE 'fit' END AS role FROM items")
def f15_fit_scope(t):
    return t.items.select("id", F.when(p.root("folder") == "ext", "place").otherwise("fit").alias("role"))


@book.query(f"SELECT prefix, count(*) AS n, bool_and(h) AS all_hidden FROM (SELECT unnest({_ANC}) AS prefix, label % 2 = 0 AS h FROM items) GROUP BY prefix")
def f16_hidden_subtrees(t):
    return f.hidden_subtrees(t.items, F.col("label") % 2 == 0)


@book.query("SELECT id FROM layout_a WHERE x BETWEEN -0.2 AND 0.2 AND y BETWEEN -0.2 AND 0.2 AND x < 0.2 AND x >= -0.2 AND y < 0.2 AND y >= -0.2 AND x + y < 0.2")
def f19_polygon(t):
    return t.layout_a.where(f.in_polygon([(-0.2, -0.2), (0.2, -0.2), (0.2, 0.0), (0.0, 0.2), (-0.2, 0.2)])).select("id")


@book.query(f"""WITH w AS (SELECT i.fingerprint, s.source, s.ord FROM (SELECT DISTINCT fingerprint FROM items WHERE fingerprint IS NOT NULL) i, (VALUES ('main', 0), ('logits', 1), ('rhythm', 2), ('text', 3)) s(source, ord))
SELECT fingerprint, string_agg(source, ',' ORDER BY ord) AS missing FROM w WHERE NOT EXISTS (SELECT 1 FROM features f WHERE f.fingerprint = w.fingerprint AND f.source = w.source AND version = 2 AND n_dims > 0) GROUP BY fingerprint""")
def j10_missing_work(t):
    return st.missing_work(t.items, t.features, SOURCES)


@book.query("SELECT id, min_by(r::DOUBLE, round(abs(r - q), 9) * 1000 + r / 1000) AS level FROM (SELECT id, (id % 70) / 10.0 AS q FROM items) i, (VALUES (0.15), (0.4), (0.8), (1.5), (3.0), (6.0)) v(r) GROUP BY id")
def j11_nearest_level(t):
    levels = F.array(*map(F.lit, (0.15, 0.4, 0.8, 1.5, 3.0, 6.0)))
    asked = F.round((F.col("id") % 70) / 10.0, 6)
    return t.items.select("id", F.array_min(F.transform(levels, lambda r: F.struct(F.round(F.abs(r - asked), 9), r.alias("r"))))["r"].alias("level"))


@book.query("SELECT id FROM items WHERE (string_split(folder, '/')[1:greatest(1, len(string_split(folder, '/')) - 1)]) = (SELECT string_split(folder, '/')[1:greatest(1, len(string_split(folder, '/')) - 1)] FROM items WHERE id = 5)")
def j14_bloom_folder(t):
    return f.blooms_folder(t.items, 5, 1).select("id")


_FAILED = "(SELECT DISTINCT fingerprint, source FROM (SELECT concat('fp', CAST(vec_id AS VARCHAR(20))) AS fingerprint, CASE WHEN vec_id % 2 = 0 THEN 'main' ELSE 'rhythm' END AS source FROM embeddings WHERE vec_id % 5 = 0))"


@book.query(f"""WITH s AS (SELECT * FROM (VALUES ('main'), ('logits'), ('rhythm'), ('text')) v(source)), d AS (SELECT DISTINCT fingerprint, source FROM features WHERE version = 2 AND n_dims > 0), fl AS {_FAILED},
x AS (SELECT s.source, i.fingerprint, d.fingerprint IS NOT NULL AS done, fl.fingerprint IS NOT NULL AS bad FROM items i CROSS JOIN s LEFT JOIN d ON d.fingerprint = i.fingerprint AND d.source = s.source LEFT JOIN fl ON fl.fingerprint = i.fingerprint AND fl.source = s.source)
SELECT source, count(*) AS total, count(fingerprint) AS fingerprinted, count(*) FILTER (WHERE done) AS done, count(*) FILTER (WHERE bad AND NOT done) AS failed,
greatest(0, count(fingerprint) - count(*) FILTER (WHERE done) - count(*) FILTER (WHERE bad AND NOT done)) AS pending FROM x GROUP BY source""")
def a9_coverage(t):
    failed = t.embeddings.where("vec_id % 5 = 0").select(F.expr("concat('fp', vec_id)").alias("fingerprint"), F.when(F.col("vec_id") % 2 == 0, "main").otherwise("rhythm").alias("source"))
    return st.coverage(t.items, t.features, failed, SOURCES)


@book.query(f"SELECT (SELECT count(*) FROM items) AS total, count(DISTINCT i.fingerprint) AS analysed, count(DISTINCT i.fingerprint) = (SELECT count(*) FROM items) AS ready FROM items i JOIN ({_PRESENT}) p USING (fingerprint) WHERE main AND logits")
def a10_readiness(t):
    return st.readiness(t.items, t.features, ["main", "logits"])


@book.query("SELECT CASE WHEN grouping(folder) = 0 THEN 'folder' ELSE 'label' END AS kind, CASE WHEN grouping(folder) = 0 THEN folder ELSE CAST(label AS VARCHAR) END AS key, count(*) AS n FROM items WHERE id % 3 = 0 GROUP BY GROUPING SETS ((folder), (label))")
def a30_selection_breakdown(t):
    return f.selection_breakdown(t.items, t.items.where("id % 3 = 0"))


@book.query("WITH s AS (SELECT path, value, avg(value) OVER () AS m, min(value) OVER () AS lo, max(value) OVER () AS hi FROM tags WHERE tag = 'energy' AND path LIKE 'lib/g1/%') SELECT path, round(least(greatest(value + 0.6 - m, 0), 1), 6) AS shifted, round(least(greatest(CASE WHEN hi = lo THEN 0.45 ELSE 0.2 + (value - lo) / (hi - lo) * 0.5 END, 0), 1), 6) AS remapped FROM s")
def a32_tag_shift(t):
    sel = t.tags.where((F.col("tag") == "energy") & F.startswith("path", F.lit("lib/g1/")))
    m, lo, hi = sel.agg(F.avg("value"), F.min("value"), F.max("value")).first()
    clamp = lambda c: F.round(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)), 6)
    remap = F.lit(0.45) if m is None or hi == lo else 0.2 + (F.col("value") - F.lit(lo)) / F.lit(hi - lo) * 0.5
    return sel.select("path", clamp(F.col("value") + 0.6 - F.lit(m)).alias("shifted"), clamp(remap).alias("remapped"))


@book.query("SELECT DISTINCT path FROM items WHERE folder LIKE 'lib/g1%' OR folder LIKE 'lib/g1/s1%' OR label = 3")
def u1_union_selections(t):
    a, b, c = (t.items.where(x).select("path") for x in ("folder like 'lib/g1%'", "folder like 'lib/g1/s1%'", "label = 3"))
    return a.unionByName(b).unionByName(c).dropDuplicates(["path"])


@book.query(f"SELECT fingerprint, main AND logits AND rhythm AND text AS in_all, rhythm AND NOT text AS only_rhythm FROM ({_PRESENT})")
def u2_source_sets(t):
    from functools import reduce

    have = {s: t.features.where((F.col("source") == s) & (F.col("version") == 2)).select("fingerprint") for s in SOURCES}
    everyone = t.features.where("version = 2").select("fingerprint").distinct()
    mark = lambda df, c: everyone.join(df.distinct().withColumn(c, F.lit(True)), "fingerprint", "left").select("fingerprint", F.coalesce(c, F.lit(False)).alias(c))
    return mark(reduce(lambda a, b: a.intersect(b), have.values()), "in_all").join(mark(have["rhythm"].exceptAll(have["text"]), "only_rhythm"), "fingerprint")


@book.query("WITH g AS (SELECT fingerprint, min(path) AS path, count(DISTINCT label) AS n FROM items WHERE fingerprint IS NOT NULL GROUP BY fingerprint) SELECT fingerprint, path FROM g WHERE n = 1")
def u3_dedup(t):
    return dedup(t.items)[0].select("fingerprint", "path")


@book.query(r"SELECT id, regexp_replace(path, '/[^/]*$', '') AS folder, split_part(path, '/', 1) AS root, regexp_replace(folder, '^[^/]*/', '') AS below FROM items")
def x2_path_parts(t):
    return t.items.select("id", p.parent("path").alias("folder"), p.root("path").alias("root"), p.below_root("folder").alias("below"))


@book.query("SELECT vec_id AS id, trim(regexp_replace(' .' || chr(65 + CAST(vec_id % 26 AS INT)) || ':x/y*z. ', '[<>:\"/\\\\|?*]', '_', 'g'), ' .') AS safe FROM embeddings")
def x3_safe_component(t):
    raw = F.concat(F.lit(" ."), F.char((65 + F.col("vec_id") % 26).cast("int")), F.lit(":x/y*z. "))
    return t.embeddings.withColumn("raw", raw).select(F.col("vec_id").alias("id"), p.safe_component("raw").alias("safe"))


@book.query("SELECT DISTINCT folder, list_reduce([0::BIGINT] || [ascii(c)::BIGINT FOR c IN string_split(folder, '')], lambda h, c: (h * 31 + c) & 262143) AS hash FROM items")
def x10_folder_hash(t):
    return t.items.select("folder").distinct().select("folder", p.folder_hash("folder").alias("hash"))
