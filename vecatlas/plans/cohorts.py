"""Cohorts and the comparison of recipes on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecatlas.operators import cohort as co
from vecatlas.operators import gather as g
from vecatlas.operators import retrieval as rt
from vecatlas.plans.book import Book, Tables

book = Book()
ROOT, SEED, K = "lib", 42, 5
RECIPES: dict[str, tuple[str, dict[str, float]]] = {
    "main": ("main", {"main": 1.0}), "main+logits@700-300": ("main", {"main": 0.7, "logits": 0.3}), "main+logits@400-600": ("main", {"main": 0.4, "logits": 0.6}),
    "rhythm": ("rhythm", {"rhythm": 1.0}), "rhythm+text@500-500": ("rhythm", {"rhythm": 0.5, "text": 0.5}),
}

COHORT = f"""per AS (SELECT fingerprint, count(DISTINCT label) AS labels, min(path) AS first FROM items WHERE root_id = '{ROOT}' AND coalesce(fingerprint, '') <> '' AND label IS NOT NULL GROUP BY fingerprint),
jd AS (SELECT i.*, CASE WHEN coalesce(root_id <> '{ROOT}', true) THEN 'outside_root' WHEN coalesce(i.fingerprint, '') = '' THEN 'missing_fingerprint' WHEN label IS NULL THEN 'no_label' WHEN labels > 1 THEN 'fingerprint_conflict' WHEN path > first THEN 'fingerprint_duplicate' END AS reason FROM items i LEFT JOIN per USING (fingerprint)),
gr AS (SELECT *, CASE WHEN artist IS NULL THEN id ELSE min(id) OVER (PARTITION BY artist) END AS grp FROM jd WHERE reason IS NULL),
gs AS MATERIALIZED (SELECT grp, count(*) AS n, row_number() OVER (ORDER BY md5('{SEED}:' || grp)) AS rn FROM gr GROUP BY grp),
run AS (SELECT 0::BIGINT AS rn, 0::BIGINT AS dev, 0::BIGINT AS total, NULL::BIGINT AS grp, NULL::VARCHAR AS split
  UNION ALL SELECT gs.rn, CASE WHEN 10 * dev < 7 * (total + n) THEN dev + n ELSE dev END, total + n, gs.grp, CASE WHEN 10 * dev < 7 * (total + n) THEN 'dev' ELSE 'heldout' END FROM run JOIN gs ON gs.rn = run.rn + 1),
ch AS MATERIALIZED (SELECT gr.*, split FROM gr JOIN (SELECT grp, split FROM run WHERE grp IS NOT NULL) USING (grp))"""


@book.query(f"WITH RECURSIVE {COHORT} SELECT id, split FROM ch")
def w9_group_split(t):
    """Whole groups of rows that share an artist or a release, by the running rule."""
    return co.cohort(t.items, ROOT, seed=SEED).where("reject_reason IS NULL").select("id", "split")


@book.query(f"""WITH RECURSIVE {COHORT}, lc AS (SELECT CAST(label AS VARCHAR) AS name, split, count(*) AS n FROM ch GROUP BY ALL)
SELECT 'rejected' AS kind, reason AS name, '' AS split, count(*) AS n FROM jd WHERE reason IS NOT NULL GROUP BY reason
UNION ALL SELECT 'label', name, split, n FROM lc
UNION ALL SELECT 'lacking', name, s, 0 FROM (SELECT DISTINCT name FROM lc), (VALUES ('dev'), ('heldout')) v(s) WHERE (name, s) NOT IN (SELECT name, split FROM lc)
UNION ALL SELECT 'groups', '', split, count(DISTINCT grp) FROM ch GROUP BY split""")
def a27_cohort_diagnostics(t):
    return co.diagnostics(co.cohort(t.items, ROOT, seed=SEED))


def members(t: Tables):
    rows, _ = g.gather(t.items, t.features, dict.fromkeys(g.WEIGHTS, 1.0), tuple(g.WEIGHTS))
    own = co.cohort(t.items, ROOT, seed=SEED).where("reject_reason IS NULL").select("id", "split")
    return rows.join(own, "id").withColumn("label", F.col("label").cast("string"))


_SOURCES = sorted({c for _, w in RECIPES.values() for c in w})
_UNIT = "[x / greatest(sqrt(list_sum([y::DOUBLE * y FOR y IN {0}])), 1e-9) FOR x IN {0}::DOUBLE[]]"
_SCORES = " UNION ALL ".join(f"SELECT '{name}' AS recipe, '{family}' AS family, a, b, round({' + '.join(f'{w / sum(ws.values())!r} * {c}' for c, w in ws.items())}, 6) AS score FROM cs" for name, (family, ws) in RECIPES.items())
_GRID = f"""WITH RECURSIVE {COHORT},
m AS MATERIALIZED (SELECT ch.id, CAST(label AS VARCHAR) AS label, split, nullif(artist, '') AS artist, nullif(release, '') AS release, {', '.join(f"{_UNIT.format(f'{c}.vec')} AS {c}" for c in _SOURCES)}
  FROM ch {' '.join(f"JOIN (SELECT fingerprint, vec FROM features WHERE source = '{c}' AND version = 2 AND len(vec) > 0 AND list_bool_or([x <> 0 FOR x IN vec])) {c} USING (fingerprint)" for c in _SOURCES)}),
cs AS MATERIALIZED (SELECT a.id AS a, b.id AS b, {', '.join(f'list_dot_product(a.{c}, b.{c}) AS {c}' for c in _SOURCES)} FROM m a JOIN m b ON a.id <> b.id),
sc AS ({_SCORES}),
md AS (SELECT recipe, family, 'all' AS mode, a, b, score FROM sc UNION ALL SELECT recipe, family, 'unrelated', a, b, score FROM sc JOIN m x ON x.id = a JOIN m y ON y.id = b WHERE NOT coalesce(x.artist = y.artist, false) AND NOT coalesce(x.release = y.release, false)),
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY recipe, mode, a ORDER BY score DESC, b) AS rank FROM md) WHERE rank <= {K}),
q AS (SELECT recipe, family, mode, x.split, a, x.label, sum((x.label = y.label)::INT) AS hits, count(*) AS k FROM nn JOIN m x ON x.id = a JOIN m y ON y.id = b GROUP BY ALL),
l AS (SELECT recipe, family, mode, split, label, sum(hits) AS hits, sum(k) AS ks, avg(hits / k) AS p, count(*) AS n, min(k) AS lo, max(k) AS hi FROM q GROUP BY ALL),
rp AS (SELECT recipe, family, mode, split, round(sum(hits) / sum(ks), 6) AS micro, round(avg(p), 6) AS macro, CAST(sum(n) AS BIGINT) AS queries, min(lo) AS k_min, max(hi) AS k_max FROM l GROUP BY ALL),
pk AS (SELECT family, recipe FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY macro DESC, recipe) AS r FROM rp WHERE split = 'dev' AND mode = 'all') WHERE r = 1)
SELECT rp.*, 'raw' AS geometry, pk.recipe IS NOT NULL AS picked FROM rp LEFT JOIN pk ON pk.family = rp.family AND pk.recipe = rp.recipe"""


@book.query(_GRID)
def a16_recipe_comparison(t):
    return rt.compare_recipes(members(t), RECIPES, K, pca_dims=None)


@book.query()
def a16_pca_comparison(t):
    """The same with each recipe's PCA geometry beside the raw one; tests hold it against numpy."""
    return rt.compare_recipes(members(t), RECIPES, K, pca_dims=6)
