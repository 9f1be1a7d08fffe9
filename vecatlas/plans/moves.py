"""Sort plans with their journal, undo and origin memory (M20, S18); components of folders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecatlas.operators import moves as mv
from vecatlas.operators import plans_and_moves as pm
from vecatlas.plans.book import Book, Tables
from vecatlas.plans.scoring import rows

book = Book()

# Rows of few names, some numbered with gaps; a third each with a class, with a style, with neither.
_SHELF = """SELECT id, CASE WHEN k = 1 THEN concat(folder, '/t', CAST(id % 7 AS VARCHAR(9)), '.dat') ELSE concat(folder, '/t', CAST(id % 7 AS VARCHAR(9)), ' (', CAST(k + k / 4 AS INT), ').dat') END AS path, fingerprint,
  coalesce(artist IS NOT NULL AND label % 3 <> 1, false) AS is_match, concat('lib/g', CAST(label % 4 AS VARCHAR(9)), '/m', CAST(label % 2 AS VARCHAR(9))) AS class, CASE WHEN id % 3 > 0 THEN concat('Gen:re---', CAST(label % 3 AS VARCHAR(9)), ' .---x') END AS style
FROM (SELECT *, row_number() OVER (PARTITION BY folder, id % 7 ORDER BY id) AS k FROM items) n"""
_PLAN = f"""sh AS MATERIALIZED ({_SHELF.replace("k + k / 4 AS INT", "k + k // 4 AS INT")}),
fo AS (SELECT *, CASE WHEN is_match THEN regexp_replace(class, '^[^/]*/', '') WHEN style IS NOT NULL THEN concat('Gen_re/', label3, '/x') END AS folder, regexp_replace(path, '/[^/]*$', '') AS own FROM (SELECT *, regexp_extract(style, '---([0-9]+)', 1) AS label3 FROM sh)),
pl AS (SELECT *, concat(split_part(path, '/', 1), '/', folder) AS place, CASE WHEN folder IS NULL THEN 'unmatched' WHEN own = concat(split_part(path, '/', 1), '/', folder) THEN 'in-place' WHEN is_match THEN 'class' ELSE 'style' END AS reason FROM fo),
cl AS (SELECT id, path, concat(place, '/', regexp_extract(path, '[^/]*$')) AS raw FROM pl WHERE reason IN ('class', 'style')),
tk AS (SELECT raw, list(k) AS ks FROM (SELECT path AS raw, 0 AS k FROM sh UNION SELECT regexp_replace(path, ' \\([0-9]+\\)\\.dat$', '.dat'), CAST(regexp_extract(path, '\\(([0-9]+)\\)\\.dat$', 1) AS INT) FROM (SELECT path FROM sh UNION ALL SELECT raw FROM cl) WHERE path LIKE '%).dat') GROUP BY raw),
rk AS (SELECT *, row_number() OVER (PARTITION BY raw ORDER BY path, id) AS i FROM cl),
nm AS (SELECT id, raw, list_filter(range(0, i + coalesce(len(ks), 0) + 1), lambda x: NOT list_contains(coalesce(ks, []), x))[i] AS n FROM rk LEFT JOIN tk USING (raw)),
fp AS MATERIALIZED (SELECT pl.id, path AS source, CASE WHEN nm.id IS NULL THEN path WHEN n = 0 THEN raw ELSE concat(raw[:-5], ' (', n, ').dat') END AS target, reason, fingerprint FROM pl LEFT JOIN nm USING (id))"""


def shelf(t: Tables) -> DataFrame:
    return t.spark.sql(_SHELF.replace("k + k / 4 AS INT", "k + k div 4 AS INT").replace("FROM items", "FROM {items}"), items=t.items)


def plan(t: Tables) -> tuple[DataFrame, DataFrame]:
    s = shelf(t)
    return s, mv.sort_plan(s, s.where("style IS NOT NULL"))


@book.query(f"WITH {_PLAN} SELECT id, source, target, reason FROM fp")
def m20_sort_plan(t):
    return plan(t)[1]


@book.query(f"""WITH {_PLAN}, a AS (SELECT source, target, regexp_replace(source, '/[^/]*$', '') AS s, regexp_replace(target, '/[^/]*$', '') AS d FROM fp),
up AS (SELECT DISTINCT unnest([array_to_string(string_split(s, '/')[1:i], '/') FOR i IN range(1, len(string_split(s, '/')) + 1)]) AS f FROM a), dn AS (SELECT DISTINCT unnest([array_to_string(string_split(d, '/')[1:i], '/') FOR i IN range(1, len(string_split(d, '/')) + 1)]) AS f FROM a)
SELECT reason AS what, count(*) AS n FROM fp GROUP BY reason UNION ALL SELECT 'emptied', count(*) FROM up WHERE f NOT IN (SELECT f FROM dn)""")
def m20_plan_counts(t):
    return mv.counts(plan(t)[1])


def journalled(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The shelf, its plan and the journal after the plan was applied, undone and applied again."""
    s, p = plan(t)
    first = mv.moves_of(p, s, "b1", 1)
    there = mv.applied(s, p)
    back, _, journal = mv.undone(there, first, 2)
    again = mv.sort_plan(back, back.where("style IS NOT NULL"))
    return back, again, journal.unionByName(mv.moves_of(again, back, "b2", 3))


@book.query(f"WITH {_PLAN} SELECT 'b2' AS batch_id, fingerprint, source, target FROM fp WHERE source <> target")
def s18_latest_batch(t):
    """Of a plan that was applied, undone and applied again; it is the first plan."""
    return mv.latest_batch(journalled(t)[2]).where("source IS NOT NULL").select("batch_id", "fingerprint", "source", "target")


@book.query(f"WITH {_PLAN} SELECT fingerprint, min(regexp_replace(regexp_replace(source, '^[^/]*/', ''), '/?[^/]*$', '')) AS origin, 3 AS recorded FROM fp WHERE source <> target AND fingerprint IS NOT NULL GROUP BY fingerprint")
def s18_origins(t):
    journal = journalled(t)[2]
    return mv.remembered(t.spark.createDataFrame([], "fingerprint string, origin string, recorded long"), journal)


_THIN = "SELECT unnest([array_to_string(string_split(folder, '/')[1:i], '/') FOR i IN range(1, len(string_split(folder, '/')) + 1)]) AS node FROM w"


@book.query(f"WITH w AS (SELECT concat(folder, '/r', id % 400) AS folder FROM items), a AS ({_THIN}) SELECT node, regexp_extract(node, '[^/]*$') AS name, count(*) AS n, len(string_split(node, '/')) - 1 AS exponent FROM a WHERE node LIKE '%/%' GROUP BY node HAVING count(*) < 2")
def m15_thin_folders(t):
    finer = t.items.select(F.concat("folder", F.lit("/r"), (F.col("id") % 400).cast("string")).alias("folder"))
    return pm.thin_folders(finer).select("node", "name", "n", F.col("exponent").cast("long").alias("exponent"))


@book.query()
def m15_folder_components(t):
    """Within-folder components; tests hold them against numpy."""
    r = rows(t)
    return pm.folder_components(r, pm.folder_directions(r))
