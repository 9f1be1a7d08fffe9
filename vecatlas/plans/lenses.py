"""What lenses ask for: required sources and completed weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecatlas.operators import gather as g
from vecatlas.plans.book import Book

book = Book()


@book.query("""WITH s AS (SELECT fingerprint, list(DISTINCT source ORDER BY source) AS sources FROM features WHERE version = 2 GROUP BY fingerprint)
SELECT array_to_string(sources, '+') AS lens, CASE WHEN len(sources) = 1 THEN sources[1] ELSE array_to_string(list_filter(sources, lambda x: x IN ('main', 'logits')), '+') END AS required, count(*) AS n FROM s GROUP BY ALL""")
def f9_required_sources(t):
    """The sources that rows have stand for lenses of just these."""
    lens = t.features.where(F.col("version") == g.VERSION).groupBy("fingerprint").agg(F.sort_array(F.collect_set("source")).alias("sources"))
    return lens.select(F.array_join("sources", "+").alias("lens"), F.array_join(g.required_of("sources"), "+").alias("required")).groupBy("lens", "required").agg(F.count("*").alias("n"))


_GIVEN = """SELECT label AS lens, CASE label % 5 WHEN 0 THEN 'main' WHEN 1 THEN 'text' WHEN 2 THEN 'other' ELSE 'rhythm' END AS source, CASE WHEN label = 3 THEN NULL WHEN label = 4 THEN 2.0E0 ELSE CAST(round(avg(id % 10) / 10, 3) AS DOUBLE) END AS weight FROM items WHERE label IS NOT NULL GROUP BY label
UNION ALL SELECT DISTINCT 1000 + label, s, 0.0E0 FROM items CROSS JOIN (SELECT 'main' AS s UNION ALL SELECT 'logits' UNION ALL SELECT 'rhythm' UNION ALL SELECT 'text') x WHERE label < 2"""


@book.query(f"""WITH gv AS ({_GIVEN}), df AS (SELECT * FROM (VALUES ('main', 0.40), ('logits', 0.25), ('rhythm', 0.20), ('text', 0.15)) v(source, dw)),
al AS (SELECT lens, source, weight, true AS given FROM gv UNION ALL SELECT l.lens, df.source, dw, false FROM (SELECT DISTINCT lens FROM gv) l, df WHERE (l.lens, df.source) NOT IN (SELECT lens, source FROM gv))
SELECT lens, source, CAST(weight AS DOUBLE) AS weight, given, CASE WHEN source NOT IN (SELECT source FROM df) THEN 'unknown source' WHEN weight IS NULL OR weight < 0 OR weight > 1 THEN 'not a weight' WHEN max(weight) OVER (PARTITION BY lens) = 0 THEN 'all zero' END AS problem FROM al""")
def f18_completed_weights(t):
    """Labels stand for lenses."""
    return g.completed_weights(t.spark.sql(_GIVEN.replace("FROM items", "FROM {items}"), items=t.items))
