"""Library views derived by SQL from the raw tables, the same in Spark and in DuckDB.

Each view is one SELECT with two dialect marks: ``SL(a,i,j)`` is the slice of an array from i to j (both
counted from 1), ``EL(a,i)`` its i-th element. Views name other views in ``NEEDS``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

_FP = "concat('fp', CAST(vec_id AS VARCHAR(20)))"


def _source(name: str, lo: int, hi: int, gap: int) -> str:
    return f"SELECT '{name}' AS source, {_FP} AS fingerprint, CASE WHEN vec_id % 13 = 0 THEN 1 ELSE 2 END AS version, {hi - lo + 1} AS n_dims, SL(embedding,{lo},{hi}) AS vec FROM embeddings WHERE vec_id % {gap} <> 0"


def _segment(seg: int) -> str:
    return f"SELECT {_FP} AS fingerprint, {seg} AS seg, CASE WHEN (vec_id + {seg}) % 9 = 0 THEN NULL ELSE {0.125 + 0.25 * seg}E0 END AS pos, SL(embedding,{16 * seg + 1},{16 * seg + 16}) AS vec FROM embeddings"


VIEWS: dict[str, str] = {
    "items": f"""SELECT vec_id AS id, concat(folder, '/', lpad(CAST(vec_id AS VARCHAR(20)), 6, '0'), '.dat') AS path,
  folder, root_id, label, artist,
  CASE WHEN artist IS NULL OR vec_id % 7 = 0 THEN NULL ELSE concat(artist, '::b', CAST(vec_id % 5 AS VARCHAR(20))) END AS release,
  CASE WHEN vec_id % 41 = 0 THEN NULL WHEN vec_id % 50 = 1 THEN concat('fp', CAST(vec_id - 1 AS VARCHAR(20))) ELSE {_FP} END AS fingerprint
FROM (SELECT vec_id, label, CASE WHEN label < 8 THEN 'lib' ELSE 'ext' END AS root_id,
    concat(CASE WHEN label < 8 THEN 'lib' ELSE 'ext' END, '/g', CAST(label % 4 AS VARCHAR(20)), '/s', CAST(label AS VARCHAR(20)), CASE WHEN vec_id % 3 = 0 THEN '/deep' ELSE '' END) AS folder,
    CASE WHEN vec_id % 11 = 0 THEN NULL ELSE concat('a', CAST(vec_id % 97 AS VARCHAR(20))) END AS artist
  FROM embeddings) t""",
    "features": " UNION ALL ".join((_source("main", 1, 32, 23), _source("logits", 33, 42, 29), _source("rhythm", 43, 56, 5), _source("text", 57, 64, 7))),
    "segments": " UNION ALL ".join(map(_segment, range(4))),
    "item_features6": f"""SELECT {_FP} AS fingerprint, (CAST(EL(embedding,1) AS DOUBLE) + 1) / 2 AS tempo_norm, cos(2 * pi() * (vec_id % 12) / 12) AS key_cos,
  sin(2 * pi() * (vec_id % 12) / 12) AS key_sin, CAST(vec_id % 2 AS DOUBLE) AS mode, (CAST(EL(embedding,2) AS DOUBLE) + 1) / 2 AS energy, (CAST(EL(embedding,3) AS DOUBLE) + 1) / 2 AS dance FROM embeddings""",
    "tags": "SELECT path, 'energy' AS tag, (id % 101) / 100.0E0 AS value FROM items UNION ALL SELECT path, 'mood' AS tag, (id % 11) / 10.0E0 AS value FROM items WHERE id % 2 = 0",
    "prompts": "SELECT vec_id AS prompt_id, concat('phrase ', CAST(vec_id AS VARCHAR(20))) AS text, SL(embedding,57,64) AS vec FROM embeddings WHERE vec_id < 24",
    "axes": """SELECT a.vec_id AS axis_id, SL(a.embedding,57,64) AS pos_vec, SL(b.embedding,57,64) AS neg_vec, -0.05E0 AS mean, 0.1E0 AS std, 0.5E0 + (a.vec_id % 5) / 2.0E0 AS reliability
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 100 WHERE a.vec_id < 17""",
    "layout_a": "SELECT vec_id AS id, CAST(EL(embedding,1) AS DOUBLE) AS x, CAST(EL(embedding,2) AS DOUBLE) AS y FROM embeddings",
    "layout_b": "SELECT id, cos(0.7E0) * x - sin(0.7E0) * y + 3 AS x, sin(0.7E0) * x + cos(0.7E0) * y - 1 AS y FROM layout_a WHERE id % 4 <> 0",
    "job_log": """SELECT event_id, ts, CASE event_id % 3 WHEN 0 THEN 'features' WHEN 1 THEN 'main' ELSE 'text' END AS kind,
  concat('fp', CAST(user_id AS VARCHAR(20))) AS dedupe_key, event_type <> 'error' AS ok, event_id % 4 <> 0 AS retryable,
  CASE WHEN event_type = 'error' THEN concat('E', CAST(event_id % 6 AS VARCHAR(20))) END AS error FROM events""",
    "series": """SELECT g.id, g.frame, coalesce(v.level, 0) AS level FROM (SELECT i AS id, f AS frame FROM IDS CROSS JOIN FRAMES) g
LEFT JOIN (SELECT user_id % 20 AS id, CAST(floor((SECONDS(ts) - 1704067200) / 3600) AS BIGINT) AS frame, sum(value) AS level FROM events GROUP BY 1, 2) v ON v.id = g.id AND v.frame = g.frame""",
}
NEEDS = {"tags": ["items"], "layout_b": ["layout_a"]}


def _spark(sql: str) -> str:
    sql = re.sub(r"SL\(([\w.]+),(\d+),(\d+)\)", lambda m: f"slice({m[1]},{m[2]},{int(m[3]) - int(m[2]) + 1})", sql)
    sql = re.sub(r"EL\(([\w.]+),(\d+)\)", lambda m: f"{m[1]}[{int(m[2]) - 1}]", sql)
    sql = sql.replace("IDS", "(SELECT explode(sequence(0L,19L)) AS i)").replace("FRAMES", "(SELECT explode(sequence(0L,719L)) AS f)")
    return sql.replace("SECONDS(ts)", "unix_micros(CAST(ts AS TIMESTAMP)) / 1000000")


def _duck(sql: str) -> str:
    sql = re.sub(r"SL\(([\w.]+),(\d+),(\d+)\)", r"\1[\2:\3]", sql)
    sql = re.sub(r"EL\(([\w.]+),(\d+)\)", r"\1[\2]", sql)
    sql = sql.replace("IDS", "(SELECT unnest(range(0,20)) AS i)").replace("FRAMES", "(SELECT unnest(range(0,720)) AS f)")
    return sql.replace("SECONDS(ts)", "epoch(ts)")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A raw table or one of the views, as a plan over Parquet scans."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = _spark(VIEWS[name])
    used = [t for t in [*TABLES, *NEEDS.get(name, [])] if re.search(rf"\b{t}\b", sql)]
    return spark.sql(re.sub(rf"\b(FROM|JOIN) ({'|'.join(used)})\b", r"\1 {\2}", sql.replace("{", "{{").replace("}", "}}")), **{t: view(spark, sf_dir, t) for t in used})


def oracle(sql: str) -> str:
    """DuckDB text of a query over tables and views: the views it names come in front as common tables."""
    names: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in names:
            names.append(name)

    for name in VIEWS:
        if re.search(rf"\b{name}\b", sql):
            add(name)
    ctes = ", ".join(f"{n} AS ({_duck(VIEWS[n])})" for n in names)
    sql = sql.strip()
    if not ctes:
        return sql
    recursive = sql.upper().startswith("WITH RECURSIVE")
    body = re.sub(r"^WITH (RECURSIVE )?", ", ", sql, flags=re.I) if re.match(r"WITH ", sql, flags=re.I) else f" {sql}"
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}{body}"
