"""Paths, folders and names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parent(path: str) -> Column:
    """Leaf folder; empty for a path without a slash."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(F.col(path), "/[^/]*$", "")).otherwise(F.lit(""))


def ancestors(folder: str) -> Column:
    """A folder and all above it, shortest first."""
    p = F.split(folder, "/")
    return F.when(F.length(folder) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, F.lit(1), i), "/")))


def root(folder: str) -> Column:
    return F.substring_index(F.col(folder), "/", 1)


def below_root(folder: str) -> Column:
    return F.when(F.instr(folder, "/") > 0, F.regexp_replace(F.col(folder), "^[^/]*/", "")).otherwise(F.lit(""))


def climb(folder: str, levels: int) -> Column:
    """The folder so many levels up, but never above its root."""
    p = F.split(folder, "/")
    return F.array_join(F.slice(p, F.lit(1), F.greatest(F.lit(1), F.size(p) - levels)), "/")


def in_subtree(folder: str, prefix: str) -> Column:
    if not prefix:
        return F.lit(True)
    return (F.col(folder) == prefix) | F.startswith(F.col(folder), F.lit(prefix + "/"))


def virtual_paths(files: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, virtual) by the longest root (root_id, root) above the path, and the paths under no root. A path meets its own ancestors only."""
    each = files.select("path", F.explode(ancestors("path")).alias("root")).join(roots, "root").groupBy("path").agg(F.max_by(F.struct("root", "root_id"), F.length("root")).alias("r"))
    found = each.select("path", F.expr("concat(r.root_id, substring(path, length(r.root) + 1))").alias("virtual"))
    return found, files.join(found, "path", "left_anti")


def maximal_roots(roots: DataFrame) -> DataFrame:
    """(root, root_id): roots that no other root covers, with the first 8 hex digits of their SHA-1 as id; a clash gets a number."""
    from pyspark.sql import Window

    r = roots.select("root").distinct()
    above = r.select("root", F.explode(F.slice(ancestors("root"), F.lit(1), F.greatest(F.lit(0), F.size(F.split("root", "/")) - 1))).alias("up"))
    covered = above.join(r.withColumnRenamed("root", "up"), "up").select("root")
    top = r.join(covered, "root", "left_anti").withColumn("id", F.substring(F.sha1("root"), 1, 8))
    w = Window.partitionBy("id").orderBy("root")
    return top.withColumn("n", F.row_number().over(w)).select("root", F.when(F.col("n") == 1, F.col("id")).otherwise(F.concat_ws("-", "id", "n")).alias("root_id"))


def resolve(path: str) -> Column:
    """A path without . and .. parts; null where .. climbs above its first part."""
    start = "CAST(array() AS ARRAY<STRING>)"
    return F.expr(
        f"aggregate(split({path}, '/'), named_struct('p', {start}, 'ok', true), (s, x) -> CASE WHEN x IN ('', '.') THEN s "
        "WHEN x = '..' THEN named_struct('p', slice(s.p, 1, greatest(0, size(s.p) - 1)), 'ok', s.ok AND size(s.p) > 1) ELSE named_struct('p', concat(s.p, array(x)), 'ok', s.ok) END, "
        "s -> CASE WHEN s.ok AND size(s.p) > 0 THEN array_join(s.p, '/') END)"
    )


def folder_tree(items: DataFrame) -> DataFrame:
    """(path, name, root_id, n_items, children): every folder above an item; names that begin with a dot are left out with all below."""
    seeds = items.select("folder").where(~F.col("folder").rlike(r"(^|/)\.")).groupBy("folder").agg(F.count("*").alias("n"))
    nodes = seeds.select(F.explode(ancestors("folder")).alias("path"), "n").groupBy("path").agg(F.sum("n").alias("n_items"))
    kids = nodes.where(F.instr("path", "/") > 0).select(F.regexp_replace("path", "/[^/]*$", "").alias("path"), F.substring_index("path", "/", -1).alias("name")).groupBy("path").agg(F.array_join(F.sort_array(F.collect_set("name")), ",").alias("children"))
    return nodes.join(kids, "path", "left").select("path", F.substring_index("path", "/", -1).alias("name"), root("path").alias("root_id"), "n_items", F.coalesce("children", F.lit("")).alias("children"))


def safe_component(name: str) -> Column:
    """A name fit for a folder: signs that paths can't hold become _, outer blanks and dots go."""
    return F.btrim(F.regexp_replace(F.col(name), r'[<>:"/\\|?*]', "_"), F.lit(" ."))


def folder_hash(path: str) -> Column:
    """Rolling hash h = 31 h + code point, of 18 bits."""
    return F.expr(f"aggregate(filter(split({path}, ''), c -> c <> ''), 0L, (h, c) -> (h * 31 + ascii(c)) & 262143)")
