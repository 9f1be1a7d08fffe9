"""Reads, upserts and reports on the feature store and the library tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def presence(features: DataFrame, sources: list[str], version: int = 2) -> DataFrame:
    """A boolean per fingerprint and source, from the stored widths: no vector is read."""
    return features.where(F.col("version") == version).groupBy("fingerprint").pivot("source", sources).agg(F.max(F.col("n_dims") > 0)).na.fill(False, sources)


def counts(features: DataFrame) -> DataFrame:
    return features.where("n_dims > 0").groupBy("source", "version").agg(F.countDistinct("fingerprint").alias("n_rows"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The last row of each key by order; new rows win over old ones of the same order."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(order.desc(), F.desc("__new"))
    return both.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn", "__new")


def upsert_family(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Members that the new row leaves out keep their old value."""
    o, n = old.alias("o"), new.alias("n")
    met = F.lit(True)
    for k in keys:
        met = met & (F.col(f"o.{k}") == F.col(f"n.{k}"))
    return o.join(n, met, "full").select(*(F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in old.columns))


def purge_old(features: DataFrame, sources: list[str], version: int) -> tuple[DataFrame, DataFrame]:
    """The rows to keep, and the number of others by source."""
    old = F.col("source").isin(sources) & (F.col("version") < version)
    return features.where(~old), features.where(old).groupBy("source").agg(F.count("*").alias("n_purged"))


def reconcile(features: DataFrame, meta: DataFrame, given: DataFrame) -> DataFrame:
    """Rows of the sources whose recorded identity (source, identity) equals the given one; both are tables with a row per source."""
    same = meta.join(given, ["source", "identity"]).select("source")
    return features.join(F.broadcast(same), "source", "left_semi")


def prune(table: DataFrame, scan: DataFrame, key: str = "path") -> tuple[DataFrame, DataFrame]:
    """The rows still in the scan, and those gone."""
    return table.join(scan.select(key), key, "left_semi"), table.join(scan.select(key), key, "left_anti")


def remap_prefix(table: DataFrame, old: str, new: str, column: str = "path") -> DataFrame:
    """A folder renamed: the prefix is literal, so % and _ mean themselves."""
    inside = (F.col(column) == old) | F.startswith(F.col(column), F.lit(old.rstrip("/") + "/"))
    return table.withColumn(column, F.when(inside, F.concat(F.lit(new), F.substring(column, len(old) + 1, 1 << 30))).otherwise(F.col(column)))


def remap_many(table: DataFrame, renames: DataFrame, column: str = "path") -> DataFrame:
    """Many renames (old, new) at once; the longest prefix wins. Each path meets its own ancestors only."""
    parts = F.split(column, "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    found = table.select(column, F.explode(prefixes).alias("old")).distinct().join(renames, "old").groupBy(column).agg(F.max_by(F.struct("old", "new"), F.length("old")).alias("r"))
    out = table.join(found, column, "left")
    return out.withColumn(column, F.when(F.col("r").isNotNull(), F.expr(f"concat(r.new, substring({column}, length(r.old) + 1))")).otherwise(F.col(column))).drop("r")


def signature(df: DataFrame, columns: list[str]) -> DataFrame:
    """One digest of a set of rows whatever their order: of their number and four sums of 60 bits each of their SHA-256, so nothing is gathered. A null counts as a tilde."""
    row = F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns)), 256)
    part = lambda k: F.sum(F.conv(F.substring("h", 1 + 15 * k, 15), 16, 10).cast("decimal(20,0)"))
    sums = df.select(row.alias("h")).agg(F.count("*").alias("n"), *(F.coalesce(part(k), F.lit(0)).cast("decimal(38,0)").alias(f"s{k}") for k in range(4)))
    return sums.select(F.sha2(F.concat_ws("|", *(F.col(c).cast("string") for c in ("n", "s0", "s1", "s2", "s3"))), 256).alias("signature"))


def latest_batch(journal: DataFrame) -> DataFrame:
    """Rows of the latest batch that no row marks as undone."""
    last = journal.groupBy("batch_id").agg(F.max("created").alias("created"), F.max("undone").alias("undone")).where(~F.col("undone")).orderBy(F.desc("created"), F.desc("batch_id")).limit(1)
    return journal.join(F.broadcast(last.select("batch_id")), "batch_id", "left_semi")


def retain(table: DataFrame, revision: str, created: str, n: int) -> DataFrame:
    """Rows of the n newest revisions."""
    newest = table.groupBy(revision).agg(F.max(created).alias(created)).orderBy(F.desc(created), F.desc(revision)).limit(n)
    return table.join(F.broadcast(newest.select(revision)), revision, "left_semi")


def merge_tags(tags: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tags after changes (path, tag, value, seq): the last change of a key counts, values are held within 0 and 1, null deletes. Changes without path or tag, or of NaN, are returned apart."""
    good = F.col("path").isNotNull() & (F.trim(F.coalesce("tag", F.lit(""))) != "") & ~F.coalesce(F.isnan("value"), F.lit(False))
    last = changes.where(good).groupBy("path", "tag").agg(F.max_by(F.struct("value"), "seq").alias("c"))
    both = tags.join(last, ["path", "tag"], "full")
    out = both.select("path", "tag", F.when(F.col("c").isNull(), F.col("value")).otherwise(F.least(F.greatest(F.col("c.value"), F.lit(0.0)), F.lit(1.0))).alias("value"), (F.col("c").isNotNull() & F.col("c.value").isNull()).alias("gone"))
    return out.where(~F.col("gone")).drop("gone"), changes.where(~good)


def rename_tag(tags: DataFrame, old: str, new: str, inside: Column) -> DataFrame:
    """Rename over a scope; an existing target is replaced."""
    moved = tags.where(inside & (F.col("tag") == old)).withColumn("tag", F.lit(new))
    rest = tags.where(~(inside & (F.col("tag") == old)))
    return rest.join(moved.select("path", "tag"), ["path", "tag"], "left_anti").unionByName(moved)


def missing_work(items: DataFrame, features: DataFrame, sources: list[str], version: int = 2) -> DataFrame:
    """(fingerprint, missing): sources in their given order that a known fingerprint lacks at the version."""
    have = features.where((F.col("version") == version) & (F.col("n_dims") > 0)).select("fingerprint", "source")
    wanted = items.where("fingerprint IS NOT NULL").select("fingerprint").distinct().withColumn("w", F.explode(F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(s).alias("source")) for i, s in enumerate(sources))))).select("fingerprint", "w.*")
    gone = wanted.join(have, ["fingerprint", "source"], "left_anti")
    return gone.groupBy("fingerprint").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "source"))), lambda x: x["source"]), ",").alias("missing"))


def coverage(items: DataFrame, features: DataFrame, failed: DataFrame, sources: list[str], version: int = 2) -> DataFrame:
    """Per source: total and fingerprinted rows, done, failed (without a vector) and pending. Rows count, not fingerprints."""
    have = presence(features, sources, version)
    lost = failed.groupBy("fingerprint").pivot("source", sources).agg(F.lit(True)).na.fill(False, sources)
    both = items.select("fingerprint").join(have, "fingerprint", "left").join(lost.select("fingerprint", *(F.col(s).alias(f"f_{s}") for s in sources)), "fingerprint", "left")
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    sums = both.agg(F.count("*").alias("total"), F.count("fingerprint").alias("fingerprinted"), *(n(F.col(s)).alias(s) for s in sources), *(n(F.col(f"f_{s}") & ~F.coalesce(s, F.lit(False))).alias(f"f_{s}") for s in sources))
    rows = F.explode(F.array(*(F.struct(F.lit(s).alias("source"), F.col(s).alias("done"), F.col(f"f_{s}").alias("failed")) for s in sources)))
    out = sums.select("total", "fingerprinted", rows.alias("r")).select("total", "fingerprinted", "r.*")
    return out.withColumn("pending", F.greatest(F.lit(0), F.col("fingerprinted") - F.col("done") - F.col("failed")))


def readiness(items: DataFrame, features: DataFrame, sources: list[str], version: int = 2) -> DataFrame:
    """Fingerprints that have all sources against all rows; ready when they are as many."""
    full = features.where(F.col("source").isin(sources) & (F.col("version") == version) & (F.col("n_dims") > 0)).groupBy("fingerprint").agg(F.countDistinct("source").alias("n")).where(F.col("n") == len(sources))
    done = items.select("fingerprint").join(full, "fingerprint", "left_semi").agg(F.countDistinct("fingerprint").alias("analysed"))
    total = items.agg(F.count("*").alias("total"))
    # two frames of one row each
    return total.withColumn("k", F.lit(1)).join(done.withColumn("k", F.lit(1)), "k").select("total", "analysed", ((F.col("total") > 0) & (F.col("analysed") == F.col("total"))).alias("ready"))
