"""Aligned source blocks and weighted composites."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecatlas.functions.vectors import unit

# The weights of the library's sources and the sources that every row must have.
WEIGHTS = {"main": 0.40, "logits": 0.25, "rhythm": 0.20, "text": 0.15}
REQUIRED = ("main", "logits")
VERSION = 2


def complete_weights(given: dict[str, float] | None, defaults: dict[str, float] = WEIGHTS) -> dict[str, float]:
    """Weights with defaults for missing keys; each within 0 and 1 (no NaN), not all zero, no unknown key."""
    given = given or {}
    if unknown := set(given) - set(defaults):
        raise ValueError(f"unknown sources: {sorted(unknown)}")
    out = {k: float(given.get(k, v)) for k, v in defaults.items()}
    if any(not 0 <= v <= 1 for v in out.values()) or not any(out.values()):
        raise ValueError("weights must lie within 0 and 1 and not all be 0")
    return out


def required_sources(sources: list[str], pair: tuple[str, ...] = REQUIRED) -> list[str]:
    """A single source requires itself; several require those of the pair that are among them."""
    if not sources:
        raise ValueError("no source")
    if len(sources) == 1:
        return list(sources)
    return [s for s in pair if s in sources]


def read_features(features: DataFrame, source: str, version: int = VERSION) -> DataFrame:
    """(fingerprint, vec) of one source at one version; empty vectors are absent."""
    return features.where((F.col("source") == source) & (F.col("version") == version) & (F.size("vec") > 0)).select("fingerprint", "vec")


def widths(features: DataFrame, sources: list[str], version: int = VERSION) -> dict[str, int]:
    """Width of each source whose vectors all have one; others are left out. Reads the stored widths only."""
    rows = features.where(F.col("source").isin(sources) & (F.col("version") == version)).groupBy("source").agg(F.min("n_dims").alias("lo"), F.max("n_dims").alias("hi")).collect()
    return {r["source"]: r["lo"] for r in rows if r["lo"] == r["hi"] and r["lo"] > 0}


def gather(items: DataFrame, features: DataFrame, weights: dict[str, float] = WEIGHTS, required: tuple[str, ...] = REQUIRED, version: int = VERSION) -> tuple[DataFrame, list[str]]:
    """Items with a column per source: inner joins for the required ones first, zero vectors for what else is missing. Sources without weight are never read."""
    wanted = [s for s, w in weights.items() if w > 0]
    dims = widths(features, wanted, version)
    used = [s for s in wanted if s in dims]
    out = items
    for s in sorted(used, key=lambda s: s not in required):
        block = read_features(features, s, version).withColumnRenamed("vec", s)
        out = out.join(block, "fingerprint", "inner" if s in required else "left")
        if s not in required:
            out = out.withColumn(s, F.coalesce(F.col(s), F.array_repeat(F.lit(0.0).cast("float"), dims[s])))
    return out, used


def statistics(df: DataFrame, columns: list[str]) -> dict[str, tuple[list[float], list[float]]]:
    """Mean and population deviation of each dimension of each column in one job: as many numbers as the vectors are wide."""
    tagged = F.concat(*(F.expr(f"transform({c}, (x, i) -> struct({k} AS s, i AS d, CAST(x AS DOUBLE) AS x))") for k, c in enumerate(columns)))
    rows = df.select(F.explode(tagged).alias("e")).groupBy("e.s", "e.d").agg(F.avg("e.x").alias("mu"), F.stddev_pop("e.x").alias("sd")).orderBy("s", "d").collect()
    return {c: ([r["mu"] for r in rows if r["s"] == k], [1.0 if r["sd"] < 1e-9 else r["sd"] for r in rows if r["s"] == k]) for k, c in enumerate(columns)}


def standardize(df: DataFrame, columns: list[str]) -> DataFrame:
    for column, (mu, sd) in statistics(df, columns).items():
        if mu:
            moments = f"arrays_zip(array({','.join(f'{m!r}D' for m in mu)}), array({','.join(f'{s!r}D' for s in sd)}))"
            df = df.withColumn(column, F.expr(f"zip_with({column}, {moments}, (x, m) -> (CAST(x AS DOUBLE) - m['0']) / m['1'])"))
    return df


def composite(df: DataFrame, used: list[str], weights: dict[str, float] = WEIGHTS, *, standard: bool = True, out: str = "vec") -> DataFrame:
    """df with out = the unit source blocks times the roots of their weights, one after the other; so squared distances add up by weight. Blocks are standardised first, or taken as they are."""
    if standard:
        df = standardize(df, used)
    for s in used:
        df = unit(df, s, s)
        df = df.withColumn(s, F.expr(f"transform({s}, x -> x * {math.sqrt(weights[s])!r}D)"))
    return df.withColumn(out, F.concat(*used)).drop(*used)


def composite_strict(df: DataFrame, used: list[str], weights: dict[str, float]) -> tuple[DataFrame, DataFrame]:
    """Weights add to 1 and sources come in name order; rows with a zero or unfinished block are returned apart."""
    from vecatlas.functions.vectors import is_valid

    total = sum(weights[s] for s in used)
    share = {s: weights[s] / total for s in used}
    good = F.lit(True)
    for s in used:
        good = good & is_valid(s)
    return composite(df.where(good), sorted(used), share, standard=False), df.where(~good)


def required_of(sources: str, pair: tuple[str, ...] = REQUIRED) -> Column:
    """:func:`required_sources` of an array column, sorted; null for a null or empty one."""
    several = F.array_intersect(F.sort_array(sources), F.array(*map(F.lit, sorted(pair))))
    return F.when(F.size(sources) == 1, F.col(sources)).when(F.size(sources) > 1, several)


def completed_weights(given: DataFrame, defaults: dict[str, float] = WEIGHTS) -> DataFrame:
    """(lens, source, weight, given, problem) of weight maps (lens, source, weight): every default source that a lens leaves out comes in with its default.

    problem is null, or for a row "unknown source", "not a weight" (null, NaN, or outside 0 to 1), or, for a lens all of whose weights are 0, "all zero".
    """
    base = given.sparkSession.createDataFrame(sorted(defaults.items()), "source string, default double")  # a row per source of the library
    lenses = given.select("lens").distinct().select("lens", F.explode(F.array(*map(F.lit, sorted(defaults)))).alias("source"))
    own = given.select("lens", "source", F.col("weight").cast("double").alias("weight"), F.lit(True).alias("given"))
    both = lenses.join(own, ["lens", "source"], "full").join(F.broadcast(base), "source", "left")
    both = both.withColumn("weight", F.when(F.col("given"), F.col("weight")).otherwise(F.col("default")))
    most = F.max("weight").over(Window.partitionBy("lens"))
    fits = F.coalesce(~F.isnan("weight") & F.col("weight").between(0, 1), F.lit(False))
    problem = F.when(F.col("default").isNull(), "unknown source").when(~fits, "not a weight").when(most == 0, "all zero")
    return both.select("lens", "source", "weight", F.coalesce("given", F.lit(False)).alias("given"), problem.alias("problem"))
