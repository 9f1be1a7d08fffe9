"""Array arithmetic on vector columns, summed in double precision."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: str, b: str) -> Column:
    """Inner product of two array columns."""
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), CAST(0 AS DOUBLE), (s, v) -> s + v)")


def norm(a: str) -> Column:
    return F.sqrt(dot(a, a))


def scaled(a: str, factor: str) -> Column:
    return F.expr(f"transform({a}, x -> CAST(x AS DOUBLE) * {factor})")


def unit(df, column: str, out: str, floor: float = 1e-9):
    """df with out = column over its length; the length is a column of its own, else it would be computed for each element."""
    return df.withColumn("__n", F.greatest(norm(column), F.lit(floor))).withColumn(out, F.expr(f"transform({column}, x -> CAST(x AS DOUBLE) / __n)")).drop("__n")


def is_valid(a: str) -> Column:
    """Finite everywhere and not all zero."""
    return F.expr(f"forall({a}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists({a}, x -> x <> 0)")


def normal_cdf(z: str) -> Column:
    """The normal distribution function by the five-term polynomial of Zelen and Severo (error below 7.5e-8)."""
    t = f"(1 / (1 + 0.2316419 * abs({z})))"
    poly = f"{t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429))))"
    tail = f"exp(-{z} * {z} / 2) / {math.sqrt(2 * math.pi)!r} * {poly}"
    return F.expr(f"CASE WHEN {z} >= 0 THEN 1 - {tail} ELSE {tail} END")
