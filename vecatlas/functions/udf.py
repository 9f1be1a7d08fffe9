"""User functions over batches of rows."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def apply_encoder(df: DataFrame, encode: Callable[[list], list], column: str, *, batch_size: int = 256, retryable: tuple[type[Exception], ...] = (OSError, TimeoutError)) -> DataFrame:
    """(id, vec, ok, error, retryable): encode turns a list of values into as many vectors. A batch that fails is tried value by value, so an error marks its own rows only."""

    def one(values: list) -> list[tuple]:
        try:
            got = encode(values)
            if len(got) != len(values):
                raise ValueError(f"{len(got)} results for {len(values)} values")
            return [(list(map(float, v)), True, None, False) for v in got]
        except Exception as e:  # noqa: BLE001  the contract turns any error of a user's function into a row
            if len(values) > 1:
                return [r for v in values for r in one([v])]
            return [(None, False, str(e)[:2000], isinstance(e, retryable))]

    def run(frames):
        for f in frames:
            rows = [r for lo in range(0, len(f), batch_size) for r in one(f[column].tolist()[lo : lo + batch_size])]
            yield pd.DataFrame({"id": f["id"], "vec": [r[0] for r in rows], "ok": [r[1] for r in rows], "error": [r[2] for r in rows], "retryable": [r[3] for r in rows]})

    return df.select("id", column).mapInPandas(run, "id long, vec array<double>, ok boolean, error string, retryable boolean")


def embedded(df: DataFrame, encode: Callable[[list], list] | None, column: str, **options) -> DataFrame:
    """(id, vec) by a user's function; without one (it is not available) and for rows on which it fails vec is null."""
    if encode is None:
        return df.select("id", F.lit(None).cast("array<double>").alias("vec"))
    return apply_encoder(df, encode, column, **options).select("id", "vec")


def payload(items: DataFrame, features: DataFrame, *, display: dict[str, Callable[[DataFrame], Column]], on: str = "fingerprint") -> DataFrame:
    """Items with a column for each callback, which makes a column expression from items joined to their features; so the plan stays visible to the optimiser."""
    both = items.join(features, on, "left")
    return both.select(*items.columns, *(f(both).alias(name) for name, f in display.items()))
