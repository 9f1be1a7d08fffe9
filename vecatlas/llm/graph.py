"""Links from shared buckets and their connected components, as joins and partial aggregates."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecatlas.llm.common import attach, frugal, semi, stash
from vecatlas.llm.shingles import mix
from vecatlas.operators.graph import components

ORDER_BITS = 18


@dataclass(frozen=True)
class Overlap:
    """What two texts must have in common to be a link.

    elements() gives a task its function from a text to its distinct 64-bit elements; need(small, large), of two sizes (numbers or columns), is the least overlap of a link and must not
    fall as large grows; least(size) is the least overlap of a link with any text that is no larger.
    """

    elements: Callable[[], Callable[[bytes], np.ndarray]]
    need: Callable
    least: Callable[[float], float]


def numbered(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A multiset as a set: the second occurrence is another element than the first."""
    turn = np.concatenate([np.arange(k) for k in counts]) if len(counts) else np.zeros(0)
    with np.errstate(over="ignore"):
        return mix(np.repeat(hashes, counts) + turn.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _bucket(elements: np.ndarray) -> np.ndarray:
    return (elements >> np.uint64(64 - ORDER_BITS)).astype(np.int64)


def _few(batches):
    """Batches of texts whose elements fit in memory side by side."""
    return (b.slice(at, 200) for b in batches for at in range(0, b.num_rows, 200))


def meetings(texts: DataFrame, labels: DataFrame, how: Overlap) -> DataFrame:
    """All pairs (a, b) of different label that can be links: an exact prefix filter.

    All elements stand in one order, the rarest first. Two rows of a link share so many that their first shared one stands early in both, so a row is filed under
    its first elements only; a pair is met where fewer elements than it needs stand before its first shared one. Frequent elements stand last, and what a large group of loosely
    alike rows has in common is filed by few of them. The order only has to be the same everywhere: it follows counts of 2^18 hashed buckets, whatever the size of the input.

    texts is (row, text), labels (row, label); both are stored tables.
    """
    spark = texts.sparkSession
    own = semi(texts, labels.select("row"), "row")

    def counted(batches):
        elements = how.elements()
        for batch in _few(batches):
            parts = [_bucket(elements(t)) for t in batch.column(0).to_pylist()]
            kinds, n = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(n.astype(np.int64))], ["bucket", "n"])

    seen = own.select("text").mapInArrow(frugal(counted), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    order = np.zeros(1 << ORDER_BITS, dtype=np.int64)
    order[seen["bucket"].to_numpy()] = seen["n"].to_numpy()
    known = spark.sparkContext.broadcast(order)

    def first_ones(batches):
        elements = how.elements()
        for batch in _few(batches):
            out: tuple[list, ...] = ([], [], [], [], [])
            for row, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                e = elements(text)
                often, size = known.value[_bucket(e)], len(e)
                ranked = np.lexsort((e, often))
                n = max(0, min(size, int(size - how.least(size) + 1e-6) + 1))
                place = np.flatnonzero(often[ranked[:n]] > 1)  # what one row has is met by none
                for column, value in zip(out, (e[ranked[place]].astype(np.int64), np.full(len(place), row), np.full(len(place), size), place, place <= size - how.need(size, size) + 1e-6), strict=True):
                    column.append(value)
            arrays = [np.concatenate(c) if c else np.zeros(0) for c in out]
            yield pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in zip(arrays, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], ["element", "row", "size", "place", "early"])

    filed = attach(own.select("row", "text").mapInArrow(frugal(first_ones), "element long, row long, size long, place long, early boolean"), labels, "row")
    filed = stash(filed, "filed")
    side = lambda k: filed.select("element", *(F.col(c).alias(f"{c}_{k}") for c in ("row", "label", "size", "place", "early")))
    left = F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b"))
    fits = (F.col("label_a") != F.col("label_b")) & (F.struct("size_a", "row_a") < F.struct("size_b", "row_b")) & (left >= how.need(F.col("size_a"), F.col("size_b")) - 1e-6)
    x, y = side("a").where("early_a"), side("b")
    return x.join(y, (x["element"] == y["element"]) & fits).select(F.col("row_a").alias("a"), F.col("row_b").alias("b")).distinct()


def linked(places: DataFrame, texts: DataFrame, link: Callable[[DataFrame, str], DataFrame], how: Overlap) -> DataFrame:
    """(v, label) of the rows that links join, from their places (row, band) in buckets and their texts (row, text).

    link(pairs, name) returns those of the pairs (a, b) that are links, as a stored table. First every row of a bucket is tried
    with one leader, the member with the most bucket mates: no more pairs than places, however large a bucket is. Rows of buckets
    that the links so far leave in different components then meet by :func:`meetings`, so no link between components is lost.
    """
    mates = places.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    shared = stash(places.join(mates, "band"), "shared-bands")
    degree = shared.groupBy("row").agg(F.sum("n").alias("degree"))
    leaders = shared.join(degree, "row").groupBy("band").agg(F.max(F.struct("degree", (-F.col("row")).alias("back"))).alias("top")).select("band", (-F.col("top.back")).alias("b"))
    pairs = stash(shared.select("band", F.col("row").alias("a")).join(leaders, "band").where("a <> b").select("a", "b").distinct(), "pairs")
    links = link(pairs, "led")
    labels = components(links)
    placed = shared.select("band", "row").join(labels.withColumnRenamed("v", "row"), "row", "left").select("band", "row", F.coalesce("label", "row").alias("label"))
    open_ = placed.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("band")
    apart = stash(placed.join(open_, "band", "left_semi").select("row", "label").distinct(), "apart")
    if apart.isEmpty():
        return labels
    tried = pairs.union(pairs.select("b", "a"))
    more = link(stash(meetings(texts, apart, how).join(tried, ["a", "b"], "left_anti"), "meetings"), "apart")
    return labels if more.isEmpty() else components(links.union(more))

