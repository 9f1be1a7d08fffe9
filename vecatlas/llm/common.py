"""What the text operators share: bounded samples and document columns, beside the library's scratch tables."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecatlas.sources.scratch import folder, scratch, stash  # noqa: F401


def documents(docs: DataFrame, id_col: str | None = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with null texts as empty ones; whatever else the frame holds is left out, so no name can clash. Without id_col (text) only."""
    ids = [] if id_col is None else [F.col(id_col).alias("doc_id")]
    return docs.select(*ids, F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def accepted(docs: DataFrame, judge: Callable[[list[list]], np.ndarray], *cols: str) -> DataFrame:
    """The rows of docs that judge accepts, as they are: nothing is shuffled and every row has its own decision.

    judge takes the values of cols of some rows, a list for each column, and returns a boolean for each row; strings come as UTF-8, a null text as an empty one.
    """
    at = [docs.columns.index(c) for c in cols]

    def run(batches):
        for batch in (b.slice(lo, 500) for b in batches for lo in range(0, b.num_rows, 500)):
            values = [batch.column(i) for i in at]
            values[0] = pc.fill_null(values[0].cast(pa.binary()), b"")
            yield batch.filter(pa.array(judge([v.to_pylist() for v in values]), pa.bool_()))

    return docs.mapInArrow(frugal(run), docs.schema)


def frugal(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, after which a worker gives back the memory that it has freed: it lives on beside the next stages' work."""

    def each(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim is not None:
                trim(0)

    return each


def in_small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Arrow batches of this session hold so many rows, where its user has left Spark's default: a batch stands in the JVM and in a worker, there as lists too."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def fold(id_col: str, parts: int):
    """The fold number that the contracts use: crc32 of the id written as text, modulo parts; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % parts


def sampled(docs: DataFrame, judged: DataFrame, strata: list, seed: int, train=None) -> DataFrame:
    """Rows of docs with the columns of judged: for each (condition, n) of strata the n ids of least hash that meet it.

    Only ids pass through shuffles; the picked ones, of number at most the sum of the n, are then broadcast to fetch their rows.
    An id that occurs twice gives one row; null ids are never picked.
    """
    ids = docs.where(F.lit(True) if train is None else train).select("doc_id").where("doc_id is not null").distinct()
    ids = ids.join(judged, "doc_id", "left").withColumn("__draw", F.xxhash64("doc_id", F.lit(seed)))
    picked = None
    for met, n in strata:
        some = ids.where(met).orderBy("__draw", "doc_id").limit(n)
        picked = some if picked is None else picked.unionByName(some)
    picked = stash(picked.drop("__draw"), "sampled")
    return docs.join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id"])


BROADCAST_IDS = 2_000_000
SALTS = 16


def semi(df: DataFrame, ids: DataFrame, *keys: str) -> DataFrame:
    """The rows of df whose keys are in ids (a stored table of just these); few ids are broadcast after counting them, more are shuffled."""
    few = ids.count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, list(keys), "left_semi")


def attach(df: DataFrame, small: DataFrame, *keys: str, how: str = "left") -> DataFrame:
    """df with the columns of small, a stored table whose keys occur once.

    Few rows are broadcast after counting them. More are shuffled, and as one key may have a large part of df,
    each key then has SALTS copies, among which its rows of df are dealt by a hash of the row.
    """
    if small.count() <= BROADCAST_IDS // 4:
        return df.join(F.broadcast(small), list(keys), how)
    dealt = df.withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)).cast("int"))
    copies = small.withColumn("__salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    return dealt.join(copies, [*keys, "__salt"], how).drop("__salt")
