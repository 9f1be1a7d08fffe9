"""Quality scores by co-training of a text-content view and a page-metadata view.

Text view: how often bytes and hashed byte pairs occur, the share of distinct words, of a word's repeats right after it, of capital
words, mean word length. Metadata view: source, language, declared length, and the page's layout (lines, their lengths,
words per line); it never looks at the words themselves.

Each view starts with the labelled sample. In every round each classifier names, among all unlabelled documents not named yet, the ``confident`` ones
that it is surest of (in the labelled proportion of good and bad), and the other view learns from
them too. A quarter of the labelled sample is kept from all that: on it a slope and offset calibrate
each view's score, and a logistic combination of the two log odds gives the final probability.

Fitting uses at most ``labelled`` labelled documents (those of the least hash). The features of all unlabelled documents are made once and stored (16-bit floats); every round scores
them all in tasks, and only those named come to the driver. Scoring reads every whole document in one narrow pass.

Null and empty texts have zero content features; null metadata is a value of its own. Without labels of both kinds every document scores
the share of good labels (0.5 without any). A document with several labels is good if they are so on average; null labels say nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecatlas.llm.common import BROADCAST_IDS, accepted, frugal, sampled, stash
from vecatlas.llm.linear import apply, logistic, platt, sigmoid

PAIRS, NAMES = 256, 64
CONTENT, META = 256 + PAIRS + 5, 2 * NAMES + 7


def content(text: bytes) -> np.ndarray:
    out = np.zeros(CONTENT, dtype=np.float32)
    if not text:
        return out
    b = np.frombuffer(text, dtype=np.uint8)
    out[:256] = np.sqrt(np.bincount(b, minlength=256) / len(b))
    if len(b) > 1:
        pair = (b[:-1].astype(np.uint32) * 2654435761 + b[1:].astype(np.uint32) * 40503) >> 7 & (PAIRS - 1)
        out[256 : 256 + PAIRS] = np.sqrt(np.bincount(pair, minlength=PAIRS) / len(pair))
    words = text.split()
    if words:
        n = len(words)
        capital = np.count_nonzero((b >= 65) & (b <= 90)) / len(b)
        out[-5:] = len(set(words)) / n, sum(map(bytes.__eq__, words[1:], words)) / n, capital, len(b) / n / 10, min(1.0, n / 20)
    return out


def _name(value: object, salt: str) -> int:
    return zlib.crc32(f"{salt}:{value}".encode()) % NAMES


def metadata(text: bytes, lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    out = np.zeros(META, dtype=np.float32)
    out[_name(lang, "lang")] = 1
    out[NAMES + _name(source, "source")] = 1
    lines = [len(x) for x in text.split(b"\n")]
    n = len(lines)
    out[-7:] = (0 if n_chars is None else np.log1p(max(n_chars, 0)) / 10, n_chars is None, np.log1p(n) / 5, np.log1p(max(lines)) / 10, np.log1p(np.mean(lines)) / 10, np.std(lines) / (1 + np.mean(lines)), sum(x < 20 for x in lines) / n)
    return out


@dataclass
class Model:
    text: np.ndarray
    meta: np.ndarray
    calibration: tuple[tuple[float, float], tuple[float, float]]
    combine: np.ndarray
    share: float
    fitted: bool = True

    def score(self, x: np.ndarray, m: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), self.share)
        views = [a * apply(w, f.astype(np.float64)) + b for w, f, (a, b) in ((self.text, x, self.calibration[0]), (self.meta, m, self.calibration[1]))]
        return sigmoid(apply(self.combine, np.stack(views, axis=1)))


Unlabelled = Callable[[list[np.ndarray], set[int], int, int], tuple[list[int], np.ndarray, np.ndarray, list[int]]]


def in_memory(x: np.ndarray, m: np.ndarray) -> Unlabelled:
    """The unlabelled documents as two arrays (see :func:`co_train`)."""

    def name(fits, named, bad, good):
        free = np.array([i for i in range(len(x)) if i not in named], dtype=np.int64)
        rows, target = [], []
        for w, view in zip(fits, (x, m), strict=True):
            z = apply(w, view[free].astype(np.float64))
            order = np.argsort(z, kind="stable")
            low, high = [i for i in order[:bad] if z[i] < 0], [i for i in order[::-1][:good] if z[i] > 0]
            rows.append([int(free[i]) for i in low + high])
            target.append([0] * len(low) + [1] * len(high))
        ids = rows[0] + rows[1]
        return ids, x[ids], m[ids], target[0] + target[1], len(rows[0])

    return name


def co_train(x: np.ndarray, m: np.ndarray, y: np.ndarray, unlabelled: Unlabelled, *, rounds: int = 4, confident: int = 600) -> Model:
    """x and m are the two views of the labelled documents, y their labels.

    unlabelled(fits, named, bad, good) gives, of the unlabelled documents not in named, those of which the first and then the second view's classifier is surest:
    their numbers, views and pseudo-labels, and how many of them the first view named.
    """
    share = float(y.mean()) if len(y) else 0.5
    if len(y) < 8 or share in (0.0, 1.0):
        return Model(np.zeros(0), np.zeros(0), ((1, 0), (1, 0)), np.zeros(0), share, False)
    held = np.arange(0, len(y), 4)
    own = np.setdiff1d(np.arange(len(y)), held)
    if len(set(y[own])) < 2:
        own = np.arange(len(y))
    views = [x.astype(np.float64), m.astype(np.float64)]
    taught = [([views[v][own]], [y[own].astype(float)], [np.ones(len(own))]) for v in (0, 1)]

    def learn(v: int) -> np.ndarray:
        return logistic(*(np.concatenate(part) for part in taught[v]), l2=1e-4, steps=150)

    fits, named = [learn(0), learn(1)], set()
    for _ in range(rounds):
        ids, more_x, more_m, target, first = unlabelled(fits, named, max(1, round(confident * (1 - share))), max(1, round(confident * share)))
        if not ids:
            break
        named.update(ids)
        target = np.array(target, dtype=float)
        for v, more, of in ((0, more_x, slice(first, None)), (1, more_m, slice(0, first))):  # what one view is sure of teaches the other
            if len(target[of]):
                for part, new in zip(taught[v], (more[of].astype(np.float64), target[of], np.full(len(target[of]), 0.3)), strict=True):  # a pseudo-label counts less
                    part.append(new)
        fits = [learn(0), learn(1)]
    target = y[held].astype(float)
    calibration = tuple(platt(apply(fits[v], views[v][held]), target) for v in (0, 1))
    odds = np.stack([calibration[v][0] * apply(fits[v], views[v][held]) + calibration[v][1] for v in (0, 1)], axis=1)
    combine = logistic(odds, target, l2=1e-3, steps=400) if len(set(target)) > 1 else np.array([0.5, 0.5, 0.0])
    return Model(fits[0], fits[1], calibration, combine, share)


def _columns(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str, chars_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(chars_col).cast("long").alias("n_chars"))


def _features(texts, langs, sources, chars) -> tuple[np.ndarray, np.ndarray]:
    x = np.stack([content(t) for t in texts]) if texts else np.zeros((0, CONTENT), dtype=np.float32)
    m = np.stack([metadata(*r) for r in zip(texts, langs, sources, chars, strict=True)]) if texts else np.zeros((0, META), dtype=np.float32)
    return x, m


def _packed(batches):
    for batch in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
        x, m = (a.astype(np.float16) for a in _features(*(batch.column(i).to_pylist() for i in range(4))))
        yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in m], pa.binary()), batch.column(4)], ["x", "m", "y"])


def _views(x: list[bytes], m: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.frombuffer(b"".join(c), dtype=np.float16).reshape(-1, n) for c, n in ((x, CONTENT), (m, META)))


def _stored(features: DataFrame) -> Unlabelled:
    """The unlabelled documents as a stored table (row, x, m)."""
    spark = features.sparkSession

    def name(fits, named, bad, good):
        known = spark.sparkContext.broadcast((fits, named))

        def judged(batches):
            fits, named = known.value
            for batch in batches:
                views = _views(batch.column(1).to_pylist(), batch.column(2).to_pylist())
                z = [apply(w, v.astype(np.float64)) for w, v in zip(fits, views, strict=True)]
                free = np.array([r not in named for r in batch.column(0).to_pylist()], dtype=bool)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(z[0]), pa.array(z[1])], ["row", "z0", "z1"]).filter(pa.array(free))

        scores = stash(features.mapInArrow(frugal(judged), "row long, z0 double, z1 double"), "view-scores")
        ids, target, first = [], [], 0
        for v in ("z0", "z1"):
            low = scores.where(F.col(v) < 0).orderBy(v, "row").limit(bad).select("row").collect()
            high = scores.where(F.col(v) > 0).orderBy(F.desc(v), "row").limit(good).select("row").collect()
            ids += [r["row"] for r in low + high]
            target += [0] * len(low) + [1] * len(high)
            first = first or len(ids)
        if not ids:
            return [], None, None, [], 0
        wanted = spark.createDataFrame([(i,) for i in sorted(set(ids))], "row long")
        got = {r["row"]: r for r in features.join(F.broadcast(wanted), "row").collect()}
        return ids, *_views([bytes(got[i]["x"]) for i in ids], [bytes(got[i]["m"]) for i in ids]), target, first

    return name


def fit(docs: DataFrame, labels: DataFrame, train: Column | None = None, *, labelled: int = 6000, confident: int = 600, rounds: int = 4, label_col: str = "quality", label_id_col: str = "doc_id", seed: int = 3, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", chars_col: str = "n_chars") -> Model:
    """train says which documents may teach (all by default)."""
    judged = labels.select(F.col(label_id_col).alias("doc_id"), F.col(label_col).alias("y")).where(F.col("y").isNotNull()).groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    rows = _columns(docs, id_col, text_col, lang_col, source_col, chars_col)
    rows = rows if train is None else rows.where(train)
    columns = [F.col("text").cast("binary").alias("text"), "lang", "source", "n_chars"]
    got = sampled(rows, judged, [("y is not null", labelled)], seed).select(*columns, "y").mapInArrow(frugal(_packed), "x binary, m binary, y int").collect()
    x, m = _views([bytes(r["x"]) for r in got], [bytes(r["m"]) for r in got])
    y = np.array([r["y"] for r in got], dtype=np.int64)
    if len(y) < 8 or len(set(y)) < 2:
        return co_train(x, m, y, in_memory(x[:0], m[:0]))
    # labels are few beside texts: their ids leave out the labelled rows by a join of ids, whatever the number of rows
    ids = stash(judged.select("doc_id"), "labelled-ids")
    few = ids.count() <= BROADCAST_IDS
    free = rows.join(F.broadcast(ids) if few else ids, "doc_id", "left_anti").select(*columns, F.monotonically_increasing_id().alias("row")).mapInArrow(frugal(_packed), "x binary, m binary, y long")
    features = stash(free.select(F.col("y").alias("row"), "x", "m"), "quality-features")
    return co_train(x, m, y, _stored(features), rounds=rounds, confident=confident)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", chars_col: str = "n_chars") -> DataFrame:
    """(doc_id, score) for every row: the probability of a good document."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(*_features(*(part.column(i).to_pylist() for i in range(1, 5)))))], ["doc_id", "score"])

    source = _columns(docs, id_col, text_col, lang_col, source_col, chars_col)
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.withColumn("text", F.col("text").cast("binary")).mapInArrow(run, f"doc_id {kind}, score double")


def of_quality(docs: DataFrame, model: Model, least: float, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", chars_col: str = "n_chars") -> DataFrame:
    """The rows of docs that are good with a probability of ``least`` or more."""
    return accepted(docs, lambda columns: model.score(*_features(*columns)) >= least, text_col, lang_col, source_col, chars_col)
