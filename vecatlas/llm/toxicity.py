"""Toxicity scores by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; all texts of the training folds are the unlabelled ones,
whatever else is known of them. With class prior p the risk is estimated as

    p R+(positives, +1) + max(0, R-(unlabelled, -1) - p R+(positives, -1)),

with the logistic loss. Where the second part falls below zero, the step goes against its gradient, so that a
flexible model can't drive it down. No text counts as confirmed to be harmless: labels of harmless texts tell the prior only
(the toxic share of labelled texts, unless it is given).

Features: whether a text has a word (ASCII signs and blanks divide, A-Z lowered; of a long word the first 64 bytes) or a longer word that begins with six bytes, for those whose
share among positives lies far above or below their share among the unlabelled texts.

Fitting uses at most ``positives`` confirmed texts (those of the least hash of the id), a quarter of which is kept for calibration, and all unlabelled texts: tasks count
their features, and then take steps on their own texts from common weights, which are averaged after each round. Slope and offset minimise the same risk on the
positives kept back and a histogram of the scores of all unlabelled texts. The driver sees ``candidates`` features' counts at most, the positives' chosen features, weights and the histogram;
none of these grows with the corpus. Scoring reads every whole text in one narrow pass.

Null and empty texts get the score of a text without any such feature. If no positive text is at hand
all texts get the prior (0 if nothing is labelled). Labels may repeat or be null: a document is toxic if any of its labels says so; null labels say nothing. Rows with one id share its label; a null id
has none. Very long texts are read whole. Repeated rows count and score as often as they come. An empty table gives an empty result. Extra columns are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecatlas.llm.common import accepted, documents, frugal, sampled, stash
from vecatlas.llm.linear import logit, sigmoid

SIGNS = bytes(c for c in range(128) if not chr(c).isalnum())
SPLIT = bytes.maketrans(SIGNS + bytes(range(65, 91)), b" " * len(SIGNS) + bytes(range(97, 123)))
LONGEST, BEGINNING = 64, 6  # bytes
CHUNK, STEPS, BINS = 4096, 100, 50  # texts that a task learns from at a time, steps on them, bins for each unit of a score


def words_of(text: bytes) -> set[bytes]:
    return set(text.translate(SPLIT).split())


def features_of(text: bytes) -> set[bytes]:
    """Words, and beginnings of longer ones with a blank behind them."""
    words = words_of(text)
    return {w[:LONGEST] for w in words} | {w[:BEGINNING] + b" " for w in words if len(w) > BEGINNING}


class Lookup:
    """What known features a text has."""

    def __init__(self, known: dict[bytes, object]):
        self.known, self.words = known, {k for k in known if not k.endswith(b" ")}
        self.beginnings = {k[:-1]: k for k in known if k.endswith(b" ")}

    def of(self, text: bytes) -> list:
        words = words_of(text)
        found = [self.known[w] for w in words & self.words]
        begun = {w[:BEGINNING] for w in words if len(w) > BEGINNING} & self.beginnings.keys()
        if any(len(w) > LONGEST for w in words):
            found += [self.known[w] for w in ({w[:LONGEST] for w in words if len(w) > LONGEST} & self.words) - words]
        return found + [self.known[self.beginnings[b]] for b in begun]


@dataclass
class Model:
    """weights by feature, bias, and the calibration."""

    weights: dict[bytes, float]
    bias: float
    slope: float
    offset: float
    prior: float

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not self.weights:
            return np.full(len(texts), self.prior)
        known = Lookup(self.weights)
        z = np.array([sum(known.of(t)) for t in texts], dtype=float).reshape(-1) + self.bias
        return sigmoid(self.slope * z + self.offset)


def _csr(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate([*rows, np.empty(0, dtype=np.int64)]).astype(np.int64)


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.log1p(np.exp(np.clip(z, -35, 35)))


def chunks(rows: Iterable, most: int = CHUNK) -> Iterator[list]:
    """All rows in lists of most each; the last has up to a quarter more, so that it is small only if there are few rows at all: few texts say little of the share that is toxic."""
    part = []
    for row in rows:
        part.append(row)
        if len(part) == most + most // 4:
            yield part[:most]
            part = part[most:]
    if part:
        yield part


def nn_pu(pos: list[np.ndarray], unl: list[np.ndarray], n: int, prior: float, start: tuple[np.ndarray, float] | None = None, *, steps: int = STEPS, rate: float = 0.1, l2: float = 1e-5) -> tuple[np.ndarray, float]:
    """Steps of a linear classifier over n features, each text an array of its features (one as often as it counts); returns weights and bias."""
    (pr, pf), (ur, uf) = _csr(pos), _csr(unl)
    w, b = (np.zeros(n), logit(np.array(prior)).item()) if start is None else (start[0].copy(), start[1])
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, steps + 1):
        zp, zu = np.bincount(pr, weights=w[pf], minlength=len(pos)) + b, np.bincount(ur, weights=w[uf], minlength=len(unl)) + b
        sp, su = sigmoid(zp), sigmoid(zu)
        negative = _softplus(zu).mean() - prior * _softplus(zp).mean()
        # d loss(z, +1)/dz = s - 1, d loss(z, -1)/dz = s
        if negative >= 0:
            gp, gu = (prior * (sp - 1) - prior * sp) / len(pos), su / len(unl)
        else:
            gp, gu = prior * sp / len(pos), -su / len(unl)
        g = np.bincount(pf, weights=gp[pr], minlength=n) + np.bincount(uf, weights=gu[ur], minlength=n) + l2 * w
        g = np.append(g, gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w -= step[:-1]
        b -= step[-1]
    return w, b


def calibrated(pos: np.ndarray, unl: np.ndarray, counts: np.ndarray, prior: float, steps: int = 600) -> tuple[float, float]:
    """Slope (0 at the least) and offset of least risk, from the scores of positives and of unlabelled texts, of which counts are as many."""
    share, spread = counts / counts.sum(), max(float(pos.std()), 1e-3)
    a, b = 1.0, 0.0
    m, v = np.zeros(2), np.zeros(2)
    for t in range(1, steps + 1):
        zp, zu = a * pos / spread + b, a * unl / spread + b
        sp, su = sigmoid(zp), sigmoid(zu)
        gp, gu = -prior * np.ones(len(pos)) / len(pos), share * su
        if (share * _softplus(zu)).sum() < prior * _softplus(zp).mean():
            gp, gu = prior * sp / len(pos), -share * su
        g = np.array([(gp * pos).sum() / spread + (gu * unl).sum() / spread, gp.sum() + gu.sum()])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        a, b = max(a - step[0], 0.0), b - step[1]
    return a / spread, b


def fit(docs: DataFrame, labels: DataFrame, train: Column, *, prior: float | None = None, positives: int = 4000, candidates: int = 1 << 16, rounds: int = 3, features: int = 4096, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", label_id_col: str = "doc_id", seed: int = 7) -> Model:
    """train says, of ``doc_id`` (the id's name here), which documents may teach."""
    spark = docs.sparkSession
    judged = labels.select(F.col(label_id_col).alias("doc_id"), F.col(label_col).alias("toxic")).where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    source = documents(docs, id_col, text_col).where(train)
    known, toxic = source.select("doc_id").join(judged, "doc_id").agg(F.count("*"), F.count_if(F.col("toxic") > 0)).first()
    if prior is None:
        prior = min(0.5, max(1e-3, toxic / known)) if known else 0.0
    if not toxic:
        return Model({}, 0.0, 1.0, 0.0, prior)
    drawn = stash(sampled(source, judged, [("toxic > 0", positives)], seed).select(F.col("text").cast("binary").alias("text"), (F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(4)) == 0).alias("held")), "confirmed")

    def named(batches):
        for batch in batches:
            for t in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(list(features_of(t)), pa.binary())], ["feature"])

    frequent = drawn.select("text").mapInArrow(frugal(named), "feature binary").groupBy("feature").count().where("count >= 3").orderBy(F.desc("count"), "feature").limit(candidates).toArrow()
    names, in_pos = frequent["feature"].to_pylist(), frequent["count"].to_numpy().astype(float)
    wanted = spark.sparkContext.broadcast({h: i for i, h in enumerate(names)})

    def counted(batches):
        for batch in batches:
            found = Lookup(wanted.value)
            seen: Counter = Counter()
            for t in batch.column(0).to_pylist():
                seen.update(found.of(t))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["feature", "n"])

    texts = source.select(F.col("text").cast("binary").alias("text"))
    rows = texts.mapInArrow(frugal(counted), "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    in_unl = np.zeros(len(names))
    in_unl[rows["feature"].to_numpy()] = rows["n"].to_numpy()
    n_pos, n_unl = drawn.count(), source.count()
    p, u, both = in_pos / n_pos, in_unl / n_unl, (in_pos + in_unl) / (n_pos + n_unl)
    # standard errors between the shares
    lean = np.abs(p - u) / (np.sqrt(both * (1 - both) * (1 / n_pos + 1 / n_unl)) + 1e-9)
    chosen = [i for i in np.lexsort((np.arange(len(lean)), -lean)) if lean[i] > 4.5][:features]
    place = spark.sparkContext.broadcast({names[i]: k for k, i in enumerate(chosen)})
    size = len(chosen)

    def told(batches):
        found = Lookup(place.value)
        for batch in batches:
            lists = [found.of(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.int32())), *batch.columns[1:]], ["features", *batch.schema.names[1:]])

    got = drawn.mapInArrow(frugal(told), "features array<int>, held boolean").collect()
    pos = [np.array(r["features"], dtype=np.int64) for r in got if not r["held"]] or [np.array(r["features"], dtype=np.int64) for r in got]
    back = [np.array(r["features"], dtype=np.int64) for r in got if r["held"]] or pos
    unlabelled = stash(texts.mapInArrow(frugal(told), "features array<int>"), "toxicity-features")
    confirmed = spark.sparkContext.broadcast(pos)
    weights, bias = np.zeros(size), logit(np.array(prior)).item()
    for _ in range(rounds):
        now = spark.sparkContext.broadcast((weights, bias))

        def local(batches, now=now):
            start, seen = now.value, 0
            for part in chunks(np.array(f, dtype=np.int64) for batch in batches for f in batch.column(0).to_pylist()):
                start, seen = nn_pu(confirmed.value, part, size, prior, start), seen + len(part)
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([np.append(start[0], start[1]).tobytes()], pa.binary()), pa.array([float(seen)])], ["flat", "weight"])

        parts = unlabelled.mapInArrow(frugal(local), "flat binary, weight double").repartition(8).mapInArrow(_added, "flat binary, weight double").collect()
        total = sum(np.frombuffer(r["flat"]) for r in parts) / sum(r["weight"] for r in parts)
        weights, bias = total[:-1].copy(), float(total[-1])

    final = spark.sparkContext.broadcast((weights, bias))

    def histogram(batches):
        w, b = final.value
        for batch in batches:
            z = np.array([w[f].sum() if f else 0.0 for f in batch.column(0).to_pylist()]).reshape(-1) + b
            bins, n = np.unique(np.round(np.clip(z, -100, 100) * BINS).astype(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(bins), pa.array(n.astype(np.int64))], ["bin", "n"])

    bins = unlabelled.mapInArrow(frugal(histogram), "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()
    slope, offset = calibrated(np.array([weights[f].sum() for f in back]) + bias, bins["bin"].to_numpy() / BINS, bins["n"].to_numpy().astype(float), prior)
    return Model({names[i]: float(weights[k]) for k, i in enumerate(chosen)}, bias, slope, offset, prior)


def _added(batches):
    """Weights times their tasks' texts, summed."""
    total, weight = None, 0.0
    for b in batches:
        for flat, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            a = np.frombuffer(flat) * w
            total, weight = (a if total is None else total + a), weight + w
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([weight])], ["flat", "weight"])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """(doc_id, score, predicted) for every row."""

    def run(batches):
        for batch in batches:
            s = model.score(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    source = documents(docs, id_col, text_col)
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of docs whose score is below the threshold."""
    return accepted(docs, lambda columns: model.score(columns[0]) < threshold, text_col)
