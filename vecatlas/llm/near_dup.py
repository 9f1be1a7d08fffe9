"""Near-duplicate classes with BagMinHash.

Each text is a multiset of five-word shingles; texts whose weighted Jaccard similarity is 0.8 or more are linked,
and linked texts share a class.

Signature. The weight axis of a shingle is cut into the blocks [0,1), [1,2), [2,4), [4,8), ... Each block has a
Poisson process of points in time whose rate is its length. A point carries a signature component and a mark that sends
it down the halvings of its block to one unit level; it counts if the level lies below the shingle's weight. As
processes depend on shingle and block only, two texts share just the points below the lesser weight, so the
earliest point of a component is the same for both with probability equal to the weighted Jaccard similarity. A text generates points only up
to the time by which its components are likely full (about 9 m points whatever its length), then goes on for those that are not.

Search. 25 bands of 5 components (of 128) miss a pair at exactly 0.8 once in 20,000 pairs. Equal multisets are one
representative from the start. In every bucket the others are compared with one leader, the member with the most bucket mates:
as many pairs as rows, however large the bucket. Rows that the leaders' links leave apart in a bucket then meet by an exact prefix filter on
their rarest shingles (see :func:`graph.meetings`), not member by member.
All candidates whose signatures (a byte of each component's point) agree in 66 % or more (4 standard errors below 0.8) are verified on whole texts.

Texts without words are one class. Null texts are empty ones. Repeated rows are rows of the same class. Very long texts are read whole, and a shingle may
occur any number of times. An empty table gives an empty result. Rows are numbered once and stored with their texts, so that a number is the same row in every later scan.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecatlas.llm.common import BROADCAST_IDS, attach, frugal, semi, stash
from vecatlas.llm.graph import Overlap, linked, numbered
from vecatlas.llm.shingles import WordHashes, mix, multiset, similarity

COMPONENTS, BANDS, ROWS = 128, 25, 5
LIKE, LEAST_AGREEING = 0.8, 0.66
AT_ONCE = 100_000  # shingles whose points are made together


def bag_signatures(hashes: np.ndarray, counts: np.ndarray, doc: np.ndarray, n_docs: int, m: int = COMPONENTS) -> np.ndarray:
    """Signatures (n_docs x m, 32-bit point names) of multisets given as parallel arrays; rows of empty multisets are 0."""
    weight = np.bincount(doc, weights=counts, minlength=n_docs)
    seeds, docs, rates, lows, tops = [hashes], [doc], [np.ones(len(doc))], [np.zeros(len(doc))], [counts]
    low = 1
    while (more := counts > low).any():
        seeds.append(mix(hashes[more] + np.uint64(low)))
        docs.append(doc[more])
        rates.append(np.full(int(more.sum()), float(low)))
        lows.append(np.full(int(more.sum()), float(low)))
        tops.append(counts[more])
        low *= 2
    seed, of, rate, low_, top = map(np.concatenate, (seeds, docs, rates, lows, tops))
    best, name = np.full(n_docs * m, np.inf), np.zeros(n_docs * m, dtype=np.uint32)
    until = np.where(weight > 0, (np.log(m) + 4) * m / np.maximum(weight, 1), 0)
    need = weight > 0
    while need.any():
        at = np.flatnonzero(need[of])
        s, d, r, lo, hi = seed[at], of[at], rate[at], low_[at], top[at]
        time, step = np.zeros(len(at)), np.uint64(0)
        while len(s):
            with np.errstate(over="ignore"):
                step += np.uint64(0x9E3779B97F4A7C15)
                h = mix(s + step)
            time = time - np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / r
            live = time < until[d]
            s, d, r, lo, hi, time, h = s[live], d[live], r[live], lo[live], hi[live], time[live], h[live]
            p = mix(h ^ np.uint64(0x5851F42D4C957F2D))
            part = (p >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)
            level = lo + np.floor((p & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 * r)
            counted = level < hi
            key, t = d[counted] * m + part[counted].astype(np.int64), time[counted]
            np.minimum.at(best, key, t)
            first = best[key] == t
            name[key[first]] = (h[counted][first] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        need &= np.isinf(best).reshape(n_docs, m).any(axis=1)
        until = until * 2
    return name.reshape(n_docs, m)


def _profiles(batches):
    """row, doc_id, fingerprint of the multiset, weight, signature, bands."""
    words = WordHashes()
    salts = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    for batch in (b.slice(at, 2000) for b in batches for at in range(0, b.num_rows, 2000)):
        rows, names, texts = batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()
        sets = {}
        for t in texts:
            if t not in sets:
                sets[t] = None
        order, start = list(sets), 0
        while start < len(order):
            got, total, stop = [], 0, start
            while stop < len(order) and (total < AT_ONCE or not got):
                got.append(multiset(order[stop], words))
                total += len(got[-1][0])
                stop += 1
            h, c = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
            doc = np.repeat(np.arange(len(got)), [len(g[0]) for g in got])
            sig = bag_signatures(h, c, doc, len(got))
            with np.errstate(over="ignore"):
                one, two = mix(h + mix(c.astype(np.uint64))), mix((h ^ np.uint64(0xA5A5A5A5A5A5A5A5)) * np.uint64(3) + c.astype(np.uint64))
                ones, twos = np.zeros(len(got), dtype=np.uint64), np.zeros(len(got), dtype=np.uint64)
                np.add.at(ones, doc, one)
                np.add.at(twos, doc, two)
                band = np.repeat(salts[None, :], len(got), axis=0)
                for i in range(ROWS):
                    band = mix(band * np.uint64(5) + sig[:, i : BANDS * ROWS : ROWS])
            weights = np.bincount(doc, weights=c, minlength=len(got)).astype(np.int64)
            for i, t in enumerate(order[start:stop]):
                sets[t] = (ones[i].astype(np.int64), twos[i].astype(np.int64), weights[i], sig[i].astype(np.uint8).tobytes() if weights[i] else None, band[i].astype(np.int64) if weights[i] else [])
            start = stop
        out = [sets[t] for t in texts]
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows, pa.int64()), names.cast(pa.int64()), *(pa.array([o[i] for o in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))))],
            ["row", "doc_id", "one", "two", "weight", "sig", "bands"],
        )


def _elements():
    words = WordHashes()
    return lambda text: numbered(*multiset(text, words))


def _overlap() -> Overlap:
    """Weighted Jaccard similarity of LIKE: a + b - common <= common / LIKE."""
    return Overlap(_elements, lambda small, large: (small + large) * (LIKE / (1 + LIKE)), lambda size: LIKE * size)


def _agreeing(batches):
    """Pairs whose signatures agree often enough."""
    for batch in batches:
        if batch.num_rows:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint8).reshape(-1, COMPONENTS) for i in (2, 3))
            yield batch.filter(pa.array((a == b).mean(axis=1) >= LEAST_AGREEING)).select(["a", "b"])


def _alike(batches):
    """Pairs whose texts are alike; the multiset of the side that recurs is remembered."""
    words, last = WordHashes(), {}
    for batch in (b.slice(at, 100) for b in batches for at in range(0, b.num_rows, 100)):
        keep = []
        for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if b not in last:
                if len(last) > 50:
                    last.clear()
                last[b] = multiset(y, words)
            keep.append(similarity(multiset(x, words), last[b]) >= LIKE)
        yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])


def _links(pairs: DataFrame, sigs: DataFrame, texts: DataFrame, name: str) -> DataFrame:
    """The pairs (a, b) that are near duplicates."""
    side = lambda df, k, v: df.select(F.col("row").alias(k), F.col(v).alias(f"{v}_{k}"))
    likely = pairs.join(side(sigs, "a", "sig"), "a").join(side(sigs, "b", "sig"), "b").select("a", "b", "sig_a", "sig_b").mapInArrow(frugal(_agreeing), "a long, b long")
    likely = stash(likely, f"{name}-likely")
    used = stash(likely.select(F.col("a").alias("row")).union(likely.select(F.col("b").alias("row"))).distinct(), "used")
    some = semi(texts, used, "row")
    return stash(likely.join(side(some, "a", "text"), "a").join(side(some, "b", "text"), "b").select("a", "b", "text_a", "text_b").mapInArrow(frugal(_alike), "a long, b long"), f"{name}-links")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """(row, doc_id, class_id, class_size, is_kept): class_id is the least doc_id of the class; is_kept marks one row of each, the first of that id.

    row is the number of the row: that in row_col, of a frame that is stored already, or else one given here. Null ids come after all others.
    """
    number = F.col(row_col) if row_col else F.monotonically_increasing_id()
    source = docs.select(number.alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    if not row_col:
        source = stash(source, "texts")
    profiles = stash(source.mapInArrow(frugal(_profiles), "row long, doc_id long, one long, two long, weight long, sig binary, bands array<long>"), "profiles")
    same = profiles.groupBy("one", "two", "weight").agg(F.min("row").alias("rep"), F.count("*").alias("n")).where("n > 1")
    same = stash(same.select("one", "two", "weight", "rep"), "equal")  # of multisets that one row has nothing is stored
    members = stash(attach(profiles.select("row", "doc_id", "one", "two", "weight"), same, "one", "two", "weight").select("row", "doc_id", "weight", F.coalesce("rep", "row").alias("rep")), "members")
    others = stash(members.where("row <> rep OR weight = 0").select("row"), "others")
    few = others.count() <= BROADCAST_IDS
    sigs = profiles.select("row", "sig", "bands").join(F.broadcast(others) if few else others, "row", "left_anti")
    places = stash(sigs.select("row", F.explode("bands").alias("band")), "bands")
    sigs, texts = profiles.select("row", "sig"), source.select("row", "text")
    labels = stash(linked(places, texts, lambda pairs, name: _links(pairs, sigs, texts, name), _overlap()).select(F.col("v").alias("rep"), "label"), "representatives")
    rows = stash(attach(members.select("row", "doc_id", "rep"), labels, "rep").select("row", "doc_id", F.coalesce("label", "rep").alias("label")), "classes")
    first = rows.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = stash(first.select("label", F.col("first.doc_id").alias("class_id"), F.col("first.row").alias("first_row"), "n"), "firsts")
    alone = F.col("n").isNull()
    return attach(rows, first, "label").select("row", "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n", F.lit(1)).cast("long").alias("class_size"), (alone | (F.col("row") == F.col("first_row"))).alias("is_kept"))


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are kept, one of each class; with all their columns."""
    numbered_docs = stash(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    gone = stash(classes(numbered_docs, id_col, text_col, "__row").where("NOT is_kept").select(F.col("row").alias("__row")), "copies")
    few = gone.count() <= BROADCAST_IDS
    return numbered_docs.join(F.broadcast(gone) if few else gone, "__row", "left_anti").select(*docs.columns)
