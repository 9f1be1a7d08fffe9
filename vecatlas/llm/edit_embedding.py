"""Document fingerprints by randomised edit embedding.

A random walk reads a text: at step j it reads the character at its place and moves on or stays, as a table that all
texts share says for (j, character). Texts within few edits read equal characters at most steps again soon after an edit,
so edit distance turns into Hamming distance between the sequences read. What is read at step j adds +1 or -1, again by a shared table of
(j, character), to one of 512 sums; the signs of the sums are the fingerprint. The share of steps at which two texts
read the same thus shows in the share of equal bits. All of a text is read: there is no prefix and no sampling.

A sum that nothing was added to takes the next one's bit, turned or not by its place. An empty text has all bits 0. Characters beyond
ASCII share 127 values of the table. Equal texts have equal fingerprints.

Near texts: bit-sampled bands find candidates, and edit distance verifies them (:func:`classes`).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecatlas.llm.common import attach, documents, stash
from vecatlas.llm.graph import Overlap, linked, numbered
from vecatlas.llm.shingles import mix

BITS, SEED, BLOCK = 512, 20, 512
AT_ONCE = 2000  # texts that walk side by side; memory grows with them, speed as well
PART_BYTES, MOST_PARTS = 16 << 20, 2048
LEAST_ID = -(1 << 63)


def symbols(text: str) -> np.ndarray:
    """A byte per character, never 0."""
    if text.isascii():
        c = np.frombuffer(text.encode(), dtype=np.uint8).copy()
        c[c == 0] = 1
        return c
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(c < 128, np.maximum(c, 1), 128 + c % 127).astype(np.uint8)


class Walk:
    """The shared tables, made in blocks of steps."""

    KEPT = 1000

    def __init__(self):
        self.kept: dict[int, tuple[np.ndarray, np.ndarray, list[int]]] = {}

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
        if b not in self.kept:
            rng = np.random.Generator(np.random.PCG64([SEED, b]))
            t = rng.integers(0, 4, (BLOCK, 256), dtype=np.uint8)
            on, sign = (t & 1).astype(np.int32), ((t & 2).astype(np.int32) - 1)
            on[:, 0] = sign[:, 0] = 0  # the end of a text
            got = on, sign, rng.permutation(BITS).tolist()
            if len(self.kept) >= self.KEPT:
                return got
            self.kept[b] = got
        return self.kept[b]


def fingerprints(texts: list[str], walk: Walk) -> np.ndarray:
    """A row of BITS zeros and ones for each text. All texts walk side by side."""
    codes = [symbols(t) for t in texts]
    order = sorted(range(len(texts)), key=lambda i: -len(codes[i]))
    lengths = np.array([len(codes[i]) for i in order], dtype=np.int64)
    flat = np.concatenate([part for i in order for part in (codes[i], np.zeros(1, dtype=np.uint8))]) if texts else np.zeros(0, dtype=np.uint8)
    end = np.cumsum(lengths + 1) - 1
    place, who = end - lengths, np.arange(len(texts))
    sums, own = np.zeros((BITS, len(texts)), dtype=np.int32), np.zeros((BITS, len(texts)), dtype=np.int32)
    b = 0
    while len(who):
        on, sign, slots = walk.block(b)
        for j in range(BLOCK):
            c = flat[place]
            own[slots[j]] += sign[j].take(c)
            place += on[j].take(c)
        b += 1
        live = place < end
        if not live.all() and (live.mean() < 0.93 or not live.any() or b % 16 == 0):
            sums[:, who[~live]] = own[:, ~live]
            place, end, who, own = place[live], end[live], who[live], own[:, live]
    bits = sums > 0
    some = np.flatnonzero((sums == 0).any(axis=0) & (sums != 0).any(axis=0))
    if len(some):
        # the next slot that has something, going round
        empty = sums[:, some] == 0
        at = np.where(empty, 2 * BITS, np.arange(BITS, dtype=np.int32)[:, None]).astype(np.int32)
        at = np.minimum.accumulate(np.vstack([at, at + np.where(empty, 0, BITS).astype(np.int32)])[::-1])[::-1][:BITS]
        near = np.take_along_axis(bits[:, some], at % BITS, axis=0)
        turn = (np.random.Generator(np.random.PCG64(SEED)).integers(0, 2, BITS) > 0)[:, None]
        bits[:, some] = np.where(empty, near ^ turn, bits[:, some])
    out = np.empty((len(texts), BITS), dtype=bool)
    out[order] = bits.T
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """From 0 to 1: the cosine that so many equal signs stand for; it estimates the share of what is read alike."""
    return np.clip(np.cos(np.pi * (a != b).mean(axis=-1)), 0, 1)


def to_hex(bits: np.ndarray) -> list[str]:
    return [r.tobytes().hex() for r in np.packbits(bits, axis=1)]


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) for every row; null texts are empty. One narrow pass."""

    def run(batches):
        walk = Walk()
        for batch in (b.slice(lo, AT_ONCE) for b in batches for lo in range(0, b.num_rows, AT_ONCE)):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(to_hex(fingerprints(batch.column(1).to_pylist(), walk)), pa.string())], ["doc_id", "fingerprint"])

    source = documents(docs, id_col, text_col)
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def edited(text: str, following: str) -> str:
    """The last third replaced by as much of the beginning of the following text as there is."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def against_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row.

    The next document follows by descending id (null ids last, equal ids by text); the first follows the last. Ids are
    cut into ranges, each of which one task reads in order; a copy of the first row of the following range
    is added to each, so every row finds its next one in its own task. Texts are shuffled once. A single row follows itself.
    """
    rows = documents(docs, id_col, text_col).select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID)).alias("k"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(min(MOST_PARTS, max(1, size // PART_BYTES)))
    bounds = rows.agg(F.percentile_approx("k", [i / parts for i in range(1, parts)], 20 * parts)).first()[0] if parts > 1 else []
    bounds = sorted(set(bounds or []))
    # part 0 has the greatest ids
    rows = rows.withColumn("part", F.size(F.filter(F.array(*map(F.lit, bounds)).cast("array<bigint>"), lambda b: F.col("k") <= b)))
    firsts = sorted((r["part"], r["k"]) for r in rows.groupBy("part").agg(F.max("k").alias("k")).collect())
    spark = docs.sparkSession
    before = spark.createDataFrame([(k, firsts[i - 1][0]) for i, (_, k) in enumerate(firsts)], "first long, of int")
    heads = rows.join(F.broadcast(before), rows["k"] == before["first"]).groupBy("of").agg(F.min("text").alias("text"))
    both = rows.select("part", F.lit(0).alias("extra"), "k", "doc_id", "text").union(heads.select(F.col("of").alias("part"), F.lit(1).alias("extra"), F.lit(LEAST_ID).alias("k"), F.lit(None).cast(rows.schema["doc_id"].dataType).alias("doc_id"), "text"))
    lined = both.repartition(max(1, len(firsts)), "part").sortWithinPartitions("part", "extra", F.desc("k"), "text").select("extra", "doc_id", "text")

    def run(batches):
        walk, kept = Walk(), ([], [], [])
        for batch in (b.slice(lo, AT_ONCE) for b in batches for lo in range(0, b.num_rows, AT_ONCE)):
            extra, names, texts = (k + batch.column(i).to_pylist() for i, k in enumerate(kept))
            n = len(texts) - 1
            own = [i for i in range(n) if not extra[i]]
            new = [edited(texts[i], texts[i + 1]) for i in own]
            bits = fingerprints(texts + new, walk)
            mine, change, following = bits[own], bits[len(texts) :], bits[[i + 1 for i in own]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([names[i] for i in own], batch.schema.field(1).type),
                    pa.array([len(texts[i]) for i in own], pa.int64()),
                    pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in new], pa.string()),
                    pa.array(to_hex(mine), pa.string()),
                    pa.array(to_hex(change), pa.string()),
                    pa.array(likeness(mine, change)),
                    pa.array(likeness(mine, following)),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )
            kept = tuple([c[-1]] for c in (extra, names, texts))

    kind = rows.schema["doc_id"].dataType.simpleString()
    return lined.mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _runs_of_three(text: bytes) -> np.ndarray:
    """The runs of three characters, with two ends before and behind; one more than the characters plus one."""
    c = np.frombuffer(text.decode().encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
    c = np.pad(c, 2)
    return numbered(*np.unique(mix((c[:-2] << np.uint64(42)) | (c[1:-1] << np.uint64(21)) | c[2:]), return_counts=True))


def within(x: str, y: str, most: int) -> bool:
    """Whether the edit distance is at most ``most``: the furthest reach on each diagonal, edit by edit, so work grows with length plus most squared."""
    if abs(len(x) - len(y)) > most:
        return False
    size = max(len(x), len(y)) + 1
    a, b = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64) for t in (x, y))
    a, b = np.append(a, np.full(size - len(a), -1)), np.append(b, np.full(size - len(b), -2))

    def slide(i: int, k: int) -> int:
        """The end of the equal run of a[i:] and b[i + k:]."""
        step = 32
        while True:
            u, v = a[i : i + step], b[i + k : i + k + step]
            n = min(len(u), len(v))
            unlike = np.flatnonzero(u[:n] != v[:n])
            if len(unlike):
                return i + int(unlike[0])
            i += n
            if n < step:
                return i
            step *= 4

    reach = {0: slide(0, 0)}
    if len(x) == len(y) and reach[0] >= len(x):
        return True
    for e in range(1, most + 1):
        new = {}
        for k in range(-e, e + 1):
            if abs(k) > most:
                continue
            i = max(reach.get(k, -2) + 1, reach.get(k - 1, -2), reach.get(k + 1, -2) + 1)
            i = min(i, len(x), len(y) - k)
            if i < 0 or i + k < 0:
                continue
            new[k] = slide(i, k) if i < len(x) and i + k < len(y) else i
        reach = new
        if reach.get(len(y) - len(x), -1) >= len(x):
            return True
    return False


def _near(batches):
    """Pairs within their distance."""
    for batch in batches:
        near = [within(x.decode(), y.decode(), most) for x, y, most in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
        yield batch.filter(pa.array(near, pa.bool_())).select(["a", "b"])


def classes(docs: DataFrame, share: float = 0.1, *, bands: int = 64, sampled: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id): texts linked by an edit distance of at most share of the longer one's length have the least row place of their class as class_id.

    Each band is a seeded sample of the fingerprint's bits. Verification is exact; recall is the method's (an edit after which the walk
    goes astray for long may be missed: 8 in 10 one-character edits of 500 characters are found at the least). The input must be a stable source.
    """
    source = stash(documents(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "edit-texts")
    prints = fingerprint(source, "row", "text").withColumnRenamed("doc_id", "row")
    rng = np.random.Generator(np.random.PCG64(SEED + 1))
    picks = [sorted(rng.choice(BITS, sampled, replace=False).tolist()) for _ in range(bands)]

    def sample(batches):
        for batch in batches:
            bits = np.unpackbits(np.frombuffer(b"".join(map(bytes.fromhex, batch.column(1).to_pylist())), dtype=np.uint8).reshape(-1, BITS // 8), axis=1).astype(np.int64)
            values = np.stack([(bits[:, p] << np.arange(sampled)).sum(axis=1) * bands + i for i, p in enumerate(picks)], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.tolist(), pa.list_(pa.int64()))], ["row", "bands"])

    def link(pairs: DataFrame, name: str) -> DataFrame:
        x, y = source.select(F.col("row").alias("a"), F.col("text").alias("ta")), source.select(F.col("row").alias("b"), F.col("text").alias("tb"))
        most = F.floor(share * F.greatest(F.length("ta"), F.length("tb"))).cast("int")
        likely = pairs.join(x, "a").join(y, "b").where(F.abs(F.length("ta") - F.length("tb")) <= most)
        near = likely.select("a", "b", F.col("ta").cast("binary"), F.col("tb").cast("binary"), most.alias("most")).mapInArrow(_near, "a long, b long")
        return stash(near, name)

    places = stash(prints.mapInArrow(sample, "row long, bands array<long>").select("row", F.explode("bands").alias("band")), "edit-bands")
    texts = source.select("row", F.col("text").cast("binary").alias("text"))
    # an edit changes three runs of three characters at most
    how = Overlap(lambda: _runs_of_three, lambda small, large: large - 3 * share * (large - 2), lambda size: size - 3 * share * (size - 2))
    labels = linked(places, texts, link, how)
    return attach(source.select("row", "doc_id"), stash(labels.withColumnRenamed("v", "row"), "edit-labels"), "row").select("doc_id", F.coalesce("label", "row").alias("class_id"))
