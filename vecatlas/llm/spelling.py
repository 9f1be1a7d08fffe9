"""Spelling variants: words a single edit apart, found in dense tiles of padded code-point matrices.

Words are maximal runs of letters (A-Z, a-z, U+00C0 to U+00FF), with A-Z lowered, of at least five code points and three occurrences.
Two words are near if one inserted, deleted or replaced code point makes one the other: then their common prefix and common suffix together reach the
longer length minus one. The edit lies in one of HOLES equal stretches of the longer word, and both words agree in all that stands around that
stretch. So a word is filed, for each stretch, under what is left and right of it, as the longer and as the shorter word: that loses no near pair, and only words that share
such a key are compared. Rows are sorted by key and cut into blocks; pairs of blocks that share a key become two dense comparisons of
code-point matrices, one padded on the right for prefixes and one on the left for suffixes. A key of more than SPLIT words is dealt by hash into sub-blocks, whose pairs are keys of their own, so that
no task has more than two of them at once. A pair counts at the key whose stretch holds its first difference, hence once. Tiles send a row for each word with near words, not
for each pair.

A word's form is its near word of the greatest n (ties: first in code-point order), if that is twice its own n at least; roots follow forms to
the last, by doubling steps. A null text has no words, a null id counts as an empty one; repeated rows count each; texts and runs may be of any length; an empty table gives an
empty result. Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecatlas.llm.common import attach, documents, frugal, stash

LETTERS, SHORTEST, OFTEN = r"[A-Za-zÀ-ÿ]", 5, 3
DROPS = 97
HOLES, SPLIT = 3, 4096
TILE, CELLS = 128, 1 << 22  # words in a block, and comparisons of code points at once
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drops: int = DROPS, least: int = OFTEN) -> DataFrame:
    """(word, n): runs by their occurrences. Where drops divides the crc32 of "<id>:<run>", the run has lost the code point of that number modulo its length."""
    runs = F.regexp_extract_all(F.col("text"), F.lit(f"{LETTERS}{{{SHORTEST},}}"), F.lit(0))  # a shorter run can't become a word
    rows = documents(docs, id_col, text_col).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    rows = rows.withColumn("run", F.translate("run", UPPER, LOWER))
    rows = rows.withColumn("h", F.crc32(F.concat_ws(":", "id", "run")))
    at = "cast(h % length(run) as int)"
    rows = rows.select(F.expr(f"if(h % {drops} = 0, concat(substring(run, 1, {at}), substring(run, {at} + 2)), run)").alias("word"))
    return rows.where(F.length("word") >= SHORTEST).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _filed(vocabulary: DataFrame, holes: int) -> DataFrame:
    """(key, longest, hole, word, n): each word as the longer one (length longest) and as the shorter one of a pair whose edit lies in the stretch hole."""
    places = F.array(*(F.struct((F.length("word") + d).alias("longest"), F.lit(s).alias("hole"), F.lit(d).alias("d")) for d in (0, 1) for s in range(holes)))
    rows = vocabulary.select("word", "n", F.explode(places).alias("p")).select("word", "n", "p.*")
    low, high = F.expr(f"longest * hole div {holes}"), F.expr(f"longest * (hole + 1) div {holes} - d")
    left, right = F.substring(F.col("word"), F.lit(1), low.cast("int")), F.substring(F.col("word"), (high + 1).cast("int"), F.col("longest"))
    return rows.where(high >= low).select(F.xxhash64("longest", "hole", left, right).alias("key"), "longest", "hole", "word", "n")


def _dealt(rows: DataFrame, split: int) -> DataFrame:
    """side, and for keys of more than split words a key for each pair of their sub-blocks: side 0 meets side 1, in pairs of different sub-blocks, and side 2 meets its own."""
    large = rows.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > split)
    large = stash(large.select("key", F.ceil(F.col("size") / split).cast("int").alias("parts")), "large-keys")
    if large.isEmpty():
        return rows.withColumn("side", F.lit(2))
    rows = attach(rows, large, "key").withColumn("own", F.pmod(F.xxhash64("word"), F.coalesce("parts", F.lit(1))).cast("int"))
    pairs = "if(parts is null, array(struct(-1 as i, -1 as j, 2 as side)), transform(sequence(0, parts - 1), k -> struct(least(k, own) as i, greatest(k, own) as j, case when k = own then 2 when own < k then 0 else 1 end as side)))"
    rows = rows.withColumn("p", F.explode(F.expr(pairs)))
    return rows.select(F.when(F.col("parts").isNull(), F.col("key")).otherwise(F.xxhash64("key", "p.i", "p.j")).alias("key"), "longest", "hole", "word", "n", "p.side")


def _matrices(block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of some words, padded right and padded left, and their lengths."""
    width = block.dtype.itemsize // 4
    points = block.view(np.uint32).reshape(len(block), width)
    size = (points > 0).sum(axis=1)
    at = np.arange(width)[None, :] - (width - size)[:, None]
    return points, np.where(at >= 0, np.take_along_axis(points, np.maximum(at, 0), axis=1), 0), size


def common(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the common prefix and suffix of each word of one block with each of another (as of _matrices, of equal width)."""
    (left_a, right_a, size_a), (left_b, right_b, size_b) = a, b
    least = np.minimum(size_a[:, None], size_b[None, :])

    def agree(x, y):
        differ = x[:, None, :] != y[None, :, :]
        return np.minimum(np.where(differ.any(axis=2), differ.argmax(axis=2), x.shape[1]), least)

    return agree(left_a, left_b), agree(right_a[:, ::-1], right_b[:, ::-1])


def near(a: tuple, b: tuple, longest: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which words are one edit apart, the longer of length longest, with the first difference from low to before high (of a's rows)."""
    prefix, suffix = common(a, b)
    long, short = np.maximum(a[2][:, None], b[2][None, :]), np.minimum(a[2][:, None], b[2][None, :])
    one_edit = (prefix + suffix >= long - 1) & (long - short <= 1) & ((prefix < long) | (short < long))
    return one_edit & (long == longest) & (prefix >= low[:, None]) & (prefix < high[:, None])


def _pairs(key: np.ndarray, side: np.ndarray, hole: np.ndarray, word: np.ndarray, longest: int, holes: int):
    """Indices of near pairs, both ways, among rows of one longest length sorted by key: tiles of each block with itself, and with later blocks while its last key goes on."""
    tile = max(1, min(TILE, int((CELLS / longest) ** 0.5)))
    low, high = longest * hole // holes, longest * (hole + 1) // holes
    block = lambda lo, hi: _matrices(word[lo:hi].astype(f"<U{longest}"))

    def met(lo, hi, a, from_, to, b):
        fits = near(a, b, longest, low[lo:hi], high[lo:hi]) & (key[lo:hi, None] == key[None, from_:to])
        i, j = np.nonzero(fits & ((side[lo:hi, None] == 2) | (side[lo:hi, None] != side[None, from_:to])))
        return lo + i, from_ + j

    for begin in range(0, len(key), tile):
        stop = min(begin + tile, len(key))
        a = block(begin, stop)
        yield met(begin, stop, a, begin, stop, a)
        if stop < len(key) and key[stop] == key[stop - 1]:
            first, last = max(begin, int(np.searchsorted(key, key[stop - 1]))), int(np.searchsorted(key, key[stop - 1], side="right"))
            a = tuple(x[first - begin :] for x in a)
            for lo in range(stop, last, tile):
                i, j = met(first, stop, a, lo, min(lo + tile, last), block(lo, min(lo + tile, last)))
                yield i, j
                yield j, i


def _compared(holes: int):
    """(word, n_near, minus best n, best word) for the words of a sorted partition that have near ones, some rows each."""

    def reduced(rows: dict[str, np.ndarray]):
        order = np.lexsort((rows["key"], rows["longest"]))  # words of one length together, so that matrices are no wider than needed
        rows = {c: v[order] for c, v in rows.items()}
        edges = np.flatnonzero(np.append(True, rows["longest"][1:] != rows["longest"][:-1]))
        found = []
        for lo, hi in zip(edges, [*edges[1:], len(order)], strict=True):
            some = [rows[c][lo:hi] for c in ("key", "side", "hole", "word")]
            found += [(lo + i, lo + j) for i, j in _pairs(*some, int(rows["longest"][lo]), holes) if len(i)]
        if not found:
            return
        i, j = (np.concatenate(x) for x in zip(*found, strict=True))
        word, n = rows["word"], rows["n"]
        kinds, name = np.unique(word, return_inverse=True)  # numpy and UTF-8 both order by code points
        by = np.lexsort((name[j], -n[j], name[i]))
        i, j = i[by], j[by]
        first = np.flatnonzero(np.append(True, name[i][1:] != name[i][:-1]))
        count = np.diff(np.append(first, len(i)))
        yield pa.RecordBatch.from_arrays([pa.array(word[i[first]].tolist(), pa.string()), pa.array(count.astype(np.int64)), pa.array(-n[j[first]]), pa.array(word[j[first]].tolist(), pa.string())], ["word", "n_near", "neg", "best"])

    def tiled(rows: dict[str, np.ndarray]):
        key = rows["key"]
        same = key[1:] == key[:-1]
        shared = np.append(same, False) | np.append(False, same) if len(key) else np.zeros(0, dtype=bool)
        if shared.any():
            yield from reduced({c: v[shared] for c, v in rows.items()})

    def run(batches):
        kept: dict[str, np.ndarray] = {}
        for batch in batches:
            rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "longest", "hole", "side", "n")} | {"word": np.array(batch.column("word").to_pylist(), dtype=object)}
            if kept:
                rows = {c: np.concatenate([kept[c], v]) for c, v in rows.items()}
            key = rows["key"]
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
            kept = {c: v[cut:] for c, v in rows.items()}
            yield from tiled({c: v[:cut] for c, v in rows.items()})
        if kept:
            yield from tiled(kept)

    return run


def variants(vocabulary: DataFrame, holes: int = HOLES, split: int = SPLIT) -> DataFrame:
    """(word, n, n_near, form, form_n) for a stored vocabulary (word, n): the number of near words and the form, null if there is none."""
    rows = _dealt(_filed(vocabulary, holes), split).repartition("key").sortWithinPartitions("key")
    parts = rows.mapInArrow(frugal(_compared(holes)), "word string, n_near long, neg long, best string")
    both = parts.select("word", F.lit(None).cast("long").alias("n"), "n_near", F.struct("neg", "best").alias("b"))
    own = vocabulary.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("struct<neg: bigint, best: string>").alias("b"))
    joined = both.unionByName(own).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("b").alias("b"))
    taken = -F.col("b.neg") >= 2 * F.col("n")
    return joined.select("word", "n", "n_near", F.when(taken, F.col("b.best")).alias("form"), F.when(taken, -F.col("b.neg")).alias("form_n"))


def with_roots(forms: DataFrame) -> DataFrame:
    """forms (a stored table with word and form, null where there is none) with root. A step takes the root of a root, so chains halve; only those that go on are looked up."""
    rows = stash(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        more = stash(rows.select(F.col("root").alias("word")).distinct().join(rows, "word").select(F.col("word").alias("root"), F.col("root").alias("next")), "next-roots")
        if more.isEmpty():
            break
        rows = stash(attach(rows, more, "root").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return forms.join(rows, "word", "left").withColumn("root", F.coalesce("root", "word"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of the documents."""
    forms = stash(variants(stash(words(docs, id_col, text_col), "words")), "forms")
    return with_roots(forms).select("word", "form", "root", "n", "n_near", "form_n")
