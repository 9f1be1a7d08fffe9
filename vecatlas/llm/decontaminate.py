"""Benchmark decontamination with DataFrame functions only.

A benchmark item of n words is looked for in windows of n words. A window of the wanted similarity lacks a fifth of the item's shingles at most, so it holds one of any fifth and one
more: an item is filed under its rarest shingles only, those of the fewest items, and what many items have in common makes no candidates. In the texts that share such a
shingle with an item, a window that moves on to its next shingle of the item loses none; so only windows that begin with a shingle of the item (or are the text's last, where that would run over its end)
are fingerprinted: all that can matter, whatever the number of other windows.

Every such window and every item gets a 64-bit SimHash of its weighted five-word shingles; bit counts run along a text once, and a window's are the difference of two. Fingerprints are cut into
RADIUS + 1 blocks; two that differ in at most RADIUS bits agree in one block at least, so item, block number and block value find all of them. A pair is
compared at its first common block. Similarity 0.8 means 9.7 differing bits on average; 21 is four standard deviations more. The exact weighted Jaccard similarity of the shingle multisets then
decides; overlaps are running sums along a text too, so no window is ever laid out, and a text of one word repeated, against an item like it, costs as much as any other.

Equal texts are looked at once. Words are runs between ASCII blanks of the lower-cased text. An item of fewer
than five words is one shingle of all its words, found where a text has these words in a row; a text shorter than an item is a window as a whole.
Items without words, null texts and null items match nothing; null ids are ordinary values. Texts and items may be of any length, and a shingle may occur any number
of times in them. Of windows that are equally alike the first counts. Repeated rows give repeated rows of the result. Empty tables give an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecatlas.llm.common import attach, documents, semi, stash

WORDS, LIKE, RADIUS = 5, 0.8, 21
BROADCAST_ROWS = 1_000_000  # a longer list of what belongs to items is joined by shuffling
BLANKS = " \t\n\x0b\f\r"
EDGES = [64 * i // (RADIUS + 1) for i in range(RADIUS + 2)]


def _words(df: DataFrame) -> DataFrame:
    """text replaced by h, the hashes of its words."""
    plain = F.btrim(F.lower("text"), F.lit(BLANKS))
    return df.withColumn("h", F.when(plain == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(plain, r"[ \t\n\x0B\f\r]+"), lambda w: F.xxhash64(w)))).drop("text")


def _rows_of(k: int) -> str:
    """The hashes of all k words in a row, as an expression."""
    return f"if(size(h) < {k}, cast(array() as array<bigint>), transform(sequence(0, size(h) - {k}), i -> xxhash64({', '.join(f'h[i + {j}]' for j in range(k))})))"


def _shingles(df: DataFrame) -> DataFrame:
    """h replaced by sh, the hashes of its five-word shingles in order."""
    return df.withColumn("sh", F.expr(_rows_of(WORDS))).drop("h")


def _placed(df: DataFrame) -> DataFrame:
    """(k1, k2, n_sh, at, s): a row for each shingle. Structs are exploded, not the shingles themselves: for a plain column Spark would add a filter on its size, and work the words out anew for each shingle in it."""
    return _shingles(df).select("k1", "k2", F.size("sh").alias("n_sh"), F.explode(F.expr("transform(sh, (s, i) -> struct(i as at, s as s))")).alias("p")).select("k1", "k2", "n_sh", "p.*")


def _fingerprinted(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys and simhash: bit b is set if more than half of the shingles have it. Two 32-bit counters share a long."""
    rows = df.select(*keys, F.explode("sh").alias("s"))
    sums = [F.sum(F.expr("(x & 1) | shiftleft(x & 2, 31)".replace("x", f"shiftrightunsigned(s, {2 * g})"))).alias(f"c{g}") for g in range(32)]
    counted = rows.groupBy(*keys).agg(F.count("*").alias("n_sh"), *sums)
    # written, so that the long expression is planned and computed once and not once for each block
    return stash(counted.select(*keys, _signs(F.col("n_sh"))), "simhash")


def _signs(n: Column) -> Column:
    """simhash from the counters c0 to c31 of n shingles."""
    bits = [F.when(2 * F.expr(f"shiftrightunsigned(c{b // 2}, {32 * (b % 2)}) & 4294967295L") > n, F.lit(1 << b if b < 63 else -(1 << 63))).otherwise(F.lit(0)) for b in range(64)]
    return reduce(lambda a, b: a.bitwiseOR(b.cast("bigint")), bits, F.lit(0).cast("bigint")).alias("simhash")


def _block(i: int, value: str) -> str:
    a, b = EDGES[i], EDGES[i + 1]
    return f"shiftrightunsigned({value}, {a}) & {(1 << (b - a)) - 1}L"


def _blocks(df: DataFrame) -> DataFrame:
    """A row for each block of the fingerprint."""
    return df.select("*", F.posexplode(F.array(*(F.expr(_block(i, "simhash")) for i in range(RADIUS + 1)))).alias("block", "value"))


def _first_common() -> Column:
    """The number of the first block in which two fingerprints agree."""
    differ = "(simhash ^ item_simhash)"
    return F.expr("case " + " ".join(f"when ({_block(i, differ)}) = 0 then {i}" for i in range(RADIUS + 1)) + " end")


def _slid(places: DataFrame, windows: DataFrame) -> DataFrame:
    """k1, k2, start, size and simhash of windows (k1, k2, start, size) over the shingles (k1, k2, at, s) of texts, stored.

    Bit counts run along each text once; a window's are the difference of two running counts, so long windows that overlap cost no more than short ones.
    """
    ends = windows.select("k1", "k2", "start", "size", F.explode(F.array(F.struct((F.col("start") - 1).alias("at"), F.lit(-1).alias("sign")), F.struct((F.col("start") + F.col("size") - 1).alias("at"), F.lit(1).alias("sign")))).alias("e"))
    both = places.select("k1", "k2", "at", "s").unionByName(ends.where("e.at >= 0").select("k1", "k2", "e.at", "e.sign", "start", "size"), allowMissingColumns=True)
    # ends stand among the shingles, behind the one of their place; so rows are moved once, before the counters are made, and windows come from where they are
    rows = both.repartition("k1", "k2").withColumn("end", F.col("sign").isNotNull())
    here = [F.expr("coalesce((x & 1) | shiftleft(x & 2, 31), 0L)".replace("x", f"shiftrightunsigned(s, {2 * g})")) for g in range(32)]
    so_far = Window.partitionBy("k1", "k2").orderBy("at", "end").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = rows.select("k1", "k2", "start", "size", "sign", "end", *(F.sum(x).over(so_far).alias(f"c{g}") for g, x in enumerate(here))).where("end")
    counted = running.groupBy("k1", "k2", "start", "size").agg(*(F.sum(F.col("sign") * F.col(f"c{g}")).alias(f"c{g}") for g in range(32)))
    return stash(counted.select("k1", "k2", "start", "size", _signs(F.col("size"))), "simhash")


def _overlaps(hits: DataFrame, starts: DataFrame) -> DataFrame:
    """starts (k1, k2, item, start) with common, the size of the multiset overlap of the window with its item.

    hits (k1, k2, item, s, at, times, size) are the places of the item's shingles in the text; the item has a shingle ``times`` times. A place counts for the windows that hold it and fewer than ``times`` places
    of its shingle before it: for a run of starts. So the overlap is a running sum over ends of runs, and no window is laid out.
    """
    placed = hits.groupBy("k1", "k2", "item", "s", "times", "size").agg(F.sort_array(F.collect_list("at")).alias("p"))
    runs = F.expr("transform(p, (x, i) -> struct(greatest(if(i >= times, p[i - times] + 1, 0), x - size + 1, 0) as low, x + 1 as high))")
    ends = placed.select("k1", "k2", "item", F.explode(runs).alias("r")).where("r.low < r.high")
    ends = ends.select("k1", "k2", "item", F.explode(F.array(F.struct(F.col("r.low").alias("start"), F.lit(1).alias("step")), F.struct(F.col("r.high").alias("start"), F.lit(-1).alias("step")))).alias("e")).select("k1", "k2", "item", "e.*")
    steps = ends.groupBy("k1", "k2", "item", "start").agg(F.sum("step").alias("step")).withColumn("asked", F.lit(0))
    both = steps.unionByName(starts.select("k1", "k2", "item", "start").withColumn("step", F.lit(0).cast("long")).withColumn("asked", F.lit(1)))
    so_far = Window.partitionBy("k1", "k2", "item").orderBy("start", "asked").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("common", F.sum("step").over(so_far)).where("asked = 1").select("k1", "k2", "item", "start", "common")


def _filed(items: DataFrame) -> DataFrame:
    """(item, n, m, s, times, rare) of items of five words and more, stored: their shingles, and whether an item is filed under them."""
    shingles = items.select("item", "n", F.size("sh").alias("m"), F.explode("sh").alias("s")).groupBy("item", "n", "m", "s").agg(F.count("*").cast("int").alias("times"))
    shared = shingles.groupBy("s").agg(F.count("*").alias("items"))
    before = F.sum("times").over(Window.partitionBy("item").orderBy("items", "s").rowsBetween(Window.unboundedPreceding, -1))
    return stash(shingles.join(shared, "s").withColumn("rare", F.coalesce(before, F.lit(0)) <= F.floor((1 - LIKE) * F.col("m") + 1e-9)), "item-shingles")


def _candidates(hashed: DataFrame, shingles: DataFrame) -> DataFrame:
    """(k1, k2, item), stored: the items that have a shingle they are filed under in common with a text (k1, k2, h)."""
    rare = shingles.where("rare").select("s", "item")
    bounded = F.broadcast if rare.count() <= BROADCAST_ROWS else (lambda df: df)
    seeds = stash(_placed(hashed).select("k1", "k2", "s").join(bounded(rare.select("s").distinct()), "s", "left_semi").distinct(), "seeds")
    return stash(seeds.join(bounded(rare), "s").select("k1", "k2", "item").distinct(), "candidates")


def found(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(k1, k2, item_id, start, words, similarity), stored: for each different text, named by two hashes (see :func:`keyed`), and each item that it holds."""
    raw = _words(documents(benchmark, item_col, item_text_col).withColumnRenamed("doc_id", "item_id")).where("size(h) > 0")
    whole = F.when(F.size("h") < WORDS, F.array(F.expr("xxhash64(size(h), h)"))).otherwise(F.expr(_rows_of(WORDS)))
    items = stash(raw.select("item_id", F.size("h").alias("n"), whole.alias("sh"), F.monotonically_increasing_id().alias("item")), "items")
    long, short = items.where(F.col("n") >= WORDS), items.where(F.col("n") < WORDS)
    shingles = _filed(long)
    bounded = F.broadcast if shingles.count() <= BROADCAST_ROWS else (lambda df: df)

    texts = documents(docs, None, text_col).select("text", *keyed("text"))
    hashed = _words(texts)
    candidates = _candidates(hashed, shingles)
    own = candidates.select("k1", "k2").distinct()
    held = semi(texts, stash(own, "held"), "k1", "k2").groupBy("k1", "k2").agg(F.first("text").alias("text"))
    places = stash(_placed(_words(held)), "places")

    wanted = candidates.join(bounded(shingles.select("item", "n", "m", "s", "times")), "item")
    hits = stash(wanted.join(places, ["k1", "k2", "s"]).withColumn("size", F.least("m", "n_sh")).select("k1", "k2", "item", "n", "m", "size", "s", "times", "at", "n_sh"), "hits")
    starts = stash(hits.select("k1", "k2", "item", "n", "m", "size", F.least("at", F.col("n_sh") - F.col("size")).alias("start")).distinct(), "window-starts")
    prints = _slid(places, starts.select("k1", "k2", "start", "size").distinct())
    of_windows = _blocks(starts.join(prints, ["k1", "k2", "start", "size"]))
    of_items = stash(_blocks(_fingerprinted(long, ["item"]).withColumnRenamed("simhash", "item_simhash").withColumn("simhash", F.col("item_simhash"))).drop("simhash"), "item-blocks")
    met = of_windows.join(bounded(of_items), ["item", "block", "value"])
    near = met.where((F.bit_count(F.col("simhash").bitwiseXOR(F.col("item_simhash"))) <= RADIUS) & (F.col("block") == _first_common()))
    pairs = stash(near.select("k1", "k2", "item", "n", "m", "size", "start"), "near-windows")
    verified = hits.join(pairs.select("k1", "k2", "item").distinct(), ["k1", "k2", "item"], "left_semi")
    exact = pairs.join(_overlaps(verified, pairs), ["k1", "k2", "item", "start"])
    exact = exact.withColumn("similarity", F.col("common") / (F.col("size") + F.col("m") - F.col("common"))).where(F.col("similarity") >= LIKE)
    best = exact.groupBy("k1", "k2", "item").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), "n")).alias("best"))
    out = best.select("k1", "k2", "item", (-F.col("best.back")).alias("start"), F.col("best.n").alias("words"), "best.similarity")

    for k in sorted(r["n"] for r in short.select("n").distinct().collect()):  # four values at most; a window of one shingle is the item or has nothing of it
        rows = F.expr(f"if(size(h) < {k}, cast(array() as array<struct<at: int, s: bigint>>), transform(sequence(0, size(h) - {k}), i -> struct(cast(i as int) as at, xxhash64({k}, slice(h, i + 1, {k})) as s)))")
        whole_ones = short.where(F.col("n") == k).select("item", F.col("sh")[0].alias("s"))
        some = hashed.select("k1", "k2", F.explode(rows).alias("p")).select("k1", "k2", "p.*").join(bounded(whole_ones.select("s").distinct()), "s", "left_semi")
        first = some.groupBy("k1", "k2", "s").agg(F.min("at").alias("start"))
        out = out.unionByName(first.join(whole_ones, "s").select("k1", "k2", "item", "start", F.lit(k).alias("words"), F.lit(1.0).alias("similarity")))
    return stash(out.join(bounded(items.select("item", "item_id")), "item").select("k1", "k2", "item_id", "start", "words", "similarity"), "leaks")


def keyed(text_col: str) -> tuple[Column, Column]:
    """The two hashes that name a text; a null text is an empty one."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2")


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, start, words, similarity): for each document and item that it holds, the first of its most similar windows; start counts words."""
    one = found(docs, benchmark, text_col, item_col, item_text_col).groupBy("k1", "k2").agg(F.collect_list(F.struct("item_id", "start", "words", "similarity")).alias("held"))
    rows = attach(docs.select(F.col(id_col).alias("doc_id"), *keyed(text_col)), stash(one, "held-items"), "k1", "k2", how="inner")
    return rows.select("doc_id", F.explode("held").alias("i")).select("doc_id", "i.*")


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text holds no item; each row is judged by its own text, whatever its id."""
    held = stash(found(docs, benchmark, text_col).select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")).distinct().withColumn("__held", F.lit(True)), "leaking")
    one, two = keyed(text_col)
    return attach(docs.withColumn("__k1", one).withColumn("__k2", two), held, "__k1", "__k2").where("__held is null").select(*docs.columns)
