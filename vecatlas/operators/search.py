"""Nearest, farthest and best rows by cosine."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecatlas.functions.vectors import dot, normal_cdf, norm, unit


def literal(vec: list[float]) -> str:
    return f"array({','.join(f'{float(x)!r}D' for x in vec)})"


def similar(df: DataFrame, query_id: int, k: int, mode: str = "near") -> DataFrame:
    """The k rows most (or least) like one row, itself left out; ties in path order. The one query row is a literal, so the plan is a scan with a top-k."""
    row = df.where(F.col("id") == query_id).select("vec").first()
    if row is None:
        return df.select("id", "path", F.lit(0.0).alias("score")).limit(0)
    q = literal(row["vec"])
    length = float(np.linalg.norm(row["vec"])) or 1.0
    score = F.round(dot("vec", q) / F.greatest(norm("vec") * length, F.lit(1e-12)), 6)
    order = F.desc("score") if mode == "near" else F.asc("score")
    return df.where(F.col("id") != query_id).select("id", "path", score.alias("score")).orderBy(order, "path").limit(k)


def best_segments(entries: DataFrame, query: list[float], limit: int) -> DataFrame:
    """(fingerprint, score, pos) of the rows whose best segment is most like the query; among equal segments the earlier one. Rows without any segment come last, without a score."""
    q = literal(query)
    length = float(np.linalg.norm(query)) or 1.0
    scored = entries.withColumn("score", F.when(F.col("pos").isNotNull(), F.round(dot("vec", q) / F.greatest(norm("vec") * length, F.lit(1e-12)), 6)))
    best = scored.groupBy("fingerprint").agg(F.max(F.when(F.col("score").isNotNull(), F.struct("score", (-F.col("seg")).alias("back"), "pos"))).alias("b"))
    return best.select("fingerprint", "b.score", "b.pos").orderBy(F.desc_nulls_last("score"), "fingerprint").limit(limit)


NUMBERS = 1 << 22  # numbers in the vectors of a block
ROWS, COLUMNS, FIRST = 256, 1024, 32  # queries, and candidates at most and at first, that are scored at once


def dealt(rows: DataFrame, asked: DataFrame, vectors: list[str], blocks: int | None = None) -> DataFrame:
    """Query rows (side 0) and rows (side 1), each with its vector columns, for every pair (a, b) of a query block and a block; a group of a and b is one task's work.

    A block holds about NUMBERS numbers at most, however many rows there are, and there are as many pairs as shuffle partitions at least.
    """
    n, width = rows.agg(F.count("*"), F.max(sum((F.size(c) for c in vectors), F.lit(0)))).first()
    partitions, whole = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n * (width or 0) // NUMBERS)
    most = blocks or max(1, whole, round(partitions**0.5 / 2))
    asking = blocks or max(1, whole, -(-partitions // most))
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("a", own(asking)).withColumn("b", each(most)).withColumn("side", F.lit(0))
    return left.unionByName(rows.withColumn("a", each(asking)).withColumn("b", own(most)).withColumn("side", F.lit(1)))


def matrix(column) -> np.ndarray:
    """An Arrow column of equally long lists without nulls as a matrix."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), -1)


def lists(x: np.ndarray) -> pa.ListArray:
    """A matrix as an Arrow column, without a Python number for each of its own."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).ravel()))


def best_columns(score, rows: int, columns: int, k: int, barred: list, least: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, column, value) of each row's k greatest scores, rounded to 6 places, ties by the lesser column, for each rule of which pairs don't count.

    score(first, end) is the matrix of those columns, barred are functions of rows and columns. Scores below a row's least are left out. Only what exceeds the k-th score so far is looked at again, so nothing is sorted as a whole.
    """
    floor = np.full(rows, -np.inf) if least is None else least - 1e-6
    found = [(np.full((rows, k), -1), np.repeat(floor[:, None], k, axis=1)) for _ in barred]
    lo, wide = 0, FIRST if least is None else COLUMNS
    while lo < columns:
        s = score(lo, min(columns, lo + wide))
        low = np.minimum.reduce([value[:, -1:] for _, value in found])
        i, j = np.divmod(np.flatnonzero(s > low + 4e-7), s.shape[1])  # later columns win no ties
        v = np.round(s[i, j], 6)
        for (at, value), no in zip(found, barred, strict=True):
            better = v > value[i, -1] + 4e-7
            better[better] = ~no(i[better], lo + j[better])
            _merge(at, value, i[better], lo + j[better], v[better])
        lo, wide = lo + wide, min(2 * wide, COLUMNS)
    out = []
    for at, value in found:
        i, place = np.nonzero(at >= 0)
        out.append((i, at[i, place], value[i, place]))
    return out


def _merge(at: np.ndarray, value: np.ndarray, i: np.ndarray, j: np.ndarray, v: np.ndarray) -> None:
    """Put columns j with values v among the best so far of their rows i."""
    k, rows = at.shape[1], np.unique(i)
    i, j, v = np.concatenate([np.repeat(rows, k), i]), np.concatenate([at[rows].ravel(), j]), np.concatenate([value[rows].ravel(), v])
    order = np.lexsort((j, -v, i))
    i, j, v = i[order], j[order], v[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    best = place < k
    at[i[best], place[best]], value[i[best], place[best]] = j[best], v[best]


class Best:
    """The k best others of each of some rows, from pairs that come with others in rising order; ties by the lesser other. No row needs what is not above its floor."""

    def __init__(self, rows: int, k: int):
        self.rows, self.k, self.floor = rows, k, np.full(rows, -np.inf)
        self.held, self.size, self.sorted = [], 0, 0

    def add(self, own: np.ndarray, other: np.ndarray, value: np.ndarray) -> None:
        self.held.append((own, other, value))
        self.size += len(own)
        if self.size > self.sorted + 2 * self.k * self.rows:
            self.found()

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(own, other, value) by own and falling value; raises the floors of rows that have k."""
        own, other, value = (np.concatenate(c) for c in zip((np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), *self.held, strict=True))
        order = np.argsort((own << 22) + np.rint((2 - value) * 1e6).astype(np.int64), kind="stable")
        own = own[order]
        counts = np.bincount(own, minlength=self.rows)
        place = np.arange(len(own)) - (np.cumsum(counts) - counts)[own]
        order, own, place = (a[place < self.k] for a in (order, own, place))
        other, value = other[order], value[order]
        last = place == self.k - 1
        self.floor[own[last]] = np.maximum(self.floor[own[last]], value[last])
        self.held, self.size, self.sorted = [(own, other, value)], len(own), len(own)
        return own, other, value


def exceeding(s: np.ndarray, least: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Places (flat) of what exceeds, in rising order; eight are skipped at once. room is for a boolean each, rounded up to eight."""
    above = room[: -(-s.size // 8) * 8]
    above[s.size :] = False
    np.greater(s, least, out=above[: s.size].reshape(s.shape))
    some = np.flatnonzero(above.view(np.uint64))
    at, bit = np.nonzero(above.reshape(-1, 8)[some])
    return 8 * some[at] + bit


def meet(x: np.ndarray, y: np.ndarray, k: int, barred, both: bool = False) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, other, value): the k greatest products of each row of x with rows of y, and, with both, of each row of y with rows of x. Values are rounded to 6 places, ties go to the lesser other.

    Rows are of length 1 at most; barred(i, j) says which pairs don't count. A pair is multiplied once for both sides, in 32 bits; only what these cannot rule out is multiplied in 64.
    """
    near, far = x.astype(np.float32), y.astype(np.float32)
    error = (x.shape[1] + 8) * 2.0**-24  # of a 32-bit product
    theirs, out = Best(len(y), k), []
    room, flags = np.empty(COLUMNS * COLUMNS, dtype=np.float32), np.empty(COLUMNS * COLUMNS, dtype=bool)
    for lo in range(0, len(x), COLUMNS):
        ours = Best(min(COLUMNS, len(x) - lo), k)
        for at in range(0, len(y), COLUMNS):
            a, b = near[lo : lo + COLUMNS], far[at : at + COLUMNS]
            s, exact = np.matmul(a, b.T, out=room[: len(a) * len(b)].reshape(len(a), len(b))), None
            for side, best in enumerate((ours, theirs)[: 1 + both]):
                floor = best.floor if side == 0 else best.floor[at : at + COLUMNS]  # a view
                along = (slice(None), None) if side == 0 else (None, slice(None))
                if s.shape[1 - side] >= k and np.isneginf(floor).any():
                    some = s[:, : max(k, ROWS)] if side == 0 else s[: max(k, ROWS)]
                    no = barred(np.arange(lo, lo + some.shape[0])[:, None], np.arange(at, at + some.shape[1])[None, :])
                    some = np.where(no | np.isnan(some), np.float32(-np.inf), some)
                    kth = np.partition(some if side == 0 else np.ascontiguousarray(some.T), -k, axis=1)[:, -k]
                    np.maximum(floor, kth - (error + 2e-6), out=floor)
                least = np.nextafter((floor + (4e-7 - error)).astype(np.float32), np.float32(-np.inf))  # later ones win no ties
                hits = exceeding(s, least[along], flags)
                many = len(hits) > s.size // 16  # as of copies, that only the exact product leaves behind
                if many:
                    exact = x[lo : lo + COLUMNS] @ y[at : at + COLUMNS].T if exact is None else exact
                    hits = exceeding(exact, (floor + 4e-7)[along], flags)
                i, j = np.divmod(hits, s.shape[1])
                free = ~barred(i + lo, j + at)
                i, j = i[free], j[free]
                v = np.round(exact[i, j] if many else np.einsum("ij,ij->i", x.take(i + lo, axis=0), y.take(j + at, axis=0)), 6)
                better = v > floor[i if side == 0 else j] + 4e-7
                i, j, v = i[better], j[better], v[better]
                best.add(*((i, j + at) if side == 0 else (j + at, i + lo)), v)
        own, other, v = ours.found()
        out.append((own + lo, other, v))
    mine = tuple(np.concatenate(c) for c in zip(*out, strict=True))
    return [mine, theirs.found()] if both else [mine]


def paired(rows: DataFrame, vectors: list[str], blocks: int | None = None) -> DataFrame:
    """Rows for every unordered pair (a, b) of blocks, a <= b: those of block a are side 0, those of another block b side 1. A group is one task's work; blocks are as in dealt()."""
    n, width = rows.agg(F.count("*"), F.max(sum((F.size(c) for c in vectors), F.lit(0)))).first()
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many = blocks or max(1, -(-n * (width or 0) // NUMBERS), round(partitions**0.5))
    each = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(many)).cast("int")).withColumn("met", F.explode(F.sequence(F.lit(0), F.lit(many - 1))))
    return each.select(*rows.columns, F.least("own", "met").alias("a"), F.greatest("own", "met").alias("b"), (F.col("own") > F.col("met")).cast("int").alias("side"))


def knn(df: DataFrame, k: int, *, blocks: int | None = None, label: str | None = None, queries: DataFrame | None = None) -> DataFrame:
    """(id, other, score): the k most alike other rows of each row by cosine of vec; ties by least id. With label only rows of another label count.

    Rows are dealt to blocks by id; two blocks meet once, for the rows of both, a row's k best there are kept as they come, and a ranking joins these:
    k rows per row and block are shuffled, never all pairs. queries are a subset of the rows (all by default); their blocks meet each block.
    """
    cols = ["id", "vec", *([F.col(label).alias("label")] if label else [F.lit(0).alias("label")])]
    base = unit(df, "vec", "vec").select(*cols)
    both = queries is None
    groups = paired(base, ["vec"], blocks) if both else dealt(base, base.join(queries.select("id"), "id", "left_semi"), ["vec"], blocks)

    def nearest(key, table):
        side = np.array(table["side"])
        q, d = (table.filter(pa.array(side == s)).sort_by("id") for s in (0, 1))
        inner = both and key[0].as_py() == key[1].as_py()
        d = q if inner else d
        parts = []
        if q.num_rows and d.num_rows:
            qi, di, ql, dl = (np.array(t[c]) for c in ("id", "label") for t in (q, d))
            barred = lambda i, j: (qi[i] == di[j]) | (ql[i] == dl[j]) if label else qi[i] == di[j]
            found = meet(matrix(q["vec"]), matrix(d["vec"]), k, barred, both and not inner)
            parts = [(own[i], other[j], s) for (own, other), (i, j, s) in zip(((qi, di), (di, qi)), found, strict=False)]
        arrays = [np.concatenate(c) for c in zip(*parts, strict=True)] or [np.zeros(0)] * 3
        return pa.table([pa.array(a, t) for a, t in zip(arrays, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["id", "other", "score"])

    local = groups.groupBy("a", "b").applyInArrow(nearest, "id long, other long, score double")
    w = Window.partitionBy("id").orderBy(F.desc("score"), "other")
    return local.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def edges(neighbours: DataFrame) -> DataFrame:
    """Undirected edges (src < dst) with the greater weight of the two directions, never below 0."""
    return neighbours.groupBy(F.least("id", "other").alias("src"), F.greatest("id", "other").alias("dst")).agg(F.greatest(F.max("score"), F.lit(0.0)).alias("weight"))


def hard_negatives(df: DataFrame, label: str, k: int = 3) -> DataFrame:
    """Unordered pairs of a row and its k nearest rows of another label."""
    near = knn(df.where(F.col(label) >= 0), k, label=label)
    return near.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def rank_prompts(rows: DataFrame, prompts: DataFrame, limit: int, least: float = 0.35) -> DataFrame:
    """The best prompt of each row and, up to limit, others of a cosine of at least ``least``. prompts is a small table (checked)."""
    if prompts.count() > 100_000:
        raise ValueError("prompts are meant to be few")
    p = unit(prompts, "vec", "pv").select("prompt_id", "text", "pv")
    r = unit(rows, "vec", "rv").select("id", "rv")
    scored = r.join(F.broadcast(p), F.size("rv") == F.size("pv")).select("id", "prompt_id", "text", F.round(dot("rv", "pv"), 6).alias("score"))
    w = Window.partitionBy("id").orderBy(F.desc("score"), "prompt_id")
    return scored.withColumn("rank", F.row_number().over(w)).where((F.col("rank") <= limit) & ((F.col("rank") == 1) | (F.col("score") >= least)))


def axis_coordinates(rows: DataFrame, axes: DataFrame, limit: int = 6) -> DataFrame:
    """The axes on which a row stands out most: z of its projection on unit(pos - neg), percentile, pole. axes is a small table."""
    a = unit(axes.withColumn("d", F.expr("zip_with(pos_vec, neg_vec, (p, n) -> CAST(p AS DOUBLE) - CAST(n AS DOUBLE))")), "d", "d").select("axis_id", "d", "mean", "std", "reliability")
    r = unit(rows, "vec", "rv").select("id", "rv")
    z = r.join(F.broadcast(a), F.size("rv") == F.size("d")).withColumn("z", (dot("rv", "d") - F.col("mean")) / F.col("std"))
    z = z.withColumn("strength", F.round(F.abs("z") * F.col("reliability"), 4)).withColumn("percentile", F.round(normal_cdf("z"), 4))
    w = Window.partitionBy("id").orderBy(F.desc("strength"), "axis_id")
    z = z.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
    return z.select("id", "axis_id", F.round("z", 4).alias("z"), "percentile", F.when(F.col("percentile") >= 0.5, "pos").otherwise("neg").alias("pole"), "rank")


def top_styles(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k greatest entries (place, score) of each row's vector without exploding it."""
    best = F.expr(f"slice(array_sort(transform({column}, (s, i) -> struct(-CAST(s AS DOUBLE) AS back, i AS style))), 1, {k})")
    return df.select("fingerprint", F.posexplode(best).alias("rank", "b")).select("fingerprint", (F.col("rank") + 1).alias("rank"), F.col("b.style").alias("style"), F.round(-F.col("b.back"), 6).alias("score"))
