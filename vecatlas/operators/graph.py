"""Components, communities and their names on graphs of items."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecatlas.operators.search import knn
from vecatlas.sources.scratch import stash


def stars(items: DataFrame, id_col: str, identities: list[str]) -> DataFrame:
    """Links (a, b) from each item to the least item of every identity that it has; null and empty identities link nothing. A popular identity is as many links as items."""
    out = None
    for c in identities:
        known = items.select(F.col(id_col).alias("a"), F.nullif(F.col(c), F.lit("")).alias("key")).where("key IS NOT NULL")
        links = known.join(known.groupBy("key").agg(F.min("a").alias("b")), "key").select("a", "b")
        out = links if out is None else out.unionByName(links)
    return out


def components(links: DataFrame) -> DataFrame:
    """(v, label) for every vertex of the links (a, b), both long; the label is the least vertex of its component.

    Each round takes the least label among the neighbours and then the label of that label, so long
    chains halve. Rounds go on until nothing changes; each is written to the shared folder.
    """
    both = stash(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links")
    labels = stash(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("n")).select("v", F.least("v", "n").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("near"))
        step = labels.join(near, "v").select("v", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = step.select(F.col("v").alias("label"), F.col("label").alias("up"))
        new = stash(step.join(jump, "label", "left").select("v", "old", F.coalesce(F.least("up", "label"), "label").alias("label")), "labels")
        labels = new.select("v", "label")
        if new.where("label < old").isEmpty():
            return labels


def bridged(edges: DataFrame, rows: DataFrame, most: int | None = None) -> DataFrame:
    """edges (src, dst, weight) with bridges that make the graph of rows (id, vec) one: the links of a maximum spanning tree over its components, by cosine (as weight at least 0).

    In a round each component but that of most rows takes its strongest pair with any other one (ties: least ids), which about halves their number; all pairs
    of rounds together are that tree. What a row has found stays its best until it has joined the row's component, and its score bounds what the row can find then;
    so only rows that may have their component's strongest pair are searched again. A row without an edge is a component; one without a cosine stays apart.
    Only a caller that gives ``most`` has the edges as they are beyond so many components.
    """
    edges = stash(edges.select("src", "dst", "weight"), "edges")  # a kNN search may lie behind them
    known = components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))).withColumnRenamed("v", "id")
    whole = stash(rows.select("id", "vec").join(known, "id", "left").select("id", "vec", F.coalesce("label", "id").alias("label")), "parted")
    if most is not None and whole.select("label").distinct().count() > most:
        return edges
    parted = stash(whole.groupBy("label", "vec").agg(F.min("id").alias("id")), "parted")  # a component's equal vectors tie, so the least id stands for them
    near = parted.select("id", F.lit(None).cast("long").alias("other"), F.lit(None).cast("double").alias("score")).where("false")
    while True:
        labels = parted.select("id", "label")
        theirs = labels.toDF("other", "theirs")
        sizes = labels.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").take(2)
        if len(sizes) < 2:
            return edges
        told = labels.where(F.col("label") != sizes[0]["label"]).join(near, "id", "left").join(theirs, "other", "left")
        told = stash(told.select("id", "other", "score", "label", F.coalesce(F.col("label") != F.col("theirs"), F.lit(False)).alias("live")), "told")
        least = told.where("live").groupBy("label").agg(F.max("score").alias("least"))
        asked = stash(told.where("NOT live").join(least, "label", "left").where("score IS NULL OR least IS NULL OR score >= least").select("id"), "asked")
        near = told.join(asked, "id", "left_anti").select("id", "other", "score")
        if not asked.isEmpty():
            near = stash(near.unionByName(knn(parted, 1, label="label", queries=asked).select("id", "other", "score")), "near")
        pair = F.struct("score", (-F.least("id", "other")).alias("src"), (-F.greatest("id", "other")).alias("dst"), "theirs")
        best = near.join(labels, "id").join(theirs, "other").where("label <> theirs").groupBy("label").agg(F.max(pair).alias("p"))
        best = stash(best.select((-F.col("p.src")).alias("src"), (-F.col("p.dst")).alias("dst"), F.greatest("p.score", F.lit(0.0)).alias("weight"), "label", "p.theirs"), "bridges")
        if best.isEmpty():
            return edges
        edges = edges.unionByName(best.groupBy("src", "dst").agg(F.max("weight").alias("weight")))
        into = components(best.select(F.col("label").alias("a"), F.col("theirs").alias("b"))).toDF("label", "into")
        parted = stash(parted.join(into, "label", "left").select("vec", "id", F.coalesce("into", "label").alias("label")), "parted")


def modularity(edges: DataFrame, membership: DataFrame, gamma: float = 1.0) -> DataFrame:
    """One row: sum over communities of the inner share of weight minus gamma times the squared share of degree. edges (src, dst, weight) are undirected, membership is (v, community)."""
    edges = stash(edges.select("src", "dst", "weight"), "edges")
    a, b = membership.toDF("src", "ca"), membership.toDF("dst", "cb")
    e = edges.join(a, "src").join(b, "dst")
    total = edges.agg(F.sum("weight").alias("m")).first()["m"] or 1.0
    inner = e.where("ca = cb").groupBy(F.col("ca").alias("c")).agg(F.sum("weight").alias("inner"))
    degree = e.select(F.col("ca").alias("c"), "weight").unionAll(e.select(F.col("cb").alias("c"), "weight")).groupBy("c").agg(F.sum("weight").alias("degree"))
    parts = degree.join(inner, "c", "left").select(F.coalesce("inner", F.lit(0.0)).alias("inner"), "degree")
    return parts.agg(F.round(F.sum(F.col("inner") / total - gamma * F.pow(F.col("degree") / (2 * total), 2)), 6).alias("modularity"))


def communities(edges: DataFrame, gamma: float = 1.0, rounds: int = 12, levels: int | None = 4) -> DataFrame:
    """(v, community) by local moving and aggregation, as joins.

    In a round the vertices of one hash parity each go to the neighbouring community of greatest positive gain w_in - gamma k S / 2m (ties: least
    community), then those of the other parity; so neighbours rarely swap. When nothing moves, or after so many rounds, communities become the vertices of the
    next level. With None for levels this goes on until a level merges nothing, and parities are dealt anew every two rounds, so that no pair swaps for good.
    A community is named by its least member.
    """
    edges = stash(edges.select("src", "dst", "weight"), "edges")
    total = 2 * (edges.agg(F.sum("weight")).first()[0] or 1.0)
    level = stash(edges.where("weight > 0 AND src <> dst").select("src", "dst", "weight").unionAll(edges.where("weight > 0 AND src <> dst").select(F.col("dst"), F.col("src"), "weight")).toDF("v", "u", "weight"), "graph")
    result = stash(level.select(F.col("v").alias("item"), F.col("v").alias("c")).distinct(), "membership")
    for n in count() if levels is None else range(levels):
        degree = stash(level.groupBy("v").agg(F.sum("weight").alias("k")), "degree")
        own = stash(degree.select("v", F.col("v").alias("c")), "communities")
        moved_any = False
        for step in range(rounds):
            sums = own.join(degree, "v").groupBy("c").agg(F.sum("k").alias("s"))
            near = level.where("v <> u").join(own.toDF("u", "c"), "u").groupBy("v", "c").agg(F.sum("weight").alias("w"))
            home = own.toDF("v", "h").join(degree, "v")
            here = home.join(near, (home["v"] == near["v"]) & (home["h"] == near["c"]), "left").select(home["v"], "h", "k", F.coalesce("w", F.lit(0.0)).alias("wh")).join(sums.toDF("h", "sh"), "h")
            gains = near.join(here, "v").where("c <> h").join(sums, "c").withColumn("gain", F.round(F.col("w") - F.col("wh") - gamma * F.col("k") * (F.col("s") - F.col("sh") + F.col("k")) / total, 9))
            best = gains.where("gain > 0").groupBy("v").agg(F.max(F.struct("gain", (-F.col("c")).alias("back"))).alias("b")).select("v", (-F.col("b.back")).alias("to"))
            turn = F.pmod(F.xxhash64("v", *([F.lit(n * rounds + step // 2)] if levels is None else [])), F.lit(2)) == step % 2
            new = stash(own.join(best, "v", "left").select("v", F.when(turn & F.col("to").isNotNull(), F.col("to")).otherwise(F.col("c")).alias("c"), (turn & F.col("to").isNotNull()).alias("moved")), "communities")
            moved = not new.where("moved").isEmpty()
            own, moved_any = new.select("v", "c"), moved_any or moved
            if not moved and step % 2:
                break
        if not moved_any or own.select("c").distinct().count() == own.count():  # swaps merge nothing, and the next level would do the same
            break
        names = own.groupBy("c").agg(F.min("v").alias("name"))
        own = stash(own.join(names, "c").select("v", F.col("name").alias("c")), "communities")
        result = stash(result.join(own.toDF("c", "d"), "c").select("item", F.col("d").alias("c")), "membership")
        level = stash(level.join(own.toDF("v", "cv"), "v").join(own.toDF("u", "cu"), "u").groupBy("cv", "cu").agg(F.sum("weight").alias("weight")).toDF("v", "u", "weight"), "graph")
    least = result.groupBy("c").agg(F.min("item").alias("community"))
    return result.join(least, "c").select(F.col("item").alias("v"), "community")


def cluster_names(membership: DataFrame, styles: DataFrame, k: int = 3) -> DataFrame:
    """(community, name, evidence): styles whose mean score in the community lies furthest above the overall mean; styles is long (v, style, score)."""
    overall = styles.groupBy("style").agg(F.avg("score").alias("all"))
    mean = styles.join(membership, "v").groupBy("community", "style").agg(F.avg("score").alias("mean")).join(F.broadcast(overall), "style").withColumn("lift", F.round(F.col("mean") - F.col("all"), 6))
    w = Window.partitionBy("community").orderBy(F.desc("lift"), "style")
    top = mean.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    ordered = F.sort_array(F.collect_list(F.struct("rank", "style", "lift")))
    leaf = F.array_distinct(F.transform(F.slice("t", 1, max(1, k - 1)), lambda s: F.element_at(F.split(s["style"].cast("string"), "---"), -1)))
    return top.groupBy("community").agg(ordered.alias("t")).select("community", F.array_join(leaf, " / ").alias("name"), F.array_join(F.transform("t", lambda s: F.concat_ws(":", s["style"].cast("string"), F.format_number(s["lift"], 4))), ",").alias("evidence"))
