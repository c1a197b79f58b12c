"""Entity graph: nodes, edges, merging, paths, communities, brokers."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from legajo.functions.text import bind, fold
from legajo.session import materialize, ship

#: Edges of the largest graph that is sent to every task (8 bytes each).
SHIPPED = 2_000_000


def mentions(docs: DataFrame) -> DataFrame:
    """(doc_id, key, name, entity_type) of each entity named by a document (persons, organizations arrays); keys are folded names."""

    def of(c: str, kind: str) -> Column:
        return F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda n: F.struct(n.alias("name"), F.lit(kind).alias("entity_type")))

    both = F.concat(of("persons", "person"), of("organizations", "organization"))
    return docs.select("doc_id", F.explode(both).alias("e")).select("doc_id", fold(F.col("e.name")).alias("key"), "e.name", "e.entity_type").filter("key != ''")


def nodes(m: DataFrame) -> DataFrame:
    """(key, name, entity_type, mentions, n_docs)."""
    return m.groupBy("key").agg(F.min("name").alias("name"), F.min("entity_type").alias("entity_type"), F.count(F.lit(1)).alias("mentions"), F.countDistinct("doc_id").alias("n_docs"))


def edges(m: DataFrame) -> DataFrame:
    """(src, dst, weight), src < dst: in how many documents two entities are named together.

    The self-join is by document, whose entities are bounded by its own text.
    """
    d = m.select("doc_id", "key").distinct()
    return d.select("doc_id", F.col("key").alias("src")).join(d.select("doc_id", F.col("key").alias("dst")), "doc_id").filter("src < dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def merge_targets(n: DataFrame) -> DataFrame:
    """(key, target): each key's longest key of the same type that holds all its words as a run (then the smallest), itself where there is none.

    The runs of words of each key (a name has few) are equi-joined with the keys, so that a frequent given name is no hot key.
    """

    def runs(ws: Column) -> Column:
        return F.flatten(F.transform(ws, lambda _, i: F.transform(F.sequence(F.lit(1), F.size(ws) - i), lambda k: F.array_join(F.slice(ws, i + 1, k), " "))))

    longer = n.select(F.col("key").alias("target"), "entity_type", F.explode(F.array_distinct(bind(F.split("key", " "), runs))).alias("key"))
    pair = longer.join(n.select("key", "entity_type"), ["key", "entity_type"]).filter("key != target")
    best = pair.groupBy("key").agg(F.min(F.struct((-F.char_length("target")).alias("l"), "target")).alias("b")).select("key", "b.target")
    return n.select("key").join(best, "key", "left").withColumn("target", F.coalesce("target", "key"))


def merged(m: DataFrame) -> DataFrame:
    """Mentions with each key replaced by its merge target."""
    return m.join(merge_targets(nodes(m)), "key").select("doc_id", F.col("target").alias("key"), "name", "entity_type")


def both_ways(e: DataFrame) -> DataFrame:
    return e.select("src", "dst", "weight").unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def alike_names(n: DataFrame, name: str, over: float = 0.6) -> DataFrame:
    """Nodes with score: 1 and a hundredth of the mentions where the key holds the folded name, else the Ratcliff-Obershelp ratio of the two where it is above `over`.

    The ratio is at most twice the shorter length by both lengths, so keys of other lengths never reach Python.
    """
    ship(n.sparkSession)

    def compare(name: pd.Series, key: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, q, k).ratio() for q, k in zip(name, key)], dtype=float)

    ratio = F.pandas_udf(compare, DoubleType())
    q = n.withColumn("asked", fold(F.trim(F.lit(name))))
    held = F.contains("key", F.col("asked"))
    a, b = F.char_length("asked"), F.char_length("key")
    near = q.filter(~held & (2 * F.least(a, b) > over * (a + b))).withColumn("score", ratio("asked", "key")).filter(F.col("score") > over)
    return q.filter(held).withColumn("score", 1 + 0.01 * F.col("mentions")).unionByName(near).drop("asked")


def degrees(e: DataFrame) -> DataFrame:
    return both_ways(e).groupBy("src").agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("strength")).withColumnRenamed("src", "key")


def related(e: DataFrame, most: int = 10) -> DataFrame:
    """(src, dst, weight, rk): the strongest neighbours of each entity."""
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("weight"), "dst"))
    return both_ways(e).withColumn("rk", rank.cast("long")).filter(f"rk <= {most}")


def distances(e: DataFrame, start: DataFrame, hops: int = 4) -> DataFrame:
    """(key, hops): breadth-first distances from the keys of start; one join a hop, the frontier being all that is carried."""
    adj = materialize(both_ways(e).select("src", "dst"), "adjacency")
    seen = start.select("key", F.lit(0).alias("hops"))
    frontier = seen
    for h in range(1, hops + 1):
        step = adj.join(frontier, adj.src == frontier.key, "left_semi").select(F.col("dst").alias("key")).distinct()
        frontier = materialize(step.join(seen, "key", "left_anti").select("key", F.lit(h).alias("hops")), "frontier")
        seen = seen.unionByName(frontier)
    return seen


def label_communities(e: DataFrame, free: int = 12) -> DataFrame:
    """(key, community): label propagation by weight until no label changes, the distributed counterpart of greedy modularity.

    A key takes the label that weighs most among its neighbours, or the smaller one of equal weight. In
    the first `free` rounds half of the keys change at a time. After them only keys that no neighbour about
    to change precedes (by a hash of key and round) change, so each change adds to the weight between
    equal labels or takes a smaller one: the rounds come to an end.
    """
    adj = materialize(both_ways(e), "adjacency")
    label = materialize(adj.select(F.col("src").alias("key")).distinct().withColumn("community", F.col("key")), "community")
    i = 0
    while True:
        votes = adj.join(label, adj.dst == label.key).groupBy("src", "community").agg(F.sum("weight").alias("w"))
        own = label.select(F.col("key").alias("src"), F.col("community").alias("own"))
        ranked = votes.join(own, "src").groupBy("src").agg(
            F.min(F.struct((-F.col("w")).alias("w"), "community")).alias("b"), F.max(F.when(F.col("community") == F.col("own"), F.col("w"))).alias("kept"), F.first("own").alias("own"))
        better = (-F.col("b.w") > F.coalesce("kept", F.lit(0))) | (-F.col("b.w") == F.col("kept")) & (F.col("b.community") < F.col("own"))
        wish = materialize(ranked.filter(better).select(F.col("src").alias("key"), F.col("b.community").alias("new"), F.struct(F.xxhash64("src", F.lit(i)).alias("h"), "src").alias("p")), "wish")
        if wish.isEmpty():
            return label
        if i < free:
            moves = wish.filter(F.pmod("p.h", F.lit(2)) == 0)
        else:
            near = adj.join(wish.select(F.col("key").alias("src"), "p"), "src").join(wish.select(F.col("key").alias("dst"), F.col("p").alias("q")), "dst")
            moves = wish.join(near.filter("q < p").select(F.col("src").alias("key")).distinct(), "key", "left_anti")
        label = materialize(label.join(moves, "key", "left").select("key", F.coalesce("new", "community").alias("community")), "community")
        i += 1


def betweenness(e: DataFrame, sources: DataFrame) -> DataFrame:
    """(key, betweenness): Brandes' accumulation from the keys of sources, over unweighted shortest paths of any length.

    With all keys as sources it is the exact measure, normalised by (n - 1)(n - 2) (n < 3: as it is); a
    part of the keys gives the partial sums from them. Rows are (source, key, distance, number of paths);
    a level is one join on the way out and one on the way back.
    """
    adj = materialize(both_ways(e).select("src", "dst"), "adjacency")
    level = sources.select(F.col("key").alias("s"), F.col("key").alias("v"), F.lit(1.0).alias("paths"))
    levels, seen = [level], level.select("s", "v")
    while True:
        step = adj.join(level, adj.src == level.v).groupBy("s", F.col("dst").alias("v")).agg(F.sum("paths").alias("paths"))
        level = materialize(step.join(seen, ["s", "v"], "left_anti"), "level")
        if level.isEmpty():
            break
        levels.append(level)
        seen = seen.unionByName(level.select("s", "v"))
    credit = levels[-1].withColumn("credit", F.lit(0.0))
    total = None
    for above in reversed(levels[:-1]):
        share = credit.select("s", F.col("v").alias("w"), ((1 + F.col("credit")) / F.col("paths")).alias("part"))
        given = share.join(adj, share.w == adj.dst).select("s", F.col("src").alias("v"), "part")
        got = above.join(given, ["s", "v"], "left").groupBy("s", "v").agg(F.first("paths").alias("paths"), F.coalesce(F.sum("part"), F.lit(0.0)).alias("part"))
        total = credit.select("v", "credit") if total is None else total.unionByName(credit.select("v", "credit"))
        credit = materialize(got.select("s", "v", "paths", (F.col("paths") * F.col("part")).alias("credit")), "credit")
    # What is left in credit belongs to the sources themselves and does not count.
    n = adj.select("src").distinct().count()
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    every = adj.select(F.col("src").alias("key")).distinct()
    if total is None:
        return every.withColumn("betweenness", F.lit(0.0))
    by = total.groupBy(F.col("v").alias("key")).agg((F.sum("credit") * scale).alias("betweenness"))
    return every.join(by, "key", "left").na.fill(0.0, ["betweenness"])


def all_betweenness(e: DataFrame, most: int = SHIPPED) -> DataFrame:
    """(key, betweenness) from all keys, exactly: the measure of betweenness().

    A graph of up to `most` edges is sent to every task as two arrays, and the tasks share the sources
    out; a larger one is walked by joins, in blocks of sources.
    """
    spark = e.sparkSession
    adj = materialize(both_ways(e).select("src", "dst"), "adjacency")
    every = materialize(adj.select(F.col("src").alias("key")).distinct(), "keys")
    n = every.count()
    if adj.count() > 2 * most:
        blocks = -(-n // 256)
        block = lambda b: every.filter(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b)
        parts = (materialize(betweenness(e, block(b)), "betweenness") for b in range(blocks))
        return reduce(DataFrame.unionByName, parts).groupBy("key").agg(F.sum("betweenness").alias("betweenness"))
    if n == 0:
        return every.withColumn("betweenness", F.lit(0.0))
    ship(spark)
    keys = np.array([r["key"] for r in every.orderBy("key").collect()], dtype=object)  # no more than twice `most`
    number = materialize(spark.createDataFrame(pd.DataFrame({"key": keys, "i": np.arange(n)})), "numbers")
    ends = adj.join(number.select(F.col("key").alias("src"), F.col("i").alias("a")), "src").join(number.select(F.col("key").alias("dst"), F.col("i").alias("b")), "dst").select(F.col("a").cast("int"), F.col("b").cast("int")).toPandas()
    a, b = ends["a"].to_numpy(), ends["b"].to_numpy()
    order = np.argsort(a, kind="stable")
    shipped = spark.sparkContext.broadcast((b[order], np.searchsorted(a[order], np.arange(n))))  # every key has an edge
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        to, first = shipped.value
        size = max(1, min(32, 4_000_000 // len(to)))
        total = np.zeros(len(first))
        for p in batches:
            ids = p["i"].to_numpy()
            for k in range(0, len(ids), size):
                s = ids[k : k + size]
                paths, far = np.zeros((len(first), len(s))), np.full((len(first), len(s)), -1, dtype=np.int32)
                paths[s, np.arange(len(s))], far[s, np.arange(len(s))] = 1.0, 0
                level = 0
                while True:
                    step = np.add.reduceat(np.where(far == level, paths, 0.0)[to], first, axis=0)
                    new = (step > 0) & (far < 0)
                    if not new.any():
                        break
                    level += 1
                    far[new], paths[new] = level, step[new]
                credit = np.zeros_like(paths)
                for at in range(level, 1, -1):
                    share = np.divide(1 + credit, paths, out=np.zeros_like(paths), where=far == at)
                    got = np.add.reduceat(share[to], first, axis=0)
                    above = far == at - 1
                    credit[above] = (paths * got)[above]
                total += credit.sum(axis=1)
        yield pd.DataFrame({"i": np.arange(len(first)), "part": total})

    tasks = spark.sparkContext.defaultParallelism
    by = number.repartition(tasks, "i").select("i").mapInPandas(run, "i long, part double").groupBy("i").agg((F.sum("part") * scale).alias("betweenness"))
    return number.join(by, "i").select("key", "betweenness")
