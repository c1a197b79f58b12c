"""Vector operators: block search, a signature index, pooling, near duplicates."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from legajo.session import materialize, ship

#: Query vectors that one block holds (one scan of the rows each), and that are multiplied at a time.
BLOCK = 32_768
AT_ONCE = 4096
#: Vectors that are sent to every task at a time when all pairs are compared.
SENT = 32_768
#: Hyperplanes, tables and the Hamming radius of the search index.
PLANES, TABLES, RADIUS = 10, 24, 2
SEED = 7


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1.0, n)


def block_search(df: DataFrame, id_col: str, vec_col: str, queries: DataFrame, k: int, include_self: bool = False, block: int = BLOCK) -> DataFrame:
    """(query, id, score, rank): the k nearest rows of each query vector by cosine, exactly.

    The queries are a stated set, gathered in blocks of a fixed number of vectors; each block is a matrix
    that every task multiplies with its rows, keeping its own k best a query, so what is shuffled is
    k rows a task and query. Null and empty vectors are left out; zero vectors score 0; ties by id.
    """
    spark = df.sparkSession
    ship(spark)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).filter("id is not null and size(v) > 0")
    qs = queries.select(F.col(id_col).cast("long").alias("query"), F.col(vec_col).alias("v")).filter("query is not null and size(v) > 0")
    n = qs.count()
    blocks = max(1, -(-n // block))
    out = None
    for b in range(blocks):
        part = qs.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b).orderBy("query").collect()  # a bounded block of the stated set
        if not part:
            continue
        ids = np.array([r["query"] for r in part])
        shipped = spark.sparkContext.broadcast((ids, _unit(np.array([r["v"] for r in part], dtype=np.float64))))

        def run(batches: Iterator[pd.DataFrame], shipped=shipped) -> Iterator[pd.DataFrame]:
            ids, q = shipped.value
            best: list[pd.DataFrame] = []
            for p in batches:
                u, own = _unit(np.vstack(p["v"].to_numpy()).astype(np.float64)), p["id"].to_numpy()
                for x in range(0, len(ids), AT_ONCE):
                    s = q[x : x + AT_ONCE] @ u.T
                    order = np.lexsort((np.broadcast_to(own, s.shape), -np.round(s, 9)), axis=1)[:, : k + 1]
                    best.append(pd.DataFrame({"query": np.repeat(ids[x : x + AT_ONCE], order.shape[1]), "id": own[order].ravel(), "score": np.take_along_axis(s, order, 1).ravel()}))
                if len(best) > 8 * -(-len(ids) // AT_ONCE):
                    best = [_keep(pd.concat(best), k + 1)]
            if best:
                yield _keep(pd.concat(best), k + 1)

        hits = rows.mapInPandas(run, "query long, id long, score double")
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        return spark.createDataFrame([], "query long, id long, score double, rank long")
    if not include_self:
        out = out.filter("query != id")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "id"))
    return out.withColumn("rank", rank.cast("long")).filter(f"rank <= {k}")


def _keep(p: pd.DataFrame, k: int) -> pd.DataFrame:
    p = p.assign(r=-p["score"].round(9)).sort_values(["query", "r", "id"])
    return p[p.groupby("query").cumcount() < k].drop(columns="r")


def signatures(df: DataFrame, id_col: str, vec_col: str, planes: int = PLANES, tables: int = TABLES) -> DataFrame:
    """(id, v, table, bucket): the sides of `planes` random hyperplanes in each of `tables` tables; every row is indexed."""
    ship(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            m = np.vstack(p["v"].to_numpy()).astype(np.float64)
            normals = np.random.default_rng(SEED).standard_normal((m.shape[1], planes * tables))
            bits = ((m @ normals) > 0).reshape(len(m), tables, planes)
            yield pd.DataFrame({"id": p["id"], "v": p["v"], "buckets": list((bits @ (1 << np.arange(planes, dtype=np.int64))).astype(np.int64))})

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).filter("id is not null and size(v) > 0")
    return rows.mapInPandas(run, "id long, v array<double>, buckets array<long>").select("id", "v", F.posexplode("buckets").alias("table", "bucket"))


def _cosine(a: str, b: str):
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda c: F.sqrt(F.aggregate(F.transform(c, lambda x: x * x), F.lit(0.0), lambda s, x: s + x))
    return dot / F.nullif(norm(a) * norm(b), F.lit(0.0))


def indexed_search(df: DataFrame, id_col: str, vec_col: str, queries: DataFrame, k: int, radius: int = RADIUS) -> DataFrame:
    """(query, id, score, rank) by the signature index: a query probes, in every table, all buckets within `radius` bits of its own; the candidates are then scored exactly."""
    index = signatures(df, id_col, vec_col)
    flips = [0, *(1 << i for i in range(PLANES))]
    if radius > 1:
        flips += [(1 << i) | (1 << j) for i in range(PLANES) for j in range(i)]
    probes = signatures(queries, id_col, vec_col).select(F.col("id").alias("query"), "table", F.explode(F.array(*(F.col("bucket").bitwiseXOR(F.lit(f).cast("long")) for f in flips))).alias("bucket"))
    pairs = index.select("id", "table", "bucket").join(probes, ["table", "bucket"]).filter("query != id").select("query", "id").distinct()
    a = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("va"))
    b = queries.select(F.col(id_col).cast("long").alias("query"), F.col(vec_col).cast("array<double>").alias("vb"))
    scored = pairs.join(a, "id").join(b, "query").select("query", "id", F.coalesce(_cosine("va", "vb"), F.lit(0.0)).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "id"))
    return scored.withColumn("rank", rank.cast("long")).filter(f"rank <= {k}")


def mean_pool(df: DataFrame, key: str, vec_col: str) -> DataFrame:
    """(key, mean): the mean vector of each key, by position; partial sums are combined before the shuffle, so a hot key is no burden."""
    pos = df.select(key, F.posexplode(F.col(vec_col).cast("array<double>")).alias("pos", "x")).groupBy(key, "pos").agg(F.avg("x").alias("x"))
    return pos.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("mean"))  # as many entries as dimensions


def close_pairs(df: DataFrame, id_col: str, vec_col: str, cosine: float, sent: int = SENT) -> DataFrame:
    """(a, b, score), a < b: all pairs of distinct ids at the cosine or more, exactly but for rounding (1e-9 below is still given).

    Every pair is scored, by products of blocks: a fixed number of vectors at a time is sent to every
    task, which multiplies them with its own rows. Work grows with the square of the rows, memory does not.
    """
    spark = df.sparkSession
    ship(spark)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).filter("id is not null and size(v) > 0")
    rows = materialize(rows.repartition(spark.sparkContext.defaultParallelism, "id"), "vectors")
    rounds = max(1, -(-rows.count() // sent))
    parts = []
    for r in range(rounds):
        part = rows.filter(F.pmod(F.xxhash64("id"), F.lit(rounds)) == r).toPandas()  # a bounded part
        if part.empty:
            continue
        shipped = spark.sparkContext.broadcast((part["id"].to_numpy(), _unit(np.vstack(part["v"].to_numpy()).astype(np.float64))))

        def run(batches: Iterator[pd.DataFrame], shipped=shipped) -> Iterator[pd.DataFrame]:
            ids, m = shipped.value
            for p in batches:
                own, u = p["id"].to_numpy(), _unit(np.vstack(p["v"].to_numpy()).astype(np.float64))
                for x in range(0, len(own), 1024):
                    for y in range(0, len(ids), 2048):
                        s = u[x : x + 1024] @ m[y : y + 2048].T
                        i, j = np.nonzero(s >= cosine - 1e-9)
                        a, b = own[x + i], ids[y + j]
                        keep = a < b
                        yield pd.DataFrame({"a": a[keep], "b": b[keep], "score": s[i, j][keep]})

        parts.append(materialize(rows.mapInPandas(run, "a long, b long, score double"), "close"))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "a long, b long, score double")


def near_duplicates(df: DataFrame, id_col: str, vec_col: str, cosine: float = 0.85) -> DataFrame:
    """(id, copies, links, linked_to): one row per vector; copies: vectors equal to it, links: other vectors at the cosine or more, linked_to: the smallest of their ids.

    Equal vectors are taken together first; distinct ones are compared by close_pairs, which loses none.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).filter("id is not null and size(v) > 0")
    keyed = rows.withColumn("cls", F.xxhash64("v"))
    reps = keyed.groupBy("cls").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v"))
    reps = materialize(reps, "classes")
    pairs = close_pairs(reps, "cls", "v", cosine).select("a", "b")
    va, vb = reps.select(F.col("cls").alias("a"), F.col("v").alias("va"), F.col("rep").alias("ra"), F.col("copies").alias("ca")), reps.select(F.col("cls").alias("b"), F.col("v").alias("vb"), F.col("rep").alias("rb"), F.col("copies").alias("cb"))
    close = pairs.join(va, "a").join(vb, "b").filter(_cosine("va", "vb") >= cosine)
    ends = close.select(F.col("a").alias("cls"), F.col("rb").alias("other"), F.col("cb").alias("n")).unionByName(close.select(F.col("b").alias("cls"), F.col("ra").alias("other"), F.col("ca").alias("n")))
    by = ends.groupBy("cls").agg(F.sum("n").alias("links"), F.min("other").alias("linked_to"))
    return keyed.select("id", "cls").join(reps.select("cls", "copies", "rep"), "cls").join(by, "cls", "left").select(
        "id", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.least(F.col("linked_to"), F.when(F.col("copies") > 1, F.col("rep"))).alias("linked_to"))
