"""Problem 8: fill containers of fixed capacity by large-item matching and best fit."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legajo.llm.tokens import TOKENIZER, token_sizes
from legajo.session import materialize

CAPACITY = 4096
#: Containers that one task packs; with it a task's rows stay bounded while its unfilled rest is a fraction of 1/500.
CONTAINERS_PER_SHARD = 2000
#: Rows that one task packs at most, for corpora of tiny texts.
ROWS_PER_SHARD = 200_000

_SCHEMA = "doc_id long, piece int, token_start long, token_end long, n_tokens long, shard int, bin int"


def pack(sizes: list[int], capacity: int) -> list[int]:
    """Container number of each size (all within capacity).

    Items above a third of the capacity: at most two fit together, so they are matched greedily, the
    largest with the largest partner that still fits. Smaller ones, in falling order, go where the
    least room is left over; a new container opens where none has room.
    """
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    where, used = [0] * len(sizes), []
    large = [i for i in order if 3 * sizes[i] > capacity]
    rising = [(sizes[i], -k) for k, i in enumerate(large)][::-1]  # ascending by size, later ones first among equals
    taken = [False] * len(large)
    for k, i in enumerate(large):
        if taken[k]:
            continue
        taken[k] = True
        at = bisect_left(rising, (sizes[i], -k))
        rising.pop(at)
        where[i] = len(used)
        used.append(sizes[i])
        j = bisect_right(rising, (capacity - sizes[i], 1)) - 1
        if j >= 0:
            size, minus = rising.pop(j)
            taken[-minus] = True
            where[large[-minus]] = len(used) - 1
            used[-1] += size
    gaps = sorted((capacity - u, b) for b, u in enumerate(used) if u < capacity)
    for i in order[len(large):]:
        if not sizes[i]:
            where[i] = 0
            used or used.append(0)
            continue
        at = bisect_left(gaps, (sizes[i], -1))
        if at < len(gaps):
            room, b = gaps.pop(at)
        else:
            room, b = capacity, len(used)
            used.append(0)
        where[i] = b
        used[b] += sizes[i]
        if room > sizes[i]:
            insort(gaps, (room - sizes[i], b))
    return where


def fill_containers(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """Put every text into a container: (doc_id, piece, token_start, token_end, n_tokens, container).

    Texts within the capacity stay whole (piece 0). A larger one is cut into full containers and a rest
    that is packed like a text. Documents are spread over shards by hash, so that each shard has the
    corpus' mix of sizes; a shard's sizes, never its texts, are packed in one task of bounded size.
    container = shard * 2^32 + number. Null and empty texts have no tokens and lie in a container without
    taking room. Rows that repeat an id are packed separately. An empty table gives no rows.
    """
    sized = materialize(token_sizes(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "text", ["doc_id"], tokenizer), "sizes")
    n = F.col("n_tokens")
    full = F.floor(n / capacity)
    pieces = sized.select(
        "doc_id", n.alias("total"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.ceil(n / capacity) - 1))).alias("piece"),
    ).select(
        "doc_id", F.col("piece").cast("int").alias("piece"), (F.col("piece") * capacity).alias("token_start"),
        F.least("total", (F.col("piece") + 1) * capacity).alias("token_end"),
    ).withColumn("n_tokens", F.col("token_end") - F.col("token_start"))
    totals = sized.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("t"), F.count(F.lit(1)).alias("r"), F.coalesce(F.sum(full), F.lit(0)).alias("f")).first()
    shards = max(1, -(-totals["t"] // (capacity * CONTAINERS_PER_SHARD)), -(-(totals["r"] + totals["f"]) // ROWS_PER_SHARD))
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)).cast("int"))

    def place(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        p["bin"] = pack(p["n_tokens"].tolist(), capacity)
        return p[["doc_id", "piece", "token_start", "token_end", "n_tokens", "shard", "bin"]]

    placed = pieces.groupBy("shard").applyInPandas(place, _SCHEMA)
    return placed.select("doc_id", "piece", "token_start", "token_end", "n_tokens", (F.col("shard").cast("long") * F.lit(2**32) + F.col("bin")).alias("container"))


def fill_report(containers: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(containers, tokens, capacity_tokens, unused_share, split_texts)."""
    by = containers.groupBy("container").agg(F.sum("n_tokens").alias("t"))
    split = containers.filter("piece > 0").agg(F.countDistinct("doc_id").alias("split_texts"))
    return by.agg(
        F.count(F.lit(1)).alias("containers"), F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"),
    ).crossJoin(F.broadcast(split)).select(  # one row on either side
        "containers", "tokens", (F.col("containers") * capacity).alias("capacity_tokens"),
        F.when(F.col("containers") > 0, 1 - F.col("tokens") / (F.col("containers") * capacity)).otherwise(0.0).alias("unused_share"), "split_texts")
