"""The further lexical passes: several fields, numbers, stems, synonyms, and their order."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from legajo.functions.text import fold
from legajo.operators import lexical
from legajo.operators.vectors import close_pairs
from legajo.session import materialize, ship

#: Endings that the light Spanish stemmer takes off, longest first; fixed values of the language.
ENDINGS = ("amientos", "imientos", "amiento", "imiento", "aciones", "adoras", "adores", "ancias", "acion", "adora", "ancia", "mente", "idades", "idad", "ables", "ibles", "able", "ible", "istas", "ista", "osos", "osas", "oso", "osa", "ivas", "ivos", "iva", "ivo", "es", "as", "os", "s", "a", "o", "e")


def stem(term: Column) -> Column:
    """A folded word without its longest known ending, at least three letters left."""
    return F.regexp_replace(term, rf"^([a-z]{{3,}}?)(?:{'|'.join(ENDINGS)})$", "$1")


def multifield(posts: dict[str, tuple[DataFrame, float]], queries: DataFrame) -> DataFrame:
    """(query, id, matched, score): BM25 of each field times its boost, added up. A row counts where every term of the query is in some field. posts: field -> (postings, boost)."""
    parts = []
    for post, boost in posts.values():
        stats = post.groupBy("id").agg(F.first("len").alias("len")).agg(F.count(F.lit(1)).alias("n_docs"), F.avg("len").alias("mean_len"))
        hit = post.join(queries.select("term").distinct(), "term", "left_semi")
        df = hit.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        tf = F.col("tf") * (lexical.K1 + 1) / (F.col("tf") + lexical.K1 * (1 - lexical.B + lexical.B * F.col("len") / F.col("mean_len")))
        weighed = queries.join(df, "term").crossJoin(F.broadcast(stats))  # stats is one row
        parts.append(hit.join(weighed, "term").select("query", "id", "term", (boost * (F.log(F.col("n_docs") / (F.col("df") + 1)) + 1) * tf).alias("s")))
    every = reduce(DataFrame.unionByName, parts)
    size = queries.groupBy("query").agg(F.count(F.lit(1)).alias("size"))
    return every.groupBy("query", "id").agg(F.countDistinct("term").alias("matched"), F.sum("s").alias("score")).join(size, "query").filter("matched = size").drop("size")


def in_order(passes: list[DataFrame], k: int) -> DataFrame:
    """(query, id, pass_no, rank): hits of the passes one after another, each row where it first turns up, k a query.

    Each pass is (query, id, score); a later one only adds what earlier ones have not found.
    """
    every = reduce(DataFrame.unionByName, [p.select("query", "id", "score", F.lit(i).alias("pass_no")) for i, p in enumerate(passes)])
    first = every.groupBy("query", "id").agg(F.min(F.struct("pass_no", (-F.round("score", 9)).alias("neg"))).alias("b")).select("query", "id", "b.pass_no", "b.neg")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("pass_no", "neg", "id"))
    return first.withColumn("rank", rank.cast("long")).filter(f"rank <= {k}").select("query", "id", F.col("pass_no").cast("long").alias("pass_no"), "rank")


def gram_matches(classes: DataFrame, floor: float = 0.4, counted: bool = False, block: int = 2048) -> DataFrame:
    """The classes that hold at least `floor` of the grams of each class that asks, exactly. classes: (cls, n, asks, grams) with distinct grams as three base-36 digits.

    (query, cls, coverage), or counted: (query, hits, best) with each class counted n times. The asking
    classes are gathered in blocks of a fixed number; a task adds up the block's rows of 0 and 1 for each
    of its own classes, so no pair of classes that share a gram is shuffled.
    """
    spark = classes.sparkSession
    ship(spark)
    asking = classes.filter("asks")
    blocks = max(1, -(-asking.count() // block))
    parts = []
    for b in range(blocks):
        part = asking.filter(F.pmod(F.xxhash64("cls"), F.lit(blocks)) == b).select("cls", "grams").orderBy("cls").collect()  # a bounded block of the stated set
        if not part:
            continue
        ids, size = np.array([r["cls"] for r in part]), np.array([len(r["grams"]) for r in part])
        used = np.unique(np.concatenate([r["grams"] for r in part]))
        place = np.full(36**3, -1, dtype=np.int32)
        place[used] = np.arange(len(used))
        held = np.zeros((len(used), len(part)), dtype=np.uint8 if size.max() < 256 else np.uint16)
        for i, r in enumerate(part):
            held[place[r["grams"]], i] = 1
        need = np.array([next(m for m in range(1, n + 1) if m / n >= floor) for n in size]).astype(held.dtype)
        shipped = spark.sparkContext.broadcast((ids, size, place, held, need))

        def run(batches: Iterator[pd.DataFrame], shipped=shipped) -> Iterator[pd.DataFrame]:
            ids, size, place, held, need = shipped.value
            hits, best = np.zeros(len(ids), dtype=np.int64), np.zeros(len(ids), dtype=held.dtype)
            for p in batches:
                found = []
                for cls, n, grams in zip(p["cls"], p["n"], p["grams"]):
                    at = place[grams]
                    met = np.add.reduce(held[at[at >= 0]], axis=0, dtype=held.dtype)
                    ok = met >= need
                    if counted:
                        hits += n * ok
                        np.maximum(best, met * ok, out=best)
                    elif ok.any():
                        i = np.flatnonzero(ok)
                        found.append(pd.DataFrame({"query": ids[i], "cls": cls, "coverage": met[i] / size[i]}))
                if found:
                    yield pd.concat(found)
            if counted:
                i = np.flatnonzero(hits)
                yield pd.DataFrame({"query": ids[i], "hits": hits[i], "best": best[i] / size[i]})

        parts.append(classes.select("cls", "n", "grams").mapInPandas(run, "query long, hits long, best double" if counted else "query long, cls long, coverage double"))
    if not parts:
        return spark.createDataFrame([], "query long, hits long, best double" if counted else "query long, cls long, coverage double")
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy("query").agg(F.sum("hits").alias("hits"), F.max("best").alias("best")) if counted else every


def word_vectors(docs: DataFrame, text_col: str, dims: int = 256, window: int = 2, least: int = 5) -> DataFrame:
    """(id, word, v): each frequent folded word's neighbours, hashed into `dims` counts, as positive log-odds. Counting is by Spark; a task adds up its own texts first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            c: Counter = Counter()
            for ws in p["ws"]:
                h = [hash_word(w) % dims for w in ws]
                for i, w in enumerate(ws):
                    for j in range(max(0, i - window), min(len(ws), i + window + 1)):
                        if i != j:
                            c[w, h[j]] += 1
            yield pd.DataFrame([(w, b, n) for (w, b), n in c.items()], columns=["word", "bucket", "n"])

    ship(docs.sparkSession)
    words = docs.select(F.regexp_extract_all(fold(F.col(text_col)), F.lit("([a-z]{4,})"), F.lit(1)).alias("ws"))
    counts = materialize(words.mapInPandas(run, "word string, bucket int, n long").groupBy("word", "bucket").agg(F.sum("n").alias("n")), "wordcounts")  # read twice below
    by_word = counts.withColumn("wn", F.sum("n").over(Window.partitionBy("word"))).filter(F.col("wn") >= least * 2 * window)
    totals = counts.groupBy("bucket").agg(F.sum("n").alias("bn"))  # dims rows
    scored = by_word.join(F.broadcast(totals), "bucket").crossJoin(F.broadcast(totals.agg(F.sum("bn").alias("all"))))
    odds = F.greatest(F.lit(0.0), F.log(F.col("n") * F.col("all") / (F.col("wn") * F.col("bn"))))
    return scored.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("bucket", odds.alias("o")))).alias("m")).select(  # dims entries at most
        F.xxhash64("word").alias("id"), "word", F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0))).alias("v"))


@lru_cache(1 << 17)
def hash_word(w: str) -> int:
    h = 2166136261
    for b in w.encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return h


def synonyms(vectors: DataFrame, k: int = 6, floor: float = 0.45) -> DataFrame:
    """(word, synonym, score, rank): the nearest words of each word by cosine, variants of the word itself (contained, or sharing its beginning up to the last two letters) taken out first."""
    pairs = close_pairs(vectors, "id", "v", floor).filter(F.col("score") >= floor)
    ends = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "score"))
    named = ends.join(vectors.select(F.col("id").alias("a"), "word"), "a").join(vectors.select(F.col("id").alias("b"), F.col("word").alias("synonym")), "b")
    stem_len = F.greatest(F.lit(4), F.least(F.char_length("word"), F.char_length("synonym")) - 2)
    variant = F.contains("word", F.col("synonym")) | F.contains("synonym", F.col("word")) | (F.expr("left(word, 4)") == F.expr("left(synonym, 4)")) & (F.substring("word", F.lit(1), stem_len) == F.substring("synonym", F.lit(1), stem_len))
    rank = F.row_number().over(Window.partitionBy("word").orderBy(F.desc(F.round("score", 9)), "synonym"))
    return named.filter(~variant).withColumn("rank", rank.cast("long")).filter(f"rank <= {k}").select("word", "synonym", "score", "rank")


def soft_boost(hits: DataFrame, other: DataFrame, weight: float = 0.35) -> DataFrame:
    """(query, id, score): hits with weight times the score that optional terms (synonyms) give the same row; no row is added."""
    o = other.select("query", "id", F.col("score").alias("more"))
    return hits.join(o, ["query", "id"], "left").withColumn("score", F.col("score") + weight * F.coalesce("more", F.lit(0.0))).select(*hits.columns)
