"""Lexical index and ranking: postings, field statistics, BM25 over sets of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def postings(df: DataFrame, id_col: str, terms: Column) -> DataFrame:
    """(id, term, tf, len): term frequencies of each row; rows without terms are absent."""
    # Exploding an array of one keeps the terms from being computed anew for each use.
    t = df.select(F.col(id_col).alias("id"), F.explode(F.array(terms)).alias("ts"))
    return t.select("id", F.size("ts").alias("len"), F.explode("ts").alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("len").alias("len"))


def query_terms(post: DataFrame, n: int = 3, df: DataFrame | None = None, total: DataFrame | None = None) -> DataFrame:
    """(query, term): the queries are all rows whose id is divisible by 50; each asks for its n most telling terms of four letters or more (tf ln(N / df), ties by term).

    df (term, df) and total (n), where given, stand for counts over post, which then need only hold the asking rows.
    """
    df = post.groupBy("term").agg(F.count(F.lit(1)).alias("df")) if df is None else df
    total = post.agg(F.countDistinct("id").alias("n")) if total is None else total  # one row
    q = post.filter("id % 50 = 0 and char_length(term) >= 4").join(df, "term").crossJoin(F.broadcast(total))
    weight = F.round(F.col("tf") * F.log(F.col("n") / F.col("df")), 6)
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc(weight), "term"))
    return q.withColumn("rk", rank).filter(f"rk <= {n}").select(F.col("id").alias("query"), "term")


def bm25(post: DataFrame, queries: DataFrame, match_all: bool = False) -> DataFrame:
    """(query, id, matched, score) of each row that holds any (or all) of a query's terms.

    score = sum of idf * tf (K1 + 1) / (tf + K1 (1 - B + B len / mean len)) with idf = ln(N / (df + 1)) + 1.
    Postings are joined with the queries' terms only; statistics cover all rows.
    """
    stats = post.groupBy("id").agg(F.first("len").alias("len")).agg(F.count(F.lit(1)).alias("n_docs"), F.avg("len").alias("mean_len"))
    terms = queries.select("term").distinct()
    hit = post.join(terms, "term", "left_semi")
    df = hit.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighed = queries.join(df, "term").crossJoin(F.broadcast(stats))  # stats is one row
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean_len")))
    idf = F.log(F.col("n_docs") / (F.col("df") + 1)) + 1
    scored = hit.join(weighed, "term").groupBy("query", "id").agg(F.count(F.lit(1)).alias("matched"), F.sum(idf * tf).alias("score"))
    if match_all:
        size = queries.groupBy("query").agg(F.count(F.lit(1)).alias("size"))
        scored = scored.join(size, "query").filter("matched = size").drop("size")
    return scored


def top_k(scored: DataFrame, k: int, score: str = "score", by: str = "query", tie: str = "id") -> DataFrame:
    """The k best rows of each query, rank from 1; equal scores by id."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(F.round(score, 9)), tie))
    return scored.withColumn("rank", rank.cast("long")).filter(f"rank <= {k}")


def coverage(grams: DataFrame, queries: DataFrame, floor: float = 0.4) -> DataFrame:
    """(query, id, coverage): share of a query's n-grams that a row holds, from the floor up. grams: (id, gram) distinct; queries: (query, gram) distinct."""
    size = queries.groupBy("query").agg(F.count(F.lit(1)).alias("size"))
    met = grams.join(queries, "gram").groupBy("query", "id").agg(F.count(F.lit(1)).alias("met"))
    return met.join(size, "query").withColumn("coverage", F.col("met") / F.col("size")).filter(F.col("coverage") >= floor).drop("met", "size")
