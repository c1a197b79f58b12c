"""Two-level clustering of vectors and the words that describe clusters."""

from __future__ import annotations

from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sizes(n: int) -> int:
    """Clusters of the first level for n items."""
    return max(1, min(n, max(2, min(6, int((n / 2) ** 0.5 + 0.5)))))


def two_levels(df: DataFrame, id_col: str, vec_col: str, seed: int = 11) -> DataFrame:
    """(id, cluster, child): bisecting k-means by cosine, two to six clusters, each parted again into at most four.

    One model over all rows, cut at two depths of the same hierarchy: the first level has k clusters, the
    second 4 k; a child belongs to the cluster that most of its members have. Null and zero vectors are in no cluster.
    """
    v = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("a")).filter(F.exists("a", lambda x: x != 0)).withColumn("features", array_to_vector("a"))
    n = v.count()
    if n < 2:
        return v.select("id", F.lit(0).alias("cluster"), F.lit(0).alias("child"))
    k = sizes(n)
    first = BisectingKMeans(k=k, distanceMeasure="cosine", seed=seed, predictionCol="cluster").fit(v).transform(v)
    both = BisectingKMeans(k=min(n, 4 * k), distanceMeasure="cosine", seed=seed, predictionCol="child").fit(v).transform(first)
    votes = both.groupBy("child", "cluster").agg(F.count(F.lit(1)).alias("n"))
    home = votes.withColumn("rk", F.row_number().over(Window.partitionBy("child").orderBy(F.desc("n"), "cluster"))).filter("rk = 1").select("child", F.col("cluster").alias("home"))
    return both.join(home, "child").select("id", F.col("home").alias("cluster"), "child")


def cluster_words(df: DataFrame, cluster_col: str, title_col: str, keywords_col: str, most: int = 8) -> DataFrame:
    """(cluster, word, weight, rk): words of four letters or more in titles count 1 each, keywords 2."""
    titles = df.select(F.col(cluster_col).alias("cluster"), F.explode(F.regexp_extract_all(F.lower(title_col), F.lit("([a-záéíóúüñç]{4,})"), F.lit(1))).alias("word"), F.lit(1).alias("w"))
    keys = df.select(F.col(cluster_col).alias("cluster"), F.explode(keywords_col).alias("word"), F.lit(2).alias("w"))
    sums = titles.unionByName(keys).filter("word is not null").groupBy("cluster", "word").agg(F.sum("w").alias("weight"))
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("weight"), "word"))
    return sums.withColumn("rk", rank.cast("long")).filter(f"rk <= {most}")


#: Words that say nothing in a label. Fixed values.
LABEL_STOP = (
    "de", "del", "la", "las", "los", "el", "en", "y", "a", "para", "por", "con", "un", "una", "s.l", "s.l.", "s.a", "s.a.", "—",
    "es", "su", "se", "al", "lo", "no", "más", "como", "o", "e", "que", "datos", "número", "dear", "from", "the", "and", "of",
)


def group_labels(df: DataFrame, group_col: str) -> DataFrame:
    """(grp, docs, label): a name for each group of documents (doc_type, category, title, keywords).

    The first that applies: the only category (General and empty ones don't count), with the only type beside
    `documento`; the one or two most frequent such types behind the most frequent category; up to three title
    words of two documents and two fifths of the group at least; the first two categories; the two most frequent
    keywords; `Documentos varios`. Ties go to the smaller text, a null type counts as `documento`; null groups are left out.
    """
    d = df.select(F.col(group_col).alias("grp"), F.coalesce("doc_type", F.lit("documento")).alias("t"), F.col("category").alias("c"), "title", "keywords").filter("grp is not null")

    def first(x: DataFrame, k: int, name: str, *order) -> DataFrame:
        r = x.withColumn("rk", F.row_number().over(Window.partitionBy("grp").orderBy(*order, "v"))).filter(F.col("rk") <= k)
        return r.groupBy("grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("rk", "v"))), lambda s: s["v"]).alias(name))  # k entries at most

    def counted(value, source: DataFrame = d) -> DataFrame:
        return source.select("grp", value.alias("v")).groupBy("grp", "v").agg(F.count(F.lit(1)).alias("n"))

    cats = counted(F.col("c")).filter("v not in ('', 'General')")
    types = counted(F.col("t")).filter("v != 'documento'")
    found = F.array_distinct(F.regexp_extract_all(F.lower("title"), F.lit("([a-zà-ÿ]{3,})"), F.lit(1)))
    size = d.groupBy("grp").agg(F.count(F.lit(1)).alias("docs"))
    words = counted(F.explode(found)).filter(~F.col("v").isin(*LABEL_STOP)).join(size, "grp").filter("n >= greatest(2, 0.4 * docs)")
    keys = counted(F.trim(F.lower(F.col("k"))), d.select("grp", F.explode("keywords").alias("k"))).filter("v != ''")
    most = F.desc("n")
    out = size
    for part in (first(cats, 2, "cats", most), first(cats, 2, "cat_names"), first(types, 2, "types", most), first(words, 3, "words", most), first(keys, 2, "keys", most)):
        out = out.join(part, "grp", "left")
    nice = lambda c, sep: F.array_join(F.transform(c, lambda v: F.initcap(F.replace(v, F.lit("_"), F.lit(" ")))), sep)
    top = F.get("cats", F.lit(0))
    only = F.when(F.size("types") == 1, F.concat(top, F.lit(" — "), nice("types", ""))).otherwise(top)
    label = (
        F.when(F.size("cats") == 1, only)
        .when(F.size("types") > 0, F.concat(F.coalesce(F.concat(top, F.lit(" — ")), F.lit("")), nice("types", " y ")))
        .when(F.size("words") > 0, nice("words", " · ")).when(F.size("cat_names") > 0, F.array_join("cat_names", " / "))
        .when(F.size("keys") > 0, nice("keys", " · ")).otherwise("Documentos varios"))
    return out.select("grp", "docs", label.alias("label"))
