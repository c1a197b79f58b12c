"""Fusing ranked lists, boosting, grouping and facets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from legajo.functions.text import bind, fold, iso_date

RRF_K = 60
BOOST = 0.15
LEXICAL, SEMANTIC = 0.55, 0.45


def rrf(lists: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """(query, id, score): sum of 1 / (k + rank) over lists (query, id, rank)."""
    union = lists[0].select("query", "id", "rank")
    for x in lists[1:]:
        union = union.unionByName(x.select("query", "id", "rank"))
    return union.groupBy("query", "id").agg(F.sum(1 / (k + F.col("rank"))).alias("score"))


def min_max(df: DataFrame, score: str, out: str) -> DataFrame:
    """Scores scaled to 0..1 within each query; all equal gives 1."""
    w = Window.partitionBy("query")
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return df.withColumn(out, F.when(hi == lo, 1.0).otherwise((F.col(score) - lo) / (hi - lo)))


def weighted(lex: DataFrame, sem: DataFrame) -> DataFrame:
    """(query, id, lex_norm, sem_norm, score, source): full outer join of two scored lists, a missing side counts 0."""
    a = min_max(lex, "score", "lex_norm").select("query", "id", "lex_norm")
    b = min_max(sem, "score", "sem_norm").select("query", "id", "sem_norm")
    j = a.join(b, ["query", "id"], "full")
    source = F.when(F.col("lex_norm").isNull(), "semantic").when(F.col("sem_norm").isNull(), "lexical").otherwise("hybrid")
    j = j.withColumn("source", source).na.fill(0.0, ["lex_norm", "sem_norm"])
    return j.withColumn("score", LEXICAL * F.col("lex_norm") + SEMANTIC * F.col("sem_norm"))


def graph_boost(hits: DataFrame, texts: DataFrame, entities: DataFrame, boost: float = BOOST, words: int = 8) -> DataFrame:
    """hits (query, id, score, ...) with named, the number of entities that both the query's text names and the row holds, and the score times 1 + boost for each, two at most.

    texts: (query, text); entities: (key, id), keys folded. A query names an entity where a run of its words (up to
    `words`) is the entity's key. Only the entities of the hits themselves are looked at, so an entity of many rows is no burden.
    """

    def runs(ws: Column) -> Column:
        return F.flatten(F.transform(ws, lambda _, i: F.transform(F.sequence(F.lit(1), F.least(F.lit(words), F.size(ws) - i)), lambda n: F.array_join(F.slice(ws, i + 1, n), " "))))

    named = texts.select("query", F.explode(bind(F.split(fold(F.col("text")), " "), runs)).alias("key")).distinct()
    both = hits.select("query", "id").join(entities.distinct(), "id").join(named, ["query", "key"]).groupBy("query", "id").agg(F.count(F.lit(1)).alias("named"))
    out = hits.join(both, ["query", "id"], "left").withColumn("named", F.coalesce("named", F.lit(0)))
    return out.withColumn("score", F.col("score") * (1 + F.least(boost * F.col("named"), F.lit(2 * boost))))


def pool_facets(pool: DataFrame, single: dict[str, int], many: dict[str, int], dated: dict[str, int], doc_col: str = "doc_id") -> DataFrame:
    """(query, facet, value, n, rk): facets of each query's hits (query, doc_id, rank and the facets' columns).

    single (column -> how many): one value a document, that of its best hit; many: lists, counted for each
    hit, most frequent first, ties by value; dated: lists of dates, as ISO texts, the newest first.
    """
    first = pool.groupBy("query", doc_col).agg(*(F.min_by(c, "rank").alias(c) for c in single))
    none = F.array().cast("array<string>")
    values = lambda c, kind, iso: F.transform(F.coalesce(F.col(c), none), lambda v: F.struct(F.lit(c).alias("facet"), (iso_date(v) if iso else v).alias("value")))
    lists = pool.select("query", F.explode(F.concat(*(values(c, "m", False) for c in many), *(values(c, "d", True) for c in dated))).alias("x"))
    once = first.select("query", F.explode(F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in single))).alias("x"))
    counts = lists.unionByName(once).select("query", "x.*").filter("value is not null and value != ''").groupBy("query", "facet", "value").agg(F.count(F.lit(1)).alias("n"))
    limit = F.element_at(F.create_map(*(F.lit(x) for kv in (single | many | dated).items() for x in kv)), F.col("facet"))
    by_date = F.when(F.col("facet").isin(*dated), F.col("value"))
    rank = F.row_number().over(Window.partitionBy("query", "facet").orderBy(F.desc(by_date), F.desc("n"), "value"))
    return counts.withColumn("rk", rank.cast("long")).filter(F.col("rk") <= limit)


def per_document(ranked: DataFrame, doc_col: str, most: int = 3, order: str = "rank") -> DataFrame:
    """At most so many hits a document and query, the best ones."""
    rn = F.row_number().over(Window.partitionBy("query", doc_col).orderBy(order))
    return ranked.withColumn("rn", rn).filter(f"rn <= {most}").drop("rn")


def facet_counts(df: DataFrame, facets: dict[str, tuple[str, bool, int]]) -> DataFrame:
    """(facet, value, n, rk): counts of each facet's values. facets: name -> (column, whether an array, how many).

    The facets' values are unpivoted first, so one pass over df and one shuffle of distinct values serve all.
    """

    def entries(name: str, c: str, many: bool) -> Column:
        values = F.coalesce(F.col(c), F.array().cast("array<string>")) if many else F.array(F.col(c))
        return F.transform(values, lambda v: F.struct(F.lit(name).alias("facet"), v.alias("value")))

    parts = [entries(n, c, many) for n, (c, many, _) in facets.items()]
    long = df.select(F.explode(F.flatten(F.array(*parts))).alias("x")).select("x.*").filter("value is not null and value != ''")
    counts = long.groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))
    limit = F.element_at(F.create_map(*(F.lit(x) for n, (_, _, k) in facets.items() for x in (n, k))), F.col("facet"))
    rank = F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("n"), "value"))
    return counts.withColumn("rk", rank.cast("long")).filter(F.col("rk") <= limit)


def cascade_counts(df: DataFrame, active: dict[str, str]) -> DataFrame:
    """(facet, value, n): each facet counted under all active filters but its own, in one pass. active: column -> value."""
    ok = {c: F.coalesce(F.col(c) == v, F.lit(False)) for c, v in active.items()}
    entries = []
    for c in active:
        others = F.lit(True)
        for o in active:
            if o != c:
                others = others & ok[o]
        entries.append(F.when(others, F.struct(F.lit(c).alias("facet"), F.col(c).alias("value"))))
    return df.select(F.explode(F.array_compact(F.array(*entries))).alias("x")).select("x.*").filter("value is not null").groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))
