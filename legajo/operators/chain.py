"""The lexical passes over chunks in their order: all terms over seven fields, any term, numbers, 3-grams, stems."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from legajo.functions import text as T
from legajo.operators import blocks, passes
from legajo.session import discard, materialize

#: Boosts of the seven fields, fixed values. Folded and plain forms of title and content hold the same terms, as terms are folded either way, so the two share postings.
BOOSTS = {"title": 2.5 + 1.8, "content": 2.0 + 1.0, "keywords": 1.2, "persons": 1.2, "organizations": 1.2}
SYNONYM_WEIGHT = 0.35
NUMERIC_UP_TO = 2
COVERAGE = 0.4


def field_terms(chunks: DataFrame) -> DataFrame:
    """(id, an array of terms for each field) of chunks (chunk_id, title, text, keywords, persons, organizations)."""
    joined = lambda c: F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), ", ")
    source = {"title": F.coalesce("title", F.lit("")), "content": F.coalesce("text", F.lit("")), "keywords": joined("keywords"), "persons": joined("persons"), "organizations": joined("organizations")}
    return chunks.select(F.col("chunk_id").alias("id"), *(T.analyzed(T.fold(c)).alias(f) for f, c in source.items()))


def field_statistics(rows: DataFrame, fields: list[str], vocabulary: DataFrame) -> tuple[DataFrame, list[tuple[int, float]]]:
    """(term, df) of each term of the vocabulary (term) with an array of the rows that hold it in each field, and each field's rows with terms and their mean length. rows: (id, fields, lens)."""
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("f"), F.array_distinct(c).alias("ts")) for i, c in enumerate(fields))))
    terms = rows.select(each.alias("x")).select("x.f", F.explode("x.ts").alias("term"))
    df = terms.groupBy("term").agg(F.array(*(F.count(F.when(F.col("f") == i, 1)) for i in range(len(fields)))).alias("df"))
    none = F.array(*(F.lit(0).cast("long") for _ in fields))
    length = lambda i: F.nullif(F.array_max(F.filter("lens", lambda x, at: at % len(fields) == i)), F.lit(0))
    sums = rows.agg(*(f(length(i)) for i in range(len(fields)) for f in (F.count, F.avg))).first()
    return vocabulary.join(df, "term", "left").select("term", F.coalesce("df", none).alias("df")), [(sums[2 * i], sums[2 * i + 1]) for i in range(len(fields))]


def _with_lengths(words: DataFrame, fields: list[str]) -> DataFrame:
    return blocks.merged(words.withColumn("lens", blocks.lengths(fields)), words.select("id"))


def _terms(queries: DataFrame, words: Column) -> DataFrame:
    return queries.select("query", F.explode(F.array_distinct(words)).alias("term"))


def _best(rows: DataFrame, queries: DataFrame, df: DataFrame | None, keys: blocks.Keys, pass_no: int, k: int) -> DataFrame:
    """The k best rows of each query (query, term, soft, or df where there is no df), written, without a row for every hit."""
    hits = blocks.best(rows, queries, keys, k, df=df)
    return materialize(hits.select("query", "id", F.lit(pass_no).alias("pass_no"), F.col("rank").alias("place")), f"pass{pass_no}")


def _in_content(words: DataFrame, queries: DataFrame, pass_no: int, k: int) -> list[DataFrame]:
    """The k best rows with all terms of a query (query, term) among their words (id, content); no frame where none asks."""
    if queries.isEmpty():
        return []
    words = materialize(words, "content")
    rows = _with_lengths(words, ["content"])
    df, stats = field_statistics(rows, ["content"], queries.select("term").distinct())
    found = _best(rows, queries.withColumn("soft", F.lit(False)), materialize(df, "df"), blocks.by_fields([(1.0, *x) for x in stats], True), pass_no, k)
    discard(words)
    return [found]


def search(chunks: DataFrame, queries: DataFrame, numbers: Column, asked_numbers: Column, k: int = 20, synonyms: DataFrame | None = None) -> DataFrame:
    """(query, id, pass_no, rank): the k first hits of each query (query, text) among chunks, pass after pass, each where it first turns up.

    0  all words of the query (stop words left out), each in any field; with synonyms (word, synonym), rows
       that hold some score 0.35 of their weight more, none is added;
    1  where that gives nothing: any word, synonyms included;
    2  where there are two hits at most and the query has numbers: all words of the query with numbers as digits
       (asked_numbers), in the chunks' text with numbers as digits (numbers);
    3  where the query looks mistyped: chunks with 0.4 of its 3-grams or more, by that share;
    4  all stems of the query in the stems of the text.

    A query of stop words alone, a null or an empty one finds nothing. Ties by id.
    """
    queries = materialize(queries.filter("text is not null").withColumn("words", T.query_words(T.fold(F.col("text")))).filter("size(words) > 0"), "queries")
    q = materialize(_terms(queries, T.analyzed(F.array_join("words", " "))), "terms")
    asked = q.withColumn("soft", F.lit(False))
    if synonyms is not None:
        extra = q.join(synonyms.select(F.col("word").alias("term"), "synonym"), "term").select("query", F.col("synonym").alias("term")).distinct()
        asked = asked.unionByName(extra.withColumn("soft", F.lit(True)))
    asked = materialize(asked, "asked")
    fields = [*BOOSTS]
    words = materialize(field_terms(chunks).select("id", *fields), "fields")
    rows = _with_lengths(words, fields)
    df, stats = field_statistics(rows, fields, asked.select("term").distinct())
    df, stats = materialize(df, "df"), [(b, *x) for b, x in zip(BOOSTS.values(), stats)]
    base = _best(rows, asked, df, blocks.by_fields(stats, True, SYNONYM_WEIGHT if synonyms is not None else 0.0), 0, k)
    found = base.groupBy("query").agg(F.count(F.lit(1)).alias("hits"))
    none = queries.select("query").join(found, "query", "left_anti")
    wide = materialize(asked.join(none, "query", "left_semi").select("query", "term").distinct().withColumn("soft", F.lit(False)), "wide")
    second = _best(rows, wide, df, blocks.by_fields(stats, False), 1, k)
    stems = lambda ts: F.transform(ts, passes.stem)
    sq = materialize(_terms(queries, stems(T.analyzed(F.array_join("words", " ")))), "stems")
    fifth = _in_content(words.select("id", stems("content").alias("content")), sq, 4, k)
    discard(words)
    # Numbers: the words with digits are one field.
    count = base.unionByName(second).groupBy("query").agg(F.count(F.lit(1)).alias("hits"))
    few = queries.join(count, "query", "left").filter(F.coalesce("hits", F.lit(0)) <= NUMERIC_UP_TO).withColumn("n", asked_numbers)
    signal = few.filter(F.exists("n", lambda t: t.rlike("[0-9]")) | (F.array_join("n", " ") != T.fold(F.col("text"))))
    numbers = chunks.select(F.col("chunk_id").alias("id"), F.coalesce(numbers, F.array().cast("array<string>")).alias("content"))
    third = _in_content(numbers, materialize(_terms(signal, "n"), "numbers"), 2, k)
    # 3-grams of mistyped queries.
    noisy = queries.filter(T.noisy(F.col("text"))).select("query", F.explode(F.array_distinct(T.char_ngrams(T.fold(F.col("text"))))).alias("term"))
    noisy = materialize(noisy.withColumn("df", F.lit(0)), "noisy")
    fourth = []
    if not noisy.isEmpty():
        signs = F.array(F.regexp_replace(T.fold(F.coalesce("text", F.lit(""))), "[^a-z0-9]", ""))
        texts = blocks.merged(chunks.select(F.col("chunk_id").alias("id"), signs.alias("texts")), chunks.select("chunk_id"))
        fourth = [_best(texts, noisy, None, blocks.by_share(COVERAGE), 3, k)]
    hits = reduce(DataFrame.unionByName, [base, second, *third, *fourth, *fifth])
    first = hits.groupBy("query", "id").agg(F.min(F.struct("pass_no", "place")).alias("b")).select("query", "id", "b.*")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("pass_no", "place", "id"))
    return first.withColumn("rank", rank.cast("long")).filter(f"rank <= {k}").select("query", "id", F.col("pass_no").cast("long").alias("pass_no"), "rank")
