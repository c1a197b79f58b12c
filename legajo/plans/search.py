"""Queries of retrieval: lexical and vector ranking, fusion, facets, grouping, context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from legajo.functions import text as T
from legajo.operators import blocks, fusion, lexical, passes, vectors
from legajo.plans.registry import query
from legajo.plans.texts import sql_fold
from legajo.session import materialize, read, spread

K = 10

# SQL building blocks: the same postings and BM25 formula over documents.text
_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"
_POST = f"""a as (select doc_id as id, list_filter(regexp_extract_all({sql_fold('text')}, '\\w+(?:\\.?\\w+)*'), lambda t: len(t) > 1 and not list_contains({_STOP}, t)) as ts from documents),
    p as (select id, term, count(*) as tf, any_value(l) as l from (select id, len(ts) as l, unnest(ts) as term from a) group by id, term)"""
_QUERIES = """nq as (select count(distinct id) as nq from p), dq as (select term, count(*) as dq from p group by term),
    q as (select query, term from (select id as query, term, row_number() over (partition by id order by round(tf * ln(nq / dq), 6) desc, term) as rk from p join dq using (term), nq where id % 50 = 0 and len(term) >= 4) where rk <= 3)"""
_BM25 = """st as (select count(*) as n, avg(l) as m from (select id, any_value(l) as l from p group by id)),
    df as (select term, count(*) as df from p group by term),
    s as (select query, id, count(*) as matched, sum((ln(n / (df + 1)) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / m))) as score from q join p using (term) join df using (term), st group by query, id)"""
_TOP = "t as (select *, row_number() over (partition by query order by round(score, 9) desc, id) as rank from s)"
_LEX = f"{_POST}, {_QUERIES}, {_BM25}"


def document_postings(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(read(spark, d, "documents").select("doc_id", "text")).select("doc_id", T.fold(F.col("text")).alias("f"))
    return materialize(lexical.postings(docs, "doc_id", T.analyzed(F.col("f"))), "postings")


def asking_documents(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, int, float]:
    """(documents (id, terms), queries (query, term, df), number of documents, mean length), for rankings that need no postings of all documents.

    Terms are counted as they are read; only the asking documents have postings.
    """
    table = read(spark, d, "documents")
    docs = spread(table.select("doc_id", "text")).select(F.col("doc_id").alias("id"), F.explode(F.array(T.analyzed(T.fold(F.col("text"))))).alias("terms")).filter("size(terms) > 0")
    docs = blocks.merged(docs, table.select("doc_id"))
    once = docs.select("id", F.size("terms").alias("len"), F.explode(F.concat(F.array_distinct("terms"), F.array(F.lit("")))).alias("term"))  # the empty term counts documents
    counts = materialize(once.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("len").alias("len")), "terms")
    every = counts.filter("term = ''").first()
    if every is None:
        return docs, spark.createDataFrame([], "query long, term string, df long"), 0, 0.0
    df = counts.select("term", "df").filter("term != ''")
    q = lexical.query_terms(lexical.postings(docs.filter("id % 50 = 0"), "id", F.col("terms")), df=df, total=counts.filter("term = ''").select(F.col("df").alias("n")))
    return docs, materialize(q.join(df, "term").select("query", "term", "df"), "asking"), every["df"], every["len"] / every["df"]


def lexical_hits(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(scored hits, queries): every document whose id is divisible by 50 asks with its three most telling terms, against all documents."""
    post = document_postings(spark, d)
    q = lexical.query_terms(post)
    return lexical.bm25(post, q), q


@query(f"with {_POST} select term, count(*) as df, sum(tf)::bigint as cf from p group by term")
def index_terms(spark: SparkSession, d: str) -> DataFrame:
    return document_postings(spark, d).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


@query(f"with {_LEX}, {_TOP} select query, id, matched, round(score, 6) as score, rank from t where rank <= {K}")
def bm25_search(spark: SparkSession, d: str) -> DataFrame:
    hits, _ = lexical_hits(spark, d)
    return lexical.top_k(hits, K).select("query", "id", "matched", F.round("score", 6).alias("score"), "rank")


@query(f"with {_LEX}, n as (select query, count(*) as size from q group by query), a2 as (select s.* from s join n using (query) where matched = size), "
       f"t as (select *, row_number() over (partition by query order by round(score, 9) desc, id) as rank from a2) select query, id, round(score, 6) as score, rank from t where rank <= {K}")
def bm25_all_terms(spark: SparkSession, d: str) -> DataFrame:
    post = document_postings(spark, d)
    q = lexical.query_terms(post)
    return lexical.top_k(lexical.bm25(post, q, match_all=True), K).select("query", "id", F.round("score", 6).alias("score"), "rank")


_TK = "incidencias_soporte_q4_2024"


@query(f"""with s as (select row_id as id, regexp_replace({sql_fold('descripcion_breve')}, '[^a-z0-9]', '', 'g') as s from {_TK}),
       g as (select distinct id, substring(s, i, 3) as gram from s, unnest(range(1, len(s) - 1)) as t(i) where len(s) >= 3),
       q as (select id as query, gram from g where id % 50 = 0), z as (select query, count(*) as size from q group by query),
       c as (select query, id, count(*) as met from g join q using (gram) group by query, id)
       select query, count(*) as hits, max(met / size)::double as best from c join z using (query) where met / size >= 0.4 group by query""")
def char3_coverage(spark: SparkSession, d: str) -> DataFrame:
    """How many tickets hold at least 0.4 of the 3-grams of a query ticket (every ticket whose id is divisible by 50), met class by class."""
    return char3_hits(spark, d)


def _gram_classes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(classes, members): tickets whose descriptions have the same letters and digits are one class, named by its smallest id; it asks where one of its ids is divisible by 50."""
    s = F.regexp_replace(T.fold(F.col("descripcion_breve")), "[^a-z0-9]", "")
    t = materialize(read(spark, d, _TK).select(F.col("row_id").alias("id"), s.alias("s")).filter("char_length(s) >= 3"), "tickets")
    by = t.groupBy("s").agg(F.min("id").alias("cls"), F.count(F.lit(1)).alias("n"), F.max(F.col("id") % 50 == 0).alias("asks"))
    codes = F.transform(F.array_distinct(T.char_ngrams(F.col("s"))), lambda g: F.conv(g, 36, 10).cast("int"))
    classes = materialize(by.select("s", "cls", "n", "asks", codes.alias("grams")), "gramclasses")
    return classes, t.join(classes.select("s", "cls"), "s").select("id", "cls")


@query()
def char3_hits(spark: SparkSession, d: str) -> DataFrame:
    """How many tickets hold at least 0.4 of the 3-grams of a query ticket, for every ticket whose id is divisible by 50."""
    classes, members = _gram_classes(spark, d)
    q = members.filter("id % 50 = 0").select(F.col("id").alias("query"), "cls")
    return q.join(passes.gram_matches(classes, counted=True).withColumnRenamed("query", "cls"), "cls").select("query", "hits", "best")


@query()
def char3_matches(spark: SparkSession, d: str) -> DataFrame:
    """(query, cls, coverage): the matches of char3_hits themselves, from class to class; char3_members has the tickets of each class."""
    return passes.gram_matches(_gram_classes(spark, d)[0])


@query()
def char3_members(spark: SparkSession, d: str) -> DataFrame:
    return _gram_classes(spark, d)[1]


_COS = "list_cosine_similarity(a.embedding::double[], b.embedding::double[])"


@query(f"""with s as (select a.vec_id as query, b.vec_id as id, {_COS} as score from embeddings a join embeddings b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
       t as (select *, row_number() over (partition by query order by round(score, 9) desc, id) as rank from s) select query, id, round(score, 6) as score, rank from t where rank <= {K}""")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings")
    hits = vectors.block_search(e, "vec_id", "embedding", e.filter("vec_id % 50 = 0"), K)
    return hits.select("query", "id", F.round("score", 6).alias("score"), "rank")


@query()
def ann_topk(spark: SparkSession, d: str) -> DataFrame:
    """The same search through the signature index; its recall against the exact one is measured in the tests."""
    e = read(spark, d, "embeddings")
    return vectors.indexed_search(e, "vec_id", "embedding", e.filter("vec_id % 50 = 0"), K).select("query", "id", F.round("score", 6).alias("score"), "rank")


@query("""with x as (select label, unnest(embedding)::double as v, unnest(range(len(embedding))) as pos from embeddings), m as (select label, pos, avg(v) as v from x group by label, pos)
       select label, list(round(v, 6) order by pos) as mean from m group by label""")
def mean_pool(spark: SparkSession, d: str) -> DataFrame:
    return vectors.mean_pool(read(spark, d, "embeddings"), "label", "embedding").select("label", F.transform("mean", lambda x: F.round(x, 6)).alias("mean"))


@query("""with s as (select a.vec_id as a, b.vec_id as b, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as c from embeddings a join embeddings b on a.vec_id < b.vec_id)
       select a, b, round(c, 6) as similarity, row_number() over (order by round(c, 9) desc, a, b) as rank from s where c >= 0.4 order by rank limit 500""")
def duplicate_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The 500 most similar pairs of vectors at a cosine of 0.4 or more, the report's own limit."""
    pairs = vectors.close_pairs(read(spark, d, "embeddings"), "vec_id", "embedding", 0.4).filter("score >= 0.4")
    top = pairs.orderBy(F.desc(F.round("score", 9)), "a", "b").limit(500)
    rank = F.row_number().over(Window.orderBy(F.desc(F.round("score", 9)), "a", "b"))  # 500 rows
    return top.select("a", "b", F.round("score", 6).alias("similarity"), rank.cast("long").alias("rank"))


@query()
def near_duplicate_vectors(spark: SparkSession, d: str) -> DataFrame:
    """One row per vector with the number of vectors at a cosine of 0.85 or more and the smallest id it is linked to."""
    return vectors.near_duplicates(read(spark, d, "embeddings"), "vec_id", "embedding", 0.85)


_SEM = f"""sem as (select a.vec_id as query, b.vec_id as id, {_COS} as score from embeddings a join embeddings b on a.vec_id % 50 = 0),
    sr as (select *, row_number() over (partition by query order by round(score, 9) desc, id) as rank from sem),
    semt as (select query, id, score, rank from sr where rank <= 20 and score >= 0.36)"""


def semantic_hits(spark: SparkSession, d: str, k: int = 20, floor: float = 0.36) -> DataFrame:
    """Vector hits of the documents' vectors (vec_id is taken for doc_id), the query itself included, from the floor up."""
    e = read(spark, d, "embeddings")
    return vectors.block_search(e, "vec_id", "embedding", e.filter("vec_id % 50 = 0"), k, include_self=True).filter(F.col("score") >= floor)


@query(f"""with {_LEX}, {_TOP}, lext as (select query, id, rank from t where rank <= 20), {_SEM},
       f as (select query, id, sum(1 / (60 + rank)) as score from (select query, id, rank from lext union all select query, id, rank from semt) group by query, id),
       r as (select *, row_number() over (partition by query order by round(score, 9) desc, id) as rank from f) select query, id, round(score, 9) as score, rank from r where rank <= {K}""")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    hits, _ = lexical_hits(spark, d)
    return lexical.top_k(fusion.rrf([lexical.top_k(hits, 20), semantic_hits(spark, d)]), K).select("query", "id", F.round("score", 9).alias("score"), "rank")


_WEIGHTED = f"""{_LEX}, {_TOP}, {_SEM},
    l as (select query, id, case when max(score) over w = min(score) over w then 1.0 else (score - min(score) over w) / (max(score) over w - min(score) over w) end as lex_norm from t where rank <= 20 window w as (partition by query)),
    m as (select query, id, case when max(score) over w = min(score) over w then 1.0 else (score - min(score) over w) / (max(score) over w - min(score) over w) end as sem_norm from semt window w as (partition by query)),
    f as (select query, id, coalesce(lex_norm, 0) as lex_norm, coalesce(sem_norm, 0) as sem_norm, 0.55::double * coalesce(lex_norm, 0) + 0.45::double * coalesce(sem_norm, 0) as score,
          case when lex_norm is null then 'semantic' when sem_norm is null then 'lexical' else 'hybrid' end as source from l full join m using (query, id))"""


def fused(spark: SparkSession, d: str) -> DataFrame:
    hits, _ = lexical_hits(spark, d)
    return fusion.weighted(lexical.top_k(hits, 20), semantic_hits(spark, d))


@query(f"""with {_WEIGHTED}, r as (select *, row_number() over (partition by query order by round(score, 9) desc, id) as rank from f)
       select query, id, round(lex_norm, 6) as lex_norm, round(sem_norm, 6) as sem_norm, round(score, 6) as score, source, rank from r where rank <= {K}""")
def weighted_fusion(spark: SparkSession, d: str) -> DataFrame:
    r = lexical.top_k(fused(spark, d), K)
    return r.select("query", "id", *(F.round(c, 6).alias(c) for c in ("lex_norm", "sem_norm", "score")), "source", "rank")


@query(f"""with {_WEIGHTED}, ent as (select distinct {sql_fold('cliente')} as key, doc_id as id from documents where trim(coalesce(cliente, '')) <> ''),
       qt as (select query, ' ' || string_agg(term, ' ') || ' ' || coalesce({sql_fold('any_value(cliente)')}, '') || ' ' as text from q join documents on doc_id = query group by query),
       named as (select query, key from qt join (select distinct key from ent) k on contains(text, ' ' || key || ' ')),
       n as (select query, id, count(*) as n from f join ent using (id) join named using (query, key) group by query, id),
       b as (select f.*, doc_type, f.score * (1 + least(0.15 * coalesce(n.n, 0), 0.3)) as boosted, coalesce(n.n, 0) as named from f join documents d on d.doc_id = f.id left join n using (query, id)),
       r as (select *, row_number() over (partition by query order by round(boosted, 9) desc, id) as rank from b)
       select query, id, doc_type, source, named::bigint as named, round(boosted, 6) as score, rank from r where rank <= {K}""")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """Lexical and vector hits, weighted fusion, boost of the documents of an entity that the query names (0.15 for each, 0.3 at most), top 10 of each query.

    A query document asks with its three most telling terms and its client's name; a document's entity is its client.
    """
    post = document_postings(spark, d)
    terms = lexical.query_terms(post)
    docs = read(spark, d, "documents")
    entities = docs.filter("trim(coalesce(cliente, '')) != ''").select(T.fold(F.col("cliente")).alias("key"), F.col("doc_id").alias("id"))
    texts = terms.groupBy("query").agg(F.array_join(F.collect_list("term"), " ").alias("t")).join(  # three terms
        docs.select(F.col("doc_id").alias("query"), "cliente"), "query").select("query", F.concat_ws(" ", "t", "cliente").alias("text"))
    hits = fusion.weighted(lexical.top_k(lexical.bm25(post, terms), 20), semantic_hits(spark, d))
    boosted = fusion.graph_boost(hits, texts, entities).join(docs.select(F.col("doc_id").alias("id"), "doc_type"), "id")
    return lexical.top_k(boosted, K).select("query", "id", "doc_type", "source", "named", F.round("score", 6).alias("score"), "rank")


_ACTIVE = {"doc_type": "informe", "language": "es", "category": "Informes"}


@query(" union all ".join(f"select '{c}' as facet, {c} as value, count(*) as n from documents_x where {c} is not null and " + " and ".join(f"{o} = '{v}'" for o, v in _ACTIVE.items() if o != c) + f" group by {c}" for c in _ACTIVE))
def cascade_facets(spark: SparkSession, d: str) -> DataFrame:
    return fusion.cascade_counts(read(spark, d, "documents_x"), _ACTIVE)


@query(f"""select chunk_id from chunks where len(list_filter(coalesce(persons, []), lambda p: contains({sql_fold('p')}, 'lopez') or contains({sql_fold('p')}, 'jovusa'))) > 0
       and len(list_filter(coalesce(dates, []), lambda x: starts_with(x, '2024'))) > 0""")
def person_date_filter(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that name a person by a folded part of the name and a date by its beginning."""
    named = F.exists("persons", lambda p: F.contains(T.fold(p), F.lit("lopez")) | F.contains(T.fold(p), F.lit("jovusa")))
    dated = F.exists("dates", lambda x: F.startswith(x, F.lit("2024")))
    return read(spark, d, "chunks").filter(named & dated).select("chunk_id")


_LISTS = ("persons", "organizations", "keywords", "dates", "emails")


@query(f"""with e as ({' union all '.join(f"select doc_id, '{c}' as c, unnest(coalesce({c}, [])) as v from chunks" for c in _LISTS)}), s as (select doc_id, c, string_agg(distinct v, '; ' order by v) as l from e group by doc_id, c),
       n as (select doc_id, count(*) as n_chunks, sum(len(text))::bigint as chars from chunks group by doc_id)
       select doc_id, n_chunks, chars, {', '.join(f"coalesce((select l from s where s.doc_id = n.doc_id and c = '{c}'), '') as {c}" for c in _LISTS)} from n""")
def document_detail(spark: SparkSession, d: str) -> DataFrame:
    """A document from its chunks: their number, the characters, and the union of each of their lists."""
    union = lambda c: F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(c, F.array().cast("array<string>")))))), "; ").alias(c)  # noqa: E731 - the chunks of one document
    return read(spark, d, "chunks").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(F.char_length("text")).alias("chars"), *map(union, _LISTS))


@query("select doc_id, md5(string_agg(text, chr(10) || chr(10) order by chunk_index, chunk_id)) as text_md5 from chunks group by doc_id")
def rebuilt_text(spark: SparkSession, d: str) -> DataFrame:
    parts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "chunk_id", "text"))), lambda x: x["text"]), "\n\n")  # one document's chunks
    return read(spark, d, "chunks").groupBy("doc_id").agg(F.md5(F.encode(parts, "UTF-8")).alias("text_md5"))


@query("""with w as (select doc_id, chunk_id, cast(ceil(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) * 1.3) as bigint) as toks, row_number() over (partition by doc_id order by chunk_index, chunk_id) as rk from chunks),
       c as (select *, sum(toks) over (partition by doc_id order by rk rows unbounded preceding)::bigint as used from w) select doc_id, chunk_id, rk, used from c where used <= 1000""")
def context_pack(spark: SparkSession, d: str) -> DataFrame:
    """The leading chunks of every document that fit into a budget of 1000 estimated tokens (1.3 a word)."""
    words = F.size(F.filter(F.split("text", r"\s+"), lambda x: x != ""))
    w = Window.partitionBy("doc_id").orderBy("chunk_index", "chunk_id")
    t = read(spark, d, "chunks").withColumn("toks", F.ceil(words * 1.3)).withColumn("rk", F.row_number().over(w).cast("long"))
    return t.withColumn("used", F.sum("toks").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("used <= 1000").select("doc_id", "chunk_id", "rk", "used")


@query("select user_id, event_id, rk from (select user_id, event_id, row_number() over (partition by user_id order by ts desc, event_id desc) as rk from events) where rk <= 20")
def session_tail(spark: SparkSession, d: str) -> DataFrame:
    """The last 20 events of each user, the shape of a session's history."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return read(spark, d, "events").withColumn("rk", F.row_number().over(w).cast("long")).filter("rk <= 20").select("user_id", "event_id", "rk")
