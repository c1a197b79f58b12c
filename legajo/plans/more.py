"""Queries of the further passes, of result shaping, clusters and the tables' previews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from legajo.functions import text as T
from legajo.operators import blocks, clusters, fusion, lexical, passes, vectors
from legajo.plans import search as S
from legajo.plans.registry import query
from legajo.plans.texts import sql_fold
from legajo.session import materialize, read

TICKETS = "incidencias_soporte_q4_2024"


def _field(col: str, name: str) -> str:
    return f"""{name}a as (select doc_id as id, list_filter(regexp_extract_all({sql_fold(f"coalesce({col}, '')")}, '\\w+(?:\\.?\\w+)*'), lambda t: len(t) > 1 and not list_contains({S._STOP}, t)) as ts from documents),
        {name} as (select id, term, count(*) as tf, any_value(l) as l from (select id, len(ts) as l, unnest(ts) as term from {name}a) group by id, term),
        {name}s as (select count(*) as n, avg(l) as m from (select id, any_value(l) as l from {name} group by id)), {name}f as (select term, count(*) as df from {name} group by term)"""


def _part(name: str, boost: float) -> str:
    return f"select query, id, term, {boost}::double * (ln(n / (df + 1)) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / m)) as s from q join {name} using (term) join {name}f using (term), {name}s"


@query(f"""with {_field('text', 'p')}, {_field('cliente', 'c')}, {_field('doc_type', 'y')}, {S._QUERIES},
       u as ({_part('p', 2.0)} union all {_part('c', 1.2)} union all {_part('y', 1.8)}), z as (select query, count(*) as size from q group by query),
       s as (select query, id, count(distinct term) as matched, sum(s) as score from u group by query, id),
       t as (select s.*, row_number() over (partition by query order by round(score, 9) desc, id) as rank from s join z using (query) where matched = size)
       select query, id, round(score, 6) as score, rank from t where rank <= 10""")
def bm25_multifield(spark: SparkSession, d: str) -> DataFrame:
    """BM25 over text, client and type with their boosts; all terms must be met, each in any field."""
    docs = read(spark, d, "documents")
    post = lambda c: materialize(lexical.postings(docs.select("doc_id", T.fold(F.coalesce(F.col(c), F.lit(""))).alias("f")), "doc_id", T.analyzed(F.col("f"))), c)
    text = post("text")
    hits = passes.multifield({"text": (text, 2.0), "cliente": (post("cliente"), 1.2), "doc_type": (post("doc_type"), 1.8)}, lexical.query_terms(text))
    return lexical.top_k(hits, 10).select("query", "id", F.round("score", 6).alias("score"), "rank")


_STEM = f"regexp_replace(t, '^([a-z]{{3,}}?)(?:{'|'.join(passes.ENDINGS)})$', '\\1')"


@query(f"""with t as (select distinct unnest(regexp_extract_all({sql_fold('descripcion_breve')}, '[a-z]+')) as t from {TICKETS}) select t as term, {_STEM} as stem from t""")
def word_stems(spark: SparkSession, d: str) -> DataFrame:
    words = read(spark, d, TICKETS).select(F.explode(F.regexp_extract_all(T.fold(F.col("descripcion_breve")), F.lit("([a-z]+)"), F.lit(1))).alias("term")).distinct()
    return words.select("term", passes.stem(F.col("term")).alias("stem"))


@query(f"""with {S._POST}, num as (select id, term from p where regexp_full_match(term, '[0-9]+')), q as (select id as query, term from (select id, term, row_number() over (partition by id order by len(term) desc, term) as rk from num where id % 50 = 0) where rk <= 2),
       z as (select query, count(*) as size from q group by query), s as (select query, id, count(*) as matched from q join num using (term) group by query, id)
       select query, count(*) as hits from s join z using (query) where matched = size group by query""")
def numeric_pass(spark: SparkSession, d: str) -> DataFrame:
    """How many documents hold both of the longest numbers of each query document (ids divisible by 50)."""
    num = S.document_postings(spark, d).filter(F.col("term").rlike("^[0-9]+$")).select("id", "term")
    w = Window.partitionBy("id").orderBy(F.desc(F.char_length("term")), "term")
    q = num.filter("id % 50 = 0").withColumn("rk", F.row_number().over(w)).filter("rk <= 2").select(F.col("id").alias("query"), "term")
    size = q.groupBy("query").agg(F.count(F.lit(1)).alias("size"))
    met = num.join(q, "term").groupBy("query", "id").agg(F.count(F.lit(1)).alias("matched")).join(size, "query").filter("matched = size")
    return met.groupBy("query").agg(F.count(F.lit(1)).alias("hits"))


@query(f"""with {S._LEX}, n as (select query, count(*) as size from q group by query),
       u as (select query, id, case when matched = size then 0 else 1 end as pass_no, -round(score, 9) as neg from s join n using (query)),
       r as (select *, row_number() over (partition by query order by pass_no, neg, id) as rank from u) select query, id, pass_no::bigint as pass_no, rank from r where rank <= 20""")
def lexical_passes(spark: SparkSession, d: str) -> DataFrame:
    """Rows with all terms first, then rows with some of them, 20 a query."""
    docs, q, n_docs, mean_len = S.asking_documents(spark, d)
    hits = blocks.best(docs, q, blocks.by_bm25(n_docs, mean_len), 20)
    return hits.select("query", "id", F.when(F.col("key") >= blocks.EVERY, 0).otherwise(1).cast("long").alias("pass_no"), "rank")


_CHUNK_HITS = f"""{S._POST}, {S._QUERIES},
    ca as (select chunk_id, doc_id, filename, title, regexp_extract_all({sql_fold('text')}, '\\w+(?:\\.?\\w+)*') as ts, {sql_fold("coalesce(title, '')")} as ft from chunks),
    cp as (select chunk_id, doc_id, filename, ft, unnest(list_distinct(ts)) as term from ca),
    ch as (select query, chunk_id, any_value(doc_id) as doc_id, any_value(filename) as filename, count(*) as matched, bool_or(contains(ft, q.term)) as in_title from q join cp using (term) group by query, chunk_id),
    cr as (select *, row_number() over (partition by query order by matched desc, in_title desc, chunk_id) as rank from ch)"""


def chunk_hits(spark: SparkSession, d: str) -> DataFrame:
    """(query, chunk_id, doc_id, filename, matched, in_title, rank): chunks by how many of a query document's terms they hold."""
    q = lexical.query_terms(S.document_postings(spark, d))
    terms = F.explode(F.array_distinct(F.regexp_extract_all(T.fold(F.col("text")), F.lit(r"(\w+(?:\.?\w+)*)"), F.lit(1))))
    c = read(spark, d, "chunks").select("chunk_id", "doc_id", "filename", T.fold(F.coalesce("title", F.lit(""))).alias("ft"), terms.alias("term"))
    hits = c.join(q, "term").groupBy("query", "chunk_id").agg(
        F.first("doc_id").alias("doc_id"), F.first("filename").alias("filename"), F.count(F.lit(1)).alias("matched"), F.max(F.contains("ft", F.col("term"))).alias("in_title"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("matched"), F.desc("in_title"), "chunk_id"))
    return hits.withColumn("rank", rank.cast("long"))


def chunk_best(spark: SparkSession, d: str, k: int) -> DataFrame:
    """(query, chunk_id, doc_id, matched, in_title, rank): the first k of chunk_hits for each query, found without a row for every hit."""
    _, q, _, _ = S.asking_documents(spark, d)
    terms = F.array_distinct(F.regexp_extract_all(T.fold(F.col("text")), F.lit(r"(\w+(?:\.?\w+)*)"), F.lit(1)))
    table = read(spark, d, "chunks")
    c = table.select(F.col("chunk_id").alias("id"), "doc_id", F.explode(F.array(F.struct(terms.alias("terms"), T.fold(F.coalesce("title", F.lit(""))).alias("title")))).alias("x")).filter("x.terms is not null")
    c = c.select("id", "doc_id", "x.terms", F.filter("x.terms", lambda t: F.contains("x.title", t)).alias("named"))
    level = F.col("key").cast("long")
    c = blocks.merged(c, table.select("chunk_id"))
    return blocks.best(c, q, blocks.by_levels, k, ("doc_id",)).select(
        "query", F.col("id").alias("chunk_id"), "doc_id", F.shiftright(level, 1).alias("matched"), (level % 2 == 1).alias("in_title"), "rank")


@query(f"with {_CHUNK_HITS}, d as (select *, row_number() over (partition by query, doc_id order by rank) as rn from cr) select query, chunk_id, doc_id, matched, in_title, rank from d where rn <= 3 and rank <= 50")
def chunks_per_document(spark: SparkSession, d: str) -> DataFrame:
    """The best 50 chunks of each query, at most three of a document."""
    return fusion.per_document(chunk_best(spark, d, 50), "doc_id", 3).select("query", "chunk_id", "doc_id", "matched", "in_title", "rank")


_SINGLE, _MANY, _DATED = {"doc_type": 20, "language": 10}, {"persons": 20, "organizations": 20, "keywords": 15}, {"dates": 20}
_ISO = "case when regexp_full_match(trim(v), '[0-9]{4}(-[0-9]{2}){0,2}') then trim(v) when regexp_full_match(trim(v), '[0-9]{1,2}(/|-)[0-9]{1,2}(/|-)[0-9]{4}') then right(trim(v), 4) || '-' || lpad(regexp_extract(trim(v), '^[0-9]+[/-]([0-9]+)', 1), 2, '0') || '-' || lpad(regexp_extract(trim(v), '^([0-9]+)', 1), 2, '0') end"


@query(f"""with {_CHUNK_HITS}, pool as (select cr.query, cr.rank, c.* from cr join chunks c using (chunk_id) where rank <= 200),
       l as ({' union all '.join([f"select query, '{c}' as facet, v from (select query, doc_id, arg_min_null({c}, rank) as v from pool group by query, doc_id)" for c in _SINGLE]
         + [f"select query, '{c}', unnest({c}) from pool" for c in _MANY] + [f"select query, 'dates', {_ISO} from (select query, unnest(dates) as v from pool)"])}),
       n as (select query, facet, v as value, count(*) as n from l where v is not null and v <> '' group by query, facet, v),
       r as (select *, row_number() over (partition by query, facet order by case when facet = 'dates' then value end desc nulls last, n desc, value) as rk from n)
       select query, facet, value, n, rk from r where rk <= case facet when 'keywords' then 15 when 'language' then 10 else 20 end""")
def facets(spark: SparkSession, d: str) -> DataFrame:
    """Facets of the 200 best chunks of each query: type and language once a document, names and keywords by count, dates the newest first."""
    pool = chunk_hits(spark, d).filter("rank <= 200").select("query", "chunk_id", "rank").join(read(spark, d, "chunks"), "chunk_id")
    return fusion.pool_facets(pool, _SINGLE, _MANY, _DATED)


@query(f"""with {_CHUNK_HITS} select query, doc_id, count(*) as n_chunks, max(matched) as best, min(rank) as first_rank, string_agg(chunk_id, ' ' order by rank) as chunk_ids from cr where rank <= 50 group by query, doc_id""")
def grouped_results(spark: SparkSession, d: str) -> DataFrame:
    """The best 50 chunks of each query, by document."""
    top = chunk_best(spark, d, 50)
    ids = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]), " ")  # 50 at most
    return top.groupBy("query", "doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.max("matched").alias("best"), F.min("rank").alias("first_rank"), ids.alias("chunk_ids"))


@query(f"""with {_CHUNK_HITS}, f as (select query, filename, min(rank) as rank from cr group by query, filename), r as (select *, row_number() over (partition by query order by rank) as rk from f) select query, filename, rk from r where rk <= 8""")
def answer_sources(spark: SparkSession, d: str) -> DataFrame:
    """The first eight distinct files among a query's hits."""
    f = chunk_hits(spark, d).groupBy("query", "filename").agg(F.min("rank").alias("rank"))
    return f.withColumn("rk", F.row_number().over(Window.partitionBy("query").orderBy("rank")).cast("long")).filter("rk <= 8").select("query", "filename", "rk")


@query(f"""with {S._WEIGHTED}, r as (select *, row_number() over (partition by query order by round(score, 9) desc, id) as rank from f)
       select query, id, rank, source, concat_ws(', ', case when lex_norm > 0 then 'terms' end, case when sem_norm > 0 then 'meaning' end) as why from r where rank <= 10""")
def explained_results(spark: SparkSession, d: str) -> DataFrame:
    r = lexical.top_k(S.fused(spark, d), 10)
    return r.select("query", "id", "rank", "source", F.concat_ws(", ", F.when(F.col("lex_norm") > 0, "terms"), F.when(F.col("sem_norm") > 0, "meaning")).alias("why"))


@query("""with w as (select doc_type as cluster, unnest(regexp_extract_all(lower(title), '[a-záéíóúüñç]{4,}')) as word, 1 as w from documents_x union all select doc_type, unnest(keywords), 2 from documents_x),
       s as (select cluster, word, sum(w)::bigint as weight from w where word is not null group by 1, 2), r as (select *, row_number() over (partition by cluster order by weight desc, word) as rk from s) select cluster, word, weight, rk from r where rk <= 8""")
def cluster_keywords(spark: SparkSession, d: str) -> DataFrame:
    return clusters.cluster_words(read(spark, d, "documents_x"), "doc_type", "title", "keywords")


_NICE = "array_to_string(list_transform(string_split(replace(v, '_', ' '), ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ')"


@query(f"""with g as (select unnest(['type ' || doc_type, 'category ' || category, 'language ' || language, 'letter ' || doc_id[1]]) as grp, coalesce(doc_type, 'documento') as t, category as c, title, keywords from documents_x),
       d as (select * from g where grp is not null), s as (select grp, count(*) as docs from d group by grp),
       cs as (select grp, c as v, count(*) as n from d where c not in ('', 'General') group by all), ts as (select grp, t as v, count(*) as n from d where t <> 'documento' group by all),
       wd as (select grp, v, count(*) as n from (select grp, unnest(list_distinct(regexp_extract_all(lower(title), '[a-zà-ÿ]{{3,}}'))) as v from d) group by all),
       ws as (select wd.grp, v, n from wd join s using (grp) where n >= greatest(2, 0.4 * docs) and v not in {clusters.LABEL_STOP}),
       ks as (select grp, v, count(*) as n from (select grp, trim(lower(k)) as v from (select grp, unnest(keywords) as k from d)) where v <> '' group by all),
       c as (select grp, count(*) as k, arg_min(v, (-n, v)) as v, (list(v order by v))[:2] as names from cs group by grp),
       t as (select grp, count(*) as k, (list({_NICE} order by n desc, v))[:2] as vs from ts group by grp),
       w as (select grp, (list({_NICE} order by n desc, v))[:3] as vs from ws group by grp), kw as (select grp, (list({_NICE} order by n desc, v))[:2] as vs from ks group by grp)
       select s.grp, docs, case when c.k = 1 then c.v || case when t.k = 1 then ' — ' || t.vs[1] else '' end when t.k > 0 then coalesce(c.v || ' — ', '') || array_to_string(t.vs, ' y ')
           when len(w.vs) > 0 then array_to_string(w.vs, ' · ') when c.k > 0 then array_to_string(c.names, ' / ') when len(kw.vs) > 0 then array_to_string(kw.vs, ' · ') else 'Documentos varios' end as label
       from s left join c using (grp) left join t using (grp) left join w using (grp) left join kw using (grp)""")
def cluster_labels(spark: SparkSession, d: str) -> DataFrame:
    """A name for each type, category, language and first letter of the identifier."""
    name = lambda kind, c: F.concat(F.lit(f"{kind} "), c)
    groups = F.array(name("type", F.col("doc_type")), name("category", F.col("category")), name("language", F.col("language")), name("letter", F.substring("doc_id", 1, 1)))
    return clusters.group_labels(read(spark, d, "documents_x").withColumn("grp", F.explode(groups)), "grp")


@query()
def vector_clusters(spark: SparkSession, d: str) -> DataFrame:
    c = clusters.two_levels(read(spark, d, "embeddings"), "vec_id", "embedding")
    return c.select("id", F.col("cluster").cast("long").alias("cluster"), F.col("child").cast("long").alias("child"))


@query()
def corpus_synonyms(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours of each frequent word of the corpus."""
    v = materialize(passes.word_vectors(read(spark, d, "documents"), "text"), "words")
    return passes.synonyms(v, floor=0.3).select("word", "synonym", F.round("score", 6).alias("score"), "rank")


@query(f"select row_id, coalesce(id_ticket, '') as id_ticket, coalesce(fecha_cierre::varchar, '') as fecha_cierre, coalesce(descripcion_breve, '') as descripcion_breve from {TICKETS} order by row_id limit 500")
def table_preview(spark: SparkSession, d: str) -> DataFrame:
    """The first 500 rows of a table as text, nulls empty: the preview's own limit."""
    t = read(spark, d, TICKETS).orderBy("row_id").limit(500)
    return t.select("row_id", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("id_ticket", "fecha_cierre", "descripcion_breve")))


@query("""with e as (select doc_id, unnest(coalesce(persons, []) || coalesce(organizations, [])) as name from documents_x)
       select doc_id, count(distinct name) as n_names, coalesce(any_value(d.title), any_value(d.filename)) as shown from documents_x d left join e using (doc_id) group by doc_id""")
def document_list(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents_x")
    none = F.array().cast("array<string>")
    return docs.select("doc_id", F.size(F.array_distinct(F.filter(F.concat(F.coalesce("persons", none), F.coalesce("organizations", none)), lambda x: x.isNotNull()))).cast("long").alias("n_names"), F.coalesce("title", "filename").alias("shown"))


@query()
def chunk_vectors_near(spark: SparkSession, d: str) -> DataFrame:
    """Near duplicates of documents by mean-pooled hashed vectors of their chunks, cosine 0.85: a row per document."""
    dims = 64
    c = read(spark, d, "chunks").select("doc_id", F.explode(F.regexp_extract_all(T.fold(F.col("text")), F.lit("([a-z]{3,})"), F.lit(1))).alias("w"))
    counts = c.groupBy("doc_id", F.pmod(F.xxhash64("w"), F.lit(dims)).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("b").agg(F.sum("n").alias("bn"), F.count(F.lit(1)).alias("docs"))  # dims rows
    centred = counts.join(F.broadcast(totals), "b").withColumn("x", F.log1p("n") - F.log1p(F.col("bn") / F.col("docs")))
    v = centred.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("b", "x"))).alias("m")).select(  # dims entries at most
        F.xxhash64("doc_id").alias("id"), "doc_id", F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0))).alias("v"))
    v = materialize(v, "chunkvectors")
    return vectors.near_duplicates(v, "id", "v", 0.85).join(v.select("id", "doc_id"), "id").select("doc_id", "copies", "links")
