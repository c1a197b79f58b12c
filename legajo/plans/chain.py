"""Queries of the lexical chain: tickets ask, chunks answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from legajo.functions import text as T
from legajo.operators import chain, passes
from legajo.plans.details import _CANON, TICKETS, _number_sql, number_stream
from legajo.plans.more import _STEM
from legajo.plans.registry import query
from legajo.plans.search import _STOP
from legajo.plans.texts import _QSTOP, sql_fold
from legajo.session import materialize, read

_WORD = r"regexp_extract_all({}, '\w+(?:\.?\w+)*')"
_KEPT = "list_filter({}, lambda t: len(t) > 1 and not list_contains(" + _STOP + ", t))"


def _analyzed(x: str) -> str:
    return _KEPT.format(_WORD.format(x))


def _weights(name: str, fields: dict[str, tuple[str, float]]) -> str:
    """(id, term, s) over several fields, as common tables."""
    rows = " union all ".join(f"select '{f}' as field, {b}::double as boost, chunk_id as id, {ts} as ts from chunks" for f, (ts, b) in fields.items())
    return f"""{name}f as ({rows}), {name}p as (select field, any_value(boost) as boost, id, term, count(*) as tf, any_value(l) as l from (select field, boost, id, len(ts) as l, unnest(ts) as term from {name}f) group by field, id, term),
        {name}s as (select field, count(*) as n, avg(l) as m from (select field, id, any_value(l) as l from {name}p group by field, id) group by field), {name}d as (select field, term, count(*) as df from {name}p group by field, term),
        {name} as (select id, term, sum(boost * (ln(n / (df + 1)) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / m))) as s from {name}p join {name}d using (field, term) join {name}s using (field) group by id, term)"""


def _every(name: str, weights: str, terms: str, pass_no: int) -> str:
    return f"""{name} as (select *, {pass_no} as pass_no from (select query, id, row_number() over (partition by query order by round(score, 9) desc, id) as place from
        (select query, id, sum(s) as score, count(*) as met from {terms} join {weights} using (term) group by query, id) join (select query, count(*) as k from {terms} group by query) using (query) where met = k) where place <= 20)"""


def _list(c: str) -> str:
    return f"array_to_string(coalesce({c}, []), ', ')"


_BOOST = chain.BOOSTS
_CHAIN = f"""with qs as (select row_id as query, descripcion_breve as text, {sql_fold('descripcion_breve')} as f from {TICKETS} where row_id % 50 = 0 and descripcion_breve is not null),
    q0 as (select query, text, f, list_filter(string_split_regex(f, '\\s+'), lambda w: w <> '' and not list_contains({_QSTOP}, w)) as words from qs), q1 as (select * from q0 where len(words) > 0),
    q as (select query, unnest(list_distinct({_analyzed("array_to_string(words, ' ')")})) as term from q1),
    {_weights('w', {'title': (_analyzed(sql_fold("coalesce(title, '')")), _BOOST['title']), 'content': (_analyzed(sql_fold("coalesce(text, '')")), _BOOST['content']), **{c: (_analyzed(sql_fold(_list(c))), _BOOST[c]) for c in ('keywords', 'persons', 'organizations')}})},
    {_every('b0', 'w', 'q', 0)},
    b1 as (select query, id, place, 1 as pass_no from (select query, id, row_number() over (partition by query order by round(sum(s), 9) desc, id) as place from q join w using (term) where query not in (select query from b0) group by query, id) where place <= 20),
    few as (select query, text, f from q1 where query not in (select query from (select query from b0 union all select query from b1) group by query having count(*) > 2)),
    {_number_sql('few', 'query', 'text', 'n')},
    na as (select id as query, string_agg(coalesce(v::varchar, {_CANON}), ' ' order by i) as a from nn group by id),
    nq as (select distinct query, unnest(string_split(a, ' ')) as term from na join few using (query) where regexp_matches(a, '[0-9]') or a <> f),
    cs as (select chunk_id, text from chunks),
    {_number_sql('cs', 'chunk_id', 'text', 'c')},
    cw as (select a.id, a.i, a.tok, a.v, case when j.joins then [j.t[j.i], j.t[j.i + 1], j.t[j.i + 2]] else [a.tok] end as words from cn a join cj j on j.id = a.id and j.i = a.i),
    cl as (select id, list_concat(words, case when v is not null then [v::varchar] when {_CANON} <> tok then [{_CANON}] else [] end) as ts from cw),
    cp as (select id, term, count(*) as tf from (select id, unnest(ts) as term from cl) group by id, term), ce as (select id, sum(tf) as l from cp group by id),
    cv as (select cp.id, term, (ln((select count(*) from ce) / (df + 1)) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / (select avg(l) from ce))) as s from cp join (select term, count(*) as df from cp group by term) using (term) join ce on ce.id = cp.id),
    {_every('b2', 'cv', 'nq', 2)},
    nz as (select query, regexp_replace(f, '[^a-z0-9]', '', 'g') as z from q1 where len(regexp_replace(f, '[a-z0-9 ]', '', 'g')) / greatest(1, len(f)) >= 0.12 or len(list_filter(string_split(f, ' '), lambda t:
         (len(t) >= 9 and regexp_matches(t, '{'|'.join(3 * c for c in 'abcdefghijklmnopqrstuvwxyz')}')) or (len(t) >= 10 and regexp_matches(t, '[bcdfghjklmnpqrstvwxyz]{{6,}}'))
         or (len(t) >= 7 and regexp_matches(t, '[a-z]') and regexp_matches(t, '[0-9]') and len(regexp_replace(t, '[^0-9]', '', 'g')) <= 0.5 * len(t)))) > 0),
    ng as (select distinct query, case when len(z) < 3 then z else substring(z, i, 3) end as gram from nz, unnest(range(1, greatest(2, len(z) - 1))) as r(i) where z <> ''),
    cz as (select chunk_id, regexp_replace({sql_fold('text')}, '[^a-z0-9]', '', 'g') as z from chunks), cg as (select distinct chunk_id as id, substring(z, i, 3) as gram from cz, unnest(range(1, len(z) - 1)) as r(i)),
    b3 as (select query, id, place, 3 as pass_no from (select query, id, row_number() over (partition by query order by round(met / k, 9) desc, id) as place from (select query, id, count(*) as met from ng join cg using (gram) group by query, id) join (select query, count(*) as k from ng group by query) using (query) where met / k >= 0.4) where place <= 20),
    sq as (select distinct query, {_STEM.replace('(t,', '(term,')} as term from q),
    {_weights('sw', {'content': (f"list_transform({_analyzed(sql_fold('text'))}, lambda t: {_STEM})", 1.0)})},
    {_every('b4', 'sw', 'sq', 4)},
    h as (select * from b0 union all by name select * from b1 union all by name select * from b2 union all by name select * from b3 union all by name select * from b4),
    g as (select query, id, min((pass_no * 1000 + place)) as pos from h group by query, id), r as (select query, id, pos // 1000 as pass_no, row_number() over (partition by query order by pos, id) as rank from g)
    select query, id, pass_no::bigint as pass_no, rank from r where rank <= 20"""


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, TICKETS).filter("row_id % 50 = 0").select(F.col("row_id").alias("query"), F.col("descripcion_breve").alias("text"))


def _numbers(keep: bool):
    return number_stream(T.fold(F.col("text")), keep=keep)


@query(_CHAIN)
def lexical_chain(spark: SparkSession, d: str) -> DataFrame:
    """Every ticket whose id is divisible by 50 asks with its description; five passes over the chunks, 20 hits a query."""
    return chain.search(read(spark, d, "chunks"), _asked(spark, d), _numbers(True), _numbers(False))


def _synonyms(spark: SparkSession, d: str) -> DataFrame:
    return passes.synonyms(materialize(passes.word_vectors(read(spark, d, "documents"), "text"), "words"), k=4).select("word", "synonym")


@query()
def lexical_chain_synonyms(spark: SparkSession, d: str) -> DataFrame:
    """The same with synonyms from the corpus: 0.35 of their weight beside all words, whole beside any word."""
    return chain.search(read(spark, d, "chunks"), _asked(spark, d), _numbers(True), _numbers(False), synonyms=materialize(_synonyms(spark, d), "synonyms"))


@query()
def query_expansion(spark: SparkSession, d: str) -> DataFrame:
    """(query, expanded): each asking ticket's description with up to four synonyms of each of its words of four letters or more, each added once, in the order of the words."""
    words = _asked(spark, d).filter("text is not null").select("query", "text", F.posexplode(F.regexp_extract_all(T.fold(F.col("text")), F.lit("([a-z]{4,})"), F.lit(1))).alias("at", "word"))
    v = passes.synonyms(materialize(passes.word_vectors(read(spark, d, "documents"), "text"), "words"), k=4)
    new = words.join(v, "word").groupBy("query", "synonym").agg(F.min(F.struct("at", "rank")).alias("first"))
    new = new.join(words.select("query", F.col("word").alias("synonym")), ["query", "synonym"], "left_anti")
    extra = new.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("first", "synonym"))).alias("s"))  # four a word of one short text
    return _asked(spark, d).filter("text is not null").join(extra, "query", "left").select("query", F.concat_ws(" ", "text", F.array_join("s.synonym", " ")).alias("expanded"))
