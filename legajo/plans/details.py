"""Queries of views and small functions: number words, filters, graph views, facet values, formats, JSON."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from legajo.functions import text as T
from legajo.operators import fusion
from legajo.operators import graph as G
from legajo.plans.graphs import _EDGES, _MENTIONS, _NODES
from legajo.plans.registry import query
from legajo.plans.texts import sql_fold
from legajo.session import read
from legajo.streaming.jobs import add_edges

TICKETS = "incidencias_soporte_q4_2024"
#: Number words of Spanish and of Catalan (folded) with their values, fixed values; "y" or "i" joins tens and units.
WORDS_ES = {
    "cero": 0, "un": 1, "uno": 1, "una": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9, "diez": 10, "once": 11, "doce": 12, "trece": 13, "catorce": 14, "quince": 15,
    "dieciseis": 16, "diecisiete": 17, "dieciocho": 18, "diecinueve": 19, "veinte": 20, "treinta": 30, "cuarenta": 40, "cincuenta": 50, "sesenta": 60, "setenta": 70, "ochenta": 80, "noventa": 90, "cien": 100,
}
WORDS_CA = {
    "zero": 0, "un": 1, "u": 1, "una": 1, "dos": 2, "tres": 3, "quatre": 4, "cinc": 5, "sis": 6, "set": 7, "vuit": 8, "nou": 9, "deu": 10, "onze": 11, "dotze": 12, "tretze": 13, "catorze": 14, "quinze": 15,
    "setze": 16, "disset": 17, "divuit": 18, "dinou": 19, "vint": 20, "trenta": 30, "quaranta": 40, "cinquanta": 50, "seixanta": 60, "setanta": 70, "vuitanta": 80, "noranta": 90, "cent": 100,
}
_BOTH = WORDS_ES | WORDS_CA


def _lookup(lang: Column, pick: Callable[[int], bool], word: Column) -> Column:
    """The value of a number word in its language (es or ca, else either), where pick takes the value."""
    of = lambda words: F.element_at(F.create_map(*(F.lit(x) for k, v in words.items() if pick(v) for x in (k, v))), F.coalesce(word, F.lit("")))
    return F.when(F.startswith(lang, F.lit("es")), of(WORDS_ES)).when(F.startswith(lang, F.lit("ca")), of(WORDS_CA)).otherwise(of(_BOTH))


def number_stream(folded: Column, lang: Column | None = None, keep: bool = False) -> Column:
    """The tokens of a folded text with number words and number spellings as digits, in order; with keep, what stood there goes before the digits.

    Tens take a following 'y' or 'i' and a unit with them. Null gives null.
    """
    lang = F.lower(F.coalesce(lang, F.lit(""))) if lang is not None else F.lit("")
    toks = T.tokens(folded)
    value, tens, unit = lambda w: _lookup(lang, lambda v: True, w), lambda w: _lookup(lang, lambda v: v >= 20 and v < 100 and v % 10 == 0, w), lambda w: _lookup(lang, lambda v: v < 10, w)
    at = lambda ts, i: F.get(ts, i)
    joins = lambda ts, i: tens(at(ts, i)).isNotNull() & at(ts, i + 1).isin("y", "i") & unit(at(ts, i + 2)).isNotNull()

    def step(ts: Column, i: Column) -> Column:
        taken = F.coalesce(joins(ts, i - 1), F.lit(False)) | F.coalesce(joins(ts, i - 2), F.lit(False))
        t, v = at(ts, i), value(at(ts, i))
        pair = F.coalesce(joins(ts, i), F.lit(False))
        number = F.when(pair, v + unit(at(ts, i + 2))).otherwise(v).cast("string")
        words = F.when(pair, F.slice(ts, i + 1, 3)).otherwise(F.array(t))
        canon = T.number_value(t)
        if keep:
            return F.when(taken, F.array().cast("array<string>")).when(v.isNotNull(), F.array_append(words, number)).when(canon != t, F.array(t, canon)).otherwise(F.array(t))
        return F.when(taken, F.array().cast("array<string>")).when(v.isNotNull(), F.array(number)).otherwise(F.array(canon))

    # An array of one keeps the tokens from being computed anew for each use.
    return F.flatten(F.flatten(F.transform(F.array(toks), lambda ts: F.transform(F.sequence(F.lit(0), F.greatest(F.size(ts) - 1, F.lit(0))), lambda i: F.when(i < F.size(ts), step(ts, i)).otherwise(F.array().cast("array<string>"))))))


def _sql_map(pick: Callable[[int], bool]) -> str:
    return "map {" + ", ".join(f"'{k}': {v}" for k, v in _BOTH.items() if pick(v)) + "}"


_V, _T, _U = _sql_map(lambda v: True), _sql_map(lambda v: v >= 20 and v < 100 and v % 10 == 0), _sql_map(lambda v: v < 10)
_CANON = """case when regexp_full_match(tok, '[0-9]{1,3}(?:[.,][0-9]{3})+') then regexp_replace(tok, '[.,]', '', 'g') when regexp_full_match(tok, '[0-9]+(?:[.,][0-9]+)?[kmb]')
    then cast(cast(round(cast(replace(regexp_replace(tok, '[kmb]$', ''), ',', '.') as double) * case right(tok, 1) when 'k' then 1000 when 'm' then 1000000 else 1000000000 end) as bigint) as varchar) else tok end"""


def _number_sql(source: str, idc: str, textc: str, pre: str = "") -> str:
    """A row for each token that is left, with its place: words joined to tens are gone. pre goes before the names of the common tables."""
    return f"""{pre}t as (select {idc} as id, regexp_extract_all({sql_fold(textc)}, '([a-z]+|[0-9]+(?:[.,][0-9]+)*[kmb]?)', 1) as t from {source} where {textc} is not null), {pre}x as (select id, t, i, t[i] as tok from {pre}t, unnest(range(1, len(t) + 1)) as r(i)),
        {pre}j as (select *, {_T}[tok] is not null and coalesce(t[i + 1] in ('y', 'i'), false) and {_U}[coalesce(t[i + 2], '')] is not null as joins from {pre}x),
        {pre}n as (select id, i, tok, case when joins then {_V}[tok] + {_U}[t[i + 2]] else {_V}[tok] end as v from {pre}j a where not exists (select 1 from {pre}j b where b.id = a.id and b.joins and b.i in (a.i - 1, a.i - 2)))"""


@query(f"with {_number_sql('documents', 'doc_id', 'text')} select id as doc_id, string_agg(v::varchar, ' ' order by i) as numbers from n where v is not null group by id")
def number_words(spark: SparkSession, d: str) -> DataFrame:
    """The numbers that a document writes in words, in order."""
    x = read(spark, d, "documents").select("doc_id", F.explode(F.array(number_stream(T.fold(F.col("text")), keep=True))).alias("s"))
    is_word = lambda w: F.coalesce(_lookup(F.lit(""), lambda v: True, w), F.lit(-1)) >= 0
    values = F.filter(F.transform("s", lambda t, i: F.when(t.rlike("^[0-9]+$") & (i > 0) & is_word(F.get("s", i - 1)), t)), lambda t: t.isNotNull())
    return x.select("doc_id", values.alias("v")).filter("size(v) > 0").select("doc_id", F.array_join("v", " ").alias("numbers"))


@query(f"with {_number_sql(TICKETS, 'row_id', 'descripcion_breve')} select id as row_id, string_agg(coalesce(v::varchar, {_CANON}), ' ' order by i) as stream from n group by id")
def number_streams(spark: SparkSession, d: str) -> DataFrame:
    """Ticket descriptions with every number as digits, the form that the numeric pass searches."""
    x = read(spark, d, TICKETS).filter("descripcion_breve is not null").select("row_id", number_stream(T.fold(F.col("descripcion_breve"))).alias("s"))
    return x.filter("size(s) > 0").select("row_id", F.array_join("s", " ").alias("stream"))


@query("""select doc_id from documents_x where coalesce(title, '') ilike '%ACTA%' or filename ilike '%acta%' or coalesce(doc_type, '') ilike '%acta%' or coalesce(category, '') ilike '%acta%'""")
def quick_filter(spark: SparkSession, d: str) -> DataFrame:
    hit = reduce(lambda a, b: a | b, (F.coalesce(F.col(c), F.lit("")).ilike("%acta%") for c in ("title", "filename", "doc_type", "category")))
    return read(spark, d, "documents_x").filter(hit).select("doc_id")


@query(f"""with {_MENTIONS.replace('from documents_x', "from documents_x where doc_type = 'contrato'")}, {_NODES}, {_EDGES}, g as (select src as key, count(*) as degree from w group by src)
       select n.key, n.entity_type, greatest(n.mentions, 1) as size, coalesce(degree, 0) as degree from n left join g on g.key = n.key""")
def graph_view(spark: SparkSession, d: str) -> DataFrame:
    """The graph of one document type, each node with its size and degree."""
    m = G.mentions(read(spark, d, "documents_x").filter("doc_type = 'contrato'"))
    return G.nodes(m).join(G.degrees(G.edges(m)), "key", "left").select("key", "entity_type", F.greatest("mentions", F.lit(1)).alias("size"), F.coalesce("degree", F.lit(0)).alias("degree"))


@query(f"""with {_MENTIONS}, {_NODES}, f as (select key, round(1 + 0.01 * mentions, 2)::double as score from n where contains(key, 'silv')) select key, score from f order by score desc, key limit 25""")
def entity_search(spark: SparkSession, d: str) -> DataFrame:
    n = G.nodes(G.mentions(read(spark, d, "documents_x"))).filter(F.contains("key", F.lit("silv")))
    return n.select("key", F.round(1 + 0.01 * F.col("mentions"), 2).alias("score")).orderBy(F.desc("score"), "key").limit(25)


@query(f"""with {_MENTIONS}, {_NODES}, {_EDGES}, near as (select *, row_number() over (partition by src order by weight desc, dst) as rk from w),
       p as (select src, string_agg(dst || ' (' || weight || ')', '; ' order by rk) as related from near where rk <= 8 group by src)
       select n.key, n.mentions, n.n_docs, coalesce(p.related, '') as related from n left join p on p.src = n.key""")
def entity_profiles(spark: SparkSession, d: str) -> DataFrame:
    m = G.mentions(read(spark, d, "documents_x"))
    top = G.related(G.edges(m), 8).groupBy("src").agg(F.sort_array(F.collect_list(F.struct("rk", F.concat("dst", F.lit(" ("), F.col("weight").cast("string"), F.lit(")")).alias("t")))).alias("r"))  # eight at most
    n = G.nodes(m)
    return n.join(top, n.key == top.src, "left").select("key", "mentions", "n_docs", F.coalesce(F.array_join("r.t", "; "), F.lit("")).alias("related"))


@query(f"""with {_MENTIONS}, {_EDGES}, s as (select a.key as src, b.key as dst, a.doc_id from dk a join dk b on a.doc_id = b.doc_id and a.key < b.key)
       select src, dst, doc_id, weight from s join e using (src, dst)""")
def shared_documents(spark: SparkSession, d: str) -> DataFrame:
    """The documents that two entities share, a row each, with the number of them; every pair, however many."""
    k = G.mentions(read(spark, d, "documents_x")).select("doc_id", "key").distinct()
    pairs = k.select("doc_id", F.col("key").alias("src")).join(k.select("doc_id", F.col("key").alias("dst")), "doc_id").filter("src < dst")
    return pairs.join(pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight")), ["src", "dst"])


@query(f"with {_MENTIONS}, dk as (select distinct doc_id, key from m) select a.key as src, b.key as dst, a.doc_id from dk a join dk b on a.doc_id = b.doc_id and a.key < b.key")
def shared_document_rows(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst, doc_id): every document of every pair of entities that share one, a row each."""
    k = G.mentions(read(spark, d, "documents_x")).select("doc_id", "key").distinct()
    return k.select("doc_id", F.col("key").alias("src")).join(k.select("doc_id", F.col("key").alias("dst")), "doc_id").filter("src < dst").select("src", "dst", "doc_id")


@query(f"with {_MENTIONS}, {_EDGES} select src, dst, weight from e")
def graph_added(spark: SparkSession, d: str) -> DataFrame:
    """The graph of one half of the documents with the other half's added: the same as that of all."""
    docs = read(spark, d, "documents_x")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    return add_edges(G.edges(G.mentions(docs.filter(half))), G.edges(G.mentions(docs.filter(~half))))


@query("""select facet, string_agg(value, '; ' order by value) as shown from (select distinct 'doc_type' as facet, doc_type as value from documents_x union select 'language', language from documents_x union select 'category', category from documents_x)
       where value is not null group by facet union all select 'dates', string_agg(v, '; ' order by v desc) from (select distinct substring(unnest(dates), 1, 7) as v from documents_x)""")
def facet_values(spark: SparkSession, d: str) -> DataFrame:
    """The distinct values of each facet in order; months the newest first."""
    docs = read(spark, d, "documents_x")
    long = docs.select(F.explode(F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in ("doc_type", "language", "category")))).alias("x")).select("x.*")
    months = docs.select(F.lit("dates").alias("facet"), F.explode("dates").alias("value")).withColumn("value", F.substring("value", 1, 7))
    lists = long.unionByName(months).filter("value is not null").distinct().groupBy("facet").agg(F.array_sort(F.collect_list("value")).alias("l"))  # a facet's few values
    return lists.select("facet", F.array_join(F.when(F.col("facet") == "dates", F.reverse("l")).otherwise(F.col("l")), "; ").alias("shown"))


@query("""with c as (select doc_type as value, count(*) as n from documents_x where language = 'en' group by 1), a as (select * from c where value is not null union all select 'nomina', 0 where not exists (select 1 from c where value = 'nomina'))
       select value, n, (value = 'nomina') as active from a""")
def active_facet(spark: SparkSession, d: str) -> DataFrame:
    """Counts of a facet with the active value kept, at 0 where no document has it."""
    docs = read(spark, d, "documents_x").filter("language = 'en'")
    c = fusion.facet_counts(docs, {"t": ("doc_type", False, 1000)}).select("value", "n")
    kept = spark.range(1).select(F.lit("nomina").alias("value"), F.lit(0).cast("long").alias("n")).join(c.select("value"), "value", "left_anti")
    return c.unionByName(kept).withColumn("active", F.col("value") == "nomina")


@query("select doc_id, row_number() over (order by coalesce(title, filename), doc_id) as place from documents_x order by place limit 100")
def browse_order(spark: SparkSession, d: str) -> DataFrame:
    """The first page of the browser: 100 documents by title, else file name."""
    page = read(spark, d, "documents_x").select("doc_id", F.coalesce("title", "filename").alias("t")).orderBy("t", "doc_id").limit(100)
    return page.select("doc_id", F.row_number().over(Window.orderBy("t", "doc_id")).cast("long").alias("place"))  # one page


@query("select doc_id, strftime(created_at, '%Y-%m-%d') as day, source from documents order by created_at desc, doc_id desc limit 8")
def recent_documents(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").orderBy(F.desc("created_at"), F.desc("doc_id")).limit(8).select("doc_id", F.date_format("created_at", "yyyy-MM-dd").alias("day"), "source")


@query("""with k as (select doc_id, unnest(keywords) as k, regexp_extract_all(lower(coalesce(title, '')), '[a-záéíóúüñ]{4,}') as ts from documents_x), p as (select distinct doc_id, lower(k) as k, unnest(ts) as t from k)
       select doc_id, k, t, (k = t or contains(k, t) or contains(t, k) or left(k, greatest(4, least(len(k), len(t)) - 2)) = left(t, greatest(4, least(len(k), len(t)) - 2)))  as variant from p""")
def morph_variants(spark: SparkSession, d: str) -> DataFrame:
    """Whether each keyword of a document and each word of its title are forms of one word."""
    words = F.regexp_extract_all(F.lower(F.coalesce("title", F.lit(""))), F.lit("([a-záéíóúüñ]{4,})"), F.lit(1))
    p = read(spark, d, "documents_x").select("doc_id", words.alias("ts"), F.explode("keywords").alias("k")).select("doc_id", F.lower("k").alias("k"), F.explode("ts").alias("t")).distinct()
    n = F.greatest(F.lit(4), F.least(F.char_length("k"), F.char_length("t")) - 2)
    same = (F.col("k") == F.col("t")) | F.contains("k", F.col("t")) | F.contains("t", F.col("k")) | (F.substring("k", F.lit(1), n) == F.substring("t", F.lit(1), n))
    return p.withColumn("variant", same)


@query(f"""with {_MENTIONS}, {_NODES}, j as (select json_object('key', key, 'mentions', mentions, 'type', entity_type) as j from n)
       select j->>'$.key' as key, cast(j->>'$.mentions' as bigint) as mentions, j->>'$.type' as entity_type from j""")
def json_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Graph nodes written as JSON documents and read back."""
    n = G.nodes(G.mentions(read(spark, d, "documents_x"))).select(F.to_json(F.struct("key", "mentions", F.col("entity_type").alias("type"))).alias("j"))
    return n.select(F.from_json("j", "key string, mentions long, type string").alias("x")).select("x.key", "x.mentions", F.col("x.type").alias("entity_type"))


@query(f"""with {_MENTIONS}, {_NODES}, {_EDGES}, j as (select json_object('src', src, 'dst', dst, 'weight', weight) as j from e), b as (select j->>'$.src' as src, j->>'$.dst' as dst, cast(j->>'$.weight' as bigint) as weight from j),
       g as (select key, count(*) as degree, sum(weight)::bigint as strength from (select src as key, weight from b union all select dst, weight from b) group by key)
       select n.key, n.mentions, coalesce(degree, 0) as degree, coalesce(strength, 0) as strength from n left join g using (key)""")
def json_graph(spark: SparkSession, d: str) -> DataFrame:
    """The graph written as JSON and read back: nodes and edges, degree and strength filled in from the edges."""
    m = G.mentions(read(spark, d, "documents_x"))
    e = G.edges(m).select(F.to_json(F.struct("src", "dst", "weight")).alias("j")).select(F.from_json("j", "src string, dst string, weight long").alias("x")).select("x.*")
    n = G.nodes(m).select(F.to_json(F.struct("key", "mentions")).alias("j")).select(F.from_json("j", "key string, mentions long").alias("x")).select("x.*")
    return n.join(G.degrees(e), "key", "left").na.fill(0, ["degree", "strength"])


_TABLES = ("documents_x", "chunks", TICKETS, "inventario_equipos_it", "documents", "orders")


@query(" union all ".join(f"select '{t}' as table_name, count(*) as n, count(*) > 200 as truncated from {t}" for t in _TABLES))
def table_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each table, and whether a result capped at 200 rows would leave some out."""
    parts = (read(spark, d, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("table_name"), "n", (F.col("n") > 200).alias("truncated")) for t in _TABLES)
    return reduce(DataFrame.unionByName, parts)


@query("select table_name, string_agg(column_name, ', ' order by column_name) as columns, count(*) as n_columns from information_schema.columns where table_name in (" + ", ".join(f"'{t}'" for t in _TABLES) + ") group by table_name")
def table_columns(spark: SparkSession, d: str) -> DataFrame:
    """The columns of each table, from the tables' schemas."""
    parts = (read(spark, d, t).limit(0).agg(F.count(F.lit(1))).select(F.lit(t).alias("table_name"), F.lit(", ".join(sorted(read(spark, d, t).columns))).alias("columns"), F.lit(len(read(spark, d, t).columns)).cast("long").alias("n_columns")) for t in _TABLES)
    return reduce(DataFrame.unionByName, parts)


@query("""with x as (select unnest(dates) as v from chunks), m as (select substring(v, 1, 7) as ym from x where len(v) >= 7)
       select ym, count(*) as n, ['enero', 'febrero', 'marzo', 'abril', 'mayo', 'junio', 'julio', 'agosto', 'septiembre', 'octubre', 'noviembre', 'diciembre'][substring(ym, 6, 2)::int] || ' ' || substring(ym, 1, 4) as shown from m
       where regexp_full_match(ym, '[0-9]{4}-(0[1-9]|1[0-2])') group by ym""")
def date_facet(spark: SparkSession, d: str) -> DataFrame:
    """Months among the chunks' dates with the name they are shown by."""
    x = read(spark, d, "chunks").select(F.explode("dates").alias("v")).filter("char_length(v) >= 7").select(F.substring("v", 1, 7).alias("ym")).filter(F.col("ym").rlike("^[0-9]{4}-(0[1-9]|1[0-2])$"))
    name = F.get(F.array(*map(F.lit, T.MONTH_NAMES)), F.substring("ym", 6, 2).cast("int") - 1)
    return x.groupBy("ym").agg(F.count(F.lit(1)).alias("n")).withColumn("shown", F.concat_ws(" ", name, F.substring("ym", 1, 4)))


@query(f"""select id_equipo, string_agg(departamento, ', ' order by row_id) as departments from (select row_id, id_equipo, trim(departamento) as departamento, row_number() over (partition by id_equipo order by row_id) as rk from inventario_equipos_it where departamento is not null)
       where rk <= 3 group by id_equipo""")
def sliced_lists(spark: SparkSession, d: str) -> DataFrame:
    """The first three departments of each piece of equipment."""
    t = read(spark, d, "inventario_equipos_it").filter("departamento is not null").withColumn("rk", F.row_number().over(Window.partitionBy("id_equipo").orderBy("row_id"))).filter("rk <= 3")
    return t.groupBy("id_equipo").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rk", F.trim("departamento").alias("v")))), lambda x: x["v"]), ", ").alias("departments"))
