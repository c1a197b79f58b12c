"""Queries of the text functions and chunkers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from legajo.functions import text as T
from legajo.operators import chunking as C
from legajo.plans.registry import query
from legajo.session import read, spread

TICKETS = "incidencias_soporte_q4_2024"


def _x(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return read(spark, d, "documents_x").select("doc_id", *cols)


def sql_fold(x: str) -> str:
    """fold() in DuckDB: accents by its own function, compatibility signs by translation."""
    for a, b in (("ß", "ss"), ("½", "1⁄2"), ("¼", "1⁄4"), ("¾", "3⁄4"), ("…", "..."), ("™", "tm")):
        x = f"replace({x}, '{a}', '{b}')"
    return f"trim(regexp_replace(strip_accents(translate(lower({x}), 'ªº²³¹µſ' || chr(160) || '‐‑ⅼ', 'ao231μs' || ' ' || '‐‐l')), '\\s+', ' ', 'g'))"


@query(f"select doc_id, md5({sql_fold('raw_text')}) as folded_md5, len({sql_fold('raw_text')})::int as n from documents_x")
def fold_text(spark: SparkSession, d: str) -> DataFrame:
    f = _x(spark, d, T.fold(F.col("raw_text")).alias("f"))
    return f.select("doc_id", F.md5(F.encode("f", "UTF-8")).alias("folded_md5"), F.char_length("f").alias("n"))


@query(f"""select row_id, array_to_string(regexp_extract_all({sql_fold('descripcion_breve')}, '([a-z]+|[0-9]+(?:[.,][0-9]+)*[kmb]?)', 1), ' ') as toks
       from {TICKETS} where descripcion_breve is not null""")
def text_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, TICKETS).filter("descripcion_breve is not null")
    return t.select("row_id", F.array_join(T.tokens(T.fold(F.col("descripcion_breve"))), " ").alias("toks"))


@query(f"""with t as (select row_id, unnest(regexp_extract_all({sql_fold('descripcion_breve')}, '([a-z]+|[0-9]+(?:[.,][0-9]+)*[kmb]?)', 1)) as tok from {TICKETS}),
       n as (select distinct tok from t where regexp_matches(tok, '[0-9]'))
       select tok, case when regexp_full_match(tok, '[0-9]{{1,3}}(?:[.,][0-9]{{3}})+') then regexp_replace(tok, '[.,]', '', 'g')
         when regexp_full_match(tok, '[0-9]+(?:[.,][0-9]+)?[kmb]') then cast(cast(round(cast(replace(regexp_replace(tok, '[kmb]$', ''), ',', '.') as double)
           * case right(tok, 1) when 'k' then 1000 when 'm' then 1000000 else 1000000000 end) as bigint) as varchar) else tok end as value from n""")
def number_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, TICKETS).select(F.explode(T.tokens(T.fold(F.col("descripcion_breve")))).alias("tok")).filter(F.col("tok").rlike("[0-9]")).distinct()
    return t.select("tok", T.number_value(F.col("tok")).alias("value"))


@query(f"""with s as (select row_id, regexp_replace({sql_fold('descripcion_breve')}, '[^a-z0-9]', '', 'g') as s from {TICKETS} where descripcion_breve is not null)
       select row_id, case when s = '' then '' when len(s) < 3 then s else array_to_string(list_transform(range(1, len(s) - 1), lambda i: substring(s, i, 3)), ' ') end as grams from s""")
def char3_ngrams(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, TICKETS).filter("descripcion_breve is not null")
    return t.select("row_id", F.array_join(T.char_ngrams(T.fold(F.col("descripcion_breve"))), " ").alias("grams"))


_CLEAN = "raw_text"
for _p, _r in (
    (r"[\p{Cf}\p{Co}\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", ""), (f"[{T.DASHES}]", " "), (r"https?://[^\s]+|www\.[^\s]+", " "), (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", " "),
    (r"\n{3,}", "\n\n"), (r"[ \t]{2,}", " "), (r"[ \t]+\n", "\n"), *((f"(?m){p}", "") for p in T.PAGE_MARKS), (r"^[\s\x0b]+|[\s\x0b]+$", ""),
):
    _CLEAN = f"regexp_replace({_CLEAN}, '{_p}', '{_r}', 'g')"


@query(f"select doc_id, md5({_CLEAN}) as clean_md5, len({_CLEAN})::int as n from documents_x")
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    c = spread(_x(spark, d, "raw_text")).select("doc_id", T.clean(F.col("raw_text")).alias("c"))
    return c.select("doc_id", F.md5(F.encode("c", "UTF-8")).alias("clean_md5"), F.char_length("c").alias("n"))


@query("select doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(raw_text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}'))), ' ') as emails from documents_x")
def extract_emails(spark: SparkSession, d: str) -> DataFrame:
    return _x(spark, d, F.array_join(T.emails(F.col("raw_text")), " ").alias("emails"))


_MAP = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in T.MONTHS.items()) + "}"


@query(rf"""
    with f as (select doc_id, unnest(regexp_extract_all(raw_text, '([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})(?:[^0-9]|$)', 1)) as x, 'iso' as k from documents_x
      union all select doc_id, unnest(regexp_extract_all(raw_text, '{T.DAY_SLASH}', 1)), 'dmy' from documents_x
      union all select doc_id, unnest(regexp_extract_all(raw_text, '{T.DAY_DASH}', 1)), 'dmy' from documents_x
      union all select doc_id, unnest(regexp_extract_all(raw_text, '{T.DAY_TEXT}', 1)), 'text' from documents_x
      union all select doc_id, unnest(regexp_extract_all(raw_text, '{T.MONTH_TEXT}', 1)), 'month' from documents_x
      union all select doc_id, unnest(regexp_extract_all(raw_text, '{T.YEAR}', 1)), 'year' from documents_x),
    v as (select distinct doc_id, case k
      when 'dmy' then right(x, 4) || '-' || lpad(regexp_extract(x, '^[0-9]+[/-]([0-9]+)', 1), 2, '0') || '-' || lpad(regexp_extract(x, '^([0-9]+)', 1), 2, '0')
      when 'text' then right(x, 4) || '-' || {_MAP}[lower(list_filter(regexp_extract_all(x, '[A-Za-z]+'), lambda w: lower(w) <> 'de')[1])] || '-' || lpad(regexp_extract(x, '^([0-9]+)', 1), 2, '0')
      when 'month' then right(x, 4) || '-' || {_MAP}[lower(regexp_extract(x, '^([A-Za-z]+)', 1))] else x end as v from f)
    select d.doc_id, coalesce(string_agg(v, ' ' order by v), '') as dates from documents_x d left join v using (doc_id) group by d.doc_id""")
def extract_dates(spark: SparkSession, d: str) -> DataFrame:
    return spread(_x(spark, d, "raw_text")).select("doc_id", F.array_join(T.dates(F.col("raw_text")), " ").alias("dates"))


@query(f"""select doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(raw_text, '{T.PERSON}', 1)))[1:20], '; ') as persons,
       array_to_string(list_sort(list_distinct(regexp_extract_all(raw_text, '{T.ORGANIZATION}', 1)))[1:15], '; ') as organizations from documents_x""")
def regex_entities(spark: SparkSession, d: str) -> DataFrame:
    """The first 20 persons and 15 organizations of a text by name, as in its SQL."""
    return _x(spark, d, F.array_join(F.slice(T.people(F.col("raw_text")), 1, 20), "; ").alias("persons"), F.array_join(F.slice(T.organizations(F.col("raw_text")), 1, 15), "; ").alias("organizations"))


@query()
def regex_entity_rows(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, entity_type, name): every person and organization of every text, a row each."""
    x = spread(_x(spark, d, "raw_text"))
    of = lambda kind, names: x.select("doc_id", F.lit(kind).alias("entity_type"), F.explode(names).alias("name"))
    return of("person", T.people(F.col("raw_text"))).unionByName(of("organization", T.organizations(F.col("raw_text"))))


def _name_rule(words: tuple[str, ...]) -> str:
    return " and ".join(f"contains(lower(filename), '{w}')" for w in words)


@query(f"""select doc_id, case {' '.join(f"when {_name_rule(w)} then '{k}'" for k, w in T.NAME_RULES)}
       {' '.join(f"when regexp_matches(lower(raw_text), '{p.replace('(?md)', '(?m)')}') then '{k}'" for k, p in T.TEXT_RULES)} else 'documento' end as doc_class from documents_x""")
def classify_documents(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents_x").select("doc_id", T.doc_class(F.col("filename"), F.col("raw_text")).alias("doc_class"))


@query("""select file_name, case when list_contains(c, 'id_ticket') then 'tickets' when list_contains(c, 'id_equipo') then 'inventario' when list_contains(c, 'vendedor') or list_contains(c, 'precio_unitario') then 'ventas' else 'tabla' end as table_class
       from (select file_name, list_transform(string_split_regex(min(raw_record), '[,;]'), lambda x: trim(lower(x), ' ' || chr(9) || chr(13) || '"' || chr(65279))) as c from raw_records where line_no = 1 group by file_name)""")
def delivery_classes(spark: SparkSession, d: str) -> DataFrame:
    """Class of each delivery by its header."""
    head = read(spark, d, "raw_records").filter("line_no = 1").groupBy("file_name").agg(F.min("raw_record").alias("h"))
    return head.select("file_name", T.table_class(F.split("h", "[,;]")).alias("table_class"))


_NO_TITLE = T.NO_TITLE.replace("'", "''")


@query(f"""with l as (select doc_id, list_filter(list_transform(string_split(raw_text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12))),
            lambda x: len(x) > 3 and not regexp_full_match(x, '[0-9]+') and not regexp_matches(x, '{_NO_TITLE}'))[1] as f, translate(regexp_replace(filename, '\\.[^.]*$', ''), '_-', '  ') as s from documents_x)
       select doc_id, case when len(f) < 120 then trim(regexp_replace(f, '^#+', '')) else array_to_string(list_transform(regexp_extract_all(lower(s), '\\p{{L}}+|[^\\p{{L}}]+'), lambda w: upper(w[1]) || w[2:]), '') end as title from l""")
def extract_title(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents_x").select("doc_id", T.title(F.col("raw_text"), F.col("filename")).alias("title"))


@query("""with s as (select doc_id, list_filter(list_transform(string_split_regex(substring(raw_text, 1, 3000), '[.!?]\\s+'), lambda s: trim(regexp_replace(s, '\\s+', ' ', 'g'))), lambda s: len(s) > 30) as l from documents_x),
       e as (select doc_id, unnest(l) as s, unnest(range(len(l))) as i from s),
       r as (select doc_id, s, -round(least(len(string_split(s, ' ')), 40) / 40.0 * case when len(string_split(s, ' ')) < 8 then 0.3 else 1.0 end::double + 1 / (1 + 0.3::double * i), 9) as k from e),
       b as (select *, row_number() over (partition by doc_id order by k, s) as rk from r)
       select d.doc_id, coalesce(string_agg(s, '. ' order by rk) filter (where rk <= 3), '') as summary from documents_x d left join b using (doc_id) group by d.doc_id""")
def summary_top3(spark: SparkSession, d: str) -> DataFrame:
    return _x(spark, d, T.summary(F.col("raw_text"), head=3000).alias("summary"))  # the head its SQL reads


@query()
def summary_whole(spark: SparkSession, d: str) -> DataFrame:
    """The three best sentences of the whole text."""
    return spread(_x(spark, d, "raw_text")).select("doc_id", T.summary(F.col("raw_text")).alias("summary"))


def _vote(k: str) -> str:
    return f"len(list_filter(w, lambda x: list_contains([{', '.join(repr(x) for x in T.FUNCTION_WORDS[k])}], x)))"


@query(f"""with w as (select doc_id, regexp_extract_all(lower(substring(raw_text, 1, 500)), '[a-zàèéíòóúçñ]+') as w from documents_x),
       v as (select doc_id, {_vote('es')} as es, {_vote('ca')} as ca, {_vote('en')} as en from w)
       select doc_id, case when es >= ca and es >= en then 'es' when ca >= en then 'ca' else 'en' end as detected from v""")
def detect_language(spark: SparkSession, d: str) -> DataFrame:
    return _x(spark, d, T.language(F.col("raw_text"), head=500).alias("detected"))  # the head its SQL reads


@query()
def language_whole(spark: SparkSession, d: str) -> DataFrame:
    """Language by a vote over the whole text."""
    return spread(_x(spark, d, "raw_text")).select("doc_id", T.language(F.col("raw_text")).alias("detected"))


@query("""with t as (select doc_id, regexp_extract_all(lower(text), '[a-záéíóúüñçàèòï]{4,}') as ts from documents),
       p as (select doc_id, term, count(*) as tf from (select doc_id, unnest(ts) as term from t) group by 1, 2),
       f as (select term, count(*) as df from p group by 1), n as (select count(*) as n from documents),
       s as (select doc_id, term, round(tf * ln(n.n / df), 6) as score from p join f using (term), n),
       r as (select *, row_number() over (partition by doc_id order by score desc, term) as rk from s)
       select doc_id, string_agg(term, ' ' order by rk) as keywords from r where rk <= 8 group by 1""")
def keywords_tfidf(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(read(spark, d, "documents").select("doc_id", "text"))
    terms = F.regexp_extract_all(F.lower("text"), F.lit("([a-záéíóúüñçàèòï]{4,})"), F.lit(1))
    p = docs.select("doc_id", F.explode(terms).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    f = p.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = docs.count()
    s = p.join(f, "term").withColumn("score", F.round(F.col("tf") * F.log(F.lit(n) / F.col("df")), 6))
    r = s.withColumn("rk", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "term"))).filter("rk <= 8")
    return r.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rk", "term"))), lambda x: x["term"]), " ").alias("keywords"))


@query(f"""with f as (select row_id, {sql_fold('descripcion_breve')} as f from {TICKETS} where descripcion_breve is not null)
       select row_id, len(regexp_replace(f, '[a-z0-9 ]', '', 'g')) / greatest(1, len(f)) >= 0.12 or len(list_filter(string_split(f, ' '), lambda t:
         (len(t) >= 9 and regexp_matches(t, '{'|'.join(3 * c for c in 'abcdefghijklmnopqrstuvwxyz')}')) or (len(t) >= 10 and regexp_matches(t, '[bcdfghjklmnpqrstvwxyz]{{6,}}'))
         or (len(t) >= 7 and regexp_matches(t, '[a-z]') and regexp_matches(t, '[0-9]') and len(regexp_replace(t, '[^0-9]', '', 'g')) <= 0.5 * len(t)))) > 0 as noisy,
         regexp_matches(f, '[0-9]') as numeric_signal from f""")
def noisy_queries(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, TICKETS).filter("descripcion_breve is not null")
    return t.select("row_id", T.noisy(F.col("descripcion_breve")).alias("noisy"), T.fold(F.col("descripcion_breve")).rlike("[0-9]").alias("numeric_signal"))


@query(f"""select coalesce(map {{{', '.join(f"'{k}': '{v}'" for k, v in T.CATEGORIES.items())}}}[doc_type], 'General') as category, count(*) as n from documents_x group by 1""")
def category_counts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents_x").groupBy(T.category(F.col("doc_type")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


_STEM = "lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(filename, '\\.[^.]*$', ''), '[^A-Za-z0-9_]', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g'))"


@query(f"select doc_id, case when regexp_matches({_STEM}, '^[0-9]') then 't_' || {_STEM} else {_STEM} end as table_name, substring(md5(filename), 1, 12) as file_id from documents_x")
def file_names(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents_x").select("doc_id", T.table_name(F.col("filename")).alias("table_name"), T.file_id(F.col("filename")).alias("file_id"))


_GRAMS = ["larevisiontecnica"[i : i + 3] for i in range(15)]


@query(f"""with w as (select doc_id, raw_text as t, lower(raw_text) as low, strip_accents(lower(raw_text)) as f from documents_x where coalesce(raw_text, '') <> ''),
       p as (select *, coalesce(list_min(list_filter([instr(low, 'revisión'), instr(low, 'técnica')], lambda x: x > 0)), list_min(list_filter([instr(f, 'revision'), instr(f, 'tecnica')], lambda x: x > 0)),
           list_filter([{', '.join(f"instr(f, '{g}')" for g in _GRAMS)}], lambda x: x > 0)[1], 1) as pos from w),
       c as (select doc_id, t, greatest(1, pos - 100) as st, least(len(t), pos + 199) as en from p)
       select doc_id, regexp_replace(regexp_replace(case when st > 1 then '...' else '' end || substring(t, st, en - st + 1) || case when en < len(t) then '...' else '' end, '(?i)(revisión)', '**\\1**', 'g'), '(?i)(técnica)', '**\\1**', 'g') as snippet from c
       union all select doc_id, '' from documents_x where coalesce(raw_text, '') = ''""")
def highlight_term(spark: SparkSession, d: str) -> DataFrame:
    """Snippets for a query of two accented words and a stop word, folded and 3-gram places included."""
    return spread(_x(spark, d, "raw_text")).select("doc_id", T.highlight(F.col("raw_text"), F.lit("la Revisión técnica")).alias("snippet"))


@query("""select distinct v as raw, case when regexp_full_match(v, '[0-9]{4}(-[0-9]{2}){0,2}') then v when regexp_full_match(v, '[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}') or regexp_full_match(v, '[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}')
         then right(v, 4) || '-' || lpad(regexp_extract(v, '^[0-9]+[/-]([0-9]+)', 1), 2, '0') || '-' || lpad(regexp_extract(v, '^([0-9]+)', 1), 2, '0') end as iso
       from (select trim(unnest(dates)) as v from documents_x union all select trim(unnest(regexp_extract_all(raw_text, '[0-9]+[-/][0-9]+[-/][0-9]+'))) from documents_x)""")
def stored_dates(spark: SparkSession, d: str) -> DataFrame:
    """Stored dates and everything in the texts that looks like one, as ISO where they are one of the five forms."""
    x = read(spark, d, "documents_x")
    raw = x.select(F.explode("dates").alias("v")).unionByName(x.select(F.explode(F.regexp_extract_all("raw_text", F.lit("([0-9]+[-/][0-9]+[-/][0-9]+)"), F.lit(1))).alias("v")))
    return raw.select(F.trim("v").alias("raw")).distinct().select("raw", T.iso_date(F.col("raw")).alias("iso"))


@query("""select doc_id, array_to_string(list_filter(list_transform(string_split(array_to_string(keywords, ' , '), ','), lambda x: trim(x)), lambda x: x <> ''), '|') as parts from documents_x""")
def split_lists(spark: SparkSession, d: str) -> DataFrame:
    """Keywords written as one text and split again."""
    return _x(spark, d, F.array_join(T.split_list(F.array_join("keywords", " , ")), "|").alias("parts"))


_QSTOP = "[" + ", ".join(f"'{w}'" for w in T.QUERY_STOP_WORDS) + "]"


@query(f"""select doc_id, array_to_string(list_filter(string_split_regex(trim(title), '\\s+'), lambda w: w <> '' and not list_contains({_QSTOP}, {sql_fold('w')})), ' ') as asked,
         coalesce(len(string_split_regex(trim(title), '\\s+')) between 2 and 4 and len(list_filter(string_split_regex(trim(title), '\\s+'), lambda w: w = '' or upper(w[1]) <> w[1] or lower(w[1]) = w[1] or upper(w) = w or list_contains([{', '.join(f"'{w}'" for w in T.QUESTION_WORDS)}], lower(w)))) = 0, false) as is_name
       from (select doc_id, title from documents_x where title is not null union all select doc_id, unnest(persons) from documents_x)""")
def query_tests(spark: SparkSession, d: str) -> DataFrame:
    """Titles and names taken as queries: without stop words, and whether they look like a name."""
    x = read(spark, d, "documents_x")
    q = x.filter("title is not null").select("doc_id", "title").unionByName(x.select("doc_id", F.explode("persons").alias("title")))
    return q.select("doc_id", F.array_join(T.query_words(F.col("title")), " ").alias("asked"), T.looks_like_name(F.col("title")).alias("is_name"))


@query("select coalesce(nullif(trim(category), ''), 'Sin categoría') as category, count(*) as n from documents_x group by 1")
def category_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Documents by stored category, those without one counted apart."""
    name = F.coalesce(F.nullif(F.trim("category"), F.lit("")), F.lit("Sin categoría"))
    return read(spark, d, "documents_x").groupBy(name.alias("category")).agg(F.count(F.lit(1)).alias("n"))


# --- chunkers: a type's chunker runs over all documents of that type


def _of(spark: SparkSession, d: str, kind: str) -> DataFrame:
    return read(spark, d, "documents_x").filter(F.col("doc_type") == kind).select("doc_id", F.col("raw_text").alias("text"))


def _cut(mark: str, kind: str) -> str:
    """Parts of a type's documents, cut before what the pattern matches (RE2 has no lookahead: a sentinel is put in first)."""
    return f"select doc_id, string_split(regexp_replace(raw_text, '\\n({mark})', chr(1) || '\\1', 'g'), chr(1)) as p from documents_x where doc_type = '{kind}'"


@query(f"""with p as ({_cut('[0-9]+[.][[:space:]]', 'acta_reunion')}), e as (select doc_id, p[1] as h, unnest(p) as x, unnest(range(len(p))) as i from p)
       select doc_id, i::int as chunk_index, case when i = 0 then trim(x) else '[Contexto: ' || substring(trim(h), 1, 200) || ']' || chr(10) || trim(x) end as text from e""")
def chunk_minutes(spark: SparkSession, d: str) -> DataFrame:
    return C.by_numbered_sections(_of(spark, d, "acta_reunion")).select("doc_id", "chunk_index", "text")


@query(r"""with p as (select doc_id, raw_text, list_filter(list_transform(string_split_regex(raw_text, '\n---+\n'), lambda x: trim(x)), lambda x: x <> '') as p from documents_x where doc_type = 'email')
       select doc_id, unnest(range(len(p)))::int as chunk_index, unnest(p) as text, 'micro' as level from p union all select doc_id, len(p)::int, trim(raw_text), 'macro' from p where len(p) > 1""")
def chunk_messages(spark: SparkSession, d: str) -> DataFrame:
    return C.by_messages(_of(spark, d, "email"))


@query(f"""with p as ({_cut('[0-9]{1,2}[.][[:space:]]', 'listado')}), e as (select doc_id, p[1] as h, unnest(p) as x, unnest(range(len(p))) as i from p)
       select doc_id, i::int as chunk_index, case when i = 0 then trim(x) else substring(trim(h), 1, 150) || chr(10) || trim(x) end as text, case when i = 0 then 'macro' else 'micro' end as level from e""")
def chunk_entries(spark: SparkSession, d: str) -> DataFrame:
    return C.by_entries(_of(spark, d, "listado"))


@query(f"""with p as ({_cut('(?:ARTÍCULO|CLÁUSULA|CAPÍTULO|Art[.])[[:space:]]', 'contrato')}),
       k as (select doc_id, list_filter(list_transform(p, lambda x: list_filter(string_split_regex(trim(x), '\\s+'), lambda w: w <> '')), lambda w: len(w) >= 10) as k from p where len(p) >= 3)
       select doc_id, unnest(range(len(k)))::int as chunk_index, unnest(list_transform(k, lambda w: array_to_string(w[1:512], ' '))) as text from k""")
def chunk_articles(spark: SparkSession, d: str) -> DataFrame:
    return C.by_articles(_of(spark, d, "contrato"), capped=True).select("doc_id", "chunk_index", "text")  # capped as in its SQL


@query()
def chunk_articles_whole(spark: SparkSession, d: str) -> DataFrame:
    """Articles with all their words, those above the limit in several chunks."""
    return C.by_articles(_of(spark, d, "contrato")).select("doc_id", "chunk_index", "text")


_HEAD = "regexp_replace({}, '\\n([A-ZÁÉÍÓÚÑ][A-ZÁÉÍÓÚÑ ]{{5,}}\\n)', chr(1) || '\\1', 'g')"


@query(f"""with m as (select doc_id, trim(raw_text) as whole, len(string_split_regex(trim(raw_text), '\\s+')) as n, string_split({_HEAD.format(_HEAD.format('raw_text'))}, chr(1)) as p from documents_x where doc_type = 'memo'),
       k as (select doc_id, case when n < 512 then [whole] else list_filter(list_transform(p, lambda x: trim(x)), lambda x: len(x) >= 20) end as k from m)
       select doc_id, unnest(range(len(k)))::int as chunk_index, unnest(k) as text, 'meso' as level from k""")
def chunk_memos(spark: SparkSession, d: str) -> DataFrame:
    return C.by_headings(_of(spark, d, "memo"))


@query()
def chunk_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return C.by_paragraphs(read(spark, d, "documents_x").select("doc_id", F.col("raw_text").alias("text")))


_COLS = ["id_ticket", "cliente", "prioridad", "categoria", "descripcion_breve", "estado"]
_ROW = "concat_ws(' | ', " + ", ".join(f"'{c}: ' || {c}" for c in _COLS) + ")"


@query(f"select row_id, {_ROW} as text from {TICKETS}")
def chunk_rows(spark: SparkSession, d: str) -> DataFrame:
    return C.rows_as_text(read(spark, d, TICKETS), _COLS).select("row_id", "text")


@query(f"""with r as (select *, trim(cliente) as grp, row_number() over (partition by trim(cliente) order by row_id) as rn from {TICKETS})
       select coalesce(grp, '') as grp, count(*) as n_rows, coalesce(grp, '') || ' (' || count(*) || ' registros)' || chr(10) || string_agg({_ROW}, chr(10) order by rn) filter (where rn <= 20) as text from r group by grp""")
def chunk_groups(spark: SparkSession, d: str) -> DataFrame:
    return C.groups_as_text(read(spark, d, TICKETS), "cliente", "row_id", _COLS)


@query(f"""with l as ({' union all '.join(f"select '{c}' as column_name, {c} as value from {TICKETS}" for c in ('cliente', 'prioridad', 'categoria', 'estado'))}),
       c as (select column_name, value, count(*) as n from l where value is not null group by 1, 2),
       r as (select *, count(*) over (partition by column_name) as n_distinct, row_number() over (partition by column_name order by n desc, value) as rk from c)
       select column_name, n_distinct, rk, value, n from r where rk <= 5""")
def table_summary(spark: SparkSession, d: str) -> DataFrame:
    return C.column_summary(read(spark, d, TICKETS), ["cliente", "prioridad", "categoria", "estado"])


@query("""select chunk_id, {p} as persons, {o} as organizations, {e} as emails from chunks""".format(**{
    k: f"array_to_string(list_filter(coalesce({c}, []), lambda x: contains(lower(text), lower(x))), '; ')" for k, c in (("p", "persons"), ("o", "organizations"), ("e", "emails"))}))
def chunk_mentions(spark: SparkSession, d: str) -> DataFrame:
    m = C.inherit_mentions(read(spark, d, "chunks"))
    return m.select("chunk_id", *(F.array_join(c, "; ").alias(c) for c in ("persons", "organizations", "emails")))
