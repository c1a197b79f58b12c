"""SQL over the tables: views, a dialect shim, limits, and the relational showcase."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from legajo.plans.registry import query
from legajo.session import read

TICKETS = "incidencias_soporte_q4_2024"
MAX_ROWS = 200
_READ_ONLY = re.compile(r"^\s*(?:with|select|from|values|table|\()", re.I)


def register_views(spark: SparkSession, d: str, only_in: str | None = None) -> list[str]:
    """Temporary views of the tables in a folder, named after their files; of those that a text names, where one is given."""
    names = sorted(f[: -len(".parquet")] for f in os.listdir(d) if f.endswith(".parquet"))
    names = [n for n in names if only_in is None or re.search(rf"\b{n}\b", only_in)]
    for n in names:
        read(spark, d, n).createOrReplaceTempView(n)
    return names


_LITERAL = re.compile(r"('(?:[^']|'')*')")


def translate(sql: str) -> str:
    """Common DuckDB spellings in Spark's: date_diff with a quoted unit, double-quoted names, list and string functions. Text inside string literals stays as it is."""
    parts = _LITERAL.split(sql)  # code and literals by turns
    for i in range(0, len(parts), 2):
        code = re.sub(r'"([A-Za-z_][\w ]*)"', r"`\1`", parts[i])
        for a, b in (("string_split", "split"), ("list_contains", "array_contains"), ("len", "char_length"), ("unnest", "explode"), ("string_agg", "listagg")):
            code = re.sub(rf"\b{a}\(", f"{b}(", code, flags=re.I)
        if re.search(r"(?i)\bdate_diff\(\s*$", code) and i + 1 < len(parts):
            parts[i + 1] = parts[i + 1].strip("'").upper()
        parts[i] = code
    return "".join(parts)


def run_sql(spark: SparkSession, sql: str, most: int | None = MAX_ROWS) -> tuple[DataFrame, bool]:
    """(rows, truncated) of a query; statements that are no query are refused with ValueError. most=None runs without a cap."""
    sql = translate(sql).strip().rstrip(";")
    if not _READ_ONLY.match(sql):
        raise ValueError("only queries are run")
    df = spark.sql(sql)
    if most is None:
        return df, False
    return df.limit(most), len(df.limit(most + 1).take(most + 1)) > most


def ask_count(sql: str, question: str) -> str:
    """Add COUNT(*) AS total to a grouped query whose question asks how many and that does not count yet."""
    wants = re.search(r"(?i)\bcu[aá]nt[oa]s?\b|\bn[uú]mero\b|\btotal de\b|\bconteo\b|\bhow many\b|\bcount\b", question)
    if wants and re.search(r"(?i)\bgroup\s+by\b", sql) and not re.search(r"(?i)\bcount\s*\(", sql):
        return re.sub(r"(?i)^(\s*select\s+)", r"\1COUNT(*) AS total, ", sql, count=1)
    return sql


def _same(sql: str):
    """A query that both engines run as it stands, through the dialect shim."""

    def put(f):
        def g(spark: SparkSession, d: str) -> DataFrame:
            register_views(spark, d, sql)
            return run_sql(spark, sql, None)[0]

        g.__name__, g.__doc__ = f.__name__, f.__doc__
        return query(sql)(g)

    return put


@_same(f"""select coalesce(categoria, '(todas)') as categoria, coalesce(prioridad, '(todas)') as prioridad, cast(grouping(categoria) as int) as g1, cast(grouping(prioridad) as int) as g2, count(*) as n
       from (select coalesce(categoria, 'sin') as categoria, prioridad from {TICKETS}) t group by rollup (categoria, prioridad)""")
def sql_rollup(): ...


@_same("select l_returnflag, l_linestatus, count(*) as n, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem group by grouping sets ((l_returnflag, l_linestatus), (l_returnflag), ())")
def sql_grouping_sets(): ...


@_same(f"""select id_ticket, row_id, estado, cast(rn as bigint) as rn from (select *, row_number() over (partition by id_ticket order by ingested_at desc, row_id desc) as rn from {TICKETS}) t where rn = 1""")
def sql_latest_state():
    """The last delivered state of each ticket."""


@_same("""select o_custkey, o_orderkey, o_totalprice, round(sum(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey rows between 2 preceding and current row), 2) as last3,
       lag(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as before, cast(dense_rank() over (partition by o_custkey order by o_totalprice desc) as bigint) as dr from orders""")
def sql_windows(): ...


@_same(f"select cliente from (select trim(cliente) as cliente from {TICKETS} where prioridad = 'alta' intersect select trim(cliente) from {TICKETS} where estado = 'escalado' except select trim(cliente) from {TICKETS} where categoria = 'zz') t")
def sql_setops(): ...


@_same("select c_mktsegment, n_name, count(*) as orders, round(sum(o_totalprice), 2) as total from customer join orders on o_custkey = c_custkey join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey group by c_mktsegment, n_name")
def sql_star_join(): ...


@_same("""select 'left' as kind, n_name, cast(count(s_suppkey) as bigint) as n from nation left join supplier on s_nationkey = n_nationkey and s_acctbal > 5000 group by n_name
       union all select 'full', coalesce(n_name, 'none'), count(*) from (select n_nationkey, n_name from nation where n_regionkey < 3) n full join (select s_nationkey from supplier where s_acctbal < 0) s on s_nationkey = n_nationkey group by coalesce(n_name, 'none')
       union all select 'cross', r_name, count(*) from region cross join (select distinct o_orderstatus from orders) o group by r_name""")
def sql_outer_joins(): ...


@_same("select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 400000)")
def sql_anti_join(): ...


@_same("select s_suppkey, s_name from supplier where s_suppkey in (select l_suppkey from lineitem where l_quantity > 49)")
def sql_semi_join(): ...


@_same(f"""with base as (select categoria, date_diff('day', fecha_apertura, fecha_cierre) as days from {TICKETS} where fecha_cierre is not null)
       select coalesce(categoria, 'sin') as "categoria", count(*) as n, cast(min(days) as bigint) as lo, cast(max(days) as bigint) as hi, round(avg(days), 6) as mean from base group by coalesce(categoria, 'sin')""")
def sql_dialect_days(): ...


@_same("with recursive r(k, n) as (select n_regionkey, 1 from nation where n_nationkey = 0 union all select k, n + 1 from r where n < 5) select k, n from r")
def sql_recursion(): ...


@query(f"""with a as (select row_id, tecnico_asignado, ingested_at from {TICKETS} where tecnico_asignado is not null)
       select x.row_id, (select epoch_us(max(y.ingested_at)) from a y where y.tecnico_asignado = x.tecnico_asignado and y.ingested_at < x.ingested_at) as before_us from a x""")
def sql_asof(spark: SparkSession, d: str) -> DataFrame:
    """As-of join: when the technician of a ticket had the delivery before it, in microseconds, by a range window over the key instead of a range join."""
    a = read(spark, d, TICKETS).filter("tecnico_asignado is not null")
    w = Window.partitionBy("tecnico_asignado").orderBy(F.unix_micros("ingested_at")).rangeBetween(Window.unboundedPreceding, -1)
    return a.select("row_id", F.unix_micros(F.max("ingested_at").over(w)).alias("before_us"))


@query(f"""select prioridad, count(*) filter (where estado = 'resuelto') as resuelto, count(*) filter (where estado = 'pendiente') as pendiente, count(*) filter (where estado = 'escalado') as escalado from {TICKETS} group by prioridad""")
def sql_pivot(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, TICKETS).groupBy("prioridad").pivot("estado", ["resuelto", "pendiente", "escalado"]).agg(F.count(F.lit(1)))
    return p.na.fill(0)


@query(f"""with old as (select * from {TICKETS} where row_id % 2 = 0), new as (select * from {TICKETS} where row_id % 3 = 0)
       select row_id, id_ticket, 'new' as src from new union all select row_id, id_ticket, 'old' from old where id_ticket not in (select id_ticket from new)""")
def upsert_rows(spark: SparkSession, d: str) -> DataFrame:
    """Replace by key: the old rows whose key was not delivered again, and all new ones (the two deliveries are the even rows and every third row)."""
    from legajo.sources.store import upsert

    t = read(spark, d, TICKETS).select("row_id", "id_ticket")
    return upsert(t.filter("row_id % 2 = 0").withColumn("src", F.lit("old")), t.filter("row_id % 3 = 0").withColumn("src", F.lit("new")), ["id_ticket"])


@query("""with t as (select time_bucket(interval '1 hour', ts) as w, event_type, value from events) select w::varchar as window_start, event_type, count(*) as n, round(sum(value), 4) as total from t group by w, event_type""")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Hourly tumbling windows: the same aggregation that the stream runs, here over the whole table."""
    from legajo.streaming.jobs import hourly

    return hourly(read(spark, d, "events")).select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""with s as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) <= interval '30 minutes' then 0 else 1 end as new from events),
       g as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as g from s)
       select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') as start, count(*) as n from g group by user_id, g""")
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of each user, closed by 30 minutes of silence."""
    w = Window.partitionBy("user_id").orderBy("ts")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))
    s = read(spark, d, "events").withColumn("new", F.when(gap <= 30 * 60 * 1_000_000, 0).otherwise(1))
    g = s.withColumn("g", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return g.groupBy("user_id", "g").agg(F.min("ts").alias("start"), F.count(F.lit(1)).alias("n")).select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("start"), "n")


@query("select cast(json_extract(props, '$.k') as bigint) as k, count(*) as n from events group by 1")
def json_field(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").groupBy(F.get_json_object("props", "$.k").cast("bigint").alias("k")).agg(F.count(F.lit(1)).alias("n"))
