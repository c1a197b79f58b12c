"""Registered queries of the core."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from legajo.plans import chain, details, graphs, more, search, sqlsurface, texts  # noqa: F401 - they register their queries
from legajo.plans.registry import QUERIES, SQL
from legajo.session import read
from legajo.sources import deliveries


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return deliveries.load_records(read(spark, d, "raw_records")).filter("reason is not null").select("record_id", "reason")


def p2_tickets(spark: SparkSession, d: str) -> DataFrame:
    return deliveries.typed_rows(deliveries.load_records(read(spark, d, "raw_records")), "tickets")


def p2_equipment(spark: SparkSession, d: str) -> DataFrame:
    return deliveries.typed_rows(deliveries.load_records(read(spark, d, "raw_records")), "equipment")


_ALL = (p2_found, p2_tickets, p2_equipment)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL} | QUERIES


def _p2_rows() -> str:
    """The delivery format in SQL, as common tables: the quoting rule as a regular expression of the whole record, values by extraction, the reason."""
    value = lambda s: f'"(?:[^"]|"")*"|[^"{s}]*'
    by_sep = lambda f: f"case when sep = ';' then {f(';')} else {f(',')} end"
    whole = by_sep(lambda s: f"regexp_full_match(raw, '(?:{value(s)})(?:{s}(?:{value(s)}))*')")
    cells = by_sep(lambda s: f"regexp_extract_all(raw || '{s}', '({value(s)}){s}', 1)")
    is_date = lambda c: f"(regexp_full_match({c}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') and try_cast({c} as date) is not null)"
    return f"""
        with h as (select file_name, min(raw_record) as h from raw_records where line_no = 1 group by file_name),
        r as (select record_id, case when raw_record like '%' || chr(13) then raw_record[:-2] else raw_record end as raw,
                case when len(h) - len(replace(h, ';', '')) > len(h) - len(replace(h, ',', '')) then ';' else ',' end as sep, contains(h, 'id_equipo') as eq
              from raw_records join h using (file_name) where line_no <> 1),
        c as (select *, {whole} as quoted, case when {whole} then {cells} end as v from r),
        t as (select *, [trim(case when x[1] = '"' then replace(x[2:-2], '""', '"') else x end, ' ' || chr(9) || chr(10) || chr(13)) for x in v] as t from c),
        j as (select *, case
            when not quoted then 'broken_quote'
            when len(v) <> 9 then 'column_count'
            when not eq and regexp_full_match(t[1], 'TK-[0-9]{{4}}-[0-9]{{4,}}') and {is_date('t[2]')} and (t[3] = '' or {is_date('t[3]')}) and t[7] <> '' then null
            when eq and regexp_full_match(t[1], 'EQ-[0-9]{{4,}}') and regexp_full_match(t[5], '[A-Z0-9-]{{5,20}}') and regexp_matches(t[5], '[0-9]')
                and (t[8] = '' or {is_date('t[8]')}) then null
            else 'invalid_value' end as reason from t)"""


def _typed_sql(layout: str) -> str:
    cells = ", ".join((f"try_cast(nullif(t[{i + 1}], '') as date)" if c.startswith("fecha") else f"nullif(t[{i + 1}], '')") + f" as {c}" for i, c in enumerate(deliveries.LAYOUTS[layout]))
    return f"{_p2_rows()} select record_id, {cells} from j where reason is null and {'eq' if layout == 'equipment' else 'not eq'}"


def oracle_sql() -> dict[str, str]:
    return {"p2_found": f"{_p2_rows()} select record_id, reason from j where reason is not null", "p2_tickets": _typed_sql("tickets"), "p2_equipment": _typed_sql("equipment")} | SQL
