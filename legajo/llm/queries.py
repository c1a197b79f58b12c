"""Registered queries of the training-data operators; each runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from legajo.llm import encoding, mail, mixing, names, neardup, packing, reading, scans, splitting
from legajo.session import read

X, CHUNKS, TICKETS, EQUIPMENT = "documents_x", "chunks", "incidencias_soporte_q4_2024", "inventario_equipos_it"


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, X).select("doc_id", F.col("raw_text").alias("text"))


def _pieces(spark: SparkSession, d: str, only_oversized: bool) -> DataFrame:
    docs = splitting.split_items(read(spark, d, X), "doc_id", "raw_text", only_oversized=only_oversized)
    chunks = splitting.split_items(read(spark, d, CHUNKS), "chunk_id", "text", "section", only_oversized=only_oversized)
    return docs.withColumn("tabla", F.lit(X)).unionByName(chunks.withColumn("tabla", F.lit(CHUNKS)))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d, True).filter("piece_index = 0").select("tabla", F.col("item_id").alias("rec_id")).distinct()


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d, False).select("tabla", F.col("item_id").alias("rec_id"), "section", "piece_index", "n_words", "n_chars", "char_start", "char_end", "text")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return mail.new_lines(read(spark, d, X)).select("doc_id", "line_no")


def p3_new_text(spark: SparkSession, d: str) -> DataFrame:
    lines = mail.new_lines(read(spark, d, X)).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("line_no", "text"))).alias("l"))  # one mail's lines
    return lines.select("doc_id", F.size("l").cast("long").alias("n_lines"), F.array_join("l.text", "\n").alias("new_text"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.similar_pairs(_texts(spark, d))


def p4_links(spark: SparkSession, d: str) -> DataFrame:
    return neardup.class_links(_texts(spark, d))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.duplicate_groups(_texts(spark, d))


def _records(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, X).select(F.lit(X).alias("tabla"), F.col("doc_id").alias("rec_id"), F.col("raw_text").alias("text"))
    tickets = read(spark, d, TICKETS).select(F.lit(TICKETS).alias("tabla"), F.col("row_id").cast("string").alias("rec_id"), F.col("descripcion_breve").alias("text"))
    return docs.unionByName(tickets)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.garbled_records(_records(spark, d))


def p5_restored(spark: SparkSession, d: str) -> DataFrame:
    return encoding.restore_records(_records(spark, d))


def _mentions(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, X)
    of = lambda df, tabla, rec, name, kind: df.select(F.lit(tabla).alias("tabla"), rec.cast("string").alias("rec_id"), name.alias("nombre"), F.lit(kind).alias("kind"))
    return (
        of(docs, X, F.col("doc_id"), F.explode("persons"), "person")
        .unionByName(of(docs, X, F.col("doc_id"), F.explode("organizations"), "organization"))
        .unionByName(of(read(spark, d, TICKETS), TICKETS, F.col("row_id"), F.col("tecnico_asignado"), "person"))
        .unionByName(of(read(spark, d, EQUIPMENT), EQUIPMENT, F.col("row_id"), F.col("asignado_a"), "person")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return names.variant_mentions(_mentions(spark, d), read(spark, d, "entity_nodes"))


def p6_links(spark: SparkSession, d: str) -> DataFrame:
    distinct = _mentions(spark, d).filter("nombre is not null").groupBy("nombre", "kind").agg(F.count(F.lit(1)).alias("n"))
    return names.link_mentions(distinct, read(spark, d, "entity_nodes"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.noise_lines(_texts(spark, d))


def p7_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scans.repair_texts(_texts(spark, d))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_containers(read(spark, d, "documents"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(packing.fill_containers(read(spark, d, "documents")))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.draw_mix(read(spark, d, "documents"), read(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.draw_mix(read(spark, d, "documents"), read(spark, d, "mix_targets"))[1]


def _levels(spark: SparkSession, d: str, keep: list[str]) -> DataFrame:
    docs = read(spark, d, "documents")
    return reading.reading_levels(docs, reading.train_levels(docs, read(spark, d, "reading_labels")), keep)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _levels(spark, d, []).filter("level >= 4 and n_words >= 60").select("doc_id")


def p10_levels(spark: SparkSession, d: str) -> DataFrame:
    return _levels(spark, d, ["lang", "source"])


def p10_profile(spark: SparkSession, d: str) -> DataFrame:
    return reading.level_profile(_levels(spark, d, ["lang", "source"]))


_ALL = (
    p1_found, p1_pieces, p3_found, p3_new_text, p4_found, p4_links, p4_groups, p5_found, p5_restored, p6_found, p6_links, p7_found, p7_repaired,
    p8_containers, p8_report, p9_mix, p9_shares, p10_found, p10_levels, p10_profile,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    """What plain SQL can say about these problems: the definitions of p1_found and p4_found."""
    words = "list_filter(string_split_regex({t}, '[ \\t\\r\\n]+'), lambda x: x <> '')"
    big = "length({t}) > 4096 or len(" + words + ") > 512"
    return {
        "p1_found": f"select 'documents_x' as tabla, doc_id as rec_id from documents_x where {big.format(t='raw_text')} "
        f"union select 'chunks', chunk_id from chunks where {big.format(t='text')}",
        "p4_found": f"""
            with w as (select doc_id, {words.format(t='lower(raw_text)')} as w from documents_x),
            s as (select distinct doc_id, w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2] as s from w, unnest(range(1, len(w) - 1)) as t(i)),
            n as (select doc_id, count(*) as n from s group by doc_id),
            c as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2)
            select x as doc_id_a, y as doc_id_b from c join n p on p.doc_id = x join n q on q.doc_id = y where c >= 0.5 * (p.n + q.n - c)""",
    }
