"""Cutting documents into retrieval chunks by their type; rows in, exploded rows out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from legajo.functions.text import row_text

MAX_WORDS = 512


def _explode(df: DataFrame, parts: Column, level: str) -> DataFrame:
    return df.select("doc_id", F.posexplode(parts).alias("chunk_index", "text")).withColumn("level", F.lit(level))


def section_title(c: Column) -> Column:
    return F.substring(F.substring_index(F.trim(c), "\n", 1), 1, 80)


def by_numbered_sections(df: DataFrame, context: int = 200) -> DataFrame:
    """Minutes: cut before lines that begin with a number and a full stop; each later section carries the head of the document as context."""
    parts = F.split("text", r"\n(?=[0-9]+\.\s)")
    head = F.concat(F.lit("[Contexto: "), F.substring(F.trim(F.get(parts, F.lit(0))), 1, context), F.lit("]\n"))
    return _explode(df, F.transform(parts, lambda p, i: F.when(i == 0, F.trim(p)).otherwise(F.concat(head, F.trim(p)))), "meso").withColumn("section", section_title(F.regexp_replace("text", r"^\[Contexto: (?s:.*?)\]\n", "")))


def by_messages(df: DataFrame) -> DataFrame:
    """E-mail threads: one chunk a message (cut at rules of three dashes), and the thread itself where there are several."""
    parts = F.filter(F.transform(F.split("text", r"\n---+\n"), lambda x: F.trim(x)), lambda p: p != "")
    single = _explode(df, parts, "micro")
    thread = df.withColumn("n", F.size(parts)).filter("n > 1").select("doc_id", F.col("n").alias("chunk_index"), F.trim("text").alias("text"), F.lit("macro").alias("level"))
    return single.unionByName(thread)


def by_headings(df: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """Memos: short ones whole, longer ones before upper-case headings; parts under 20 characters are dropped."""
    words = F.size(F.split(F.trim("text"), r"\s+"))
    parts = F.split("text", r"\n(?=[A-ZÁÉÍÓÚÑ][A-ZÁÉÍÓÚÑ ]{5,}\n)")
    kept = F.filter(F.transform(parts, lambda x: F.trim(x)), lambda p: F.char_length(p) >= 20)
    return _explode(df, F.when(words < max_words, F.array(F.trim("text"))).otherwise(kept), "meso")


def by_entries(df: DataFrame, context: int = 150) -> DataFrame:
    """Listings: cut before numbered entries; every entry carries the head of the listing, which is the first chunk."""
    parts = F.split("text", r"\n(?=[0-9]{1,2}\.\s)")
    head = F.substring(F.trim(F.get(parts, F.lit(0))), 1, context)
    out = _explode(df, F.transform(parts, lambda p, i: F.when(i == 0, F.trim(p)).otherwise(F.concat(head, F.lit("\n"), F.trim(p)))), "micro")
    return out.withColumn("level", F.when(F.col("chunk_index") == 0, "macro").otherwise("micro"))


def by_articles(df: DataFrame, max_words: int = MAX_WORDS, capped: bool = False) -> DataFrame:
    """Legal texts of three sections or more: cut before articles and clauses, parts of fewer than 10 words dropped; longer ones go on in further chunks, or are capped by whole words."""
    parts = F.split("text", r"\n(?=(?:ARTÍCULO|CLÁUSULA|CAPÍTULO|Art\.)\s)")
    words = lambda p: F.filter(F.split(F.trim(p), r"\s+"), lambda w: w != "")
    kept = F.filter(parts, lambda p: F.size(words(p)) >= 10)
    starts = lambda p: F.array(F.lit(1)) if capped else F.sequence(F.lit(1), F.size(words(p)), F.lit(max_words))
    pieces = F.flatten(F.transform(kept, lambda p: F.transform(starts(p), lambda i: F.array_join(F.slice(words(p), i, F.lit(max_words)), " "))))
    return _explode(df.filter(F.size(parts) >= 3), pieces, "meso")


def by_paragraphs(df: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """Any text: paragraphs packed greedily up to the limit; a paragraph over it is packed by sentences. A fold inside the row, without Python."""
    paras = F.filter(F.transform(F.split("text", r"\n{2,}"), lambda x: F.trim(x)), lambda p: p != "")
    size = lambda p: F.size(F.split(p, r"\s+"))
    units = F.flatten(F.transform(paras, lambda p: F.when(size(p) <= max_words, F.array(p)).otherwise(F.split(p, r"(?<=[.!?])\s+"))))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"), F.lit(0).alias("n"))

    def step(acc: Column, u: Column) -> Column:
        full = (acc["n"] > 0) & (acc["n"] + size(u) > max_words)
        return F.struct(
            F.when(full, F.array_append(acc["done"], acc["cur"])).otherwise(acc["done"]).alias("done"),
            F.when(full | (acc["n"] == 0), u).otherwise(F.concat(acc["cur"], F.lit(" "), u)).alias("cur"),
            F.when(full, size(u)).otherwise(acc["n"] + size(u)).alias("n"))

    return _explode(df, F.aggregate(units, start, step, lambda a: F.when(a["n"] > 0, F.array_append(a["done"], a["cur"])).otherwise(a["done"])), "meso")


def rows_as_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """Tabular level 1: each row as text."""
    return df.withColumn("text", row_text(columns))


def groups_as_text(df: DataFrame, key: str, order: str, columns: list[str], most: int = 20) -> DataFrame:
    """Tabular level 2: per group its size and its first rows. The first rows are found by rank before they are gathered, so no group is collected whole."""
    k = F.trim(key)
    ranked = df.withColumn("grp", k).withColumn("rn", F.row_number().over(Window.partitionBy("grp").orderBy(order)))
    heads = ranked.filter(f"rn <= {most}").withColumn("line", row_text(columns)).groupBy(F.col("grp").alias("g")).agg(F.sort_array(F.collect_list(F.struct("rn", "line"))).alias("ls"))
    sizes = df.groupBy(k.alias("grp")).agg(F.count(F.lit(1)).alias("n_rows"))
    name = F.coalesce("grp", F.lit(""))
    return sizes.join(heads, F.col("grp").eqNullSafe(F.col("g"))).select(
        name.alias("grp"), "n_rows", F.concat(name, F.lit(" ("), F.col("n_rows").cast("string"), F.lit(" registros)\n"), F.array_join("ls.line", "\n")).alias("text"))


def column_summary(df: DataFrame, columns: list[str], top: int = 5) -> DataFrame:
    """Tabular level 3: distinct values and the most frequent ones of each column, in one pass over the unpivoted values."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns))).alias("x")).select("x.*").filter("value is not null")
    counts = long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("column_name").orderBy(F.desc("n"), "value"))
    total = counts.groupBy("column_name").agg(F.count(F.lit(1)).alias("n_distinct"))
    return counts.withColumn("rk", rank).filter(f"rk <= {top}").join(total, "column_name").select("column_name", "n_distinct", F.col("rk").cast("long").alias("rk"), "value", "n")


def inherit_mentions(chunks: DataFrame) -> DataFrame:
    """Persons, organisations and e-mails of a document that its chunk literally holds, whatever the case."""
    held = lambda c: F.filter(F.col(c), lambda p: F.contains(F.lower("text"), F.lower(p)))
    return chunks.select("chunk_id", *(F.coalesce(held(c), F.array().cast("array<string>")).alias(c) for c in ("persons", "organizations", "emails")))
