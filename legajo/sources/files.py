"""Files as documents: text with encoding fallback, CSV with a sniffed separator, DOCX and XLSX from their XML, optional PDF."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from legajo.functions.text import file_id
from legajo.session import ship

EXTENSIONS = ("txt", "md", "csv", "docx", "doc", "xlsx", "pdf")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def decode(raw: bytes) -> str:
    """Text of a file: UTF-8 (a byte-order mark is dropped), else cp1252 where its bytes are defined, else Latin-1."""
    for enc in ("utf-8-sig", "cp1252"):
        try:
            return raw.decode(enc)
        except UnicodeDecodeError:
            continue
    return raw.decode("latin-1")


def separator(head: str) -> str:
    return ";" if head.count(";") > head.count(",") else ","


def docx_text(raw: bytes) -> str:
    """The paragraphs of a DOCX file that are not blank, parted by blank lines."""
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml"))
    paras = ("".join(t.text or "" for t in p.iter(f"{_W}t")) for p in root.iter(f"{_W}p"))
    return "\n\n".join(p for p in paras if p.strip())


def xlsx_rows(raw: bytes) -> list[list[str]]:
    """The cells of the first sheet of an XLSX file as text, missing cells empty."""
    z = zipfile.ZipFile(io.BytesIO(raw))
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in s.iter(f"{_S}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
    sheet = sorted(n for n in z.namelist() if re.match(r"xl/worksheets/sheet\d+\.xml$", n))[0]
    rows = []
    for r in ElementTree.fromstring(z.read(sheet)).iter(f"{_S}row"):
        row: list[str] = []
        for c in r.iter(f"{_S}c"):
            col = 0
            for ch in re.match(r"[A-Z]+", c.get("r", "A")).group():
                col = col * 26 + ord(ch) - 64
            row += [""] * (col - 1 - len(row))
            v = c.find(f"{_S}v")
            text = "".join(t.text or "" for t in c.iter(f"{_S}t")) if c.get("t") == "inlineStr" else (v.text or "" if v is not None else "")
            row.append(shared[int(text)] if c.get("t") == "s" and text else text)
        rows.append(row)
    return rows


def table_text(name: str, rows: list[list[str]]) -> str:
    """A table as text: one head line, then 'column: value | column: value' of the cells that are not empty."""
    if not rows:
        return ""
    head, body = [c.strip() for c in rows[0]], rows[1:]
    lines = [" | ".join(f"{h}: {v}" for h, v in zip(head, r) if v) for r in body]
    return f"Datos de '{name}' — {len(body)} filas, columnas: {', '.join(head)}\n\n" + "\n".join(lines)


def parse(name: str, raw: bytes) -> str | None:
    """Text of one file by its extension; null where it can't be read."""
    ext = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    try:
        if ext in ("docx", "doc"):
            return docx_text(raw)
        if ext in ("xlsx", "xls"):
            return table_text(name, xlsx_rows(raw))
        if ext == "csv":
            import csv

            text = decode(raw)
            rows = [r for r in csv.reader(io.StringIO(text), delimiter=separator(text[:2000]))]
            return table_text(name, [r for r in rows if len(r) == len(rows[0])]) if rows else ""
        if ext == "pdf":
            try:
                import pypdf
            except ImportError:
                return None
            return "\n\n".join(t for t in (p.extract_text() for p in pypdf.PdfReader(io.BytesIO(raw)).pages) if t.strip())
        return decode(raw)
    except Exception:  # noqa: BLE001 - a broken file is a row without text, not the end of the job
        return None


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(doc_id, filename, filepath, raw_text) of the files of a folder with a known extension; a broken file has a null text. One file is one row, parsed in parallel."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return parse_files(files)


def parse_files(files: DataFrame) -> DataFrame:
    """The same of a (streaming) binaryFile frame."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            name = p["path"].str.rsplit("/", n=1).str[-1]
            yield pd.DataFrame({"filename": name, "filepath": p["path"], "raw_text": [parse(n, c) for n, c in zip(name, p["content"])]})

    ship(files.sparkSession)
    known = files.filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*EXTENSIONS)).select("path", "content")
    parsed = known.mapInPandas(run, "filename string, filepath string, raw_text string")
    return parsed.select(file_id(F.col("filename")).alias("doc_id"), "filename", "filepath", "raw_text")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with inferred types; the separator is that of the first line, malformed lines are dropped, headers trimmed."""
    head = spark.read.text(path).limit(1).collect()
    sep = separator(head[0][0] if head else "")
    df = spark.read.csv(path, sep=sep, header=True, inferSchema=True, mode="DROPMALFORMED", encoding="UTF-8")
    return df.withColumnsRenamed({c: c.strip().lstrip("﻿") for c in df.columns})


def read_vectors(spark: SparkSession, path: str, dims: int, most: int | None = None) -> DataFrame:
    """(word, v) of a text file of word vectors, one word and its numbers a line, scaled to length 1; lines of another width and words that are not letters are left out."""
    parts = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path)
    lines = (lines.limit(most) if most else lines).select(parts.alias("p")).filter(F.size("p") == dims + 1)
    v = F.transform(F.slice("p", 2, dims), lambda x: x.try_cast("double"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    rows = lines.select(F.lower(F.get("p", F.lit(0))).alias("word"), v.alias("v")).filter(F.col("word").rlike(r"(?U)^\p{L}+$") & ~F.exists("v", lambda x: x.isNull()))
    return rows.withColumn("n", norm).filter("n > 0").select("word", F.transform("v", lambda x: x / F.col("n")).alias("v"))
