"""Hand-computed cases and brute force for operators that SQL does not cover."""

import itertools
import os
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from legajo import session
from legajo.functions import text as T
from legajo.operators import chunking, fusion, graph, passes, vectors
from legajo.plans import sqlsurface
from legajo.plans.engine import Agent, Engine
from legajo.sources import files, store
from legajo.streaming import jobs


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


def test_fold_numbers_dates(spark):
    assert one(spark, T.fold, "  Reunión  Straße ") == "reunion strasse"
    assert one(spark, T.fold, None) is None
    assert one(spark, T.fold, "Šibenik İz ≠ ŽÓ №ºª") == "sibenik iz = zo №oa"
    assert all(len(x) == len(set(x)) for x in T.fold_table()[:1]) and len(T.fold_table()[0]) == len(T.fold_table()[1])
    assert [one(spark, T.number_value, x) for x in ("1.234", "6k", "1,5m", "32", "abc")] == ["1234", "6000", "1500000", "32", "abc"]
    assert one(spark, T.dates, "el 10 de enero de 2025 y 03/09/2024, marzo de 2023") == ["2023", "2023-03", "2024", "2024-09-03", "2025", "2025-01", "2025-01-10"]
    assert one(spark, T.char_ngrams, "ab c-d") == ["abc", "bcd"] and one(spark, T.char_ngrams, "ab") == ["ab"] and one(spark, T.char_ngrams, "¡!") == []


def test_rrf_and_min_max(spark):
    a = spark.createDataFrame([(0, "a", 1), (0, "b", 2)], "query int, id string, rank int")
    b = spark.createDataFrame([(0, "b", 1), (0, "c", 2)], "query int, id string, rank int")
    got = {r["id"]: r["score"] for r in fusion.rrf([a, b]).collect()}
    assert got["b"] == pytest.approx(1 / 62 + 1 / 61) and got["a"] == pytest.approx(1 / 61) and got["c"] == pytest.approx(1 / 62)
    s = spark.createDataFrame([(0, "a", 5.0), (0, "b", 5.0), (1, "a", 1.0), (1, "b", 3.0)], "query int, id string, score double")
    assert sorted((r["query"], r["id"], r["n"]) for r in fusion.min_max(s, "score", "n").collect()) == [(0, "a", 1.0), (0, "b", 1.0), (1, "a", 0.0), (1, "b", 1.0)]


def edges(spark, pairs):
    return spark.createDataFrame([(min(p), max(p), 1) for p in pairs], "src string, dst string, weight long")


def brandes(nodes, pairs):
    near = {n: {b for a, b in [*pairs, *((y, x) for x, y in pairs)] if a == n} for n in nodes}
    total = dict.fromkeys(nodes, 0.0)

    def paths(s, t):
        level, found = [[s]], []
        while level and not found:
            found = [p for p in level if p[-1] == t]
            level = [p + [n] for p in level for n in near[p[-1]] if n not in p]
        return found

    for s, t in itertools.permutations(nodes, 2):
        ps = paths(s, t)
        for p in ps:
            for v in p[1:-1]:
                total[v] += 1 / len(ps)
    n = len(nodes)
    return {k: v / ((n - 1) * (n - 2)) for k, v in total.items()}


@pytest.mark.parametrize("pairs", [["ab", "bc"], ["ab", "ac", "ad", "ae"], ["ab", "bc", "cd", "de", "ea"], ["ab", "bc", "ca", "cd", "de", "ef", "fd", "af"]])
def test_betweenness(spark, pairs):
    pairs = [tuple(p) for p in pairs]
    nodes = sorted({x for p in pairs for x in p})
    e = edges(spark, pairs)
    got = {r["key"]: r["betweenness"] for r in graph.betweenness(e, spark.createDataFrame([(n,) for n in nodes], "key string")).collect()}
    want = brandes(nodes, pairs)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_graph_merge_and_communities(spark):
    m = spark.createDataFrame([("d1", "ana", "Ana", "person"), ("d1", "ana lopez", "Ana López", "person"), ("d2", "ana", "Ana", "organization")], "doc_id string, key string, name string, entity_type string")
    assert {(r["key"], r["target"]) for r in graph.merge_targets(graph.nodes(m.filter("doc_id = 'd1'"))).collect()} == {("ana", "ana lopez"), ("ana lopez", "ana lopez")}
    two = [tuple(p) for p in itertools.chain(itertools.combinations("abcd", 2), itertools.combinations("wxyz", 2))] + [("d", "w")]
    c = {r["key"]: r["community"] for r in graph.label_communities(edges(spark, two)).collect()}
    assert len({c[k] for k in "abc"}) == 1 and len({c[k] for k in "xyz"}) == 1 and c["a"] != c["z"]


def test_paragraph_packing(spark):
    text = "\n\n".join(["uno dos tres."] * 3 + ["a b c. d e f. g h i. j k l."])
    got = [r["text"] for r in chunking.by_paragraphs(spark.createDataFrame([("d", text)], "doc_id string, text string"), 7).orderBy("chunk_index").collect()]
    assert all(len(x.split()) <= 7 for x in got) and " ".join(got).split() == text.split()


def test_ann_recall_and_block_search(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((40, 32))
    m = (centres[rng.integers(0, 40, 800)] + 0.45 * rng.standard_normal((800, 32))).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, v array<double>")
    q = df.filter("id % 50 = 0")
    exact = {(r["query"], r["id"]) for r in vectors.block_search(df, "id", "v", q, 10).collect()}
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    for i in range(0, 800, 50):
        s = u @ u[i]
        s[i] = -9
        assert {j for a, j in exact if a == i} == set(np.argsort(-s)[:10].tolist())
    found = {(r["query"], r["id"]) for r in vectors.indexed_search(df, "id", "v", q, 10).collect()}
    assert len(exact & found) / len(exact) >= 0.9


def test_vector_near_duplicates(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((60, 24))
    m = np.vstack([base, base[:30] + 0.2 * rng.standard_normal((30, 24)), base[:3]])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, v array<double>")
    got = {r["id"]: r["links"] for r in vectors.near_duplicates(df, "id", "v", 0.85).collect()}
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    want = ((u @ u.T) >= 0.85 - 1e-12).sum(axis=1) - 1
    assert sum(got.values()) >= 0.9 * want.sum() and all(got[i] <= want[i] for i in got) and len(got) == len(m)
    assert vectors.near_duplicates(df.limit(0), "id", "v").count() == 0


def test_sql_surface(spark):
    spark.range(300).createOrReplaceTempView("numbers_300")
    df, cut = sqlsurface.run_sql(spark, 'select id as "n" from numbers_300')
    assert df.count() == 200 and cut
    with pytest.raises(ValueError):
        sqlsurface.run_sql(spark, "drop table x")
    assert sqlsurface.ask_count("SELECT a FROM t GROUP BY a", "¿Cuántos hay?") == "SELECT COUNT(*) AS total, a FROM t GROUP BY a"
    assert sqlsurface.ask_count("SELECT a FROM t", "¿Cuántos hay?") == "SELECT a FROM t"
    assert sqlsurface.ask_count("SELECT a FROM t GROUP BY a", "total de filas").startswith("SELECT COUNT(*) AS total")
    assert sqlsurface.translate("""select 'call len(x) and "q"', len(a), "b c", date_diff('day', x, y)""") == """select 'call len(x) and "q"', char_length(a), `b c`, date_diff(DAY, x, y)"""


def test_files_and_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "memo.txt").write_bytes("Reunión a las 8\n".encode("cp1252"))
    (src / "t.csv").write_text("﻿a;b\n1;2\n3\n", encoding="utf-8")
    (src / "skip.bin").write_bytes(b"\0")
    with zipfile.ZipFile(src / "d.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Hola</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Dos</w:t></w:r></w:p></w:body></w:document>')
    (src / "broken.docx").write_bytes(b"no zip")
    got = {r["filename"]: r["raw_text"] for r in files.read_files(spark, str(src)).collect()}
    assert got == {"memo.txt": "Reunión a las 8\n", "t.csv": "Datos de 't.csv' — 1 filas, columnas: a, b\n\na: 1 | b: 2", "d.docx": "Hola\n\nDos", "broken.docx": None}
    for _ in range(2):  # a second run finds nothing new
        jobs.stream_files(spark, str(src), str(tmp_path / "docs"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "docs")).count() == 4


def test_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "ev"))
    jobs.stream_hourly(spark, str(tmp_path / "ev"), events.schema, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    out = {(r["window_start"], r["event_type"]): r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = {(r["window_start"], r["event_type"]): r["n"] for r in jobs.hourly(events).collect()}
    last = max(w for w, _ in batch)
    closed = {k: v for k, v in batch.items() if (last - k[0]).total_seconds() > 3 * 3600}
    assert out and closed.items() <= out.items() and out.items() <= batch.items()


def test_engine(spark, sf, tmp_path):
    e = Engine(spark, spark.read.parquet(f"{sf}/documents_x.parquet"), spark.read.parquet(f"{sf}/chunks.parquet"))
    hits = e.search("contrato de servicios", 5).collect()
    assert 0 < len(hits) <= 5 and [h["rank"] for h in hits] == list(range(1, len(hits) + 1))
    assert e.search("the of and", 5).count() == 0
    assert e.context("contrato", 300).agg(F.max("used")).first()[0] <= 300
    a = e.entities(1).first()["key"]
    assert e.entity(a).count() == 1 and e.path(a, a) == [a]
    near = graph.related(graph.edges(e._mentions()), 1).first()
    assert e.path(near["src"], near["dst"]) == [near["src"], near["dst"]]
    assert "error" in e.call_tool("query_data", "{bad") and e.call_tool("find_connection", f'{{"a": "{a}", "b": "nadie"}}') == "[]"
    (tmp_path / "acta_nueva.txt").write_text("ACTA DE REUNIÓN\nAsisten Ana Pérez Gil", encoding="utf-8")
    assert e.ingest(str(tmp_path)).filter("filename = 'acta_nueva.txt' and doc_type = 'acta_reunion'").count() == 1


def test_passes_in_order(spark):
    a = spark.createDataFrame([(0, 1, 2.0)], "query long, id long, score double")
    b = spark.createDataFrame([(0, 1, 9.0), (0, 2, 1.0)], "query long, id long, score double")
    assert [(r["id"], r["pass_no"], r["rank"]) for r in passes.in_order([a, b], 5).orderBy("rank").collect()] == [(1, 0, 1), (2, 1, 2)]
    assert one(spark, passes.stem, "instalaciones") == one(spark, passes.stem, "instalacion")


def test_agent(spark, sf):
    class Script:
        def __init__(self, *lines):
            self.lines, self.prompts = list(lines), []

        def complete(self, prompt):
            self.prompts.append(prompt)
            return self.lines.pop(0)

    bad = '{"tool": "query_data", "arguments": {"sql": "drop table x"}}'
    p = Script(bad, bad, '{"tool": "search_documents", "arguments": {"query": "contrato"}}', "Listo.")
    e = Engine(spark, spark.read.parquet(f"{sf}/documents_x.parquet"), spark.read.parquet(f"{sf}/chunks.parquet"), p)
    a = Agent(e)
    got = a.ask("¿Qué contratos hay?")
    assert got["answer"] == "Listo." and got["sources"] and "failed before" in p.prompts[2] and a.turns[-1] == ("assistant", "Listo.")
    p.lines = ["SELECT nope", "```sql\nselect 1 as one\n```"]
    assert e.ask_sql("uno")[0].first()["one"] == 1
    p.lines = ["Sí."]
    assert e.ask("contrato")["answer"] == "Sí."


def test_soft_boost_and_vector_file(spark, tmp_path):
    a = spark.createDataFrame([(0, 1, 2.0), (0, 2, 1.0)], "query long, id long, score double")
    b = spark.createDataFrame([(0, 2, 10.0), (0, 3, 5.0)], "query long, id long, score double")
    assert sorted((r["id"], r["score"]) for r in passes.soft_boost(a, b).collect()) == [(1, 2.0), (2, 4.5)]
    (tmp_path / "v.txt").write_text("3 2\nCasa 3 4\nx9 1 1\nsol 0 0\nmar 1 x\n", encoding="utf-8")
    assert [(r["word"], r["v"]) for r in files.read_vectors(spark, str(tmp_path / "v.txt"), 2).collect()] == [("casa", [0.6, 0.8])]


def test_xlsx():
    import io

    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>a</t></si><si><t>b </t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2"><v>5</v></c><c r="C2" t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>')
    assert files.xlsx_rows(raw.getvalue()) == [["a", "", "b "], ["5", "", "x"]]
    assert files.parse("t.xlsx", raw.getvalue()).startswith("Datos de 't.xlsx' — 1 filas, columnas: a, , b\n\na: 5 | b: x")
    assert files.parse("t.pdf", b"no pdf") is None and files.decode("ñ".encode("latin-1")) == "ñ"


def test_tables(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a ;b\n1;x\n2;y\n", encoding="utf-8")
    t = files.read_table(spark, str(tmp_path / "t.csv"))
    assert t.columns == ["a", "b"] and t.agg(F.sum("a")).first()[0] == 3
    store.write_table(t, str(tmp_path / "out"), "b")
    new = spark.createDataFrame([(9, "x"), (8, "z")], "a int, b string")
    got = store.upsert(spark.read.parquet(str(tmp_path / "out")), new, ["b"]).collect()
    assert sorted((r["a"], r["b"]) for r in got) == [(2, "y"), (8, "z"), (9, "x")]


def test_materialize_and_clean_up(spark):
    df = session.materialize(spark.range(5), "t")
    path = df.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    assert df.count() == 5 and os.path.exists(path)
    assert session.clean_up(spark) >= 1 and not os.path.exists(path)
