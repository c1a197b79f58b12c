"""The lexical passes, boosts and facets on small tables written by hand."""

from pyspark.sql import functions as F

from legajo.functions import text as T
from legajo.operators import chain, fusion
from legajo.plans.details import number_stream

CHUNKS = [
    ("c1", "Caldera nueva", "La caldera de la planta pierde agua.", ["agua"], ["Ana López"], []),
    ("c2", None, "El contrato de mantenimiento cuesta 1.200 euros.", None, None, ["Talleres Sur"]),
    ("c3", "Acta", "Reuniones de proveedores y contratos.", [], [], []),
    ("c4", "", "", [], [], []),
    ("c5", "Nota", "mantenimiento de la planta", ["caldera"], [], []),
]


def ask(spark, *texts, synonyms=None):
    chunks = spark.createDataFrame(CHUNKS, "chunk_id string, title string, text string, keywords array<string>, persons array<string>, organizations array<string>")
    queries = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "query long, text string")
    n = lambda keep: number_stream(T.fold(F.col("text")), keep=keep)
    rows = chain.search(chunks, queries, n(True), n(False), synonyms=synonyms).orderBy("query", "rank").collect()
    return {i: [(r["id"], r["pass_no"]) for r in rows if r["query"] == i] for i in range(len(texts))}


def test_passes(spark):
    got = ask(spark, "la caldera planta", "caldera zzzz", "mil 1200 euros", "reunión proveedor", "cald3ra plant4 pi3rde", "de la", None, "", "ANA lopez")
    assert [x for x, _ in got[0]] == ["c1", "c5"] and {p for _, p in got[0]} == {0}  # all words, each in any field
    assert got[1] and {p for _, p in got[1]} == {1} and {x for x, _ in got[1]} == {"c1", "c5"}  # any word
    assert ("c2", 1) in got[2]
    assert ("c3", 4) in got[3]  # stems
    assert got[4] and got[4][0][1] in (1, 3) and "c1" in [x for x, _ in got[4]]  # 3-grams of a mistyped query
    assert not got[5] and not got[6] and not got[7] and [x for x, _ in got[8]] == ["c1"]


def test_numbers(spark):
    assert ("c2", 2) in ask(spark, "1200 euros")[0] or ask(spark, "1200 euros")[0][0][0] == "c2"


def test_synonyms(spark):
    syn = spark.createDataFrame([("radiador", "caldera"), ("planta", "agua")], "word string, synonym string")
    assert {x for x, _ in ask(spark, "radiador", synonyms=syn)[0]} == {"c1", "c5"}
    assert ask(spark, "planta", synonyms=syn)[0][0] == ("c1", 0)  # the row with the synonym goes first


def test_graph_boost(spark):
    hits = spark.createDataFrame([(1, "a", 1.0), (1, "b", 1.0), (1, "c", 1.0), (2, "a", 1.0)], "query long, id string, score double")
    texts = spark.createDataFrame([(1, "contrato de Ana López con Sur y Norte SA"), (2, "nada")], "query long, text string")
    entities = spark.createDataFrame([("ana lopez", "a"), ("sur", "b"), ("norte sa", "b"), ("ana lopez", "b"), ("lop", "c")], "key string, id string")
    got = {(r["query"], r["id"]): (r["named"], round(r["score"], 4)) for r in fusion.graph_boost(hits, texts, entities).collect()}
    assert got == {(1, "a"): (1, 1.15), (1, "b"): (3, 1.3), (1, "c"): (0, 1.0), (2, "a"): (0, 1.0)}


def test_pool_facets(spark):
    rows = [(1, "d1", 1, "acta", ["Ana", "Luis"], ["3/2/2024", "x"]), (1, "d1", 2, "acta", ["Ana"], ["2023"]), (1, "d2", 3, None, None, ["2024-02-03"])]
    pool = spark.createDataFrame(rows, "query long, doc_id string, rank int, doc_type string, persons array<string>, dates array<string>")
    got = [(r["facet"], r["value"], r["n"], r["rk"]) for r in fusion.pool_facets(pool, {"doc_type": 20}, {"persons": 1}, {"dates": 20}).orderBy("facet", "rk").collect()]
    assert got == [("dates", "2024-02-03", 2, 1), ("dates", "2023", 1, 2), ("doc_type", "acta", 1, 1), ("persons", "Ana", 2, 1)]
