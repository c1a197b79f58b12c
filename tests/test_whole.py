"""Whole results where an operator once stopped short, against brute force."""

import itertools

from legajo import queries as core


def test_char3_every_query(spark, sf):
    from legajo.functions import text as T

    q = core.queries()
    rows = spark.read.parquet(f"{sf}/incidencias_soporte_q4_2024.parquet").select("row_id", T.fold("descripcion_breve").alias("f")).collect()
    flat = {r["row_id"]: "".join(c for c in r["f"] or "" if c in "abcdefghijklmnopqrstuvwxyz0123456789") for r in rows}
    grams = {i: {s[j : j + 3] for j in range(len(s) - 2)} for i, s in flat.items() if len(s) >= 3}
    want = {(a, i): len(grams[a] & g) / len(grams[a]) for a in grams if a % 50 == 0 for i, g in grams.items() if len(grams[a] & g) / len(grams[a]) >= 0.4}
    asked = {a for a, _ in want}
    assert any(a % 3000 for a in asked)
    got = {r["query"]: (r["hits"], r["best"]) for r in q["char3_hits"](spark, sf).collect()}
    assert got == {a: (sum(x == a for x, _ in want), max(v for (x, _), v in want.items() if x == a)) for a in asked}
    cls = {r["id"]: r["cls"] for r in q["char3_members"](spark, sf).collect()}
    of = {c: [i for i in cls if cls[i] == c] for c in set(cls.values())}
    pairs = {(a, i): r["coverage"] for r in q["char3_matches"](spark, sf).collect() for a in of[r["query"]] if a % 50 == 0 for i in of[r["cls"]]}
    assert pairs == want


def test_whole_texts(spark):
    from pyspark.sql import functions as F

    from legajo.functions import text as T
    from legajo.operators import chunking

    short, long = "Una frase de relleno sin nada dentro. ", "palabra " * 45 + "final"
    x = spark.createDataFrame([(short * 100 + long + ". Fin.", "el la los de que con. " * 30 + "the of and to is that for with. " * 60)], "s string, l string")
    got = x.select(T.summary(F.col("s")).alias("s"), T.language(F.col("l")).alias("l")).first()
    assert len(short * 100) > 3000 and long in got["s"] and got["l"] == "en"
    parts = ["ARTÍCULO 1 " + " ".join(f"a{i}" for i in range(1100)), "ARTÍCULO 2 " + " ".join(f"b{i}" for i in range(20)), "ARTÍCULO 3 corto"]
    c = chunking.by_articles(spark.createDataFrame([("d", "\n".join(parts))], "doc_id string, text string")).orderBy("chunk_index").collect()
    assert [len(r["text"].split()) for r in c] == [512, 512, 78, 22] and " ".join(r["text"] for r in c).split() == " ".join(parts[:2]).split()


def test_shared_document_rows(spark, tmp_path):
    docs = [(f"d{i:02d}", ["Ana Gil", "Eva Sanz"], ["Tres S.L."] if i == 0 else []) for i in range(60)] + [("e", None, None)]
    spark.createDataFrame(docs, "doc_id string, persons array<string>, organizations array<string>").write.parquet(str(tmp_path / "documents_x.parquet"))
    got = sorted((r["src"], r["dst"], r["doc_id"]) for r in core.queries()["shared_document_rows"](spark, str(tmp_path)).collect())
    assert got == sorted([("ana gil", "eva sanz", x) for x, _, _ in docs[:60]] + [("ana gil", "tres s.l.", "d00"), ("eva sanz", "tres s.l.", "d00")])


def test_betweenness_of_long_paths(spark):
    from legajo.operators import graph

    n = 12
    e = spark.createDataFrame([(f"k{i:02d}", f"k{i + 1:02d}", 1) for i in range(n - 1)], "src string, dst string, weight long")
    want = {f"k{i:02d}": 2 * i * (n - 1 - i) / ((n - 1) * (n - 2)) for i in range(n)}
    for got in (graph.all_betweenness(e), graph.all_betweenness(e, most=1)):
        got = {r["key"]: round(r["betweenness"], 9) for r in got.collect()}
        assert got == {k: round(v, 9) for k, v in want.items()}
    ring = [("a", "b", 1), ("b", "c", 1), ("c", "d", 1), ("a", "d", 1), ("d", "e", 1)]
    e = spark.createDataFrame(ring, "src string, dst string, weight long")
    x, y = ({r["key"]: round(r["betweenness"], 9) for r in b.collect()} for b in (graph.all_betweenness(e), graph.betweenness(e, graph.both_ways(e).selectExpr("src as key").distinct())))
    assert x == y and graph.all_betweenness(e.limit(0)).count() == 0


def test_communities_come_to_rest(spark):
    from legajo.operators import graph

    pairs = [(f"{i:03d}", f"{i + 1:03d}", 1 + i) for i in range(30)]
    e = spark.createDataFrame(pairs, "src string, dst string, weight long")
    c = {r["key"]: r["community"] for r in graph.label_communities(e).collect()}
    for k in c:
        near = [(b if a == k else a, w) for a, b, w in pairs if k in (a, b)]
        votes = {x: sum(w for b, w in near if c[b] == x) for x in {c[b] for b, _ in near}}
        assert min((-w, x) for x, w in votes.items())[1] == c[k]


def test_vector_links_lose_none(spark):
    import numpy as np

    from legajo.operators import vectors

    rng = np.random.default_rng(11)
    base = rng.standard_normal((1200, 24))
    u = base / np.linalg.norm(base, axis=1, keepdims=True)
    off = rng.standard_normal(u.shape)
    off -= (off * u).sum(axis=1, keepdims=True) * u
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    m = np.vstack([u, 0.855 * u + np.sqrt(1 - 0.855**2) * off])  # 1,200 pairs just above the cosine
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, v array<double>")
    n = m / np.linalg.norm(m, axis=1, keepdims=True)
    close = (n @ n.T) >= 0.85
    np.fill_diagonal(close, False)
    got = {r["id"]: (r["links"], r["linked_to"]) for r in vectors.near_duplicates(df, "id", "v", 0.85).collect()}
    assert got == {i: (int(c.sum()), int(np.flatnonzero(c)[0])) for i, c in enumerate(close)}
    assert vectors.close_pairs(df, "id", "v", 0.85, sent=500).count() == close.sum() // 2


def test_synonyms_of_every_word(spark):
    from legajo.operators import passes

    near = [f"casa{c}" for c in "abcdefghijklmnopqrstuvwxyzabcdef"]
    rows = [(i, w + str(i), [1.0, 0.001 * i, 0.0]) for i, w in enumerate(near)] + [(100, "casa", [1.0, 0.0, 0.0]), (101, "hogar", [1.0, 0.3, 0.0]), (102, "lejos", [0.0, 0.0, 1.0])]
    got = passes.synonyms(spark.createDataFrame(rows, "id long, word string, v array<double>")).collect()
    assert [(r["synonym"], r["rank"]) for r in got if r["word"] == "casa"] == [("hogar", 1)]
    assert {r["word"] for r in got} == {w for _, w, _ in rows} - {"lejos"}
    docs = spark.createDataFrame([("La metodológica petición última llega pronto. " * 8,)], "text string")
    assert {"metodologica", "peticion", "ultima"} <= {r["word"] for r in passes.word_vectors(docs, "text").collect()}


def test_regex_entity_rows(spark, tmp_path):
    people = [f"Ana{c} Gil{c}" for c in "abcdefghijklmnopqrstuvwxyz"]
    firms = [f"Casa{c} S.L." for c in "abcdefghijklmnopqrst"]
    spark.createDataFrame([("d", ", ".join(people) + " y con " + "; ".join(firms))], "doc_id string, raw_text string").write.parquet(str(tmp_path / "documents_x.parquet"))
    got = core.queries()["regex_entity_rows"](spark, str(tmp_path)).collect()
    assert sorted(r["name"] for r in got if r["entity_type"] == "person") == people
    assert sorted(r["name"] for r in got if r["entity_type"] == "organization") == firms
