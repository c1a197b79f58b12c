"""Text rules against rows written out by hand from the rules themselves, not from the operators."""

import pytest
from pyspark.sql import functions as F

from legajo.functions import text as T
from legajo.plans.details import number_stream


def one(spark, f, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(f(*(F.col(f"c{i}") for i in range(len(values)))).alias("x")).first()["x"]


@pytest.mark.parametrize("text, want", [
    ("10 enero 2025 y 3 ene 2024 y mar de 2023", ["2023", "2023-03", "2024", "2024-01", "2024-01-03", "2025", "2025-01", "2025-01-10"]),
    ("31/02/2024, 1-9-2023 y 2022-13-45", ["2022", "2022-13-45", "2023", "2023-09-01", "2024", "2024-02-31"]),
    ("el 5 de Mayo de 2021", ["2021", "2021-05", "2021-05-05"]),
    ("5 de mayo 2021", ["2021", "2021-05"]),
    ("DIC 2020", ["2020", "2020-12"]), ("sin fecha 3025", []), ("", []),
])
def test_dates(spark, text, want):
    assert one(spark, T.dates, text) == want


@pytest.mark.parametrize("raw, want", [("2024-05-06", "2024-05-06"), ("2024-05", "2024-05"), ("2024", "2024"), ("6/5/2024", "2024-05-06"), ("06-05-2024", "2024-05-06"), ("6 de mayo de 2024", None), ("", None)])
def test_stored_date(spark, raw, want):
    assert one(spark, T.iso_date, raw) == want


@pytest.mark.parametrize("name, text, want", [
    ("ficha_x.txt", "", "documento"), ("presupuesto.txt", "", "tabla"), ("acta_2024.txt", "", "documento"), ("Acta-Reunion.txt", "", "acta_reunion"), ("pedido_7.txt", "", "factura"), ("offer.txt", "", "contrato"),
    ("x.txt", "Sprint #12 de hoy", "acta_reunion"), ("x.txt", "hola\nDe: Ana\nPara: Luis", "email"), ("x.txt", "Importe total: 3", "factura"), ("x.txt", "Firmado por ambas partes", "contrato"), ("x.txt", "CIF: B1", "listado"), ("x.txt", "nada", "documento"),
])
def test_classes(spark, name, text, want):
    assert one(spark, T.doc_class, name, text) == want


def test_table_class(spark):
    of = lambda h: one(spark, lambda c: T.table_class(F.split(c, ",")), h)
    assert [of(h) for h in ("a, ID_Ticket ", "id_equipo,b", "x,Vendedor", "precio_unitario", "a,b")] == ["tickets", "inventario", "ventas", "ventas", "tabla"]


@pytest.mark.parametrize("text, want", [
    ("uno\nPágina 3\ndos", "uno\n\ndos"), ("--- Página 4 ---\nx", "x"), ("=== Pág. ===\nx", "=== Pág. ===\nx"), ("a\n== págs 2 de 3 ==\nb", "a\n\nb"), ("Page 2 of 9 fin", "fin"), ("a\n\n12\n\nb", "a\n\nb"), ("a\n-----\nb", "a\n\nb"), ("ver https://x.es/a y a@b.es ya", "ver y ya"),
])
def test_clean(spark, text, want):
    assert one(spark, T.clean, text) == want


@pytest.mark.parametrize("text, want", [
    ("CONFIDENCIAL\n12/03/2024\nPlan de obra", "Plan de obra"), ("\n--- Página 1 ---\n== Página 2 de 3\n3 / 7\n## Título\n", "Título"), ("***\n123\nabc\nLarga", "Larga"), ("x" * 130 + "\nCorta", "Acta De 2024"), ("", "Acta De 2024"),
])
def test_title(spark, text, want):
    assert one(spark, T.title, text, "acta_de-2024.txt") == want


@pytest.mark.parametrize("text, lang, keep, want", [
    ("una caja, dieciséis sillas y setze taules", None, False, "1 caja 16 sillas y 16 taules"), ("veinte y uno", None, False, "21"), ("trenta i dues", "ca", False, "30 i dues"), ("vint i u", "ca", False, "21"), ("setze", "es", False, "setze"),
    ("6k y 1.5m o 1.200,5", None, False, "6000 y 1500000 o 1.200,5"), ("cuarenta y dos de 10.000", None, True, "cuarenta y dos 42 de 10.000 10000"), ("", None, False, ""),
])
def test_numbers(spark, text, lang, keep, want):
    df = spark.createDataFrame([(text, lang)], "t string, l string")
    assert " ".join(df.select(number_stream(T.fold(F.col("t")), F.col("l"), keep).alias("x")).first()["x"]) == want


def test_highlight(spark):
    text = "x" * 300 + " la Reunión (final) del lunes " + "y" * 300
    got = one(spark, T.highlight, text, "reunión (final)")
    assert got.startswith("..." + "x" * 96 + " la **Reunión** **(final)** del lunes yyy") and got.endswith("y...") and len(got.replace("*", "")) == 3 + 100 + 200 + 3
    assert "**" not in one(spark, T.highlight, text, "reunion") and "la Reunión" in one(spark, T.highlight, text, "reunion")
    assert one(spark, T.highlight, "corto", "de la") == "corto" and one(spark, T.highlight, "", "hola") == ""
    assert "zanahoria" in one(spark, T.highlight, "a" * 400 + " zanahoria " + "b" * 300, "zanaboria")


def test_queries_and_lists(spark):
    assert one(spark, T.query_words, "el Informe de la Planta según") == ["Informe", "Planta"] and one(spark, T.query_words, "de la") == []
    assert [one(spark, T.looks_like_name, q) for q in ("Ana López", "ANA LÓPEZ", "Aurora", "Qué Informe", "Ana López Ruiz Gil Mas", "ana López")] == [True, False, False, False, False, False]
    assert one(spark, T.split_list, " a, b ,,c ") == ["a", "b", "c"] and one(spark, T.split_list, None) == []


def test_alike_names(spark):
    from difflib import SequenceMatcher

    from legajo.operators.graph import alike_names

    keys = ["marta soler", "marta solé", "marina soler vidal", "soler", "m. soler", "pere puig", "x" * 200, "grupo marta soler sl"]
    n = spark.createDataFrame([(k, 3) for k in keys], "key string, mentions int")
    got = {r["key"]: round(r["score"], 9) for r in alike_names(n, " Marta SOLER ").collect()}
    ratio = lambda k: SequenceMatcher(None, "marta soler", k).ratio()
    assert got == {k: 1.03 if "marta soler" in k else round(ratio(k), 9) for k in keys if "marta soler" in k or ratio(k) > 0.6}
    assert alike_names(n.limit(0), "x").count() == 0


def test_search_in_parts(spark, monkeypatch):
    import numpy as np

    from legajo.operators import vectors

    rows = [(i, v.tolist()) for i, v in enumerate(np.random.default_rng(3).standard_normal((300, 8)))]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    whole = sorted(map(tuple, vectors.block_search(df, "id", "v", df.filter("id % 5 = 0"), 4).select("query", "id", "rank").collect()))
    monkeypatch.setattr(vectors, "AT_ONCE", 7)
    parts = sorted(map(tuple, vectors.block_search(df, "id", "v", df.filter("id % 5 = 0"), 4, block=23).select("query", "id", "rank").collect()))
    assert whole == parts and len(whole) == 240


def test_group_labels(spark):
    from legajo.operators.clusters import group_labels

    rows = [
        ("a", None, "General", "Plan de obra norte", ["x"]), ("a", "documento", "", "Obra del plan", []), ("a", "documento", None, "otra cosa", None),
        ("b", "documento", "Ventas", "uno", []), ("b", "documento", "Compras", "dos", []),
        ("c", "documento", None, None, ["riesgo", " Riesgo ", "acero"]), ("d", None, None, None, None),
        ("e", "acta_reunion", "Obras", "t", []), ("e", "documento", "Obras", "t", []), ("f", "acta_reunion", None, "t", []), (None, "email", "Obras", "t", []),
    ]
    df = spark.createDataFrame(rows, "g string, doc_type string, category string, title string, keywords array<string>")
    got = {r["grp"]: r["label"] for r in group_labels(df, "g").collect()}
    assert got == {"a": "Obra · Plan", "b": "Compras / Ventas", "c": "Riesgo · Acero", "d": "Documentos varios", "e": "Obras — Acta Reunion", "f": "Acta Reunion"}
    assert group_labels(df.limit(0), "g").count() == 0
