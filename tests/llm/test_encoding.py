import pytest

from legajo.llm import encoding as E

CLEAN = ["La conexión del técnico está dañada según el informe", "Petición de portátil — REF-2024-1", "La campaña de la válvula más rápida", "El señor técnico pidió la conexión"]
GOOD = ["Distribuições Âmbar & Irmãos pidió ½ pulgada y ±4 °C", "El menú ├─ datos └─ copias", "Se pagó £8 y ¥13; ¼ queda", "«FORÊT» château", "plain ascii"]


def misread(t, w, r):
    return t.encode(w).decode(r, "replace")


BAD = [misread(CLEAN[0], "utf-8", "latin-1"), misread(CLEAN[2], "utf-8", "cp850"), misread(CLEAN[3], "cp1252", "mac_roman"), misread(CLEAN[2], "cp1252", "cp1251"), misread(misread(CLEAN[0], "utf-8", "latin-1"), "utf-8", "latin-1"), misread(CLEAN[0], "cp1252", "utf-8")]


def frame(spark):
    rows = [("t", f"c{i}-{k}", t) for k in range(4) for i, t in enumerate(CLEAN)] + [("t", f"g{i}", t) for i, t in enumerate(GOOD)]
    rows += [("t", f"b{i}", t) for i, t in enumerate(BAD)] + [("t", "null", None), ("t", "empty", ""), ("u", "b0", BAD[0]), ("t", "b0", BAD[0]), ("t", "new", "un garañón".encode().decode("latin-1"))]
    return spark.createDataFrame(rows, "tabla string, rec_id string, text string").selectExpr("*", "1 as token", "2 as n", "3 as fixes")


def test_found(spark):
    got = {(r["tabla"], r["rec_id"]) for r in E.garbled_records(frame(spark)).collect()}
    assert got == {("t", f"b{i}") for i in range(len(BAD))} | {("u", "b0"), ("t", "new")}
    assert E.garbled_records(frame(spark).limit(0)).count() == 0


def test_restored(spark):
    got = {(r["tabla"], r["rec_id"]): r["restored"] for r in E.restore_records(frame(spark).filter("rec_id != 'b0' or tabla = 'u'")).collect()}
    assert got["u", "b0"] == CLEAN[0] and got["t", "b1"] == CLEAN[2] and got["t", "b2"] == CLEAN[3] and got["t", "b3"] == CLEAN[2] and got["t", "b4"] == CLEAN[0] and got["t", "b5"] == CLEAN[0]


@pytest.mark.parametrize("word", ["conexión", "año", "señal", "más", "—"])
def test_forms_hold_every_chain(word):
    forms = E.garbled_forms(word)
    assert misread(word, "utf-8", "latin-1") in forms and word not in forms
