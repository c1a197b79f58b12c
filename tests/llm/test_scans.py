import random

from legajo.llm import scans as S

CLEAN = "La válvula del almacén necesita una garantía reciente. El plan técnico-comercial compara el coste-beneficio del aparcamiento.\nLa encuesta de la oficina confirma el mantenimiento de la campaña.\n"
SCAN = """Compras / Documento interno
La válvula del aparca-
miento necesita una g@rantía recien¬
te. El plan técnico-
comercial compara el coste-beneficio del alrnacén.

Página 1 de 2
Compras / Documento interno
La encuesfa de la ofi-

Página 2 de 2
Compras / Documento intern0
cina confirma el plan PO-
2024-0001 y la campafia 5egún.

Título sin punto

Otro párrafo.

Lectura del contador:
188
"""
WANT = {
    (1, "furniture"), (7, "furniture"), (8, "furniture"), (11, "furniture"), (12, "furniture"), (2, "hyphen"), (3, "hyphen"), (9, "hyphen"), (3, "misread"), (5, "misread"), (9, "misread"), (14, "misread"),
}


def frame(spark):
    rows = [(f"c{i}", CLEAN + "Según la campaña y la oficina.\n") for i in range(16)] + [("s", SCAN), ("s2", SCAN), ("n", None), ("e", ""), (None, SCAN), ("num", "Total:\n12\nfin")]
    rows.append(("bare", "Texto claro de la oficina\n\n3\nmás texto\n\n4\nfin"))
    return spark.createDataFrame(rows, "doc_id string, text string").selectExpr("*", "1 as line", "2 as word")


def test_noise(spark):
    got = {}
    for r in S.noise_lines(frame(spark)).collect():
        got.setdefault(r["doc_id"], set()).add((r["line_no"], r["noise"]))
    assert got["s"] == WANT and got["s2"] == WANT and set(got) == {"s", "s2", "bare"} and got["bare"] == {(3, "furniture"), (6, "furniture")}
    assert S.noise_lines(frame(spark).limit(0)).count() == 0


def test_repair(spark):
    got = {r["doc_id"]: r["text"] for r in S.repair_texts(frame(spark)).collect()}
    assert set(got) == {"s", "s2", "bare"}
    assert got["s"].startswith("La válvula del aparcamiento necesita una garantía reciente. El plan técnico-comercial compara el coste-beneficio del almacén.\n\nLa encuesta de la oficina confirma el plan PO-")
    assert "\n\nTítulo sin punto\n\nOtro párrafo.\n\n" in got["s"]
    assert "Página" not in got["s"] and "interno" not in got["s"] and "y la campaña" in got["s"]


def test_forms_of_the_corpus(spark):
    """A page line of no listed shape is found by its masked form: it repeats within texts and stands inside sentences; list entries and openings of sentences do not."""
    r = random.Random(4)
    words = "la bomba de la planta necesita una pieza nueva y el taller la pide al almacén central para montar línea en otoño".split()

    def text(k):
        body = [" ".join(r.choice(words) for _ in range(6)) for _ in range(16)]
        for n, i in enumerate((12, 9, 6, 3)):
            if i % 2:  # a page may also end with a sentence
                body[i - 1], body[i] = body[i - 1] + ".", body[i].capitalize()
            body.insert(i, f"tomo {k} hoja {4 - n} del legajo")
        return "\n".join(body)

    lists = "\n".join(f"Pieza {i}: llave\nPrecio: {i} euros" for i in range(6))
    rows = [(f"t{k}", text(k)) for k in range(4)] + [("lista", lists)]
    got = {(r["doc_id"], r["line_no"]) for r in S.noise_lines(spark.createDataFrame(rows, "doc_id string, text string")).filter("noise = 'furniture'").collect()}
    assert {(f"t{k}", n) for k in range(4) for n in (4, 8, 12, 16)} == got


def test_neighbours_decide(spark):
    """Two printed forms are as near to what was read; the words beside it tell which. A word that a clean text holds once is suspected where scans show it over and over."""
    page = "Página 1 de 2"
    clean = ["la muda de la tienda queda lista hoy."] * 9 + ["la rueda gira en el eje y la nuda pasa."] * 9 + ["el coste de la planta sube hoy."] * 60 + ["El c0ste baja."]
    scan = lambda i, x: (f"s{i}", f"{page}\nla muda de la tienda queda lista hoy\nel coste de la planta {i} sube\n{x}")
    rows = [(f"c{i}", t) for i, t in enumerate(clean)] + [scan(i, f"el c0ste de la planta {i + 20} sube") for i in range(12)]
    vocab, lines = S.read_scans(spark.createDataFrame(rows, "doc_id string, text string"))
    words = S.line_words(S.cut_words(lines, vocab))
    assert ("c0ste", "coste") in {(r["word"], r["printed"]) for r in S.misread_words(words, vocab).collect()}
    cases = spark.createDataFrame([("rnuda", "muda"), ("rnuda", "nuda")], "word string, printed string")
    near = spark.createDataFrame([("rnuda", "la", "de", 1), ("muda", "la", "de", 2), ("muda", "la", "de", 3), ("nuda", "la", "pasa", 4)], "word string, before string, after string, ctx long")
    got = {r["printed"]: r["support"] for r in S._support(near, cases).collect()}
    assert got["muda"] > got["nuda"] > 0


def test_changes():
    assert S.changes("garantía", "g@rantía") == (1,) and S.changes("almacén", "alrnacén") and S.changes("incluye", "induye") and S.changes("nómina", "nómma") and S.changes("solicitó", "sohcitó")
    assert S.changes("casa", "casa") is None and S.changes("casa", "cosa") is None
    for a, b in S.CONFUSED:
        assert S.skeleton(a) == S.skeleton(b) or b in "zq", (a, b)


def test_any_number_of_confusions():
    from legajo.llm.scans import changes

    assert changes("mínimamente", "mínimamente") is None
    assert len(changes("mammamia", "rnarnrnarnia")) == 4
    assert changes("casa", "mesa") is None


def test_frequent_words_go_no_further(spark):
    """p7_found's CPU seconds: rows of words that can't be suspects are left behind at once, and words are read off the lines without a second window."""
    from legajo.session import materialize

    clean = [(f"c{i}", "el coste de la planta sube hoy.") for i in range(60)]
    scans = [(f"s{i}", f"Página 1 de 2\nel c0ste de la planta {i} sube en la fac-\ntoría") for i in range(12)]
    vocab, lines = S.read_scans(spark.createDataFrame(clean + scans, "doc_id string, text string"))
    cut = materialize(S.cut_words(lines, vocab), "cut")
    words = S.line_words(cut)
    plan = words._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan
    words = materialize(words, "words")
    rows = S.suspect_rows(words, vocab)
    assert {r["word"] for r in rows.collect()} == {"c0ste", "en", "factoría"} and rows.count() == 36 and words.count() == 108
    assert {(r["word"], r["printed"]) for r in S.misread_words(words, vocab, rows).collect()} == {("c0ste", "coste")}


def test_kept_forms():
    """Lines masked together, words looked up and lines without blanks at their ends come out as each by itself."""
    text = "Acta / Núm 12\n-- Page 3 --\nlos ΣΑΣ 4: AB-20-301 cortan\nla l1nea\nActa / Núm 13\ny siguen\nActa / Núm 13"
    lines, own, masks, sure = S.mark(text)
    assert sure and own == [False, True, False, False, True, False, True] and masks == [S.mask(x) for x in lines]
    padded = S.mark("\n".join(f" \t{x} \r" for x in text.split("\n")))
    assert padded[1:] == (own, masks, sure)
    assert masks[0] == masks[4] == S.skeleton("acta / núm #") and masks[2] == S.skeleton("los σας #: code cortan")
    from collections import Counter

    raw = ["casa,", "casa", "Casa.", "http:", "www", "www.a.es", "12,5", "a@b.es", "plan-marco", "(x1y)", "A1", "5egún"]
    out = Counter()
    S._count_words(Counter(raw), False, out)
    assert out == {("w", "casa"): 2, ("c", "casa"): 1, ("w", "www"): 1, ("t", "plan-marco"): 1, ("w", "plan"): 1, ("w", "marco"): 1, ("w", "x1y"): 1}
