from legajo.llm import mail as M

TEXT = """De: Ana López Gil <a.lopez@x.example>
Para: Luis <l@x.example>
Asunto: Re: prueba

Hola Luis,

De: las dos opciones, prefiero la segunda.
Un saludo del equipo no basta.
> línea citada
> otra
Respondo aquí en medio.

El 3 de mayo de 2024,
Luis <l@x.example>
escribió:
> más texto

Un saludo,
--
Ana López Gil
Jefatura de Planta
Tel. 555 11 22 ext. 333

P.D. No olvides la llave.

********************
AVISO LEGAL: Este mensaje y sus adjuntos van dirigidos exclusivamente a su destinatario
y pueden contener información confidencial.

----- Mensaje original -----
De: Luis
Para: Ana

Texto antiguo sin marcas.
"""
NEW = [5, 7, 8, 11, 24]


def frame(spark, sf, extra=()):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents_x.parquet").select("doc_id", "raw_text")
    rows = [("mio", TEXT), ("nulo", None), ("vacio", ""), ("memo", "MEMORANDO\n\nDe: Ana\nPara: Luis\n\nTexto."), ("solo", "De: Ana\nPara: Luis\nAsunto: nada"), *extra]
    return docs.unionByName(spark.createDataFrame(rows, "doc_id string, raw_text string"))


def test_new_lines(spark, sf):
    got = M.new_lines(frame(spark, sf)).collect()
    mine = sorted(r["line_no"] for r in got if r["doc_id"] == "mio")
    assert mine == NEW
    assert not {"nulo", "vacio", "memo", "solo"} & {r["doc_id"] for r in got}


def test_repeats_long_and_empty(spark, sf):
    long = TEXT.replace("Respondo aquí en medio.", "\n".join(["Una línea más de respuesta, con su punto final."] * 3000))
    df = frame(spark, sf, [("mio", TEXT), ("largo", long)]).selectExpr("doc_id", "raw_text", "1 as label", "2 as line_no")
    got = M.new_lines(df).collect()
    assert sum(r["doc_id"] == "mio" for r in got) == 2 * len(NEW)
    assert sum(r["doc_id"] == "largo" for r in got) == len(NEW) - 1 + 3000
    assert M.new_lines(df.limit(0)).count() == 0


INDENTED = """From: Lucia Mas <l.mas@x.example>
To: Ana
Subject: Re: visita

Hi Ana,
I will be there at ten.
Bring the red folder, please.

Lucía

On Friday, 2024-12-24 at 8:50, Ana wrote:

\tCan you come on Monday?
\tThe plan is on the table.

Este correo es confidencial. Queda prohibida su copia o reenvío sin
permiso del remitente.
"""
FORWARDED = """De: Ana López Gil <a.lopez@x.example>
Para: Luis
Fecha: 2024-01-01

Te paso lo de abajo.
Mira sobre todo el precio.

Atentamente,
Ana

----- Mensaje reenviado -----
De: Pedro
Para: Ana

Buenos días,
El precio es alto.

Saludos,
Pedro
"""
#: Labels of the non-blank lines, by hand: h head, n new, q earlier message, s sign-off, d notice.
BY_HAND = ((TEXT, "hhhnnnqqnqqqqsssssnddd" "qqqq"), (INDENTED, "hhhnnnsqqqdd"), (FORWARDED, "hhhnnssqqqqqqq"))


def test_decoding_beats_the_seed_and_single_lines(spark):
    """Against labels given by hand: the seed knows few lines, each line by itself is wrong for some, the sequence is right for all."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents_x.parquet")
    model = M.train_lines(M.mails(docs))
    seed = alone = right = total = 0
    short = {"h": "header", "n": "new", "q": "quoted", "s": "signature", "d": "disclaimer"}
    for text, hand in BY_HAND:
        m = M.Mail(text)
        seen = m.observed()
        want = [M.LABELS.index(short[c]) for c in hand]
        assert len(want) == len(m.at)
        rule = [m.lines[i].strip("*- ") == "" for i in m.at]  # a rule belongs to what it parts off, whichever that is
        b = M.Batch([seen])
        best = [M.STATE_LABEL[s] for s in model.shown(b)[0].argmax(axis=1)]
        for y, s, a, v, r in zip(want, M.seed_labels(m), best, model.label([seen])[0], rule):
            total, seed, alone, right = total + 1, seed + (s == y), alone + (a == y), right + (v == y or r)
    assert seed < 0.6 * total and alone < 0.95 * total and right == total, (seed, alone, right, total)
