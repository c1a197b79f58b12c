"""Text functions as Column expressions; all of them run inside the JVM.

Null in gives null out unless stated otherwise.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value computed once a row, however often f uses it (inside a lambda function Spark would compute it anew for each element)."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


@lru_cache(maxsize=1)
def fold_table() -> tuple[str, str]:
    """Letters and signs up to U+04FF, U+1Exx and U+20xx to U+23xx whose compatibility form without marks is one other character."""
    a, b = [], []
    for cp in [*range(0xA0, 0x500), *range(0x1E00, 0x1F00), *range(0x2000, 0x2400)]:
        c = chr(cp)
        d = "".join(x for x in unicodedata.normalize("NFKD", c.lower()) if not unicodedata.combining(x))
        if len(d) == 1 and d != c.lower():
            for x in {c, c.lower()}:
                if len(x) == 1 and x not in a:
                    a.append(x), b.append(d)
    return "".join(a), "".join(b)


#: Signs that fold to several characters, fixed values of the compatibility decomposition.
EXPAND = (("ß", "ss"), ("½", "1⁄2"), ("¼", "1⁄4"), ("¾", "3⁄4"), ("…", "..."), ("œ", "oe"), ("æ", "ae"), ("™", "tm"))


def fold(c: Column) -> Column:
    """Lower case, without accents, white space collapsed and trimmed."""
    a, b = fold_table()
    c = F.translate(F.lower(c), a, b)
    for x, y in EXPAND:
        c = F.replace(c, F.lit(x), F.lit(y)) if x not in "œæ" else c
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\p{M}+", ""), r"\s+", " "))


def tokens(folded: Column) -> Column:
    """Runs of a-z, and numbers with thousands, decimals and a k, m or b suffix, of folded text."""
    return F.regexp_extract_all(folded, F.lit(r"([a-z]+|[0-9]+(?:[.,][0-9]+)*[kmb]?)"), F.lit(1))


def analyzed(folded: Column) -> Column:
    """Index terms: words of two characters or more, an inner dot kept, stop words dropped."""
    terms = F.regexp_extract_all(folded, F.lit(r"(\w+(?:\.?\w+)*)"), F.lit(1))
    return F.filter(terms, lambda t: (F.char_length(t) > 1) & ~t.isin(*STOP_WORDS))


#: English stop list of the index analyzer, fixed values.
STOP_WORDS = (
    "and", "is", "it", "an", "as", "at", "have", "in", "yet", "if", "from", "for", "when", "by", "to", "you", "be", "we", "that", "may", "not", "with", "tbd", "a", "on", "your", "this", "of", "us",
    "will", "can", "the", "or", "are",
)


def number_value(tok: Column) -> Column:
    """Canonical form of a number token: grouped thousands joined, k, m and b spelled out; other tokens as they are."""
    grouped = tok.rlike(r"^[0-9]{1,3}(?:[.,][0-9]{3})+$")
    suffix = F.substring(tok, -1, 1)
    body = F.replace(F.regexp_replace(tok, "[kmb]$", ""), F.lit(","), F.lit("."))
    scale = F.when(suffix == "k", 1_000).when(suffix == "m", 1_000_000).otherwise(1_000_000_000)
    expanded = F.round(body.try_cast("double") * scale).cast("long").cast("string")
    return F.when(grouped, F.regexp_replace(tok, "[.,]", "")).when(tok.rlike(r"^[0-9]+(?:[.,][0-9]+)?[kmb]$"), expanded).otherwise(tok)


def char_ngrams(folded: Column, n: int = 3) -> Column:
    """Character n-grams of the letters and digits of folded text; a shorter text is its own only one, an empty one has none."""

    def of(s: Column) -> Column:
        size = F.char_length(s)
        grams = F.transform(F.sequence(F.lit(1), size - (n - 1)), lambda i: F.substring(s, i, F.lit(n)))
        return F.when(s == "", F.array().cast("array<string>")).when(size < n, F.array(s)).otherwise(grams)

    return bind(F.regexp_replace(folded, "[^a-z0-9]", ""), of)


#: Long dashes, fixed values.
DASHES = "‐‑‒–—―⸺⸻﹘﹣－"


#: Page markers, numbers and rules on lines of their own in the order in which they are taken out, fixed values.
PAGE_MARKS = (
    r"[-=*_]{2,}\s*[Pp][aá]g(?:ina)?[s]?\s*[0-9]+(?:\s*(?:de|of)\s*[0-9]+)?\s*[-=*_]{0,10}", r"[Pp]ágina\s+[0-9]+(?:\s+de\s+[0-9]+)?", r"[Pp]age\s+[0-9]+(?:\s+of\s+[0-9]+)?",
    r"^\s*[0-9]{1,3}\s*$", r"^\s*[-=*_]{3,}\s*$",
)


def clean(c: Column) -> Column:
    """Index text: control characters, long dashes, URLs, e-mail addresses, page furniture and surplus white space go."""
    steps = (
        (r"[\p{Cc}\p{Cf}\p{Co}&&[^\n\r\t]]", ""), (f"[{DASHES}]", " "), (r"https?://[^\s]+|www\.[^\s]+", " "), (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", " "),
        (r"\n{3,}", "\n\n"), (r"[ \t]{2,}", " "), (r"[ \t]+\n", "\n"),
        *((f"(?md){p}", "") for p in PAGE_MARKS),
    )
    return F.regexp_replace(reduce(lambda x, s: F.regexp_replace(x, s[0], s[1]), steps, c), r"^\s+|\s+$", "")


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def emails(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(f"({EMAIL})"), F.lit(1))))


#: Month names and abbreviations with their numbers, fixed values.
MONTHS = {
    "enero": "01", "febrero": "02", "marzo": "03", "abril": "04", "mayo": "05", "junio": "06", "julio": "07", "agosto": "08", "septiembre": "09", "octubre": "10", "noviembre": "11", "diciembre": "12",
    "ene": "01", "feb": "02", "mar": "03", "abr": "04", "may": "05", "jun": "06", "jul": "07", "ago": "08", "sep": "09", "oct": "10", "nov": "11", "dic": "12",
}
MONTH_NAMES = tuple(MONTHS)[:12]
_MONTH = "|".join(MONTHS)
#: Days with slashes and dashes, days and months in words, years; fixed values.
DAY_SLASH, DAY_DASH = "([0-9]{1,2}/[0-9]{1,2}/[0-9]{4})", "([0-9]{1,2}-[0-9]{1,2}-[0-9]{4})"
DAY_TEXT = rf"(?i)([0-9]{{1,2}}\s+(?:de\s+(?:{_MONTH})\s+de|(?:{_MONTH})\s+de|(?:{_MONTH}))\s+[0-9]{{4}})"
MONTH_TEXT = rf"(?i)((?:{_MONTH})\s+(?:de\s+)?[0-9]{{4}})"
YEAR = r"\b((?:19|20)[0-9]{2})\b"


def _month(name: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in MONTHS.items() for x in kv)), F.lower(name))


def _day_month_year(d: Column) -> Column:
    p = "^([0-9]+)[/-]([0-9]+)[/-]([0-9]{4})$"
    return F.concat_ws("-", F.regexp_extract(d, p, 3), F.lpad(F.regexp_extract(d, p, 2), 2, "0"), F.lpad(F.regexp_extract(d, p, 1), 2, "0"))


def iso_date(d: Column) -> Column:
    """One stored date as ISO text: yyyy-mm-dd, yyyy-mm and yyyy as they are, days with slashes or dashes turned round, else null. The calendar is not checked."""
    d = F.trim(d)
    return F.when(d.rlike("^[0-9]{4}(?:-[0-9]{2}){0,2}$"), d).when(d.rlike(f"^(?:{DAY_SLASH}|{DAY_DASH})$"), _day_month_year(d))


def dates(c: Column) -> Column:
    """All dates of a text as sorted distinct ISO texts: days in figures and in words (with 'de' or without, months in full or cut to three letters), months (yyyy-mm), years."""
    found = lambda p: F.regexp_extract_all(c, F.lit(p), F.lit(1))
    year = lambda m: F.substring(m, -4, 4)
    day = lambda m: F.lpad(F.regexp_extract(m, "^([0-9]+)", 1), 2, "0")
    return F.array_sort(F.array_distinct(F.concat(
        found("([0-9]{4}-[0-9]{2}-[0-9]{2})(?=[^0-9]|$)"), F.transform(found(DAY_SLASH), _day_month_year), F.transform(found(DAY_DASH), _day_month_year),
        F.transform(found(DAY_TEXT), lambda m: F.concat_ws("-", year(m), _month(F.regexp_extract(m, r"(?i)^[0-9]+\s+(?:de\s+)?([a-z]+)", 1)), day(m))),
        F.transform(found(MONTH_TEXT), lambda m: F.concat_ws("-", year(m), _month(F.regexp_extract(m, "(?i)^([a-z]+)", 1)))), found(YEAR))))


PERSON = r"(?:^|[^A-Za-zÁÉÍÓÚÑÜáéíóúñü])([A-ZÁÉÍÓÚÑ][a-záéíóúñü]+ [A-ZÁÉÍÓÚÑ][a-záéíóúñü]+(?: [A-ZÁÉÍÓÚÑ][a-záéíóúñü]+)?)"
ORGANIZATION = r"([A-ZÁÉÍÓÚÑ][A-Za-zÁÉÍÓÚÑáéíóúñü&.]*(?: (?:de |y |del )?[A-ZÁÉÍÓÚÑ][A-Za-zÁÉÍÓÚÑáéíóúñü&]*){0,4},? (?:S\.L\.U\.|S\.L\.|S\.A\.|Inc\.|Ltd\.|GmbH|B\.V\.))"


def people(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(PERSON), F.lit(1))))


def organizations(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(ORGANIZATION), F.lit(1))))


#: Lines that are no title: page numbers, dates alone, marks of confidence; and rules. Fixed values.
NO_TITLE = (
    r"(?i)^[-=*_\s]*(?:p[aá]ginas?\s*[0-9]+(?:\s*(?:de|of)\s*[0-9]+)?[-=*_\s]*|page\s*[0-9]+(?:\s*of\s*[0-9]+)?|[0-9]+\s*/\s*[0-9]+|[0-9]{1,2}[/\-][0-9]{1,2}[/\-][0-9]{2,4}"
    r"|confidencial|privado|internal)\s*[-=*_]*\s*$|^[-=*_\s]{3,}$"
)


def title(text: Column, filename: Column) -> Column:
    """The first informative line (more than 3 characters, no number, page mark, date, rule or mark of confidence) if under 120 characters, without leading #; else the file name made readable."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x, F.lit(" \t\r\u000b\f")))
    first = F.get(F.filter(lines, lambda x: (F.char_length(x) > 3) & ~x.rlike("^[0-9]+$") & ~x.rlike(NO_TITLE)), F.lit(0))
    stem = F.translate(F.regexp_replace(filename, r"\.[^.]*$", ""), "_-", "  ")
    shown = F.array_join(F.transform(F.regexp_extract_all(stem, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1)), F.initcap), "")
    return F.when(F.char_length(first) < 120, F.trim(F.regexp_replace(first, "^#+", ""))).otherwise(shown)


def summary(text: Column, most: int = 3, head: int | None = None) -> Column:
    """The best sentences of a text, or of its head: long ones and early ones score; joined by '. '."""
    sentences = F.filter(F.transform(F.split(text if head is None else F.substring(text, 1, head), r"[.!?]\s+"), lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))), lambda s: F.char_length(s) > 30)

    def score(s: Column, i: Column) -> Column:
        n = F.size(F.split(s, " "))
        base = F.least(n, F.lit(40)) / F.lit(40.0) * F.when(n < 8, 0.3).otherwise(1.0)
        return F.struct((-(F.round(base + 1 / (1 + 0.3 * i), 9))).alias("k"), s.alias("s"))

    best = F.slice(F.array_sort(F.transform(sentences, score)), 1, most)
    return F.array_join(F.transform(best, lambda x: x["s"]), ". ")


#: File name and content rules of the document types in their order, fixed values; a name rule lists words that must all be there.
NAME_RULES = (
    ("acta_reunion", ("acta", "reunion")), ("memo", ("memo",)), ("factura", ("factura",)), ("factura", ("invoice",)), ("contrato", ("contrato",)), ("contrato", ("nda",)), ("listado", ("proveedores",)),
    ("documento", ("ficha",)), ("documento", ("manual",)), ("documento", ("catalogo",)), ("tabla", ("presupuesto",)), ("tabla", ("nomina",)), ("informe", ("informe",)), ("informe", ("auditoria",)),
    ("documento", ("certificado",)), ("documento", ("pliego",)), ("documento", ("licitacion",)), ("factura", ("pedido",)), ("factura", ("order",)), ("contrato", ("offer",)), ("contrato", ("propuesta",)),
)
TEXT_RULES = (
    ("acta_reunion", r"acta de reuni[oó]n|sprint review|sprint #[0-9]+"), ("memo", "memorándum|memorando|circular interna"), ("email", r"(?md)^de:\s*.+\n.*para:"), ("factura", r"base imponible|n\.?º\s*factura|importe total"),
    ("contrato", r"cláusula\s+[0-9]|firmado por ambas|las partes acuerdan"), ("listado", "listado de proveedores|rating:|cif:"),
)
#: Classes of tables by the columns they have, first match wins, fixed values.
TABLE_RULES = (("tickets", ("id_ticket",)), ("inventario", ("id_equipo",)), ("ventas", ("vendedor", "precio_unitario")))


def doc_class(filename: Column, text: Column) -> Column:
    """Document type by the first rule that fits: the file name's, then the content's, else documento."""
    name, body = F.lower(filename), F.lower(text)
    c = F.when(F.lit(False), F.lit(""))
    for kind, words in NAME_RULES:
        c = c.when(reduce(lambda a, b: a & b, (F.contains(name, F.lit(w)) for w in words)), kind)
    for kind, p in TEXT_RULES:
        c = c.when(body.rlike(p), kind)
    return c.otherwise("documento")


def table_class(columns: Column) -> Column:
    """Class of a table by its column names (an array): tickets, inventario, ventas, else tabla."""
    names = F.transform(columns, lambda x: F.trim(F.lower(x), F.lit(" \t\r\"\ufeff")))
    c = F.when(F.lit(False), F.lit(""))
    for kind, any_of in TABLE_RULES:
        c = c.when(F.arrays_overlap(names, F.array(*map(F.lit, any_of))), kind)
    return c.otherwise("tabla")


#: Frequent function words by language, fixed values.
FUNCTION_WORDS = {
    "es": ("el", "la", "los", "las", "de", "del", "en", "y", "que", "un", "una", "con", "por", "para", "se", "al", "lo", "su"),
    "ca": ("el", "la", "els", "les", "de", "del", "en", "i", "que", "un", "una", "amb", "per", "al", "dels", "és", "perquè", "durant"),
    "en": ("the", "of", "and", "to", "in", "is", "a", "that", "for", "with", "on", "by", "at", "an", "be", "this", "while", "from"),
}


def language(text: Column, head: int | None = None) -> Column:
    """Language by a vote of function words in a text, or in its head; ties and silence go to es, then ca."""
    words = F.regexp_extract_all(F.lower(text if head is None else F.substring(text, 1, head)), F.lit(r"([a-zàèéíòóúçñ]+)"), F.lit(1))
    votes = {k: F.size(F.filter(words, lambda w, k=k: F.array_contains(F.array(*map(F.lit, v)), w))) for k, v in FUNCTION_WORDS.items()}
    return F.when((votes["es"] >= votes["ca"]) & (votes["es"] >= votes["en"]), "es").when(votes["ca"] >= votes["en"], "ca").otherwise("en")


#: Category of a document type, fixed values.
CATEGORIES = {"acta_reunion": "Reuniones", "email": "Comunicaciones", "memo": "Recursos Humanos", "contrato": "Legal", "factura": "Finanzas", "listado": "Compras", "tickets": "Soporte", "inventario": "IT", "informe": "Informes"}


def category(doc_type: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in CATEGORIES.items() for x in kv)), F.coalesce(doc_type, F.lit(""))), F.lit("General"))


def noisy(c: Column) -> Column:
    """Whether a query looks mistyped: many signs, a long run of one letter or of consonants, letters mixed with digits."""
    f = fold(c)
    signs = F.char_length(F.regexp_replace(f, "[a-z0-9 ]", "")) / F.greatest(F.lit(1), F.char_length(f))
    long = F.exists(F.split(f, " "), lambda t: (
        ((F.char_length(t) >= 9) & t.rlike(r"([a-z])\1\1")) | ((F.char_length(t) >= 10) & t.rlike("[bcdfghjklmnpqrstvwxyz]{6,}"))
        | ((F.char_length(t) >= 7) & t.rlike("[a-z]") & t.rlike("[0-9]") & (F.char_length(F.regexp_replace(t, "[^0-9]", "")) <= 0.5 * F.char_length(t)))))
    return (signs >= 0.12) | long


def table_name(filename: Column) -> Column:
    """A file name as a table name."""
    s = F.regexp_replace(filename, r"\.[^.]*$", "")
    s = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "[^A-Za-z0-9_]", "_"), "_+", "_"), "^_+|_+$", ""))
    return F.when(s.rlike("^[0-9]"), F.concat(F.lit("t_"), s)).otherwise(s)


def file_id(filename: Column) -> Column:
    return F.substring(F.md5(filename.cast("binary")), 1, 12)


#: Spanish words that say nothing by themselves, fixed values, folded; queries and highlights leave them out.
QUERY_STOP_WORDS = (
    "el", "la", "los", "las", "un", "una", "unos", "unas", "a", "ante", "bajo", "con", "contra", "de", "desde", "en", "entre", "hacia", "hasta", "para", "por", "segun", "sin", "sobre", "tras", "durante", "mediante", "via",
    "y", "e", "ni", "o", "u", "pero", "sino", "aunque", "si", "que", "como", "cuando", "donde", "pues", "ya", "porque", "yo", "tu", "ella", "nosotros", "vosotros", "ellos", "me", "te", "se", "nos", "os", "le", "les", "lo",
    "este", "esta", "estos", "estas", "ese", "esa", "esos", "esas", "es", "son", "era", "fue", "ser", "estar", "hay", "ha", "han", "he", "hemos", "sido", "tiene", "tienen", "al", "del", "no", "mas", "muy", "tan", "tanto",
    "cada", "todo", "toda", "todos", "todas", "otro", "otra", "sus", "su", "mi", "mis", "tus", "nuestro",
)


def query_words(query: Column) -> Column:
    """The words of a query (cut at white space) that are no stop words; none where all are."""
    return F.filter(F.split(F.trim(query), r"\s+"), lambda w: (w != "") & ~fold(w).isin(*QUERY_STOP_WORDS))


def fold_letters(c: Column) -> Column:
    """Lower case without accents, letter by letter, so that places stay those of the original (signs that fold to several characters are left)."""
    a, b = fold_table()
    return F.translate(F.lower(c), a, b)


def highlight(text: Column, query: Column, context: int = 200) -> Column:
    """The text around the first place of any word of a query (three letters or more, no stop word), the words marked by **, ellipses at the cuts.

    Where no word stands as it is typed, its folded form is looked for in the folded text, then the query's
    3-grams in their order; where nothing is found, or no word is left, it is the head of the text. Null and empty texts give an empty one.
    """
    words = F.transform(F.filter(query_words(query), lambda w: F.char_length(w) > 2), lambda w: F.lower(w))
    place = lambda c, body: F.call_function("locate", c, body)
    places = lambda body, needles: F.filter(F.transform(needles, lambda w: place(w, body)), lambda i: i > 0)
    typed = bind(F.lower(text), lambda body: F.array_min(places(body, words)))
    folded = bind(fold_letters(text), lambda body: F.coalesce(F.array_min(places(body, F.transform(words, fold))), F.get(places(body, char_ngrams(fold(query))), F.lit(0))))

    def around(first: Column) -> Column:
        start = F.greatest(F.lit(1), first - context // 2)
        end = F.least(F.char_length(text), first - 1 + context)
        cut = F.concat(F.when(start > 1, "...").otherwise(""), F.substring(text, start, end - start + 1), F.when(end < F.char_length(text), "...").otherwise(""))
        return F.aggregate(words, cut, lambda s, w: F.regexp_replace(s, F.concat(F.lit(r"(?iu)\Q"), F.replace(w, F.lit(r"\E"), F.lit("")), F.lit(r"\E")), F.lit("**$0**")))

    head = F.concat(F.substring(text, 1, context), F.when(F.char_length(text) > context, "...").otherwise(""))
    return F.when(F.coalesce(F.char_length(text), F.lit(0)) == 0, "").when(F.size(words) == 0, head).otherwise(bind(F.coalesce(typed, folded, F.lit(1)), around))


def split_list(c: Column) -> Column:
    """'a, b, c' as a list, trimmed, without empty parts; null and empty give an empty list."""
    return F.coalesce(F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != ""), F.array().cast("array<string>"))


#: Words by which a query shows that it asks for more than a name, fixed values.
QUESTION_WORDS = (
    "qué", "que", "cuál", "cual", "cómo", "como", "dónde", "donde", "cuándo", "cuando", "quién", "quien", "cuánto", "cuanto", "por", "hay", "existe", "tiene", "puede", "dame", "dime", "busca", "muéstrame", "listar", "informe", "reporte",
)


def looks_like_name(query: Column) -> Column:
    """Two to four words, each with a capital first and not all in capitals, none of them a question word."""
    words = F.split(F.trim(query), r"\s+")
    title = F.forall(words, lambda w: (F.upper(F.substring(w, 1, 1)) == F.substring(w, 1, 1)) & (F.lower(F.substring(w, 1, 1)) != F.substring(w, 1, 1)) & (F.upper(w) != w))
    return F.coalesce(F.size(words).between(2, 4) & title & ~F.exists(words, lambda w: F.lower(w).isin(*QUESTION_WORDS)), F.lit(False))


def row_text(columns: list[str]) -> Column:
    """'col: value | col: value' of the columns that are not null."""
    return F.concat_ws(" | ", *(F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in columns))
