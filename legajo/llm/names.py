"""Problem 6: link typed names to a directory by equi-joins on canonical rewritings.

Every entry of the directory is rewritten by nickname, initial, shortening, legal-form and order rules, and each word of an
organisation's name by abbreviation rules; the rewritings are exploded and equi-joined with the typed names. A rewriting's price is
how rare it is, in bits: how many its rules make for an entry, counted in the exploded table, and how seldom they are what
typed names show, counted over the spellings that meet one entry only. The cheapest way to an entry wins; entries that share
it are weighed by how often each is written out in full.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import combinations, product

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from legajo.session import materialize, text_batches

#: Short and familiar forms of given names in Spanish and Catalan, by the folded full name; fixed values of general use, not taken from any directory.
NICKNAMES = {
    "adrian": ["adri"], "agustin": ["agus"], "alberto": ["alber", "berto", "beto", "tito", "albert"], "alejandra": ["alex", "jandra", "sandra"], "alejandro": ["alex", "ale", "jandro", "sandro"],
    "alfonso": ["fonso", "poncho"], "alfredo": ["fredo", "fredi"], "alicia": ["ali", "licia"], "alvaro": ["alvarito"], "amparo": ["ampa", "amparito"], "ana": ["anita", "anna"],
    "andres": ["andreu"], "angel": ["angelito", "lito"], "angeles": ["angelines", "geles"], "antonia": ["toñi", "toña", "antoñita"], "antonio": ["toni", "toño", "antoñito", "antoni"],
    "asuncion": ["asun", "choni"], "aurelio": ["yeyo"], "aurora": ["auri"], "bartolome": ["bartolo", "tomeu"], "beatriz": ["bea", "betty", "beatriu"], "begoña": ["bego"], "benito": ["beni"], "benjamin": ["benja"],
    "bernardo": ["berni", "nardo", "bernat"], "carlos": ["carlitos", "charly", "carles"], "carmen": ["mamen", "menchu", "carmela", "carme"], "carolina": ["carol", "caro"], "catalina": ["cata", "lina"],
    "cayetano": ["tano"], "cecilia": ["ceci"], "concepcion": ["concha", "conchi", "conchita"], "consuelo": ["chelo", "consu"], "cristina": ["cris", "tina"], "cristobal": ["tobal"], "daniel": ["dani"],
    "david": ["davi"], "diego": ["dieguito"], "dolores": ["lola", "loli", "lolita", "dolors"], "domingo": ["mingo", "txomin"], "eduardo": ["edu", "lalo", "eduard"], "elena": ["lena", "nena", "helena"], "elisa": ["eli"],
    "emilia": ["emi", "mili"], "emilio": ["emi", "milio"], "encarnacion": ["encarna", "encarni"], "enrique": ["quique", "kike", "quico", "enric"], "ernesto": ["neto"], "esperanza": ["espe"], "esteban": ["estebi", "esteve"],
    "estefania": ["estefi", "fani"], "eugenia": ["geni"], "eulalia": ["lali", "laia"], "eva": ["evita"], "federico": ["fede", "frederic"], "felipe": ["feli", "pipe", "felip"], "felix": ["feliu"], "fernando": ["fer", "nando", "fernan", "ferran"],
    "francisca": ["paqui", "paca", "quica", "fran"], "francisco": ["paco", "curro", "fran", "pancho", "kiko", "cisco", "francesc"], "gabriel": ["gabi", "biel"], "gema": ["gemi"], "gerardo": ["gera", "lalo"], "gertrudis": ["tula"], "gloria": ["glori"],
    "gonzalo": ["gonza", "chalo"], "gregorio": ["goyo", "gregori"], "guadalupe": ["lupe", "lupita", "guada"], "guillermo": ["guille", "memo", "willy", "guillem"], "hector": ["hec", "tito"], "hugo": ["hugui", "huguito"], "ignacio": ["nacho", "iñaki", "ignasi"],
    "inmaculada": ["inma", "macu", "ima"], "ines": ["agnes", "inesita"], "isabel": ["isa", "bel", "chabela", "isabelita"], "jaime": ["jaimito", "jaume"], "javier": ["javi", "xavi", "javito", "xavier"], "jesus": ["chus", "suso", "chuchi"], "joaquin": ["quino", "quim", "chimo", "joaqui", "joaquim"],
    "jorge": ["jordi", "coque", "yorch"], "jose": ["pepe", "pep", "josep", "pepito"], "jose antonio": ["josean", "toño"], "jose luis": ["joselu", "pepelu"], "jose manuel": ["josema", "chema", "manel"], "jose maria": ["chema", "josemari", "josep maria"], "jose ramon": ["joserra", "moncho"],
    "josefa": ["pepa", "pepi", "fina"], "juan": ["juanito", "juani", "joan"], "juan antonio": ["juanan"], "juan carlos": ["juanca", "juancar"], "juan francisco": ["juanfran"], "juan jose": ["juanjo"], "juan manuel": ["juanma"], "juana": ["juani", "juanita"], "julia": ["juli"], "julian": ["juli"],
    "laura": ["lau", "laurita"], "leonardo": ["leo"], "leticia": ["leti"], "lorenzo": ["loren", "llorenç"], "lourdes": ["lurdes", "lulu"], "lucia": ["lucy", "luci", "llucia"], "luis": ["lucho", "luisito", "lluis"], "luisa": ["lui", "luisita"], "magdalena": ["magda", "malena", "lena"],
    "manuel": ["manolo", "manu", "lolo", "manel"], "manuela": ["manoli", "manuelita"], "margarita": ["marga", "margui", "rita"], "maria": ["mari", "mariquita", "maruja"], "maria angeles": ["marian", "angelines"], "maria carmen": ["maricarmen", "mamen"], "maria dolores": ["mariloli", "lola", "maridol"], "maria isabel": ["maribel", "marisa", "mabel"],
    "maria jesus": ["chus", "mariaje"], "maria jose": ["mariajo", "majo", "coti"], "maria luisa": ["marisa", "malu", "marilu"], "maria pilar": ["mapi", "maripili"], "maria teresa": ["maite", "mayte", "maritere"], "maria victoria": ["marivi", "mavi"], "mariano": ["nano"], "marta": ["martita"], "matilde": ["mati"],
    "mercedes": ["merche", "merce", "meche"], "miguel": ["migue", "miki", "miquel"], "miguel angel": ["migue"], "milagros": ["mila", "mili"], "monica": ["moni"], "montserrat": ["montse", "monse", "rat"], "natalia": ["nati", "nata", "talia"], "natividad": ["nati"], "nicolas": ["nico", "colas"], "nuria": ["nuri"], "oscar": ["osqui", "osquitar"],
    "pablo": ["pablito", "pau"], "patricia": ["patri", "pati"], "pedro": ["perico", "pedrito", "pere"], "pilar": ["pili", "piluca", "pilarin"], "purificacion": ["puri"], "rafael": ["rafa", "rafita", "fael"], "ramon": ["moncho", "mon"], "raquel": ["raque", "kel"], "remedios": ["reme"], "ricardo": ["richi", "ricky", "ricard"], "roberto": ["rober", "berto", "beto"], "rocio": ["chio"],
    "rodrigo": ["rodri"], "rosa": ["rosita", "rosi"], "rosa maria": ["rosamari", "romi"], "rosario": ["charo", "chari", "rosarito"], "ruben": ["rube"], "salvador": ["salva", "chava"], "santiago": ["santi", "yago", "chago", "jaume"], "sebastian": ["sebas"], "sergio": ["sergi", "checo"], "silvia": ["silvi"], "sofia": ["sofi", "chofi"], "soledad": ["sole", "chole"], "susana": ["susi"],
    "teresa": ["tere", "maite", "teresita"], "tomas": ["tomi", "tomasin"], "trinidad": ["trini"], "ursula": ["ursi", "urs"], "valentin": ["valen"], "vanesa": ["vane"], "veronica": ["vero"], "vicente": ["vicen", "chente", "tito", "vicent"], "victor": ["vic"], "victoria": ["vicky", "viky"], "virginia": ["virgi"], "yolanda": ["yoli", "yola"], "zaida": ["zai"],
}
#: Words that open a given name of two words.
_FIRST_OF_TWO = {"ana", "carlos", "francisco", "jose", "juan", "luis", "maria", "miguel", "rosa", "victor"}
TITLES = {"sr", "sra", "sra.", "dr", "dra", "ing", "lic", "don", "dona", "dna", "mr", "mrs", "ms", "sr/a", "dr/a", "d/dna", "prof"}
_LEGAL = re.compile(r"[ ,]*\b(?:s ?l ?u|s ?a ?u|s ?l ?l|s ?l|s ?a|ltd|ltda|inc|gmbh|b ?v|sociedad (?:limitada|anonima)(?: unipersonal)?|limited|s coop|c ?b)\s*$")
_SMALL = {"y", "de", "del", "la", "el", "los", "las", "i", "d"}
#: What is left of those when a letter is dropped, doubled or swapped.
_SMALL_TYPED = {"e", "dee", "dde", "ed"}
_VOWELS = set("aeiou")


def fold(s: str) -> str:
    s = unicodedata.normalize("NFKD", s.lower().replace("ª", "a"))
    return "".join(c for c in s if not unicodedata.combining(c))


_FOLDED = {k: [fold(x) for x in v] for k, v in NICKNAMES.items()}


def person_tokens(s: str) -> list[str]:
    s = fold(s)
    t = [x for x in re.split(r"[^0-9a-z/ñ]+", s.replace(".", " ").replace(",", " ")) if x]
    while len(t) > 1 and t[0] in TITLES:
        t = t[1:]
    return t


def strip_legal(s: str) -> str:
    s = re.sub(r"[.]", " ", fold(s))
    s = re.sub(r"\s+", " ", s).strip(" ,")
    return re.sub(_LEGAL, "", s).strip(" ,") or s


def organization_tokens(s: str) -> list[str]:
    t = [x for x in re.split(r"[^0-9a-z+]+", strip_legal(s)) if x and x not in _SMALL]
    return [x for i, x in enumerate(t) if not i or x not in _SMALL_TYPED]


def split_person(name: str) -> tuple[str, list[str]]:
    """Given name (one or two words) and surnames of a full official form: two surnames, or one after a given name of two words."""
    t = person_tokens(name)
    k = 2 if len(t) > 3 or (len(t) == 3 and t[0] in _FIRST_OF_TWO and t[1] in _FOLDED) else 1
    return " ".join(t[:k]), t[k:]


def given_forms(given: str) -> dict[str, str]:
    """{rewriting: rule} of a given name: as written, nickname, initial, cut, short."""
    parts = given.split()
    g = {given: ""}
    for x in _FOLDED.get(given, []):
        g.setdefault(x, "nickname")
    initials = " ".join(p[0] for p in parts)
    g.setdefault(initials, "initial")
    if len(parts) > 1:
        a, b = parts
        g.setdefault(a + b, "nickname")
        for x in _FOLDED.get(a, []):
            g.setdefault(f"{x} {b}", "nickname")
        for x in _FOLDED.get(b, []):
            g.setdefault(f"{a} {x}", "nickname")
            g.setdefault(a + x, "nickname")
        g.setdefault(initials.replace(" ", ""), "initial")
        g.setdefault(f"{a[0]} {b}", "initial")
        g.setdefault(f"{a} {b[0]}", "initial")
        g.setdefault(f"{a[:3]} {b[:3]}", "cut")
        g.setdefault(a[0], "initial+short")
        g.setdefault(a, "short")
    first, rest = parts[0], parts[1:]
    for n in range(2, min(6, len(first))):
        g.setdefault(" ".join([first[:n], *rest]), "cut")
        if rest:
            g.setdefault(" ".join([first, rest[0][:n]]), "cut")
            g.setdefault(first[:n], "cut+short")
    return g


def person_forms(name: str) -> dict[str, str]:
    """{canonical rewriting: rules}: nickname, initial, shortening and order rules; words in lower case without accents. The fewest rules lead to a form."""
    given, surnames = split_person(name)
    if not surnames:
        return {given: ""} if given else {}
    tails = [(surnames, ""), (surnames[:1], "one surname")]
    if len(surnames) > 1:
        tails += [([surnames[0], surnames[1][0]], "surname initial"), ([surnames[0][0], surnames[1]], "first surname initial"), (surnames[1:], "second surname")]
    else:
        tails = tails[:1]
    out: dict[str, str] = {}
    for (x, p), (t, q) in product(given_forms(given).items(), tails):
        for form, order in ((" ".join([x, *t]), ""), (" ".join([*t, x]), "order")):
            rules = "+".join(r for r in (p, q, order) if r)
            if form not in out or rules.count("+") + bool(rules) < out[form].count("+") + bool(out[form]):
                out[form] = rules
    return out


def organization_forms(name: str) -> dict[str, str]:
    """{canonical rewriting: rules}: legal form dropped, the proper word last or first."""
    t = organization_tokens(name)
    return {" ".join(t): "", " ".join([t[-1], *t[:-1]]): "order"} if len(t) > 1 else {x: "" for x in t}


def abbreviations(word: str) -> dict[str, str]:
    """{abbreviation: rule} of a word: cut off after any letter, or contracted to its head (or its first letter and one or two further consonants) and its last letters."""
    out = {word[:n]: "cut" for n in range(1, len(word))}
    consonants = [c for c in word[1:] if c not in _VOWELS]
    heads = {word[:n] for n in range(1, len(word) - 1)} | {word[0] + "".join(c) for k in (1, 2) for c in combinations(consonants, k)}
    for h in heads:
        for n in range(1, 5):
            x = h + word[-n:]
            if len(x) < len(word):
                out.setdefault(x, "contraction")
    return out


def directory_forms(nodes: DataFrame) -> DataFrame:
    """(form, node_key, kind, rules): every rewriting of every directory entry; (name, node_key, entity_type) in."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            rows = []
            for key, name, kind in zip(p["node_key"], p["name"], p["entity_type"]):
                forms = person_forms(name) if kind == "person" else organization_forms(name)
                rows += [(f, key, kind, c) for f, c in forms.items()]
            yield pd.DataFrame(rows, columns=["form", "node_key", "kind", "rules"])

    return nodes.select("node_key", "name", "entity_type").mapInPandas(run, "form string, node_key string, kind string, rules string")


def _price(n: Column) -> Column:
    """How rare one of n rewritings is, in bits."""
    return F.log2(1 + n)


def priced_forms(forms: DataFrame) -> DataFrame:
    """forms with bits: for each set of rules, how rare its rewritings are in the exploded table; a name as it is written costs nothing."""
    rate = forms.groupBy("kind", "rules").agg(_price(F.count(F.lit(1)) / F.countDistinct("node_key")).alias("bits"))  # a few dozen rows, the rules are fixed
    return forms.join(F.broadcast(rate), ["kind", "rules"]).withColumn("bits", F.when(F.col("rules") == "", 0.0).otherwise(F.round("bits", 6)))


def _abbreviated(forms: DataFrame) -> DataFrame:
    """(kind, word, fixed, bits): abbreviations of the words of organisations' names, the proper word left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            rows = [("organization", x, w, r) for w in p["fixed"] for x, r in abbreviations(w).items()]
            yield pd.DataFrame(rows, columns=["kind", "word", "fixed", "rule"])

    common = forms.filter("kind = 'organization' and rules = ''").select(F.explode(F.expr("slice(split(form, ' '), 1, size(split(form, ' ')) - 1)")).alias("fixed")).distinct()
    every = common.mapInPandas(run, "kind string, word string, fixed string, rule string")
    n = Window.partitionBy("fixed", "rule")
    return every.select("kind", "word", "fixed", F.round(_price(F.count(F.lit(1)).over(n)), 6).alias("bits"))


def _endings(typed: DataFrame, forms: DataFrame) -> DataFrame:
    """(kind, word, fixed, bits): words of organisations' names with another ending (up to four letters after a stem of five or more)."""
    common = forms.filter("kind = 'organization' and rules = ''").select("kind", F.explode(F.expr("slice(split(form, ' '), 1, size(split(form, ' ')) - 1)")).alias("word")).distinct()

    def stems(df: DataFrame, cut: int, name: str) -> DataFrame:
        long = df.filter("kind = 'organization' and char_length(word) > 5")
        return long.select("kind", F.col("word").alias(name), F.explode(F.expr(f"transform(sequence(1, least({cut}, char_length(word) - 5)), i -> left(word, char_length(word) - i))")).alias("stem"))

    met = stems(typed, 4, "word").join(stems(common, 3, "fixed"), ["kind", "stem"]).groupBy("kind", "word", "fixed").agg(F.max(F.char_length("stem")).alias("s"))
    return met.select("kind", "word", "fixed", F.round(_price(F.pow(F.lit(26.0), F.lit(2)) * (F.char_length("word") - F.col("s"))), 6).alias("bits"))


def _mention_words(mentions: DataFrame) -> DataFrame:
    """(nombre, kind, pos, n, word): the folded words of each distinct spelling."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            rows = []
            for name, kind in zip(p["nombre"], p["kind"]):
                t = person_tokens(name) if kind == "person" else organization_tokens(name)
                rows += [(name, kind, i, len(t), w) for i, w in enumerate(t)]
            yield pd.DataFrame(rows, columns=["nombre", "kind", "pos", "n", "word"])

    return mentions.mapInPandas(run, "nombre string, kind string, pos int, n int, word string")


def one_typo(a: str, b: str) -> Column:
    """At most one letter inserted, dropped, replaced or swapped with its neighbour, or ll typed as y, between columns a and b."""
    x, y = F.col(a), F.col(b)
    swapped = F.exists(
        F.sequence(F.lit(1), F.greatest(F.char_length(x) - 1, F.lit(1))),
        lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.lit(1)), F.substring(x, i, F.lit(1)), F.substring(x, i + 2, F.char_length(x))) == y)
    far = F.levenshtein(x, y, 2)
    return (F.replace(x, F.lit("y"), F.lit("ll")) == y) | F.when(far.between(0, 1), True).otherwise((far == 2) & (F.char_length(x) == F.char_length(y)) & swapped)


def _word_forms(words: DataFrame) -> DataFrame:
    """(kind, word, del): a word of three letters or more with each single letter dropped, as it is, and with y spelled out as ll."""
    drops = F.transform(F.sequence(F.lit(1), F.char_length("word")), lambda i: F.concat(F.substring("word", F.lit(1), i - 1), F.substring("word", i + 1, F.char_length("word"))))
    every = F.concat(drops, F.array(F.col("word"), F.replace("word", F.lit("y"), F.lit("ll"))))
    return words.filter("char_length(word) >= 3").select("kind", "word", F.explode(F.array_distinct(every)).alias("del"))


def _typos(typed: DataFrame, known: DataFrame) -> DataFrame:
    """(kind, word, fixed, bits): words typed that are one typo away from a known word. Only words of three letters or more have typos."""
    longest = known.groupBy("kind").agg((F.max(F.char_length("word")) + 1).alias("longest"))  # a row for each kind; what is longer is two typos away
    typed = typed.join(F.broadcast(longest), "kind").filter("char_length(word) <= longest").select("kind", "word")
    near = _word_forms(typed).join(_word_forms(known).withColumnRenamed("word", "fixed"), ["kind", "del"]).select("kind", "word", "fixed").distinct().filter(one_typo("word", "fixed"))
    # A letter in or over 26 at each place, or one dropped or swapped: so many words are one typo away.
    return near.withColumn("bits", F.round(_price(54 * F.char_length("fixed")), 6))


def compact(name: str, kind: str) -> str:
    """The letters of a name alone, without its legal form: what is left when a blank was missed, moved or hit as a letter."""
    return re.sub(r"[^0-9a-zñ]", "", " ".join(person_tokens(name)) if kind == "person" else strip_legal(name))


def _whole_names(mentions: DataFrame, nodes: DataFrame) -> DataFrame:
    """(nombre, kind, node_key, bits) of spellings that are one typo away from a full name once blanks are left out."""

    def squeeze(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            p = p.copy()
            p["word"] = [compact(n, k) for n, k in zip(p["nombre"], p["kind"])]
            yield p

    typed = mentions.mapInPandas(squeeze, "nombre string, kind string, word string")
    full = nodes.select(F.col("name").alias("nombre"), F.col("entity_type").alias("kind"), "node_key").mapInPandas(squeeze, "nombre string, kind string, node_key string, word string")
    pairs = _typos(typed.select("kind", "word").distinct(), full.select("kind", "word").distinct())
    return typed.join(pairs, ["kind", "word"]).join(full.select("kind", F.col("word").alias("fixed"), "node_key"), ["kind", "fixed"]).select(
        "nombre", "kind", "node_key", (F.col("bits") + 1).alias("bits"))


def link_mentions(mentions: DataFrame, nodes: DataFrame) -> DataFrame:
    """(nombre, kind, node_key, bits, rarity, rules) for each distinct spelling (nombre, kind, n) that means a directory entry.

    1. Every rewriting of every entry is written out (nickname, initial, shortening, legal form, order), with the
       price of its rules.
    2. The words of a spelling stand for words of the rewritings: as they are, as abbreviations (organisations), or,
       for words no rewriting holds, with another ending (organisations) or across one typo, by single-letter deletions.
    3. The spellings so read are equi-joined with the rewritings.
    4. Spellings that no rewriting meets are compared as whole names without blanks, by the same deletions.
    5. The cheapest way wins. Entries that share it are weighed by how often each is written
       out in full: the leader needs more than half. rarity is one divided by their number.

    rules names the rules of the way, with 'typo', 'abbreviation', 'ending' or 'blanks' for what was done to the words. A
    spelling equal to an entry's name is that entry at 0 bits. Null or blank spellings mean nothing. Ties without a
    leader give no row. The directory is of fixed size; its forms take part in plain joins. A spelling of more words
    than the longest rewriting can mean no entry.
    """
    text_batches(mentions.sparkSession)
    mentions = mentions.filter("nombre is not null and trim(nombre) != ''")
    nodes = nodes.filter("name is not null and node_key is not null")
    forms = materialize(priced_forms(materialize(directory_forms(nodes), "rewritings")), "forms")
    known = forms.select("kind", F.explode(F.split("form", " ")).alias("word")).distinct()
    most = forms.groupBy("kind").agg(F.max(F.size(F.split("form", " "))).alias("most"))  # a row for each kind
    words = materialize(_mention_words(mentions.select("nombre", "kind")).join(F.broadcast(most), "kind").filter("n <= most").drop("most"), "words")
    distinct = words.select("kind", "word").distinct()
    as_is = distinct.join(known, ["kind", "word"], "left_semi").select("kind", "word", F.col("word").alias("fixed"), F.lit(0.0).alias("bits"), F.lit("").alias("how"))
    short = distinct.join(_abbreviated(forms), ["kind", "word"]).select("kind", "word", "fixed", "bits", F.lit("abbreviation").alias("how"))
    unknown = distinct.join(known, ["kind", "word"], "left_anti")
    ending = _endings(unknown, forms).select("kind", "word", "fixed", "bits", F.lit("ending").alias("how"))
    typo = _typos(unknown, known).select("kind", "word", "fixed", "bits", F.lit("typo").alias("how"))
    read = as_is.unionByName(short).unionByName(ending).unionByName(typo)
    # A spelling's words with all they may stand for, then every combination; both are bounded by the directory.
    options = words.join(read, ["kind", "word"]).groupBy("nombre", "kind", "n", "pos").agg(
        F.collect_set(F.struct("bits", "fixed", "how")).alias("o")).groupBy("nombre", "kind", "n").agg(
        F.sort_array(F.collect_list(F.struct("pos", "o"))).alias("w")).filter("size(w) = n")

    def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            rows = []
            for name, kind, w in zip(p["nombre"], p["kind"], p["w"]):
                for c in product(*([(x["bits"], x["fixed"], x["how"]) for x in o["o"]] for o in w)):
                    rows.append((name, kind, " ".join(x for _, x, _ in c), sum(b for b, _, _ in c), "+".join(sorted({h for _, _, h in c if h}))))
            yield pd.DataFrame(rows, columns=["nombre", "kind", "form", "own", "how"])

    spelled = options.mapInPandas(combine, "nombre string, kind string, form string, own double, how string")
    ways = materialize(spelled.join(forms, ["kind", "form"]).groupBy("nombre", "kind", "node_key", "rules", "how").agg(F.round(F.min(F.col("bits") + F.col("own")), 4).alias("bits")), "ways")
    # What the rules are worth: over the spellings that can mean one entry only, how often each set of rules is the way.
    single = ways.groupBy("nombre", "kind").agg(F.countDistinct("node_key").alias("k"), F.min(F.struct("bits", "rules")).alias("w")).filter("k = 1")
    use = single.groupBy("kind", "w.rules").agg(F.count(F.lit(1)).alias("used"))
    use = forms.select("kind", "rules").distinct().join(use, ["kind", "rules"], "left").withColumn("used", F.coalesce("used", F.lit(0)) + 1)  # a few dozen rows
    use = use.withColumn("seldom", F.round(F.log2(F.sum("used").over(Window.partitionBy("kind")) / F.col("used")), 4)).select("kind", "rules", "seldom")
    bits = F.when(F.col("rules") == "", F.col("bits")).otherwise(F.col("bits") + F.col("seldom"))
    way = F.struct(F.round(bits, 4).alias("bits"), F.concat_ws("+", F.nullif("rules", F.lit("")), F.nullif("how", F.lit(""))).alias("rules"))
    hits = ways.join(F.broadcast(use), ["kind", "rules"]).groupBy("nombre", "kind", "node_key").agg(F.min(way).alias("way")).select("nombre", "kind", "node_key", "way.*")
    hits = materialize(hits, "hits")
    exact = mentions.join(nodes.select(F.col("name").alias("nombre"), F.col("entity_type").alias("kind"), "node_key"), ["nombre", "kind"])
    rest = mentions.select("nombre", "kind").join(hits.select("nombre", "kind").distinct(), ["nombre", "kind"], "left_anti")
    hits = hits.unionByName(_whole_names(rest, nodes).withColumn("rules", F.lit("blanks")))
    often = exact.groupBy("node_key").agg(F.sum("n").alias("often"))
    best = Window.partitionBy("nombre", "kind")
    ranked = hits.withColumn("least", F.min("bits").over(best)).filter("bits = least").join(often, "node_key", "left")
    ranked = ranked.withColumn("often", F.coalesce("often", F.lit(0)) + 1.0).withColumn("rarity", 1 / F.count(F.lit(1)).over(best))
    ranked = ranked.withColumn("share", F.col("often") / F.sum("often").over(best)).filter("share > 0.5")
    found = ranked.select("nombre", "kind", "node_key", "bits", "rarity", "rules").join(exact.select("nombre", "kind"), ["nombre", "kind"], "left_anti")
    return found.unionByName(exact.select("nombre", "kind", "node_key", F.lit(0.0).alias("bits"), F.lit(1.0).alias("rarity"), F.lit("").alias("rules")))


def variant_mentions(occurrences: DataFrame, nodes: DataFrame) -> DataFrame:
    """(tabla, rec_id, nombre, node_key): occurrences (tabla, rec_id, nombre, kind) of entries not spelled exactly as their name."""
    distinct = occurrences.filter("nombre is not null").groupBy("nombre", "kind").agg(F.count(F.lit(1)).alias("n"))
    links = link_mentions(distinct, nodes).join(nodes.select("node_key", "name"), "node_key").filter("nombre != name").select("nombre", "kind", "node_key")
    return occurrences.join(links, ["nombre", "kind"]).select("tabla", "rec_id", "nombre", "node_key").distinct()
