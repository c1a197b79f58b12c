"""Problem 7: page furniture, words cut at line ends and misread letters in scanned texts."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from legajo.llm.runs import runs
from legajo.session import discard, materialize, spread, text_batches

#: Page numbers on a line of their own, digits masked as \d; fixed values.
PAGE = (
    r"(?:P[áaà]gina \d+(?: de \d+)?|Page \d+(?: of \d+)?|P[áaà]g\. ?\d+(?: ?/ ?\d+)?|[-–—] ?\d+ ?[-–—]|\[\d+\]|· ?\d+ ?·"
    r"|(?:Hoja|Folio|Full)(?: n\.º)? \d+(?: de \d+)?|-{2,} ?(?:P[áaà]gina|Page) \d+ ?-{2,}|\d+ ?\| ?\p{Lu}[^|]{2,40}|\p{Lu}[^|]{2,40} ?\| ?\d+|\d+ ?/ ?\d+)"
)
#: A running header or footer: a capitalised line with a sign that parts its fields, or a word and a file code.
HEADER = r"\p{Lu}[^\n]{1,60}(?: [—–·|/] [^\n]{1,60})+|\p{Lu}[\p{Ll}\d@]+(?: [\p{Ll}\d@]+){0,3} \p{Lu}{2,4}-\d{2,4}-\d{2,6}"
MARKS = "-‐¬\xad"
_MARKS = "\\-‐¬\\u00AD"  # the same inside a character class
#: What a scanner makes of letters: (printed, read). Fixed values.
CONFUSED = (
    ("o", "0"), ("ó", "0"), ("ò", "0"), ("l", "1"), ("i", "1"), ("í", "1"), ("l", "I"), ("i", "l"), ("l", "i"), ("s", "5"), ("g", "9"), ("q", "9"), ("z", "2"), ("b", "8"), ("b", "h"), ("h", "b"), ("ó", "6"), ("é", "6"),
    ("a", "@"), ("á", "@"), ("á", "ä"), ("à", "ä"), ("t", "f"), ("f", "t"), ("í", "f"), ("e", "c"), ("c", "e"), ("u", "n"), ("n", "u"), ("u", "ii"), ("ú", "ii"), ("n", "ii"), ("m", "rn"), ("rn", "m"), ("in", "m"), ("ni", "m"),
    ("cl", "d"), ("d", "cl"), ("li", "h"), ("h", "li"), ("ñ", "fi"), ("vv", "w"), ("w", "vv"),
)
#: How much more frequent a form must be than what it was misread as, and how much more often, for each word of text, scans must show a word
#: that clean texts hold too for it to be suspected.
FREQUENT = 4
SCAN_TYPICAL = 10
#: Lines of up to so many characters can be furniture. A masked line that repeats within texts is a form of furniture where it does so in
#: FORM_TEXTS texts, stands inside a sentence in the share CUTS of its places, and is itself continued in small letters in no more than RUNS_ON.
SHORT = 130
FORM_TEXTS = 3
CUTS = 0.05
RUNS_ON = 0.75

#: Words are counted over the texts of a task up to so many different ones or characters of text, then handed on.
HELD_WORDS = 200_000
HELD_CHARS = 64 << 20
#: Forms of words kept by a Python worker, and the longest of these words.
KEPT = 1 << 17
KEPT_CHARS = 40

_EDGE = ".,;:()[]{}\"'!?¿¡«»“”<>|*=_…"
_CODE = re.compile(r"^\S+@\S+\.\S+$|^\W*\d[\d.,/:\-%€]*\W*$|^https?:|^www\.")
_PART = re.compile(r"[^\-‐¬\xad/'’·&+()\[\]<>«».,;:\"!?¿¡]+")
#: The skeleton of a word: glyphs that are mistaken for each other fall together.
_SKELETON = str.maketrans({
    **dict.fromkeys("aáàä@", "a"), **dict.fromkeys("oóòöeéèc06", "o"), **dict.fromkeys("iíïltfr1I|", "i"), **dict.fromkeys("uúünhñb8", "ii"),
    "m": "iii", "d": "oi", "5": "s", "9": "g", "q": "g", "2": "z", "w": "vv",
})


def skeleton(word: str) -> str:
    return word.translate(_SKELETON)


class _Kept(dict):
    """What a function gives for a word, made once for words that come again."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, word: str):
        found = self.make(word)
        if len(word) <= KEPT_CHARS:
            if len(self) >= KEPT:
                self.clear()
            self[word] = found
        return found


_bones = _Kept(skeleton).__getitem__


def sql_skeleton(c: Column) -> Column:
    """skeleton() inside the JVM."""
    one = {k: v for k, v in ((chr(k), v) for k, v in _SKELETON.items()) if len(v) == 1}
    many: dict[str, str] = {}
    for k, v in _SKELETON.items():
        if len(v) > 1:
            many[v] = many.get(v, "") + chr(k)
    signs = dict(zip(many, "\ue010\ue011\ue012\ue013\ue014"))  # stand-ins, so that a replacement is not replaced again
    c = F.translate(c, "".join(one) + "".join(many.values()), "".join(one.values()) + "".join(signs[v] * len(ks) for v, ks in many.items()))
    for v, sign in signs.items():
        c = F.replace(c, F.lit(sign), F.lit(v))
    return c


_BY_FIRST = {c: tuple(p for p in CONFUSED if p[0][0] == c) for c in {p[0][0] for p in CONFUSED}}


@lru_cache(maxsize=100_000)
def changes(printed: str, read: str) -> tuple[int, ...] | None:
    """Places in `read` that differ when `printed` was misread as it, by the fewest confusions; None where it can't be, () is no misreading and None too.

    Breadth first over (letters printed, letters read): equal letters cost nothing, each confusion one step, also
    where the letters agree ("in" read as "m" does not, "u" as "ii" might).
    """
    step: dict[tuple[int, int], tuple[int, ...]] = {(0, 0): ()}
    seen: set[tuple[int, int]] = set()
    while step:
        reach: dict[tuple[int, int], tuple[int, ...]] = {}
        for (i, j), at in step.items():
            while (i, j) not in seen and (i, j) not in reach:
                reach[i, j] = at
                if i < len(printed) and j < len(read) and printed[i] == read[j]:
                    i, j = i + 1, j + 1
        if (len(printed), len(read)) in reach:
            return reach[len(printed), len(read)] or None
        seen.update(reach)
        step = {}
        for (i, j), at in reach.items():
            for a, b in _BY_FIRST.get(printed[i : i + 1], ()):
                if printed.startswith(a, i) and read.startswith(b, j):
                    step.setdefault((i + len(a), j + len(b)), (*at, j))
    return None


_PAGE = regex.compile(PAGE)
_PAGE_FIRST = "P-–—[·HF"  # what PAGE begins with, but for digits and lines with a bar
_HEADER = regex.compile(HEADER)
_DIGITS = re.compile(r"\d+")
_FILE_CODE = re.compile(r"\b[A-Z]{2,4}-\d{2,4}-\d{2,6}\b")


def is_header(t: str) -> bool:
    return len(t) < 130 and t[:1].isupper() and t[-1] not in ",;:" and (any(c in t for c in "—–·|/") or "-" in t) and _HEADER.fullmatch(t) is not None


def _core(token: str) -> str:
    return token.strip(_EDGE)


_NUMBER = re.compile(r"(?<![^\W\d_])\d+(?![^\W\d_])")


def _masked(text: str) -> str:
    return (_NUMBER.sub("#", _FILE_CODE.sub("code", text)) if _DIGITS.search(text) else text).lower()


def mask(line: str) -> str:
    """The form of a line: file codes and numbers masked, letters as glyph skeleton, so that a running line keeps it from page to page, file to file and reading to reading."""
    return " ".join(map(_bones, _masked(line).split(" ")))


def _stripped(text: str) -> list[str]:
    """The lines of a text without spaces, tabs and CR at their ends."""
    lines = text.split("\n")
    if "\t" in text or "\r" in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " ":
        return [x.strip(" \t\r") for x in lines]
    return lines


def mark(text: str, forms: Counter | None = None) -> tuple[list[str], list[bool], list[str | None], bool] | None:
    """(lines, furniture by the text itself, forms of short lines, sure) of a text; None where nothing hints at page furniture.

    Furniture by the text itself: page numbers; bare numbers that count up; lines of a header's shape
    that are repeated. Without any, a repeated form that stands inside a sentence is a hint, and sure is false.
    forms counts the repeated forms: ('mt', form) texts, 'mo' places, 'mc' places inside a sentence, 'mn' places
    continued in small letters, 'mh' texts where it has a header's shape.
    """
    ts = _stripped(text)
    full = [i for i, t in enumerate(ts) if t]
    # Only short lines can be furniture, so digits are masked in these alone.
    short = [i for i in full if len(ts[i]) < SHORT]
    line = "\n".join([ts[i] for i in short])
    masked = _DIGITS.sub("#", line)
    keys = dict(zip(short, masked.split("\n")))
    page = [False] * len(ts)
    if masked != line:
        for i, key in keys.items():
            t = ts[i]
            if len(t) < 70 and t != key and (t[0] in _PAGE_FIRST or t[0].isdecimal() or "|" in t) and _PAGE.fullmatch(t):
                page[i] = True
        if True not in page:
            bare = [(i, int(ts[i])) for i in short if len(ts[i]) < 5 and ts[i].isascii() and ts[i].isdigit() and not (i and ts[i - 1].endswith(":"))]
            for (i, v), (j, w) in zip(bare, bare[1:]):
                if w == v + 1:
                    page[i] = page[j] = True
    places: dict[str, list[int]] = {}
    if len(set(keys.values())) < len(keys):
        places = {key: [] for key, n in Counter(keys.values()).items() if n > 1 and any(map(str.isalpha, key))}
        for k, i in enumerate(full):
            if i in keys and keys[i] in places:
                places[keys[i]].append(k)
    own, hint = page, False
    for at in places.values():
        header = is_header(ts[full[at[0]]])
        same = Counter(ts[full[k]] for k in at)
        if header:
            for k in at:
                own[full[k]] = own[full[k]] or same[ts[full[k]]] > 1
        cuts = runs_on = 0
        for k in at:
            below = ts[full[k + 1]] if k + 1 < len(full) else ""
            above = ts[full[k - 1]] if k else ""
            runs_on += below[:1].islower()
            cuts += below[:1].islower() and above[-1:].isalnum()
        hint = hint or cuts > 0
        if forms is not None:
            m = mask(ts[full[at[0]]])
            forms["mt", m] += 1
            forms["mo", m] += len(at)
            forms["mc", m] += cuts
            forms["mn", m] += runs_on
            forms["mh", m] += header and max(same.values()) > 1
    sure = any(own)
    if not sure and not hint:
        return None
    masks: list[str | None] = [None] * len(ts)
    for i, x in zip(short, _masked(line).split("\n")):
        if any(map(str.isalpha, ts[i])):
            masks[i] = " ".join(map(_bones, x.split(" ")))
    return text.split("\n"), own, masks, sure


def _count_words(raw: Counter, scan: bool, out: Counter) -> None:
    """Into out: the words of runs of characters and their counts."""
    small = "s" if scan else "w"
    for token, n in raw.items():
        w = _core(token)
        if w.isalpha() and not token.startswith(("http", "www")):  # no code, number or sign inside, as most are
            if w[0].islower():
                out[small, w] += n
            elif w[0].isupper():
                out["c", w.lower()] += n
            continue
        if _CODE.match(token):
            continue
        if "-" in w[1:-1]:
            out["t", w.lower()] += n
        for x in _PART.findall(w):
            if x[0].islower():
                out[small, x] += n
            elif x[0].isupper() and not any(map(str.isdigit, x)):
                out["c", x.lower()] += n


def known_forms(vocab: DataFrame) -> DataFrame:
    """(mask): the forms of furniture that the corpus shows, from the counts of forms repeated within texts."""
    n = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0))
    by = vocab.filter("kind in ('mt', 'mo', 'mc', 'mn', 'mh')").groupBy(F.col("word").alias("mask")).agg(n("mt").alias("texts"), n("mo").alias("places"), n("mc").alias("cuts"), n("mn").alias("on"), n("mh").alias("headers"))
    return by.filter(f"headers >= 2 or (texts >= {FORM_TEXTS} and cuts >= {CUTS} * places and on <= {RUNS_ON} * places)").select("mask")


def read_scans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vocabulary, lines) of texts (doc_id, text), in one pass over them.

    vocabulary: (kind, word, n): kind 'w' words in small letters of texts without furniture, 's' of the
    other texts, 'c' capitalised words in small letters, 't' words with a hyphen inside; 'm..' forms of lines, see mark().
    lines: (doc_id, line_no, line, furniture) of all lines of scanned texts, cut at LF and counted from 1.
    Furniture: page numbers; runs of bare numbers that count up by one, where a text has no other page
    numbers (never the value under a label that ends with a colon); lines of a header's shape that are
    repeated word for word in the text; and every line whose form (numbers and codes masked, glyph skeleton) the
    corpus knows as furniture, see known_forms().
    """
    text_batches(docs.sparkSession)
    schema = pa.schema([("kind", pa.string()), ("word", pa.string()), ("n", pa.int64()), ("doc_id", pa.string()), ("line_no", pa.int32()), ("line", pa.string()), ("own", pa.bool_()), ("mask", pa.string()), ("sure", pa.bool_())])

    def batch(size: int, **columns: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[c.name], c.type) if c.name in columns else pa.nulls(size, c.type) for c in schema], schema=schema)

    def counted(clean: Counter, scanned: Counter, out: Counter) -> pa.RecordBatch:
        _count_words(clean, False, out)
        _count_words(scanned, True, out)
        found = [(k, w, n) for (k, w), n in out.items() if n]
        for c in (clean, scanned, out):
            c.clear()
        return batch(len(found), **dict(zip(("kind", "word", "n"), map(list, zip(*found))))) if found else batch(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clean, scanned, out, seen = Counter(), Counter(), Counter(), 0
        for p in batches:
            ids, numbers, lines, own, masks, sure = [], [], [], [], [], []
            for d, t in zip(p["doc_id"].to_pylist(), p["text"].to_pylist()):
                m = mark(t, out)
                (scanned if m and m[3] else clean).update(runs(t))
                seen += len(t)
                if m:
                    n = len(m[0])
                    ids += [d] * n
                    numbers += range(1, n + 1)
                    lines += m[0]
                    own += m[1]
                    masks += m[2]
                    sure += [m[3]] * n
            if ids:
                yield batch(len(ids), doc_id=ids, line_no=numbers, line=lines, own=own, mask=masks, sure=sure)
            if seen > HELD_CHARS or len(clean) + len(scanned) + len(out) > HELD_WORDS:
                yield counted(clean, scanned, out)
                seen = 0
        yield counted(clean, scanned, out)

    both = spread(docs.filter("text is not null").select("doc_id", "text")).mapInArrow(
        run, "kind string, word string, n long, doc_id string, line_no int, line string, own boolean, mask string, sure boolean")
    both = materialize(both, "scans")
    vocab = materialize(both.filter("kind is not null").groupBy("kind", "word").agg(F.sum("n").alias("n")), "vocabulary")
    known = materialize(known_forms(vocab).withColumn("known", F.lit(True)), "forms")  # its size is known then, and most often small enough for every task
    lines = both.filter("kind is null").join(known, "mask", "left")
    lines = materialize(lines.select("doc_id", "line_no", "line", "sure", (F.col("own") | F.coalesce("known", F.lit(False))).alias("furniture")), "marked")
    discard(both)
    # A text with a hint alone is a scan where the hint is a known form.
    proven = lines.filter("not sure and furniture").select("doc_id").distinct()
    return vocab, lines.filter("sure").unionByName(lines.filter("not sure").join(proven, "doc_id", "left_semi")).drop("sure")


def cut_words(lines: DataFrame, vocab: DataFrame) -> DataFrame:
    """Lines (doc_id, line_no, line, furniture) that are neither furniture nor blank with hyphen, glued, follows, next_no and next_word: whether the line ends inside a word, or at a mark at all, or goes on with a word cut on the line before; the next two where the line ends inside a word.

    A mark other than the plain hyphen always cuts. A plain one does, unless it belongs to a code, a
    number or a compound: the corpus decides between the joined and the hyphenated form.
    """
    full = lines.filter("not furniture and trim(line) != ''")
    row = Window.partitionBy("doc_id").orderBy("line_no")
    # Only what is looked for of a line goes through the window.
    marked = F.col("line").rlike(rf"[{_MARKS}][ \t\r]*$")
    of_end = lambda k: F.when(marked, F.regexp_extract("line", rf"([^ \t]*[^ \t{_MARKS}])([{_MARKS}])[ \t\r]*$", k)).otherwise(F.lit(""))
    ends = full.select("doc_id", "line_no", of_end(1).alias("end"), of_end(2).alias("mark"), F.regexp_extract("line", r"^[ \t]*([^ \t\r]+)", 1).alias("first"))
    ends = ends.withColumn("next_no", F.lead("line_no").over(row)).withColumn("next_word", F.lead("first").over(row)).filter("mark != '' and next_word is not null")
    ends = ends.withColumn("head", F.regexp_replace("end", r"^[.,;:()\[\]{}\"'!?¿¡«»“”<>|*=_…]+", "")).withColumn("tail", F.regexp_replace("next_word", r"[.,;:()\[\]{}\"'!?¿¡«»“”<>|*=_…]+$", ""))
    cand = ends.filter("head != '' and tail != ''").select("doc_id", "line_no", "head", "tail", "mark", "next_no", "next_word")
    cand = cand.withColumn("joined", F.lower(F.concat("head", "tail"))).withColumn("compound", F.lower(F.concat_ws("-", "head", "tail")))
    plain = vocab.filter("kind in ('w', 'c')").groupBy("word").agg(F.sum("n").alias("nj")).withColumnRenamed("word", "joined")
    whole = vocab.filter("kind = 't'").select(F.col("word").alias("compound"), F.col("n").alias("nc"))
    lefts = vocab.filter("kind = 't' and n > 1 and word rlike '(?U)^\\\\p{L}+-\\\\p{L}+$'").select(F.split_part("word", F.lit("-"), F.lit(1)).alias("left"), F.split_part("word", F.lit("-"), F.lit(2)).alias("right"))
    cand = cand.join(plain, "joined", "left").join(whole, "compound", "left")
    cand = cand.withColumn("left", F.lower(F.element_at(F.split("head", "-"), -1))).join(
        lefts.groupBy("left").agg(F.count(F.lit(1)).alias("compounds")), "left", "left")
    code = F.col("head").rlike(r"[\p{Lu}\d]$") | F.col("tail").rlike(r"^\d+[\d\-/.:,%]*$")
    of_word = (
        F.when(F.col("mark") != "-", True).when(code, False)
        .when(F.col("nj").isNotNull() & (F.col("nj") >= F.coalesce("nc", F.lit(0))), True)
        .when(F.col("nc").isNotNull(), False).when(F.col("compounds").isNotNull() & (F.char_length("left") > 3), False)
        .otherwise(F.col("tail").rlike(r"(?U)^[\p{Ll}\d@]")))
    # What is found of a line goes to it and to the next one, so that no line needs a second window.
    told = cand.select("doc_id", "line_no", "next_no", "next_word", of_word.alias("hyphen"))
    of_line = F.struct("line_no", "hyphen", F.lit(True).alias("glued"), F.lit(False).alias("follows"), F.when(F.col("hyphen"), F.col("next_no")).alias("next_no"), F.when(F.col("hyphen"), F.col("next_word")).alias("next_word"))
    of_next = F.struct(F.col("next_no").alias("line_no"), F.lit(False).alias("hyphen"), F.lit(False).alias("glued"), F.lit(True).alias("follows"), F.lit(None).cast("int").alias("next_no"), F.lit(None).cast("string").alias("next_word"))
    told = told.select("doc_id", F.explode(F.when(F.col("hyphen"), F.array(of_line, of_next)).otherwise(F.array(of_line))).alias("x")).select("doc_id", "x.*")
    told = told.groupBy("doc_id", "line_no").agg(*(F.max(c).alias(c) for c in ("hyphen", "glued", "follows", "next_no", "next_word")))
    found = full.join(told, ["doc_id", "line_no"], "left")
    return found.select(*full.columns, "next_no", "next_word", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("hyphen", "glued", "follows")))


def _words_of(token: str) -> tuple[str, tuple[str, ...]]:
    """(core, words in small letters) of a run of characters."""
    core = _core(token)
    if token[0].isupper() and not (token[0] == "I" and token[1:2].islower()) or _CODE.match(token):
        return core, ()
    return core, tuple(x for x in _PART.findall(core) if len(x) > 1 and not x[1:].isupper() and any(map(str.isalpha, x)))


_words = _Kept(_words_of).__getitem__


def line_words(cut: DataFrame) -> DataFrame:
    """(doc_id, line_no, next_no, word, left, ctx, before, after) of words in small letters; ctx is a hash of the line, before and after are the neighbours on it, left is the length of the part on the line where the word goes on in the next one, else null."""
    text_batches(cut.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in batches:
            at, next_no, words, left, before, after = [], [], [], [], [], []
            for i, (line, hyphen, nxt, word, skip) in enumerate(zip(*(p[c].to_pylist() for c in ("line", "hyphen", "next_no", "next_word", "follows")))):
                tokens = runs(line)
                found = [_words(t) for t in (tokens[1:] if skip else tokens)]
                cores = [None, *[core for core, _ in found], None]
                if hyphen and found:
                    found.pop()
                    head = tokens[-1].rstrip(MARKS).lstrip(_EDGE)
                    x = head + word.rstrip(_EDGE)
                    if x and not x[0].isupper() and not _CODE.match(x) and not any(c in x for c in MARKS):
                        at.append(i)
                        next_no.append(nxt)
                        words.append(x)
                        left.append(len(head))
                        before.append(cores[-3])
                        after.append(None)
                for k, (_, parts) in enumerate(found):
                    for x in parts:
                        at.append(i)
                        next_no.append(None)
                        words.append(x)
                        left.append(None)
                        before.append(cores[k])
                        after.append(cores[k + 2])
            of = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [p["doc_id"].take(of), p["line_no"].take(of), pa.array(next_no, pa.int32()), pa.array(words, pa.string()), pa.array(left, pa.int32()), p["ctx"].take(of), pa.array(before, pa.string()), pa.array(after, pa.string())],
                names=["doc_id", "line_no", "next_no", "word", "left", "ctx", "before", "after"])

    return cut.select("doc_id", "line_no", "line", "hyphen", "next_no", "next_word", "follows", F.xxhash64("line").alias("ctx")).mapInArrow(
        run, "doc_id string, line_no int, next_no int, word string, left int, ctx long, before string, after string")


def _support(words: DataFrame, cases: DataFrame, suspects: DataFrame | None = None) -> DataFrame:
    """(word, printed, support): how often the neighbours of each word stand beside the printed form where that is read rightly. cases: (word, printed); suspects: the rows of words that hold the cases' words, if they are known."""
    side = lambda k, c: F.struct(F.lit(k).alias("side"), F.col(c).alias("near"))
    beside = lambda df: df.select("word", "ctx", F.explode(F.array(side("b", "before"), side("a", "after"))).alias("x")).select("word", "ctx", "x.side", "x.near").filter("near is not null").distinct()
    forms = cases.select(F.col("printed").alias("word")).distinct()
    pairs = beside(words.join(forms, "word", "left_semi")).groupBy(F.col("word").alias("printed"), "side", "near").agg(F.count(F.lit(1)).alias("seen"))
    around = beside((words if suspects is None else suspects).join(cases.select("word").distinct(), "word", "left_semi")).groupBy("word", "side", "near").agg(F.count(F.lit(1)).alias("times"))
    met = around.join(cases.select("word", "printed"), "word").join(pairs, ["printed", "side", "near"])
    return met.groupBy("word", "printed").agg(F.sum(F.col("times") * F.log1p("seen")).alias("support"))


def _typical(times: str) -> Column:
    """Whether no clean text holds a word, or scans show it often enough to suspect it."""
    return F.col("held").isNull() | (F.col(times) * F.col("w") >= SCAN_TYPICAL * F.col("held") * F.col("s"))


def suspect_rows(words: DataFrame, vocab: DataFrame) -> DataFrame:
    """The rows of words whose word can be a suspect by its places, with held, w and s: how often clean texts hold it, and the words of clean texts and of scans.

    No word has more different lines than places, so all suspects are among them; the frequent words of clean texts are not.
    """
    clean = vocab.filter("kind = 'w'").select("word", F.col("n").alias("held"))
    size = lambda k: F.sum(F.when(F.col("kind") == k, F.col("n"))).alias(k)
    total = vocab.filter("kind in ('w', 's')").agg(size("w"), size("s"))  # one row
    places = words.groupBy("word").agg(F.count(F.lit(1)).alias("places"))
    maybe = materialize(places.join(clean, "word", "left").crossJoin(F.broadcast(total)).filter(_typical("places")).drop("places"), "suspects")
    return materialize(words.join(maybe, "word"), "suspect_rows")


def misread_words(words: DataFrame, vocab: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """(word, printed, at): distinct words with the frequent form of the same skeleton that a scanner may have misread; at: the places. rows: suspect_rows(words, vocab), if they are made.

    Suspects are the words that no clean text holds, and those that scans show SCAN_TYPICAL times as often as
    clean texts do, for each word of text. Of several forms with the fewest confusions, the one that the
    suspect's neighbours stand beside most often is chosen, then the most frequent; a suspect that clean
    texts hold needs such neighbours.
    """
    rows = suspect_rows(words, vocab) if rows is None else rows
    shape = lambda w: sql_skeleton(F.col(w))
    # A word's own weight is the number of different lines that hold it, so that copies of a scan don't make its errors frequent.
    own = rows.groupBy("word", "held", "w", "s", "ctx").agg(F.lit(1).alias("line")).groupBy("word", "held", "w", "s").agg(F.count(F.lit(1)).alias("own"))
    suspects = own.filter(_typical("own")).withColumn("bones", shape("word"))
    both = vocab.filter("kind in ('w', 's') and char_length(word) > 1 and word rlike '(?U)^\\\\p{Ll}+$'").groupBy("word").agg(F.sum("n").alias("n"))
    forms = both.filter("n > 1").select(F.col("word").alias("printed"), "n", shape("word").alias("bones"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            rows = []
            for w, c, n, held in zip(p["word"], p["printed"], p["n"], p["known"]):
                at = changes(c, w)
                if at:
                    rows.append((w, c, n, held, list(at)))
            yield pd.DataFrame(rows, columns=["word", "printed", "n", "known", "at"])

    near = suspects.join(forms, "bones").filter(f"n >= {FREQUENT} * own and word != printed")
    made = near.select("word", "printed", "n", F.col("held").isNotNull().alias("known")).mapInPandas(run, "word string, printed string, n long, known boolean, at array<int>")
    one = Window.partitionBy("word")
    made = materialize(made.withColumn("least", F.min(F.size("at")).over(one)).filter("size(at) = least").withColumn("k", F.count(F.lit(1)).over(one)).drop("least"), "misread")
    sure = made.filter("k = 1 and not known")
    cases = made.filter("k > 1 or known")
    best = one.orderBy(F.desc("support"), F.desc("n"), "printed")
    told = cases.join(_support(words, cases, rows), ["word", "printed"], "left").withColumn("support", F.coalesce("support", F.lit(0.0))).filter("support > 0 or not known")
    told = told.withColumn("rank", F.row_number().over(best)).filter("rank = 1")
    return sure.select("word", "printed", "at").unionByName(told.select("word", "printed", "at"))


def noise_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, noise) of scanned texts (doc_id, text): furniture, hyphen, misread.

    A text is scanned where it carries page furniture; others, null and empty texts give no rows. A line
    of furniture has no other noise. A misread letter in the second part of a cut word counts for the
    line that holds it. Rows that repeat an id are taken as one text of more lines.
    """
    docs = docs.filter("doc_id is not null and text is not null")
    vocab, lines = read_scans(docs)
    cut = materialize(cut_words(lines, vocab), "cut")
    words = materialize(line_words(cut), "words")
    rows = suspect_rows(words, vocab)
    bad = misread_words(words, vocab, rows)
    hit = rows.join(bad, "word").select(
        "doc_id", F.explode(F.transform("at", lambda i: F.when(F.col("left").isNotNull() & (i >= F.col("left")), F.col("next_no")).otherwise(F.col("line_no")))).alias("line_no"))
    return lines.filter("furniture").select("doc_id", "line_no", F.lit("furniture").alias("noise")).unionByName(
        cut.filter("hyphen").select("doc_id", "line_no", F.lit("hyphen").alias("noise"))).unionByName(
        hit.select("doc_id", "line_no", F.lit("misread").alias("noise"))).distinct()


def repair_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of scanned texts as continuous paragraphs: furniture dropped, cut words joined, misread words put right, lines joined up to the next blank one.

    A blank line next to furniture ends a paragraph only where the line before it ends a sentence.
    """
    docs = docs.filter("doc_id is not null and text is not null")
    vocab, lines = read_scans(docs)
    row = Window.partitionBy("doc_id").orderBy("line_no")
    lines = lines.withColumn("passed", F.sum(F.col("furniture").cast("int")).over(row))
    cut = materialize(cut_words(lines, vocab), "cut")
    bad = misread_words(materialize(line_words(cut), "words"), vocab)
    kept = cut.withColumn("gap", F.col("line_no") - F.lag("line_no", 1, 0).over(row) > 1).withColumn("above", F.lag("line").over(row)).withColumn(
        "above_cut", F.coalesce(F.lag("hyphen").over(row), F.lit(False)))
    ends = F.coalesce(F.col("above").rlike(r"[.!?:;…»)]\s*$|^[^\p{Ll}]{3,80}$"), F.lit(True))
    page_break = F.col("passed") > F.coalesce(F.lag("passed").over(row), F.lit(0))
    kept = kept.withColumn("page_break", page_break).withColumn("starts", (F.col("gap") & (~F.col("page_break") | ends) & ~F.col("above_cut")) | F.col("line").rlike(r"^\s*(?:\d+\.|[-*•]) "))
    kept = kept.withColumn("paragraph", F.sum(F.col("starts").cast("int")).over(row))
    clean = F.regexp_replace(F.regexp_replace("line", r"^[ \t]+|[ \t\r]+$", ""), rf"[{_MARKS}]$", "")
    whole = F.regexp_replace("line", r"^[ \t]+|[ \t\r]+$", "")
    piece = F.when(F.col("hyphen"), clean).when(F.col("glued"), whole).otherwise(F.concat(whole, F.lit(" ")))
    paras = kept.groupBy("doc_id", "paragraph").agg(F.sort_array(F.collect_list(F.struct("line_no", piece.alias("p")))).alias("ps")).select(
        "doc_id", "paragraph", F.trim(F.array_join("ps.p", "")).alias("text"))
    # Words are put right by an equi-join on the paragraph's own words.
    tokens = paras.select("doc_id", "paragraph", F.explode(F.array_distinct(F.split("text", r"[^\p{L}\p{N}@|]+"))).alias("word")).join(bad.select("word", "printed"), "word")
    fixes = tokens.groupBy("doc_id", "paragraph").agg(F.collect_list(F.struct("word", "printed")).alias("fixes"))
    fixed = paras.join(fixes, ["doc_id", "paragraph"], "left").withColumn("text", F.when(F.col("fixes").isNull(), F.col("text")).otherwise(
        F.aggregate("fixes", F.col("text"), lambda t, f: F.regexp_replace(t, F.concat(F.lit(r"(?U)(?<![\p{L}\p{N}@])\Q"), f["word"], F.lit(r"\E(?![\p{L}\p{N}@])")), f["printed"]))))
    return fixed.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("paragraph", "text"))).alias("ps")).select("doc_id", F.array_join("ps.text", "\n\n").alias("text"))
