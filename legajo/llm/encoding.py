"""Problem 5: find wrongly decoded text and restore it by a table of garbled forms of clean words."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from legajo.session import materialize, text_batches

#: Encodings a text may have been written in, and those it may have been read in by mistake.
WRITTEN = ("utf-8", "cp1252", "mac_roman", "cp850")
READ_AS = ("latin-1", "cp1252", "mac_roman", "cp850", "cp437", "cp1251", "cp1250", "iso8859-15", "utf-8")
#: Non-ASCII characters of clean text: letters of Spanish, Catalan and neighbouring languages, typographic marks.
CLEAN = "áéíóúüñçàèòïâêôãõäöëîûìùÁÉÍÓÚÜÑÇÀÈÒÏÂÊÔÃÕÄÖËÎÛß·—–«»“”‘’…€ºª°¿¡½¼¾±²³£¥¢§©®µ×‐"
#: How much more frequent than its garbled form a word must be where the form itself looks like clean text.
RATIO = 3.0

_NOT_ASCII = re.compile(r"[^\x00-\x7f]")
_EDGE = ".,;:()[]{}\"'!?<>|*=_"
_LETTERS = frozenset("áéíóúüñçàèòïâêôãõäöëîûìùÁÉÍÓÚÜÑÇÀÈÒÏÂÊÔÃÕÄÖËÎÛß")
#: Letters of the collection's own languages.
_OWN = frozenset("áéíóúüñçàèòïÁÉÍÓÚÜÑÇÀÈÒÏ")
_CLEAN = frozenset(CLEAN)
#: A sign between or right after letters, and a middle dot other than the Catalan l·l: no clean word has them.
_SIGN_INSIDE = re.compile(r"(?<=[^\W\d_])(?!(?<=l)·l)[^\w\x00-\x7f](?=[^\W\d_])|(?<=[^\W\d_])[¼½¾²³±£¥¢§©®×]|(?<!l)·(?=[^\W\d_])", re.I)
_ASCII_LETTER = re.compile("[A-Za-z]")


@lru_cache(maxsize=4096)
def _byte_as(b: int, enc: str) -> str:
    """One byte in a one-byte encoding; bytes that the encoding leaves undefined keep their number, as common software does."""
    try:
        return bytes([b]).decode(enc)
    except UnicodeDecodeError:
        return chr(b)


def _misread(word: str, written: str, read: str) -> str | None:
    """What the word looks like when its bytes are read in another encoding; None where it can't be written or stays as it is."""
    try:
        raw = word.encode(written)
    except UnicodeEncodeError:
        return None
    got = raw.decode("utf-8", "replace") if read == "utf-8" else "".join(_byte_as(b, read) for b in raw)
    return None if got == word else got


def garbled_forms(word: str) -> dict[str, str]:
    """{garbled form: chain} of a word under all chains of one or two wrong decodings (two only by way of UTF-8)."""
    out: dict[str, str] = {}
    for w in WRITTEN:
        for r in READ_AS:
            if w == r:
                continue
            g = _misread(word, w, r)
            if g is None:
                continue
            out.setdefault(g, f"{w}>{r}")
            if w == "utf-8":
                for r2 in READ_AS[:5]:
                    g2 = _misread(g, "utf-8", r2)
                    if g2 is not None:
                        out.setdefault(g2, f"{w}>{r}>utf-8>{r2}")
    if "�" not in word:
        out.setdefault(_NOT_ASCII.sub("�", word), "replaced")
    return out


def _core(token: str) -> str:
    return token.strip(_EDGE)


def foreign_tokens(text: str | None) -> list[str]:
    """The distinct words of a text that hold a character beyond ASCII, without ASCII punctuation around them."""
    if not text or text.isascii():
        return []
    seen = {t for t in text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") if not t.isascii()}
    return list({_core(t) for t in seen})


def token_table(records: DataFrame) -> DataFrame:
    """(tabla, rec_id, token) of records (tabla, rec_id, text): a row for each distinct word beyond ASCII of a record."""
    text_batches(records.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            tab, ids, toks = [], [], []
            for t, i, x in zip(p["tabla"], p["rec_id"], p["text"]):
                found = foreign_tokens(x)
                if found:
                    k = len(found)
                    tab += [t] * k
                    ids += [i] * k
                    toks += found
            yield pd.DataFrame({"tabla": tab, "rec_id": ids, "token": toks})

    return records.filter("text is not null").select("tabla", "rec_id", "text").mapInPandas(run, "tabla string, rec_id string, token string")


def _is_clean(token: str) -> bool:
    """Letters of clean text only, no sign between them, in a usual mix of cases: a lone capital with an accent inside a small word is none."""
    beyond = _NOT_ASCII.findall(token)
    if not all(c in _CLEAN for c in beyond) or _SIGN_INSIDE.search(token):
        return False
    inner = token[1:]
    mixed = any(c in _LETTERS and c.isupper() for c in inner) and any(c.islower() for c in inner)
    return not mixed


def _could_be_clean(token: str) -> bool:
    """Words in the collection's own letters, and tokens that are no words at all: for these a frequent original must speak."""
    if not _ASCII_LETTER.search(token):
        return True
    return _is_clean(token) and all(c in _OWN or c not in _LETTERS for c in _NOT_ASCII.findall(token))


def garbled_table(vocabulary: DataFrame) -> DataFrame:
    """(garbled, word, chain, n): the forms of every clean word of a vocabulary (token, n)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            rows = []
            for w, n in zip(p["token"], p["n"]):
                if _is_clean(w):
                    letters = any(c in _LETTERS for c in w)
                    for g, chain in garbled_forms(w).items():
                        # A single symbol misread as another symbol proves nothing; a letter or several signs in its place do.
                        if letters or len(g) > len(w) or g.isalpha():
                            rows.append((g, w, chain, n))
            yield pd.DataFrame(rows, columns=["garbled", "word", "chain", "n"])

    return vocabulary.mapInPandas(run, "garbled string, word string, chain string, n long")


@lru_cache(maxsize=1)
def _sequences() -> tuple[re.Pattern, dict[str, str]]:
    """The forms of two characters or more of single clean characters, for words that occur nowhere in clean form."""
    table: dict[str, str] = {}
    for c in CLEAN:
        for g, _ in sorted(garbled_forms(c).items(), key=lambda x: len(x[1])):
            if len(g) > 1 and "�" not in g and not g.isascii():
                table.setdefault(g, c)
    return re.compile("|".join(map(re.escape, sorted(table, key=len, reverse=True)))), table


def restore_by_sequences(token: str) -> str | None:
    """The token with its garbled sequences put right, where that makes a clean word with a letter in it; else None."""
    pattern, table = _sequences()
    got = pattern.sub(lambda m: table[m.group()], token)
    return got if got != token and _is_clean(got) and not any(c in got for c in "ãõâêôäëîûÂÊÔ¼¾½³²±") else None


def bad_tokens(tokens: DataFrame) -> DataFrame:
    """(token, word, chain): the distinct words that a wrong decoding left, with the original where one is proven (else null).

    Every clean word of the collection is garbled under all chains and equi-joined with the distinct words.
    A word with characters or signs foreign to clean text is bad as soon as one original makes it, however
    often it was copied; one that could be clean only where its original is RATIO times as frequent. Of several originals the most
    frequent is taken. U+FFFD always marks a bad word, with or without an original.
    """
    vocab = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    vocab = materialize(vocab, "vocabulary")  # distinct words: small beside the texts, read twice
    # A word has some forty forms: the table is far larger than its source's size tells, so it is never broadcast.
    table = garbled_table(vocab.repartition(vocab.sparkSession.sparkContext.defaultParallelism, "token"))
    best = Window.partitionBy("garbled").orderBy(F.desc("n"), "word")
    table = table.withColumn("k", F.row_number().over(best)).filter("k = 1").drop("k")

    @F.pandas_udf("boolean")
    def clean(words: pd.Series) -> pd.Series:
        return words.map(_could_be_clean)

    @F.pandas_udf("string")
    def sequences(words: pd.Series) -> pd.Series:
        return words.map(restore_by_sequences)

    v = vocab.select("token", F.col("n").alias("own"), clean("token").alias("looks_clean"))
    hit = v.join(table.hint("merge"), v.token == table.garbled, "left")
    proven = F.col("word").isNotNull() & (~F.col("looks_clean") | (F.col("n") >= RATIO * F.col("own")))
    hit = hit.withColumn("proven", proven).withColumn("by_sequence", F.when(F.col("proven"), None).otherwise(sequences("token")))
    return hit.filter(F.col("proven") | F.col("by_sequence").isNotNull() | F.contains("token", F.lit("�"))).select(
        "token", F.when(F.col("proven"), F.col("word")).otherwise(F.col("by_sequence")).alias("word"),
        F.when(F.col("proven"), F.col("chain")).when(F.col("by_sequence").isNotNull(), F.lit("sequence")).otherwise(F.lit("lost")).alias("chain"))


def garbled_records(records: DataFrame) -> DataFrame:
    """(tabla, rec_id) of the records (tabla, rec_id, text) with at least one wrongly decoded word.

    Null and empty texts are no cases; rows that repeat an id count once; an empty table gives no rows.
    """
    tokens = token_table(records)
    return tokens.join(bad_tokens(tokens).select("token"), "token", "left_semi").select("tabla", "rec_id").distinct()


def restore_records(records: DataFrame) -> DataFrame:
    """(tabla, rec_id, restored, fixed_words, lost_words): affected records with the originals substituted.

    A record's pairs of bad word and original are gathered (bounded by its own words) and replaced in its
    text, longest first. Words without a proven original stay as they are and count as lost.
    """
    tokens = token_table(records)
    fixes = tokens.join(bad_tokens(tokens), "token").groupBy("tabla", "rec_id").agg(F.collect_list(F.struct("token", "word")).alias("fixes"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            rows = []
            for tab, i, text, fx in zip(p["tabla"], p["rec_id"], p["text"], p["fixes"]):
                to = {f["token"]: f["word"] for f in fx}
                known = {a: b for a, b in to.items() if b is not None}
                if known:
                    pattern = re.compile("|".join(map(re.escape, sorted(known, key=len, reverse=True))))
                    text = pattern.sub(lambda m: known[m.group()], text)
                rows.append((tab, i, text, len(known), len(to) - len(known)))
            yield pd.DataFrame(rows, columns=["tabla", "rec_id", "restored", "fixed_words", "lost_words"])

    return records.select("tabla", "rec_id", "text").filter("text is not null").join(fixes, ["tabla", "rec_id"]).mapInPandas(
        run, "tabla string, rec_id string, restored string, fixed_words int, lost_words int")
