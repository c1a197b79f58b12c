"""Problem 1: cut oversized items into pieces at natural boundaries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from legajo.session import spread, text_batches

MAX_WORDS = 512
MAX_CHARS = 4096
OVERLAP_WORDS = 50
#: Characters a shared word may have on average before the overlap is measured in characters instead.
OVERLAP_CHARS_PER_WORD = 20
#: Price of a cut by the boundary it falls on.
PENALTY = {"heading": 0.0, "paragraph": 1.0, "sentence": 3.0, "line": 4.0, "word": 25.0, "inside": 60.0}
#: Price of a piece by its squared relative distance from the even size.
BALANCE = 4.0

_WORD = re.compile(r"[^ \t\r\n]+")
_HEADING = re.compile(r"(?:[A-ZÁÉÍÓÚÑÜÀÈÒÏÇ0-9 .,\-—:/()·]{4,80}|#{1,6} .*|\d+(?:\.\d+)*\.? [^\n]{1,78}|(?:CLÁUSULA|ARTÍCULO|CAPÍTULO|Art\.).{0,74})(?=\n|$)")
_OUT = "piece_index int, text string, n_words int, n_chars int, char_start int, char_end int, n_shared int"


def word_count(c: Column) -> Column:
    """Runs of characters other than space, tab, CR and LF."""
    return F.regexp_count(c, F.lit(r"[^ \t\r\n]+"))


def is_oversized(c: Column, max_words: int = MAX_WORDS, max_chars: int = MAX_CHARS) -> Column:
    """Null texts are not oversized. n words take 2n - 1 characters at least, so short texts skip the word count."""
    n = F.char_length(c)
    long_enough = n >= 2 * max_words + 1
    return F.coalesce((n > max_chars) | (F.when(long_enough, word_count(c)).otherwise(0) > max_words), F.lit(False))


def _units(text: str, cap: int) -> tuple[list[int], list[int], list[bool]]:
    """Spans of the words; a word longer than cap characters becomes several units, cut after a separator where one is near. inside[i]: unit i continues a word."""
    starts, ends, inside = [], [], []
    for m in _WORD.finditer(text):
        a, b = m.span()
        if b - a <= cap:
            starts.append(a), ends.append(b), inside.append(False)
        else:
            k = a
            while k < b:
                end = min(b, k + cap)
                if end < b:
                    at = max(text.rfind(c, k + cap // 2, end) for c in ";,|/")
                    end = at + 1 if at > 0 else end
                starts.append(k), ends.append(end), inside.append(k > a)
                k = end
    return starts, ends, inside


def _price(text: str, end: int, start: int, continued: bool) -> float:
    if continued:
        return PENALTY["word" if text[end - 1] in ";,|/" else "inside"]
    gap = text[end:start]
    if "\n" in gap:
        if _HEADING.match(text, start) and not text[start : start + 40].isspace():
            return PENALTY["heading"] if gap.count("\n") > 1 or text[end - 1] in ".:;!?" else PENALTY["line"]
        if gap.count("\n") > 1:
            return PENALTY["paragraph"]
        return PENALTY["sentence"] if text[end - 1] in ".!?:;…" else PENALTY["line"]
    if text[end - 1] in ".!?…" and not text[start].islower():
        return PENALTY["sentence"]
    return PENALTY["line"] if len(gap) > 64 else PENALTY["word"]


def split_text(text: str, max_words: int = MAX_WORDS, max_chars: int = MAX_CHARS, overlap: int = OVERLAP_WORDS, overlap_chars: int = OVERLAP_CHARS_PER_WORD) -> list[tuple[int, int, int]]:
    """(start, end, words) of the pieces of a text, the cheapest by dynamic programming.

    A boundary is the gap before a unit. The natural ones always count; in a stretch without any that
    would not fit into a piece, each gap between words, and at last each cut inside a word, counts too.
    cost[b] = min over a of cost[a] + price of the cut at b + size imbalance of the piece from a to b,
    where the piece reaches back before a by the shared words, by as many as leave room for the stretch
    up to the next boundary (a wide gap between two words may take that room). So there is always a way.
    """
    cap = max(1, min(max_chars // 8, max_chars))
    starts, ends, inside = _units(text, cap)
    n = len(starts)
    if not n:
        return [(0, 0, 0)]
    overlap = max(0, min(overlap, max_words - 1))
    s, e = np.array(starts), np.array(ends)
    share_chars = min(overlap * overlap_chars, max_chars // 2)

    def back(b: int) -> int:
        """First unit of the part that the piece starting at boundary b shares with the one before."""
        if not b or not overlap:
            return b
        k = max(0, b - overlap)
        return max(k, int(np.searchsorted(s, ends[b - 1] - share_chars)))

    price = [PENALTY["paragraph"]] + [_price(text, ends[i - 1], starts[i], inside[i]) for i in range(1, n)] + [0.0]
    natural = [0, *(i for i in range(1, n) if price[i] < PENALTY["word"]), n]
    room_words, room_chars = max_words - overlap, max_chars - share_chars
    bounds: list[int] = []
    for a, b in zip(natural, natural[1:]):
        bounds.append(a)
        if b - a > room_words or ends[b - 1] - starts[a] > room_chars // 2:
            bounds.extend(range(a + 1, b))
    bounds.append(n)
    m = len(bounds)
    at = np.array(bounds)
    room = np.searchsorted(s, e[at[1:] - 1] - max_chars)
    first = np.array([back(b) for b in bounds])
    first[:-1] = np.minimum(np.maximum(first[:-1], np.maximum(room, at[1:] - max_words)), at[:-1])
    total_words = n + overlap * max(0, n // max(1, room_words))
    shared = min(share_chars, overlap * (ends[-1] - starts[0]) / n)
    parts = max(1, -(-total_words // max_words), int(-(-(ends[-1] - starts[0] - shared) // (max_chars - shared))))
    even = max(1.0, (ends[-1] - starts[0]) / parts)
    cost, prev = np.full(m, np.inf), np.full(m, -1)
    cost[0] = 0.0
    low = 0
    for j in range(1, m):
        b = at[j]
        end = ends[b - 1]
        while low < j - 1 and (b - first[low] > max_words or end - s[first[low]] > max_chars):
            low += 1
        f = first[low:j]
        size = end - s[f]
        ok = (b - f <= max_words) & (size <= max_chars)
        c = cost[low:j] + BALANCE * ((end - s[at[low:j]]) / even - 1.0) ** 2
        c = np.where(ok, c, np.inf)
        k = int(np.argmin(c))
        if np.isfinite(c[k]):
            cost[j], prev[j] = c[k] + price[b], low + k
    if not np.isfinite(cost[-1]):
        raise ValueError("no way to cut the text")  # each stretch between boundaries fits, so this cannot be
    cuts = [m - 1]
    while cuts[-1] > 0:
        cuts.append(int(prev[cuts[-1]]))
    cuts.reverse()
    out = []
    for i, j in zip(cuts, cuts[1:]):
        a = int(first[i])
        out.append((starts[a], ends[bounds[j] - 1], bounds[j] - a))
    return out


def split_items(
    df: DataFrame, id_col: str, text_col: str, section_col: str | None = None,
    max_words: int = MAX_WORDS, max_chars: int = MAX_CHARS, overlap: int = OVERLAP_WORDS, only_oversized: bool = False, overlap_chars: int = OVERLAP_CHARS_PER_WORD,
) -> DataFrame:
    """Pieces of the items of df: (item_id, section, piece_index, text, n_words, n_chars, char_start, char_end, n_shared).

    Every piece has at most max_words words and max_chars characters. Consecutive pieces share `overlap`
    words (fewer where the shared words would pass overlap_chars characters a word on average, as in
    blocks without breaks). n_shared is how many words, cut ones included, a piece has in common with
    the one before it; a joint that fell short has an n_shared below `overlap`. An item within the limits is its own single piece, unless only_oversized. Null text or null
    id: no piece / the id stays null. An oversized text without a word gives one empty piece. Rows that
    repeat an id are cut separately. Other columns of df are dropped, so their names cannot clash.
    """
    text_batches(df.sparkSession)
    section = F.col(section_col) if section_col else F.lit(None)
    items = df.select(F.col(id_col).cast("string").alias("item_id"), section.cast("string").alias("section"), F.col(text_col).alias("text"))
    big = is_oversized(F.col("text"), max_words, max_chars)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            rows = []
            for i, sec, t in zip(p["item_id"], p["section"], p["text"]):
                last = 0
                for k, (a, b, n) in enumerate(split_text(t, max_words, max_chars, overlap, overlap_chars)):
                    rows.append((i, sec, k, t[a:b], n, b - a, a, b, len(_WORD.findall(t, a, last)) if a < last else 0))
                    last = b
            yield pd.DataFrame(rows, columns=["item_id", "section", "piece_index", "text", "n_words", "n_chars", "char_start", "char_end", "n_shared"])

    pieces = spread(items.filter(big)).mapInPandas(cut, f"item_id string, section string, {_OUT}")
    if only_oversized:
        return pieces
    whole = items.filter(F.col("text").isNotNull() & ~big).select(
        "item_id", "section", F.lit(0).alias("piece_index"), "text", word_count(F.col("text")).cast("int").alias("n_words"),
        F.char_length("text").alias("n_chars"), F.lit(0).alias("char_start"), F.char_length("text").alias("char_end"), F.lit(0).alias("n_shared"))
    return whole.unionByName(pieces)
