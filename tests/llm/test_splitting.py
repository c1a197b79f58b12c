"""Pieces stay within the limits, cover the text, share the overlap and prefer natural boundaries."""

from hypothesis import given, settings
from hypothesis import strategies as st

from legajo.llm import splitting as S

words = st.sampled_from(["uno", "dos.", "Tres", "cuatro,", "x" * 30, "CLÁUSULA", "\n", "\n\n", "Fin.\n\n"])


@settings(max_examples=60, deadline=None)
@given(st.lists(words, max_size=400), st.integers(8, 60), st.integers(0, 6))
def test_limits_cover_overlap(parts, max_words, overlap):
    text = " ".join(parts)
    cut = S.split_text(text, max_words, 400, overlap)
    tokens = [m.span() for m in S._WORD.finditer(text)]
    if not tokens:
        assert cut == [(0, 0, 0)]
        return
    starts, ends = [a for a, _ in tokens], [b for _, b in tokens]
    assert cut[0][0] == starts[0] and cut[-1][1] == ends[-1]
    for a, b, n in cut:
        assert b - a <= 400 and n <= max_words and len(S._WORD.findall(text[a:b])) <= max_words and a in starts and b in ends
    for (_, b, _), (a, _, _) in zip(cut, cut[1:]):
        shared = [i for i, s in enumerate(starts) if a <= s and ends[i] <= b]
        assert a <= b + 250 and len(shared) <= overlap
        # fewer shared words only where they would be too long
        if len(shared) < min(overlap, starts.index(a)) and starts.index(a) > 0:
            i = starts.index(a) - 1
            assert b - starts[i] > min(overlap * S.OVERLAP_CHARS_PER_WORD, 200)


def test_giant_word_and_natural_cuts():
    cut = S.split_text("z" * 10_000, 512, 4096, 50)
    assert all(b - a <= 4096 for a, b, _ in cut) and cut[-1][1] == 10_000
    paras = "\n\n".join(" ".join(["palabra"] * 60) + "." for _ in range(20))
    for a, _, _ in S.split_text(paras, 512, 4096, 0):
        assert a == 0 or paras[a - 2 : a] == "\n\n"


def test_frame(spark):
    big = "Frase corta de prueba. " * 400
    df = spark.createDataFrame([("a", big, "s", 1), ("a", big, "s", 1), ("b", None, None, 2), ("c", "", "", 3), ("d", " " * 5000, None, 4), ("e", "ok", None, 5), (None, big, None, 6)], "id string, text string, section string, piece_index int")
    rows = S.split_items(df, "id", "text", "section").collect()
    by = {}
    for r in rows:
        by.setdefault(r["item_id"], []).append(r)
    n = len(S.split_text(big))
    assert len(by["a"]) == 2 * n and len(by[None]) == n and "b" not in by and [r["text"] for r in by["e"]] == ["ok"] and len(by["c"]) == 1
    assert len(by["d"]) == 1 and by["d"][0]["n_words"] == 0
    assert {r["item_id"] for r in S.split_items(df, "id", "text", only_oversized=True).collect()} == {"a", "d", None}
    assert S.split_items(df.limit(0), "id", "text").count() == 0


def test_wide_gaps_and_shared_words(spark):
    wide = ("palabra " * 300 + "\n" + " " * 3900 + "\n" + "otra " * 300).strip()
    cut = S.split_text(wide)
    assert all(b - a <= S.MAX_CHARS and n <= S.MAX_WORDS for a, b, n in cut)
    assert cut[0][0] == 0 and cut[-1][1] == len(wide)
    df = spark.createDataFrame([("a", "palabra " * 2000), ("b", ("x" * 100 + " ") * 200)], "id string, text string")
    rows = S.split_items(df, "id", "text").collect()
    assert {r["n_shared"] for r in rows if r["item_id"] == "a" and r["piece_index"]} == {S.OVERLAP_WORDS}
    assert all(r["n_shared"] < S.OVERLAP_WORDS for r in rows if r["item_id"] == "b")
    more = S.split_items(df, "id", "text", overlap=10, overlap_chars=101).collect()
    assert {r["n_shared"] for r in more if r["item_id"] == "b" and r["piece_index"]} == {10}
