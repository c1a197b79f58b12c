import itertools
import random

import pytest

from legajo.llm import neardup as N


def brute(rows, least=0.5):
    sets = {}
    for d, t in rows:
        w = (t or "").lower().split()
        s = set(zip(w, w[1:], w[2:]))
        if s:
            sets[d] = s
    out = set()
    for a, b in itertools.combinations(sorted(sets), 2):
        x = len(sets[a] & sets[b])
        if x >= least * (len(sets[a]) + len(sets[b]) - x):
            out.add((a, b))
    return out


def pairs(df, **kw):
    return {(r["doc_id_a"], r["doc_id_b"]) for r in N.similar_pairs(df, **kw).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(60):
        base = [r.choice(vocab) for _ in range(r.randint(5, 150))]
        rows.append((f"b{i}", " ".join(base)))
        for k in range(r.randint(0, 3)):
            t = list(base)
            for _ in range(r.randint(0, max(1, len(t) // 8))):
                j = r.randrange(len(t))
                t[j : j + 1] = r.choice([[], [r.choice(vocab)], [t[j], r.choice(vocab)]])
            if r.random() < 0.3:
                h = len(t) // 2
                t = t[h:] + t[:h]
            rows.append((f"b{i}v{k}", " ".join(t)))
    rows += [("n", None), ("e", ""), ("t", "dos palabras"), ("c1", "  UNO dos\nTRES  cuatro "), ("c2", "uno dos tres cuatro"), ("largo", " ".join(vocab * 60)), ("largo2", " ".join(vocab * 60) + " fin")]
    df = spark.createDataFrame(rows, "doc_id string, text string").selectExpr("*", "1 as cls", "'z' as a", "2 as size")
    want = brute(rows)
    assert ("c1", "c2") in want and ("largo", "largo2") in want
    assert pairs(df) == want


def test_copies(spark):
    """A class of forty copies: every pair of them, in blocks of any size, and every link of each."""
    text = "uno dos tres cuatro cinco seis siete ocho nueve diez"
    rows = [(f"k{i:02d}", text) for i in range(40)] + [("z", text + " once"), ("z2", text + " once"), ("y", "nada que ver con lo de arriba")]
    df = spark.createDataFrame(rows + rows[:3], "doc_id string, text string")
    want = brute(rows)
    assert len(want) == 42 * 41 // 2
    assert pairs(df) == want and pairs(df, block=7) == want and N.similar_pairs(df, block=7).count() == len(want)
    g = {r["doc_id"]: r for r in N.duplicate_groups(df).collect()}
    assert g["z"]["group_id"] == "k00" == g["k07"]["group_id"] == g["k07"]["class_id"] and g["k03"]["copies"] == 40 and g["z2"]["links"] == 1 and g["z2"]["class_id"] == "z" and g["y"]["group_id"] is None
    assert [(r["class_a"], r["class_b"], r["similarity"]) for r in N.class_links(df).collect()] == [("k00", "z", 8 / 9)]
    assert pairs(df.limit(0)) == set() and N.duplicate_groups(df.limit(0)).count() == 0


def test_open_nodes(spark):
    """Versions of one form share many roots: with tiny leaves the walk opens nodes down to the last stride and finds the same pairs."""
    r = random.Random(5)
    base = [f"w{r.randrange(900)}" for _ in range(120)]
    rows = []
    for i in range(50):
        t = list(base)
        for _ in range(r.randint(0, 14)):
            t[r.randrange(len(t))] = f"x{r.randrange(5000)}"
        rows.append((f"d{i:02d}", " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id string, text string")
    want = brute(rows)
    assert 100 < len(want) < 1225
    assert pairs(df, leaf=2) == pairs(df) == want


def test_words():
    h = N.word_hashes("ab cd\tab\r\nñandú\xa0x  cd ")
    assert len(h) == 5 and h[0] == h[2] and h[1] == h[4] and len(set(h)) == 3
    many = [f"{a}{b}{c}" for a in "abcdefghij" for b in "klmnopqrst" for c in range(1000)]
    assert len(set(N.word_hashes(" ".join(many)))) == len(many)


def test_components(spark):
    chain = [(f"{i:03d}", f"{i + 1:03d}") for i in range(40)] + [("x", "y")]
    got = {r["id"]: r["component"] for r in N.components(spark.createDataFrame(chain, "x string, y string")).collect()}
    assert {got[f"{i:03d}"] for i in range(41)} == {"000"} and got["y"] == "x"
