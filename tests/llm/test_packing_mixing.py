import random

import pytest
from pyspark.sql import functions as F

from legajo.llm import mixing, packing
from legajo.llm.tokens import encoding


@pytest.mark.parametrize("seed", range(6))
def test_pack(seed):
    r = random.Random(seed)
    cap = 100
    sizes = [r.choice([r.randint(0, 20), r.randint(20, 60), r.randint(60, 100), 33, 34, 50]) for _ in range(r.randint(1, 400))]
    where = packing.pack(sizes, cap)
    bins: dict[int, list[int]] = {}
    for s, w in zip(sizes, where):
        bins.setdefault(w, []).append(s)
    assert all(sum(b) <= cap for b in bins.values()) and all(sum(3 * s > cap for s in b) <= 2 for b in bins.values())
    least = -(-sum(sizes) // cap)
    assert len(bins) <= max(1, 11 * max(least, sum(s > cap / 2 for s in sizes)) // 9 + 2)


def test_pack_pairs_largest():
    where = packing.pack([60, 40, 55, 45, 35, 30], 100)
    assert where[0] == where[1] and where[2] == where[3] and where[4] == where[5]
    assert packing.pack([], 10) == [] and packing.pack([0, 0], 10) == [0, 0]


def test_containers(spark):
    texts = [(i, "palabra " * (i * 7 % 900)) for i in range(120)] + [(500, None), (501, ""), (502, "token " * 9000), (503, "igual"), (503, "igual")]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("shard", F.lit("x")).withColumn("n_tokens", F.lit(-1))
    c = packing.fill_containers(df, capacity=1000)
    rows = c.collect()
    enc = encoding()
    sizes: dict = {}
    for i, t in texts:
        sizes[i] = sizes.get(i, 0) + len(enc.encode_ordinary(t or ""))
    got: dict = {}
    for r in rows:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["n_tokens"]
        assert r["token_end"] - r["token_start"] == r["n_tokens"] <= 1000
    assert got == sizes
    assert {r["doc_id"] for r in rows if r["piece"] > 0} == {i for i, n in sizes.items() if n > 1000}
    assert c.groupBy("container").agg(F.sum("n_tokens").alias("t")).filter("t > 1000").count() == 0
    rep = packing.fill_report(c, 1000).first()
    assert rep["unused_share"] < 0.1 and rep["tokens"] == sum(sizes.values())
    assert packing.fill_containers(df.limit(0)).count() == 0


def test_mix(spark):
    r = random.Random(1)
    rows = [(i, "big" if i % 3 else "small", "palabra de prueba " * r.randint(1, 40)) for i in range(1500)] + [(9000, "tiny", "uno dos tres " * 10), (9001, None, "x"), (9002, "big", None), (9003, "other", "y"), (None, "big", "z")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("key", F.lit(1)).withColumn("bucket", F.lit(1))
    t = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 2), ("tiny", 0.1, 3), ("absent", 0.2, 1), ("zero", 0.0, 1)], "source string, target_weight double, max_repeats int")
    drawn, shares = mixing.draw_mix(df, t, total_tokens=40_000)
    s = {r["source"]: r for r in shares.collect()}
    assert set(s) == {"big", "small", "tiny", "absent", "zero"} and s["absent"]["drawn_tokens"] == 0 and s["zero"]["drawn_tokens"] == 0
    assert abs(s["big"]["drawn_tokens"] - 20_000) <= 120 and abs(s["small"]["drawn_tokens"] - 16_000) <= 120
    d = drawn.collect()
    assert s["tiny"]["drawn_tokens"] == 3 * s["tiny"]["available_tokens"] and all(1 <= r["times"] <= {"big": 1, "small": 2, "tiny": 3}[r["source"]] for r in d)
    assert len({r["doc_id"] for r in d}) == len(d) and {r["source"] for r in d} == {"big", "small", "tiny"}
    _, most = mixing.draw_mix(df, t.filter("source != 'tiny'"))
    m = {r["source"]: r for r in most.collect()}
    assert abs(m["big"]["actual_share"] - 5 / 9) < 0.01 and sum(r["actual_share"] for r in m.values()) == pytest.approx(1)
    empty = mixing.draw_mix(df.limit(0), t)
    assert empty[0].count() == 0 and empty[1].filter("drawn_tokens > 0").count() == 0
