from pyspark.sql import functions as F

from legajo.llm import reading as R


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/reading_labels.parquet")
    train, test = labels.filter(F.pmod(F.xxhash64("doc_id"), F.lit(4)) != 0), labels.filter(F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0)
    model = R.train_levels(docs, train)
    got = R.reading_levels(docs.join(test.select("doc_id").distinct(), "doc_id"), model).join(test, "doc_id").collect()
    assert len(got) > 100
    assert sum((r["level"] >= 4) == (r["nivel"] >= 4) for r in got) / len(got) > 0.95
    assert sum(abs(r["level"] - r["nivel"]) <= 1 for r in got) / len(got) > 0.95


def test_edges(spark):
    docs = spark.createDataFrame([(1, "sol pan sol", "x"), (2, "jurisprudencia contractual", "x"), (3, None, "x"), (4, "", "x"), (5, "12 34", "x"), (1, "pan", "y")], "doc_id long, text string, level string")
    labels = spark.createDataFrame([(1, 1, "a"), (2, 5, "a"), (2, 4, "b"), (9, 3, "a"), (None, 2, "a"), (2, None, "c"), (1, 7, "z")], "doc_id long, nivel int, anotador string")
    m = R.train_levels(docs, labels)
    got = {(r["doc_id"], r["n_words"]): r["level"] for r in R.reading_levels(docs, m).collect()}
    assert got[1, 3] == 1 and got[1, 1] == 1 and got[2, 2] in (4, 5) and got[3, 0] is None and got[4, 0] is None and got[5, 2] is None
    seeded = R.train_levels(docs, labels.limit(0))
    assert seeded.score("jurisprudencia contractual")[0] is not None
    assert R.reading_levels(docs.limit(0), m).count() == 0
    none = R.train_levels(docs.limit(0), labels)
    assert none.score("hola")[0] is not None
