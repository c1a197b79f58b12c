"""The best rows of each query: against the SQL twins on tables full of ties, without a record shuffled for each pair of a query and a row."""

import duckdb
import pytest

from legajo import queries as core

COMMON = ["caldera", "bomba", "planta"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """2,000 documents and chunks that nearly all hold the same three telling words; some texts repeat, one is empty, one null, two chunks share an identifier."""
    d = str(tmp_path_factory.mktemp("ties"))
    other = lambda i: f"w{'abcdefghij'[i % 10] * (1 + i % 4)}"
    text = lambda i: " ".join(COMMON * 3 + [other(i)] * (i % 3) * (i % 50 > 0)) if i % 7 or i % 50 == 0 else f"{COMMON[i % 3]} nada"
    docs = [(i, text(i)) for i in range(2000)] + [(3000, ""), (3001, None)]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(4).write.parquet(f"{d}/documents.parquet")
    chunks = [(f"c{i * 7919 % 2000:05d}", f"d{i // 2}", f"f{i // 2}", COMMON[i % 3].title() if i % 5 == 0 else None, text(i)) for i in range(2000)]
    chunks += [("c00007", "d3", "f3", "Bomba", "planta caldera"), ("e", "e", "e", "Caldera", ""), ("n", "n", "n", "Caldera", None)]
    chunks = [(x[0], "d3", "f3", *x[3:]) if x[0] == "c00007" else x for x in chunks]
    spark.createDataFrame(chunks, "chunk_id string, doc_id string, filename string, title string, text string").repartition(4).write.parquet(f"{d}/chunks.parquet")
    return d


def shuffled(spark) -> int:
    """Records that the session has written to shuffles so far."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    none = jvm.java.util.ArrayList()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(none, False, False, gateway.new_array(jvm.double, 0), none)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def same_as_sql(spark, d, name):
    con = duckdb.connect()
    for t in ("documents", "chunks"):
        con.sql(f"create view {t} as select * from '{d}/{t}.parquet/*.parquet'")
    before = shuffled(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables
    try:
        df = core.queries()[name](spark, d)
        got = [tuple(r) for r in df.collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = shuffled(spark) - before
    want = con.sql(f"select {', '.join(df.columns)} from ({core.oracle_sql()[name]})").fetchall()
    assert sorted(got) == sorted(want) and len({r[0] for r in got}) == 40
    # 40 queries times 2,000 rows would be some 80,000 records; the words of 40 asking rows, 4 tasks' best and the keys are far fewer.
    assert moved < 25_000, moved


def test_chunks_per_document(spark, tables):
    same_as_sql(spark, tables, "chunks_per_document")


def test_lexical_passes(spark, tables):
    same_as_sql(spark, tables, "lexical_passes")


def test_grouped_results(spark, tables):
    same_as_sql(spark, tables, "grouped_results")


def test_chain_with_synonyms(spark):
    from pyspark.sql import functions as F

    from legajo.functions import text as T
    from legajo.operators import chain
    from legajo.plans.details import number_stream

    chunks = [(f"c{i:04d}", None, f"caldera bomba u{'abcdefghij'[i % 10]}", None, None, None) for i in range(1500)]
    chunks = spark.createDataFrame(chunks, "chunk_id string, title string, text string, keywords array<string>, persons array<string>, organizations array<string>")
    asked = spark.createDataFrame([(i, "radiador") for i in range(120)] + [(200, "ua")], "query long, text string")
    synonyms = spark.createDataFrame([("radiador", "caldera"), ("radiador", "bomba"), ("ua", "bomba")], "word string, synonym string")
    n = lambda keep: number_stream(T.fold(F.col("text")), keep=keep)
    before = shuffled(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = sorted(tuple(r) for r in chain.search(chunks, asked, n(True), n(False), synonyms=synonyms).collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = shuffled(spark) - before
    assert got == [(i, f"c{j:04d}", 1, j + 1) for i in range(120) for j in range(20)] + [(200, f"c{j:04d}", 0, j // 10 + 1) for j in range(0, 200, 10)]
    assert moved < 100_000, moved  # 120 queries times 1,500 rows and two words are 360,000


def test_chain_passes_without_a_row_for_each_hit(spark):
    from pyspark.sql import functions as F

    from legajo.functions import text as T
    from legajo.operators import chain
    from legajo.plans.details import number_stream

    chunks = [(f"c{i:04d}", None, f"caldera bomba u{'abcdefghij'[i % 10]}", None, None, None) for i in range(1500)]
    chunks += [("z", None, "xilo", None, None, None), ("z", None, "yunque", None, None, None)]  # one identifier, two rows
    chunks = spark.createDataFrame(chunks, "chunk_id string, title string, text string, keywords array<string>, persons array<string>, organizations array<string>")
    asked = [(i, "caldera bomba ***") for i in range(120)] + [(200, "calderra bombas ***"), (201, "xilo yunque")]  # the signs make it look mistyped
    asked = spark.createDataFrame(asked, "query long, text string")
    synonyms = spark.createDataFrame([("caldera", "ua"), ("bomba", "nada")], "word string, synonym string")
    n = lambda keep: number_stream(T.fold(F.col("text")), keep=keep)
    before = shuffled(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = sorted(tuple(r) for r in chain.search(chunks, asked, n(True), n(False), synonyms=synonyms).collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = shuffled(spark) - before
    every = [(i, f"c{10 * j:04d}", 0, j + 1) for i in range(120) for j in range(20)]  # rows with the synonym go first
    assert got == [*every, *((200, f"c{j:04d}", 3, j + 1) for j in range(20)), (201, "z", 0, 1)]
    assert moved < 60_000, moved  # 120 queries times 1,500 rows are 180,000 in each of three passes
