"""One object over a corpus: search, detail, graph, SQL, ingestion, and the data side of question answering.

Language models are behind a protocol; nothing here needs one. Every method that returns rows returns a DataFrame.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from legajo.functions import text as T
from legajo.operators import clusters, graph, lexical, vectors
from legajo.plans import sqlsurface
from legajo.sources.files import read_files
from legajo.sources.store import upsert


class Provider(Protocol):
    """A language model: text in, text out."""

    def complete(self, prompt: str) -> str: ...


class Engine:
    """documents: doc_id, filename, raw_text, doc_type, language, title, category and arrays persons, organizations, keywords, dates.
    chunks: chunk_id, doc_id, text, chunk_index, filename, title, doc_type, language and the same arrays."""

    def __init__(self, spark: SparkSession, documents: DataFrame, chunks: DataFrame, provider: Provider | None = None):
        self.spark, self.documents, self.chunks, self.provider = spark, documents, chunks, provider

    # --- search

    def filtered(self, doc_type: str | None = None, language: str | None = None, person: str | None = None, organization: str | None = None, date: str | None = None) -> DataFrame:
        """Chunks under the filters: equality for type and language, a folded part of a name, the beginning of a date."""
        c = self.chunks
        if doc_type:
            c = c.filter(F.col("doc_type") == doc_type)
        if language:
            c = c.filter(F.col("language") == language)
        for column, part in (("persons", person), ("organizations", organization)):
            if part:
                c = c.filter(F.exists(column, lambda p: F.contains(T.fold(p), T.fold(F.lit(part)))))
        if date:
            c = c.filter(F.exists("dates", lambda x: F.startswith(x, F.lit(date))))
        return c

    def search(self, text: str, top_k: int = 10, **filters: str | None) -> DataFrame:
        """(chunk_id, doc_id, filename, title, score, matched, rank, snippet): BM25 over the filtered chunks, at most three of a document; a query of stop words only finds nothing."""
        c = self.filtered(**filters)
        post = lexical.postings(c.select("chunk_id", T.fold(F.col("text")).alias("f")), "chunk_id", T.analyzed(F.col("f")))
        q = self.spark.createDataFrame([(text,)], "t string").select(F.lit(0).alias("query"), F.explode(F.array_distinct(T.analyzed(T.fold(F.col("t"))))).alias("term"))
        hits = lexical.bm25(post, q).withColumnRenamed("id", "chunk_id").join(c.select("chunk_id", "doc_id", "filename", "title", "text"), "chunk_id")
        per_doc = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("matched"), F.desc("score"), "chunk_id"))
        best = hits.withColumn("rn", per_doc).filter("rn <= 3").orderBy(F.desc("matched"), F.desc("score"), "chunk_id").limit(top_k)
        first = next(iter(re.findall(r"\w{3,}", text)), text)
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("matched"), F.desc("score"), "chunk_id"))
        return best.withColumn("rank", rank).select("chunk_id", "doc_id", "filename", "title", "score", "matched", "rank", T.highlight(F.col("text"), F.lit(first)).alias("snippet"))

    # --- documents

    def list_documents(self) -> DataFrame:
        return self.documents.select("doc_id", "filename", F.coalesce("title", "filename").alias("title"), "doc_type", "language", "category").orderBy(F.coalesce("title", "filename"))

    def document(self, doc_id: str) -> DataFrame:
        return self.documents.filter(F.col("doc_id") == doc_id).join(self.chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks")), "doc_id", "left")

    def raw_text(self, doc_id: str) -> DataFrame:
        parts = F.sort_array(F.collect_list(F.struct("chunk_index", "chunk_id", "text")))  # one document's chunks
        return self.chunks.filter(F.col("doc_id") == doc_id).groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n\n").alias("text"))

    def summary(self, doc_id: str) -> DataFrame:
        return self.documents.filter(F.col("doc_id") == doc_id).select("doc_id", T.summary(F.col("raw_text")).alias("summary"))

    def clusters(self, document_vectors: DataFrame) -> DataFrame:
        """(id, cluster, child) of (doc_id, vector)."""
        return clusters.two_levels(document_vectors, "doc_id", "vector")

    def duplicates(self, document_vectors: DataFrame, cosine: float = 0.85) -> DataFrame:
        v = document_vectors.select(F.xxhash64("doc_id").alias("id"), "doc_id", "vector")
        return vectors.near_duplicates(v, "id", "vector", cosine).join(v.select("id", "doc_id"), "id").select("doc_id", "copies", "links")

    def stats(self) -> DataFrame:
        return self.documents.groupBy("doc_type").agg(F.count(F.lit(1)).alias("documents"))

    # --- graph

    def _mentions(self) -> DataFrame:
        return graph.merged(graph.mentions(self.documents))

    def entities(self, top_k: int = 50) -> DataFrame:
        return graph.nodes(self._mentions()).orderBy(F.desc("mentions"), "key").limit(top_k)

    def find_entity(self, name: str, top_k: int = 10) -> DataFrame:
        """Entities whose key holds the folded name, the most mentioned first; then those alike, see alike_names()."""
        return graph.alike_names(graph.nodes(self._mentions()), name).orderBy(F.desc("score"), "key").limit(top_k)

    def entity(self, name: str) -> DataFrame:
        """One entity with its eight strongest neighbours."""
        m = self._mentions()
        key = T.fold(F.lit(name))
        near = graph.related(graph.edges(m), 8).filter(F.col("src") == key).groupBy("src").agg(F.sort_array(F.collect_list(F.struct((-F.col("weight")).alias("w"), F.col("dst").alias("name")))).alias("related"))
        return graph.nodes(m).filter(F.col("key") == key).join(near, F.col("key") == near.src, "left").drop("src")

    def path(self, a: str, b: str, hops: int = 6) -> list[str]:
        """The shortest path between two entities (smallest keys on ties), found by distances from either end; [] where there is none."""
        e = graph.edges(self._mentions())
        x, y = (self.spark.range(1).select(T.fold(F.lit(n)).alias("key")) for n in (a, b))
        da, db = graph.distances(e, x, hops), graph.distances(e, y, hops)
        both = da.withColumnRenamed("hops", "ha").join(db.withColumnRenamed("hops", "hb"), "key").withColumn("total", F.col("ha") + F.col("hb"))
        least = both.agg(F.min("total")).first()[0]
        if least is None:
            return []
        on = both.filter(F.col("total") == least).groupBy("ha").agg(F.sort_array(F.collect_set("key")).alias("ks")).orderBy("ha").limit(hops + 1).collect()
        if least == 0:
            return [on[0]["ks"][0]]
        near = {(r["src"], r["dst"]) for r in graph.both_ways(e).join(both.filter(F.col("total") == least).select(F.col("key").alias("src")), "src", "left_semi").join(
            both.filter(F.col("total") == least).select(F.col("key").alias("dst")), "dst", "left_semi").collect()}
        way = [on[0]["ks"][0]]
        for r in on[1:]:
            way.append(next(k for k in r["ks"] if (way[-1], k) in near))
        return way

    # --- SQL and tools

    def sql(self, text: str, most: int = sqlsurface.MAX_ROWS) -> tuple[DataFrame, bool]:
        return sqlsurface.run_sql(self.spark, text, most)

    def tables(self) -> DataFrame:
        """(table_name, column_name, type) of the views there are."""
        rows = [(t.name, c.name, c.dataType) for t in self.spark.catalog.listTables() for c in self.spark.catalog.listColumns(t.name)]
        return self.spark.createDataFrame(rows, "table_name string, column_name string, type string")

    def peek(self, table: str, n: int = 5) -> DataFrame:
        return self.spark.table(T_NAME.sub("", table)).limit(max(1, min(10, n)))

    def ask_sql(self, question: str, attempts: int = 3) -> tuple[DataFrame, bool]:
        """A question as SQL by the provider; what does not analyse goes back to it with the error."""
        if not self.provider:
            raise RuntimeError("no provider")
        columns = "\n".join(f"{r['table_name']}.{r['column_name']} {r['type']}" for r in self.tables().collect())
        error = ""
        for _ in range(attempts):
            said = re.sub(r"^```(?:sql)?\s*|\s*```$", "", self.provider.complete(f"Tables:\n{columns}\nQuestion: {question}\n{error}One SQL query:").strip())
            try:
                return self.sql(sqlsurface.ask_count(said, question))
            except Exception as e:  # noqa: BLE001 - whatever analysis says is the provider's next hint
                error = f"The last query failed: {str(e)[:300]}\n"
        raise ValueError(error)

    def context(self, question: str, budget: int = 4000, top_k: int = 8) -> DataFrame:
        """The best chunks of a question as long as their estimated tokens (1.3 a word) fit the budget: (rank, filename, text, used)."""
        hits = self.search(question, top_k).join(self.chunks.select("chunk_id", "text"), "chunk_id")
        words = F.ceil(F.size(F.filter(F.split("text", r"\s+"), lambda x: x != "")) * 1.3)
        used = F.sum(words).over(Window.partitionBy(F.lit(0)).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))  # top_k rows
        return hits.withColumn("used", used).filter(F.col("used") <= budget).select("rank", "filename", "text", "used")

    def ask(self, question: str) -> dict:
        """Answer by the provider from the packed context, with its distinct sources."""
        if not self.provider:
            raise RuntimeError("no provider")
        rows = self.context(question).orderBy("rank").collect()
        prompt = "\n\n".join(f"[{r['filename']}]\n{r['text']}" for r in rows)
        return {"answer": self.provider.complete(f"{prompt}\n\n{question}"), "sources": list(dict.fromkeys(r["filename"] for r in rows))[:6]}

    def tools(self) -> dict[str, Callable[..., str]]:
        """The functions an agent may call; each takes keyword arguments and returns JSON."""
        show = lambda df, n=30: json.dumps([r.asDict(True) for r in df.limit(n).collect()], default=str, ensure_ascii=False)
        return {
            "search_documents": lambda query, doc_type=None: show(self.search(query, 8, doc_type=doc_type)),
            "query_data": lambda sql: show(self.sql(sql)[0]),
            "get_entity_info": lambda name: show(self.entity(name)),
            "find_connection": lambda a, b: json.dumps(self.path(a, b), ensure_ascii=False),
            "list_available_tables": lambda: show(self.tables(), 500),
            "peek_table": lambda table, n=5: show(self.peek(table, n)),
        }

    def call_tool(self, name: str, arguments: str) -> str:
        """Run a tool with JSON arguments; malformed arguments count as none, errors come back as JSON."""
        try:
            args = json.loads(arguments or "{}")
        except ValueError:
            args = {}
        try:
            return self.tools()[name](**(args if isinstance(args, dict) else {}))
        except Exception as e:  # noqa: BLE001 - the agent is told
            return json.dumps({"error": str(e)[:300]})

    # --- ingestion

    def ingest(self, folder: str) -> DataFrame:
        """The documents with those of a folder added; files that are known by name are replaced."""
        new = read_files(self.spark, folder).filter("raw_text is not null")
        enriched = new.select(
            "doc_id", "filename", "raw_text", T.doc_class(F.col("filename"), F.col("raw_text")).alias("doc_type"), T.language(F.col("raw_text")).alias("language"), T.title(F.col("raw_text"), F.col("filename")).alias("title"),
            T.people(F.col("raw_text")).alias("persons"), T.organizations(F.col("raw_text")).alias("organizations"), T.dates(F.col("raw_text")).alias("dates"))
        enriched = enriched.withColumn("category", T.category(F.col("doc_type")))
        old = self.documents.select(*enriched.columns)
        self.documents = upsert(old, enriched, ["doc_id"])
        return self.documents


class Agent:
    """A loop in which a provider answers with a tool call, {"tool": ..., "arguments": {...}}, or with its answer; six turns at most, a failed call is not repeated."""

    def __init__(self, engine: Engine, history: int = 10):
        self.engine, self.history, self.turns = engine, history, []

    def ask(self, question: str, turns: int = 6) -> dict:
        said, failed, sources = "", set(), []
        past = "".join(f"{who}: {what}\n" for who, what in self.turns[-2 * self.history :])
        for _ in range(turns):
            answer = self.engine.provider.complete(f"{past}{question}\n{said}")
            try:
                call = json.loads(answer)
                name, args = call["tool"], json.dumps(call.get("arguments", {}), sort_keys=True)
            except (ValueError, KeyError, TypeError):
                self.turns += [("user", question), ("assistant", answer)]
                return {"answer": answer, "sources": list(dict.fromkeys(sources))[:8]}
            seen = json.dumps({"error": "this call failed before"}) if (name, args) in failed else self.engine.call_tool(name, args)
            if '"error"' in seen[:10]:
                failed.add((name, args))
            elif name == "search_documents":
                sources += [r["filename"] for r in json.loads(seen)]
            said += f"{name}({args}) = {seen}\n"
        return {"answer": "", "sources": list(dict.fromkeys(sources))[:8]}


T_NAME = re.compile(r"[^A-Za-z0-9_]")
