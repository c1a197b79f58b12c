"""Problem 10: reading level by smoothed unigram language models, one per level, over words and sentence-length symbols."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from legajo.llm.runs import runs
from legajo.session import spread, text_batches

#: Labelled rows that are learnt from at most (the lowest hashes of the id).
MAX_LABELLED = 200_000
SMOOTHING = 0.5

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE_END = re.compile(r"[.!?]\s+|\n\s*\n|\n- ")


def symbols(text: str | None) -> list[str]:
    """The words of a text in small letters and, for each sentence, a symbol of its length (in tens of words, 0 to 9)."""
    text = (text or "").lower()
    words = _WORD.findall(text)
    return words and words + [f"#{min(s.count(' ') // 10, 9)}" for s in _SENTENCE_END.split(text) if s.count(" ") > 2]


def _words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in batches:
        ids, words, counts = [], [], []
        for i, t in zip(p["doc_id"], p["text"]):
            for w, n in Counter(symbols(t)).items():
                ids.append(i), words.append(w), counts.append(n)
        yield pd.DataFrame({"doc_id": ids, "word": words, "n": np.array(counts, dtype=np.int64)})


def formula_level(text_col: str = "text"):
    """A level 1-5 by mean letters per word, for corpora without labels: steps at 4.2, 5.0, 5.8 and 6.8 letters."""
    letters = F.char_length(F.regexp_replace(text_col, r"(?U)[^\p{L}]", ""))
    mean = letters / F.greatest(F.lit(1), F.regexp_count(F.col(text_col), F.lit(r"(?U)\p{L}+")))
    return F.when(mean < 4.2, 1).when(mean < 5.0, 2).when(mean < 5.8, 3).when(mean < 6.8, 4).otherwise(5)


class LevelModel:
    """log p(word | level) of every word of the labelled sample and log p(level); plain numbers, shipped to the workers."""

    def __init__(self, levels: list[int], prior: np.ndarray, words: dict[str, int], logp: np.ndarray):
        self.levels, self.prior, self.words, self.logp = levels, prior, words, logp

    def score(self, text: str | None) -> tuple[int | None, float | None, int]:
        found = symbols(text)
        if not found:
            return None, None, 0
        get = self.words.get
        ids = [k for k in map(get, found) if k is not None]
        s = self.prior + self.logp[np.array(ids, dtype=np.int64)].sum(axis=0) if ids else self.prior.copy()
        k = int(np.argmax(s))
        return self.levels[k], float(1 / np.exp(np.minimum(s - s[k], 0)).sum()), len(found)


def train_levels(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> LevelModel:
    """Fit on the labelled documents (a bounded sample: the max_labelled lowest hashes of the id).

    A text with two annotators counts half for each of their levels. Labels outside 1-5, null labels and
    labels without a document are left out. Without any usable label, formula_level seeds the training.
    The counting is done by Spark; a row of counts for each word of the sample comes back, so what is
    collected is bounded by max_labelled, not by the corpus.
    """
    text_batches(docs.sparkSession)
    marks = labels.filter("doc_id is not null and nivel between 1 and 5").groupBy("doc_id").agg(F.collect_set("nivel").alias("levels"), F.count(F.lit(1)).alias("k"))
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null")
    sample = docs.join(marks, "doc_id").select("doc_id", "text", F.explode("levels").alias("level"), (1 / F.size("levels")).alias("weight"))
    if not sample.limit(1).count():
        sample = docs.orderBy(F.xxhash64("doc_id")).limit(max_labelled).select("doc_id", "text", formula_level("text").alias("level"), F.lit(1.0).alias("weight"))
    prior = {r["level"]: r["w"] for r in sample.groupBy("level").agg(F.sum("weight").alias("w")).collect()}
    counts = sample.select("doc_id", "text").dropDuplicates(["doc_id"]).mapInPandas(_words, "doc_id long, word string, n long")
    by = counts.join(sample.drop("text"), "doc_id").groupBy("word").pivot("level", [1, 2, 3, 4, 5]).agg(F.sum(F.col("n") * F.col("weight")))
    found = by.na.fill(0.0).toPandas().sort_values("word")
    levels = sorted(prior) or [3]
    c = found[[str(k) for k in levels]].to_numpy(dtype=float)
    logp = np.log((c + SMOOTHING) / (c.sum(axis=0) + SMOOTHING * (len(c) + 1)))
    w = np.array([prior.get(k, 1.0) for k in levels])
    return LevelModel(levels, np.log(w / w.sum()), {w: i for i, w in enumerate(found["word"])}, logp)


def reading_levels(docs: DataFrame, model: LevelModel, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, [keep], level, posterior, n_words): the level with the highest posterior.

    n_words counts runs of characters other than blanks, tabs and line ends. A null text, or one without
    a letter, has a null level. Words outside the models are no evidence. Ties go to the lower level.
    """
    spark = docs.sparkSession
    text_batches(spark)
    keep = [c for c in keep or [] if c != "doc_id"]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *(docs.schema[c] for c in keep), T.StructField("level", T.IntegerType()), T.StructField("posterior", T.DoubleType()), T.StructField("n_words", T.IntegerType())])
    shipped = spark.sparkContext.broadcast(model)  # the words of at most MAX_LABELLED texts

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shipped.value
        for p in batches:
            rows = [m.score(t) for t in p["__text"]]
            out = p[["doc_id", *keep]].copy()
            out["level"] = pd.array([r[0] for r in rows], dtype="Int32")
            out["posterior"] = [r[1] for r in rows]
            out["n_words"] = [len(runs(t)) for t in p["__text"]]
            yield out

    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, F.col("text").alias("__text"))).mapInPandas(score, schema)


def level_profile(levels: DataFrame) -> DataFrame:
    """Documents by level, lang (lower case) and source: (level, lang, source, docs, words)."""
    return levels.groupBy("level", F.lower("lang").alias("lang"), "source").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_words").alias("words"))
