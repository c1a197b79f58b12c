"""Sizes of texts in tokens of a public tokenizer (problems 8 and 9)."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from legajo.session import spread, text_batches

TOKENIZER = os.environ.get("LEGAJO_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: The tokenizer's own pre-splitting pattern, a fixed value that belongs to the vocabulary file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_loaded: dict[str, object] = {}


def encoding(path: str = TOKENIZER):
    """The tokenizer of a rank file, loaded once for each Python worker."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def token_sizes(df: DataFrame, text_col: str, keep: list[str], tokenizer: str = TOKENIZER) -> DataFrame:
    """The columns `keep` with n_tokens (bigint). Null and empty texts have 0 tokens; the text goes no further."""
    text_batches(df.sparkSession)
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("n_tokens", T.LongType())])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoding(tokenizer).encode_ordinary
        for p in batches:
            out = p[keep].copy()
            out["n_tokens"] = [len(encode(t)) if t else 0 for t in p["__text"]]
            yield out

    return spread(df.select(*keep, F.col(text_col).alias("__text"))).mapInPandas(count, schema)
