"""Sizes of texts in tokens of a public tokenizer.

Vocabularies are read from a folder that is a parameter; none is part of the package.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folder of the vocabulary files, on every executor.
FOLDER = os.environ.get("SPARRIX_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits a text before the merges of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(2)
def _encoder(folder: str, vocabulary: str):
    import tiktoken

    with open(f"{folder}/{vocabulary}", "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("sparrix", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(texts: list[str | None], folder: str = FOLDER, vocabulary: str = VOCABULARY) -> np.ndarray:
    """Tokens of each text; null has none."""
    encode = _encoder(folder, vocabulary).encode_ordinary
    return np.array([len(encode(t)) if t else 0 for t in texts], np.int64)


def token_counts(docs: DataFrame, doc: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc``, ``keep``, ``tokens``: one row for each document of at least one token.

    Null and empty texts have no token and give no row.
    """

    @F.arrow_udf(T.LongType())
    def tokens(texts: pa.Array) -> pa.Array:
        return pa.array(count_tokens(texts.to_pylist(), folder, vocabulary))

    rows = docs.where(F.col(doc).isNotNull() & F.col(text).isNotNull() & (F.col(text) != ""))
    return rows.select(F.col(doc).alias("doc"), *keep, tokens(F.col(text)).alias("tokens")).where("tokens > 0")
