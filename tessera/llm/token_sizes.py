"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
import tiktoken
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the public vocabulary lies on every machine; a parameter of each operator.
RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the pattern that goes with the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoder(ranks: str) -> tiktoken.Encoding:
    """The tokenizer of a rank file, loaded once in a worker."""
    with open(ranks, "rb") as lines:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})


def token_size(text: Column, ranks: str = RANKS) -> Column:
    """Number of tokens of the whole text, an int; 0 for null and empty texts."""

    @F.pandas_udf(T.IntegerType())
    def size(texts: pd.Series) -> pd.Series:
        encode = encoder(ranks).encode_ordinary
        return pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int32")

    return size(text)
