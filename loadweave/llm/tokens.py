"""Token counts with a public tokenizer whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = os.environ.get("LOADWEAVE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: fixed value: the pre-token pattern that belongs to this public vocabulary
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str = PATTERN):
    """The encoding, once per Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, path: str = VOCABULARY) -> Column:
    """Tokens of the whole text; null and empty texts have 0. Equal texts in a batch are counted once."""

    @F.pandas_udf(T.LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(path)
        for s in batches:
            codes, values = pd.factorize(s.fillna(""))
            n = [len(enc.encode_ordinary(x)) for x in values]
            yield pd.Series(n, dtype="int64").take(codes).reset_index(drop=True)

    return count(text)
