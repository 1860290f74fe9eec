"""Token counts under a public tokenizer, whose file is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The rank file of a byte-level BPE for many languages.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoder(path: str = TOKENIZER):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(text: str, path: str = TOKENIZER) -> int:
    return len(encoder(path).encode_ordinary(text))


def with_token_counts(df: DataFrame, key: str, text: str, *keep: str, path: str = TOKENIZER) -> DataFrame:
    """(key, keep..., tokens) for every row; null and empty texts have 0 tokens."""
    slim = df.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)])
    kinds = dict(slim.dtypes)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for pdf in batches:
            pdf["tokens"] = [len(enc.encode_ordinary(t)) if t else 0 for t in pdf.pop("_text")]
            yield pdf

    schema = ", ".join([f"_key {kinds['_key']}", *[f"_k{i} {kinds[f'_k{i}']}" for i in range(len(keep))], "tokens long"])
    out = slim.mapInPandas(scan, schema)
    return out.select(F.col("_key").alias(key), *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], "tokens")
