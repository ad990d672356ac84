"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"  # a folder with vocabulary files; never copied
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


@lru_cache(maxsize=2)
def encoding(folder: str, vocabulary: str):
    """The tokenizer of a rank file, once per process."""
    import tiktoken

    try:
        from public_tokenizers import PATTERN
    except ImportError:
        PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    with Path(folder, vocabulary).open("rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(df: DataFrame, ident: str, text: str, *, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``ident`` and ``tokens`` of each row; a null text has 0 tokens. Rows with a null ``ident`` are left out, and of
    rows with one ``ident`` a single one is kept, that with the largest text."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(folder, vocabulary)
        for batch in batches:
            yield pd.DataFrame({ident: batch[ident], "tokens": [0 if t is None else len(enc.encode_ordinary(t)) for t in batch[text]]})

    kind = df.schema[ident].dataType.simpleString()
    sized = df.select(ident, text).filter(F.col(ident).isNotNull()).mapInPandas(count, f"`{ident}` {kind}, tokens long")
    return sized.groupBy(ident).agg(F.max("tokens").alias("tokens"))
