"""Sizes of texts in tokens of a public tokenizer (byte-level BPE; ranks file as a parameter)."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that belongs to this vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoding(path: str = TOKENIZER):
    """Loaded once a Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_tokens(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """doc_id, source, tokens: whole texts, special strings as ordinary text; 0 for null and empty texts.

    Rows without doc_id are left out; a doc_id that stands again counts once.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(path)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if isinstance(t, str) and t else 0 for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "tokens": n})

    sized = documents.filter(F.col("doc_id").isNotNull()).select("doc_id", "source", "text").mapInPandas(count, "doc_id long, source string, tokens long")
    return sized.groupBy("doc_id").agg(F.max(F.struct("tokens", "source")).alias("x")).select("doc_id", "x.source", "x.tokens")
