"""Byte-pair token counts.

Each text is encoded where it lies, one at a time within its Arrow batch: only
the text goes to the worker and only its count comes back, nothing is shuffled.

NULL and empty texts have 0 tokens. Strings of special tokens are plain text.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.operators.partitioning import spread_small

#: How a byte-level vocabulary of 50,257 ids cuts texts (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    import tiktoken
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("from-file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _counter(path: str, pattern: str):
    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        encode = _encoding(path, pattern).encode_ordinary
        return pa.array((len(encode(t.as_py() or "")) for t in texts), pa.int64(), size=len(texts))
    return count


def with_bpe_count(df: DataFrame, vocabulary: str, text: str = "text", name: str = "tokens", pattern: str = PATTERN) -> DataFrame:
    """``df`` with the number of tokens of each text; every row and column stays.

    ``vocabulary`` is a file of base64 tokens and their ranks that every worker can read.
    """
    kept = [c for c in df.columns if c != name]
    return spread_small(df).select(*kept, _counter(vocabulary, pattern)(F.col(text)).alias(name))
