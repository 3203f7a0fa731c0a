"""K4: token counting.

Default: a native word/number/punctuation count (one regex pass inside
codegen, no per-row Python). The BPE vocabulary the reference counts with
is not available offline; :func:`bpe_token_count` wraps it as an Arrow UDF
when the encoding can be loaded, and callers pass whichever column they
want to the budget and profile operators.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from textlake.functions.text import PY_WHITESPACE

# A token is a run of letters, a run of digits, or one other non-space char.
TOKEN_PATTERN = r"\p{L}+|\p{N}+|[^\p{L}\p{N}" + PY_WHITESPACE + "]"


def token_count(c: Column) -> Column:
    """Native token count; NULL text counts as 0."""
    return F.coalesce(F.regexp_count(c, F.lit(TOKEN_PATTERN)), F.lit(0)).cast("long")


def tokens(c: Column) -> Column:
    """The tokens themselves (array<string>)."""
    return F.regexp_extract_all(c, F.lit(TOKEN_PATTERN), 0)


@lru_cache(maxsize=4)
def _encoding(name: str):
    import tiktoken  # optional; needs its vocabulary file locally
    return tiktoken.get_encoding(name)


def bpe_available(name: str = "cl100k_base") -> bool:
    try:
        _encoding(name)
        return True
    except Exception:
        return False


def bpe_token_count(c: Column, name: str = "cl100k_base") -> Column:
    """BPE token count as an Arrow UDF (only when the encoding loads)."""

    @F.pandas_udf("long")
    def _count(s: pd.Series) -> pd.Series:
        enc = _encoding(name)
        return s.map(lambda t: 0 if t is None else len(enc.encode(t, disallowed_special=())))

    return _count(c)
