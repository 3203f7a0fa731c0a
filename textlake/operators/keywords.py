"""C7 / S2 for many keywords: which of a keyword table's entries occur in each text.

One ``contains`` per keyword reads a text as often as there are keywords. Here
the keywords become an Aho-Corasick automaton, which finds all of them in one
pass. Folding (S1) is a Spark expression on both sides; the automaton runs in
Arrow batches over the folded column alone, and no row is exchanged by a key
(inputs of few partitions are spread over the cores).

The keyword table may grow: its bytes are counted first, and it is cut by hash
into blocks of about ``BLOCK_BYTES``. The driver and each task hold one block
at a time; with several blocks the rows and what was found so far are written
between them.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.functions.text import fold
from textlake.operators.partitioning import spread_small
from textlake.session import materialize

#: Bytes of folded keywords in one automaton; 420,000 of 10 letters took 175 MB of a worker and 5 s to build.
BLOCK_BYTES = 4 << 20


def _finder(block):
    """Texts and what earlier blocks found -> the same with the keywords of this block."""
    def find(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        import ahocorasick
        a = ahocorasick.Automaton()
        for w in block.value:
            a.add_word(w, w)
        a.make_automaton()
        # an empty word is not taken by the automaton and an automaton without words cannot search
        everywhere, search = [w for w in block.value if not w], a.iter if len(a) else lambda t: ()
        for texts, before in batches:
            out = []
            for t, found in zip(texts, before):
                out.append([*found.as_py(), *everywhere, *{w for _, w in search(t.as_py())}] if t.is_valid else None)
            yield pa.array(out, pa.list_(pa.string()))
    return F.arrow_udf(find, "array<string>")


def with_keywords(df: DataFrame, keywords: DataFrame, text: str = "text", keyword: str = "keyword", name: str = "keywords",
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``df`` with the sorted folded keywords that the folded text contains; every row and column stays.

    Keywords that fold to the same string are one; NULL keywords are ignored;
    one that folds to '' is in every text, as with ``contains``. A NULL text
    has a NULL list, a text without keywords an empty one. A column ``name``
    of the input is replaced.
    """
    words = keywords.select(fold(F.col(keyword)).alias("w")).where("w IS NOT NULL").distinct()
    size = words.agg(F.coalesce(F.sum(F.octet_length("w") + 1), F.lit(0))).first()[0]
    n_blocks = max(1, ceil(size / block_bytes))
    sc = df.sparkSession.sparkContext
    kept = [F.col(c) for c in df.columns if c != name]
    rows = spread_small(df).withColumns({"__text": fold(F.col(text)), "__found": F.array().cast("array<string>")})
    for i in range(n_blocks):
        part = words.where(F.pmod(F.xxhash64("w"), F.lit(n_blocks)) == i)
        block = sc.broadcast(tuple(sorted(r.w for r in part.collect())))
        rows = rows.withColumn("__found", _finder(block)("__text", "__found"))
        if i + 1 < n_blocks:
            rows = materialize(rows)
    return rows.select(*kept, F.array_sort("__found").alias(name))


def select_by_keywords(df: DataFrame, keywords: DataFrame, text: str = "title", keyword: str = "keyword",
                       block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows whose text contains any keyword; an empty keyword table keeps every row, a NULL text matches nothing."""
    if keywords.where(F.col(keyword).isNotNull()).isEmpty():
        return df
    found = with_keywords(df, keywords, text, keyword, "__hits", block_bytes)
    return found.where(F.size("__hits") > 0).select(*df.columns)
