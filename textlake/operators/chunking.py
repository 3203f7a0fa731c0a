"""Chunkers (K1-K3, F1, D7).

* :func:`word_windows` -- every ``n`` words joined by a space, fully native.
* :func:`explode_recursive` -- the recursive character splitter over Arrow
  batches: one text at a time, chunk rows leave in small batches. Each document
  is split independently, so the work is embarrassingly parallel; a worker
  holds one batch of texts and ``OUT_CHARS`` of chunks, whatever the table.
* :func:`recursive_chunks` -- the same as an Arrow UDF column.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlake.functions.text import PY_WHITESPACE
from textlake.operators.partitioning import spread_small
from textlake.params import CHUNK_OVERLAP, CHUNK_SEPARATORS, CHUNK_SIZE

WORD_PATTERN = "[^" + PY_WHITESPACE + "]+"
#: Characters of chunks that the splitter holds before they leave the worker.
OUT_CHARS = 1 << 20


# ---- word windows (native) ---------------------------------------------

def words(c: Column) -> Column:
    """Runs of non-whitespace (Python's notion of whitespace), as a split on
    whitespace with empty pieces removed -- the same words as extracting
    every ``WORD_PATTERN`` match, at about half the cost."""
    return F.array_remove(F.split(c, "[" + PY_WHITESPACE + "]+"), "")


def word_windows(w: Column, n: int) -> Column:
    """``array<string>`` of n-word windows (empty for no words).

    ``w`` must be a column *reference* to the word array (see
    :func:`with_word_windows`): an expression inside the lambda would be
    re-evaluated for every window.
    """
    k = F.ceil(F.size(w) / F.lit(n)).cast("int")
    return F.when(F.size(w) > 0, F.transform(
        F.sequence(F.lit(0), k - 1),
        lambda i: F.array_join(F.slice(w, i * n + 1, F.lit(n)), " "))
    ).otherwise(F.array().cast("array<string>"))


def with_word_windows(df: DataFrame, text: str, n: int, name: str = "windows") -> DataFrame:
    """Adds ``name`` = n-word windows of ``text`` (words extracted once)."""
    return spread_small(df).withColumn("_words", words(F.col(text))) \
             .withColumn(name, word_windows(F.col("_words"), n)).drop("_words")


def explode_chunks(df: DataFrame, chunks: Column, key: str, keep: list[str]) -> DataFrame:
    """One row per chunk, metadata copied, ``chunk_no`` from 1,
    ``text_id = {key}_chunk{n}``."""
    # posexplode_outer + an explicit filter: with plain posexplode the
    # optimizer infers ``size(chunks) > 0`` below the generator and inlines
    # the whole chunk expression there, evaluating it twice.
    out = df.select(*keep, F.posexplode_outer(chunks).alias("_pos", "chunk")) \
        .where(F.col("chunk").isNotNull())
    return _with_text_id(out.withColumn("chunk_no", (F.col("_pos") + 1).cast("int")), key).drop("_pos")


def _with_text_id(chunks: DataFrame, key: str) -> DataFrame:
    return chunks.withColumn("text_id", F.concat(F.col(key).cast("string"), F.lit("_chunk"),
                                                 F.col("chunk_no").cast("string")))


# ---- recursive character splitter --------------------------------------

def _pieces(text: str, sep: str) -> list[str]:
    """Cut at ``sep``, each separator starting the piece after it."""
    if sep == "":
        return list(text)
    parts = text.split(sep)
    out = [parts[0]] + [sep + p for p in parts[1:]]
    return [p for p in out if p != ""]


def _merge(pieces: list[str], size: int, overlap: int) -> list[str]:
    """Greedy windows of pieces: emit when the next piece would overflow,
    then drop pieces from the front until at most ``overlap`` chars remain
    and the next piece fits."""
    out: list[str] = []
    window: list[str] = []
    total = 0
    for p in pieces:
        n = len(p)
        if window and total + n > size:
            joined = "".join(window).strip()
            if joined:
                out.append(joined)
            while window and (total > overlap or total + n > size):
                total -= len(window.pop(0))
        window.append(p)
        total += n
    joined = "".join(window).strip()
    if joined:
        out.append(joined)
    return out


def split_recursive(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
                    separators=CHUNK_SEPARATORS) -> list[str]:
    """K1 / K2: split on the first separator present, recurse on long pieces."""
    seps = list(separators)
    sep, rest = seps[-1], []
    for i, s in enumerate(seps):
        if s == "" or s in text:
            sep, rest = s, seps[i + 1:]
            break
    out: list[str] = []
    short: list[str] = []
    for p in _pieces(text, sep):
        if len(p) < size:
            short.append(p)
            continue
        if short:
            out += _merge(short, size, overlap)
            short = []
        out += split_recursive(p, size, overlap, rest) if rest else [p]
    if short:
        out += _merge(short, size, overlap)
    return out


def recursive_chunks(c: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
                     separators=CHUNK_SEPARATORS) -> Column:
    """Arrow UDF column ``array<string>``; NULL text gives NULL (no chunks)."""
    seps = tuple(separators)

    @F.pandas_udf("array<string>")
    def _split(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else split_recursive(t, size, overlap, seps))

    return _split(c)


def _chunk_rows(keep: list[str], size: int, overlap: int, separators: tuple[str, ...], out_chars: int):
    """``mapInArrow`` kernel: rows (*keep, chunk, chunk_no); NULL texts give none."""
    def rows(b, at, chunks, numbers):
        kept = [b.column(c).take(pa.array(at, pa.int32())) for c in keep]
        return pa.RecordBatch.from_arrays([*kept, pa.array(chunks, pa.string()), pa.array(numbers, pa.int32())],
                                          [*keep, "chunk", "chunk_no"])

    def run(batches):
        for b in batches:
            texts = b.column("_text")
            at, chunks, numbers, held = [], [], [], 0
            for i in range(b.num_rows):
                t = texts[i].as_py()
                if t is None:
                    continue
                for n, c in enumerate(split_recursive(t, size, overlap, separators), 1):
                    at.append(i)
                    chunks.append(c)
                    numbers.append(n)
                    held += len(c)
                    if held >= out_chars:
                        yield rows(b, at, chunks, numbers)
                        at, chunks, numbers, held = [], [], [], 0
            if at:
                yield rows(b, at, chunks, numbers)
    return run


def explode_recursive(df: DataFrame, text: str, key: str, keep: list[str], size: int = CHUNK_SIZE,
                      overlap: int = CHUNK_OVERLAP, separators=CHUNK_SEPARATORS, out_chars: int = OUT_CHARS) -> DataFrame:
    """One row per recursive chunk, as :func:`explode_chunks` of :func:`recursive_chunks`."""
    rows = df.select(*keep, F.col(text).alias("_text"))
    schema = T.StructType([*df.select(*keep).schema.fields, T.StructField("chunk", T.StringType()),
                           T.StructField("chunk_no", T.IntegerType())])
    return _with_text_id(rows.mapInArrow(_chunk_rows(keep, size, overlap, tuple(separators), out_chars), schema), key)


def chunk_file(stem: Column, n: Column) -> Column:
    """``{stem}_{n:04}`` kept as a column instead of one file per chunk."""
    return F.format_string("%s_%04d", stem, n)

