"""Helpers shared by the operators: safe columns, scratch tables, word hashing.

The word kernel works on the bytes of an Arrow text column without a Python
object per word: it finds words, hashes each to 64 bits and gives per-document
word counts. Its memory is a small multiple of ``BLOCK_BYTES`` plus eight bytes
per word of the batch slice it is given.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textlake.session import scratch_path

#: Text bytes that a kernel handles at once (a longer document goes alone).
BLOCK_BYTES = 1 << 20
#: Bytes of an Arrow batch inside ``small_batches``.
BATCH_BYTES = 4 << 20
#: White space between words: space and U+0009 to U+000D.
SPACE_CLASS = "[\\x20\\x09-\\x0D]"
WORD_CLASS = "[^\\x20\\x09-\\x0D]"
_SPACES = " \t\n\x0b\x0c\r"


def words_col(text: Column) -> Column:
    """Array of the words of a text; NULL text gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), "")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spaces() -> str:
    return _SPACES


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared scratch folder and read back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def forget(df: DataFrame) -> None:
    """Delete the files of a ``saved`` table that nothing reads any more."""
    sc = df.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(df._scratch)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def partitions_for(spark: SparkSession) -> int:
    """Partitions for CPU-heavy work on a table: the session's shuffle setting."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# -- worker memory ------------------------------------------------------------

_RESIDENT: dict = {}


def resident(key: tuple, make: Callable):
    """The one large object that a worker keeps between its tasks; asking for another drops it."""
    if key not in _RESIDENT:
        _RESIDENT.clear()
        _RESIDENT[key] = make()
    return _RESIDENT[key]


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run: Callable, keeps: bool = False) -> Callable:
    """A kernel whose worker gives freed memory back at its end.

    Spark reuses Python workers, so what Arrow's pool and the C library hold
    would stay with the executor through all later stages. Kernels that do not
    use the resident object (``keeps``) drop it first.
    """
    def kernel(batches):
        if not keeps:
            _RESIDENT.clear()
        try:
            yield from run(batches)
        finally:
            _give_back()
    return kernel


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Python kernels that run inside get their rows in batches of BATCH_BYTES, or of one larger row.

    The session's own limit is ten thousand rows, which with long texts are tens
    of MB, held by the JVM and by the worker, once more for the batch that is on its way.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def lean_group(run: Callable, tables: int = 1) -> Callable:
    """The same for a kernel of groups: a function of one or two tables that gives a table."""
    def given_back(*group: pa.Table) -> pa.Table:
        _RESIDENT.clear()
        try:
            return run(*group)
        finally:
            _give_back()
    # Spark looks at the number of arguments
    return (lambda one: given_back(one)) if tables == 1 else (lambda left, right: given_back(left, right))


# -- word kernel --------------------------------------------------------------

_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE_KEY = mix64(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_POS_KEY = mix64(np.arange(1, 4097, dtype=np.uint64) * _U(0xD1B54A32D192ED03)) | _U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Separators of ``letters`` words: every ASCII byte that is no letter or digit.
_NO_LETTER = np.zeros(256, dtype=bool)
_NO_LETTER[:128] = True
_NO_LETTER[48:58] = False
_NO_LETTER[65:91] = False
_NO_LETTER[97:123] = False


def _pos_key(pos: np.ndarray) -> np.ndarray:
    if not len(pos) or pos.max() < len(_POS_KEY):
        return _POS_KEY[pos]
    return mix64((pos.astype(np.uint64) + _U(1)) * _U(0xD1B54A32D192ED03)) | _U(1)


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; NULL counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    off = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset:col.offset + len(col) + 1]
    data = col.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0]:off[-1]], off - off[0]


def slices(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``limit`` text bytes each, one document at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def word_hashes(buf: np.ndarray, offsets: np.ndarray, letters: bool = False,
                prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (A-Z lower-cased) and the words of each document.

    ``letters``: words are runs of ASCII letters, digits and all other
    non-ASCII characters, so punctuation does not stick to them. With
    ``prefixes`` each word gives a row of 1 + len(prefixes) hashes: its own
    and those of its first bytes (of the whole word, where it is shorter).
    """
    n_docs = len(offsets) - 1
    width = 1 + len(prefixes)
    none = np.zeros((0, width) if prefixes else 0, np.uint64), np.zeros(n_docs, np.int64)
    if not len(buf):
        return none
    inside = ~(_NO_LETTER if letters else _IS_SPACE)[buf]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[firsts] = inside[firsts]
    kept = np.flatnonzero(inside)
    if not len(kept):
        return none
    at = np.flatnonzero(begins)
    starts = np.flatnonzero(begins[kept])
    lens = np.diff(np.append(starts, len(kept)))
    pos = np.arange(len(kept), dtype=np.int64) - np.repeat(starts, lens)
    value = _BYTE_KEY[_LOWER[buf[kept]]] * _pos_key(pos)
    key = _U(0x9E3779B97F4A7C15)
    h = mix64(np.add.reduceat(value, starts) + lens.astype(np.uint64) * key)
    if prefixes:
        # the length of a prefix is part of its hash; a short word is its own prefix of the same name
        cut = [mix64(np.add.reduceat(np.where(pos < k, value, _U(0)), starts) + mix64(np.full(1, k, np.uint64))) for k in prefixes]
        h = np.stack([h, *cut], axis=1)
    return h, np.diff(np.searchsorted(at, offsets))


def shingle_hashes(h: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size``-word shingles and the document number of each, repeats included.

    A document with fewer words than ``size`` has its whole sequence as its
    only shingle; one without words has none.
    """
    ends = np.cumsum(counts)
    doc = np.repeat(np.arange(len(counts)), counts)
    if not len(h):
        return h, doc
    out = h.copy()
    key = _U(0x9E3779B97F4A7C15)
    for k in range(1, size):
        n = max(len(h) - k, 0)
        nxt = np.zeros_like(h)
        nxt[:n] = h[k:]
        same = np.zeros(len(h), bool)
        same[:n] = doc[k:] == doc[:n]
        out = mix64(out * _U(3) + key) + np.where(same, nxt, _U(0)) * _U(0xC2B2AE3D27D4EB4F)
    out = mix64(out)
    index = np.arange(len(h)) - np.repeat(ends - counts, counts)
    keep = (index + size <= counts[doc]) | ((counts[doc] < size) & (index == 0))
    return out[keep], doc[keep]


def distinct_per_doc(values: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each document, sorted inside it, and how many each has.

    ``doc`` ascends. One short sort a document is faster than one sort by two keys.
    """
    cuts = np.searchsorted(doc, np.arange(n_docs + 1))
    parts = [np.unique(values[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
    sizes = np.fromiter(map(len, parts), np.int64, n_docs)
    return (np.concatenate(parts) if parts else values[:0]), sizes
