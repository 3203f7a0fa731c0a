"""Homomorphic multiset hash of texts: wide vectors of paragraphs summed modulo 2^16.

A text is the multiset of its paragraphs (its ``\\n``-separated lines, blank
ones included). A paragraph gives a vector of ``LANES`` 16-bit lanes:

* 32 identity lanes, the 64-byte BLAKE2b digest of its bytes,
* 256 likeness lanes: each of its three-word shingles (a shorter paragraph is
  one shingle) adds +1 or -1 to one lane, both taken from the shingle's hash.

The fingerprint of a text is the sum of its paragraphs' vectors, lane by lane
modulo 2^16. So it does not depend on their order, equal texts have equal
fingerprints, the fingerprint of a union is a sum, and paragraphs are inserted
or deleted by adding or subtracting their vectors alone (:func:`combine`).

:func:`likeness` of two fingerprints is 1 for equal ones, else
``1 - |a - b|^2 / (|a|^2 + |b|^2)`` over the likeness lanes, cut to 0..1: an
estimate of ``2 <x, y> / (<x, x> + <y, y>)`` over the counts x and y of the
shingles, with a standard error of about ``sqrt(2 / 256)``. Differences are
read as signed 16-bit numbers, so it holds while no lane differs by more than
32,767. Identity lanes are uniformly random: two multisets share them by
chance with a probability of 2^-512.

Defined cases: a NULL text is an empty one; an empty text is one blank
paragraph. Repeated rows are each a row of the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, saved, shingle_hashes, word_hashes

IDENTITY = 32
LIKENESS = 256
LANES = IDENTITY + LIKENESS
SHINGLE = 3
#: Text bytes of a part, the rows that one task orders and walks through.
PART_BYTES = 32 << 20
#: Parts at most (larger ones beyond 3 TB), so that their bounds stay small.
MAX_PARTS = 100_000
#: Characters of texts that a kernel hashes at once (a longer text goes alone).
BLOCK_CHARS = 1 << 20
#: Copies of one (id, text) from which they are worked out once and multiplied.
MANY_COPIES = 10_000
_RESULT = ("doc_id long, n_chars long, edited_sha256 string, vector binary, edited_vector binary, "
           "near_edited double, near_next double")


def fingerprints(texts: list[str | None]) -> np.ndarray:
    """Vectors (u16) of texts, one row each; None is the empty multiset: no paragraph at all."""
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    lines = [[] if t is None else r.split(b"\n") for t, r in zip(texts, raw)]
    per = np.fromiter(map(len, lines), np.int64, len(texts))
    flat = [x for ls in lines for x in ls]
    out = np.zeros((len(texts), LANES), np.uint16)
    owner = np.repeat(np.arange(len(texts)), per)
    if not flat:
        return out
    digests = np.frombuffer(b"".join(hashlib.blake2b(x).digest() for x in flat), "<u2").reshape(-1, IDENTITY)
    some = np.flatnonzero(per)
    starts = (np.cumsum(per) - per)[some]
    out[some, :IDENTITY] = np.add.reduceat(digests, starts, axis=0, dtype=np.uint16)
    sizes = np.fromiter(map(len, flat), np.int64, len(flat))
    words, counts = word_hashes(np.frombuffer(b"".join(flat), np.uint8), np.concatenate([[0], np.cumsum(sizes)]))
    h, line = shingle_hashes(words, counts, SHINGLE)
    lane = (h >> np.uint64(8)).astype(np.int64) % LIKENESS
    sign = np.where(h & np.uint64(1), 1.0, -1.0)
    sums = np.bincount(owner[line] * LIKENESS + lane, sign, len(texts) * LIKENESS)
    out[:, IDENTITY:] = sums.astype(np.int64).astype(np.uint16).reshape(-1, LIKENESS)
    return out


def combine(vectors: np.ndarray, inserted: np.ndarray | int = 0, deleted: np.ndarray | int = 0) -> np.ndarray:
    """Fingerprints after paragraphs with the vectors ``inserted`` came and those with ``deleted`` went."""
    return (vectors + inserted - deleted).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Likeness 0..1 of fingerprints row by row."""
    x, y = (v[:, IDENTITY:].view(np.int16).astype(np.float64) for v in (a, b))
    gap = combine(a, deleted=b)[:, IDENTITY:].view(np.int16).astype(np.float64)
    total = (x * x).sum(1) + (y * y).sum(1)
    like = np.clip(1 - (gap * gap).sum(1) / np.maximum(total, 1), 0, 1)
    like[total == 0] = 0
    like[(a == b).all(1)] = 1
    return like


def _fingerprint_column(batches):
    for b in batches:
        texts = [t or "" for t in b.column("text").to_pylist()]
        found = [fingerprints(texts[i:j]) for i, j in _runs(texts)]
        raw = np.concatenate(found).astype("<u2").tobytes() if found else b""
        cells = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * LANES), len(texts), [None, pa.py_buffer(raw)])
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), cells.cast(pa.binary())], ["doc_id", "vector"])


def text_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, vector): the fingerprint of each text as little-endian bytes."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_fingerprint_column, "doc_id long, vector binary")


def _runs(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``BLOCK_CHARS`` characters each, one text at least."""
    i, held = 0, 0
    for j, t in enumerate(texts):
        if held and held + len(t) > BLOCK_CHARS:
            yield i, j
            i, held = j, 0
        held += len(t) + 1
    if held:
        yield i, len(texts)


def _edits(texts: list[str], following: list[str]) -> pa.RecordBatch:
    """Result columns for texts and the text after each.

    The edited text keeps the paragraphs before its cut, so its fingerprint is
    that of the text with the paragraphs from the cut on deleted and the new
    ones inserted; kept paragraphs are not hashed again.
    """
    heads, olds, news, digests = [], [], [], []
    for t, nxt in zip(texts, following):
        cut = len(t) - len(t) // 2
        line = t.rfind("\n", 0, cut) + 1  # of the paragraph with the cut
        tail = nxt[:len(t) // 2]
        heads.append(t[:line - 1] if line else None)
        olds.append(t[line:])
        news.append(t[line:cut] + tail)
        digests.append(hashlib.sha256((t[:cut] + tail).encode("utf-8", "surrogatepass")).hexdigest())
    old = fingerprints(olds)
    own = combine(fingerprints(heads), inserted=old)
    edited = combine(own, inserted=fingerprints(news), deleted=old)
    after = np.concatenate([own[1:], fingerprints(following[-1:])])  # each text's next is the following row
    cells = [pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * LANES), len(texts), [None, pa.py_buffer(v.astype("<u2").tobytes())])
             .cast(pa.binary()) for v in (own, edited)]
    return pa.RecordBatch.from_arrays(
        [pa.array([len(t) for t in texts], pa.int64()), pa.array(digests), *cells, pa.array(likeness(own, edited)), pa.array(likeness(own, after))],
        ["n_chars", "edited_sha256", "vector", "edited_vector", "near_edited", "near_next"])


def _walk(batches):
    """Kernel: rows ordered by part and place; a guest ends its part and gives no row of its own."""
    ids, texts, copies, parts, size = [], [], [], [], 0
    ended = False

    def flush():
        # all held rows but the newest have their next text beside them, within one part
        n = len(texts) - 1
        for i, j in _runs(texts[:n]):
            while i < j:  # a part's guest is the last of its rows
                k = i
                while k < j and copies[k]:
                    k += 1
                if k > i:
                    out = _edits(texts[i:k], texts[i + 1:k + 1])
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i:k], pa.int64()), *out.columns], ["doc_id", *out.schema.names])
                i = k + 1
        del ids[:n], texts[:n], copies[:n], parts[:n]

    for b in batches:
        for d, t, c, p in zip(*(b.column(x).to_pylist() for x in ("doc_id", "text", "copies", "part"))):
            if c == 0 and ended and parts[-1] == p:
                continue  # one guest is enough
            ended = c == 0
            ids.append(d)
            texts.append(t)
            copies.append(c)
            parts.append(p)
            size += len(t) + 1
            if size > BLOCK_CHARS:
                yield from flush()
                size = len(texts[-1])
    if len(texts) > 1:
        yield from flush()


def _part_of(bounds):
    """Part of a row: the last whose first (order, tie) is not above the row's."""
    @F.pandas_udf("long")
    def part(order: pd.Series, tie: pd.Series) -> pd.Series:
        first = bounds.value
        row = np.empty(len(order), first.dtype)
        row["order"], row["tie"] = order, tie
        return pd.Series(np.searchsorted(first, row, side="right") - 1)
    return part


def _order(doc_id: Column) -> Column:
    """Ascending for descending ids, NULL last."""
    return F.coalesce(F.bitwise_not(doc_id), F.lit((1 << 63) - 1))


def edited_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part_bytes: int = PART_BYTES,
                        many_copies: int = MANY_COPIES) -> DataFrame:
    """Rows (doc_id, n_chars, edited_sha256, vector, edited_vector, near_edited, near_next) of all documents.

    Documents are ordered by descending doc_id, NULL last, then by a hash of
    their text; after the last comes the first. The edited text has the last
    ``n_chars div 2`` characters replaced by the first as many of the next
    document's text. Texts are exchanged once: rows go to the part of the order
    that stored bounds give, and the first row of a part is also sent as a guest
    to the part before. (id, text) pairs with ``many_copies`` rows or more
    travel once with their number: all copies but one are followed by an equal
    text.
    """
    spark = docs.sparkSession
    d = F.col("doc_id")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.select("*", _order(d).alias("order"), F.xxhash64("text").alias("tie"))
    keys = saved(rows.groupBy("order", "tie").agg(F.count("*").alias("copies"), F.max(F.octet_length("text")).alias("bytes")), "fingerprint-keys")
    n_bytes, n_rows, most = keys.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("copies"), F.lit(0)),
                                     F.coalesce(F.max("copies"), F.lit(0))).first()
    n_parts = max(min(int(n_bytes) // part_bytes, MAX_PARTS) + 1, spark.sparkContext.defaultParallelism)
    ranged = keys.repartitionByRange(n_parts, "order", "tie").groupBy(F.spark_partition_id().alias("p"))
    first = sorted(tuple(r) for r in ranged.agg(F.min("order"), F.min_by("tie", F.struct("order", "tie"))).drop("p").collect())  # a row per part
    bounds = np.array(first, [("order", "i8"), ("tie", "i8")])
    n_parts = max(len(bounds), 1)
    rows = rows.withColumn("copies", F.lit(1).cast("long"))
    many = max(many_copies, int(n_rows) // 100_000)
    if most >= many:  # at most n_rows / many keys, 100,000 at any size
        hot = F.broadcast(keys.where(F.col("copies") >= many).select("order", "tie"))
        once = saved(rows.join(hot, ["order", "tie"], "left_semi").groupBy("order", "tie")
                     .agg(F.min("doc_id").alias("doc_id"), F.min("text").alias("text"), F.count("*").alias("copies")), "fingerprint-copies")
        rows = rows.join(hot, ["order", "tie"], "left_anti").unionByName(once)
    begins = spark.createDataFrame([(o, t, (p - 1) % n_parts) for p, (o, t) in enumerate(bounds.tolist())], "order long, tie long, part long")
    guests = rows.join(F.broadcast(begins), ["order", "tie"]).withColumn("copies", F.lit(0).cast("long"))
    rows = rows.withColumn("part", _part_of(spark.sparkContext.broadcast(bounds))("order", "tie"))
    dealt = rows.unionByName(guests).repartitionById(n_parts, F.col("part").cast("int"))
    ordered = dealt.sortWithinPartitions("part", F.col("copies") == 0, "order", "tie").select("doc_id", "text", "copies", "part")
    out = ordered.mapInArrow(lean(_walk), _RESULT)
    if most < many:
        return out
    same = once.where("copies > 1").select("doc_id", "text", "copies").mapInArrow(_followed_by_itself, f"n long, {_RESULT}")
    return out.unionByName(same.withColumn("n", F.explode(F.sequence(F.lit(2).cast("long"), "n"))).drop("n"))


def _followed_by_itself(batches):
    for b in batches:
        for i in range(b.num_rows):
            t = b.column("text")[i].as_py()
            out = _edits([t], [t])
            yield pa.RecordBatch.from_arrays([b.column("copies").slice(i, 1), b.column("doc_id").slice(i, 1), *out.columns],
                                             ["n", "doc_id", *out.schema.names])
