"""Stupid-backoff language-model scores from count tables of the whole corpus.

N-grams of words (A-Z lower-cased) are known by 56-bit hashes. Documents are
dealt into chunks; a chunk's distinct n-grams of each length with their counts
are cut into buckets by hash, so each bucket's task holds the count table of
its n-grams: the sum over chunks. Joined in the bucket to the chunks' n-grams,
the totals go back to the chunks, where the documents' exploded n-grams look
them up and the scores are summed per document. A word pair that occurs in
every document is one row a chunk, never a group of its occurrences.

Every n-gram is counted, however rare. A document is scored by what the other
documents hold: its own counts c_d are taken off those of all, c' = c - c_d, so
text that occurs nowhere else backs off and repeated text does not.
S(w | context) = c'(context w) / c'(context) if c'(context w) is at least
``min_count``, else ALPHA times the score with the context's first word
dropped; for single words c(w) / N, which is never 0. The document's score is
the sum of ln S over its words.

Defined cases: NULL and wordless texts have no words and score 0, mean NULL;
contexts never cross documents; repeated rows are other documents of equal
text, all counted and returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean_group, mix64, slices, text_buffers, word_hashes

ORDER = 3
ALPHA = 0.4
MIN_COUNT = 1
CHUNK_BYTES = 12 << 20
#: Text bytes of the corpus per bucket of each length's count table.
BUCKET_BYTES = 12 << 20
#: At 10^12 distinct n-grams some 10^-5 of them share their hash with another.
HASH_BITS = 56
_KEY = np.uint64(0x9E3779B97F4A7C15)


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    buf, off = text_buffers(texts)
    parts = [word_hashes(buf[off[i]:off[j]], off[i:j + 1] - off[i]) for i, j in slices(off)]
    return (np.concatenate([np.zeros(0, np.uint64), *[h for h, _ in parts]]),
            np.concatenate([np.zeros(0, np.int64), *[c for _, c in parts]]))


def ngrams(h: np.ndarray, counts: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length 1..order: hashes of the n-grams that end at each word, and whether the document has that many words before."""
    place = np.arange(len(h)) - np.repeat(np.cumsum(counts) - counts, counts)
    g = mix64(h + _KEY)
    for n in range(1, order + 1):
        if n > 1:
            before = np.concatenate([np.zeros(n - 1, np.uint64), h[:-(n - 1)]]) if len(h) >= n else np.zeros(len(h), np.uint64)
            g = mix64(g * np.uint64(3) + before + mix64(np.full(1, n, np.uint64)))
        yield g >> np.uint64(64 - HASH_BITS), place >= n - 1


def _cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins in sorted hashes; buckets are equal ranges of hashes."""
    edges = (np.arange(1, buckets, dtype=object) * (1 << HASH_BITS) // buckets).astype(np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def _pack(keys: np.ndarray) -> bytes:
    """Sorted hashes as differences, byte planes apart so that they compress."""
    return np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8)[:, :HASH_BITS // 8].T.tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(HASH_BITS // 8, -1)
    wide = np.zeros((planes.shape[1], 8), np.uint8)
    wide[:, :HASH_BITS // 8] = planes.T
    return np.cumsum(wide.view(np.uint64).ravel(), dtype=np.uint64)


def _pack_counts(n: np.ndarray) -> bytes:
    """Counts as byte planes, as many as the largest needs."""
    width = max(1, (int(n.max()).bit_length() + 7) // 8) if len(n) else 1
    return bytes([width]) + n.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unpack_counts(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8, offset=1).reshape(blob[0], -1)
    return sum(p.astype(np.int64) << (8 * k) for k, p in enumerate(planes))


def _count_chunk(order: int, buckets: int):
    """The chunk's distinct n-grams and counts, a row a bucket; each length has buckets of its own."""
    def run(table: pa.Table) -> pa.Table:
        h, counts = _words(table.column("text"))
        bucket, grams, found = [], [], []
        for k, (g, ok) in enumerate(ngrams(h, counts, order)):
            keys, n = np.unique(g[ok], return_counts=True)
            at = _cuts(keys, buckets)
            for b in np.flatnonzero(np.diff(at)):
                bucket.append(k * buckets + int(b))
                grams.append(_pack(keys[at[b]:at[b + 1]]))
                found.append(_pack_counts(n[at[b]:at[b + 1]]))
        chunk = np.full(len(bucket), table.column("chunk")[0].as_py())
        return pa.table({"chunk": pa.array(chunk, pa.int64()), "bucket": pa.array(bucket, pa.int64()),
                         "grams": pa.array(grams, pa.binary()), "counts": pa.array(found, pa.binary())})
    return run


def _total_bucket(table: pa.Table) -> pa.Table:
    """Sum the counts of a bucket over chunks, and give each chunk the totals of its n-grams."""
    keys = [_unpack(x) for x in table.column("grams").to_pylist()]
    counts = [_unpack_counts(x) for x in table.column("counts").to_pylist()]
    every = np.concatenate(keys)
    order = np.argsort(every)
    new = np.ones(len(every), bool)
    new[1:] = every[order][1:] != every[order][:-1]
    totals = np.add.reduceat(np.concatenate(counts)[order], np.flatnonzero(new))
    back = np.empty(len(every), np.int64)
    back[order] = totals[np.cumsum(new) - 1]
    parts = np.split(back, np.cumsum([len(k) for k in keys])[:-1])
    return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"),
                     "totals": pa.array([_pack_counts(x) for x in parts], pa.binary())})


def _looked_up(grams: np.ndarray, doc: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each n-gram the count in all documents and that in its own; ``totals`` are by ascending hash, ``doc`` ascends."""
    if not len(grams):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    by = np.argsort(grams, kind="stable")
    first = np.ones(len(grams), bool)
    first[1:] = grams[by][1:] != grams[by][:-1]
    run = first.copy()
    run[1:] |= doc[by][1:] != doc[by][:-1]
    starts = np.flatnonzero(run)
    lens = np.diff(starts, append=len(grams))
    every, own = np.empty((2, len(grams)), np.int64)
    every[by] = totals[np.cumsum(first) - 1]
    own[by] = np.repeat(lens, lens)
    return every, own


def _score_chunk(order: int, buckets: int, alpha: float, min_count: int, n_words: int):
    def run(texts: pa.Table, totals: pa.Table) -> pa.Table:
        h, counts = _words(texts.column("text"))
        doc = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        by = sorted(zip(totals.column("bucket").to_pylist(), totals.column("totals").to_pylist()))
        best, context = np.zeros(len(h)), np.zeros(len(h), np.int64)
        # ln S of the longest n-gram that other documents hold; each one dropped costs ln alpha
        for k, (g, ok) in enumerate(ngrams(h, counts, order)):
            table = [_unpack_counts(x) for b, x in by if b // buckets == k]
            every, own = _looked_up(g[ok], doc[ok], np.concatenate([np.zeros(0, np.int64), *table]))
            seen = np.zeros(len(h), np.int64)
            seen[ok] = every - own
            if k:
                context = np.concatenate([[0], context[:-1]])
                known = (seen >= min_count) & (context > 0)
                best = np.where(known, np.log(np.where(known, seen, 1) / np.where(known, context, 1)), best + np.where(ok, np.log(alpha), 0.0))
                seen[~known] = 0
            else:
                best = np.log(every / max(n_words, 1))
            context = seen
        return pa.table({"doc_id": texts.column("doc_id"), "n_words": pa.array(counts, pa.int64()),
                         "score": pa.array(np.bincount(doc, weights=best, minlength=len(counts))[:len(counts)])})
    return run


def lm_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", order: int = ORDER, alpha: float = ALPHA,
              min_count: int = MIN_COUNT, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Rows (doc_id, n_words, score, mean): every document scored by the counts of all others."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    spaces = F.regexp_count(F.coalesce("text", F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+"))
    size, words = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.coalesce(F.sum(spaces), F.lit(0))).first()
    chunks, buckets = int(size) // chunk_bytes + 1, int(size) // bucket_bytes + 1
    dealt = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)))
    counted = dealt.groupBy("chunk").applyInArrow(lean_group(_count_chunk(order, buckets)), "chunk long, bucket long, grams binary, counts binary")
    totals = counted.groupBy("bucket").applyInArrow(lean_group(_total_bucket), "chunk long, bucket long, totals binary")
    scored = dealt.groupBy("chunk").cogroup(totals.groupBy("chunk")).applyInArrow(
        lean_group(_score_chunk(order, buckets, alpha, min_count, int(words)), 2), "doc_id long, n_words long, score double")
    return scored.withColumn("mean", F.when(F.col("n_words") > 0, F.col("score") / F.col("n_words")))
