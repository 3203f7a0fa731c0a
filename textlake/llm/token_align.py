"""Alignment of two tokenizers' ids, by windows between whitespace-token anchors.

Both tokenizers encode a whole text: A the text behind a space, B the text (it
adds that space itself). Each distinct piece of text (cut before single spaces
between visible characters, where neither tokenizer's ids depend on what stands
beside) is encoded once as long as it is remembered, and its tokens' bytes are
compared with the piece.

An anchor is a byte offset at which a token of A and a token of B both begin
and both begin with a space, so what stands before ends in both. Anchors cut a
document into windows of (ids of A, ids of B); a window's alignment depends on
its ids alone and is memoised by them (by a 64-bit hash of both id tuples). Inside a window, byte offsets where
tokens of both end cut groups; the two tokens that end there are a link.

Defined cases: texts that are NULL or empty, or of which one tokenizer does not
give back the bytes (such as a U+2581 in the text), have no tokens: counts of 0
and NULL groups. Strings of special tokens are plain text. Repeated rows are
each a row of the result. Other columns are ignored.

Memory of a worker: ``REMEMBERED`` pieces and as many windows at most, then the
memory starts anew with the block at hand.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, mix64, resident, saved, slices, text_buffers
from .token_frames import BLOCK_BYTES, _pos_key, cut_pieces

#: Pieces, and windows, that a worker remembers.
REMEMBERED = 500_000
#: Rows up to which the table of id pairs is broadcast (some 40 bytes each).
BROADCAST_PAIRS = 1_000_000
_SHIFT = 32
_ALIGNED = ("row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, "
            "pairs array<long>, times array<int>")


class ByteBPE:
    """A byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # byte-level names: printable bytes stand for themselves, the others follow from U+0100 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        names = self.tokenizer.get_vocab()
        self.tokens = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.tokens[i] = bytes(byte[c] for c in name) if all(c in byte for c in name) else name.encode()

    def encode(self, pieces: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]


class PieceBPE:
    """A sentencepiece model that puts a space before its input."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        self.model = m = SentencePieceProcessor(model_file=path)
        self.tokens = [bytes([int(m.id_to_piece(i)[3:-1], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode()
                       for i in range(m.get_piece_size())]

    def encode(self, pieces: list[str]) -> list[list[int]]:
        """Ids of pieces that begin with the space that the model adds."""
        return self.model.encode([p[1:] for p in pieces], num_threads=1)


def align_windows(ids: list[np.ndarray], owner: list[np.ndarray], sizes: list[np.ndarray],
                  names: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Alignment of windows that stand one after the other.

    ``ids`` of A and of B, the window of each (``owner``), the bytes of each
    id (``sizes``) and ids as text (``names``). Returns the packed id pairs of
    all links, the window of each, and the groups of each window as text.
    """
    ends = [np.cumsum(s[x]) for x, s in zip(ids, sizes)]
    shared, at_a, at_b = np.intersect1d(*ends, assume_unique=True, return_indices=True)
    links = ids[0][at_a].astype(np.int64) << _SHIFT | ids[1][at_b]
    # tokens of A, then those of B, by group; each is followed by the sign that separates it from the next
    group = np.concatenate([np.searchsorted(shared, e) for e in ends])
    order = np.argsort(group * 2 + np.repeat([0, 1], [len(x) for x in ids]), kind="stable")
    signs = np.full(len(order), ",")
    signs[at_a], signs[len(ids[0]) + at_b] = "|", ";"
    flat = [names[i] + sign for i, sign in zip(np.concatenate(ids)[order].tolist(), signs[order].tolist())]
    cuts = np.flatnonzero(np.diff(np.concatenate(owner)[order], prepend=-1, append=-1))
    texts = ["".join(flat[i:j])[:-1] for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
    return links, owner[0][at_a], texts


class _Flat:
    """Lists of numbers known by a number each, in one flat array."""

    def __init__(self, kind):
        self.values, self.at, self.size = np.zeros(0, kind), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, values: np.ndarray, size: np.ndarray) -> None:
        """Lists that stand one after the other, with their lengths."""
        self.at = np.append(self.at, len(self.values) + np.cumsum(size) - size)
        self.size = np.append(self.size, size)
        self.values = np.append(self.values, values)

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists ``which`` one after the other, and their lengths."""
        size = self.size[which]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.values[np.repeat(self.at[which] - ends + size, size) + np.arange(total)], size


def _missing(known: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which of ``wanted`` are not in the sorted ``known``."""
    if not len(known):
        return np.ones(len(wanted), bool)
    return known[np.minimum(np.searchsorted(known, wanted), len(known) - 1)] != wanted


class Aligner:
    """Tokens and alignments of blocks of text."""

    def __init__(self, path_a: str, path_b: str, limit: int = REMEMBERED):
        self.a, self.b, self.limit = ByteBPE(path_a), PieceBPE(path_b), limit
        self.sizes = [np.fromiter(map(len, t.tokens), np.int64, len(t.tokens)) for t in (self.a, self.b)]
        self.spaced = [np.fromiter((x[:1] == b" " for x in t.tokens), bool, len(t.tokens)) for t in (self.a, self.b)]
        self.names = list(map(str, range(max(map(len, self.sizes)))))
        self._forget_pieces()
        self._forget_windows()

    def _forget_pieces(self) -> None:
        self.known, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.whole = (_Flat(np.int32), _Flat(np.int32)), np.zeros(0, bool)

    def _forget_windows(self) -> None:
        self.windows, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.texts, self.links = [], _Flat(np.int64)

    def _learn(self, hashes: np.ndarray, raw: list[bytes]) -> None:
        pieces = [x.decode("utf-8") for x in raw]
        whole = np.ones(len(raw), bool)
        at = np.arange(len(self.whole), len(self.whole) + len(raw))
        for t, held in zip((self.a, self.b), self.ids):
            found = t.encode(pieces)
            tokens = t.tokens
            whole &= np.fromiter((b"".join([tokens[i] for i in ids]) == x for ids, x in zip(found, raw)), bool, len(raw))
            size = np.fromiter(map(len, found), np.int64, len(found))
            held.add(np.fromiter(chain.from_iterable(found), np.int32, int(size.sum())), size)
        self.whole = np.append(self.whole, whole)
        where = np.searchsorted(self.known, hashes)
        self.known, self.place = np.insert(self.known, where, hashes), np.insert(self.place, where, at)

    def _pieces(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of each piece of a block, and the pieces of each document."""
        starts, lens, h = cut_pieces(buf, off)
        unique, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        new = _missing(self.known, unique)
        if len(self.known) + new.sum() > self.limit:
            self._forget_pieces()
            new[:] = True
        if new.any():
            raw = buf.tobytes()
            self._learn(unique[new], [raw[starts[i]:starts[i] + lens[i]] for i in first[new]])
        return self.place[np.searchsorted(self.known, unique)][inverse], np.diff(np.searchsorted(starts, off))

    def tokens(self, buf: np.ndarray, off: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, ids of each document) of A and of B; documents that either does not give back have none."""
        n = len(off) - 1
        if not len(buf):
            return [(np.zeros(0, np.int32), np.zeros(n, np.int64))] * 2
        pieces, per = self._pieces(buf, off)
        doc = np.repeat(np.arange(n), per)
        broken = np.bincount(doc[~self.whole[pieces]], minlength=n) > 0
        pieces, doc = pieces[~broken[doc]], doc[~broken[doc]]
        out = []
        for held in self.ids:
            ids, size = held.take(pieces)
            out.append((ids, np.bincount(doc, size, n).astype(np.int64)))
        return out

    def _window_numbers(self, ids: list[np.ndarray], cuts: list[np.ndarray]) -> np.ndarray:
        """Number of the memoised alignment of each window; ``cuts``: where windows begin in the ids of A and of B."""
        h = np.zeros(len(cuts[0]), np.uint64)
        lens = [np.diff(np.append(c, len(x))) for x, c in zip(ids, cuts)]
        for side, (x, c, n) in enumerate(zip(ids, cuts, lens)):
            pos = np.arange(len(x), dtype=np.int64) - np.repeat(c, n)
            h = mix64(h + np.add.reduceat(mix64(x.astype(np.uint64) + np.uint64(side + 1 << 40)) * _pos_key(pos), c) + n.astype(np.uint64))
        unique, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        new = _missing(self.windows, unique)
        if len(self.windows) + new.sum() > self.limit:
            self._forget_windows()
            new[:] = True
        if new.any():
            fresh = first[new]
            where = [np.repeat(np.arange(len(fresh)), n[fresh]) for n in lens]
            at = [np.arange(len(w)) + np.repeat(c[fresh] - np.cumsum(n[fresh]) + n[fresh], n[fresh]) for w, c, n in zip(where, cuts, lens)]
            links, owner, texts = align_windows([x[i] for x, i in zip(ids, at)], where, self.sizes, self.names)
            place = np.searchsorted(self.windows, unique[new])
            self.windows = np.insert(self.windows, place, unique[new])
            self.numbers = np.insert(self.numbers, place, len(self.texts) + np.arange(len(fresh)))
            self.texts += texts
            self.links.add(links, np.bincount(owner, minlength=len(fresh)))
        return self.numbers[np.searchsorted(self.windows, unique)][inverse]

    def align(self, buf: np.ndarray, off: np.ndarray) -> Iterator[tuple]:
        """(n_a, n_b, groups, id pairs, links of each pair) of each document of a block."""
        (a, per_a), (b, per_b) = self.tokens(buf, off)
        nothing = (0, 0, None, np.zeros(0, np.int64), np.zeros(0, np.int64))
        if not len(a):
            yield from [nothing] * (len(off) - 1)
            return
        some = per_a > 0
        # byte offsets at which tokens begin; both sides hold the same bytes
        begin_a, begin_b = (np.cumsum(s[x]) - s[x] for x, s in zip((a, b), self.sizes))
        first_a, first_b = ((np.cumsum(p) - p)[some] for p in (per_a, per_b))
        free_a, free_b = self.spaced[0][a], self.spaced[1][b]
        free_a[first_a] = free_b[first_b] = True
        free_a, free_b = np.flatnonzero(free_a), np.flatnonzero(free_b)
        _, at_a, at_b = np.intersect1d(begin_a[free_a], begin_b[free_b], assume_unique=True, return_indices=True)
        cuts = [free_a[at_a], free_b[at_b]]
        number = self._window_numbers([a, b], cuts)
        bounds = np.append(np.searchsorted(cuts[0], first_a), len(number))
        pairs, sizes = self.links.take(number)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        numbers, texts, k = number.tolist(), self.texts, 0
        for n_a, n_b in zip(per_a.tolist(), per_b.tolist()):
            if not n_a:
                yield nothing
                continue
            x, y = bounds[k], bounds[k + 1]
            k += 1
            yield n_a, n_b, ";".join([texts[i] for i in numbers[x:y]]), *np.unique(pairs[ends[x]:ends[y]], return_counts=True)


def _align(path_a: str, path_b: str):
    def run(batches):
        aligner = resident(("aligner", path_a, path_b), lambda: Aligner(path_a, path_b))
        for batch in batches:
            texts = batch.column("text").cast(pa.large_string())
            space, none = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
            texts = pc.if_else(pc.equal(texts, none), none, pc.binary_join_element_wise(space, texts, none))
            buf, off = text_buffers(texts)
            for i, j in slices(off, BLOCK_BYTES):
                rows = list(aligner.align(buf[off[i]:off[j]], off[i:j + 1] - off[i]))
                n_a, n_b, groups, pairs, times = zip(*rows)
                cuts = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in pairs])]), pa.int32())
                links = pa.array([int(x.sum()) for x in times], pa.int64())
                lists = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (np.concatenate(pairs), np.concatenate(times).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").slice(i, j - i), batch.column("doc_id").slice(i, j - i), pa.array(n_a, pa.int64()),
                     pa.array(n_b, pa.int64()), links, links, pa.array(groups, pa.string()), *lists],
                    ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"])
    return run


def align(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (row, doc_id, n_a, n_b, n_groups, n_links, groups, pairs, times), one per document.

    ``row`` tells rows apart. ``groups`` has the ids of all groups in order,
    ``a,a|b;a|b,b``. ``pairs`` are the id pairs linked in the document (A's id
    times 2^32 plus B's) and ``times`` how often each is. A group ends with one
    link, so their numbers are the same.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(lean(_align(path_a, path_b), keeps=True), _ALIGNED)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """Rows (pair, links, best): links of each id pair in all documents, and whether no pair of its B id has more."""
    each = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    counts = saved(each.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("links")), "align-pairs")
    b = F.col("pair").bitwiseAND(F.lit((1 << _SHIFT) - 1)).alias("b")
    most = counts.groupBy(b).agg(F.max("links").alias("most"))
    return counts.select("*", b).join(most, "b").select("pair", "links", (F.col("links") == F.col("most")).alias("best"))


def score_links(aligned: DataFrame, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """``aligned`` (a stored table of :func:`align`) with n_best and count_sum in place of pairs and times.

    The table of id pairs is broadcast up to a counted size; beyond it both
    sides are exchanged, so a pair that every document holds can be split.
    """
    counts = saved(pair_counts(aligned), "align-counts")
    each = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", "x.pairs", "x.times")
    each = each.withColumnRenamed("pairs", "pair")
    small = counts.count() <= broadcast_pairs
    each = each.join(F.broadcast(counts) if small else counts.hint("merge"), "pair")
    sums = each.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
                                   F.sum(F.col("times") * F.col("links")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    return (aligned.drop("pairs", "times").join(sums, "row", "left")
            .withColumn("n_best", F.coalesce("n_best", zero)).withColumn("count_sum", F.coalesce("count_sum", zero)))


def align_corpus(docs: DataFrame, path_a: str, path_b: str, extra: dict | None = None, **columns) -> DataFrame:
    """:func:`align`, stored without its groups but with the columns ``extra`` made of them, then :func:`score_links`."""
    rows = align(docs, path_a, path_b, **columns)
    return score_links(saved(rows.withColumns(extra or {}).drop("groups"), "aligned")).drop("row")
