"""Token ids in files of independent zstandard frames with a trailing seek table.

A file is a valid zstandard stream. Data frames hold the ids of consecutive
documents and are compressed on their own; behind each stands a skippable
frame of one byte. The last frame is a skippable frame with the seek table: an
entry per data frame (place, sizes, documents, ids, first id, XXH64 of the raw
frame) and a checksum of the table itself. A reader looks up the frame of a
document, decompresses that frame alone and checks its sum.

Raw frame (little endian): u32 documents, u32 bytes per id, then per document
i64 doc_id, u8 id present, u32 ids; then all ids as u16 where all fit, else u32.

Spark writes the files: rows are frames, the row separator is a line feed, and
that line feed is the byte of the skippable frame before it.

Documents are dealt by ranges of (doc_id, text), so files in the order of their
numbers are in ascending order of doc_id; NULL ids come first, repeated rows stand together.
Defined cases: NULL and empty texts have only the end id; strings of special
tokens in a text become what the tokenizer file makes of them.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textlake.session import scratch_path

from .common import _BYTE_KEY, _pos_key, lean, mix64, resident, saved, slices, small_batches, text_buffers

END_ID = 2
FRAME_IDS = 1 << 18
FILE_BYTES = 32 << 20
#: Pieces of text whose ids a worker remembers.
CACHE_PIECES = 1_000_000
_SKIP = struct.pack("<II", 0x184D2A50, 1)
_TABLE_MAGIC = 0x184D2A5E
_ENTRY = struct.Struct("<QIIIIQqB")
_FOOT = struct.Struct("<IQ3s")
_FOOT_MAGIC = b"TKF"
#: Text bytes whose pieces are counted together.
BLOCK_BYTES = 3 << 19
#: Text bytes that are encoded together, and new pieces that the tokenizer gets at once: what a task holds beside its memory of pieces.
ENCODE_BYTES = 1 << 19
LEARN_PIECES = 1 << 12
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True


def cut_pieces(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and hashes of the pieces of a block of text bytes whose documents begin at ``off``."""
    # single spaces after a visible ASCII character or a letter of U+00C0 to U+00FF, and before one
    prev, after = np.zeros(len(buf), bool), np.zeros(len(buf), bool)
    prev[1:] = _VISIBLE[buf[:-1]]
    prev[2:] |= (buf[:-2] == 0xC3) & (buf[1:-1] >= 0x80)
    after[:-1] = _VISIBLE[buf[1:]] | (buf[1:] == 0xC3)
    begins = (buf == 0x20) & prev & after
    firsts = off[:-1][off[:-1] < off[1:]]
    begins[firsts - 1] = False  # the last byte of the document before
    begins[firsts] = True
    starts = np.flatnonzero(begins)
    lens = np.diff(np.append(starts, len(buf)))
    pos = np.arange(len(buf), dtype=np.int64) - np.repeat(starts, lens)
    return starts, lens, mix64(np.add.reduceat(_BYTE_KEY[buf] * _pos_key(pos), starts) + lens.astype(np.uint64))


class Encoder:
    """Ids of texts, each distinct piece encoded once as long as it is remembered.

    A text is cut into pieces whose ids do not depend on each other: before
    each single space between two characters that are certainly no white
    space. Pieces are known by 64-bit hashes in a sorted array with their ids
    in one flat array, so ``limit`` pieces take some 40 bytes each; beyond it
    the memory starts anew with the block at hand.
    """

    def __init__(self, path: str, limit: int = CACHE_PIECES):
        from tokenizers import Tokenizer
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self._clear()

    def _clear(self) -> None:
        self.known, self.at, self.size = (np.zeros(0, t) for t in (np.uint64, np.int64, np.int64))
        self.ids = np.zeros(0, np.uint32)

    def _learn(self, hashes: np.ndarray, raw: bytes, cuts: list[tuple[int, int]]) -> None:
        """Add new pieces (ascending hashes), those of the places ``cuts`` of ``raw``."""
        sizes, ids = [], [self.ids]
        for k in range(0, len(cuts), LEARN_PIECES):  # the tokenizer's results are many times larger than the ids in them
            pieces = [raw[x:y].decode("utf-8") for x, y in cuts[k:k + LEARN_PIECES]]
            found = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
            ids.append(np.fromiter(chain.from_iterable(found), np.uint32, int(sizes[-1].sum())))
        size = np.concatenate(sizes)
        at = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate(ids)
        place = np.searchsorted(self.known, hashes)
        for name, new in (("known", hashes), ("at", at), ("size", size)):  # one array after the other is copied
            setattr(self, name, np.insert(getattr(self, name), place, new))

    def encode_block(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (u32) of all documents of a block of text bytes, and where each begins."""
        if not len(buf):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        starts, lens, h = cut_pieces(buf, off)
        unique, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        new = self._unknown(unique)
        if len(self.known) + new.sum() > self.limit:
            self._clear()
            new[:] = True
        if new.any():
            begins = starts[first[new]]
            self._learn(unique[new], buf.tobytes(), list(zip(begins.tolist(), (begins + lens[first[new]]).tolist())))
        place = np.searchsorted(self.known, unique)[inverse]
        size = self.size[place]
        ends = np.cumsum(size)
        ids = self.ids[np.repeat(self.at[place] - ends + size, size) + np.arange(ends[-1])]
        per = np.concatenate([[0], ends])[np.searchsorted(starts, off)]
        return ids, per

    def _unknown(self, hashes: np.ndarray) -> np.ndarray:
        place = np.searchsorted(self.known, hashes)
        same = np.zeros(len(hashes), bool)
        inside = place < len(self.known)
        same[inside] = self.known[place[inside]] == hashes[inside]
        return ~same

    def encode_column(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text of an Arrow column."""
        buf, off = text_buffers(texts)
        for i, j in slices(off, ENCODE_BYTES):
            ids, per = self.encode_block(buf[off[i]:off[j]], off[i:j + 1] - off[i])
            for a, b in zip(per[:-1], per[1:]):
                yield ids[a:b]


def frame(docs: list[tuple[int | None, bytes]]) -> bytes:
    """Raw frame of documents (doc_id, ids as u32 bytes)."""
    ids = np.frombuffer(b"".join(x for _, x in docs), "<u4")
    width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
    head = b"".join(struct.pack("<qBI", d or 0, d is not None, len(x) // 4) for d, x in docs)
    return struct.pack("<II", len(docs), width) + head + ids.astype(f"<u{width}").tobytes()


def unframe(raw: bytes) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of a raw frame."""
    n, width = struct.unpack_from("<II", raw)
    at = 8 + 13 * n
    for k in range(n):
        d, known, size = struct.unpack_from("<qBI", raw, 8 + 13 * k)
        yield (d if known else None), np.frombuffer(raw, f"<u{width}", size, at).astype("<u4")
        at += size * width


def seek_table(entries: list[tuple]) -> bytes:
    """The last frame without its last byte, a line feed that the writer adds."""
    body = b"".join(_ENTRY.pack(*e) for e in entries)
    foot = _FOOT.pack(len(entries), xxhash.xxh64_intdigest(body), _FOOT_MAGIC)
    return struct.pack("<II", _TABLE_MAGIC, len(body) + len(foot) + 1) + body + foot


def read_seek_table(data: bytes) -> list[tuple]:
    """Entries (place, packed size, raw size, documents, ids, XXH64, first id, id present) of a file's end."""
    n, check, magic = _FOOT.unpack_from(data, len(data) - _FOOT.size - 1)
    body = data[len(data) - _FOOT.size - 1 - n * _ENTRY.size:len(data) - _FOOT.size - 1]
    if magic != _FOOT_MAGIC or xxhash.xxh64_intdigest(body) != check:
        raise ValueError("damaged seek table")
    return list(_ENTRY.iter_unpack(body))


def read_frame(data: bytes, entry: tuple) -> bytes:
    """One raw frame, checked."""
    raw = zstandard.ZstdDecompressor().decompress(data[entry[0]:entry[0] + entry[1]], max_output_size=entry[2])
    if len(raw) != entry[2] or xxhash.xxh64_intdigest(raw) != entry[5]:
        raise ValueError("damaged frame")
    return raw


def _write(path: str, end_id: int | None, frame_ids: int):
    tail = b"" if end_id is None else struct.pack("<I", end_id)

    def run(batches):
        encoder, packer = resident(("encoder", path), lambda: Encoder(path)), zstandard.ZstdCompressor(level=3)
        held, size, place, entries = [], 0, 0, []

        def flush():
            nonlocal held, size, place
            raw = frame(held)
            packed = packer.compress(raw)
            entries.append((place, len(packed), len(raw), len(held), size, xxhash.xxh64_intdigest(raw), held[0][0] or 0, held[0][0] is not None))
            place += len(packed) + len(_SKIP) + 1
            held, size = [], 0
            return pa.RecordBatch.from_arrays([pa.array([packed + _SKIP], pa.binary())], ["frame"])

        for b in batches:
            for d, ids in zip(b.column("doc_id").to_pylist(), encoder.encode_column(b.column("text"))):
                held.append((d, ids.tobytes() + tail))
                size += len(held[-1][1]) // 4
                if size >= frame_ids:
                    yield flush()
        if held:
            yield flush()
        if entries:
            yield pa.RecordBatch.from_arrays([pa.array([seek_table(entries)], pa.binary())], ["frame"])
    return run


def write_tokens(docs: DataFrame, out: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text",
                 end_id: int | None = END_ID, frame_ids: int = FRAME_IDS) -> None:
    """Encode all texts and write them in ascending order of doc_id to a new folder ``out``."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 8), F.lit(0))).first()[0]
    files = max(int(total) // FILE_BYTES + 1, spark.sparkContext.defaultParallelism)
    tie = F.xxhash64("text")
    rows = rows.repartitionByRange(files, F.col("doc_id"), tie).sortWithinPartitions("doc_id", tie)
    frames = rows.mapInArrow(lean(_write(tokenizer, end_id, frame_ids), keeps=True), "frame binary")
    with small_batches(spark):
        frames.select(F.col("frame").cast("string")).write.option("lineSep", "\n").text(out)


def read_tokens(spark: SparkSession, path: str, only: list[int] | None = None) -> DataFrame:
    """Rows (doc_id, file, place, n_tokens, ids_crc32, ids) of a folder; ``only``: just these documents' frames are decompressed."""
    wanted = None if only is None else np.unique(np.array(only, np.int64))

    def hit(entries: list[tuple], k: int) -> bool:
        low = entries[k][6] if entries[k][7] else -(1 << 63)
        later = entries[k + 1] if k + 1 < len(entries) else None
        high = (later[6] if later[7] else -(1 << 63)) if later else (1 << 63) - 1
        at = int(np.searchsorted(wanted, low))
        return at < len(wanted) and wanted[at] <= high

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                name, data = b.column("path")[i].as_py(), b.column("content")[i].as_py()
                entries = read_seek_table(data)
                before = 0
                for k, e in enumerate(entries):
                    if wanted is None or hit(entries, k):
                        docs = [(before + j, d, x) for j, (d, x) in enumerate(unframe(read_frame(data, e)))]
                        if wanted is not None:
                            docs = [x for x in docs if x[1] is not None and x[1] in only]
                        raw = [x.tobytes() for *_, x in docs]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([d for _, d, _ in docs], pa.int64()), pa.array([name] * len(docs), pa.string()),
                             pa.array([p for p, *_ in docs], pa.int64()), pa.array([len(x) // 4 for x in raw], pa.int64()),
                             pa.array([zlib.crc32(x) for x in raw], pa.int64()), pa.array(raw, pa.binary())],
                            ["doc_id", "file", "place", "n_tokens", "ids_crc32", "ids"])
                    before += e[3]

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(lean(run), "doc_id long, file string, place long, n_tokens long, ids_crc32 long, ids binary")


def file_number(name) -> Column:
    """Number in the name of a part file; names of more digits sort wrongly as text."""
    return F.regexp_extract(name, r"part-(\d+)[^/]*$", 1).cast("long")


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32): every document read back, with the ids before it in the whole folder.

    The running sum goes over one row per file, and inside each file.
    """
    rows = saved(read_tokens(spark, path).drop("ids"), "token-index")
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("size"))
    order = Window.orderBy(file_number("file"), "file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select(F.col("file").alias("f"), F.coalesce(F.sum("size").over(order), F.lit(0)).alias("base"))
    inside = Window.partitionBy("file").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return rows.join(files, rows.file == files.f).select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def tokenise(docs: DataFrame, tokenizer: str, **how) -> DataFrame:
    """Write ``docs`` to a new folder of the shared scratch space and return its token_index."""
    spark = docs.sparkSession
    out = scratch_path(spark, "token-frames")
    write_tokens(docs, out, tokenizer, **how)
    return token_index(spark, out)
