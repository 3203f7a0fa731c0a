import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from tokenizers import Tokenizer

from helpers import docs_of
from textlake.llm import token_frames as K

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", " ", "a", "The cat's  hat\n\nwasn't 12 3", "é ñ ü — “quoted” 漢字 🙂", "a<|endoftext|>b", " lead", "trail ", "x\u00a0y \u2003z",
         "tab\there\r\nnext", "''s 're !'s", "a \x1c b\x85c", "word " * 500, "\n \n  \n", "\u0301e combining", "don't 'll  'll", "ＡＢ ½ ²"]


def direct(texts):
    t = Tokenizer.from_file(PATH)
    return [np.array(t.encode(x or "", add_special_tokens=False).ids, "<u4").tobytes() for x in texts]


def test_encoder_equals_the_library():
    rng = random.Random(1)
    alphabet = "ab é'.,<|>\n\t  sreZ9½漢\u2009\x1c"
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(800)]
    for limit in (50, 10 ** 6):
        encoder = K.Encoder(PATH, limit)
        for part in (texts[:7], texts):
            assert [x.tobytes() for x in encoder.encode_column(pa.array(part))] == direct(part)


def test_frames_and_seek_table():
    docs = [(None, b""), (5, np.array([1, 70000], "<u4").tobytes()), (-7, np.arange(9, dtype="<u4").tobytes())]
    assert [(d, x.tobytes()) for d, x in K.unframe(K.frame(docs))] == docs
    entries = [(0, 10, 20, 3, 11, 12345, 5, 1), (19, 1, 2, 3, 4, 5, 0, 0)]
    data = b"x" * 7 + K.seek_table(entries) + b"\n"
    assert K.read_seek_table(data) == entries
    with pytest.raises(ValueError):
        K.read_seek_table(data[:20] + b"!" + data[21:])


def expected(rows):
    out, at = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = direct([t])[0] + b"\x02\0\0\0"
        out.append((d, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    return out


def test_round_trip_in_order_of_ids(spark):
    rows = [(97 * i % 101 - 20, t) for i, t in enumerate(TEXTS)] + [(1000 + i, f"text {i} " * (i % 40)) for i in range(200)] + [(None, "x")]
    out = K.tokenise(docs_of(spark, rows).repartition(5), PATH, frame_ids=300)
    assert sorted(map(tuple, out.collect()), key=lambda r: r[1]) == expected(rows)


def test_files_are_zstandard_streams_and_reads_are_selective(spark, tmp_path):
    rows = [(i, f"some text number {i}") for i in range(500)]
    path = str(tmp_path / "t")
    K.write_tokens(docs_of(spark, rows), path, PATH, frame_ids=64)
    files = sorted((tmp_path / "t").glob("part-*"))
    raw = b""
    for f in files:
        data = f.read_bytes()
        entries = K.read_seek_table(data)
        got = b"".join(iter(lambda r=zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True): r.read(1 << 20), b""))
        assert got == b"".join(K.read_frame(data, e) for e in entries)
        raw += got
        assert sum(e[3] for e in entries) > 0
        with pytest.raises(Exception):
            K.read_frame(data[:8] + bytes([data[8] ^ 1]) + data[9:], entries[0])
    assert raw
    some = K.read_tokens(spark, path, only=[3, 77, 499, 10 ** 9]).collect()
    ids = dict(zip([3, 77, 499], direct([rows[k][1] for k in (3, 77, 499)])))
    assert {r["doc_id"]: bytes(r["ids"]) for r in some} == {k: v + b"\x02\0\0\0" for k, v in ids.items()}


def test_repeated_rows_and_empty_table(spark):
    out = K.tokenise(docs_of(spark, [(1, "same")] * 4 + [(0, "b")]), PATH).collect()
    assert sorted(r["start"] for r in out) == [0, 2, 4, 6, 8] and len({r["ids_crc32"] for r in out}) == 2
    assert K.tokenise(docs_of(spark, [(1, "a")]).limit(0), PATH).count() == 0


def test_files_are_ordered_by_their_numbers(spark):
    names = [f"file:/a/part-7/part-{n:05d}-6d6f-c000.txt" for n in (100000, 99999, 0, 123456, 20)]
    df = spark.createDataFrame([(x,) for x in names], "file string")
    got = [r.file for r in df.orderBy(K.file_number("file"), "file").collect()]
    assert got == [names[i] for i in (2, 4, 1, 0, 3)]


def test_new_pieces_go_to_the_tokenizer_in_small_runs():
    """A block of new words only is not encoded at once: the tokenizer's results are many times the size of the ids."""
    class Counted:
        def __init__(self, inner):
            self.inner, self.asked = inner, []

        def encode_batch_fast(self, pieces, **how):
            self.asked.append(len(pieces))
            return self.inner.encode_batch_fast(pieces, **how)
    encoder = K.Encoder(PATH)
    encoder.tokenizer = counted = Counted(encoder.tokenizer)
    texts = [" ".join(f"{97 * k:x}z" for k in range(a, a + 20000)) for a in (0, 20000, 10000)] + ["", "a b"]
    assert [x.tobytes() for x in encoder.encode_column(pa.array(texts))] == direct(texts)
    assert sum(counted.asked) >= 40000 and max(counted.asked) <= 4096


def test_the_writer_gets_its_texts_in_batches_of_few_bytes(spark, tmp_path, monkeypatch):
    """Rows of long texts reach the kernel a few MB at a time; the session's setting stays as it was."""
    def write(*how):
        def run(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([f"{b.num_rows} {b.nbytes}".encode()], pa.binary())], ["frame"])
        return run
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, records = spark.conf.get(name), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(K, "_write", write)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    try:
        K.write_tokens(docs_of(spark, [(1, "some words " * 2000)] * 1000), str(tmp_path / "t"), PATH)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
    got = [tuple(map(int, r.value.split())) for r in spark.read.text(str(tmp_path / "t")).collect()]
    assert sum(n for n, _ in got) == 1000 and max(size for _, size in got) < 5 << 20
    assert spark.conf.get(name) == before
