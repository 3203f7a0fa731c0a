"""K1 / K2 / K3 chunkers on the chunk_edges fixture and on the corpus."""

from pyspark.sql import functions as F

from textlake.operators.chunking import (explode_chunks, recursive_chunks, split_recursive,
                                         with_word_windows)
from textlake.params import SUMMARY_SEPARATORS

from conftest import SMALL


def test_example_from_spec():
    assert split_recursive("aaaa bbbb. cccc dddd\n\neeee", 12, 4) == ["aaaa bbbb", ". cccc dddd", "eeee"]


def test_edges():
    assert split_recursive("", 12, 4) == []
    assert split_recursive("\n\n\n\n", 12, 4) == []
    long_word = "x" * 3000
    out = split_recursive(long_word, 1024, 256)
    assert all(len(c) <= 1024 for c in out)
    assert "".join(out[:1]) == "x" * 1024
    paras = "\n\n".join(["p" * 10] * 5)
    assert split_recursive(paras, 25, 0) == ["pppppppppp\n\npppppppppp", "pppppppppp\n\npppppppppp",
                                             "pppppppppp"]


def test_paragraph_separators_may_exceed_size():
    text = "y" * 50 + "\n" + "z" * 10
    out = split_recursive(text, 20, 5, SUMMARY_SEPARATORS)
    assert out[0] == "y" * 50 and max(len(c) for c in out) > 20


def test_corpus_chunks_bounded_and_covering(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    c = explode_chunks(docs, recursive_chunks(F.col("text")), "doc_id", ["doc_id", "text"])
    assert c.where(F.char_length("chunk") > 1024).count() == 0
    # every chunk is a piece of its document
    assert c.where(~F.col("text").contains(F.col("chunk"))).count() == 0
    # ordinals are dense from 1
    g = c.groupBy("doc_id").agg(F.max("chunk_no").alias("m"), F.count("*").alias("n"))
    assert g.where(F.col("m") != F.col("n")).count() == 0
    # the UDF equals the Python function
    rows = docs.limit(20).collect()
    got = {r.doc_id: r.chunks for r in docs.limit(20).select("doc_id", recursive_chunks(F.col("text")).alias("chunks")).collect()}
    for r in rows:
        assert got[r.doc_id] == split_recursive(r.text)


def test_null_text_has_no_chunks(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "id long, text string")
    c = explode_chunks(df, recursive_chunks(F.col("text")), "id", ["id"])
    assert c.count() == 0


def test_word_windows(spark):
    df = spark.createDataFrame([(1, "a b  c\td e"), (2, ""), (3, None)], "id long, text string")
    out = {r.id: r.windows for r in with_word_windows(df, "text", 2).collect()}
    assert out[1] == ["a b", "c d", "e"]
    assert out[2] == []


def test_chunk_rows_leave_in_small_batches():
    """A worker holds one text's chunks, not those of the whole batch."""
    import pyarrow as pa

    from textlake.operators.chunking import _chunk_rows
    texts = ["p" * 900 + "\n" + "q" * 900, None, "", "r" * 900] * 50
    b = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array(texts)], ["id", "_text"])
    out = list(_chunk_rows(["id"], 1024, 256, SUMMARY_SEPARATORS, 2000)(iter([b])))
    assert len(out) >= 50 and max(sum(map(len, o.column("chunk").to_pylist())) for o in out) < 4000
    got = [(r["id"], r["chunk_no"], r["chunk"]) for o in out for r in o.to_pylist()]
    assert got == [(i, n, c) for i, t in enumerate(texts) if t is not None
                   for n, c in enumerate(split_recursive(t, 1024, 256, SUMMARY_SEPARATORS), 1)]


def test_explode_recursive_equals_the_column(spark):
    from textlake.operators.chunking import explode_recursive
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(50)
    a = explode_chunks(docs, recursive_chunks(F.col("text")), "doc_id", ["doc_id", "lang"])
    b = explode_recursive(docs, "text", "doc_id", ["doc_id", "lang"])
    cols = ["doc_id", "lang", "chunk_no", "text_id", "chunk"]
    assert sorted(map(tuple, a.select(cols).collect())) == sorted(map(tuple, b.select(cols).collect()))
    assert b.schema["chunk_no"].dataType == a.schema["chunk_no"].dataType
