"""Byte-pair counts by distinct piece equal the tokenizer's counts of whole texts."""

import pytest
from pyspark.sql import functions as F

from textlake.operators.bpe import with_bpe_count
from textlake.registry.bpe import agg_bpe_tokens_by_lang, vocabulary, win_bpe_budget

from conftest import SMALL


@pytest.fixture(scope="module")
def count():
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: len(t.encode(text or "", add_special_tokens=False).ids)


def test_odd_texts(spark, count):
    texts = ["", None, " ", "  two   spaces ", "tab\tand\r\n\nlines \n", "it's we'll DON'T they've", "1234 56,78.9", "ñandú Àé ﬁ", "日本語 mix",
             "👩‍👩‍👧 🏳️‍🌈", " nbsp ​ thin　wide", "<|endoftext|>", "same text", "same text", "same text", "x" * 3000, "a b " * 2000, "\x00\x1c\x85"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("piece", F.lit(1)).withColumn("tokens", F.lit("old"))
    got = {r.id: r.tokens for r in with_bpe_count(df, vocabulary()).collect()}
    assert got == {i: count(t) for i, t in enumerate(texts)}
    assert with_bpe_count(df.limit(0), vocabulary()).count() == 0


def test_given_documents_and_queries(spark, count):
    from textlake.sources.tables import Tables
    t = Tables(spark, SMALL)
    docs = t.documents.select("doc_id", "lang", "text")
    rows = with_bpe_count(docs, vocabulary()).collect()
    assert len(rows) == docs.count() and all(r.tokens == count(r.text) for r in rows)
    by = {r.lang: r.total_tokens for r in agg_bpe_tokens_by_lang(t).collect()}
    assert by == {lang: sum(r.tokens for r in rows if r.lang == lang) for lang in {r.lang for r in rows}}
    kept = win_bpe_budget(t).collect()
    texts = {(r.conv_id, r.turn): r.text for r in t.conversations.collect()}
    assert kept and all(r.tokens == count(texts[r.conv_id, r.turn]) for r in kept)


def test_texts_are_not_shuffled(spark):
    from textlake.sources.tables import Tables
    d = Tables(spark, SMALL).documents.select("lang", "text").repartition(3)
    plan = with_bpe_count(d, vocabulary())._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
