"""Many keywords by automaton equal one ``in`` per keyword."""

import random

import pytest
from pyspark.sql import functions as F

from textlake.functions.text import fold_py
from textlake.operators.filters import select_titles
from textlake.operators.keywords import select_by_keywords, with_keywords


def brute(text, words):
    return None if text is None else sorted({w for w in map(fold_py, words) if w in fold_py(text)})


@pytest.mark.parametrize("block_bytes", [4 << 20, 30_000])
def test_ten_thousand_keywords_equal_brute_force(spark, block_bytes):
    rng = random.Random(3)
    words = list({"".join(rng.choices("abcé", k=rng.randint(2, 9))) for _ in range(14_000)})[:10_000]
    texts = ["".join(rng.choices("ABcé  ", k=rng.randint(0, 120))) for _ in range(60)] + ["".join(rng.choices("abcÉ ", k=30_000))]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = with_keywords(df, spark.createDataFrame([(w,) for w in words], "keyword string"), block_bytes=block_bytes)
    assert {r.id: r.keywords for r in got.collect()} == {i: brute(t, words) for i, t in enumerate(texts)}


def test_odd_rows_and_clashing_columns(spark):
    rows = [(1, "Ley del Agua", "x"), (1, "Ley del Agua", "x"), (2, None, "x"), (3, "", "x"), (None, "ÁGUILA", "x"), (4, "日本", "x")]
    df = spark.createDataFrame(rows, "id long, title string, keywords string").withColumn("keyword", F.lit("k"))
    keys = spark.createDataFrame([("águ",), ("AGU",), ("ley del",), (None,)], "keyword string")
    got = with_keywords(df, keys, "title")
    assert sorted(got.columns) == sorted(df.columns)
    assert sorted(((r.id or 0), r.keywords) for r in got.collect() if r.title is not None) == [
        (0, ["agu"]), (1, ["agu", "ley del"]), (1, ["agu", "ley del"]), (3, []), (4, [])]
    assert [r.keywords for r in got.where("title IS NULL").collect()] == [None]
    assert with_keywords(df.limit(0), keys, "title").count() == 0
    assert {tuple(r.keywords) for r in with_keywords(df.dropna(), keys.limit(0), "title").collect()} == {()}
    everywhere = spark.createDataFrame([("",), ("zz",)], "keyword string")
    assert {tuple(r.keywords) for r in with_keywords(df.dropna(subset="title"), everywhere, "title").collect()} == {("",)}


@pytest.mark.parametrize("words", [["agua", "ñu"], [], ["日"]])
def test_filter_equals_one_contains_per_keyword(spark, words):
    df = spark.createDataFrame([(1, "Agua"), (2, "Nuñez"), (3, None), (4, "nada")], "id long, title string")
    keys = spark.createDataFrame([(w,) for w in words], "keyword string")
    want = select_titles(df, words, full_extraction=False)
    got = select_by_keywords(df, keys)
    assert got.columns == df.columns and sorted(r.id for r in got.collect()) == sorted(r.id for r in want.collect())


def test_texts_are_not_exchanged_by_key(spark, capsys):
    df = spark.range(0, 1000, 1, 8).select("id", F.col("id").cast("string").alias("text"))
    with_keywords(df, spark.createDataFrame([("7",)], "keyword string")).explain()
    plan = capsys.readouterr().out
    assert "ArrowEval" in plan and "hashpartitioning" not in plan and "Join" not in plan
