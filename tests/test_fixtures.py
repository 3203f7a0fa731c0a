"""Fixture tests (FIXTURES.md part 3): budget, dates, markup, QA, row numbers."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from textlake.functions.dates import spanish_long_date
from textlake.functions.markup import extract_fields, parse_one
from textlake.functions.text import clean_text, fold, fold_py, keyword_match
from textlake.operators.windows import budget_cut, dense_row_number
from textlake.plans.qa import answer_spans


def test_budget_edges(spark):
    rows = [(1, 1, 3), (1, 2, 2), (1, 3, 1),      # 3, 5 (= limit, excluded), 6
            (2, 1, 9), (2, 2, 1),                  # first item over the limit: nothing kept
            (3, 1, 0), (3, 2, 0), (3, 3, 4)]       # zero-token items
    df = spark.createDataFrame(rows, "query_id long, rank int, tokens long")
    kept = budget_cut(df, "query_id", ["rank"], "tokens", 5)
    got = sorted((r.query_id, r.rank) for r in kept.collect())
    assert got == [(1, 1), (3, 1), (3, 2), (3, 3)]


def test_spanish_dates(spark):
    df = spark.createDataFrame([("Sentencia de 05 de marzo de 2021",), ("el 15 de brumario de 2020",),
                                ("sin fecha",), (None,)], "t string")
    got = [r[0] for r in df.select(spanish_long_date(F.col("t"))).collect()]
    assert got == ["05/03/2021", None, None, None]


BROKEN = [
    "<documento><titulo>Ley &amp; orden</titulo><texto><p>uno<p>dos</texto></documento>",
    "<documento><texto>sin cierre",
    "<x><titulo>solo titulo</titulo></x>",
    "<documento><!-- c --><script>var a='<texto>no</texto>';</script><texto>bien</texto></documento>",
    "",
    None,
]


def test_markup_is_tolerant(spark):
    out = [parse_one(x, ("titulo", "rango"), "documento", "texto") for x in BROKEN]
    assert out[0]["titulo"] == "Ley & orden" and out[0]["body"] == "unodos"
    assert out[1]["body"] == "sin cierre" and out[1]["titulo"] is None
    assert out[2]["titulo"] == "solo titulo" and out[2]["body"] is None
    assert out[3]["body"] == "bien"
    assert out[4]["body"] is None and out[5]["titulo"] is None
    df = spark.createDataFrame([(x,) for x in BROKEN], "x string")
    got = df.select(extract_fields(F.col("x"), ("titulo", "rango")).alias("f")).collect()
    assert [r.f.body for r in got] == [o["body"] for o in out]


def test_fold_equals_python(spark):
    words = ["Élle", "ÜBER", "Niño", "Straße", "Ǆemal", "ﬁn", "café", None]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = [r[0] for r in df.select(fold(F.col("w"))).collect()]
    assert got == [None if w is None else fold_py(w) for w in words]
    m = [r[0] for r in df.select(keyword_match(F.col("w"), ["nino", "CAFÉ"])).collect()]
    assert m == [False, False, True, False, False, False, True, False]
    assert [r[0] for r in df.select(keyword_match(F.col("w"), [])).collect()] == [True] * len(words)


def test_clean_text_equals_python(spark):
    samples = ["a\n b|c  d  e  ", "\x1c x \x85y", "", None]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    got = [r[0] for r in df.select(clean_text(F.col("s"))).collect()]
    want = [None if s is None else " ".join(s.replace("\n", " ").replace("|", " ").split()) for s in samples]
    assert got == want


QA = [
    # key, question, context, answer_start, answer_text
    (1, "q uno", "La ley orgánica de protección civil", 7, "orgánica de"),   # middle
    (2, "q", "Artículo primero del código", 0, "Artículo"),                 # start
    (3, "q", "texto sin respuesta", 100, "ausente"),                        # absent (offset outside)
    (6, "q", "texto sin respuesta", 0, "ausente"),                          # offsets only, like the reference
    (4, "q", "uno dos tres", 2, "o dos"),                                   # offset inside a token
    (5, "q", "Él está aquí", 3, "está"),                                    # accented
]


def test_qa_spans(spark):
    df = spark.createDataFrame(QA, "k long, question string, context string, answer_start int, answer_text string")
    got = {r.k: (r.start_token, r.end_token) for r in answer_spans(df, ["k"]).collect()}
    assert got[1] == (2, 3)
    assert got[2] == (0, 0)
    assert got[3] == (0, 0)
    assert got[6] == (0, 1)   # spans are matched by offsets, not by text
    assert got[4] == (0, 1)
    assert got[5] == (1, 1)


def test_qa_model_inputs(spark):
    from textlake.plans.qa import model_inputs
    rows = [(1, "q uno", " ".join(f"c{i}" for i in range(20))), (2, "q", "a b"), (3, " ".join("q" * 12), "x")]
    out = {r.k: r for r in model_inputs(spark.createDataFrame(rows, "k long, question string, context string"), 10).collect()}
    assert out[1].input_tokens == ["[CLS]", "q", "uno", "[SEP]", "c0", "c1", "c2", "c3", "c4", "[SEP]"]
    assert out[1].attention_mask == [1] * 10
    assert out[2].input_tokens == ["[CLS]", "q", "[SEP]", "a", "b", "[SEP]"] + ["[PAD]"] * 4
    assert out[2].attention_mask == [1] * 6 + [0] * 4
    assert len(out[3].input_tokens) == len(out[3].attention_mask) == 10


def test_accented_terms_stay_whole(spark):
    from textlake.operators.rerank import terms
    df = spark.createDataFrame([("Protección de niños, 2ª vez",)], "t string")
    assert df.select(terms(F.col("t"))).first()[0] == ["proteccion", "de", "ninos", "2", "vez"]


def test_one_of_two_newlines_goes(spark):
    from textlake.functions.text import strip_newline_suffix
    df = spark.createDataFrame([("a\n\n",), ("a\n",), ("a",), ("\n",), (None,)], "t string")
    assert [r[0] for r in df.select(strip_newline_suffix(F.col("t"))).collect()] == ["a\n", "a", "a", "", None]


def test_qa_truncation(spark):
    ctx = " ".join(f"w{i}" for i in range(600))
    start = ctx.index("w550")
    df = spark.createDataFrame([(1, "q", ctx, start, "w550")],
                               "k long, question string, context string, answer_start int, answer_text string")
    r = answer_spans(df, ["k"]).collect()[0]
    assert (r.start_token, r.end_token) == (0, 0)  # truncated away
    assert r.n_ctx_tokens == 512 - 1 - 3 and r.n_padding == 0


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_dense_row_number_on_skewed_groups(spark, parts):
    # one group holds most rows
    rows = [("hot", i) for i in range(3000)] + [("a", i) for i in range(50)] + [("b", i) for i in range(7)]
    df = spark.createDataFrame(rows, "g string, n long")
    got = dense_row_number(df, ["g"], ["n"], "rn", num_partitions=parts)
    w = Window.partitionBy("g").orderBy("n")
    want = df.withColumn("rn", F.row_number().over(w))
    a = sorted(tuple(r) for r in got.select("g", "n", "rn").collect())
    b = sorted(tuple(r) for r in want.select("g", "n", "rn").collect())
    assert a == b


def test_random_split_is_seeded(spark):
    from textlake.plans.qa import random_split
    df = spark.range(1000)
    a1, b1 = random_split(df, 0.2, seed=7)
    a2, b2 = random_split(df, 0.2, seed=7)
    assert a1.count() + b1.count() == 1000
    assert sorted(r.id for r in b1.collect()) == sorted(r.id for r in b2.collect())


def test_histogram_min_equals_max(spark):
    from textlake.operators.aggregates import histogram
    df = spark.createDataFrame([(7,), (7,), (7,), (None,)], "v long")
    assert [(r.bin, r.n) for r in histogram(df, "v", 20).collect()] == [(0, 3)]
    df2 = spark.createDataFrame([(0,), (5,), (10,)], "v long")
    got = sorted((r.bin, r.n) for r in histogram(df2, "v", 20).collect())
    assert got == [(0, 1), (10, 1), (19, 1)]  # the maximum falls in the last, closed bin


def test_zero_hits_give_no_context(spark):
    from textlake.params import Params
    from textlake.plans.retrieval import answer_contexts
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    q = e.select(F.col("vec_id").alias("query_id"), "embedding")
    out = answer_contexts(q, e, d, Params(), min_score=1.5, exclude_same_id=True)
    assert out.count() == 0


def _numbered(df, got):
    w = Window.partitionBy("g").orderBy("n")
    want = df.withColumn("rn", F.row_number().over(w))
    cols = [*df.columns, "rn"]
    assert got.columns == cols
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.select(cols).collect()), key=repr)


def test_dense_row_number_carries_columns_and_null_groups(spark):
    rows = [(None if i % 5 == 0 else i % 5, i * 7919 % 20011, f"payload {i}") for i in range(20000)]
    df = spark.createDataFrame(rows, "g int, n int, p string").repartition(6)
    _numbered(df, dense_row_number(df, ["g"], ["n"], "rn", num_partitions=7))


def test_dense_row_number_one_hot_group_among_many(spark):
    # nine tenths of the rows in one of many groups: its numbers come from several tasks
    rows = [(-1, i) for i in range(18000)] + [(g, 0) for g in range(2000)]
    df = spark.createDataFrame(rows, "g int, n int").repartition(4)
    got = dense_row_number(df, ["g"], ["n"], "rn", num_partitions=8)
    _numbered(df, got)
    tasks = got.where("g = -1").select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks >= 1  # the join may regroup small results; ranges below are what is split
    ranged = df.repartitionByRange(8, "g", "n").where("g = -1").select(F.spark_partition_id().alias("p")).distinct()
    assert ranged.count() >= 6


def test_first_rows_cuts_a_total_order(spark):
    from textlake.operators.windows import first_rows
    df = spark.createDataFrame([(i * 37 % 1000,) for i in range(1000)], "n int").repartition(5)
    assert sorted(r.n for r in first_rows(df, ["n"], 123).collect()) == list(range(123))
    assert first_rows(df, ["n"], 5000).count() == 1000


def test_profile_counts_what_it_leaves_out(spark):
    from textlake.params import Params
    from textlake.plans.corpus import profile_chunks, profile_histogram
    df = spark.createDataFrame([(f"{i}_chunk1", "a b c" if i % 4 else "x" * 50) for i in range(40)], "text_id string, chunk string")
    out = profile_chunks(df, Params(max_bytes=60))
    assert out["stats"].collect()[0].asDict() == {"n_chunks": 30, "total_tokens": 90, "mean_tokens": 3.0, "n_over_bytes": 10}
    assert profile_histogram(out["chunks"]).collect()[0].n == 30
    assert profile_chunks(df, Params(max_chunks=7))["stats"].first().n_chunks == 7


def test_observed_stage_counts(spark):
    from textlake.operators.aggregates import observe_counts
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    seen, obs = observe_counts(d, "docs", non_empty=F.length("text") > 0)
    n = seen.where(F.col("lang") == "en").count()
    got = obs.get
    assert got["n_rows"] == d.count() and got["n_non_empty"] <= got["n_rows"] and n <= got["n_rows"]
