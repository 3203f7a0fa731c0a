"""Model hooks (K4-K7) run in Arrow batches; the watermark dedup path of J1."""

import numpy as np
from pyspark.sql import functions as F

from textlake.functions.tokens import bpe_available, token_count
from textlake.operators.embedding import encode, encode_with, same_model
from textlake.operators.rerank import score_pairs_with
from textlake.operators.summary import summarize_with
from textlake.schemas import EVENTS
from textlake.streaming.incremental import resume_feed

from conftest import SMALL


def _make_factory():
    """A hook defined locally is shipped to the workers by value."""
    import numpy as np_

    class LengthEncoder:
        def encode(self, texts):
            return np_.array([[len(t), t.count(" ") + 1.0] for t in texts], dtype=np_.float32)

    return lambda: LengthEncoder()


def test_encode_with_hook_and_blank_text(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "   "), (3, None)], "id long, text string")
    out = {r.id: r for r in encode_with(df, _make_factory(), "len-2").collect()}
    assert out[1].embedding == [5.0, 3.0] and out[1].model_id == "len-2"
    assert out[2].embedding == [] and out[3].embedding == []


def test_default_encoder_is_unit_length_and_blank_is_empty(spark):
    df = spark.createDataFrame([(1, "Ley de protección civil"), (2, "")], "id long, text string")
    out = {r.id: r.embedding for r in encode(df).collect()}
    assert abs(np.linalg.norm(out[1]) - 1.0) < 1e-6 and len(out[1]) == 768
    assert out[2] == []


def test_model_mismatch_is_refused(spark):
    a = encode(spark.createDataFrame([(1, "x")], "id long, text string"))
    b = encode_with(spark.createDataFrame([(1, "x")], "id long, text string"), _make_factory(), "len-2")
    same_model(a, a)
    try:
        same_model(a, b)
        raise AssertionError("expected a refusal")
    except ValueError:
        pass


def test_pair_scorer_and_summarizer_hooks(spark):
    pairs = spark.createDataFrame([("ley", "la ley dice"), ("x", "nada")], "query_text string, doc_text string")
    got = score_pairs_with(pairs, lambda q, d: [float(a in b) for a, b in zip(q, d)]).collect()
    assert [r.score for r in got] == [1.0, 0.0]
    docs = spark.createDataFrame([("Primera frase. Segunda.",)], "text string")
    s = summarize_with(docs, lambda xs: [x.split(".")[0] for x in xs]).collect()[0]
    assert s.text_summary == "Primera frase"


def test_bpe_counter_is_optional(spark):
    # the vocabulary is not available offline; the native count is the default
    assert bpe_available() in (True, False)
    df = spark.createDataFrame([("Hola, mundo 2024!",)], "t string")
    assert df.select(token_count(F.col("t"))).first()[0] == 5  # Hola , mundo 2024 !


def test_resume_feed_with_watermark_dedup(spark, tmp_path):
    ev = spark.read.parquet(f"{SMALL}/events.parquet")
    src, sink, ck = str(tmp_path / "src"), str(tmp_path / "sink"), str(tmp_path / "ck")
    days = sorted({r[0] for r in ev.select(F.to_date("ts").cast("string")).distinct().collect()})
    for d in days[::5]:  # time-ordered files; each file also repeats the previous day
        part = ev.where(F.to_date("ts") >= F.date_sub(F.lit(d), 1)).where(F.to_date("ts") < F.date_add(F.lit(d), 5))
        part.coalesce(1).write.mode("append").parquet(src)
    q = resume_feed(spark, src, EVENTS, sink, ck, ["event_id"], max_files=1,
                    dedup_watermark=("ts", "3 days"))
    q.awaitTermination(300)
    out = spark.read.parquet(sink)
    assert out.count() == ev.count() and out.select("event_id").distinct().count() == ev.count()
