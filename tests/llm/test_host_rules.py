import random
from collections import Counter

from pyspark.sql import functions as F

from helpers import docs_of, words
from textlake.llm import host_rules as H


def brute(text):
    t, w = text or "", words(text)
    wins = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    cover = {i + k for i in range(len(w) - 2) if wins[tuple(w[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover)


def texts():
    rng = random.Random(2)
    out = [None, "", " \t\n", "a", "a b", "a b c", "a a a a", "a b c a b c", "x\n\nx\n x\n", "é#é $ \x0b<>", "\x1cq \x85", "a b c " * 3000]
    out += [" ".join(rng.choice("abcd") for _ in range(n)) + "\n" * (n % 3) + "a b" for n in range(3, 80, 4)]
    out += [" ".join(rng.choice(["ab", "é", "c\n", "d"]) + str(rng.randrange(20)) for _ in range(200))]
    return out


def test_statistics_match_brute_force(spark):
    rows = list(enumerate(texts()))
    out = H.text_statistics(docs_of(spark, rows)).orderBy("doc_id").select("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert [tuple(r) for r in out.collect()] == [brute(t) for _, t in rows]


def test_shrunk_rates_and_verdicts(spark):
    # a: 40 of 50 fail, b..k: none of 20, z: its only document fails, NULL hosts stand alone
    rows = [(i, "a", i < 40) for i in range(50)] + [(100 + 20 * h + i, f"h{h}", False) for h in range(10) for i in range(20)]
    rows += [(900, "z", True), (901, None, True), (902, None, False)]
    stats = spark.createDataFrame(rows, "doc_id long, source string, bad boolean")
    v = {r["host"]: r for r in H.host_verdicts(stats, "source", "bad").collect()}
    assert v["a"]["rejected"] and not v["h0"]["rejected"] and 0 < v["h0"]["rate"] < 0.1 and 0.6 < v["a"]["rate"] < 0.8
    assert v["z"]["rate"] < 1 and None not in v
    out = {r["doc_id"]: r["kept"] for r in H.apply_host_rules(stats, "source", "bad").collect()}
    assert len(out) == len(rows)
    assert not any(out[i] for i in range(50)) and out[100] and out[902] and not out[901]


def test_no_spread_and_empty(spark):
    same = spark.createDataFrame([(i, f"h{i % 3}", i % 6 < 3) for i in range(60)], "doc_id long, source string, bad boolean")
    rates = {round(r["rate"], 3) for r in H.host_verdicts(same, "source", "bad").collect()}
    assert rates == {0.5}
    assert H.apply_host_rules(same.limit(0), "source", "bad").count() == 0
    one = same.where("source = 'h0'")
    assert H.apply_host_rules(one, "source", "bad").count() == 20


def test_native_plan(spark):
    out = H.text_statistics(docs_of(spark, [(1, "a b c")])).withColumn("bad", H.base_rule())
    plan = H.apply_host_rules(out, "source", "bad")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert out.select(F.max("n_words")).first()[0] == 3
