import math
import random

import numpy as np
from pyspark.sql import functions as F

from helpers import docs_of
from textlake.llm import toxicity_fm as X
from textlake.llm.queries import held_out, read


def auc(score, label):
    rank = np.empty(len(score))
    rank[np.argsort(score)] = np.arange(len(score))
    n = label.sum()
    return (rank[label == 1].sum() - n * (n - 1) / 2) / (n * (len(label) - n))


def pairs(n, seed):
    """Toxic where an insult meets a group mention; each alone is as frequent in clean texts."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        w = [rng.choice("abcdefghijklmnop") * 3 for _ in range(20)] + ["scum"] * insult + ["folk"] * group
        rng.shuffle(w)
        rows.append((i, " ".join(w), int(insult == group)))
    return rows


def test_pairwise_interactions_are_learned(spark):
    train, test = pairs(1500, 1), pairs(500, 2)
    model = X.train(docs_of(spark, [r[:2] for r in train]), spark.createDataFrame([(d, t) for d, _, t in train], "doc_id long, toxic int"), epochs=40)
    out = X.score(docs_of(spark, [r[:2] for r in test]), model).orderBy("doc_id").collect()
    label = np.array([t for *_, t in test])
    score = np.array([r["toxic_score"] for r in out])
    # no additive weights of the two terms can tell these apart
    assert auc(score, label) > 0.95


def rare_pairs(n, seed, share=0.04, base=0.095):
    """Rare words that are toxic together only; alone they are as rarely toxic as others are by chance."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = rng.random() < share, rng.random() < share
        if rng.random() < share / 10:
            a = b = True
        w = [f"w{rng.randrange(3000)}" for _ in range(58)] + ["scum"] * a + ["folk"] * b
        rng.shuffle(w)
        rows.append((i, " ".join(w), int(a and b) if a or b else int(rng.random() < base), a + b))
    return rows


def test_rare_pair_is_learned(spark):
    train, test = rare_pairs(6000, 1), rare_pairs(2000, 2)
    labels = spark.createDataFrame([(d, t) for d, _, t, _ in train], "doc_id long, toxic int")
    model = X.train(docs_of(spark, [r[:2] for r in train]), labels)
    out = X.score(docs_of(spark, [r[:2] for r in test]), model).orderBy("doc_id").collect()
    score, both = np.array([r["toxic_score"] for r in out]), np.array([k for *_, k in test])
    assert score[both == 2].mean() > 0.5 and score[both == 1].mean() < 0.2 and score[both == 0].mean() < 0.2


def test_telling_pairs_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(X, "PAIR_BLOCK", 50)
    rng = random.Random(5)
    docs = []
    for i in range(400):
        places = set(rng.sample(range(12), 4))
        docs.append((int({1, 2} <= places or {7, 9} <= places or rng.random() < 0.1), i, sorted(places)))
    p = sum(d[0] for d in docs) / len(docs)
    sample = spark.createDataFrame(docs, "toxic int, order long, places array<int>")
    df = {a: [d[0] for d in docs if a in d[2]] for a in range(12)}
    counts = spark.createDataFrame([(a, len(x), sum(x)) for a, x in df.items()], "place int, df long, hit long")
    want, limit = set(), math.log(12 * 11 / 2 / 0.05)
    for a in range(12):
        for b in range(a):
            x = [d[0] for d in docs if a in d[2] and b in d[2]]
            ra, rb = ((sum(df[k]) + p) / (len(df[k]) + 1) for k in (a, b))
            odds = ra / (1 - ra) * rb / (1 - rb) * (1 - p) / p
            e, h, n = max(odds / (1 + odds), p), sum(x), len(x)
            g = h * math.log(h / (n * e)) + ((n - h) * math.log((n - h) / (n * (1 - e))) if n > h else 0) if h > n * e else 0
            want |= {a, b} if g >= limit else set()
    assert want and X.telling_pairs(sample, counts, p, bits=4) == want


def test_scores_equal_a_plain_machine():
    rng = np.random.default_rng(3)
    index = np.array([0, 1, 2, 0, 3, 4, 5, 0], np.int32)
    model = X.Model(-0.4, index, np.vstack([np.zeros(4), rng.normal(size=(5, 4))]))
    docs = [[1, 2, 4], [], [0, 3, 7], [1, 2, 4, 5, 6], [6]]
    got = model.scores(np.concatenate(docs).astype(np.int64), np.array(list(map(len, docs))))
    for s, d in zip(got, docs):
        w = [model.weights[index[x]] for x in d if index[x]]
        raw = -0.4 + sum(x[0] for x in w) + sum(float(np.dot(x[1:], y[1:])) for i, x in enumerate(w) for y in w[:i])
        assert abs(s - 1 / (1 + math.exp(-raw))) < 1e-12


def test_held_out_accuracy_on_the_table(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = read(spark, sf, "documents").select("doc_id", "text"), read(spark, sf, "labels")
    model = X.train(docs, labels.where(~held_out()))
    out = X.score(docs, model).join(labels, "doc_id").where(held_out()).collect()
    label, found = np.array([r["toxic"] for r in out]), np.array([r["toxic_predicted"] for r in out])
    assert label.sum() > 50
    assert auc(np.array([r["toxic_score"] for r in out]), label) > 0.95
    assert (found & label).sum() > 0.85 * label.sum() and (found & label).sum() > 0.9 * found.sum()


def test_inflected_forms_share_a_term(spark):
    rows = [(i, f"plain words vilest{'abcdefghij'[i // 10 % 10]}" if i % 10 == 0 else "plain words only") for i in range(300)]
    model = X.train(docs_of(spark, rows), spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(300)], "doc_id long, toxic int"))
    out = {r["doc_id"]: r["toxic_predicted"] for r in X.score(docs_of(spark, [(1, "a vilestxyz thing"), (2, "a plain thing")]), model).collect()}
    assert out == {1: 1, 2: 0}


def test_defined_cases(spark):
    docs = docs_of(spark, [(1, None), (2, ""), (3, "bad word"), (4, "good word"), (4, "good word"), (5, "x " * 100000)])
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    model = X.train(docs, empty)
    assert {r["toxic_predicted"] for r in X.score(docs, model).collect()} == {0}
    one = X.train(docs, spark.createDataFrame([(3, 1), (3, None), (3, 0)], "doc_id long, toxic int"))
    out = X.score(docs, one, names=("score", "predicted"))
    assert out.count() == 6 and out.where("score < 0.9 OR predicted = 0").count() == 0
    assert out.columns == [*docs.columns, "score", "predicted"]
    labels = spark.createDataFrame([(i, i % 2) for i in range(6)] * 2, "doc_id long, toxic int").withColumn("text", F.lit("clash"))
    assert X.score(docs.limit(0), X.train(docs, labels)).count() == 0
    assert X.drop_toxic(docs, empty).columns == docs.columns
    assert X.drop_toxic(docs.withColumn("toxic_score", F.lit(1)), empty).count() == 6


def test_sample_is_bounded(spark):
    rows = pairs(300, 3)
    labels = spark.createDataFrame([(d, t) for d, _, t in rows], "doc_id long, toxic int")
    a = X.train(docs_of(spark, [r[:2] for r in rows]), labels, sample_docs=50)
    b = X.train(docs_of(spark, [r[:2] for r in rows[::-1]]), labels, sample_docs=50)
    assert np.array_equal(a.weights, b.weights) and a.bias == b.bias


def test_repeated_ids_do_not_widen_the_sample(spark, monkeypatch):
    sizes, fit = [], X.fit
    monkeypatch.setattr(X, "fit", lambda rows, n, *more, **how: sizes.append(len(n)) or fit(rows, n, *more, **how))
    rows = [(d % 20, t) for d, t, _ in pairs(600, 4)]  # thirty texts of each id
    labels = spark.createDataFrame([(d, d % 2) for d in range(20)], "doc_id long, toxic int")
    X.train(docs_of(spark, rows), labels, sample_docs=7)
    X.train(docs_of(spark, rows), labels)
    assert sizes == [7, 20]
