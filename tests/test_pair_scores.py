"""Scores of given pairs: equal to BM25 said plainly, whatever repeats, in any turns and runs, and no rows of (pair, term)."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from textlake.functions.packing import pack, unpack
from textlake.functions.text import fold_py
from textlake.operators import joins
from textlake.operators import rerank as R


def tables(spark, seed=3):
    rnd = random.Random(seed)
    word = lambda: f"w{int(rnd.paretovariate(0.6)) % 900}"
    docs = [(i, " ".join(word() for _ in range(rnd.randint(1, 60)))) for i in range(150)]
    docs += [docs[7], docs[7], (7, "w1 w2"), (7, "w1 w1"), (8, None), (150, None), (151, ""), (152, "Áéí W1 w1")]
    docs += [(None, "w1 w2 w3"), (None, "w1"), (None, "w5")]
    queries = [(i, " ".join(word() for _ in range(12))) for i in range(20)]
    queries += [(3, "w1 w2 w1"), (20, "nothing-here"), (21, ""), (22, None), (23, "aei w1"), (None, "w1"), (99, "w1")]
    pairs = [(q, rnd.choice([7, 8, 150, 151, 152, 999, rnd.randrange(150)])) for q in range(24) for _ in range(8)]
    pairs += [(23, 152), (3, 7), (3, 7), (3, 7), (None, 7), (3, None), (77, 7)]
    return docs, queries, pairs


def words(text):
    return re.findall("[a-z0-9]+", fold_py(text)) if text else []


def expected(docs, queries, pairs, k1=1.2, b=0.75):
    tf, longest = defaultdict(Counter), defaultdict(list)
    for d, text in docs:
        t = words(text)
        longest[d].append(None if text is None else len(t))
        if t:
            tf[d, len(t)].update(t)
    lengths = [max((x for x in n if x is not None), default=None) for n in longest.values()]
    known = [x for x in lengths if x is not None]
    avgdl, n = sum(known) / len(known), len(lengths)
    df = Counter(t for c in tf.values() for t in c)
    asked = defaultdict(set)
    for q, text in queries:
        asked[q] |= set(words(text))
    out = {}
    for (q, d), times in Counter(p for p in pairs if None not in p).items():
        parts = [math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1) * c[t] * (k1 + 1) / (c[t] + k1 * (1 - b + b * dl / avgdl))
                 for (e, dl), c in tf.items() if e == d for t in asked[q] if t in c]
        if parts:
            out[q, d] = sum(parts) * times
    return out


@pytest.mark.parametrize("terms_a_turn, bound, repeats", [(1 << 22, 1 << 26, True), (1 << 22, 1 << 26, False), (20, 0, True)])
def test_equals_bm25_of_the_pairs(spark, monkeypatch, terms_a_turn, bound, repeats):
    docs, queries, pairs = tables(spark)
    if not repeats:
        docs = list({d: (d, x) for d, x in docs}.values())
    monkeypatch.setattr(R, "VOCABULARY_TERMS", terms_a_turn)
    monkeypatch.setattr(joins, "BROADCAST_BYTE_BOUND", bound)
    monkeypatch.setattr(R, "postings", None)  # the corpus is not exchanged by (document, term)
    found = R.bm25(spark.createDataFrame(queries, "query_id int, text string"), spark.createDataFrame(docs, "doc_id long, text string"),
                   candidates=spark.createDataFrame(pairs, "query_id long, doc_id long"))
    assert dict(found.dtypes) == {"query_id": "bigint", "doc_id": "bigint", "score": "double"}
    assert "Generate" not in found._jdf.queryExecution().toString()  # nor are pairs by term
    rows = found.collect()
    want = expected(docs, queries, pairs)
    assert len(rows) == len(want) > 50
    assert {(r["query_id"], r["doc_id"]): round(r["score"], 9) for r in rows} == {k: round(x, 9) for k, x in want.items()}


def test_nothing_to_score(spark):
    docs, queries, pairs = tables(spark)
    d, q = spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame(queries, "query_id string, text string")
    p = spark.createDataFrame(pairs, "query_id string, doc_id string")
    assert R.bm25(q, d, candidates=p.limit(0)).count() == R.bm25(q.limit(0), d, candidates=p).count() == 0
    assert R.bm25(q, d.limit(0), candidates=p).count() == 0
    assert R.bm25(q, d, candidates=p).count() == len(expected(docs, queries, pairs))  # ids may be strings


def test_packed_rows():
    rnd = np.random.default_rng(1)
    rows = [np.sort(rnd.choice(10 ** int(rnd.integers(1, 7)), int(rnd.integers(0, 9)), replace=False)) for _ in range(60)]
    sizes, numbers = np.array([len(x) for x in rows]), np.concatenate(rows)
    counts = rnd.integers(1, 1 << 40, len(numbers))
    column = pack(sizes, numbers, counts)
    for lo, hi in ((0, 60), (7, 31), (59, 60), (4, 4)):
        row, number, count = unpack(column.slice(lo, hi - lo))
        a, b = sizes[:lo].sum(), sizes[:hi].sum()
        assert row.tolist() == np.repeat(np.arange(hi - lo), sizes[lo:hi]).tolist()
        assert number.tolist() == numbers[a:b].tolist() and count.tolist() == counts[a:b].tolist()
    assert len(pack(np.array([4]), np.array([0, 5, 100, 127]), np.ones(4, np.int64))[0].as_py()) == 8  # two bytes an entry


def test_queries_go_on_from_batch_to_batch(monkeypatch):
    """Any cut of the rows into batches and runs gives the same scores."""
    rnd = np.random.default_rng(2)
    entries = lambda: np.sort(rnd.choice(40, 15, replace=False))
    rows = []
    for q in range(9):
        rows += [(q, None, 0, None, entries()) for _ in range(q % 3)]  # the first has no text, others have two
        rows += [(q, 100 + d, 1 + d % 2, 15, entries()) for d in range(5)]
    column = pack(np.full(len(rows), 15), np.concatenate([r[4] for r in rows]), rnd.integers(1, 9, 15 * len(rows)))
    plain = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))]
    whole = pa.RecordBatch.from_arrays([*plain, column], ["query_id", "doc_id", "times", "dl", "packed"])
    table = type("V", (), {"value": rnd.random(40)})
    found = []
    for step, run in ((len(rows), 1 << 20), (len(rows), 40), (4, 1 << 20), (1, 1)):
        monkeypatch.setattr(R, "PAIR_RUN_BYTES", run)
        batches = [whole.slice(at, step) for at in range(0, len(rows), step)]
        found.append([r for o in R._scored_pairs(table, 12.0, 1.2, 0.75)(iter(batches)) for r in o.to_pylist()])
    assert all(x == found[0] for x in found) and {r["query_id"] for r in found[0]} == {1, 2, 4, 5, 7, 8}
