import math
import random
from collections import Counter

import pytest

from helpers import docs_of, lower_ascii, words
from textlake.llm.lm_backoff import _pack, _pack_counts, _unpack, _unpack_counts, lm_scores


def brute(rows, order, alpha, min_count):
    docs = [words(lower_ascii(t)) for _, t in rows]
    c = Counter(tuple(w[i - n + 1:i + 1]) for w in docs for i in range(len(w)) for n in range(1, order + 1) if i - n + 1 >= 0)
    total = sum(map(len, docs))

    def s(g, own):
        if len(g) == 1:
            return c[g] / total
        others = c[g] - own[g]
        if others >= min_count and s_known(g[:-1], own):
            return others / (c[g[:-1]] - own[g[:-1]])
        return alpha * s(g[1:], own)

    def s_known(g, own):
        return c[g] - own[g] >= (min_count if len(g) > 1 else 1) and (len(g) == 1 or s_known(g[:-1], own))
    out = []
    for (d, _), w in zip(rows, docs):
        own = Counter(tuple(w[i - n + 1:i + 1]) for i in range(len(w)) for n in range(1, order + 1) if i - n + 1 >= 0)
        out.append((d, len(w), sum(math.log(s(tuple(w[max(0, i - order + 1):i + 1]), own)) for i in range(len(w)))))
    return out


@pytest.mark.parametrize("order,min_count,chunk", [(2, 2, 1 << 20), (3, 1, 300), (1, 1, 200), (4, 3, 500), (3, 1, 1 << 20)])
def test_matches_brute_force(spark, order, min_count, chunk):
    rng = random.Random(order)
    rows = [(i, " ".join(rng.choice(["a", "B", "b", "é", "cc", "d", f"x{rng.randrange(30)}"]) for _ in range(rng.randrange(40)))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, "a"), (103, "never"), (104, rows[3][1]), (104, rows[3][1])]
    out = lm_scores(docs_of(spark, rows), order=order, min_count=min_count, chunk_bytes=chunk, bucket_bytes=chunk)
    got = sorted(map(tuple, out.select("doc_id", "n_words", "score").collect()))
    want = sorted(brute(rows, order, 0.4, min_count))
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert [r[2] for r in got] == pytest.approx([r[2] for r in want])
    assert out.where("n_words = 0 AND mean IS NOT NULL").count() == 0


def test_text_found_elsewhere_scores_higher(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("abcdefghijklmnopqrst") for _ in range(30))) for i in range(40)]
    out = {r["doc_id"]: r["mean"] for r in lm_scores(docs_of(spark, rows + [(99, rows[0][1])])).collect()}
    assert out[0] == out[99] > max(out[i] for i in range(1, 40))


def test_null_ids_long_texts_and_empty_table(spark):
    rows = [(None, "a b " * 30000), (None, "a b"), (2, "b a")]
    got = sorted(lm_scores(docs_of(spark, rows)).select("n_words", "score").collect())
    assert [r[0] for r in got] == [2, 2, 60000]
    assert lm_scores(docs_of(spark, rows).limit(0)).count() == 0


def test_packing_round_trips():
    import numpy as np
    keys = np.sort(np.array([0, 1, 5, 1 << 55, (1 << 56) - 1], np.uint64))
    assert (_unpack(_pack(keys)) == keys).all()
    for n in ([1, 1, 2], [0, 300], [1 << 40, 7], []):
        assert _unpack_counts(_pack_counts(np.array(n, np.int64))).tolist() == n
