import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from helpers import docs_of, lower_ascii, rows_of
from textlake.llm import ranked_search
from textlake.llm.ranked_search import mine_shared

TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")


def terms(text):
    return TERM.findall(lower_ascii(text))


def plain(docs, items, k=10):
    """Rows by the formula, one document and item after the other."""
    found = [(d, Counter(terms(t))) for d, t in docs]
    found = [(d, c) for d, c in found if c]
    n_docs, n_terms = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for i, q in wanted.items():
        rows = []
        for d, c in found:
            m = 10 + (90 * sum(c.values()) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                    for t in q if t in c)
            if s > 0:
                rows.append((-s, d is None, d or 0, d))
        out += [(i, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(rows)[:k], 1)]
    return sorted(out, key=repr)


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def corpus(seed, n=300):
    rnd = random.Random(seed)
    vocab = [f"w{int(rnd.paretovariate(0.6))}" for _ in range(400)] + ["ñandú", "Été", "x_y", "a.b"]
    text = lambda m: " ".join(rnd.choice(vocab) for _ in range(m))
    docs = [(i, text(rnd.randint(1, 60))) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, " .,;\n"), (None, docs[0][1]), (None, text(20)), docs[3], docs[3], (n + 3, docs[5][1]),
             (n + 4, text(200_000))]
    items = [(i, text(rnd.randint(1, 25)) + " " + docs[i][1]) for i in range(30)]
    items += [(100, None), (101, ""), (102, "..."), (None, text(5)), (7, text(4)), (103, items[2][1]), (104, "nowhere"), items[9]]
    return docs, items


@pytest.mark.parametrize("block_terms, acc_bytes", [(1 << 18, 16 << 20), (250, 1)])
def test_equals_the_formula(spark, block_terms, acc_bytes):
    """One block or many, documents in one run or one by one: the same rows."""
    docs, items = corpus(1)
    out = ranked_search.ranked_search(docs_of(spark, docs).repartition(5), items_of(spark, items), block_terms=block_terms, acc_bytes=acc_bytes)
    assert rows_of(out) == plain(docs, items)


def test_ties_go_by_id_over_partitions(spark):
    docs = [(i, "same words here" if i % 2 else "other") for i in reversed(range(200))]
    out = ranked_search.ranked_search(docs_of(spark, docs).repartition(7), items_of(spark, [(1, "Same WORDS")]))
    assert [(r.rank, r.doc_id) for r in sorted(out.collect(), key=lambda r: r.rank)] == [(i + 1, 2 * i + 1) for i in range(10)]


def test_empty_tables_and_clashing_columns(spark):
    docs, items = docs_of(spark, [(1, "a b")]), items_of(spark, [(1, "a")])
    assert ranked_search.ranked_search(docs.limit(0), items).collect() == []
    assert ranked_search.ranked_search(docs, items.limit(0)).collect() == []
    from pyspark.sql import functions as F
    more = docs_of(spark, [(1, "a b"), (2, "b")])
    for c in ("n", "terms", "tfs", "item_id", "rank", "score"):
        more, items = more.withColumn(c, F.lit("x")), items if c == "item_id" else items.withColumn(c, F.lit(3))
    out = ranked_search.ranked_search(more, items)
    assert rows_of(out) == plain([(1, "a b"), (2, "b")], [(1, "a")])


def test_shared_sets_add_up_to_the_items():
    """Every list unfolds to its own leaves, and sharing shortens the sums."""
    rnd = np.random.default_rng(3)
    sets = [np.unique(rnd.zipf(1.3, 40) % 300) for _ in range(200)]
    nodes, sizes = np.concatenate(sets), np.array([len(s) for s in sets])
    left, right, rest, short = mine_shared(nodes, sizes, 300)
    def unfold(x):
        return [x] if x < 300 else unfold(left[x - 300]) + unfold(right[x - 300])
    ends = np.cumsum(short)
    for s, a, b in zip(sets, ends - short, ends):
        assert sorted(y for x in rest[a:b] for y in unfold(x)) == s.tolist()
    assert len(left) + len(rest) < 0.8 * len(nodes)
