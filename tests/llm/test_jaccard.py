import random

import pytest

from helpers import docs_of, lower_ascii, words
from textlake.llm.components import components
from textlake.llm.jaccard_join import drop_near_duplicates, jaccard_components


def sets(text, size):
    w = words(lower_ascii(text))
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute(rows, size, percent):
    s = [sets(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(s[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def near_copies(seed, groups=14, size=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    texts = []
    for g in range(groups):
        base = [rng.choice(vocab) for _ in range(rng.randrange(4, size))]
        for _ in range(rng.randrange(1, 14)):
            t = list(base)
            for _ in range(rng.randrange(0, 5)):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            base = t if rng.random() < 0.4 else base  # chains of small changes as well as stars
            texts.append(" ".join(t))
    texts += ["the same passage " * 5 + " ".join(rng.choice(vocab) for _ in range(40)) for _ in range(15)]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed,size,percent,rounds", [(1, 3, 90, 3), (2, 3, 70, 1), (3, 5, 80, 0), (4, 1, 60, 2), (5, 2, 100, 3)])
def test_components_match_brute_force(spark, seed, size, percent, rounds):
    texts = near_copies(seed) + [None, "", " \n", "a", "A", "a b", "B a", "a b c", "A  B\tC"] * 2
    rows = [(1000 - 3 * i, t) for i, t in enumerate(texts)]
    out = jaccard_components(docs_of(spark, rows), size=size, percent=percent, rounds=rounds, rank_bits=14)
    assert sorted(map(tuple, out.select("doc_id", "n_shingles", "component_id").collect()), key=repr) == brute(rows, size, percent)


def test_a_large_group_is_a_star(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(250):
        t = list(base)
        for _ in range(3):
            t[rng.randrange(300)] = f"x{rng.randrange(10 ** 6)}"
        texts.append(" ".join(t))
    rows = list(enumerate(texts))
    out = jaccard_components(docs_of(spark, rows))
    assert sorted(map(tuple, out.select("doc_id", "n_shingles", "component_id").collect()), key=repr) == brute(rows, 3, 90)


def test_one_document_of_each_group_stays(spark):
    rows = [(5, "a b c d e f g h"), (2, "a b c d e f g h"), (2, "a b c d e f g h"), (3, None), (4, ""), (9, "z y x"), (None, "q r s t"), (None, None)]
    df = docs_of(spark, rows)
    out = drop_near_duplicates(df)
    assert out.columns == df.columns
    assert sorted([(r["doc_id"], r["text"]) for r in out.collect()], key=repr) == sorted(
        [(2, rows[0][1]), (3, None), (4, ""), (9, "z y x"), (None, "q r s t"), (None, None)], key=repr)


def test_nulls_repeats_long_texts_and_empty_table(spark):
    long = " ".join(f"w{i}" for i in range(50000))
    rows = [(7, long), (8, long + " tail"), (None, long), (7, long), (7, "another text here")]
    out = jaccard_components(docs_of(spark, rows))
    assert sorted(map(tuple, out.select("doc_id", "n_shingles", "component_id").collect()), key=repr) == brute(rows, 3, 90)
    assert jaccard_components(docs_of(spark, rows).limit(0)).count() == 0


def test_short_documents_each_alone_in_its_partition(spark):
    rows = [(1, "a b"), (2, "c d e"), (3, "A b")]
    df = docs_of(spark, rows).repartitionByRange(3, "doc_id")
    assert sorted(len(p) for p in df.rdd.glom().collect()) == [1, 1, 1]
    out = jaccard_components(df, size=5, percent=80)
    assert sorted(map(tuple, out.select("doc_id", "n_shingles", "component_id").collect()), key=repr) == brute(rows, 5, 80)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(500, 500), (-5, 7), (7, -5)]
    out = components(spark.createDataFrame(edges, "u long, v long"))
    got = {r["node"]: r["root"] for r in out.collect()}
    assert got == {**{i: -5 for i in range(41)}, -5: -5, **{i: 100 for i in range(100, 160)}}
    assert out.count() == len(got)


def test_bitmaps_bound_the_difference_of_large_sets():
    """Bits that differ are at most the shingles that differ, and tell unrelated sets of thousands of shingles apart."""
    import numpy as np
    from textlake.llm.jaccard_join import set_bitmaps
    rng = np.random.default_rng(3)
    values = rng.integers(1, 1 << 62, 6000).astype(np.uint64)
    sets = [values[:2000], values[60:2000], values[2000:4000], values[:0], values[:1]]
    sizes = np.array([len(s) for s in sets])
    words = np.array(set_bitmaps(np.concatenate(sets), sizes).to_pylist(), np.int64)
    apart = lambda i, j: int(np.bitwise_count((words[i] ^ words[j]).view(np.uint64)).sum())
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert apart(i, j) <= len(np.setxor1d(a, b))
    assert apart(0, 2) > 4000 * 10 // 190  # more than linked sets may differ
    assert not words[3].any() and apart(3, 4) == 1


def test_texts_are_fetched_for_near_sets_only(spark, monkeypatch):
    """Sets that share a prefix shingle and little else never need their texts."""
    from textlake.llm import jaccard_join as J
    rng = random.Random(8)
    own = lambda: [f"v{rng.randrange(10 ** 6)}" for _ in range(50)]
    common = [f"c{i}" for i in range(40)]
    rows = [(i, " ".join(common + own())) for i in range(20)]
    rows += [(50, " ".join(own() + own())), (51, None)]
    rows.append((52, rows[20][1] + " more"))
    asked, texts = [], J._Join.texts

    def counted(self, pairs):
        out = texts(self, pairs)
        asked.append(out.count())
        return out
    monkeypatch.setattr(J._Join, "texts", counted)
    found = jaccard_components(docs_of(spark, rows), rank_bits=1).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, found.collect()), key=repr) == brute(rows, 3, 90)
    assert asked == [2]


def test_prefix_rows_without_a_fitting_set_are_dropped(spark):
    """A shingle's sets of sizes too far apart leave no rows; every two sets that fit each other stay, copies once."""
    from textlake.llm.jaccard_join import with_partners
    rng = random.Random(4)
    rows = [(1, 10 * k, 2 ** k, 0) for k in range(1, 8)] + [(2, 900, 100, 0), (2, 901, 120, 0), (3, 5, 40, 0), (3, 5, 40, 0)]
    for h in range(10, 60):
        for s in rng.sample(range(1000), rng.randrange(1, 7)):
            n = rng.randrange(1, 60)
            rows += [(h, s, n, rng.randrange(n - -(-9 * n // 10) + 1))] * rng.randrange(1, 3)
    out = [tuple(r) for r in with_partners(spark.createDataFrame(rows, "h long, s long, n int, pos int").repartition(3), 90).collect()]

    def fits(a, b):
        return a[0] == b[0] and a[1] != b[1] and 190 * min(a[2] - a[3], b[2] - b[3]) >= 90 * (a[2] + b[2])
    assert len(out) == len(set(out)) and set(out) <= set(rows)
    assert {r for r in rows if any(fits(r, x) for x in rows)} <= set(out)
    assert not [r for r in out if r[0] < 10]
