import itertools
import random
import re

from helpers import docs_of, rows_of
from textlake.llm.decontam import MASKS, contaminated, decontaminate, find_overlaps


def vocab(rng, n):
    return [rng.choice(["le", "un"]) if rng.random() < 0.3 else f"w{rng.randrange(3000)}" for _ in range(n)]


def brute(docs, items, least=13, share=0.8):
    """All diagonals of all pairs, grown from every seed hit as the operator defines it."""
    ids = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = {}
    for d, t in docs:
        w = ids(t)
        for it, x in items:
            v = ids(x)
            masks = MASKS if len(v) >= min(map(len, MASKS)) else ("1" * len(v),)
            for m in masks if v else ():
                for i in range(len(w) - len(m) + 1):
                    for j in range(len(v) - len(m) + 1):
                        if all(w[i + k] == v[j + k] for k, c in enumerate(m) if c == "1"):
                            eq = [w[i - j + k] == v[k] if 0 <= i - j + k < len(w) else None for k in range(len(v))]

                            def grow(flags):
                                n = e = 0
                                best = (0, 0)
                                for f in flags:
                                    if f is None:
                                        break
                                    n, e = n + 1, e + f
                                    if f and e >= n * share:
                                        best = (n, e)
                                return best
                            r, l = grow(eq[j:]), grow(eq[:j][::-1])
                            got = (r[0] + l[0], r[1] + l[1])
                            if got[0] >= min(least, len(v)):
                                out[d, it] = max(out.get((d, it), (0, 0, 0)), (*got, len(v)))
    return sorted((d, i, *x) for (d, i), x in out.items())


def fixture():
    rng = random.Random(8)
    items = [(i, " ".join(vocab(rng, n))) for i, n in enumerate([14, 15, 20, 30, 60, 3, 9, 10, 12])]
    docs = []
    for d in range(60):
        body = vocab(rng, rng.randrange(0, 80))
        if d % 2:
            w = items[rng.randrange(len(items))][1].split()
            a = rng.randrange(0, max(1, len(w) // 3)) if d % 3 == 0 else 0
            w = w[a:]
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = "other"
            at = rng.randrange(len(body) + 1)
            body[at:at] = w
        docs.append((d, " ".join(body).capitalize() + "."))
    return docs, items


def test_matches_brute_force(spark):
    docs, items = fixture()
    want = brute(docs, items)
    assert len(want) > 15
    got = rows_of(find_overlaps(docs_of(spark, docs), spark.createDataFrame(items, "item_id long, text string")))
    assert got == sorted(want, key=repr)


def test_substitutions_are_tolerated_and_clean_texts_stay(spark):
    item = " ".join(f"t{i}" for i in range(30))
    changed = " ".join("no" if i % 7 == 3 else f"t{i}" for i in range(30))
    half = " ".join(f"t{i}" if i % 2 else "no" for i in range(30))
    docs = docs_of(spark, [(1, "pre " + item), (2, changed + " post"), (3, half), (4, "t1 t2 t3 t4 t5 t6 t7 t8 t9 t10 t11 t12"), (5, "clean")])
    items = spark.createDataFrame([(9, item)], "item_id long, text string")
    assert [r["doc_id"] for r in contaminated(docs, items).orderBy("doc_id").collect()] == [1, 2]
    assert sorted(r["doc_id"] for r in decontaminate(docs, items).collect()) == [3, 4, 5]


def test_defined_cases(spark):
    long = "x " * 50000 + "alpha beta gamma"
    docs = docs_of(spark, [(1, None), (2, ""), (3, "..."), (4, "Alpha, BETA gamma!"), (4, "alpha beta gamma"), (None, "alpha beta gamma"), (6, long)])
    items = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "alpha beta gamma", 0), (3, "alpha beta gamma", 0)], "item_id long, text string, s int")
    got = rows_of(find_overlaps(docs, items))
    assert got == sorted([(4, 3, 3, 3, 3), (None, 3, 3, 3, 3), (6, 3, 3, 3, 3)], key=repr)
    kept = decontaminate(docs, items)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3]
    assert find_overlaps(docs, items.limit(0)).count() == 0
    assert find_overlaps(docs.limit(0), items).count() == 0


def test_clean_rows_stay_beside_contaminated_ones_of_their_id(spark):
    bad, rows = "alpha beta gamma", [(None, "clean one"), (None, "clean two"), (None, None), (7, "clean"), (7, None), (8, "clean")]
    docs = docs_of(spark, rows + [(None, bad), (None, "so " + bad), (7, bad), (7, bad)])
    items = spark.createDataFrame([(3, bad)], "item_id long, text string")
    kept = decontaminate(docs, items)
    assert kept.columns == docs.columns
    assert sorted([(r["doc_id"], r["text"]) for r in kept.collect()], key=repr) == sorted(rows, key=repr)
    # an id and a text of one value are not the same row
    texts = spark.createDataFrame([(bad, None), (None, bad)], "doc_id string, text string")
    assert decontaminate(texts, items).collect() == [(bad, None)]


def test_native_plan(spark):
    plan = find_overlaps(docs_of(spark, [(1, "a")]), spark.createDataFrame([(1, "b c d")], "item_id long, text string"))
    text = plan._jdf.queryExecution().toString()
    assert "Python" not in text and "Arrow" not in text and "NestedLoop" not in text


def whole(docs, items, least=13, num=4, den=5):
    """The longest stretch on any diagonal of any pair; knows neither seeds nor sides."""
    out = {}
    for d, t in docs:
        w = re.findall(r"[^\W_]+", t.lower())
        for it, x in items:
            v = re.findall(r"[^\W_]+", x.lower())
            for o in range(-len(v) + 1, len(w)):
                eq = [k for k in range(len(v)) if 0 <= o + k < len(w) and w[o + k] == v[k]]
                for a in range(len(eq)):
                    for b in range(a, len(eq)):
                        n, e = eq[b] - eq[a] + 1, b - a + 1
                        if n >= min(least, len(v)) and e * den >= n * num:
                            out[d, it] = max(out.get((d, it), (0, 0, 0)), (n, e, len(v)))
    return sorted(((d, i, *x) for (d, i), x in out.items()), key=repr)


def test_every_substitution_that_the_share_allows(spark):
    items, docs = [], []
    for n, most in ((10, 2), (11, 2), (13, 2), (14, 2), (15, 3)):
        item = [f"n{n}x{i}" for i in range(n)]
        items.append((n, " ".join(item)))
        for e in range(most + 1):
            for places in itertools.combinations(range(1, n - 1), e):
                docs.append((len(docs), " ".join(["pre"] + ["no" if i in places else x for i, x in enumerate(item)] + ["post"])))
    got = rows_of(find_overlaps(docs_of(spark, docs), spark.createDataFrame(items, "item_id long, text string")))
    assert len(got) == len(docs)
    assert got == whole(docs, items)


def test_long_stretches_of_any_substitutions(spark):
    rng = random.Random(5)
    items = [(i, " ".join(f"w{rng.randrange(60)}" for _ in range(n))) for i, n in enumerate([12, 16, 18, 19, 20, 24, 29, 40])]
    docs = []
    for d in range(240):
        w = rng.choice(items)[1].split()
        for _ in range(rng.randrange(0, len(w) // 3)):
            w[rng.randrange(len(w))] = "other"
        docs.append((d, " ".join(["a"] * rng.randrange(3) + w[rng.randrange(3):] + [f"w{rng.randrange(60)}" for _ in range(20)])))
    want = whole(docs, items)
    assert 60 < len(want) < 235
    assert rows_of(find_overlaps(docs_of(spark, docs), spark.createDataFrame(items, "item_id long, text string"))) == want


def test_masks_leave_no_stretch_without_a_seed():
    for n, e in ((10, 2), (15, 3), (20, 4)):
        for gone in itertools.combinations(range(1, n), e):
            assert any(all(o + k not in gone for k, c in enumerate(m) if c == "1") for m in MASKS for o in range(n - len(m) + 1))
