import hashlib
import random

import numpy as np
import pytest

from helpers import docs_of
from textlake.llm import multiset_hash as mh


def corpus(seed, n=80):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghñ€𝒳 ") for _ in range(rnd.randint(1, 8)))
    text = lambda m: "".join(word() + rnd.choice("   \n") for _ in range(m))
    docs = [(i, text(rnd.randint(1, 200))) for i in range(0, 2 * n, 2)]
    return docs + [(1, None), (3, ""), (5, "\n"), (7, "x"), (-4, text(9)), (None, text(30)), (9, docs[3][1]), (11, text(4000)), docs[4], docs[4]]


def plain(docs):
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), one document after the other."""
    def vector(t):  # each paragraph on its own, summed as plain numbers
        total = [0] * mh.LANES
        for line in t.split("\n"):
            for k, x in enumerate(mh.fingerprints([line])[0].tolist()):
                total[k] = (total[k] + x) % (1 << 16)
        return np.array([total], np.uint16)
    docs = sorted(((d, t or "") for d, t in docs), key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for (d, t), (_, nxt) in zip(docs, docs[1:] + docs[:1]):
        half = len(t) // 2
        edited = t[:len(t) - half] + nxt[:half]
        a, b, c = vector(t), vector(edited), vector(nxt)
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), a.tobytes(), b.tobytes(),
                    float(mh.likeness(a, b)[0]), float(mh.likeness(a, c)[0])))
    return sorted(out, key=repr)


def found(df):
    return sorted(((*r[:3], bytes(r[3]), bytes(r[4]), *r[5:]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("part_bytes", [32 << 20, 3000])
def test_equals_the_definition(spark, part_bytes):
    """Rows, edits and likeness over one part or many, whole order wrapped at its end."""
    docs = corpus(2)
    out = mh.edited_fingerprints(docs_of(spark, docs).repartition(6), part_bytes=part_bytes)
    assert found(out) == plain(docs)


def test_many_copies_travel_once(spark):
    docs = corpus(3, 20) + [(8, "many copies\nof this")] * 300 + [(None, None)] * 200
    out = mh.edited_fingerprints(docs_of(spark, docs).repartition(5), part_bytes=2000, many_copies=50)
    # the order of rows with one id is free: they are told apart by a hash of the text
    expected = plain([r for r in docs if r[0] is not None])
    rows = found(out)
    assert len(rows) == len(docs)
    copies = [r for r in rows if r[0] == 8 and r[1] == 19]
    assert len(copies) == 300 and sum(r[6] == 1.0 for r in copies) >= 299
    assert [r for r in rows if r[0] is not None and r[0] not in (8, -4)] == [r for r in expected if r[0] not in (8, -4)]
    nones = [r for r in rows if r[0] is None and r[1] == 0]
    assert len(nones) == 200 and sum(r[6] == 1.0 for r in nones) >= 199


def test_order_free_and_incremental():
    a, b, c = "first line", "second\tline here", "third"
    one, other = mh.fingerprints([f"{a}\n{b}\n{c}"]), mh.fingerprints([f"{c}\n{a}\n{b}"])
    assert (one == other).all() and mh.likeness(one, other)[0] == 1
    part = mh.fingerprints([b])
    assert (mh.combine(one, deleted=part) == mh.fingerprints([f"{a}\n{c}"])).all()
    assert (mh.combine(mh.fingerprints([f"{a}\n{c}"]), inserted=part) == one).all()
    for t in (f"{a}\n{b}", f"{a}\n{b}\n{c}\n{c}", f"{a}\n{b}\n{c}\n", f"{a} {b}\n{c}", f"{a}\n{b.upper()}\n{c}"):
        assert (mh.fingerprints([t]) != one).any()
    assert (mh.fingerprints([""]) != mh.fingerprints([None])).any()


def test_likeness_follows_the_share_of_common_words():
    rnd = random.Random(5)
    words = [f"w{rnd.randrange(10**6)}" for _ in range(6000)]
    whole = "\n".join(" ".join(words[i:i + 12]) for i in range(0, 3000, 12))
    for kept in (0, 0.25, 0.5, 0.75, 1):
        cut = int(250 * kept)
        lines = whole.split("\n")
        other = "\n".join(lines[:cut] + [" ".join(words[3000 + 12 * i:3012 + 12 * i]) for i in range(250 - cut)])
        assert abs(mh.likeness(mh.fingerprints([whole]), mh.fingerprints([other]))[0] - kept) < 0.2


def test_empty_table_and_clashing_columns(spark):
    from pyspark.sql import functions as F
    docs = docs_of(spark, [(1, "a\nb c"), (2, "d e f g")])
    assert mh.edited_fingerprints(docs.limit(0)).collect() == []
    more = docs
    for c in ("order", "tie", "copies", "part", "bytes", "vector"):
        more = more.withColumn(c, F.lit("x"))
    assert found(mh.edited_fingerprints(more)) == plain([(1, "a\nb c"), (2, "d e f g")])
    got = {r.doc_id: bytes(r.vector) for r in mh.text_fingerprints(more).collect()}
    assert got == {d: mh.fingerprints([t]).tobytes() for d, t in ((1, "a\nb c"), (2, "d e f g"))}
