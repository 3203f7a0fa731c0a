import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from helpers import lower_ascii, words
from textlake.llm.common import distinct_per_doc, shingle_hashes, slices, text_buffers, word_hashes

TEXT = st.one_of(st.none(), st.text(alphabet="aAbZ é\n\t\x0b\x1c ,.", max_size=40))


def hashed(texts, size=1, limit=16, letters=False):
    buf, off = text_buffers(pa.array(texts, pa.string()))
    out = []
    for i, j in slices(off, limit):
        h, c = word_hashes(buf[off[i]:off[j]], off[i:j + 1] - off[i], letters)
        assert c.sum() == len(h)
        s, d = shingle_hashes(h, c, size)
        v, m = distinct_per_doc(s, d, j - i)
        e = np.cumsum(m)
        out += [set(v[b - n:b].tolist()) for n, b in zip(m, e)]
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=8), st.integers(1, 3))
def test_shingle_sets_mirror_plain_sets(texts, size):
    got = hashed(texts, size)
    want = []
    for t in texts:
        w = words(lower_ascii(t))
        want.append({tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    assert list(map(len, got)) == list(map(len, want))
    for a in range(len(texts)):
        for b in range(len(texts)):
            assert len(got[a] & got[b]) == len(want[a] & want[b])


def test_long_shingles_of_a_short_text_alone_in_its_slice():
    for n in range(5):
        sets = hashed([" ".join("abcd"[:n]), " ".join("ABCD"[:n]), "x y z a b c"], size=5, limit=1)
        assert list(map(len, sets)) == [min(n, 1), min(n, 1), 2] and sets[0] == sets[1]


def test_words_longer_than_the_position_table():
    a, b = "x" * 10000, "x" * 9999 + "y"
    one, two, three = hashed([a, b, a + " " + b])
    assert len(one) == len(two) == 1 and one != two and three == one | two


def test_letters_part_words_at_punctuation():
    one, two = hashed(["Ab,cd. é!", "ab cd é"], letters=True)
    assert one == two and len(one) == 3
