import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest

from helpers import docs_of, rows_of
from textlake.llm import token_align
from textlake.llm.queries import PIECES, TOKENIZER, op13_token_align

A, B = public_tokenizers.path(TOKENIZER), public_tokenizers.path(PIECES)


@pytest.fixture(scope="module")
def whole():
    """Ids and byte ends of a whole text by both libraries, without pieces, windows or memory."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=B)
    from tokenizers.pre_tokenizers import ByteLevel
    names = sorted(ByteLevel.alphabet())
    plain = [c for c in names if ord(c) < 256]
    byte_of = {c: ord(c) for c in plain}
    rest = [x for x in range(256) if x not in byte_of.values()]
    byte_of |= {chr(256 + i): x for i, x in enumerate(rest)}

    def ends(tokens):
        out, at = [], 0
        for t in tokens:
            at += len(t)
            out.append(at)
        return out

    def run(text):
        if not text:
            return None
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            return None
        return ids_a, ids_b, ends(bytes_a), ends(bytes_b)
    return run


def plain(docs, whole):
    rows, links_of = [], []
    for d, t in docs:
        found = whole(t)
        if not found:
            rows.append((d, 0, 0, 0, []))
            links_of.append(("", []))
            continue
        ids_a, ids_b, ends_a, ends_b = found
        both = sorted(set(ends_a) & set(ends_b))
        other = dict(zip(ends_b, ids_b))
        links = [(x, other[e]) for x, e in zip(ids_a, ends_a) if e in other]
        groups, i, j = [], 0, 0
        for e in both:
            x, y = ends_a.index(e, i) + 1, ends_b.index(e, j) + 1
            groups.append(",".join(map(str, ids_a[i:x])) + "|" + ",".join(map(str, ids_b[j:y])))
            i, j = x, y
        rows.append((d, len(ids_a), len(ids_b), len(groups), links))
        links_of.append((hashlib.sha256(";".join(groups).encode()).hexdigest(), links))
    counts = Counter(p for *_, links in rows for p in links)
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return sorted(((d, n_a, n_b, n_g, len(ls), sum(counts[p] == best[p[1]] for p in ls), sum(counts[p] for p in ls), sha)
                   for (d, n_a, n_b, n_g, ls), (sha, _) in zip(rows, links_of)), key=repr)


ODD = ["", None, " ", "  ", "\n", "a", " a", "a ", "  two  spaces   three ", "tab\tand\nline\r\nend", "<|endoftext|> <s></s><unk> x<|endoftext|>",
       "▁ in ▁text", "ﬁ ligature é é Å", "日本語 と English 混ぜ", "emoji 👩‍👩‍👧 🏳️‍🌈 !", " nbsp ​zero", "it's we'll DON'T  can't", "1234567 89,01.5",
       "\x00 nul", "ñandú ÀÉ àé", "x" * 500, "a b " * 800]


def test_equals_whole_text_tokens(spark, whole):
    rnd = random.Random(4)
    letters = "abcdeéñ the ing ion 0123 ,.;!?\n\t　漢"
    docs = list(enumerate(ODD)) + [(100 + i, "".join(rnd.choice(letters) for _ in range(rnd.randint(1, 400)))) for i in range(150)]
    docs += [(None, "no id here"), (None, "no id here"), (7, " a"), (100, "repeated id, other text")]
    out = token_align.align_corpus(docs_of(spark, docs).repartition(5), A, B, {"sha": token_align.F.coalesce(token_align.F.sha2("groups", 256), token_align.F.lit(""))})
    assert rows_of(out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "sha")) == plain(docs, whole)


def test_query_on_given_documents(spark, whole):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(op13_token_align(spark, "/root/testdata/sf0.001")) == plain(docs, whole)


def test_memory_starts_anew(whole):
    """A small memory gives the same groups as a large one."""
    import numpy as np
    texts = [" " + t for t in ODD if t] * 2
    raw = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    buf = np.frombuffer(b"".join(raw), np.uint8)
    small, large = token_align.Aligner(A, B, limit=5), token_align.Aligner(A, B)
    expect = [r[:3] for r in large.align(buf, off)]
    assert [r[:3] for r in small.align(buf, off)] == expect
    for k in range(len(texts)):
        assert [r[:3] for r in small.align(buf[off[k]:off[k + 1]], off[k:k + 2] - off[k])] == expect[k:k + 1]


def test_shuffled_counts_and_empty_table(spark):
    docs = docs_of(spark, [(i, "the same words and " + str(i % 7)) for i in range(200)] + [(500, "▁")])
    from pyspark.sql import functions as F
    more = docs
    for c in ("row", "n_a", "pairs", "groups", "links"):
        more = more.withColumn(c, F.lit("x"))
    rows = token_align.saved(token_align.align(more, A, B), "t")
    assert rows_of(token_align.score_links(rows, broadcast_pairs=0)) == rows_of(token_align.score_links(rows))
    assert token_align.align_corpus(docs.limit(0), A, B).collect() == []
