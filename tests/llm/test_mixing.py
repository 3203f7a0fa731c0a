from collections import Counter

import pytest

from helpers import docs_of
from textlake.llm import mixing as M


def test_exponent_meets_repetition_limit_and_entropy():
    tokens = {"a": 1_000_000, "b": 50_000, "c": 20_000}
    x = M.solve_exponent(tokens, max_repeat=2.0)
    times = M.passes(tokens, M.temperature_weights(tokens, x))
    assert min(times.values()) == pytest.approx(1) and max(times.values()) == pytest.approx(2, abs=1e-6)
    x = M.solve_exponent(tokens, target_entropy=0.7)
    assert M.entropy(M.temperature_weights(tokens, x)) == pytest.approx(0.7, abs=1e-6)
    assert M.solve_exponent({"a": 5}, max_repeat=2.0) == 0.0
    assert M.solve_exponent(tokens, max_repeat=1e9) == 0.0


def fixture(n=400):
    return [(i, "w " * (1 + i % 13), ["big", "big", "big", "mid", "tiny"][i % 5] if i % 50 else "rare") for i in range(n)]


def test_weights_are_realised(spark):
    rows = fixture()
    out = M.mixture(docs_of(spark, rows), max_repeat=3.0, block_docs=20)
    got = out.collect()
    assert len(got) == len(rows) and min(r["copies"] for r in got) >= 1 and max(r["copies"] for r in got) <= 3
    tokens, mixed, most = Counter(), Counter(), Counter()
    for r in got:
        tokens[r["source"]] += r["n_tokens"]
        mixed[r["source"]] += r["n_tokens"] * r["copies"]
        most[r["source"]] = max(most[r["source"]], r["n_tokens"])
    times = M.passes(tokens, M.temperature_weights(tokens, M.solve_exponent(tokens, 3.0)))
    for s in tokens:
        assert abs(mixed[s] - times[s] * tokens[s]) <= most[s] + 1
    assert sorted(map(tuple, got)) == sorted(map(tuple, M.mixture(docs_of(spark, rows[::-1]).repartition(7), max_repeat=3.0, block_docs=20).collect()))


def test_budget_cuts_whole_blocks_first(spark):
    rows = [(i, "a b c d", "s") for i in range(100)]
    got = M.mixture(docs_of(spark, rows), max_repeat=None, budget=200, block_docs=10).collect()
    assert sum(r["copies"] for r in got) == 50
    by = {}
    for r in got:
        by.setdefault(r["block"], []).append(r["copies"])
    assert sum(0 < sum(x) < len(x) for x in by.values()) <= 1


def test_mixture_rows_and_order(spark):
    df = docs_of(spark, fixture(100))
    out = M.mix(df, block_docs=10)
    plan = {r["doc_id"]: r["copies"] for r in M.mixture(df, block_docs=10).collect()}
    assert out.columns == [*df.columns, "mix"]
    assert Counter(r["doc_id"] for r in out.collect()) == Counter(plan)
    order = [(r["mix"]["pass_no"], r["mix"]["block"], r["source"]) for r in out.orderBy("mix").collect()]
    blocks = [k for i, k in enumerate(order) if i == 0 or order[i - 1] != k]
    assert len(blocks) == len(set(blocks))  # a block's documents stand together
    assert [p for p, *_ in order] == sorted(p for p, *_ in order)


def test_nulls_repeats_and_empty_table(spark):
    rows = [(1, None, None), (2, "", None), (3, "a b", "s"), (3, "a b", "s"), (None, "a", "s"), (4, "x " * 50000, "t")]
    out = M.mix(docs_of(spark, rows), max_repeat=1.0)
    assert out.count() == len(rows)
    assert M.mix(docs_of(spark, rows).limit(0)).count() == 0
