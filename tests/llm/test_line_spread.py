import random

from helpers import docs_of, rows_of, words
from textlake.llm.line_spread import boilerplate_lines, explode_lines, remove_boilerplate


def brute(rows, min_sites):
    sites = {}
    for _, t, s in rows:
        for line in (t or "").split("\n") if t is not None else []:
            if words(line) and s is not None:
                sites.setdefault(line, set()).add(s)
    bad = {x for x, s in sites.items() if len(s) >= min_sites}
    out = []
    for d, t, _ in rows:
        lines = t.split("\n") if t is not None else []
        out.append((d, sum(bool(words(x)) for x in lines), sum(x in bad for x in lines),
                    None if t is None else "\n".join(x for x in lines if x not in bad)))
    return sorted(out, key=repr)


def fixture():
    rng = random.Random(4)
    rows = []
    for i in range(300):
        lines = [f"line {rng.randrange(400)}" for _ in range(rng.randrange(6))] + [f"common {i % k}" for k in (2, 9, 40)] + ["", "footer"]
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines), f"site{rng.randrange(30)}" if i % 3 else "hot"))
    return rows + [(900, None, "a"), (901, "", "b"), (902, "footer", None), (None, "footer\nown", "c"), (903, "\n\n", "c")] + rows[:3]


def test_matches_brute_force(spark):
    rows = fixture()
    for least in (3, 8, 20):
        assert rows_of(remove_boilerplate(docs_of(spark, rows), min_sites=least)) == brute(rows, least)


def test_counts_near_the_threshold_are_exact(spark):
    rows = [(100 * n + i, f"on {n} sites", f"s{i}") for n in range(1, 60) for i in range(n)]
    df = docs_of(spark, rows).withColumnRenamed("doc_id", "key")
    bad = boilerplate_lines(explode_lines(df, "source", "text", "key"), 40)
    assert bad.count() == 20 and bad.where("sites = 40").count() == 1


def test_empty_table(spark):
    assert remove_boilerplate(docs_of(spark, [(1, "a")]).limit(0)).count() == 0
