import corpus_pipeline as P
from textlake.llm.queries import QUERIES, read

from conftest import SMALL


def test_stages_and_result(spark):
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_frames"]
    docs = first = read(spark, SMALL, "documents")
    counts = []
    for name, stage in P.STAGES:
        docs = P.saved(stage(spark, docs, SMALL), f"test-{name}")
        counts.append(docs.count())
        if name != "token_frames":
            assert docs.columns == first.columns and dict(docs.dtypes) == dict(first.dtypes)
    assert first.count() >= counts[0] >= counts[1] >= counts[2] <= counts[3] == counts[4]
    assert P.run(spark, SMALL).orderBy("start").collect() == docs.orderBy("start").collect()


def test_stages_on_an_empty_table(spark):
    docs = read(spark, SMALL, "documents").limit(0)
    for name, stage in P.STAGES:
        docs = P.saved(stage(spark, docs, SMALL), f"empty-{name}")
    assert docs.count() == 0


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
