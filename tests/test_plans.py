"""Plan shapes that matter at scale: pruning, pushdown, partial top-k,
broadcasts only of bounded sides, no nested-loop joins."""

from pyspark.sql import functions as F

import __spark_entry__ as E
from textlake.session import scratch_path
from textlake.sources.files import read_year_folders

from conftest import SMALL


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_reads_only_needed_columns(spark):
    p = plan(E.queries()["fn_char_byte_len"](spark, SMALL))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in p


def test_year_filter_prunes_partitions(spark):
    path = scratch_path(spark, "pp")
    d = spark.read.parquet(f"{SMALL}/documents.parquet")
    d.withColumn("year", (F.lit(1978) + F.pmod("doc_id", F.lit(47))).cast("int")) \
        .write.partitionBy("year").parquet(path)
    q = read_year_folders(spark, path, prefix="year=").where(F.col("year") == 1995).select("doc_id")
    p = plan(q)
    assert "PartitionFilters: [isnotnull(year" in p and "= 1995)" in p


def test_flagship_never_shuffles_the_corpus(spark):
    p = plan(E.queries()["rag_answer_contexts"](spark, SMALL))
    assert "NestedLoopJoin" not in p and "CartesianProduct" not in p
    assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p
    k = plan(E.queries()["join_topk_similarity"](spark, SMALL))
    assert "MapInArrow" in k and k.count("WindowGroupLimit") == 2  # partial + final top-k


def test_bm25_broadcasts_query_terms(spark):
    p = plan(E.queries()["rank_bm25_top10"](spark, SMALL))
    assert "NestedLoopJoin" not in p and "CartesianProduct" not in p
    assert "BroadcastHashJoin" in p


def test_no_registered_query_uses_a_cross_join(spark):
    # every query whose plan can be built without writing: no nested loops
    for name in ["join_topk_similarity", "flt_score_threshold", "rank_rerank_hits",
                 "rag_context_report", "agg_token_histogram", "qa_answer_spans",
                 "prompt_by_model", "win_batch_numbers", "fn_extractive_summary"]:
        p = plan(E.queries()[name](spark, SMALL))
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


def _exchanges(df):
    """Distinct shuffles of the initial plan, without broadcasts, scalar subqueries and reuse."""
    text = plan(df).split("== Initial Plan ==")[-1].split("Subquery")[0]
    return [x for x in text.splitlines() if "Exchange" in x and "Broadcast" not in x and "Reused" not in x]


def test_summary_shuffles_documents_once(spark):
    # both branches read the same exchange of documents (the second is reused when it runs)
    found = _exchanges(E.queries()["fn_extractive_summary"](spark, SMALL))
    assert found and all("hashpartitioning(_k" in x for x in found) and len(found) <= 2


def test_bm25_pairs_never_move(spark):
    p = plan(E.queries()["rank_bm25_top10"](spark, SMALL))
    # scores are summed where a document's postings are; only each task's best candidates are shuffled
    sums = [x for x in p.splitlines() if "Exchange hashpartitioning(query_id" in x]
    assert sums and all("doc_id" not in x for x in sums)
    assert "Partial" in "".join(x for x in p.splitlines() if "WindowGroupLimit" in x)


def test_spreading_starts_no_job(spark):
    from textlake.operators.partitioning import spread_small
    d = spark.read.parquet(f"{SMALL}/documents.parquet")
    plan_df = d.join(d.select("doc_id").where("doc_id > 5"), "doc_id", "left_anti").orderBy("doc_id")
    tracker, before = spark.sparkContext.statusTracker(), None
    spark.sparkContext.setJobGroup("spread", "spread")
    before = set(tracker.getJobIdsForGroup("spread"))
    out = spread_small(plan_df, "doc_id")
    assert set(tracker.getJobIdsForGroup("spread")) == before
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert out.count() == plan_df.count()


def test_a_cluster_needs_a_shared_folder():
    import pytest

    from textlake import session as S

    class Sc:
        master = "spark://host:7077"
        def getCheckpointDir(self): return None  # noqa: E704
        def getConf(self): return {}  # noqa: E704

    class Spark:
        sparkContext = Sc()
        conf = {}
    with pytest.raises(RuntimeError):
        S.ensure_checkpoint_dir(Spark())


def test_broadcast_bound_is_in_bytes(spark):
    from textlake.operators.joins import bounded_broadcast
    ids = spark.range(10)
    assert "ResolvedHint" in bounded_broadcast(ids, 1_000_000)._jdf.queryExecution().analyzed().toString()
    texts = ids.selectExpr("id", "cast(id as string) as t")
    assert "ResolvedHint" not in bounded_broadcast(texts, 1_000_000, text_bytes=4000)._jdf.queryExecution().analyzed().toString()
