"""P1 / P2 / P3 on gazette-shaped fixtures; A5, A12, B7."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from textlake.functions.dates import calendar_rows
from textlake.params import Params
from textlake.plans.corpus import (build_documents, build_index, chunk_corpus, fetch_outcomes,
                                   format_corpus, success_marks)
from textlake.plans.qa import answer_spans
from textlake.schemas import QA_EXAMPLE
from textlake.sinks.tables import overwrite_checked
from textlake.sources.files import read_many, resolve_paths


def _item(title, url):
    t = f"<titulo>{title}</titulo>" if title is not None else ""
    u = f"<urlxml>{url}</urlxml>" if url is not None else ""
    return f"<item>{t}{u}</item>"


DAYS = [
    ("20240101", 200, "<sumario>" + _item("Ley uno", "/diario_boe/xml.php?id=BOE-A-2024-1")
     + _item("Anuncio", "/diario_boe/xml.php?id=BOE-B-2024-2")
     + _item("Orden de protección", "/diario_boe/xml.php?id=BOE-C-2024-3")
     + _item("Sin url", None) + _item("Corta", "/x") + "</sumario>"),
    ("20240102", 404, "<html>not found</html>"),
    ("20240103", 200, "<sumario>" + _item("Ley dos", "/diario_boe/xml.php?id=BOE-A-2024-4") + "</sumario>"),
    ("20240105", 200, "<sumario>" + _item(None, "/diario_boe/xml.php?id=BOE-A-2024-5") + "</sumario>"),
]


def _calendar(spark):
    span = spark.createDataFrame([(dt.date(2024, 1, 1), dt.date(2024, 1, 7))], "a date, b date")
    return calendar_rows(span, "a", "b")


def test_calendar_skips_sundays(spark):
    days = [r.day for r in _calendar(spark).collect()]
    assert dt.date(2024, 1, 7) not in days and len(days) == 6  # 7 Jan 2024 is a Sunday


def test_build_index(spark):
    landed = spark.createDataFrame(DAYS, "day_id string, status int, body string")
    idx = build_index(_calendar(spark), landed, Params())
    got = sorted((r.day_id, r.url, r.title) for r in idx.collect())
    root = "https://www.boe.es/diario_boe/xml.php?id="
    assert got == [("20240101", root + "BOE-A-2024-1", "Ley uno"),
                   ("20240101", root + "BOE-C-2024-3", "Orden de protección"),
                   ("20240103", root + "BOE-A-2024-4", "Ley dos"),
                   ("20240105", root + "BOE-A-2024-5", None)]
    # after a mark the earlier days are skipped; the first run keeps its start day
    later = build_index(_calendar(spark), landed, Params(), mark="20240101")
    assert {r.day_id for r in later.collect()} == {"20240103", "20240105"}


DOC = ("<documento><metadatos><titulo>{t}</titulo><departamento>Jefatura</departamento>"
       "<rango>Ley</rango><origen_legislativo>Estatal</origen_legislativo></metadatos>"
       "<texto><p>Artículo 1.</p><p>{body}</p></texto></documento>")


def test_build_documents_and_format(spark):
    root = "https://www.boe.es/diario_boe/xml.php?id="
    index = spark.createDataFrame([
        ("20240101", root + "BOE-A-2024-1", "Ley uno"),
        ("20240101", root + "BOE-C-2024-1", "Orden de protección"),  # same number, other class
        ("20240103", root + "BOE-A-2024-4", "Ley dos"),
        ("20240103", root + "BOE-A-2024-9", "Falla"),
        ("20240104", root + "BOE-A-2024-7", None),
    ], "day_id string, url string, title string")
    landed = spark.createDataFrame([
        (root + "BOE-A-2024-1", 200, DOC.format(t="Ley uno", body="Texto uno")),
        (root + "BOE-C-2024-1", 200, DOC.format(t="Orden", body="Texto C")),
        (root + "BOE-A-2024-4", 200, DOC.format(t="Ley dos", body="Texto dos")),
        (root + "BOE-A-2024-9", 500, "error"),
    ], "url string, status int, body string")
    done = spark.createDataFrame([("A", "2024", 1)], "cls string, year string, n long")
    docs = build_documents(index, landed, done, Params())
    got = {r.doc_key: r for r in docs.collect()}
    # class A number 1 is done; class C number 1 is not (marks per class and year)
    assert set(got) == {"C-2024-1", "A-2024-4", "A-2024-9"}
    assert got["A-2024-4"].text == "Artículo 1.Texto dos" and got["A-2024-4"].rang == "Ley"
    assert got["A-2024-9"].text is None  # failed fetch: NULL fields, not a failed job
    kw = build_documents(index, landed, None, Params(keywords=("proteccion",), full_extraction=False))
    assert [r.doc_key for r in kw.collect()] == ["C-2024-1"]
    ok, retry = fetch_outcomes(docs)
    assert [r.doc_key for r in retry.collect()] == ["A-2024-9"]  # kept for a retry, not stored as NULLs
    marks = {(r.cls, r.year): r.n for r in success_marks(ok).collect()}
    assert marks == {("C", "2024"): 1, ("A", "2024"): 4}  # the failed number 9 does not move the mark
    corpus = format_corpus(docs)
    assert corpus.columns == ["doc_key", "url", "title", "date", "legislative_origin", "department",
                              "rang", "text"]
    assert [r.doc_key for r in corpus.collect()] == ["C-2024-1", "A-2024-4", "A-2024-9"]
    chunks = chunk_corpus(corpus, None, Params(chunk_size=12, chunk_overlap=4), prefix_title=True)
    assert chunks.where(F.col("doc_key") == "A-2024-9").count() == 0  # no text, no chunks
    assert all(r.text_id.startswith(r.doc_key + "_chunk") for r in chunks.collect())


def test_resolve_paths_and_read_many(spark, tmp_path):
    local, remote = tmp_path / "local", tmp_path / "remote"
    df = spark.createDataFrame([(1, "a")], "id long, v string")
    df.write.parquet(str(local / "one.parquet"))
    df.write.parquet(str(remote / "two.parquet"))
    paths, missing = resolve_paths(spark, ["one.parquet", "two.parquet", "three.parquet"],
                                   str(local), str(remote))
    assert paths[0].startswith(str(local)) and paths[1].startswith(str(remote))
    assert missing == ["three.parquet"]  # reported and skipped, not fatal
    assert read_many(spark, paths, df.schema).count() == 2


def test_overwrite_checked_rejects_wrong_dimension(spark, tmp_path):
    good = spark.createDataFrame([(1, [0.1, 0.2])], "id long, e array<float>")
    overwrite_checked(good, str(tmp_path / "v"), "e", 2)
    assert spark.read.parquet(str(tmp_path / "v")).count() == 1
    bad = spark.createDataFrame([(1, [0.1, 0.2]), (2, [0.1])], "id long, e array<float>")
    with pytest.raises(Exception):
        overwrite_checked(bad, str(tmp_path / "w"), "e", 2)


def test_inline_nested_qa_dataset(spark):
    rows = [("¿Qué ley?", "La Ley Orgánica 1/1982 protege el honor", {"answer_start": 3, "text": "Ley Orgánica"})]
    ds = spark.createDataFrame(rows, QA_EXAMPLE)
    flat = ds.select(F.monotonically_increasing_id().alias("k"), "question", "context",
                     F.col("answers.answer_start").alias("answer_start"),
                     F.col("answers.text").alias("answer_text"))
    r = answer_spans(flat, ["k"]).collect()[0]
    assert (r.start_token, r.end_token) == (1, 2)


def test_build_index_entities_and_malformed_day(spark):
    landed = spark.createDataFrame([
        ("20240101", 200, "<sumario>" + _item("Ley &amp; orden", "/diario_boe/xml.php?id=BOE-A-2024-1") + "</sumario>"),
        ("20240102", 200, "<sumario><item><titulo>roto"),  # malformed: that day only
        ("20240103", 200, "<sumario>" + _item("Ley dos", "/diario_boe/xml.php?id=BOE-A-2024-4") + "</sumario>"),
    ], "day_id string, status int, body string")
    got = sorted((r.day_id, r.title) for r in build_index(_calendar(spark), landed, Params()).collect())
    assert got == [("20240101", "Ley & orden"), ("20240103", "Ley dos")]


def test_build_index_finds_nested_items(spark):
    nested = "<sumario><seccion n='1'><departamento>" + _item("Ley", "/diario_boe/xml.php?id=BOE-A-2024-1") + \
        "<item id='x'><titulo>roto</item></departamento></seccion>" + _item("Orden", "/diario_boe/xml.php?id=BOE-C-2024-2") + "</sumario>"
    landed = spark.createDataFrame([("20240101", 500, "error"), ("20240101", 200, nested)], "day_id string, status int, body string")
    got = sorted((r.day_id, r.title) for r in build_index(_calendar(spark), landed, Params()).collect())
    assert got == [("20240101", "Ley"), ("20240101", "Orden")]  # the broken item is lost alone


def test_documents_landed_twice_count_once(spark):
    url = "https://www.boe.es/diario_boe/xml.php?id=BOE-A-2024-1"
    index = spark.createDataFrame([("20240101", url, "Ley")], "day_id string, url string, title string")
    landed = spark.createDataFrame([(url, 500, "e", 3), (url, 200, DOC.format(t="a", body="old"), 1), (url, 200, DOC.format(t="a", body="new"), 2)],
                                   "url string, status int, body string, landed_at int")
    docs = build_documents(index, landed, None).collect()
    assert len(docs) == 1 and docs[0].text.endswith("new")


def test_boe_year_folders(spark, tmp_path):
    from textlake.sources.files import read_year_folders
    for y in (1995, 2001):
        spark.createDataFrame([(y, i) for i in range(3)], "y int, i int").write.parquet(str(tmp_path / f"boe_{y}"))
    spark.createDataFrame([(0, 0)], "y int, i int").write.parquet(str(tmp_path / "other_2001"))
    out = read_year_folders(spark, str(tmp_path))
    assert sorted((r.year, r.y) for r in out.collect()) == [(1995, 1995)] * 3 + [(2001, 2001)] * 3


def test_failed_documents_are_drained(spark, tmp_path):
    from textlake.plans.ingest import ingest_documents
    from textlake.sinks.tables import read_marks
    root = "https://www.boe.es/diario_boe/xml.php?id=BOE-A-2024-"
    index = spark.createDataFrame([("20240101", f"{root}{n}", "t") for n in range(1, 6)], "day_id string, url string, title string")

    def landed(bad):
        return spark.createDataFrame([(f"{root}{n}", 500 if n in bad else 200, DOC.format(t="t", body=str(n))) for n in range(1, 6)],
                                     "url string, status int, body string")
    state = str(tmp_path / "s")
    left = []
    for bad in ((3, 5), (3,), ()):
        ingest_documents(index, landed(bad), state)
        keys = [r.doc_key for r in spark.read.parquet(state + "/documents").collect()]
        assert len(keys) == len(set(keys))
        left.append((len(keys), sorted(r.doc_key for r in read_marks(spark, state + "/retry").collect())))
    assert left == [(3, ["A-2024-3", "A-2024-5"]), (4, ["A-2024-3"]), (5, [])]
