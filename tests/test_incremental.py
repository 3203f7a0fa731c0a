"""Replay safety, resume from checkpoint, stream = batch."""

import random

from pyspark.sql import functions as F

from textlake.schemas import EVENTS
from textlake.sinks.tables import UpsertTable, append_new
from textlake.streaming.incremental import (assemble_deltas, deltas, resume_feed, upsert_feed)

from conftest import SMALL


ROWS = "text_id string, pos int, payload string"


def _state(table):
    rows = table.read().collect()
    assert len(rows) == len({r.text_id for r in rows})
    return {r.text_id: r.payload for r in rows}


def test_upsert_replay_and_late_batches(spark, tmp_path):
    t = UpsertTable(spark, str(tmp_path / "u"), ["text_id"], order="pos")
    b1 = spark.createDataFrame([("a", 1, "a1"), ("a", 2, "a2"), ("b", 1, "b1"), (None, 1, "n1")], ROWS)
    b2 = spark.createDataFrame([("b", 1, "b2"), ("c", 1, "c2")], ROWS)
    t.write_batch(b1)
    t.write_batch(b2)
    t.write_batch(b2)  # replayed batch
    want = {"a": "a2", "b": "b2", "c": "c2", None: "n1"}
    assert _state(t) == want
    t.write_batch(spark.createDataFrame([("a", 5, "a5"), ("c", 0, "late")], ROWS))
    assert _state(t) == {**want, "a": "a5"}  # a late row of a smaller order changes nothing
    t.write_batch(b1)  # an old batch of a restarted stream
    assert _state(t)["a"] == "a5"


def test_upsert_without_order_the_last_batch_wins(spark, tmp_path):
    t = UpsertTable(spark, str(tmp_path / "u"), ["text_id"], parts=3)
    t.write_batch(spark.createDataFrame([(str(i), i, "one") for i in range(50)], ROWS))
    t.write_batch(spark.createDataFrame([(str(i), i, "two") for i in range(40, 60)], ROWS))
    got = _state(t)
    assert len(got) == 60 and [got[str(i)] for i in (39, 40, 59)] == ["one", "two", "two"]


def test_upsert_touches_only_its_partitions(spark, tmp_path):
    path = tmp_path / "u"
    t = UpsertTable(spark, str(path), ["text_id"], parts=8)
    t.write_batch(spark.createDataFrame([(str(i), i, "x") for i in range(200)], ROWS))
    before = {f: f.stat().st_mtime_ns for f in path.glob("parts=8/key_part=*/*.parquet")}
    t.write_batch(spark.createDataFrame([("7", 1, "y")], ROWS))
    after = set(path.glob("parts=8/key_part=*/*.parquet"))
    changed = {f.parent.name for f in set(before) ^ after}
    assert len(changed) == 1 and t.read().count() == 200


def test_upsert_folders_follow_bytes(spark, tmp_path):
    path = tmp_path / "u"
    t = UpsertTable(spark, str(path), ["text_id"], parts=2, part_bytes=4_000)
    rows = [(str(i), i, f"{i * 2654435761 % 2**32:x}" * 20) for i in range(4000)]
    t.write_batch(spark.createDataFrame(rows, ROWS))
    parts = t.current_parts()
    assert parts >= 16 and [p.name for p in path.glob("parts=*")] == [f"parts={parts}"]
    assert t.read().count() == 4000
    before = {f: f.stat().st_mtime_ns for f in path.glob("parts=*/key_part=*/*.parquet")}
    t.write_batch(spark.createDataFrame([("7", 1, "y"), ("8", 1, "y"), ("new", 1, "y")], ROWS))
    after = set(path.glob("parts=*/key_part=*/*.parquet"))
    assert t.current_parts() == parts and len({f.parent.name for f in set(before) ^ after}) <= 3
    got = _state(t)
    assert len(got) == 4001 and [got[k] for k in ("7", "8", "new", "9")] == ["y", "y", "y", rows[9][2]]


def test_unfinished_growth_is_left_out(spark, tmp_path):
    t = UpsertTable(spark, str(tmp_path / "u"), ["text_id"], parts=4)
    t.write_batch(spark.createDataFrame([(str(i), i, "x") for i in range(20)], ROWS))
    spark.createDataFrame([("1", 1, "broken")], ROWS).write.parquet(str(tmp_path / "u" / "parts=8" / "key_part=1"))
    assert t.current_parts() == 4 and t.read().count() == 20
    t.write_batch(spark.createDataFrame([("1", 1, "y")], ROWS))
    assert t.read().count() == 20 and [p.name for p in (tmp_path / "u").glob("parts=*")] == ["parts=4"]


def test_append_new_is_exactly_once(spark, tmp_path):
    p = str(tmp_path / "a")
    df = spark.createDataFrame([(i, i % 3) for i in range(20)], "k long, v long")
    append_new(df.where("k < 10"), p, ["k"])
    append_new(df, p, ["k"])
    append_new(df, p, ["k"])
    out = spark.read.parquet(p)
    assert out.count() == 20 and out.select("k").distinct().count() == 20


def test_append_new_repeats_and_null_keys(spark, tmp_path):
    p = str(tmp_path / "a")
    df = spark.createDataFrame([(1, "x"), (1, "x"), (None, "x"), (None, "y")], "k long, v string")
    append_new(df, p, ["k"])
    append_new(df, p, ["k"])
    assert sorted((r.k is None, r.k) for r in spark.read.parquet(p).collect()) == [(False, 1), (True, None)]


def test_append_new_reads_only_touched_partitions(spark, tmp_path):
    p = str(tmp_path / "a")
    df = spark.createDataFrame([(i, f"d{i // 10}") for i in range(50)], "k long, day string")
    append_new(df.where("k < 45"), p, ["k"], ["day"])
    # a broken file in an untouched partition does no harm
    (tmp_path / "a" / "day=d0" / "part-broken.parquet").write_bytes(b"no parquet")
    append_new(df.where("k >= 40"), p, ["k"], ["day"])
    assert spark.read.parquet(p + "/day=d4").count() == 10


def _land_unordered(spark, events, src, n_files=4, dup=50, seed=7):
    """Events split into files in random order, with planted duplicates."""
    rows = events.collect()
    rnd = random.Random(seed)
    rnd.shuffle(rows)
    rows += rnd.sample(rows, dup)
    size = len(rows) // n_files + 1
    for i in range(n_files):
        part = rows[i * size:(i + 1) * size]
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(src)


def test_resume_feed_matches_batch_and_restarts(spark, tmp_path):
    ev = spark.read.parquet(f"{SMALL}/events.parquet")
    src, sink, ck = str(tmp_path / "src"), str(tmp_path / "sink"), str(tmp_path / "ck")
    _land_unordered(spark, ev.where("ts < '2024-01-20'"), src)
    q = resume_feed(spark, src, EVENTS, sink, ck, ["event_id"], max_files=1)
    q.awaitTermination(300)
    first = spark.read.parquet(sink)
    assert first.count() == ev.where("ts < '2024-01-20'").count()
    # restart with nothing new: no change
    q = resume_feed(spark, src, EVENTS, sink, ck, ["event_id"], max_files=1)
    q.awaitTermination(300)
    assert spark.read.parquet(sink).count() == first.count()
    # new files (overlapping the old ones) arrive: only new keys are appended
    _land_unordered(spark, ev.where("ts >= '2024-01-15'"), src, n_files=2, seed=9)
    q = resume_feed(spark, src, EVENTS, sink, ck, ["event_id"], max_files=1)
    q.awaitTermination(300)
    out = spark.read.parquet(sink)
    assert out.count() == ev.count() and out.select("event_id").distinct().count() == ev.count()


def test_upsert_feed_latest_per_key(spark, tmp_path):
    ev = spark.read.parquet(f"{SMALL}/events.parquet")
    src, ck = str(tmp_path / "src"), str(tmp_path / "ck")
    # time-ordered files so that batch order equals time order
    days = sorted({r[0] for r in ev.select(F.to_date("ts").cast("string")).distinct().collect()})
    for d in days[::7]:
        ev.where(F.to_date("ts") >= F.lit(d)).where(F.to_date("ts") < F.date_add(F.lit(d), 7)) \
            .coalesce(1).write.mode("append").parquet(src)
    table = UpsertTable(spark, str(tmp_path / "t"), ["user_id"], order="ts")
    q = upsert_feed(spark, src, EVENTS, table, ck, max_files=1)
    q.awaitTermination(300)
    got = {r.user_id: r.event_id for r in table.read().select("user_id", "event_id").collect()}
    latest = ev.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("e"))
    assert got == {r.user_id: r.e for r in latest.collect()}


def test_stream_deltas_equal_batch(spark, tmp_path):
    conv = spark.read.parquet(f"{SMALL}/conversations.parquet").where("role = 'assistant'")
    d = deltas(conv, "text", ["conv_id", "turn"])
    src = str(tmp_path / "deltas")
    d.repartition(3).write.parquet(src)
    stream = spark.readStream.schema(d.schema).parquet(src)
    q = (assemble_deltas(stream, ["conv_id", "turn"]).writeStream.outputMode("complete")
         .format("memory").queryName("assembled_deltas").start())
    q.processAllAvailable()
    q.stop()
    got = {(r.conv_id, r.turn): r.message for r in spark.table("assembled_deltas").collect()}
    want = {(r.conv_id, r.turn): r.message for r in assemble_deltas(d, ["conv_id", "turn"]).collect()}
    assert got == want
    orig = {(r.conv_id, r.turn): r.text for r in conv.collect()}
    assert all(orig[k] == v for k, v in got.items())


def test_word_windows_on_a_stream(spark, tmp_path):
    from textlake.operators.chunking import explode_chunks, with_word_windows
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    src = str(tmp_path / "docs")
    docs.write.parquet(src)
    stream = spark.readStream.schema(docs.schema).parquet(src)
    chunks = explode_chunks(with_word_windows(stream, "text", 50), F.col("windows"), "doc_id", ["doc_id"])
    q = chunks.writeStream.format("memory").queryName("stream_windows").start()
    q.processAllAvailable()
    q.stop()
    batch = explode_chunks(with_word_windows(docs, "text", 50), F.col("windows"), "doc_id", ["doc_id"])
    assert spark.table("stream_windows").count() == batch.count()


def test_rounds_left_and_next_window(spark):
    from textlake.streaming.incremental import next_window, rounds_left
    marks = spark.createDataFrame([("a", "05/03/2021", 4), ("b", "01/01/2020", 99)], "source string, date string, round long")
    out = {r.source: r for r in next_window(rounds_left(marks, 10)).collect()}
    assert (out["a"].rounds_left, out["a"].window_start, out["a"].window_end) == (5, "01/01/2021", "05/03/2021")
    assert out["b"].rounds_left == 0


def test_upsert_feed_restarted_from_nothing(spark, tmp_path):
    """A lost checkpoint reads all files again, in one batch: the table stays as it was."""
    ev = spark.read.parquet(f"{SMALL}/events.parquet")
    src = str(tmp_path / "src")
    _land_unordered(spark, ev, src)
    table = UpsertTable(spark, str(tmp_path / "t"), ["user_id"], order="ts")
    for ck, files in (("a", 1), ("b", None)):
        upsert_feed(spark, src, EVENTS, table, str(tmp_path / ck), max_files=files).awaitTermination(300)
        got = {r.user_id: r.ts for r in table.read().select("user_id", "ts").collect()}
        assert got == {r.user_id: r.ts for r in ev.groupBy("user_id").agg(F.max("ts").alias("ts")).collect()}


def test_replayed_batch_is_written_without_merging(spark, tmp_path, monkeypatch):
    """Only keys are compared when a batch replaces all that its partitions hold; other batches are merged."""
    table = UpsertTable(spark, str(tmp_path / "t"), ["text_id"], parts=4)
    widths = []
    from textlake.sinks import tables
    real = tables.materialize
    monkeypatch.setattr(tables, "materialize", lambda df: widths.append(len(df.columns)) or real(df))
    rows = [(str(i), i, "x" * 50) for i in range(40)] + [(None, -1, "null key")]
    full = spark.createDataFrame(rows, "text_id string, n long, body string")
    table.write_batch(full)
    table.write_batch(full.withColumn("n", F.col("n") + 100))
    assert widths == [2, 2]  # the keys and their partition, never the rows
    got = lambda: sorted((str(r.text_id), r.n, r.body) for r in table.read().collect())
    assert got() == sorted((str(k), n + 100, b) for k, n, b in rows)
    # no body in the batch: the column stays, empty
    table.write_batch(full.select("text_id", "n"))
    assert got() == sorted(((str(k), n, None) for k, n, _ in rows), key=lambda r: r[:2])
    # a part of the keys, and a key twice: merged
    table.write_batch(full.where("n >= 30").unionAll(full.where("n = 31")))
    table.write_batch(spark.createDataFrame([("new", 7, "b")], full.schema))
    assert {k: b for k, _, b in got()} == {**{str(k): b if n >= 30 else None for k, n, b in rows}, "new": "b"}
    assert len(got()) == 42
