"""Incremental and streaming patterns.

* J1 -- resume a day feed: a file-source stream with a checkpoint; each
  micro-batch is appended exactly once (key anti join in ``foreachBatch``).
  ``trigger(availableNow=True)`` drains the backlog and stops (backfill).
* J2 -- per-group resume / skip-if-done: ``foreachBatch`` into an
  :class:`UpsertTable`; a merged batch merges again without effect, so
  neither a replayed batch nor a new checkpoint makes duplicates, and with
  the table's order column late batches never undo newer rows.
* J3 -- backward cursor: the next window ends at the earliest date seen
  per source; marks are a small versioned table.
* J4 -- token deltas: empty deltas dropped, ordered assembly per message.

Deduplication inside the stream: without a watermark Spark keeps every key
in state (bounded backfills only); for an endless feed use
``withWatermark`` + ``dropDuplicatesWithinWatermark`` on time-ordered
input with a delay at least the file disorder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from textlake.sinks.tables import UpsertTable, append_new

# A word with its trailing blanks, or a run of blanks (explicit class: the
# same text in Java and RE2).
DELTA_PATTERN = "[^ \\t\\n\\r]+[ \\t\\n\\r]*|[ \\t\\n\\r]+"


def feed_stream(spark: SparkSession, source_dir: str, schema: T.StructType,
                max_files: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).format("parquet")
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(source_dir)


def resume_feed(spark: SparkSession, source_dir: str, schema: T.StructType, sink_path: str,
                checkpoint: str, key: list[str], partition_by: list[str] | None = None,
                max_files: int | None = None, dedup_watermark: tuple[str, str] | None = None
                ) -> StreamingQuery:
    """Append every new key once; restartable from ``checkpoint``."""
    s = feed_stream(spark, source_dir, schema, max_files)
    if dedup_watermark:
        col, delay = dedup_watermark
        wm = col
        if isinstance(schema[col].dataType, T.TimestampNTZType):
            # watermarks need an instant: read the zone-less wall clock as UTC
            # (independent of the session time zone)
            epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
            s = s.withColumn("_event_time", F.timestamp_micros(
                F.timestamp_diff("MICROSECOND", epoch, F.col(col))))
            wm = "_event_time"
        s = s.withWatermark(wm, delay).dropDuplicatesWithinWatermark(key)
        if wm != col:
            s = s.drop(wm)

    def sink(batch: DataFrame, batch_id: int) -> None:
        append_new(batch, sink_path, key, partition_by)

    return (s.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())


def upsert_feed(spark: SparkSession, source_dir: str, schema: T.StructType, table: UpsertTable,
                checkpoint: str, max_files: int | None = None) -> StreamingQuery:
    """Each micro-batch becomes one upsert batch (replay-safe)."""
    s = feed_stream(spark, source_dir, schema, max_files)

    def sink(batch: DataFrame, batch_id: int) -> None:
        table.write_batch(batch)

    return (s.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())


def next_cursor(seen: DataFrame, source: str, date: Column, marks: DataFrame | None = None) -> DataFrame:
    """Per source, the earliest date seen becomes the next end date
    (dd/MM/yyyy); ``round`` is the 0-based index of the last round run, so
    it continues from the previous mark (or starts at 0)."""
    cur = seen.groupBy(source).agg(F.min(date).alias("end_date"),
                                   F.count_distinct(date).alias("rounds"))
    prev = F.lit(-1)
    if marks is not None:
        cur = cur.join(marks.select(source, F.col("round").alias("_prev")), source, "left")
        prev = F.coalesce(F.col("_prev"), F.lit(-1))
    return cur.select(source, F.date_format("end_date", "dd/MM/yyyy").alias("date"),
                      (prev + F.col("rounds")).cast("long").alias("round"))


def rounds_left(marks: DataFrame, num_searches: int) -> DataFrame:
    """Rounds still to run per source, ``num_searches - (last round + 1)``, never below 0."""
    return marks.withColumn("rounds_left", F.greatest(F.lit(num_searches) - (F.col("round") + 1), F.lit(0)).cast("long"))


def next_window(marks: DataFrame) -> DataFrame:
    """Bounds of each source's next search (dd/MM/yyyy): from the first
    day of the mark's year to the mark, both included."""
    return marks.withColumn("window_start", F.concat(F.lit("01/01/"), F.substring("date", 7, 4))) \
        .withColumn("window_end", F.col("date"))


def deltas(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """Split messages into streamed pieces: each word with its trailing space."""
    return df.select(*keys, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(DELTA_PATTERN), 0))
                     .alias("seq", "delta"))


def assemble_deltas(d: DataFrame, keys: list[str]) -> DataFrame:
    """Drop empty deltas, then concatenate in ``seq`` order.

    Works on a batch or a streaming DataFrame (update / complete mode).
    """
    kept = d.where(F.length("delta") > 0)
    arr = F.array_sort(F.collect_list(F.struct("seq", "delta")))
    return kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_deltas"),
                                   F.array_join(F.transform(arr, lambda x: x["delta"]), "").alias("message"))
