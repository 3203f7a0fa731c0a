"""Declared schemas: every read names its schema, nothing is inferred."""

from pyspark.sql import types as T

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])

PAGES = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
])

EMBEDDINGS = T.StructType([
    T.StructField("vec_id", T.LongType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("label", T.IntegerType()),
])

CONVERSATIONS = T.StructType([
    T.StructField("conv_id", T.LongType()),
    T.StructField("turn", T.LongType()),
    T.StructField("role", T.StringType()),
    T.StructField("text", T.StringType()),
])

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()),
    # stored without a zone (isAdjustedToUTC=false): read as TIMESTAMP_NTZ so
    # results never depend on the session time zone
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])

BENCHMARK = T.StructType([
    T.StructField("item_id", T.LongType()),
    T.StructField("text", T.StringType()),
])

LABELS = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("quality", T.IntegerType()),
    T.StructField("toxic", T.IntegerType()),
])

ORDERS = T.StructType([
    T.StructField("o_orderkey", T.LongType()),
    T.StructField("o_custkey", T.LongType()),
    T.StructField("o_orderstatus", T.StringType()),
    T.StructField("o_totalprice", T.DoubleType()),
    T.StructField("o_orderdate", T.TimestampNTZType()),
    T.StructField("o_orderpriority", T.StringType()),
])

TABLES = {
    "documents": DOCUMENTS,
    "pages": PAGES,
    "embeddings": EMBEDDINGS,
    "conversations": CONVERSATIONS,
    "events": EVENTS,
    "benchmark": BENCHMARK,
    "labels": LABELS,
    "orders": ORDERS,
}

QA_EXAMPLE = T.StructType([
    T.StructField("question", T.StringType()),
    T.StructField("context", T.StringType()),
    T.StructField("answers", T.StructType([
        T.StructField("answer_start", T.IntegerType()),
        T.StructField("text", T.StringType()),
    ])),
])
