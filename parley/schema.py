"""Pinned schemas. Nothing in the library infers a schema.

``ts`` is TIMESTAMP_NTZ holding UTC wall time, so hours, days and weeks are
UTC whatever the session time zone of the cluster is.
"""

from pyspark.sql import types as T

RAW = T.StructType(
    [
        T.StructField("type", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("displayName", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
        T.StructField("username", T.StringType()),
        T.StructField("channel", T.StringType()),
        T.StructField("raw", T.StringType()),
    ]
)
#: Raw records with a place for lines that are none.
RAW_OR_CORRUPT = T.StructType([*RAW.fields, T.StructField("_corrupt_record", T.StringType())])
RAW_ENVELOPE = T.StructType([T.StructField("messages", T.ArrayType(RAW))])

MESSAGES = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("username", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("emotes_tag", T.StringType()),
        T.StructField("role", T.StringType()),
        T.StructField("channel", T.StringType()),
    ]
)

COVERAGE = T.StructType(
    [
        T.StructField("channel_key", T.StringType()),
        T.StructField("year_month", T.StringType()),
        T.StructField("cov_from", T.TimestampNTZType()),
        T.StructField("cov_to", T.TimestampNTZType()),
        T.StructField("truncated", T.BooleanType()),
        T.StructField("fetched_at", T.TimestampNTZType()),
    ]
)

CATALOG = T.StructType(
    [
        T.StructField("channel", T.StringType()),
        T.StructField("provider", T.StringType()),
        T.StructField("emote_id", T.StringType()),
        T.StructField("name", T.StringType()),
    ]
)
