"""Column layouts of the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T

# One row per content block.
BRONZE = T.StructType(
    [
        T.StructField("_id", T.StringType(), False),
        T.StructField("type", T.StringType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("project_id", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("ingested_at", T.TimestampType()),
        T.StructField("extracted_at", T.TimestampType()),
        T.StructField("message_role", T.StringType()),
        T.StructField("message_content", T.StringType()),
        T.StructField("message_raw", T.StringType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("tool_name", T.StringType()),
        T.StructField("tool_id", T.StringType()),
        T.StructField("tool_use_id", T.StringType()),
    ]
)

# Document id and position of the block in it; they make the order of blocks that
# share one timestamp definite.
BLOCK_POSITION = T.StructType(
    [T.StructField("doc_id", T.StringType()), T.StructField("block_index", T.IntegerType())]
)

# One log line, as delivered.
DOCUMENT = T.StructType(
    [
        T.StructField("_id", T.StringType(), False),
        T.StructField("type", T.StringType()),
        T.StructField("sessionId", T.StringType()),
        T.StructField("projectId", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("ingestedAt", T.TimestampType()),
        T.StructField("sourceFile", T.StringType()),
        T.StructField("entry", T.StringType()),
    ]
)

TOOL_CATEGORIES = T.StructType(
    [
        T.StructField("tool_name", T.StringType()),
        T.StructField("tool_category", T.StringType()),
        T.StructField("description", T.StringType()),
    ]
)
