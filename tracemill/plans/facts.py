"""Fact tables and their session and tool keys.

A session key is the hash of the session id, so it needs no lookup: every session of a
fact row has a row in the session dimension. What the lookup does change is the row
count, because a session that occurs in several projects matches several dimension
rows. `session_fanout` lists just those sessions; joining with that short list replaces
a shuffle of the facts with the whole session dimension. Stored as a table, the list is
broadcast by Spark whenever its size is under the broadcast threshold and shuffled
(with skew handling) otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.functions import expressions as x


def session_fanout(rollup: DataFrame) -> DataFrame:
    """Sessions that occur in more than one project (no project counts as one)."""
    return (
        rollup.where(F.col("session_id").isNotNull())
        .groupBy("session_id", "project_id")
        .agg(F.lit(1).alias("one"))
        .groupBy("session_id")
        .agg(F.count("one").cast("int").alias("dimension_rows"))
        .where(F.col("dimension_rows") > 1)
    )


def with_session_key(rows: DataFrame, fanout: DataFrame) -> DataFrame:
    """Session key per row; a row repeats once per dimension row of its session."""
    return (
        rows.join(fanout, "session_id", "left")
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.coalesce("dimension_rows", F.lit(1)))))
        .withColumn("session_key", F.md5("session_id"))
        .drop("dimension_rows", "_copy")
    )


def with_tool_key(rows: DataFrame, categories: DataFrame) -> DataFrame:
    """Tool key per row, null for a tool outside the category table."""
    known = F.broadcast(categories.select("tool_name", F.md5("tool_name").alias("tool_key")))
    return rows.join(known, "tool_name", "left")


def fct_messages(messages: DataFrame, fanout: DataFrame) -> DataFrame:
    return with_session_key(messages, fanout).select(
        F.md5("conversation_id").alias("message_key"),
        "session_key",
        F.col("partition_date").alias("date_key"),
        "project_id",
        "conversation_id",
        "session_id",
        "role",
        "turn_type",
        "message_sequence",
        "content_length",
        F.col("seconds_since_previous").alias("response_time_seconds"),
        "task_category",
        "time_of_day",
        "day_type",
        "hour_of_day",
        "day_of_week",
        "has_code_block",
        "has_url",
        "is_question",
        "effective_timestamp",
        "partition_date",
        "source_file",
    )


def fct_tool_calls(usage: DataFrame, fanout: DataFrame, categories: DataFrame) -> DataFrame:
    return with_tool_key(with_session_key(usage, fanout), categories).select(
        F.md5("conversation_id").alias("tool_call_key"),
        "session_key",
        "tool_key",
        F.col("partition_date").alias("date_key"),
        "project_id",
        "conversation_id",
        "session_id",
        "tool_name",
        "entry_type",
        "is_invocation",
        "is_result",
        "tool_sequence",
        "tool_category",
        "is_file_operation",
        "is_search_operation",
        "is_shell_command",
        "file_path",
        "file_extension",
        "file_type_category",
        F.col("content_length").alias("tool_content_length"),
        "estimated_execution_seconds",
        "hour_of_day",
        "day_of_week",
        "effective_timestamp",
        "partition_date",
        "source_file",
    )


def fct_file_operations(usage: DataFrame, fanout: DataFrame, categories: DataFrame) -> DataFrame:
    tool = F.col("tool_name")
    rows = usage.where(F.col("is_file_operation"))
    return with_tool_key(with_session_key(rows, fanout), categories).select(
        F.md5("conversation_id").alias("file_operation_key"),
        "session_key",
        "tool_key",
        F.col("partition_date").alias("date_key"),
        "project_id",
        "conversation_id",
        "session_id",
        "tool_name",
        x.operation_type(tool).alias("operation_type"),
        "file_path",
        "file_extension",
        "file_type_category",
        (tool == "Read").alias("is_read"),
        (tool == "Write").alias("is_write"),
        (tool == "Edit").alias("is_edit"),
        F.col("content_length").alias("operation_content_length"),
        "estimated_execution_seconds",
        "hour_of_day",
        "day_of_week",
        "effective_timestamp",
        "partition_date",
        "source_file",
    )
