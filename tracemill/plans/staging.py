"""Staging models: cleaned entries, messages and tool calls.

Whatever a single row can tell (flags, text features) is computed before the ordered
columns. A model that does not read the text then drops it at the scan, and the wide
text never travels through the shuffle of the ordered columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.functions import expressions as x
from tracemill.functions import rules
from tracemill.operators.ordered import Shift, order_within

STAGED_COLUMNS = [
    "conversation_id", "entry_type", "session_id", "project_id", "original_timestamp",
    "effective_timestamp", "ingested_at", "extracted_at", "message_role", "message_content",
    "message_raw", "tool_name", "tool_id", "tool_use_id", "source_file", "partition_date",
    "content_length", "is_message", "is_tool_related", "is_user_message", "is_assistant_message",
]

MESSAGE_COLUMNS = [
    "conversation_id", "session_id", "project_id", "effective_timestamp", "partition_date",
    "entry_type", "role", "message_content", "content_length", "message_sequence",
    "previous_role", "seconds_since_previous", "source_file", "turn_type",
]

TOOL_CALL_COLUMNS = [
    "conversation_id", "session_id", "project_id", "effective_timestamp", "partition_date",
    "entry_type", "tool_name", "tool_id", "tool_use_id", "is_invocation", "is_result",
    "tool_content", "raw_parameters", "content_length", "tool_sequence", "source_file",
    "next_same_tool_timestamp", "next_entry_type",
]


def staged_entries(bronze: DataFrame) -> DataFrame:
    """All entries, plus document id and block position for a definite order."""
    # Null before the cast: a failed cast of an empty text is slow.
    suffix = F.nullif(F.regexp_extract("_id", r"_(\d+)$", 1), F.lit(""))
    return bronze.where(F.col("_id").isNotNull()).select(
        F.col("_id").alias("conversation_id"),
        F.coalesce("type", F.lit("unknown")).alias("entry_type"),
        "session_id",
        "project_id",
        F.col("timestamp").alias("original_timestamp"),
        F.coalesce("timestamp", "ingested_at", "extracted_at").alias("effective_timestamp"),
        "ingested_at",
        "extracted_at",
        "message_role",
        "message_content",
        "message_raw",
        "tool_name",
        "tool_id",
        "tool_use_id",
        "source_file",
        F.col("date").alias("partition_date"),
        x.zero(F.length("message_content")).alias("content_length"),
        F.col("type").isin("user", "assistant").alias("is_message"),
        F.col("type").isin("tool_use", "tool_result").alias("is_tool_related"),
        (F.col("message_role") == "user").alias("is_user_message"),
        (F.col("message_role") == "assistant").alias("is_assistant_message"),
        F.regexp_replace("_id", r"_\d+$", "").alias("doc_id"),
        x.zero(suffix.try_cast("int")).alias("block_index"),
    )


def stg_conversations(bronze: DataFrame) -> DataFrame:
    return staged_entries(bronze).select(*STAGED_COLUMNS)


def message_rows(entries: DataFrame) -> DataFrame:
    """User and assistant entries with text."""
    return entries.where(F.col("is_message") & F.col("message_content").isNotNull()).withColumn(
        "role", F.coalesce("message_role", "entry_type")
    )


def with_message_order(messages: DataFrame, **options) -> DataFrame:
    """Sequence, previous role, gap and turn type inside the session."""
    ordered = order_within(
        messages,
        "session_id",
        sequence="message_sequence",
        shifts={
            "previous_role": Shift("message_role", -1),
            "_previous_at": Shift("effective_timestamp", -1),
        },
        **options,
    )
    before = F.col("previous_role")
    return ordered.withColumns(
        {
            "seconds_since_previous": x.seconds_between(F.col("_previous_at"), F.col("effective_timestamp")),
            "turn_type": F.when(before.isNull(), "conversation_start")
            .when((F.col("role") == "user") & (before == "assistant"), "follow_up")
            .when((F.col("role") == "assistant") & (before == "user"), "response")
            .otherwise("continuation"),
        }
    )


def stg_messages(entries: DataFrame, **options) -> DataFrame:
    return with_message_order(message_rows(entries), **options).select(*MESSAGE_COLUMNS)


def tool_rows(entries: DataFrame) -> DataFrame:
    """Tool calls and results with names, flags and text features."""
    tool = F.coalesce("tool_name", F.lit("unknown"))
    text = F.col("message_content")
    return entries.where(F.col("is_tool_related")).withColumns(
        {
            "tool_name": tool,
            "is_invocation": F.col("entry_type") == "tool_use",
            "is_result": F.col("entry_type") == "tool_result",
            "tool_content": text,
            "raw_parameters": F.col("message_raw"),
            "file_path": x.file_path(tool, text),
            "file_extension": x.file_extension(tool, text),
            "is_file_operation": tool.isin(rules.FILE_TOOLS),
            "is_search_operation": tool.isin(rules.SEARCH_TOOLS),
            "is_shell_command": tool == rules.SHELL_TOOL,
        }
    )


def with_tool_order(tools: DataFrame, **options) -> DataFrame:
    """Sequence, next call of the same tool and next entry type inside the session."""
    return order_within(
        tools,
        "session_id",
        sequence="tool_sequence",
        shifts={
            "next_same_tool_timestamp": Shift("effective_timestamp", 1, within="tool_name"),
            "next_entry_type": Shift("entry_type", 1),
        },
        **options,
    )


def stg_tool_calls(entries: DataFrame, **options) -> DataFrame:
    return with_tool_order(tool_rows(entries), **options).select(*TOOL_CALL_COLUMNS)
