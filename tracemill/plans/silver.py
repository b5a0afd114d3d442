"""Intermediate models: enriched messages, tool usage, session measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.functions import expressions as x
from tracemill.functions import rules
from tracemill.plans import staging

ENRICHED_COLUMNS = [
    "conversation_id", "session_id", "project_id", "role", "message_content", "content_length",
    "message_sequence", "turn_type", "previous_role", "seconds_since_previous",
    "effective_timestamp", "partition_date", "hour_of_day", "day_of_week", "week_of_year",
    "month_of_year", "time_of_day", "day_type", "task_category", "has_code_block", "has_url",
    "is_question", "source_file",
]

TOOL_USAGE_COLUMNS = [
    "conversation_id", "session_id", "project_id", "effective_timestamp", "partition_date",
    "entry_type", "tool_name", "tool_id", "tool_use_id", "is_invocation", "is_result",
    "tool_content", "raw_parameters", "content_length", "tool_sequence",
    "next_same_tool_timestamp", "next_entry_type", "tool_category", "tool_description",
    "file_path", "file_extension", "hour_of_day", "day_of_week", "estimated_execution_seconds",
    "is_file_operation", "is_search_operation", "is_shell_command", "source_file",
    "file_type_category",
]


def message_features(entries: DataFrame, classify=x.task_category) -> DataFrame:
    """Message rows with every column that needs no neighbour row."""
    at, text = F.col("effective_timestamp"), F.col("message_content")
    hour, dow = F.hour(at), x.day_of_week(at)
    # A column of its own, so that the many rules share one folding of the text.
    folded = staging.message_rows(entries).withColumn("_folded", F.lower(text))
    return folded.withColumns(
        {
            "hour_of_day": hour,
            "day_of_week": dow,
            "week_of_year": F.weekofyear(at),
            "month_of_year": F.month(at),
            "time_of_day": x.time_of_day(hour),
            "day_type": x.day_type(dow),
            "task_category": classify("_folded"),
            "has_code_block": text.contains("```"),
            "has_url": text.contains("http"),
            "is_question": text.contains("?"),
        }
    ).drop("_folded")


def int_messages_enriched(entries: DataFrame, classify=x.task_category, **options) -> DataFrame:
    return staging.with_message_order(message_features(entries, classify), **options).select(*ENRICHED_COLUMNS)


def tool_features(entries: DataFrame, categories: DataFrame) -> DataFrame:
    """Tool rows with category and file type; the category table is tiny and fixed."""
    at = F.col("effective_timestamp")
    known = F.broadcast(
        categories.select("tool_name", "tool_category", F.col("description").alias("tool_description"))
    )
    return (
        staging.tool_rows(entries)
        .join(known, "tool_name", "left")
        .withColumns(
            {
                "tool_category": F.coalesce("tool_category", F.lit("unknown")),
                "file_type_category": x.file_type("file_extension"),
                "hour_of_day": F.hour(at),
                "day_of_week": x.day_of_week(at),
            }
        )
    )


def int_tool_usage(entries: DataFrame, categories: DataFrame, **options) -> DataFrame:
    ordered = staging.with_tool_order(tool_features(entries, categories), **options)
    waits = F.col("is_invocation") & (F.col("next_entry_type") == "tool_result")
    return ordered.withColumn(
        "estimated_execution_seconds",
        F.when(
            waits & F.col("next_same_tool_timestamp").isNotNull(),
            x.seconds_between(F.col("effective_timestamp"), F.col("next_same_tool_timestamp")),
        ),
    ).select(*TOOL_USAGE_COLUMNS)


def activity_rollup(entries: DataFrame) -> DataFrame:
    """Entries per session, project and day: the one narrow pass behind session bounds,
    project activity and the date range."""
    return entries.groupBy("session_id", "project_id", "partition_date").agg(
        F.min("effective_timestamp").alias("first_at"),
        F.max("effective_timestamp").alias("last_at"),
        F.count(F.lit(1)).alias("entries"),
    )


def session_messages(entries: DataFrame) -> DataFrame:
    """Message measures per session.

    The mean positive gap between neighbours needs no window: the positive gaps of a
    session add up to last minus first, and there is one per distinct timestamp after
    the first. Grouping by (session, timestamp) first also spreads a huge session.
    """
    per_instant = (
        staging.message_rows(entries)
        .where(F.col("session_id").isNotNull())
        .groupBy("session_id", "effective_timestamp")
        .agg(
            F.count(F.lit(1)).alias("n"),
            x.count_where(F.col("role") == "user").alias("users"),
            x.count_where(F.col("role") == "assistant").alias("assistants"),
            F.sum("content_length").alias("length"),
        )
    )
    span = x.micros_between(F.min("effective_timestamp"), F.max("effective_timestamp"))
    gaps = F.count("effective_timestamp") - 1
    return per_instant.groupBy("session_id").agg(
        F.sum("n").alias("message_count"),
        F.sum("users").alias("user_message_count"),
        F.sum("assistants").alias("assistant_message_count"),
        F.sum("length").alias("total_content_length"),
        F.when(gaps > 0, span / gaps / F.lit(1e6)).alias("avg_response_time_seconds"),
    )


def session_tools(entries: DataFrame) -> DataFrame:
    """Tool measures per session. Counting per (session, tool) first gives the distinct
    count and the most used tool without holding names in an aggregation buffer."""
    per_tool = (
        staging.tool_rows(entries)
        .where(F.col("session_id").isNotNull())
        .groupBy("session_id", "tool_name")
        .agg(
            F.count(F.lit(1)).alias("n"),
            x.count_where(F.col("is_invocation")).alias("invocations"),
            x.count_where(F.col("is_result")).alias("results"),
        )
    )
    return per_tool.groupBy("session_id").agg(
        F.sum("n").alias("tool_call_count"),
        F.count(F.lit(1)).alias("unique_tools_used"),
        F.sum("invocations").alias("tool_invocations"),
        F.sum("results").alias("tool_results"),
        most_frequent("tool_name", "n").alias("primary_tool"),
    )


def most_frequent(value: str, count: str):
    """Value with the highest count; the smallest one on a tie."""
    return F.min(F.struct(-F.col(count), F.col(value)))[value]


def int_sessions_computed(rollup: DataFrame, messages: DataFrame, tools: DataFrame) -> DataFrame:
    """One row per (session, project). Message and tool measures belong to the session,
    so they repeat for a session that occurs in two projects."""
    bounds = (
        rollup.where(F.col("session_id").isNotNull())
        .groupBy("session_id", "project_id")
        .agg(
            F.min("first_at").alias("session_start"),
            F.max("last_at").alias("session_end"),
            F.min("partition_date").alias("start_date"),
            F.max("partition_date").alias("end_date"),
            F.sum("entries").alias("total_entries"),
        )
    )
    seconds = x.seconds_between(F.col("session_start"), F.col("session_end"))
    count = x.zero(F.col("message_count"))
    calls = x.zero(F.col("tool_call_count"))
    return (
        bounds.join(messages, "session_id", "left")
        .join(tools, "session_id", "left")
        .select(
            "session_id",
            "project_id",
            "session_start",
            "session_end",
            "start_date",
            "end_date",
            "total_entries",
            seconds.alias("duration_seconds"),
            (seconds / 60.0).alias("duration_minutes"),
            (seconds / 3600.0).alias("duration_hours"),
            count.alias("message_count"),
            x.zero(F.col("user_message_count")).alias("user_message_count"),
            x.zero(F.col("assistant_message_count")).alias("assistant_message_count"),
            x.zero(F.col("total_content_length")).alias("total_content_length"),
            F.coalesce(
                x.ratio(F.col("total_content_length"), F.col("message_count")), F.lit(0.0)
            ).alias("avg_content_length"),
            F.coalesce("avg_response_time_seconds", F.lit(0.0)).alias("avg_response_time_seconds"),
            calls.alias("tool_call_count"),
            x.zero(F.col("unique_tools_used")).alias("unique_tools_used"),
            x.zero(F.col("tool_invocations")).alias("tool_invocations"),
            x.zero(F.col("tool_results")).alias("tool_results"),
            "primary_tool",
            F.coalesce(x.ratio(calls, F.col("message_count")), F.lit(0.0)).alias("tools_per_message"),
            x.ladder(seconds, rules.DURATION_CLASSES, "long", inclusive=False).alias("session_duration_category"),
            x.ladder(count, rules.ACTIVITY_LEVELS, "heavy").alias("activity_level"),
        )
    )
