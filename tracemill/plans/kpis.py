"""Key figures computable from the stored columns, and the pairing of calls with results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions import expressions as x
from tracemill.plans.silver import most_frequent


def turns_per_session(sessions: DataFrame) -> DataFrame:
    """User messages of each session."""
    return sessions.select("session_id", "project_id", F.col("user_message_count").alias("turns"))


def active_sessions(messages: DataFrame, granularity: str = "day") -> DataFrame:
    """Distinct sessions per period."""
    return messages.groupBy(x.period(F.col("effective_timestamp"), granularity).alias("period")).agg(
        F.count_distinct("session_id").alias("active_sessions")
    )


def tool_share(calls: DataFrame) -> DataFrame:
    """Calls per tool and their share of all calls; the window runs over one row per tool."""
    per_tool = calls.groupBy("tool_name").agg(F.count(F.lit(1)).alias("calls"))
    everything = Window.partitionBy()
    return per_tool.withColumn("share", F.col("calls") / F.sum("calls").over(everything))


def files_per_session(operations: DataFrame) -> DataFrame:
    return operations.groupBy("session_id").agg(F.count_distinct("file_path").alias("files"))


def edit_frequency(operations: DataFrame, sessions: DataFrame) -> DataFrame:
    """Edits per hour of session; null for a session without duration."""
    edits = operations.where(F.col("is_edit")).groupBy("session_id").agg(F.count(F.lit(1)).alias("edits"))
    return sessions.join(edits, "session_id", "left").select(
        "session_id",
        "project_id",
        x.zero(F.col("edits")).alias("edits"),
        x.ratio(x.zero(F.col("edits")), F.col("duration_hours")).alias("edits_per_hour"),
    )


def daily_hours(messages: DataFrame) -> DataFrame:
    """Hours with activity and the busiest hour (earliest on a tie) per day."""
    per_hour = messages.groupBy("partition_date", "hour_of_day").agg(F.count(F.lit(1)).alias("n"))
    return per_hour.groupBy(F.col("partition_date").alias("date_key")).agg(
        F.count("hour_of_day").alias("active_hours"),
        most_frequent("hour_of_day", "n").alias("peak_hour"),
    )


def projects_per_day(rollup: DataFrame) -> DataFrame:
    return rollup.groupBy(F.col("partition_date").alias("date_key")).agg(
        F.count_distinct("project_id").alias("projects")
    )


def paired_tool_calls(tools: DataFrame) -> DataFrame:
    """Each invocation with its result, matched on the call id, and the time between.

    One side is grouped by call id first, so a result delivered many times does not
    multiply the invocation; the earliest result counts.
    """
    results = (
        tools.where(F.col("is_result") & F.col("tool_use_id").isNotNull())
        .groupBy(F.col("tool_use_id").alias("_call"))
        .agg(F.min("effective_timestamp").alias("result_at"))
    )
    calls = tools.where(F.col("is_invocation") & F.col("tool_id").isNotNull())
    return calls.join(results, F.col("tool_id") == F.col("_call"), "left").select(
        "conversation_id",
        "session_id",
        "tool_name",
        "tool_id",
        F.col("effective_timestamp").alias("called_at"),
        "result_at",
        F.col("result_at").isNotNull().alias("has_result"),
        x.seconds_between(F.col("effective_timestamp"), F.col("result_at")).alias("execution_seconds"),
    )
