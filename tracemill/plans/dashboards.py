"""Named result sets over the gold tables."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.functions import expressions as x


def sessions_over_time(daily: DataFrame) -> DataFrame:
    return daily.select("date_key", "session_count").orderBy("date_key")


def average_session_duration(sessions: DataFrame) -> DataFrame:
    return sessions.agg((x.mean_seconds(x.to_micros(F.col("duration_seconds"))) / 60.0).alias("avg_duration"))


def active_hours(hourly: DataFrame) -> DataFrame:
    return hourly.select("hour_of_day", "day_name", "total_activity")


def tool_usage(efficiency: DataFrame) -> DataFrame:
    return efficiency.select("tool_name", "total_calls").orderBy(F.desc("total_calls"))


def tool_category_breakdown(efficiency: DataFrame) -> DataFrame:
    return efficiency.groupBy("tool_category").agg(F.sum("total_calls").alias("calls")).orderBy(F.desc("calls"))


def top_tools(efficiency: DataFrame, limit: int = 10) -> DataFrame:
    """Tools outside the category table have no rank and come last."""
    return (
        efficiency.orderBy(F.col("popularity_rank").asc_nulls_last(), "tool_name")
        .limit(limit)
        .select("tool_name", "total_calls", "sessions_used")
    )


def top_tools_with_category(efficiency: DataFrame, limit: int = 10) -> DataFrame:
    return (
        efficiency.orderBy(F.col("popularity_rank").asc_nulls_last(), "tool_name")
        .limit(limit)
        .select("tool_name", "tool_category", "total_calls", "sessions_used", "popularity_rank")
    )


def project_ranking(projects: DataFrame, limit: int = 15) -> DataFrame:
    return (
        projects.orderBy(F.desc("total_messages"), "project_id")
        .limit(limit)
        .select("project_id", "total_messages", "session_count")
    )


def project_status(projects: DataFrame) -> DataFrame:
    return projects.groupBy("activity_status").agg(F.count(F.lit(1)).alias("project_count"))


def daily_code_changes(daily: DataFrame) -> DataFrame:
    return (
        daily.where("has_activity").select("date_key", "file_reads", "file_writes", "file_edits").orderBy("date_key")
    )


def file_types(changes: DataFrame) -> DataFrame:
    return (
        changes.where(F.col("aggregation_level") == "by_file_type")
        .select(F.col("aggregation_key").alias("file_type"), "total_operations")
        .orderBy(F.desc("total_operations"))
    )


def task_categories(messages: DataFrame, count_name: str = "count") -> DataFrame:
    return messages.groupBy("task_category").agg(F.count(F.lit(1)).alias(count_name)).orderBy(F.desc(count_name))


def response_time_trend(sessions: DataFrame) -> DataFrame:
    mean = F.avg(F.col("avg_response_time_seconds").cast("decimal(24,9)")).cast("double")
    return sessions.groupBy("date_key").agg(mean.alias("avg_response")).orderBy("date_key")


def most_active_hours(hourly: DataFrame, limit: int = 10) -> DataFrame:
    return (
        hourly.orderBy(F.desc("total_activity"), "day_of_week", "hour_of_day")
        .limit(limit)
        .select("hour_label", "day_name", "total_activity")
    )


def recent_trend(daily: DataFrame, as_of: datetime.date, days: int = 30) -> DataFrame:
    return (
        daily.where(F.col("date_key") >= F.lit(as_of - datetime.timedelta(days=days)))
        .select("date_key", "session_count", "message_count", "tool_call_count")
        .orderBy("date_key")
    )


def filtered(
    table: DataFrame,
    start: datetime.date | None = None,
    end: datetime.date | None = None,
    projects: list[str] | None = None,
    activity_levels: list[str] | None = None,
) -> DataFrame:
    """Dashboard filters; each applies when given."""
    if start:
        table = table.where(F.col("date_key") >= F.lit(start))
    if end:
        table = table.where(F.col("date_key") <= F.lit(end))
    if projects:
        table = table.where(F.col("project_id").isin(projects))
    if activity_levels:
        table = table.where(F.col("activity_level").isin(activity_levels))
    return table


def freshness(bronze: DataFrame) -> DataFrame:
    return bronze.agg(
        F.max("extracted_at").alias("last_extraction"),
        F.max("date").alias("latest_date"),
        F.count(F.lit(1)).alias("total_records"),
    )
