"""Dimension tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions import expressions as x
from tracemill.functions import rules
from tracemill.plans.silver import most_frequent


def dim_date(rollup: DataFrame, as_of: Column) -> DataFrame:
    """One row per day between the first and the last partition date, without gaps."""
    bounds = rollup.agg(F.min("partition_date").alias("lo"), F.max("partition_date").alias("hi"))
    # An empty table has null bounds: the sequence is null and gives no rows.
    days = bounds.select(F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 DAY"))).alias("date_key"))
    d = F.col("date_key")
    dow = x.day_of_week(d)
    quarter_start = F.trunc(d, "quarter")
    age = F.datediff(as_of, d)
    return days.select(
        d,
        F.year(d).alias("year"),
        F.quarter(d).alias("quarter"),
        F.month(d).alias("month"),
        F.weekofyear(d).alias("week_of_year"),
        F.dayofmonth(d).alias("day_of_month"),
        dow.alias("day_of_week"),
        F.dayofyear(d).alias("day_of_year"),
        F.date_format(d, "yyyy-MM").alias("year_month"),
        F.concat(F.date_format(d, "yyyy"), F.lit("-Q"), F.quarter(d).cast("string")).alias("year_quarter"),
        F.date_format(d, "MMMM").alias("month_name"),
        F.date_format(d, "MMM").alias("month_name_short"),
        F.date_format(d, "EEEE").alias("day_name"),
        F.date_format(d, "EEE").alias("day_name_short"),
        F.trunc(d, "week").alias("week_start_date"),
        F.date_add(F.trunc(d, "week"), 6).alias("week_end_date"),
        F.trunc(d, "month").alias("month_start_date"),
        F.last_day(d).alias("month_end_date"),
        quarter_start.alias("quarter_start_date"),
        F.date_sub(F.add_months(quarter_start, 3), 1).alias("quarter_end_date"),
        x.is_weekend(dow).alias("is_weekend"),
        (~x.is_weekend(dow)).alias("is_weekday"),
        (d == as_of).alias("is_today"),
        (d == F.date_sub(as_of, 1)).alias("is_yesterday"),
        (F.trunc(d, "week") == F.trunc(as_of, "week")).alias("is_current_week"),
        (F.trunc(d, "month") == F.trunc(as_of, "month")).alias("is_current_month"),
        age.alias("days_ago"),
        F.floor(age / 7).cast("double").alias("weeks_ago"),
    )


def dim_projects(rollup: DataFrame, sessions: DataFrame, as_of: Column) -> DataFrame:
    activity = (
        rollup.where(F.col("project_id").isNotNull())
        .groupBy("project_id")
        .agg(
            F.min("first_at").alias("first_seen"),
            F.max("last_at").alias("last_active"),
            F.sum("entries").alias("total_entries"),
            F.count_distinct("session_id").alias("session_count"),
            F.count_distinct("partition_date").alias("active_days"),
        )
    )
    measures = (
        sessions.where(F.col("project_id").isNotNull())
        .groupBy("project_id")
        .agg(
            F.sum("message_count").alias("total_messages"),
            F.sum("tool_call_count").alias("total_tool_calls"),
            (x.mean_seconds(x.to_micros(F.col("duration_seconds"))) / 60.0).alias("mean_minutes"),
            F.avg("message_count").alias("mean_messages"),
            F.avg("tool_call_count").alias("mean_tools"),
        )
    )
    last, first = F.to_date("last_active"), F.to_date("first_seen")
    idle = F.datediff(as_of, last)
    return activity.join(measures, "project_id", "left").select(
        F.md5("project_id").alias("project_key"),
        "project_id",
        "first_seen",
        "last_active",
        first.alias("first_seen_date"),
        last.alias("last_active_date"),
        "total_entries",
        "session_count",
        "active_days",
        x.zero(F.col("total_messages")).alias("total_messages"),
        x.zero(F.col("total_tool_calls")).alias("total_tool_calls"),
        F.coalesce("mean_minutes", F.lit(0.0)).alias("avg_session_duration_minutes"),
        F.coalesce("mean_messages", F.lit(0.0)).alias("avg_messages_per_session"),
        F.coalesce("mean_tools", F.lit(0.0)).alias("avg_tools_per_session"),
        idle.alias("days_since_active"),
        F.datediff(last, first).alias("project_age_days"),
        x.ladder(idle, rules.PROJECT_STATUS, "inactive").alias("activity_status"),
        F.when(F.col("session_count") == 1, "single_session")
        .otherwise(x.ladder(F.col("session_count"), rules.PROJECT_SIZES, "large"))
        .alias("project_size"),
    )


def session_task_categories(messages: DataFrame) -> DataFrame:
    """Main task category and number of categories per session."""
    return (
        messages.where(F.col("session_id").isNotNull())
        .groupBy("session_id", "task_category")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("session_id")
        .agg(
            most_frequent("task_category", "n").alias("primary_task_category"),
            F.count(F.lit(1)).alias("task_category_count"),
        )
    )


def dim_sessions(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    s = sessions.join(session_task_categories(messages), "session_id", "left")
    hour, dow = F.hour("session_start"), x.day_of_week(F.col("session_start"))

    def per_minute(count: str) -> Column:
        busy = (F.col(count) > 0) & (F.col("duration_minutes") > 0)
        return F.when(busy, F.col(count) / F.col("duration_minutes")).otherwise(F.lit(0.0))

    return s.select(
        F.md5("session_id").alias("session_key"),
        "session_id",
        "project_id",
        F.col("start_date").alias("date_key"),
        "session_start",
        "session_end",
        "start_date",
        "end_date",
        "duration_seconds",
        "duration_minutes",
        "duration_hours",
        "session_duration_category",
        "message_count",
        "user_message_count",
        "assistant_message_count",
        "total_content_length",
        "avg_content_length",
        "avg_response_time_seconds",
        "tool_call_count",
        "unique_tools_used",
        "tool_invocations",
        "tool_results",
        "primary_tool",
        "tools_per_message",
        "activity_level",
        "primary_task_category",
        "task_category_count",
        hour.alias("start_hour"),
        dow.alias("start_day_of_week"),
        x.time_of_day(hour).alias("session_time_of_day"),
        x.day_type(dow).alias("session_day_type"),
        per_minute("message_count").alias("messages_per_minute"),
        per_minute("tool_call_count").alias("tools_per_minute"),
    )


def tool_statistics(usage: DataFrame) -> DataFrame:
    """Use of each tool. The first grouping shrinks the rows on keys that spread any
    popular tool; the distinct counts then run on what is left."""
    micros = x.to_micros(F.col("estimated_execution_seconds"))
    return tool_statistics_of_cells(
        usage.groupBy("tool_name", "session_id", "project_id", "partition_date").agg(
            F.count(F.lit(1)).alias("n"),
            F.min("effective_timestamp").alias("first_at"),
            F.max("effective_timestamp").alias("last_at"),
            x.count_where(F.col("is_invocation")).alias("invocations"),
            x.count_where(F.col("is_result")).alias("results"),
            F.sum(micros).alias("micros"),
            F.count(micros).alias("timed"),
        )
    )


def tool_statistics_of_cells(cells: DataFrame) -> DataFrame:
    return cells.groupBy("tool_name").agg(
        F.sum("n").alias("total_calls"),
        F.count_distinct("session_id").alias("sessions_used"),
        F.count_distinct("project_id").alias("projects_used"),
        F.count_distinct("partition_date").alias("days_used"),
        F.min("first_at").alias("first_used"),
        F.max("last_at").alias("last_used"),
        F.sum("invocations").alias("invocation_count"),
        F.sum("results").alias("result_count"),
        (x.ratio(F.sum("micros"), F.sum("timed")) / F.lit(1e6)).alias("avg_execution_seconds"),
    )


def tool_file_types(usage: DataFrame) -> DataFrame:
    files = usage.where(F.col("is_file_operation") & F.col("file_type_category").isNotNull())
    return file_types_of_cells(files.groupBy("tool_name", "file_type_category").agg(F.count(F.lit(1)).alias("n")))


def file_types_of_cells(cells: DataFrame) -> DataFrame:
    return (
        cells.groupBy("tool_name", "file_type_category")
        .agg(F.sum("n").alias("n"))
        .groupBy("tool_name")
        .agg(
            most_frequent("file_type_category", "n").alias("primary_file_type"),
            F.count(F.lit(1)).alias("file_types_count"),
        )
    )


def dim_tools(categories: DataFrame, usage: DataFrame) -> DataFrame:
    return tools_with_use(categories, tool_statistics(usage), tool_file_types(usage))


def tools_with_use(categories: DataFrame, statistics: DataFrame, file_types: DataFrame) -> DataFrame:
    """One row per tool of the category table, used or not."""
    category = F.col("tool_category")
    calls = x.zero(F.col("total_calls"))
    both = (F.col("invocation_count") > 0) & (F.col("result_count") > 0)
    # The category table is the left side of both joins, so all results stay that small.
    flags = ["file", "shell", "search", "agent", "planning", "network", "interaction"]
    return (
        categories.join(statistics, "tool_name", "left")
        .join(file_types, "tool_name", "left")
        .select(
            F.md5("tool_name").alias("tool_key"),
            "tool_name",
            "tool_category",
            F.col("description").alias("tool_description"),
            *[
                (category == ("file_operations" if f == "file" else f)).alias(f"is_{f}_tool")
                for f in flags
            ],
            calls.alias("total_calls"),
            x.zero(F.col("sessions_used")).alias("sessions_used"),
            x.zero(F.col("projects_used")).alias("projects_used"),
            x.zero(F.col("days_used")).alias("days_used"),
            "first_used",
            "last_used",
            x.zero(F.col("invocation_count")).alias("invocation_count"),
            x.zero(F.col("result_count")).alias("result_count"),
            "avg_execution_seconds",
            "primary_file_type",
            x.zero(F.col("file_types_count")).alias("file_types_count"),
            F.when(both, x.ratio(F.col("result_count"), F.col("invocation_count"))).alias("success_rate"),
            F.rank().over(Window.orderBy(calls.desc())).alias("popularity_rank"),
            x.ladder(calls, rules.USAGE_TIERS, "heavy").alias("usage_tier"),
        )
    )
