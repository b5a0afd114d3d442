"""Aggregate tables. Stored unordered; readers sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions import expressions as x
from tracemill.operators.median import exact_median, median_of_counts
from tracemill.plans.silver import most_frequent

TOP_EXTENSIONS = 20


def _minutes(seconds: str = "duration_seconds") -> Column:
    """Mean duration in minutes from exact microsecond sums."""
    return x.mean_seconds(x.to_micros(F.col(seconds))) / 60.0


def _mean(value: str) -> Column:
    """Mean of a double column through a decimal, so that it does not depend on the order
    of the rows."""
    return F.avg(F.col(value).cast("decimal(24,9)")).cast("double")


def session_summary(sessions: DataFrame) -> DataFrame:
    """All-sessions summary with 17 measures, one row."""
    micros = x.to_micros(F.col("duration_seconds"))
    one = sessions.agg(
        F.count(F.lit(1)).alias("total_sessions"),
        F.count_distinct("project_id").alias("unique_projects"),
        _minutes().alias("avg_duration_minutes"),
        F.min("duration_minutes").alias("min_duration_minutes"),
        F.max("duration_minutes").alias("max_duration_minutes"),
        (F.sum(micros) / F.lit(6e7)).alias("total_duration_minutes"),
        (F.sum(micros) / F.lit(3.6e9)).alias("total_duration_hours"),
        F.avg("message_count").alias("avg_messages_per_session"),
        F.sum("message_count").alias("total_messages"),
        F.avg("user_message_count").alias("avg_user_messages"),
        F.avg("assistant_message_count").alias("avg_assistant_messages"),
        F.avg("tool_call_count").alias("avg_tools_per_session"),
        F.sum("tool_call_count").alias("total_tool_calls"),
        F.avg("unique_tools_used").alias("avg_unique_tools"),
        _mean("avg_response_time_seconds").alias("overall_avg_response_time_seconds"),
        _mean("messages_per_minute").alias("avg_messages_per_minute"),
        _mean("tools_per_minute").alias("avg_tools_per_minute"),
    ).withColumn("_all", F.lit("overall"))
    median = (
        exact_median(sessions.withColumns({"_us": micros, "_all": F.lit("overall")}), ["_all"], "_us", "_median")
        .select("_all", (F.col("_median") / F.lit(6e7)).alias("median_duration_minutes"))
    )
    return one.join(median, "_all", "left").drop("_all")


def session_breakdowns(sessions: DataFrame) -> DataFrame:
    """Counts and means by duration class, activity level, time of day and day type in one
    grouping-sets pass."""
    keys = {
        "by_duration_category": "session_duration_category",
        "by_activity_level": "activity_level",
        "by_time_of_day": "session_time_of_day",
        "by_day_type": "session_day_type",
    }
    columns = list(keys.values())
    grouped = sessions.groupingSets([[c] for c in columns], *columns).agg(
        F.grouping_id().alias("_set"),
        F.count(F.lit(1)).alias("session_count"),
        _minutes().alias("avg_duration_minutes"),
        F.avg("message_count").alias("avg_messages"),
        F.avg("tool_call_count").alias("avg_tools"),
        _mean("messages_per_minute").alias("avg_productivity"),
        (F.sum(x.to_micros(F.col("duration_seconds"))) / F.lit(3.6e9)).alias("total_hours"),
    )
    kind = F
    for i, name in enumerate(keys):
        # A bit of the id is 0 for the one column that is grouped on.
        kind = kind.when(F.col("_set") == (15 ^ (8 >> i)), F.lit(name))
    return grouped.select(
        kind.alias("metric_type"), F.coalesce(*columns).alias("metric_key"), *grouped.columns[5:]
    )


def agg_session_metrics(sessions: DataFrame) -> DataFrame:
    """The summary and three breakdowns, stacked. The day type breakdown is not part of it."""
    overall = session_summary(sessions).select(
        F.lit("overall").alias("metric_type"),
        F.lit(None).cast("string").alias("metric_key"),
        "total_sessions",
        "unique_projects",
        "avg_duration_minutes",
        "median_duration_minutes",
        "total_duration_hours",
        "avg_messages_per_session",
        "total_messages",
        "avg_tools_per_session",
        "total_tool_calls",
        "overall_avg_response_time_seconds",
        F.col("avg_messages_per_minute").alias("productivity_score"),
    )
    by_time = F.col("metric_type") == "by_time_of_day"
    parts = (
        session_breakdowns(sessions)
        .where(F.col("metric_type") != "by_day_type")
        .select(
            "metric_type",
            "metric_key",
            F.col("session_count").alias("total_sessions"),
            "avg_duration_minutes",
            F.col("avg_messages").alias("avg_messages_per_session"),
            F.when(~by_time, F.col("avg_tools")).alias("avg_tools_per_session"),
            F.when(by_time, F.col("avg_productivity")).alias("productivity_score"),
        )
    )
    return overall.unionByName(parts, allowMissingColumns=True).withColumn("computed_at", F.current_timestamp())


def tool_cells(calls: DataFrame) -> DataFrame:
    """Tool calls counted per tool, hour, session and project: small enough for the exact
    distinct counts that follow, and keyed so that a popular tool is spread."""
    micros = x.to_micros(F.col("estimated_execution_seconds"))
    return calls.groupBy("tool_name", "tool_category", "hour_of_day", "session_id", "project_id").agg(
        F.count(F.lit(1)).alias("n"),
        x.count_where(F.col("is_invocation")).alias("invocations"),
        x.count_where(F.col("is_result")).alias("results"),
        F.sum(micros).alias("micros"),
        F.count(micros).alias("timed"),
        F.max(micros).alias("longest"),
    )


def category_totals(calls: DataFrame) -> DataFrame:
    return (
        tool_cells(calls)
        .groupBy("tool_category")
        .agg(
            F.sum("n").alias("total_calls"),
            F.count_distinct("tool_name").alias("unique_tools"),
            F.count_distinct("session_id").alias("sessions_used"),
            (x.ratio(F.sum("micros"), F.sum("timed")) / F.lit(1e6)).alias("avg_execution_seconds"),
        )
    )


def tool_hours(calls: DataFrame) -> DataFrame:
    return calls.groupBy("tool_name", "hour_of_day").agg(F.count(F.lit(1)).alias("call_count"))


def peak_hours(calls: DataFrame) -> DataFrame:
    return _peaks(tool_hours(calls))


def _peaks(hours: DataFrame) -> DataFrame:
    """Busiest hour per tool; the earliest one on a tie."""
    return (
        hours.groupBy("tool_name")
        .agg(
            most_frequent("hour_of_day", "call_count").alias("peak_hour"),
            F.max("call_count").alias("peak_hour_calls"),
        )
    )


def call_durations(calls: DataFrame) -> DataFrame:
    """Calls counted per tool and exact duration."""
    timed = calls.withColumn("micros", x.to_micros(F.col("estimated_execution_seconds"))).where("micros IS NOT NULL")
    return timed.groupBy("tool_name", "tool_category", "micros").agg(F.count(F.lit(1)).alias("n"))


def agg_tool_efficiency(calls: DataFrame, tools: DataFrame) -> DataFrame:
    return tool_efficiency(tool_cells(calls), call_durations(calls), tools)


def tool_efficiency(cells: DataFrame, durations: DataFrame, tools: DataFrame) -> DataFrame:
    """From cells and durations, which may be finer than `tool_cells` and `call_durations` make them: all
    their numbers add up."""
    hours = cells.groupBy("tool_name", "hour_of_day").agg(F.sum("n").alias("call_count"))
    per_tool = (
        cells.groupBy("tool_name", "tool_category")
        .agg(
            F.sum("n").alias("total_calls"),
            F.count_distinct("session_id").alias("sessions_used"),
            F.count_distinct("project_id").alias("projects_used"),
            F.sum("invocations").alias("invocations"),
            F.sum("results").alias("results"),
            (x.ratio(F.sum("micros"), F.sum("timed")) / F.lit(1e6)).alias("mean_seconds"),
            (F.max("longest") / F.lit(1e6)).alias("longest_seconds"),
        )
        # Over one row per tool; saves another pass over the calls.
        .withColumn("category_total_calls", F.sum("total_calls").over(Window.partitionBy("tool_category")))
    )
    medians = median_of_counts(durations, ["tool_name", "tool_category"], "micros", "n", "_median")
    known = tools.select("tool_name", "tool_description", "popularity_rank", "usage_tier")
    # Every side holds a row per tool; sizes are left to run-time planning.
    return (
        per_tool.join(medians, ["tool_name", "tool_category"], "left")
        .join(_peaks(hours), "tool_name", "left")
        .join(known, "tool_name", "left")
        .select(
            "tool_name",
            "tool_category",
            "tool_description",
            "total_calls",
            "sessions_used",
            "projects_used",
            "invocations",
            "results",
            F.when(F.col("invocations") > 0, x.percent(F.col("results"), F.col("invocations"))).alias(
                "success_rate_pct"
            ),
            x.fixed(F.col("mean_seconds"), 3).alias("avg_execution_seconds"),
            x.fixed(F.col("_median") / F.lit(1e6), 3).alias("median_execution_seconds"),
            x.fixed(F.col("longest_seconds"), 3).alias("max_execution_seconds"),
            "peak_hour",
            "peak_hour_calls",
            "popularity_rank",
            "usage_tier",
            "category_total_calls",
            x.percent(F.col("total_calls"), F.col("category_total_calls")).alias("pct_of_category"),
            F.current_timestamp().alias("computed_at"),
        )
    )


FILE_KEYS = ["file_type_category", "operation_type", "file_extension"]


def file_cells(operations: DataFrame) -> DataFrame:
    """File operations per distinct combination of everything that is grouped or counted distinctly."""
    return operations.groupBy(*FILE_KEYS, "file_path", "session_id", "project_id").agg(
        F.count(F.lit(1)).alias("n"),
        x.count_where(F.col("is_read")).alias("reads"),
        x.count_where(F.col("is_write")).alias("writes"),
        x.count_where(F.col("is_edit")).alias("edits"),
        F.sum("operation_content_length").alias("length"),
    )


def file_operation_sets(cells: DataFrame) -> DataFrame:
    """File operation measures overall, by file type, by operation type and by extension.

    The grouping sets expand only the combinations of the cells.
    """
    columns = FILE_KEYS
    # Grouping sets give no overall row for no input; this row, which adds nothing, gives one.
    nothing = cells.sparkSession.range(1).select(
        *[F.lit(0 if f.name == "n" else None).cast(f.dataType).alias(f.name) for f in cells.schema.fields]
    )
    cells = cells.unionByName(nothing)
    # A copy, because inside grouping sets a grouped column reads as null elsewhere.
    cells = cells.withColumn("_ext", F.col("file_extension"))
    grouped = cells.groupingSets([[], *[[c] for c in columns]], *columns).agg(
        F.grouping_id().alias("_set"),
        F.sum("n").alias("total_operations"),
        F.sum("reads").alias("read_operations"),
        F.sum("writes").alias("write_operations"),
        F.sum("edits").alias("edit_operations"),
        F.count_distinct("file_path").alias("unique_files"),
        F.count_distinct("_ext").alias("unique_extensions"),
        F.count_distinct("session_id").alias("sessions_with_file_ops"),
        F.count_distinct("project_id").alias("projects_with_file_ops"),
        F.sum("length").alias("total_content_length"),
    )
    level = (
        F.when(F.col("_set") == 7, "overall")
        .when(F.col("_set") == 3, "by_file_type")
        .when(F.col("_set") == 5, "by_operation_type")
        .otherwise("by_extension")
    )
    key = F.coalesce(*columns)
    return grouped.select(level.alias("aggregation_level"), key.alias("aggregation_key"), *grouped.columns[4:]).where(
        (F.col("aggregation_level") == "overall") | F.col("aggregation_key").isNotNull()
    )


def agg_code_changes(operations: DataFrame, top_extensions: int = TOP_EXTENSIONS) -> DataFrame:
    return code_changes(file_cells(operations), top_extensions)


def code_changes(cells: DataFrame, top_extensions: int = TOP_EXTENSIONS) -> DataFrame:
    """Levels of file operations; of the extensions the most used ones, which is what the report shows."""
    sets = file_operation_sets(cells)
    by_extension = F.col("aggregation_level") == "by_extension"
    top = (
        sets.where(by_extension)
        .orderBy(F.desc("total_operations"), "aggregation_key")
        .limit(top_extensions)
    )
    total = F.col("total_operations")
    mean = x.ratio(F.col("total_content_length"), total)
    return (
        sets.where(~by_extension)
        .unionByName(top)
        .select(
            "aggregation_level",
            "aggregation_key",
            "total_operations",
            "read_operations",
            "write_operations",
            "edit_operations",
            x.percent(F.col("read_operations"), total).alias("read_pct"),
            x.percent(F.col("write_operations"), total).alias("write_pct"),
            x.percent(F.col("edit_operations"), total).alias("edit_pct"),
            "unique_files",
            "unique_extensions",
            "sessions_with_file_ops",
            "projects_with_file_ops",
            x.fixed(mean, 0).alias("avg_content_length"),
            "total_content_length",
            F.current_timestamp().alias("computed_at"),
        )
    )


def daily_sessions(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("date_key").agg(
        F.count(F.lit(1)).alias("session_count"),
        F.count_distinct("project_id").alias("active_projects"),
        (F.sum(x.to_micros(F.col("duration_seconds"))) / F.lit(6e7)).alias("total_session_minutes"),
        _minutes().alias("avg_session_minutes"),
        F.sum("message_count").alias("total_messages"),
        F.avg("message_count").alias("avg_messages_per_session"),
        F.sum("tool_call_count").alias("total_tool_calls"),
    )


def daily_messages(messages: DataFrame) -> DataFrame:
    return messages.groupBy("date_key").agg(
        F.count(F.lit(1)).alias("message_count"),
        x.count_where(F.col("role") == "user").alias("user_messages"),
        x.count_where(F.col("role") == "assistant").alias("assistant_messages"),
        F.avg("content_length").alias("avg_content_length"),
        F.sum("content_length").alias("total_content_length"),
        x.count_where(F.col("has_code_block")).alias("messages_with_code"),
        x.count_where(F.col("is_question")).alias("question_count"),
    )


def daily_tools(calls: DataFrame) -> DataFrame:
    micros = x.to_micros(F.col("estimated_execution_seconds"))
    return calls.groupBy("date_key").agg(
        F.count(F.lit(1)).alias("tool_call_count"),
        F.count_distinct("tool_name").alias("unique_tools_used"),
        x.count_where(F.col("is_file_operation")).alias("file_operations"),
        x.count_where(F.col("is_search_operation")).alias("search_operations"),
        x.count_where(F.col("is_shell_command")).alias("shell_commands"),
        x.mean_seconds(micros).alias("avg_execution_seconds"),
    )


def daily_file_operations(operations: DataFrame) -> DataFrame:
    return operations.groupBy("date_key").agg(
        F.count(F.lit(1)).alias("file_operation_count"),
        x.count_where(F.col("is_read")).alias("file_reads"),
        x.count_where(F.col("is_write")).alias("file_writes"),
        x.count_where(F.col("is_edit")).alias("file_edits"),
        F.count_distinct("file_path").alias("unique_files_touched"),
    )


def agg_daily_summary(
    dates: DataFrame, sessions: DataFrame, messages: DataFrame, calls: DataFrame, operations: DataFrame
) -> DataFrame:
    return daily_summary(dates, daily_sessions(sessions), daily_messages(messages), daily_tools(calls), daily_file_operations(operations))


def daily_summary(dates: DataFrame, sessions: DataFrame, messages: DataFrame, calls: DataFrame, operations: DataFrame) -> DataFrame:
    """One row per day of the date dimension, zero where nothing happened, from measures per day."""
    s = sessions.select("date_key", "session_count", "active_projects", "total_session_minutes", "avg_session_minutes")
    joined = (
        dates.join(s, "date_key", "left")
        .join(messages, "date_key", "left")
        .join(calls, "date_key", "left")
        .join(operations, "date_key", "left")
    )
    count = lambda name: x.zero(F.col(name)).alias(name)
    real = lambda name: F.coalesce(F.col(name), F.lit(0.0))
    per_session = lambda name: F.when(
        x.zero(F.col("session_count")) > 0,
        F.round(x.ratio(x.zero(F.col(name)), F.col("session_count")), 2),
    ).otherwise(F.lit(0.0))
    return joined.select(
        "date_key", "year", "month", "week_of_year", "day_of_week", "day_name", "is_weekend", "is_weekday", "year_month",
        count("session_count"),
        count("active_projects"),
        real("total_session_minutes").alias("total_session_minutes"),
        x.fixed(real("avg_session_minutes"), 2).alias("avg_session_minutes"),
        count("message_count"),
        count("user_messages"),
        count("assistant_messages"),
        x.fixed(real("avg_content_length"), 0).alias("avg_content_length"),
        count("total_content_length"),
        count("messages_with_code"),
        count("question_count"),
        count("tool_call_count"),
        count("unique_tools_used"),
        count("file_operations"),
        count("search_operations"),
        count("shell_commands"),
        x.fixed(real("avg_execution_seconds"), 3).alias("avg_tool_execution_seconds"),
        count("file_operation_count"),
        count("file_reads"),
        count("file_writes"),
        count("file_edits"),
        count("unique_files_touched"),
        per_session("message_count").alias("messages_per_session"),
        per_session("tool_call_count").alias("tools_per_session"),
        (x.zero(F.col("session_count")) > 0).alias("has_activity"),
        F.current_timestamp().alias("computed_at"),
    )


def hourly_messages(messages: DataFrame) -> DataFrame:
    """Counted per session and project first, so that the exact distinct counts expand those
    combinations and not the messages."""
    on = ["hour_of_day", "day_of_week"]
    cells = messages.groupBy(*on, "session_id", "project_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("content_length").alias("length"),
        F.count("content_length").alias("measured"),
        x.count_where(F.col("role") == "user").alias("user"),
        x.count_where(F.col("role") == "assistant").alias("assistant"),
        x.count_where(F.col("has_code_block")).alias("code"),
    )
    return hourly_message_cells(cells)


def hourly_message_cells(cells: DataFrame) -> DataFrame:
    on = ["hour_of_day", "day_of_week"]
    return cells.groupBy(*on).agg(
        F.sum("n").alias("message_count"),
        F.count_distinct("session_id").alias("unique_sessions"),
        F.count_distinct("project_id").alias("unique_projects"),
        x.ratio(F.sum("length"), F.sum("measured")).alias("avg_content_length"),
        F.sum("user").alias("user_messages"),
        F.sum("assistant").alias("assistant_messages"),
        F.sum("code").alias("messages_with_code"),
    )


def hourly_tools(calls: DataFrame) -> DataFrame:
    on = ["hour_of_day", "day_of_week"]
    cells = calls.groupBy(*on, "tool_name").agg(
        F.count(F.lit(1)).alias("n"),
        x.count_where(F.col("is_file_operation")).alias("file"),
        x.count_where(F.col("is_search_operation")).alias("search"),
        x.count_where(F.col("is_shell_command")).alias("shell"),
    )
    return hourly_tool_cells(cells)


def hourly_tool_cells(cells: DataFrame) -> DataFrame:
    return cells.groupBy("hour_of_day", "day_of_week").agg(
        F.sum("n").alias("tool_call_count"),
        F.count_distinct("tool_name").alias("unique_tools"),
        F.sum("file").alias("file_operations"),
        F.sum("search").alias("search_operations"),
        F.sum("shell").alias("shell_commands"),
    )


def session_starts(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy(
        F.col("start_hour").alias("hour_of_day"), F.col("start_day_of_week").alias("day_of_week")
    ).agg(F.count(F.lit(1)).alias("session_starts"), _minutes().alias("avg_session_duration"))


def hour_day_grid(spark) -> DataFrame:
    """All 168 pairs of hour and weekday, from one row and two generators."""
    return (
        spark.range(1)
        .select(F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour_of_day"))
        .select("hour_of_day", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("day_of_week"))
    )


def agg_hourly_activity(messages: DataFrame, calls: DataFrame, sessions: DataFrame) -> DataFrame:
    return hourly_activity(hourly_messages(messages), hourly_tools(calls), session_starts(sessions))


def hourly_activity(messages: DataFrame, calls: DataFrame, starts: DataFrame) -> DataFrame:
    """One row per hour and weekday, from measures per hour and weekday."""
    on = ["hour_of_day", "day_of_week"]
    hour, dow = F.col("hour_of_day"), F.col("day_of_week")
    count = lambda name: x.zero(F.col(name)).alias(name)
    real = lambda name: F.coalesce(F.col(name), F.lit(0.0))
    return (
        hour_day_grid(messages.sparkSession)
        .join(messages, on, "left")
        .join(calls, on, "left")
        .join(starts, on, "left")
        .select(
            hour,
            dow,
            x.day_name(dow).alias("day_name"),
            x.day_type(dow).alias("day_type"),
            x.time_of_day(hour).alias("time_of_day"),
            F.concat(F.lpad(hour.cast("string"), 2, "0"), F.lit(":00")).alias("hour_label"),
            count("message_count"),
            count("unique_sessions"),
            count("unique_projects"),
            x.fixed(real("avg_content_length"), 0).alias("avg_content_length"),
            count("user_messages"),
            count("assistant_messages"),
            count("messages_with_code"),
            count("tool_call_count"),
            count("unique_tools"),
            count("file_operations"),
            count("search_operations"),
            count("shell_commands"),
            count("session_starts"),
            x.fixed(real("avg_session_duration"), 2).alias("avg_session_duration"),
            (x.zero(F.col("message_count")) + x.zero(F.col("tool_call_count"))).alias("total_activity"),
            F.current_timestamp().alias("computed_at"),
        )
    )
