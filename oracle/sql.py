"""Registered query name -> DuckDB SQL."""

from __future__ import annotations

from oracle.logs import LOG_ORACLE, declared
from oracle.models import AS_OF, columns_of, with_blocks
from oracle.stored import STORED_ORACLE
from tracemill.plans import silver, staging
from tracemill.queries import LAYERS

SESSION_COLUMNS = [
    "session_id", "project_id", "session_start", "session_end", "start_date", "end_date", "total_entries",
    "duration_seconds", "duration_minutes", "duration_hours", "message_count", "user_message_count",
    "assistant_message_count", "total_content_length", "avg_content_length", "avg_response_time_seconds",
    "tool_call_count", "unique_tools_used", "tool_invocations", "tool_results", "primary_tool",
    "tools_per_message", "session_duration_category", "activity_level",
]
SESSION_DIM_COLUMNS = ["session_key", "date_key"] + [c for c in SESSION_COLUMNS if c != "total_entries"] + [
    "primary_task_category", "task_category_count", "start_hour", "start_day_of_week", "session_time_of_day",
    "session_day_type", "messages_per_minute", "tools_per_minute",
]


def replaced(block: str, *doubles: str) -> str:
    """All columns of a block with the doubles rounded."""
    if not doubles:
        return with_blocks(f"SELECT * FROM {block}")
    changes = ", ".join(f"round({d}, 6) AS {d}" for d in doubles)
    return with_blocks(f"SELECT * REPLACE ({changes}) FROM {block}")


STG_MESSAGES = columns_of("chat", staging.MESSAGE_COLUMNS)
STG_TOOL_CALLS = columns_of("calls", staging.TOOL_CALL_COLUMNS)

ORACLE: dict[str, str] = {
    "stg_conversations": columns_of("entries", staging.STAGED_COLUMNS),
    "stg_messages": STG_MESSAGES,
    "stg_messages_split_sessions": STG_MESSAGES,
    "stg_tool_calls": STG_TOOL_CALLS,
    "stg_tool_calls_split_sessions": STG_TOOL_CALLS,
    "int_messages_enriched": columns_of("chat", silver.ENRICHED_COLUMNS),
    "int_tool_usage": columns_of("usage", silver.TOOL_USAGE_COLUMNS),
    "int_sessions_computed": columns_of("sessions", SESSION_COLUMNS),
    "dim_date": replaced("days"),
    "dim_projects": replaced("projects"),
    "dim_sessions": columns_of("session_dim", SESSION_DIM_COLUMNS),
    "dim_tools": replaced("tool_dim"),
    "fct_messages": replaced("message_fact"),
    "fct_tool_calls": with_blocks("SELECT * EXCLUDE (wait_us) FROM call_fact"),
    "fct_file_operations": replaced("file_fact"),
    "agg_session_metrics": replaced("session_metrics", "overall_avg_response_time_seconds", "productivity_score"),
    "agg_tool_efficiency": replaced("efficiency"),
    "agg_code_changes": replaced("code_changes"),
    "agg_daily_summary": replaced("daily"),
    "agg_hourly_activity": replaced("hourly"),
    "activity_rollup": with_blocks(
        """SELECT session_id, project_id, partition_date, min(effective_timestamp) AS first_at,
                  max(effective_timestamp) AS last_at, count(*) AS entries FROM entries GROUP BY ALL"""
    ),
    "session_summary": replaced(
        "session_stats", "overall_avg_response_time_seconds", "avg_messages_per_minute", "avg_tools_per_minute"
    ),
    "session_breakdowns": replaced("session_cuts", "avg_productivity"),
    "tool_category_totals": replaced("category_stats"),
    "tool_hours": replaced("hour_stats"),
    "tool_peak_hours": replaced("busiest"),
    "sessions_over_time": with_blocks("SELECT date_key, session_count FROM daily"),
    "average_session_duration": with_blocks("SELECT avg(us) / 1e6 / 60.0 AS avg_duration FROM sessions"),
    "active_hours": with_blocks("SELECT hour_of_day, day_name, total_activity FROM hourly"),
    "tool_usage": with_blocks("SELECT tool_name, total_calls FROM efficiency"),
    "tool_category_breakdown": with_blocks(
        "SELECT tool_category, CAST(sum(total_calls) AS BIGINT) AS calls FROM efficiency GROUP BY tool_category"
    ),
    "top_tools": with_blocks(
        """SELECT tool_name, total_calls, sessions_used FROM efficiency
           ORDER BY popularity_rank NULLS LAST, tool_name LIMIT 10"""
    ),
    "top_tools_with_category": with_blocks(
        """SELECT tool_name, tool_category, total_calls, sessions_used, popularity_rank FROM efficiency
           ORDER BY popularity_rank NULLS LAST, tool_name LIMIT 10"""
    ),
    "project_ranking": with_blocks(
        """SELECT project_id, total_messages, session_count FROM projects
           ORDER BY total_messages DESC, project_id LIMIT 15"""
    ),
    "project_status": with_blocks(
        "SELECT activity_status, count(*) AS project_count FROM projects GROUP BY activity_status"
    ),
    "daily_code_changes": with_blocks(
        "SELECT date_key, file_reads, file_writes, file_edits FROM daily WHERE has_activity"
    ),
    "file_types": with_blocks(
        """SELECT aggregation_key AS file_type, total_operations FROM code_changes
           WHERE aggregation_level = 'by_file_type'"""
    ),
    "task_category_distribution": with_blocks(
        """SELECT task_category, count(*) AS count FROM message_fact GROUP BY task_category"""
    ),
    "response_time_trend": with_blocks(
        "SELECT date_key, round(avg(avg_response_time_seconds), 6) AS avg_response FROM session_dim GROUP BY date_key"
    ),
    "most_active_hours": with_blocks(
        """SELECT hour_label, day_name, total_activity FROM hourly
           ORDER BY total_activity DESC, day_of_week, hour_of_day LIMIT 10"""
    ),
    "recent_trend": with_blocks(
        f"""SELECT date_key, session_count, message_count, tool_call_count FROM daily
            WHERE date_key >= {AS_OF} - 30"""
    ),
    "filtered_sessions": columns_of("session_dim", SESSION_DIM_COLUMNS)
    + """ WHERE date_key BETWEEN DATE '2024-01-10' AND DATE '2024-01-20'
          AND project_id IN ('p1', 'p2', 'p3') AND activity_level IN ('minimal', 'light')""",
    "freshness": with_blocks(
        """SELECT max(extracted_at) AS last_extraction, max(date) AS latest_date, count(*) AS total_records
           FROM bronze"""
    ),
}

ORACLE.update(LOG_ORACLE)
ORACLE.update(STORED_ORACLE)
ORACLE.update({f"checks_{layer}": declared(names) for layer, names in LAYERS.items()})
