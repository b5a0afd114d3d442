"""The declared checks of every model and the two expectation suites."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame

from tracemill.operators import quality as q
from tracemill.plans.catalog import Lineage
from tracemill.schemas import BRONZE

# The value lists of the checks.
ENTRY_TYPES = [
    "user", "assistant", "tool_use", "tool_result", "system", "summary", "file-history-snapshot",
    "queue-operation", "progress", "unknown",
]
ROLES = ["user", "assistant"]
TURN_TYPES = ["conversation_start", "follow_up", "response", "continuation"]
TOOL_ENTRIES = ["tool_use", "tool_result"]
TOOL_NAMES = [
    "Read", "Write", "Edit", "Bash", "Glob", "Grep", "Task", "TodoRead", "TodoWrite", "WebFetch", "WebSearch",
    "NotebookEdit", "MultiEdit", "AskFollowupQuestion", "AttemptCompletion", "unknown",
]
TASKS = ["bug_fix", "feature", "refactor", "testing", "documentation", "review", "other"]
TIMES = ["morning", "afternoon", "evening", "night"]
DAY_TYPES = ["weekday", "weekend"]
DURATIONS = ["quick", "short", "medium", "long"]
LEVELS = ["minimal", "light", "moderate", "heavy"]
FILE_TYPES = [
    "javascript", "python", "jvm", "go", "rust", "sql", "documentation", "config", "styles", "html", "shell",
    "docker", "other",
]
SEED_CATEGORIES = ["file_operations", "shell", "search", "agent", "planning", "network", "interaction"]
STATUSES = ["active_today", "active_this_week", "active_this_month", "inactive"]
SIZES = ["single_session", "small", "medium", "large"]
TIERS = ["unused", "rare", "occasional", "frequent", "heavy"]
OPERATIONS = ["read", "write", "edit", "multi_edit", "other"]
FILE_TOOL_NAMES = ["Read", "Write", "Edit", "NotebookEdit", "MultiEdit"]
METRIC_TYPES = ["overall", "by_duration_category", "by_activity_level", "by_time_of_day"]
LEVELS_OF_CHANGE = ["overall", "by_file_type", "by_operation_type", "by_extension"]
WEEKDAYS = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]

# Per model the columns that must be unique, must be set, may only take some
# values, and must occur in another model.
DECLARED: dict[str, dict] = {
    "bronze": {"unique": ["_id"], "not_null": ["_id", "type", "extracted_at", "date"]},
    "tool_categories": {
        "unique": ["tool_name"],
        "not_null": ["tool_name", "tool_category"],
        "accepted": {"tool_category": SEED_CATEGORIES},
    },
    "stg_conversations": {
        "unique": ["conversation_id"],
        "not_null": ["conversation_id", "entry_type", "effective_timestamp", "partition_date", "is_message", "is_tool_related"],
        "accepted": {"entry_type": ENTRY_TYPES},
    },
    "stg_messages": {
        "unique": ["conversation_id"],
        "not_null": ["conversation_id", "role", "message_content", "message_sequence"],
        "accepted": {"role": ROLES, "turn_type": TURN_TYPES},
    },
    "stg_tool_calls": {
        "unique": ["conversation_id"],
        "not_null": ["conversation_id", "entry_type", "tool_name", "is_invocation", "is_result", "tool_sequence"],
        "accepted": {"entry_type": TOOL_ENTRIES, "tool_name": TOOL_NAMES},
    },
    "int_messages_enriched": {
        "unique": ["conversation_id"],
        "not_null": ["conversation_id", "hour_of_day", "day_of_week"],
        "accepted": {"task_category": TASKS, "time_of_day": TIMES, "day_type": DAY_TYPES},
    },
    "int_sessions_computed": {
        "unique": ["session_id"],
        "not_null": ["session_id", "session_start", "session_end", "message_count", "tool_call_count"],
        "accepted": {"session_duration_category": DURATIONS, "activity_level": LEVELS},
    },
    "int_tool_usage": {
        "unique": ["conversation_id"],
        "not_null": ["conversation_id", "tool_name", "tool_category", "is_file_operation", "is_search_operation", "is_shell_command"],
        "accepted": {"file_type_category": FILE_TYPES},
    },
    "dim_date": {
        "unique": ["date_key"],
        "not_null": ["date_key", "year", "quarter", "month", "day_of_week", "is_weekend"],
        "accepted": {"quarter": [1, 2, 3, 4]},
    },
    "dim_projects": {
        "unique": ["project_key", "project_id"],
        "not_null": ["project_key", "project_id", "first_seen", "last_active", "session_count"],
        "accepted": {"activity_status": STATUSES, "project_size": SIZES},
    },
    "dim_sessions": {
        "unique": ["session_key", "session_id"],
        "not_null": ["session_key", "session_id", "session_start", "session_end"],
        "accepted": {
            "session_duration_category": DURATIONS, "activity_level": LEVELS,
            "session_time_of_day": TIMES, "session_day_type": DAY_TYPES,
        },
        "refers": {"date_key": ("dim_date", "date_key")},
    },
    "dim_tools": {
        "unique": ["tool_key", "tool_name"],
        "not_null": ["tool_key", "tool_name", "tool_category", "popularity_rank"],
        "accepted": {"tool_category": [*SEED_CATEGORIES, "unknown"], "usage_tier": TIERS},
    },
    "fct_messages": {
        "unique": ["message_key"],
        "not_null": ["message_key", "role", "content_length", "effective_timestamp"],
        "accepted": {"role": ROLES, "task_category": TASKS},
        "refers": {"session_key": ("dim_sessions", "session_key"), "date_key": ("dim_date", "date_key")},
    },
    "fct_tool_calls": {
        "unique": ["tool_call_key"],
        "not_null": ["tool_call_key", "entry_type", "tool_name", "tool_category", "effective_timestamp"],
        "accepted": {"entry_type": TOOL_ENTRIES},
        "refers": {
            "session_key": ("dim_sessions", "session_key"), "tool_key": ("dim_tools", "tool_key"),
            "date_key": ("dim_date", "date_key"),
        },
    },
    "fct_file_operations": {
        "unique": ["file_operation_key"],
        "not_null": ["file_operation_key", "operation_type", "tool_name", "effective_timestamp"],
        "accepted": {"operation_type": OPERATIONS, "tool_name": FILE_TOOL_NAMES},
        "refers": {
            "session_key": ("dim_sessions", "session_key"), "tool_key": ("dim_tools", "tool_key"),
            "date_key": ("dim_date", "date_key"),
        },
    },
    "agg_session_metrics": {
        "not_null": ["metric_type", "total_sessions", "computed_at"],
        "accepted": {"metric_type": METRIC_TYPES},
    },
    "agg_tool_efficiency": {
        "unique": ["tool_name"],
        "not_null": ["tool_name", "tool_category", "total_calls", "popularity_rank", "computed_at"],
    },
    "agg_code_changes": {
        "not_null": ["aggregation_level", "total_operations", "computed_at"],
        "accepted": {"aggregation_level": LEVELS_OF_CHANGE},
    },
    "agg_daily_summary": {
        "unique": ["date_key"],
        "not_null": ["date_key", "session_count", "message_count", "tool_call_count", "has_activity", "computed_at"],
        "refers": {"date_key": ("dim_date", "date_key")},
    },
    "agg_hourly_activity": {
        "not_null": ["hour_of_day", "day_of_week", "day_name", "time_of_day", "total_activity", "computed_at"],
        "accepted": {"day_name": WEEKDAYS, "time_of_day": TIMES},
    },
}

BRONZE_TYPES = ["user", "assistant", "tool_use", "tool_result"]
STAGED_TYPES = [*BRONZE_TYPES, "unknown"]


def model_checks(models: Lineage, name: str) -> DataFrame:
    """All declared checks of one model."""
    rules, df = DECLARED[name], models[name]
    rows = [q.not_null(c) for c in rules.get("not_null", [])]
    rows += [q.accepted_values(c, v) for c, v in rules.get("accepted", {}).items()]
    results = [q.run_row_checks(df, name, rows)]
    results += [q.unique(df, name, c) for c in rules.get("unique", [])]
    results += [
        q.relationship(df, name, c, models[parent], parent_column)
        for c, (parent, parent_column) in rules.get("refers", {}).items()
    ]
    return q.combine(results)


def declared_checks(models: Lineage, names: list[str] | None = None) -> DataFrame:
    return q.combine([model_checks(models, n) for n in names or DECLARED])


def bronze_suite(bronze: DataFrame) -> DataFrame:
    """Eight checks of the raw table. The column set is that of the table as it is stored."""
    suite = "bronze"
    rows = [
        q.not_null("_id"),
        q.not_null("type"),
        q.accepted_values("type", BRONZE_TYPES),
        q.not_null("extracted_at"),
        q.not_null("date"),
    ]
    return q.combine(
        [
            q.columns_match(bronze, suite, BRONZE.fieldNames()),
            q.run_row_checks(bronze, suite, rows),
            q.unique(bronze, suite, "_id"),
            q.row_count_between(bronze, suite, 0),
        ]
    )


def silver_suite(models: Lineage) -> DataFrame:
    """Ten checks, each on the model that has the column."""
    suite = "silver"
    staged = [
        q.not_null("conversation_id"),
        q.accepted_values("entry_type", STAGED_TYPES),
        q.not_null("effective_timestamp"),
    ]
    enriched = [
        q.accepted_values("task_category", TASKS),
        q.accepted_values("time_of_day", TIMES),
        q.between("hour_of_day", 0, 23),
        q.between("day_of_week", 0, 6),
    ]
    computed = [
        q.accepted_values("session_duration_category", DURATIONS),
        q.accepted_values("activity_level", LEVELS),
    ]
    sessions = models["int_sessions_computed"]
    return q.combine(
        [
            q.run_row_checks(models["stg_conversations"], suite, staged),
            q.run_row_checks(models["message_features"], suite, enriched),
            q.run_row_checks(sessions, suite, computed),
            q.column_type(sessions, suite, "duration_seconds", ["float", "double"]),
        ]
    )


def checkpoint(models: Lineage) -> DataFrame:
    """Both suites with their totals."""
    return q.summary(bronze_suite(models.bronze).unionByName(silver_suite(models)))


def source_freshness(bronze: DataFrame, as_of: datetime.datetime) -> DataFrame:
    return q.freshness(bronze, as_of)
