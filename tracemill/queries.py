"""Every registered query: name -> function of (session, data directory)."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.functions import expressions as x
from tracemill import stored_queries
from tracemill.operators import flatten, merge, quality, search
from tracemill.operators.search import LogFilter
from tracemill.plans import aggregates, checks, dashboards, kpis, silver, staging
from tracemill.plans.catalog import Lineage, Options
from tracemill.sources import documents, event_log, tables
from tracemill.sources.event_log import bronze_from_events

AS_OF = datetime.date(2024, 2, 1)

Query = Callable[[SparkSession, str], DataFrame]


# Means of doubles; their last digits depend on the order of addition.
FLOAT_MEANS = {
    "overall_avg_response_time_seconds", "avg_messages_per_minute", "avg_tools_per_minute", "avg_productivity",
    "productivity_score", "avg_response",
}


def comparable(df: DataFrame) -> DataFrame:
    """Engine-neutral types: wide integers, doubles, zone-free timestamps, no load stamp.
    Means of doubles are rounded; every other double is exact on both engines."""
    columns = []
    for f in df.schema.fields:
        c = f"`{f.name}`"
        if f.name == "computed_at":
            continue
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = f"cast({c} AS bigint)"
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = f"cast({c} AS double)"
            c = f"round({c}, 6)" if f.name in FLOAT_MEANS else c
        elif isinstance(f.dataType, T.TimestampType):
            c = f"cast({c} AS timestamp_ntz)"
        columns.append(f"{c} AS `{f.name}`")
    return df.selectExpr(*columns)


def lineage(spark: SparkSession, sf_dir: str, **options) -> Lineage:
    return Lineage(bronze_from_events(spark, sf_dir), Options(as_of=AS_OF, **options))


def over(model: str, then: Callable[[DataFrame], DataFrame] = lambda df: df, **options) -> Query:
    """A model, or a query over it."""
    return lambda spark, sf_dir: comparable(then(lineage(spark, sf_dir, **options)[model]))


MODEL_QUERIES: dict[str, Query] = {
    name: over(name)
    for name in [
        "stg_conversations", "stg_messages", "stg_tool_calls", "int_messages_enriched", "int_tool_usage",
        "int_sessions_computed", "dim_date", "dim_projects", "dim_sessions", "dim_tools", "fct_messages",
        "fct_tool_calls", "fct_file_operations", "agg_session_metrics", "agg_tool_efficiency",
        "agg_code_changes", "agg_daily_summary", "agg_hourly_activity",
    ]
}

# The plan for huge sessions, forced by a low limit.
SPLIT_QUERIES: dict[str, Query] = {
    "stg_messages_split_sessions": over("stg_messages", split=True, hot_rows=5),
    "stg_tool_calls_split_sessions": over("stg_tool_calls", split=True, hot_rows=5),
}

PART_QUERIES: dict[str, Query] = {
    "activity_rollup": over("activity_rollup"),
    "session_summary": over("dim_sessions", aggregates.session_summary),
    "session_breakdowns": over("dim_sessions", aggregates.session_breakdowns),
    "tool_category_totals": over("fct_tool_calls", aggregates.category_totals),
    "tool_hours": over("fct_tool_calls", aggregates.tool_hours),
    "tool_peak_hours": over("fct_tool_calls", aggregates.peak_hours),
}

DASHBOARD_QUERIES: dict[str, Query] = {
    "sessions_over_time": over("agg_daily_summary", dashboards.sessions_over_time),
    "average_session_duration": over("dim_sessions", dashboards.average_session_duration),
    "active_hours": over("agg_hourly_activity", dashboards.active_hours),
    "tool_usage": over("agg_tool_efficiency", dashboards.tool_usage),
    "tool_category_breakdown": over("agg_tool_efficiency", dashboards.tool_category_breakdown),
    "top_tools": over("agg_tool_efficiency", dashboards.top_tools),
    "top_tools_with_category": over("agg_tool_efficiency", dashboards.top_tools_with_category),
    "project_ranking": over("dim_projects", dashboards.project_ranking),
    "project_status": over("dim_projects", dashboards.project_status),
    "daily_code_changes": over("agg_daily_summary", dashboards.daily_code_changes),
    "file_types": over("agg_code_changes", dashboards.file_types),
    "task_category_distribution": over("message_measures", dashboards.task_categories),
    "response_time_trend": over("dim_sessions", dashboards.response_time_trend),
    "most_active_hours": over("agg_hourly_activity", dashboards.most_active_hours),
    "recent_trend": over("agg_daily_summary", lambda d: dashboards.recent_trend(d, AS_OF)),
    "filtered_sessions": over(
        "dim_sessions",
        lambda d: dashboards.filtered(
            d, datetime.date(2024, 1, 10), datetime.date(2024, 1, 20), ["p1", "p2", "p3"], ["minimal", "light"]
        ),
    ),
    "freshness": lambda spark, sf_dir: comparable(dashboards.freshness(bronze_from_events(spark, sf_dir))),
}

EXTRACTED_AT = datetime.datetime(2024, 3, 3, tzinfo=datetime.timezone.utc)
MARK = datetime.datetime(2024, 1, 20, 12, tzinfo=datetime.timezone.utc)
NOW = datetime.datetime(2024, 1, 31, tzinfo=datetime.timezone.utc)
PAGE_CURSOR = search.encode_cursor("2024-01-15T06:00:00.000Z", "e5")
WEEK = LogFilter("p3", start="2024-01-08", end="2024-01-14")


def over_documents(then: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: comparable(then(event_log.documents_from_events(spark, sf_dir)))


def over_conversations(then: Callable[[DataFrame], DataFrame]) -> Query:
    """Over documents as the landing table holds them: with the whole entry and no ready text."""
    return lambda spark, sf_dir: comparable(
        then(event_log.documents_from_conversations(spark, sf_dir)).select("_id", "sessionId", "message")
    )


def over_bronze(then: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: comparable(then(bronze_from_events(spark, sf_dir)))


def over_lineage(then: Callable[[Lineage], DataFrame]) -> Query:
    return lambda spark, sf_dir: comparable(then(lineage(spark, sf_dir)))


def with_bounds(activity: DataFrame) -> DataFrame:
    first, last = x.period_bounds(F.col("periodStart"), "week")
    return activity.withColumns({"first_day": first, "last_day": last})


LOG_QUERIES: dict[str, Query] = {
    "page_newest": over_documents(lambda d: search.page(d, LogFilter("p3"))),
    "page_after_cursor": over_documents(lambda d: search.page(d, LogFilter("p3"), cursor=PAGE_CURSOR, limit=20)),
    "page_oldest_of_week": over_documents(lambda d: search.page(d, WEEK, limit=100, order="asc")),
    "page_last": over_documents(
        lambda d: search.page(d, LogFilter("p3", session="s27-2"), limit=100, order="asc")
    ),
    "match_count": over_documents(lambda d: search.match_count(d, WEEK)),
    "search_words": over_documents(lambda d: search.matching(d, LogFilter("p3", search="loader REVIEW -suite"))),
    "search_phrase": over_documents(
        lambda d: search.matching(d, LogFilter("p3", search='"login page" hello', start="2024-01-03"))
    ),
    "search_excluding": over_documents(
        lambda d: search.matching(d, LogFilter("p3", search="k table -document", end="2024-01-20"))
    ),
    "export_rows": over_documents(
        lambda d: search.export_rows(d, LogFilter("p3", start="2024-01-08", end="2024-01-14"))
    ),
    "activity_by_hour": over_documents(lambda d: search.message_activity(d, LogFilter("p3"), "hour", 90)),
    "activity_by_day": over_documents(lambda d: search.message_activity(d, WEEK, "day")),
    "activity_by_week": over_documents(lambda d: with_bounds(search.message_activity(d, LogFilter("p3"), "week"))),
    "activity_total": over_documents(lambda d: search.activity_total(search.message_activity(d, LogFilter("p3")))),
    "project_list": over_documents(search.projects),
    "session_list": over_documents(lambda d: search.sessions(d, "p3")),
    "documents_per_project": over_documents(search.documents_per_project),
    "text_search": lambda spark, sf_dir: comparable(
        spark.read.parquet(f"{sf_dir}/documents.parquet")
        .where(search.keyword_match(F.col("text"), "test the -und"))
        .select("doc_id", "lang", F.length("text").alias("length"))
    ),
    "search_landing": over_conversations(lambda d: search.matching(d, LogFilter("p3", search="lead head -und"))),
    "search_landing_keys": over_conversations(lambda d: search.matching(d, LogFilter("p3", search="role content type text"))),
    "log_documents": lambda spark, sf_dir: comparable(
        documents.to_documents(event_log.lines_from_conversations(spark, sf_dir), F.lit(NOW)).drop("entry")
    ),
    "log_malformed": lambda spark, sf_dir: comparable(
        documents.malformed(event_log.lines_from_conversations(spark, sf_dir)).drop("line")
    ),
    "documents_since": over_documents(lambda d: documents.since(d, MARK)),
    "documents_retained": over_documents(lambda d: documents.retained(d, MARK, NOW - datetime.timedelta(days=6))),
    "ingest_status": over_documents(lambda d: documents.ingest_status(d, MARK)),
    "table_date_range": over_bronze(tables.date_range),
    "table_top_projects": over_bronze(tables.top_projects),
    "table_type_distribution": over_bronze(tables.type_distribution),
}


def later_purchases(bronze: DataFrame) -> DataFrame:
    """All calls extracted once more a day later, with new text and on the next day; half of
    them also in an older version that must lose."""
    again = bronze.where(F.col("type") == "tool_use").withColumns(
        {
            "extracted_at": F.col("extracted_at") + F.expr("INTERVAL 1 DAY"),
            "message_content": F.concat(F.lit("again "), "tool_id"),
            "date": F.date_add("date", 1),
        }
    )
    older = again.where(F.col("tool_name") != "Read").withColumns(
        {"extracted_at": F.col("extracted_at") - F.expr("INTERVAL 2 DAYS"), "message_content": F.lit("older")}
    )
    return again.unionByName(older)


def unseen(bronze: DataFrame) -> DataFrame:
    """Calls and errors delivered to a table that already has the calls."""
    calls = bronze.where(F.col("type") == "tool_use")
    incoming = bronze.where(F.col("type").isin("tool_use", "tool_result"))
    return merge.insert_new(calls, incoming.unionByName(incoming))


def late_messages(models: Lineage) -> DataFrame:
    newest = models["activity_rollup"].agg(F.max("partition_date")).first()[0]
    return merge.late_window(models["message_measures"], F.lit(newest)).select(
        "conversation_id", "session_id", "session_key", "partition_date", "role", "content_length"
    )


def flattened(spark: SparkSession, sf_dir: str, python_json: bool) -> DataFrame:
    docs = event_log.documents_from_conversations(spark, sf_dir)
    return flatten.flatten_documents(docs, F.lit(EXTRACTED_AT), python_json)


def order_of_blocks(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    entries = staging.staged_entries(flattened(spark, sf_dir, True))
    return silver.int_messages_enriched(entries, **options)


DATA_QUERIES: dict[str, Query] = {
    "upsert_result": over_bronze(lambda b: merge.merged(b, later_purchases(b))),
    "latest_versions": over_bronze(lambda b: merge.latest_per_id(later_purchases(b))),
    "insert_only_delivery": over_bronze(unseen),
    "late_window": over_lineage(late_messages),
    "flatten_documents": lambda spark, sf_dir: comparable(flattened(spark, sf_dir, True).drop("message_raw")),
    "flatten_documents_compact": lambda spark, sf_dir: comparable(flattened(spark, sf_dir, False)),
    "messages_of_documents": lambda spark, sf_dir: comparable(order_of_blocks(spark, sf_dir)),
    "messages_of_documents_split": lambda spark, sf_dir: comparable(
        order_of_blocks(spark, sf_dir, split=True, hot_rows=2)
    ),
}

KPI_QUERIES: dict[str, Query] = {
    "turns_per_session": over("dim_sessions", kpis.turns_per_session),
    "active_sessions": over("message_features", kpis.active_sessions),
    "tool_share": over("fct_tool_calls", kpis.tool_share),
    "files_per_session": over("fct_file_operations", kpis.files_per_session),
    "edit_frequency": over_lineage(lambda m: kpis.edit_frequency(m["fct_file_operations"], m["dim_sessions"])),
    "daily_hours": over("message_features", kpis.daily_hours),
    "projects_per_day": over("activity_rollup", kpis.projects_per_day),
    "paired_tool_calls": over_lineage(lambda m: kpis.paired_tool_calls(staging.tool_rows(m["entries"]))),
    "task_category_by_word": over_lineage(
        lambda m: dashboards.task_categories(silver.message_features(m["entries"], x.task_category_by_word))
    ),
}

LAYERS = {
    "staging": ["bronze", "tool_categories", "stg_conversations", "stg_messages", "stg_tool_calls"],
    "silver": ["int_messages_enriched", "int_sessions_computed", "int_tool_usage"],
    "dimensions": ["dim_date", "dim_projects", "dim_sessions", "dim_tools"],
    "facts": ["fct_messages", "fct_tool_calls", "fct_file_operations"],
    "aggregates": [
        "agg_session_metrics", "agg_tool_efficiency", "agg_code_changes", "agg_daily_summary", "agg_hourly_activity",
    ],
}


def layer_checks(names: list[str]) -> Query:
    return over_lineage(lambda m: checks.declared_checks(m, names))


CHECK_QUERIES: dict[str, Query] = {
    **{f"checks_{layer}": layer_checks(names) for layer, names in LAYERS.items()},
    "bronze_suite": over_bronze(checks.bronze_suite),
    "silver_suite": over_lineage(checks.silver_suite),
    "suite_checkpoint": over_lineage(checks.checkpoint),
    "timestamp_order": over_lineage(
        lambda m: quality.run_row_checks(
            m["stg_conversations"],
            "stg_conversations",
            [quality.not_before("ingested_at", "original_timestamp"), quality.not_before("original_timestamp", "ingested_at")],
        )
    ),
    "source_freshness": over_bronze(lambda b: checks.source_freshness(b, NOW)),
    "rejected_rows": over_bronze(
        lambda b: quality.split_rows(b, F.col("type").isin(checks.BRONZE_TYPES))[1].select("_id", "type", "date")
    ),
}

# Stored tables: written, changed and read back below the shared scratch folder.
STORED_QUERIES: dict[str, Query] = {
    "search_index": lambda spark, sf_dir: comparable(stored_queries.search_index(spark, sf_dir)),
    "table_versions": lambda spark, sf_dir: comparable(stored_queries.table_versions(spark, sf_dir)),
    "landing_inserts": lambda spark, sf_dir: comparable(stored_queries.landing_inserts(spark, sf_dir)),
    "delta_tool_efficiency": lambda spark, sf_dir: comparable(stored_queries.delta_tool_efficiency(spark, sf_dir)),
}


def in_utc(query: Query) -> Query:
    """All timestamps of the models are UTC, whatever the session was set to."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return query(spark, sf_dir)

    return run


GROUPS = [
    MODEL_QUERIES,
    SPLIT_QUERIES,
    PART_QUERIES,
    DASHBOARD_QUERIES,
    LOG_QUERIES,
    DATA_QUERIES,
    KPI_QUERIES,
    CHECK_QUERIES,
    STORED_QUERIES,
]
QUERIES: dict[str, Query] = {name: in_utc(query) for group in GROUPS for name, query in group.items()}
