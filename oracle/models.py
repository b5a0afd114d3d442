"""SQL for the models, as named blocks that a query strings together in a WITH clause."""

from __future__ import annotations

import re

from tracemill.functions import rules
from tracemill.sources import event_log

AS_OF = "DATE '2024-02-01'"
SESSION_ORDER = "ORDER BY effective_timestamp, substr(md5(doc_id), 1, 7), doc_id, block_index"


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def array(values: list[str]) -> str:
    return "[" + ", ".join(quoted(v) for v in values) + "]"


def _task_rules() -> str:
    lines = []
    for category, patterns in rules.TASK_PATTERNS.items():
        alternatives = "|".join(p.strip("%").replace("%", ".*") for p in patterns)
        lines.append(f"WHEN regexp_matches(lower(message_content), {quoted(alternatives)}, 's') THEN {quoted(category)}")
    return "CASE " + " ".join(lines) + " ELSE 'other' END"


def _task_word_rules() -> str:
    lines = [
        f"WHEN regexp_matches(lower(message_content), {quoted('|'.join(p))}) THEN {quoted(c)}"
        for c, p in rules.TASK_WORD_PATTERNS.items()
    ]
    return "CASE " + " ".join(lines) + " ELSE 'other' END"


def clock(hour: str) -> str:
    return (
        f"CASE {hour} // 6 WHEN 1 THEN 'morning' WHEN 2 THEN 'afternoon' "
        f"WHEN 3 THEN if({hour} < 22, 'evening', 'night') ELSE 'night' END"
    )


def _values(rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(quoted(v) for v in r) + ")" for r in rows) + ")"


EXTENSIONS = [(e, kind) for kind, extensions in rules.FILE_TYPES.items() for e in extensions]

BLOCKS: dict[str, str] = {
    "seed": f"SELECT * FROM {_values(rules.TOOL_CATEGORIES)} AS t(tool_name, tool_category, description)",
    "extensions": f"SELECT * FROM {_values(EXTENSIONS)} AS t(extension, kind)",
    "parts": """
        SELECT *,
               'p' || if(user_id = 7, event_id % 2, user_id % 12) AS project,
               if(event_id % 97 = 0, NULL,
                  's' || user_id || '-' || if(user_id % 2 = 0, day(ts), day(ts) // 7)) AS session,
               if(event_id % 50 = 0, NULL, ts) AS stamp
        FROM events""",
    "bronze": f"""
        SELECT 'e' || event_id AS _id,
               CASE event_type WHEN 'view' THEN 'user' WHEN 'click' THEN 'assistant'
                    WHEN 'purchase' THEN 'tool_use' WHEN 'error' THEN 'tool_result'
                    WHEN 'signup' THEN if(event_id % 2 = 0, 'system', NULL) END AS type,
               session AS session_id, project AS project_id, stamp AS timestamp,
               ts + INTERVAL 5 MINUTE AS ingested_at, ts + INTERVAL 1 HOUR AS extracted_at,
               CASE WHEN event_type IN ('view', 'error') THEN 'user'
                    WHEN event_type IN ('click', 'purchase') THEN 'assistant' END AS message_role,
               if(event_id % 41 = 0, NULL,
                  ({array(event_log.TEMPLATES)})[event_id % 12 + 1] || ' ' || props) AS message_content,
               props AS message_raw,
               '/logs/projects/' || project || '/' || session || '.jsonl' AS source_file,
               CAST(coalesce(stamp, ts + INTERVAL 5 MINUTE) AS DATE) AS date,
               if(event_type = 'purchase', ({array(event_log.TOOLS)})[event_id % 17 + 1], NULL) AS tool_name,
               if(event_type = 'purchase', 't' || event_id, NULL) AS tool_id,
               if(event_type = 'error', 't' || (event_id - 1), NULL) AS tool_use_id
        FROM parts""",
    "entries": """
        SELECT _id AS conversation_id, ifnull(type, 'unknown') AS entry_type, session_id, project_id,
               timestamp AS original_timestamp,
               coalesce(timestamp, ingested_at, extracted_at) AS effective_timestamp,
               ingested_at, extracted_at, message_role, message_content, message_raw, tool_name,
               tool_id, tool_use_id, source_file, date AS partition_date,
               ifnull(length(message_content), 0) AS content_length,
               (type = 'user' OR type = 'assistant') AS is_message,
               (type = 'tool_use' OR type = 'tool_result') AS is_tool_related,
               message_role = 'user' AS is_user_message,
               message_role = 'assistant' AS is_assistant_message,
               regexp_replace(_id, '_[0-9]+$', '') AS doc_id,
               ifnull(try_cast(regexp_extract(_id, '_([0-9]+)$', 1) AS INTEGER), 0) AS block_index
        FROM bronze WHERE _id IS NOT NULL""",
    "messages": f"""
        SELECT *, ifnull(message_role, entry_type) AS role,
               hour(effective_timestamp) AS hour_of_day, dayofweek(effective_timestamp) AS day_of_week,
               weekofyear(effective_timestamp) AS week_of_year, month(effective_timestamp) AS month_of_year,
               {clock("hour(effective_timestamp)")} AS time_of_day,
               if(dayofweek(effective_timestamp) % 6 = 0, 'weekend', 'weekday') AS day_type,
               {_task_rules()} AS task_category,
               {_task_word_rules()} AS word_category,
               position('```' IN message_content) > 0 AS has_code_block,
               position('http' IN message_content) > 0 AS has_url,
               position('?' IN message_content) > 0 AS is_question
        FROM entries WHERE is_message AND message_content IS NOT NULL""",
    "chat": f"""
        SELECT *, gap_us / 1e6 AS seconds_since_previous,
                  CASE WHEN previous_role IS NULL THEN 'conversation_start'
                       WHEN role || '<' || previous_role = 'user<assistant' THEN 'follow_up'
                       WHEN role || '<' || previous_role = 'assistant<user' THEN 'response'
                       ELSE 'continuation' END AS turn_type
        FROM (SELECT *, row_number() OVER w AS message_sequence, lag(message_role) OVER w AS previous_role,
                     epoch_us(effective_timestamp) - lag(epoch_us(effective_timestamp)) OVER w AS gap_us
              FROM messages WINDOW w AS (PARTITION BY session_id {SESSION_ORDER}))""",
    "calls": f"""
        SELECT * EXCLUDE (tool_name), ifnull(tool_name, 'unknown') AS tool_name,
               entry_type = 'tool_use' AS is_invocation, entry_type = 'tool_result' AS is_result,
               message_content AS tool_content, message_raw AS raw_parameters,
               row_number() OVER (PARTITION BY session_id {SESSION_ORDER}) AS tool_sequence,
               lead(effective_timestamp) OVER (PARTITION BY session_id, ifnull(tool_name, 'unknown') {SESSION_ORDER})
                   AS next_same_tool_timestamp,
               lead(entry_type) OVER (PARTITION BY session_id {SESSION_ORDER}) AS next_entry_type
        FROM entries WHERE is_tool_related""",
    "usage": f"""
        SELECT c.* EXCLUDE (tool_name), c.tool_name, ifnull(s.tool_category, 'unknown') AS tool_category,
               s.description AS tool_description, c.file_path, c.file_extension,
               ifnull(x.kind, 'other') AS file_type_category,
               hour(effective_timestamp) AS hour_of_day, dayofweek(effective_timestamp) AS day_of_week,
               if(is_invocation AND next_entry_type = 'tool_result',
                  epoch_us(next_same_tool_timestamp) - epoch_us(effective_timestamp), NULL) AS wait_us,
               wait_us / 1e6 AS estimated_execution_seconds,
               list_contains({array(rules.FILE_TOOLS)}, c.tool_name) AS is_file_operation,
               list_contains({array(rules.SEARCH_TOOLS)}, c.tool_name) AS is_search_operation,
               c.tool_name = {quoted(rules.SHELL_TOOL)} AS is_shell_command
        FROM (SELECT *,
                     if(list_contains({array(rules.PATH_TOOLS)}, tool_name) AND instr(tool_content, '/') > 0,
                        regexp_extract(tool_content, {quoted(rules.PATH_REGEX)}, 1), NULL) AS file_path,
                     if(list_contains({array(rules.PATH_TOOLS)}, tool_name) AND instr(tool_content, '.') > 0,
                        regexp_extract(tool_content, {quoted(rules.EXTENSION_REGEX)}, 1), NULL) AS file_extension
              FROM calls) c
        LEFT JOIN seed s ON s.tool_name = c.tool_name
        LEFT JOIN extensions x ON x.extension = c.file_extension""",
    "spans": """
        SELECT session_id, project_id, min(effective_timestamp) AS session_start,
               max(effective_timestamp) AS session_end, min(partition_date) AS start_date,
               max(partition_date) AS end_date, count(*) AS total_entries,
               (epoch_us(max(effective_timestamp)) - epoch_us(min(effective_timestamp))) AS us
        FROM entries WHERE session_id IS NOT NULL GROUP BY ALL""",
    "talk": """
        SELECT session_id, count(*) AS message_count,
               count(*) FILTER (role = 'user') AS user_message_count,
               count(*) FILTER (role = 'assistant') AS assistant_message_count,
               CAST(sum(content_length) AS BIGINT) AS total_content_length,
               avg(content_length) AS avg_content_length,
               avg(gap_us) FILTER (gap_us > 0) / 1e6 AS gap
        FROM chat GROUP BY session_id""",
    "work": """
        SELECT session_id, count(*) AS tool_call_count, count(DISTINCT tool_name) AS unique_tools_used,
               count(*) FILTER (is_invocation) AS tool_invocations, count(*) FILTER (is_result) AS tool_results
        FROM calls GROUP BY session_id""",
    "favourite": """
        SELECT session_id, first(tool_name ORDER BY n DESC, tool_name) AS primary_tool
        FROM (SELECT session_id, tool_name, count(*) AS n FROM calls GROUP BY ALL) GROUP BY session_id""",
    "sessions": """
        SELECT s.*, us / 1e6 AS duration_seconds, us / 1e6 / 60.0 AS duration_minutes,
               us / 1e6 / 3600.0 AS duration_hours,
               ifnull(message_count, 0) AS message_count, ifnull(user_message_count, 0) AS user_message_count,
               ifnull(assistant_message_count, 0) AS assistant_message_count,
               ifnull(total_content_length, 0) AS total_content_length,
               ifnull(avg_content_length, 0) AS avg_content_length,
               ifnull(gap, 0) AS avg_response_time_seconds,
               ifnull(tool_call_count, 0) AS tool_call_count, ifnull(unique_tools_used, 0) AS unique_tools_used,
               ifnull(tool_invocations, 0) AS tool_invocations, ifnull(tool_results, 0) AS tool_results,
               primary_tool,
               if(message_count > 0, ifnull(tool_call_count, 0) / CAST(message_count AS DOUBLE), 0) AS tools_per_message,
               CASE WHEN us < 60000000 THEN 'quick' WHEN us < 600000000 THEN 'short'
                    WHEN us < 3600000000 THEN 'medium' ELSE 'long' END AS session_duration_category,
               CASE WHEN ifnull(message_count, 0) <= 5 THEN 'minimal' WHEN message_count <= 20 THEN 'light'
                    WHEN message_count <= 50 THEN 'moderate' ELSE 'heavy' END AS activity_level
        FROM spans s LEFT JOIN talk USING (session_id) LEFT JOIN work USING (session_id)
             LEFT JOIN favourite USING (session_id)""",
    "days": f"""
        SELECT d AS date_key, year(d) AS year, quarter(d) AS quarter, month(d) AS month,
               weekofyear(d) AS week_of_year, day(d) AS day_of_month, dayofweek(d) AS day_of_week,
               dayofyear(d) AS day_of_year, strftime(d, '%Y-%m') AS year_month,
               year(d) || '-Q' || quarter(d) AS year_quarter, monthname(d) AS month_name,
               left(monthname(d), 3) AS month_name_short, dayname(d) AS day_name,
               left(dayname(d), 3) AS day_name_short,
               CAST(d - CAST(isodow(d) - 1 AS INTEGER) AS DATE) AS week_start_date,
               CAST(d + CAST(7 - isodow(d) AS INTEGER) AS DATE) AS week_end_date,
               make_date(year(d), month(d), 1) AS month_start_date, last_day(d) AS month_end_date,
               make_date(year(d), quarter(d) * 3 - 2, 1) AS quarter_start_date,
               last_day(make_date(year(d), quarter(d) * 3, 1)) AS quarter_end_date,
               dayofweek(d) % 6 = 0 AS is_weekend, dayofweek(d) % 6 <> 0 AS is_weekday,
               d = {AS_OF} AS is_today, d + 1 = {AS_OF} AS is_yesterday,
               yearweek(d) = yearweek({AS_OF}) AS is_current_week,
               strftime(d, '%Y%m') = strftime({AS_OF}, '%Y%m') AS is_current_month,
               datediff('day', d, {AS_OF}) AS days_ago,
               CAST(floor(datediff('day', d, {AS_OF}) / 7) AS DOUBLE) AS weeks_ago
        FROM (SELECT CAST(unnest(range(lo, hi + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS d
              FROM (SELECT CAST(min(partition_date) AS TIMESTAMP) AS lo, CAST(max(partition_date) AS TIMESTAMP) AS hi
                    FROM entries))""",
    "projects": f"""
        SELECT *, CASE WHEN days_since_active <= 1 THEN 'active_today' WHEN days_since_active <= 7 THEN 'active_this_week'
                       WHEN days_since_active <= 30 THEN 'active_this_month' ELSE 'inactive' END AS activity_status,
               CASE WHEN session_count = 1 THEN 'single_session' WHEN session_count <= 5 THEN 'small'
                    WHEN session_count <= 20 THEN 'medium' ELSE 'large' END AS project_size
        FROM (SELECT md5(a.project_id) AS project_key, a.*, CAST(first_seen AS DATE) AS first_seen_date,
                     CAST(last_active AS DATE) AS last_active_date,
                     ifnull(b.total_messages, 0) AS total_messages, ifnull(b.total_tool_calls, 0) AS total_tool_calls,
                     ifnull(b.minutes, 0) AS avg_session_duration_minutes,
                     ifnull(b.avg_messages, 0) AS avg_messages_per_session, ifnull(b.avg_tools, 0) AS avg_tools_per_session,
                     datediff('day', CAST(last_active AS DATE), {AS_OF}) AS days_since_active,
                     datediff('day', CAST(first_seen AS DATE), CAST(last_active AS DATE)) AS project_age_days
              FROM (SELECT project_id, min(effective_timestamp) AS first_seen, max(effective_timestamp) AS last_active,
                           count(*) AS total_entries, count(DISTINCT session_id) AS session_count,
                           count(DISTINCT partition_date) AS active_days
                    FROM entries WHERE project_id IS NOT NULL GROUP BY project_id) a
              LEFT JOIN (SELECT project_id, CAST(sum(message_count) AS BIGINT) AS total_messages,
                                CAST(sum(tool_call_count) AS BIGINT) AS total_tool_calls,
                                avg(us) / 1e6 / 60.0 AS minutes, avg(message_count) AS avg_messages,
                                avg(tool_call_count) AS avg_tools
                         FROM sessions GROUP BY project_id) b ON b.project_id = a.project_id)""",
    "topics": """
        SELECT session_id, first(task_category ORDER BY n DESC, task_category) AS primary_task_category,
               count(*) AS task_category_count
        FROM (SELECT session_id, task_category, count(*) AS n FROM messages GROUP BY ALL) GROUP BY session_id""",
    "session_dim": f"""
        SELECT md5(s.session_id) AS session_key, s.* EXCLUDE (total_entries), s.start_date AS date_key,
               t.primary_task_category, t.task_category_count,
               hour(session_start) AS start_hour, dayofweek(session_start) AS start_day_of_week,
               {clock("hour(session_start)")} AS session_time_of_day,
               if(dayofweek(session_start) % 6 = 0, 'weekend', 'weekday') AS session_day_type,
               if(message_count > 0 AND us > 0, message_count / duration_minutes, 0) AS messages_per_minute,
               if(tool_call_count > 0 AND us > 0, tool_call_count / duration_minutes, 0) AS tools_per_minute
        FROM sessions s LEFT JOIN topics t USING (session_id)""",
    "tool_dim": """
        SELECT md5(s.tool_name) AS tool_key, s.tool_name, s.tool_category, s.description AS tool_description,
               s.tool_category = 'file_operations' AS is_file_tool, s.tool_category = 'shell' AS is_shell_tool,
               s.tool_category = 'search' AS is_search_tool, s.tool_category = 'agent' AS is_agent_tool,
               s.tool_category = 'planning' AS is_planning_tool, s.tool_category = 'network' AS is_network_tool,
               s.tool_category = 'interaction' AS is_interaction_tool,
               ifnull(n, 0) AS total_calls, ifnull(sessions_used, 0) AS sessions_used,
               ifnull(projects_used, 0) AS projects_used, ifnull(days_used, 0) AS days_used, first_used, last_used,
               ifnull(invocation_count, 0) AS invocation_count, ifnull(result_count, 0) AS result_count,
               avg_execution_seconds, primary_file_type, ifnull(file_types_count, 0) AS file_types_count,
               if(invocation_count > 0 AND result_count > 0,
                  result_count / CAST(invocation_count AS DOUBLE), NULL) AS success_rate,
               rank() OVER (ORDER BY ifnull(n, 0) DESC) AS popularity_rank,
               CASE WHEN n IS NULL THEN 'unused' WHEN n <= 10 THEN 'rare' WHEN n <= 100 THEN 'occasional'
                    WHEN n <= 1000 THEN 'frequent' ELSE 'heavy' END AS usage_tier
        FROM seed s
        LEFT JOIN (SELECT tool_name, count(*) AS n, count(DISTINCT session_id) AS sessions_used,
                          count(DISTINCT project_id) AS projects_used, count(DISTINCT partition_date) AS days_used,
                          min(effective_timestamp) AS first_used, max(effective_timestamp) AS last_used,
                          count(*) FILTER (is_invocation) AS invocation_count,
                          count(*) FILTER (is_result) AS result_count,
                          avg(wait_us) / 1e6 AS avg_execution_seconds
                   FROM usage GROUP BY tool_name) u ON u.tool_name = s.tool_name
        LEFT JOIN (SELECT tool_name, first(file_type_category ORDER BY n DESC, file_type_category) AS primary_file_type,
                          count(*) AS file_types_count
                   FROM (SELECT tool_name, file_type_category, count(*) AS n FROM usage
                         WHERE is_file_operation GROUP BY ALL) GROUP BY tool_name) f ON f.tool_name = s.tool_name""",
    "message_fact": """
        SELECT md5(conversation_id) AS message_key, d.session_key, partition_date AS date_key, c.project_id,
               conversation_id, c.session_id, role, turn_type, message_sequence, content_length,
               seconds_since_previous AS response_time_seconds, task_category, time_of_day, day_type, hour_of_day,
               day_of_week, has_code_block, has_url, is_question, effective_timestamp, partition_date, source_file
        FROM chat c LEFT JOIN session_dim d ON d.session_id = c.session_id""",
    "call_fact": """
        SELECT md5(conversation_id) AS tool_call_key, d.session_key, t.tool_key, partition_date AS date_key,
               u.project_id, conversation_id, u.session_id, u.tool_name, entry_type, is_invocation, is_result,
               tool_sequence, u.tool_category, is_file_operation, is_search_operation, is_shell_command, file_path,
               file_extension, file_type_category, content_length AS tool_content_length, estimated_execution_seconds,
               wait_us, hour_of_day, day_of_week, effective_timestamp, partition_date, source_file
        FROM usage u LEFT JOIN session_dim d ON d.session_id = u.session_id
             LEFT JOIN tool_dim t ON t.tool_name = u.tool_name""",
    "file_fact": """
        SELECT tool_call_key AS file_operation_key, session_key, tool_key, date_key, project_id, conversation_id,
               session_id, tool_name,
               CASE tool_name WHEN 'Read' THEN 'read' WHEN 'Write' THEN 'write' WHEN 'NotebookEdit' THEN 'write'
                    WHEN 'Edit' THEN 'edit' WHEN 'MultiEdit' THEN 'multi_edit' ELSE 'other' END AS operation_type,
               file_path, file_extension, file_type_category, tool_name = 'Read' AS is_read,
               tool_name = 'Write' AS is_write, tool_name = 'Edit' AS is_edit,
               tool_content_length AS operation_content_length, estimated_execution_seconds, hour_of_day, day_of_week,
               effective_timestamp, partition_date, source_file
        FROM call_fact WHERE is_file_operation""",
    "session_stats": """
        SELECT count(*) AS total_sessions, count(DISTINCT project_id) AS unique_projects,
               avg(us) / 1e6 / 60.0 AS avg_duration_minutes,
               quantile_cont(us, 0.5) / 6e7 AS median_duration_minutes,
               min(duration_minutes) AS min_duration_minutes, max(duration_minutes) AS max_duration_minutes,
               sum(us) / 6e7 AS total_duration_minutes, sum(us) / 3.6e9 AS total_duration_hours,
               avg(message_count) AS avg_messages_per_session, CAST(sum(message_count) AS BIGINT) AS total_messages,
               avg(user_message_count) AS avg_user_messages, avg(assistant_message_count) AS avg_assistant_messages,
               avg(tool_call_count) AS avg_tools_per_session, CAST(sum(tool_call_count) AS BIGINT) AS total_tool_calls,
               avg(unique_tools_used) AS avg_unique_tools,
               avg(avg_response_time_seconds) AS overall_avg_response_time_seconds,
               avg(messages_per_minute) AS avg_messages_per_minute, avg(tools_per_minute) AS avg_tools_per_minute
        FROM session_dim""",
    "session_cuts": """
        SELECT metric_type, metric_key, count(*) AS session_count, avg(us) / 1e6 / 60.0 AS avg_duration_minutes,
               avg(message_count) AS avg_messages, avg(tool_call_count) AS avg_tools,
               avg(messages_per_minute) AS avg_productivity, sum(us) / 3.6e9 AS total_hours
        FROM (UNPIVOT (SELECT us, message_count, tool_call_count, messages_per_minute,
                              session_duration_category AS by_duration_category, activity_level AS by_activity_level,
                              session_time_of_day AS by_time_of_day, session_day_type AS by_day_type FROM session_dim)
              ON by_duration_category, by_activity_level, by_time_of_day, by_day_type
              INTO NAME metric_type VALUE metric_key)
        GROUP BY ALL""",
    "session_metrics": """
        SELECT 'overall' AS metric_type, NULL AS metric_key, total_sessions, unique_projects, avg_duration_minutes,
               median_duration_minutes, total_duration_hours, avg_messages_per_session, total_messages,
               avg_tools_per_session, total_tool_calls, overall_avg_response_time_seconds,
               avg_messages_per_minute AS productivity_score
        FROM session_stats
        UNION ALL BY NAME
        SELECT metric_type, metric_key, session_count AS total_sessions, avg_duration_minutes,
               avg_messages AS avg_messages_per_session,
               if(metric_type = 'by_time_of_day', NULL, avg_tools) AS avg_tools_per_session,
               if(metric_type = 'by_time_of_day', avg_productivity, NULL) AS productivity_score
        FROM session_cuts WHERE metric_type <> 'by_day_type'""",
    "category_stats": """
        SELECT tool_category, count(*) AS total_calls, count(DISTINCT tool_name) AS unique_tools,
               count(DISTINCT session_id) AS sessions_used, avg(wait_us) / 1e6 AS avg_execution_seconds
        FROM call_fact GROUP BY tool_category""",
    "hour_stats": "SELECT tool_name, hour_of_day, count(*) AS call_count FROM call_fact GROUP BY ALL",
    "busiest": """
        SELECT tool_name, first(hour_of_day ORDER BY call_count DESC, hour_of_day) AS peak_hour,
               max(call_count) AS peak_hour_calls
        FROM hour_stats GROUP BY tool_name""",
    "efficiency": """
        SELECT f.tool_name, f.tool_category, d.tool_description, f.total_calls, f.sessions_used, f.projects_used,
               invocations, results,
               if(invocations > 0, round(100.0 * results / invocations, 2), NULL) AS success_rate_pct,
               CAST(round(CAST(mean AS DECIMAL(18, 3)), 3) AS DOUBLE) AS avg_execution_seconds,
               CAST(round(CAST(middle AS DECIMAL(18, 3)), 3) AS DOUBLE) AS median_execution_seconds,
               CAST(round(CAST(longest AS DECIMAL(18, 3)), 3) AS DOUBLE) AS max_execution_seconds,
               peak_hour, peak_hour_calls, d.popularity_rank, d.usage_tier, c.total_calls AS category_total_calls,
               round(100.0 * f.total_calls / c.total_calls, 2) AS pct_of_category
        FROM (SELECT tool_name, tool_category, count(*) AS total_calls, count(DISTINCT session_id) AS sessions_used,
                     count(DISTINCT project_id) AS projects_used, count(*) FILTER (is_invocation) AS invocations,
                     count(*) FILTER (is_result) AS results, avg(wait_us) / 1e6 AS mean,
                     quantile_cont(wait_us, 0.5) / 1e6 AS middle, max(estimated_execution_seconds) AS longest
              FROM call_fact GROUP BY ALL) f
        LEFT JOIN tool_dim d ON d.tool_name = f.tool_name
        LEFT JOIN category_stats c ON c.tool_category = f.tool_category
        LEFT JOIN busiest b ON b.tool_name = f.tool_name""",
    "change_cells": """
        SELECT aggregation_level, aggregation_key, count(*) AS total_operations,
               count(*) FILTER (is_read) AS read_operations, count(*) FILTER (is_write) AS write_operations,
               count(*) FILTER (is_edit) AS edit_operations, count(DISTINCT file_path) AS unique_files,
               count(DISTINCT file_extension) AS unique_extensions, count(DISTINCT session_id) AS sessions_with_file_ops,
               count(DISTINCT project_id) AS projects_with_file_ops, avg(operation_content_length) AS mean_length,
               CAST(sum(operation_content_length) AS BIGINT) AS total_content_length
        FROM (SELECT *, unnest(['overall', 'by_file_type', 'by_operation_type', 'by_extension']) AS aggregation_level,
                     unnest([NULL, file_type_category, operation_type, file_extension]) AS aggregation_key
              FROM file_fact)
        WHERE aggregation_level = 'overall' OR aggregation_key IS NOT NULL
        GROUP BY ALL""",
    "code_changes": """
        SELECT aggregation_level, aggregation_key, total_operations, read_operations, write_operations, edit_operations,
               round(100.0 * read_operations / total_operations, 2) AS read_pct,
               round(100.0 * write_operations / total_operations, 2) AS write_pct,
               round(100.0 * edit_operations / total_operations, 2) AS edit_pct,
               unique_files, unique_extensions, sessions_with_file_ops, projects_with_file_ops,
               CAST(round(CAST(mean_length AS DECIMAL(18, 3)), 0) AS DOUBLE) AS avg_content_length, total_content_length
        FROM change_cells
        QUALIFY aggregation_level <> 'by_extension' OR row_number() OVER (
            PARTITION BY aggregation_level ORDER BY total_operations DESC, aggregation_key) <= 20""",
    "daily": """
        SELECT d.date_key, year, month, week_of_year, day_of_week, day_name, is_weekend, is_weekday, year_month,
               ifnull(s.session_count, 0) AS session_count, ifnull(s.active_projects, 0) AS active_projects,
               ifnull(s.total_session_minutes, 0) AS total_session_minutes,
               CAST(round(CAST(ifnull(s.mean_minutes, 0) AS DECIMAL(18, 3)), 2) AS DOUBLE) AS avg_session_minutes,
               ifnull(m.message_count, 0) AS message_count, ifnull(m.user_messages, 0) AS user_messages,
               ifnull(m.assistant_messages, 0) AS assistant_messages,
               CAST(round(CAST(ifnull(m.mean_length, 0) AS DECIMAL(18, 3)), 0) AS DOUBLE) AS avg_content_length,
               ifnull(m.total_content_length, 0) AS total_content_length,
               ifnull(m.messages_with_code, 0) AS messages_with_code, ifnull(m.question_count, 0) AS question_count,
               ifnull(t.tool_call_count, 0) AS tool_call_count, ifnull(t.unique_tools_used, 0) AS unique_tools_used,
               ifnull(t.file_operations, 0) AS file_operations, ifnull(t.search_operations, 0) AS search_operations,
               ifnull(t.shell_commands, 0) AS shell_commands,
               CAST(round(CAST(ifnull(t.mean_seconds, 0) AS DECIMAL(18, 3)), 3) AS DOUBLE) AS avg_tool_execution_seconds,
               ifnull(f.file_operation_count, 0) AS file_operation_count, ifnull(f.file_reads, 0) AS file_reads,
               ifnull(f.file_writes, 0) AS file_writes, ifnull(f.file_edits, 0) AS file_edits,
               ifnull(f.unique_files_touched, 0) AS unique_files_touched,
               ifnull(round(ifnull(m.message_count, 0) / CAST(s.session_count AS DOUBLE), 2), 0) AS messages_per_session,
               ifnull(round(ifnull(t.tool_call_count, 0) / CAST(s.session_count AS DOUBLE), 2), 0) AS tools_per_session,
               s.session_count IS NOT NULL AS has_activity
        FROM days d
        LEFT JOIN (SELECT date_key, count(*) AS session_count, count(DISTINCT project_id) AS active_projects,
                          sum(us) / 6e7 AS total_session_minutes, avg(us) / 1e6 / 60.0 AS mean_minutes
                   FROM session_dim GROUP BY date_key) s USING (date_key)
        LEFT JOIN (SELECT date_key, count(*) AS message_count, count(*) FILTER (role = 'user') AS user_messages,
                          count(*) FILTER (role = 'assistant') AS assistant_messages, avg(content_length) AS mean_length,
                          CAST(sum(content_length) AS BIGINT) AS total_content_length,
                          count(*) FILTER (has_code_block) AS messages_with_code,
                          count(*) FILTER (is_question) AS question_count
                   FROM message_fact GROUP BY date_key) m USING (date_key)
        LEFT JOIN (SELECT date_key, count(*) AS tool_call_count, count(DISTINCT tool_name) AS unique_tools_used,
                          count(*) FILTER (is_file_operation) AS file_operations,
                          count(*) FILTER (is_search_operation) AS search_operations,
                          count(*) FILTER (is_shell_command) AS shell_commands,
                          avg(wait_us) / 1e6 AS mean_seconds
                   FROM call_fact GROUP BY date_key) t USING (date_key)
        LEFT JOIN (SELECT date_key, count(*) AS file_operation_count, count(*) FILTER (is_read) AS file_reads,
                          count(*) FILTER (is_write) AS file_writes, count(*) FILTER (is_edit) AS file_edits,
                          count(DISTINCT file_path) AS unique_files_touched
                   FROM file_fact GROUP BY date_key) f USING (date_key)""",
    "hourly": f"""
        SELECT g.hour_of_day, g.day_of_week, ({array(rules.DAY_NAMES)})[g.day_of_week + 1] AS day_name,
               if(g.day_of_week % 6 = 0, 'weekend', 'weekday') AS day_type, {clock("g.hour_of_day")} AS time_of_day,
               printf('%02d:00', g.hour_of_day) AS hour_label,
               ifnull(m.message_count, 0) AS message_count, ifnull(m.unique_sessions, 0) AS unique_sessions,
               ifnull(m.unique_projects, 0) AS unique_projects,
               CAST(round(CAST(ifnull(m.mean_length, 0) AS DECIMAL(18, 3)), 0) AS DOUBLE) AS avg_content_length,
               ifnull(m.user_messages, 0) AS user_messages, ifnull(m.assistant_messages, 0) AS assistant_messages,
               ifnull(m.messages_with_code, 0) AS messages_with_code, ifnull(t.tool_call_count, 0) AS tool_call_count,
               ifnull(t.unique_tools, 0) AS unique_tools, ifnull(t.file_operations, 0) AS file_operations,
               ifnull(t.search_operations, 0) AS search_operations, ifnull(t.shell_commands, 0) AS shell_commands,
               ifnull(s.session_starts, 0) AS session_starts,
               CAST(round(CAST(ifnull(s.mean_minutes, 0) AS DECIMAL(18, 3)), 2) AS DOUBLE) AS avg_session_duration,
               ifnull(m.message_count, 0) + ifnull(t.tool_call_count, 0) AS total_activity
        FROM (SELECT i // 7 AS hour_of_day, i % 7 AS day_of_week FROM range(168) r(i)) g
        LEFT JOIN (SELECT hour_of_day, day_of_week, count(*) AS message_count,
                          count(DISTINCT session_id) AS unique_sessions, count(DISTINCT project_id) AS unique_projects,
                          avg(content_length) AS mean_length, count(*) FILTER (role = 'user') AS user_messages,
                          count(*) FILTER (role = 'assistant') AS assistant_messages,
                          count(*) FILTER (has_code_block) AS messages_with_code
                   FROM messages GROUP BY ALL) m USING (hour_of_day, day_of_week)
        LEFT JOIN (SELECT hour_of_day, day_of_week, count(*) AS tool_call_count,
                          count(DISTINCT tool_name) AS unique_tools, count(*) FILTER (is_file_operation) AS file_operations,
                          count(*) FILTER (is_search_operation) AS search_operations,
                          count(*) FILTER (is_shell_command) AS shell_commands
                   FROM call_fact GROUP BY ALL) t USING (hour_of_day, day_of_week)
        LEFT JOIN (SELECT start_hour AS hour_of_day, start_day_of_week AS day_of_week, count(*) AS session_starts,
                          avg(us) / 1e6 / 60.0 AS mean_minutes
                   FROM session_dim GROUP BY ALL) s USING (hour_of_day, day_of_week)""",
}


def _needs(sql: str, blocks: dict[str, str]) -> list[str]:
    return [b for b in blocks if re.search(rf"\b(?:FROM|JOIN)\s+{b}\b", sql)]


def with_blocks(select: str, blocks: dict[str, str] | None = None) -> str:
    """The statement with every block it reads, directly or not, put in front."""
    blocks = blocks or BLOCKS
    chosen: list[str] = []

    def add(sql: str) -> None:
        for name in _needs(sql, blocks):
            if name not in chosen:
                add(blocks[name])
                if name not in chosen:
                    chosen.append(name)

    add(select)
    if not chosen:
        return select
    return "WITH " + ",\n".join(f"{n} AS ({blocks[n]})" for n in chosen) + "\n" + select


def columns_of(block: str, columns: list[str]) -> str:
    return with_blocks(f"SELECT {', '.join(columns)} FROM {block}")
