"""SQL for documents, searches, merges, flattening, key figures and checks."""

from __future__ import annotations

from oracle.models import BLOCKS, columns_of, quoted, with_blocks
from tracemill.plans import checks, silver

DOCUMENTS = """
    SELECT _id, type, session_id AS "sessionId", project_id AS "projectId",
           strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%gZ') AS timestamp, ingested_at AS "ingestedAt",
           source_file AS "sourceFile", message_content AS message
    FROM bronze"""

# Documents made from conversation turns, one row per content block. `kind` is null where a
# document has no block.
TURN_BLOCKS = """
    SELECT *, 0 AS i, role AS kind, text AS content, text AS spaced, NULL AS raw, NULL AS name, NULL AS call, NULL AS answers
    FROM turns WHERE shape = 0
    UNION ALL SELECT *, 0, role, text, text, CAST(json_object('role', role, 'content', text) AS VARCHAR), NULL, NULL, NULL
    FROM turns WHERE shape = 1
    UNION ALL SELECT *, 0, role, both_texts, both_texts, NULL, NULL, NULL, NULL FROM turns WHERE shape = 2
    UNION ALL SELECT turns.*, i, role, text, text, NULL, NULL, NULL, NULL
    FROM turns, (VALUES (0), (2)) v(i) WHERE shape = 3
    UNION ALL SELECT *, 1, 'tool_use', '{"path":"/a.py","line":' || turn || '}', '{"path": "/a.py", "line": ' || turn || '}',
                     '{"type":"tool_use","id":"t' || turn || '","name":"Read","input":{"path":"/a.py","line":' || turn || '}}',
                     'Read', 't' || turn, NULL
    FROM turns WHERE shape = 3
    UNION ALL SELECT *, 3, 'tool_use', NULL, NULL,
                     '{"type":"tool_use","id":"t' || turn || '","name":"TodoRead","input":{}}', 'TodoRead', 't' || turn, NULL
    FROM turns WHERE shape = 3
    UNION ALL SELECT *, 0, 'tool_result', 'head' || chr(10) || text, 'head' || chr(10) || text,
                     '{"type":"tool_result","tool_use_id":"t' || turn || '","content":["head",{"type":"text","text":'
                     || CAST(to_json(text) AS VARCHAR) || '},{"type":"image"}]}', NULL, NULL, 't' || turn
    FROM turns WHERE shape = 4
    UNION ALL SELECT *, 1, 'user', text, text, NULL, NULL, NULL, NULL FROM turns WHERE shape = 4
    UNION ALL SELECT *, 0, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM turns WHERE shape IN (5, 6)
    UNION ALL SELECT *, 0, role, CAST(turn AS VARCHAR), CAST(turn AS VARCHAR),
                     CAST(json_object('role', role, 'content', turn) AS VARCHAR), NULL, NULL, NULL
    FROM turns WHERE shape = 7"""


def flat(content: str) -> str:
    return f"""
    SELECT doc || if(i = 0, '', '_' || i) AS _id,
           if(kind IN ('tool_use', 'tool_result'), kind, role) AS type,
           'conv' || conv_id AS session_id, 'p' || conv_id % 5 AS project_id, stamp AS timestamp,
           TIMESTAMP '2024-03-02' AS ingested_at, TIMESTAMP '2024-03-03' AS extracted_at,
           CASE kind WHEN 'tool_use' THEN 'assistant' WHEN 'tool_result' THEN 'user' WHEN 'user' THEN 'user'
                WHEN 'assistant' THEN 'assistant' END AS message_role,
           {content} AS message_content, raw AS message_raw, '/logs/projects/p/conv' || conv_id || '.jsonl' AS source_file,
           if(stamp IS NULL, DATE '2024-03-02', DATE '2024-03-01') AS date,
           name AS tool_name, call AS tool_id, answers AS tool_use_id
    FROM turn_blocks"""


ALL = {
    **BLOCKS,
    "docs": DOCUMENTS,
    "turns": """
        SELECT *, (conv_id + turn) % 8 AS shape, 'c' || conv_id || 't' || turn AS doc,
               'lead' || chr(10) || text || chr(10) || text AS both_texts,
               if(turn % 7 = 6, NULL, TIMESTAMP '2024-03-01 10:00:00' + to_minutes(turn % 60)) AS stamp
        FROM conversations""",
    "turn_blocks": TURN_BLOCKS,
    "flat_compact": flat("content"),
    "flat_spaced": flat("spaced"),
    "again": """
        SELECT * REPLACE (extracted_at + INTERVAL 1 DAY AS extracted_at, 'again ' || tool_id AS message_content,
                          CAST(date + 1 AS DATE) AS date)
        FROM bronze WHERE type = 'tool_use'""",
}
FLAT = {**ALL, "bronze": "SELECT * FROM flat_spaced"}

WORD = r"[^\p{L}\p{N}_]"


def has_word(text: str, word: str) -> str:
    return f"regexp_matches({text}, {quoted(f'(^|{WORD}){word}({WORD}|$)')}, 'i')"


def sql(select: str) -> str:
    return with_blocks(select, ALL)


def landing_search(where: str) -> str:
    """Conversation documents of one project by their text; the shapes are those of the test documents."""
    return f"""
        WITH texts AS (
            SELECT 'c' || conv_id || 't' || turn AS _id, 'conv' || conv_id AS "sessionId",
                   CASE (conv_id + turn) % 8
                       WHEN 2 THEN 'lead' || chr(10) || text || chr(10) || text
                       WHEN 3 THEN text || chr(10) || text
                       WHEN 4 THEN 'head' || chr(10) || text || chr(10) || text
                       WHEN 5 THEN '' WHEN 6 THEN NULL WHEN 7 THEN CAST(turn AS VARCHAR) ELSE text END AS message
            FROM conversations WHERE conv_id % 5 = 3)
        SELECT * FROM texts WHERE {where}"""


def page(where: str, limit: int, order: str) -> str:
    return sql(
        f"""SELECT * EXCLUDE (total, cursor_row), total > {limit} AS has_more,
                   if(total > {limit}, to_base64(encode(cursor_row)), NULL) AS next_cursor
            FROM (SELECT d.*, count(*) OVER () AS total,
                         nth_value(d.timestamp || '|' || d._id, {limit}) OVER
                             (ORDER BY d.timestamp {order}, d._id {order} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
                             AS cursor_row
                  FROM docs d WHERE {where})
            ORDER BY timestamp {order}, _id {order} LIMIT {limit}"""
    )


def chart(period: str, label: str, where: str, periods: int, extra: str = "") -> str:
    return (
        f"SELECT {label} AS period, p AS \"periodStart\", u AS \"user\", a AS assistant{extra} FROM ("
        f"SELECT strftime(CAST(timestamp AS TIMESTAMP), {quoted(period)}) AS p, count(*) FILTER (type = 'user') AS u, "
        f"count(*) FILTER (type = 'assistant') AS a FROM docs WHERE timestamp IS NOT NULL AND \"projectId\" = 'p3' {where} "
        f"GROUP BY 1 ORDER BY 1 DESC LIMIT {periods})"
    )


WEEK = "AND timestamp >= '2024-01-08' AND timestamp < '2024-01-15'"
DAY_LABEL = "strftime(CAST(p AS DATE), '%b ') || day(CAST(p AS DATE))"
HOUR_LABEL = "strftime(CAST(p AS TIMESTAMP), '%b ') || day(CAST(p AS TIMESTAMP)) || strftime(CAST(p AS TIMESTAMP), ' %H:%M')"

MODEL_BLOCKS = {
    "bronze": "bronze", "tool_categories": "seed", "stg_conversations": "entries", "stg_messages": "chat",
    "stg_tool_calls": "calls", "int_messages_enriched": "chat", "int_sessions_computed": "sessions",
    "int_tool_usage": "usage", "dim_date": "days", "dim_projects": "projects", "dim_sessions": "session_dim",
    "dim_tools": "tool_dim", "fct_messages": "message_fact", "fct_tool_calls": "call_fact",
    "fct_file_operations": "file_fact", "agg_session_metrics": "session_metrics",
    "agg_tool_efficiency": "efficiency", "agg_code_changes": "code_changes", "agg_daily_summary": "daily",
    "agg_hourly_activity": "hourly",
}


def literal(value) -> str:
    return quoted(value) if isinstance(value, str) else str(value)


def check(suite: str, name: str, column: str, failed: str, total: str, source: str) -> str:
    return (
        f"SELECT {quoted(suite)} AS suite, {quoted(name)} AS \"check\", {quoted(column)} AS \"column\", "
        f"CAST({failed} AS BIGINT) AS failed, CAST({total} AS BIGINT) AS total, {failed} = 0 AS success FROM {source}"
    )


def row_check(suite: str, name: str, column: str, bad: str, block: str) -> str:
    return check(suite, name, column, f"count(*) FILTER ({bad})", "count(*)", block)


def is_null(suite: str, column: str, block: str) -> str:
    # The load stamp is not part of the SQL models; it is never null.
    bad = "false" if column == "computed_at" else f"{column} IS NULL"
    return row_check(suite, "not_null", column, bad, block)


def outside(suite: str, column: str, values: list, block: str) -> str:
    listed = ", ".join(literal(v) for v in values)
    return row_check(suite, "accepted_values", column, f"{column} NOT IN ({listed})", block)


def repeated(suite: str, column: str, block: str) -> str:
    failed = f"(SELECT count(*) FROM (SELECT {column} FROM {block} WHERE {column} IS NOT NULL GROUP BY 1 HAVING count(*) > 1))"
    return check(suite, "unique", column, failed, f"(SELECT count({column}) FROM {block})", "(SELECT 1) one")


def declared(models: list[str]) -> str:
    parts = []
    for m in models:
        rules, block = checks.DECLARED[m], MODEL_BLOCKS[m]
        parts += [is_null(m, c, block) for c in rules.get("not_null", [])]
        parts += [outside(m, c, v, block) for c, v in rules.get("accepted", {}).items()]
        parts += [repeated(m, c, block) for c in rules.get("unique", [])]
        parts += [
            row_check(
                m, "relationships", c, f"{c} NOT IN (SELECT {key} FROM {MODEL_BLOCKS[parent]})",
                f"(SELECT {c} FROM {block} WHERE {c} IS NOT NULL) child",
            )
            for c, (parent, key) in rules.get("refers", {}).items()
        ]
    return sql("\nUNION ALL ".join(parts))


BRONZE_SUITE = "\nUNION ALL ".join(
    [
        check("bronze", "columns_match_set", "", "0", "15", "(SELECT 1) one"),
        *[is_null("bronze", c, "bronze") for c in ("_id", "type", "extracted_at", "date")],
        outside("bronze", "type", checks.BRONZE_TYPES, "bronze"),
        repeated("bronze", "_id", "bronze"),
        check("bronze", "row_count_between", "", "0", "count(*)", "bronze"),
    ]
)
SILVER_SUITE = "\nUNION ALL ".join(
    [
        is_null("silver", "conversation_id", "entries"),
        outside("silver", "entry_type", checks.STAGED_TYPES, "entries"),
        is_null("silver", "effective_timestamp", "entries"),
        outside("silver", "task_category", checks.TASKS, "messages"),
        outside("silver", "time_of_day", checks.TIMES, "messages"),
        row_check("silver", "between", "hour_of_day", "hour_of_day NOT BETWEEN 0 AND 23", "messages"),
        row_check("silver", "between", "day_of_week", "day_of_week NOT BETWEEN 0 AND 6", "messages"),
        outside("silver", "session_duration_category", checks.DURATIONS, "sessions"),
        outside("silver", "activity_level", checks.LEVELS, "sessions"),
        check("silver", "column_type", "duration_seconds", "0", "1", "(SELECT 1) one"),
    ]
)

LOG_ORACLE: dict[str, str] = {
    "page_newest": page("\"projectId\" = 'p3'", 50, "DESC"),
    "page_after_cursor": page(
        "\"projectId\" = 'p3' AND (timestamp, _id) < ('2024-01-15T06:00:00.000Z', 'e5')", 20, "DESC"
    ),
    "page_oldest_of_week": page(f"\"projectId\" = 'p3' {WEEK}", 100, "ASC"),
    "page_last": page("\"sessionId\" = 's27-2' AND \"projectId\" = 'p3'", 100, "ASC NULLS FIRST"),
    "match_count": sql(f"SELECT count(*) AS total FROM docs WHERE \"projectId\" = 'p3' {WEEK}"),
    "search_words": sql(
        f"""SELECT * FROM docs WHERE "projectId" = 'p3' AND NOT {has_word('message', 'suite')}
            AND ({has_word('message', 'loader')} OR {has_word('message', 'review')})"""
    ),
    "search_phrase": sql(
        """SELECT * FROM docs WHERE "projectId" = 'p3' AND message ILIKE '%login page%' AND timestamp >= '2024-01-03'"""
    ),
    "search_excluding": sql(
        f"""SELECT * FROM docs WHERE "projectId" = 'p3' AND timestamp < '2024-01-21' AND NOT {has_word('message', 'document')}
            AND ({has_word('message', 'k')} OR {has_word('message', 'table')})"""
    ),
    "export_rows": sql(
        """SELECT * FROM docs WHERE "projectId" = 'p3'
           AND "ingestedAt" BETWEEN TIMESTAMP '2024-01-08' AND TIMESTAMP '2024-01-14'
           ORDER BY "ingestedAt" DESC, _id DESC"""
    ),
    "activity_by_hour": sql(chart("%Y-%m-%dT%H:00", HOUR_LABEL, "", 90)),
    "activity_by_day": sql(chart("%Y-%m-%d", DAY_LABEL, WEEK, 14)),
    "activity_by_week": sql(
        chart(
            "%G-W%V", "p", "", 14,
            ", CAST(strptime(p || '-1', '%G-W%V-%u') AS DATE) AS first_day"
            ", CAST(strptime(p || '-7', '%G-W%V-%u') AS DATE) AS last_day",
        )
    ),
    "activity_total": sql(
        f"SELECT CAST(sum(\"user\" + assistant) AS BIGINT) AS \"totalMessages\" FROM ({chart('%Y-%m-%d', 'p', '', 14)}) c"
    ),
    "project_list": sql("SELECT DISTINCT \"projectId\" FROM docs"),
    "session_list": sql(
        "SELECT DISTINCT \"sessionId\" FROM docs WHERE \"projectId\" = 'p3' AND length(\"sessionId\") > 0"
    ),
    "search_landing": landing_search(
        f"({has_word('message', 'lead')} OR {has_word('message', 'head')}) AND NOT {has_word('message', 'und')}"
    ),
    "search_landing_keys": landing_search(" OR ".join(has_word("message", w) for w in ("role", "content", "type", "text"))),
    "log_documents": """SELECT md5(concat('/logs/projects/p/conv', conv_id, '.jsonl:', turn * 1000)) AS _id,
            role AS type, CAST(NULL AS VARCHAR) AS "sessionId", 'p' AS "projectId", CAST(NULL AS VARCHAR) AS timestamp,
            TIMESTAMP '2024-01-31' AS "ingestedAt", concat('/logs/projects/p/conv', conv_id, '.jsonl') AS "sourceFile"
        FROM conversations WHERE turn % 5 <> 4 AND turn % 9 <> 7""",
    "log_malformed": """SELECT concat('/logs/projects/p/conv', conv_id, '.jsonl') AS source_file,
            CAST(turn * 1000 AS BIGINT) AS byte_offset
        FROM conversations WHERE turn % 5 = 4 OR turn % 9 = 7""",
    "documents_per_project": sql("SELECT \"projectId\", count(*) AS count FROM docs GROUP BY 1"),
    "text_search": f"""SELECT doc_id, lang, length(text) AS length FROM documents
        WHERE ({has_word('text', 'test')} OR {has_word('text', 'the')}) AND NOT {has_word('text', 'und')}""",
    "documents_since": sql("SELECT * FROM docs WHERE \"ingestedAt\" >= TIMESTAMP '2024-01-20 12:00:00'"),
    "documents_retained": sql(
        """SELECT * FROM docs WHERE "ingestedAt" > TIMESTAMP '2024-01-20 12:00:00'
           OR "ingestedAt" >= TIMESTAMP '2024-01-25' - INTERVAL 7 DAY"""
    ),
    "ingest_status": sql(
        """SELECT count(*) FILTER ("ingestedAt" > m) AS pending, count(*) FILTER ("ingestedAt" <= m) AS synced,
                  max("ingestedAt") FILTER ("ingestedAt" <= m) AS last_sync_at
           FROM (SELECT *, TIMESTAMP '2024-01-20 12:00:00' AS m FROM docs)"""
    ),
    "table_date_range": sql(
        """SELECT count(*) AS row_count, min(date) AS min_date, max(date) AS max_date,
                  count(DISTINCT date) AS date_count FROM bronze"""
    ),
    "table_top_projects": sql(
        "SELECT project_id, count(*) AS count FROM bronze GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"
    ),
    "table_type_distribution": sql("SELECT type, count(*) AS count FROM bronze GROUP BY 1"),
    "upsert_result": sql("SELECT * FROM again UNION ALL SELECT * FROM bronze WHERE type IS DISTINCT FROM 'tool_use'"),
    "latest_versions": sql("SELECT * FROM again"),
    "insert_only_delivery": sql("SELECT * FROM bronze WHERE type = 'tool_result'"),
    "late_window": sql(
        """SELECT conversation_id, session_id, session_key, partition_date, role, content_length FROM message_fact
           WHERE partition_date >= (SELECT max(partition_date) FROM entries) - 1"""
    ),
    "flatten_documents": sql("SELECT * EXCLUDE (message_raw) FROM flat_spaced"),
    "flatten_documents_compact": sql("SELECT * FROM flat_compact"),
    "messages_of_documents": with_blocks(f"SELECT {', '.join(silver.ENRICHED_COLUMNS)} FROM chat", FLAT),
    "messages_of_documents_split": with_blocks(f"SELECT {', '.join(silver.ENRICHED_COLUMNS)} FROM chat", FLAT),
    "turns_per_session": columns_of("session_dim", ["session_id", "project_id", "user_message_count AS turns"]),
    "active_sessions": sql(
        """SELECT strftime(effective_timestamp, '%Y-%m-%d') AS period, count(DISTINCT session_id) AS active_sessions
           FROM messages GROUP BY 1"""
    ),
    "tool_share": sql(
        """SELECT tool_name, count(*) AS calls, count(*) / CAST((SELECT count(*) FROM call_fact) AS DOUBLE) AS share
           FROM call_fact GROUP BY tool_name"""
    ),
    "files_per_session": sql("SELECT session_id, count(DISTINCT file_path) AS files FROM file_fact GROUP BY 1"),
    "edit_frequency": sql(
        """SELECT s.session_id, s.project_id, ifnull(e.n, 0) AS edits,
                  if(us = 0, NULL, ifnull(e.n, 0) / duration_hours) AS edits_per_hour
           FROM session_dim s LEFT JOIN (SELECT session_id, count(*) AS n FROM file_fact WHERE is_edit GROUP BY 1) e
                USING (session_id)"""
    ),
    "daily_hours": sql(
        """SELECT partition_date AS date_key, count(*) AS active_hours, first(hour_of_day ORDER BY n DESC, hour_of_day) AS peak_hour
           FROM (SELECT partition_date, hour_of_day, count(*) AS n FROM messages GROUP BY ALL) GROUP BY 1"""
    ),
    "projects_per_day": sql(
        "SELECT partition_date AS date_key, count(DISTINCT project_id) AS projects FROM entries GROUP BY 1"
    ),
    "paired_tool_calls": sql(
        """SELECT *, (epoch_us(result_at) - epoch_us(called_at)) / 1e6 AS execution_seconds
           FROM (SELECT c.conversation_id, c.session_id, c.tool_name, c.tool_id, c.effective_timestamp AS called_at,
                        min(r.effective_timestamp) AS result_at, count(r.conversation_id) > 0 AS has_result
                 FROM calls c LEFT JOIN calls r ON r.is_result AND r.tool_use_id = c.tool_id
                 WHERE c.is_invocation AND c.tool_id IS NOT NULL GROUP BY ALL)"""
    ),
    "task_category_by_word": sql("SELECT word_category AS task_category, count(*) AS count FROM messages GROUP BY 1"),
    "bronze_suite": sql(BRONZE_SUITE),
    "silver_suite": sql(SILVER_SUITE),
    "suite_checkpoint": sql(
        f"""SELECT ifnull(suite, 'all') AS suite, count(*) AS checks, count(*) FILTER (success) AS passed,
                   bool_and(success) AS success
            FROM ({BRONZE_SUITE} UNION ALL {SILVER_SUITE}) r GROUP BY ROLLUP (suite)"""
    ),
    "timestamp_order": sql(
        row_check("stg_conversations", "not_before", "ingested_at", "ingested_at < original_timestamp", "entries")
        + " UNION ALL "
        + row_check("stg_conversations", "not_before", "original_timestamp", "original_timestamp < ingested_at", "entries")
    ),
    "source_freshness": sql(
        """SELECT latest, hours AS age_hours,
                  CASE WHEN hours <= 24 THEN 'pass' WHEN hours <= 48 THEN 'warn' ELSE 'error' END AS status
           FROM (SELECT max(extracted_at) AS latest,
                        (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(max(extracted_at))) / 3.6e9 AS hours FROM bronze)"""
    ),
    "rejected_rows": sql(
        """SELECT _id, type, date FROM bronze
           WHERE type IS NULL OR type NOT IN ('user', 'assistant', 'tool_use', 'tool_result')"""
    ),
}
