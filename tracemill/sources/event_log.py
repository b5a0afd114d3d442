"""Session-log tables derived from the generic `events` and `conversations` tables.

The test data holds no session logs, so these pure expressions turn each event into one
bronze row and each conversation turn into one log document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions import rules
from tracemill.functions.expressions import sql_list
from tracemill.schemas import BRONZE

# Message texts: one per task category, then code, link, question, two file paths.
TEMPLATES = [
    "Please fix the login page",
    "implement the export job",
    "Refactor the loader module",
    "run the TEST suite again",
    "document the table layout",
    "review my latest change",
    "hello there",
    "```python\nprint(1)\n```",
    "see http://example.com/page",
    "which one is faster?",
    '{"file_path": "/src/app/main.py"}',
    "/docs/readme.md",
]

TOOLS = [t[0] for t in rules.TOOL_CATEGORIES] + ["mcp_custom"]


# Each event as a bronze row. `at` is the event time, `day` its day of the month.
BRONZE_SQL = {
    "_id": "concat('e', event_id)",
    "type": """CASE event_type WHEN 'view' THEN 'user' WHEN 'click' THEN 'assistant'
               WHEN 'purchase' THEN 'tool_use' WHEN 'error' THEN 'tool_result'
               WHEN 'signup' THEN if(event_id % 2 = 0, 'system', NULL) END""",
    "session_id": "if(event_id % 97 = 0, NULL, concat('s', user_id, '-', if(user_id % 2 = 0, day, floor(day / 7))))",
    "project_id": "concat('p', if(user_id = 7, event_id % 2, user_id % 12))",
    "timestamp": "if(event_id % 50 = 0, NULL, at)",
    "ingested_at": "at + INTERVAL 5 MINUTES",
    "extracted_at": "at + INTERVAL 1 HOUR",
    "message_role": """CASE WHEN event_type IN ('view', 'error') THEN 'user'
                       WHEN event_type IN ('click', 'purchase') THEN 'assistant' END""",
    "message_content": f"""if(event_id % 41 = 0, NULL,
                       concat(get(array({sql_list(TEMPLATES)}), cast(event_id % 12 AS int)), ' ', props))""",
    "message_raw": "props",
    "tool_name": f"if(event_type = 'purchase', get(array({sql_list(TOOLS)}), cast(event_id % 17 AS int)), NULL)",
    "tool_id": "if(event_type = 'purchase', concat('t', event_id), NULL)",
    "tool_use_id": "if(event_type = 'error', concat('t', event_id - 1), NULL)",
}


def bronze_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    timed = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(
        "*", "cast(ts AS timestamp) AS at", "dayofmonth(ts) AS day"
    )
    rows = timed.selectExpr(*[f"{sql} AS {name}" for name, sql in BRONZE_SQL.items()])
    placed = rows.selectExpr(
        "*",
        "concat('/logs/projects/', project_id, '/', session_id, '.jsonl') AS source_file",
        "to_date(coalesce(timestamp, ingested_at)) AS date",
    )
    return placed.select(*BRONZE.fieldNames())


def documents_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same events as delivered documents; timestamps are ISO text."""
    b = bronze_from_events(spark, sf_dir)
    return b.select(
        "_id",
        "type",
        F.col("session_id").alias("sessionId"),
        F.col("project_id").alias("projectId"),
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"),
        F.col("ingested_at").alias("ingestedAt"),
        F.col("source_file").alias("sourceFile"),
        F.col("message_content").alias("message"),
    )


def json_text(value: Column) -> Column:
    """A string as a JSON string literal."""
    listed = F.to_json(F.array(value))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def documents_from_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn as a log document; the message shape rotates over all known shapes."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    text, role = json_text(F.col("text")), json_text(F.col("role"))
    turn = F.col("turn").cast("string")

    def block(*parts) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    text_block = block('{"type":"text","text":', text, "}")
    tool_use = block('{"type":"tool_use","id":"t', turn, '","name":"Read","input":{"path":"/a.py","line":', turn, "}}")
    empty_use = block('{"type":"tool_use","id":"t', turn, '","name":"TodoRead","input":{}}')
    nested = block(
        '{"type":"tool_result","tool_use_id":"t', turn, '","content":["head",{"type":"text","text":', text, '},{"type":"image"}]}'
    )
    shapes = [
        text,
        block('{"role":', role, ',"content":', text, "}"),
        block('{"role":', role, ',"content":["lead",', text_block, ',{"type":"thinking"},', text_block, "]}"),
        block('{"role":', role, ',"content":[', text_block, ",", tool_use, ",", text_block, ",", empty_use, "]}"),
        block('{"role":"user","content":[', nested, ",", text_block, "]}"),
        block('{"role":', role, ',"content":[{"type":"thinking"}]}'),
        F.lit("null"),
        block('{"role":', role, ',"content":', turn, "}"),
    ]
    message = F.get(F.array(*shapes), ((F.col("conv_id") + F.col("turn")) % len(shapes)).cast("int"))
    doc_id = F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("t"), turn)
    minute = F.lpad(F.pmod(F.col("turn"), F.lit(60)).cast("string"), 2, "0")
    stamp = F.when(F.col("turn") % 7 == 6, "not a time").otherwise(
        F.concat(F.lit("2024-03-01T10:"), minute, F.lit(":00Z"))
    )
    session = F.concat(F.lit("conv"), F.col("conv_id").cast("string"))
    return c.select(
        doc_id.alias("_id"),
        F.col("role").alias("type"),
        session.alias("sessionId"),
        F.concat(F.lit("p"), (F.col("conv_id") % 5).cast("string")).alias("projectId"),
        stamp.alias("timestamp"),
        F.lit("2024-03-02 00:00:00").cast("timestamp").alias("ingestedAt"),
        F.concat(F.lit("/logs/projects/p/"), session, F.lit(".jsonl")).alias("sourceFile"),
        F.concat(F.lit('{"type":'), role, F.lit(',"message":'), message, F.lit("}")).alias("entry"),
    )


def lines_from_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' entries as lines of a log; every fifth turn is cut off, every ninth is a bare number."""
    turn = F.regexp_extract("_id", r"t(\d+)$", 1).cast("bigint")
    line = F.when(turn % 5 == 4, F.expr("left(entry, length(entry) - 1)")).when(turn % 9 == 7, turn.cast("string")).otherwise(F.col("entry"))
    docs = documents_from_conversations(spark, sf_dir)
    return docs.select(F.col("sourceFile").alias("source_file"), (turn * 1000).alias("byte_offset"), line.alias("line"))
