"""Queries that write tables, change them and read them back."""

from __future__ import annotations

import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.operators.flatten import flatten_documents
from tracemill.operators.search import LogFilter
from tracemill.operators.text_index import TextIndex
from tracemill.plans.catalog import Options
from tracemill.plans.delta import DeltaState
from tracemill.schemas import BRONZE
from tracemill.sources import documents, event_log
from tracemill.sources.scratch import scratch_folder
from tracemill.sources.snapshots import SnapshotTable

AS_OF = datetime.date(2024, 2, 1)
EXTRACTED_AT = datetime.datetime(2024, 3, 3, tzinfo=datetime.timezone.utc)
SEARCHES = ["lead heads -und", '"que la"', '"des la" the -et', "tables thes des -le -lead"]
LATEST = ("extracted_at", "ingested_at")


def search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation documents in two deliveries, the first one twice; four searches through the index."""
    docs = event_log.documents_from_conversations(spark, sf_dir)
    index = TextIndex(spark, scratch_folder(spark, "search-index"))
    even = F.crc32("_id") % 2 == 0
    for delivery, part in (("a/0", docs.where(even)), ("a/0", docs.where(even)), ("a/1", docs.where(~even))):
        index.add(part, delivery)
    found = [index.matching(LogFilter("p3", search=s)).select("_id", "sessionId", F.lit(s).alias("search")) for s in SEARCHES]
    return reduce(DataFrame.unionByName, found)


def _bronze(spark: SparkSession, folder: str) -> SnapshotTable:
    return SnapshotTable(spark, f"{folder}/bronze", BRONZE, "date", ("project_id", "timestamp"), ("session_id",), "ingested_at")


def _again(rows: DataFrame) -> DataFrame:
    """The calls extracted once more, later and with new text, on the next day."""
    return rows.where(F.col("type") == "tool_use").withColumns(
        {
            "extracted_at": F.col("extracted_at") + F.expr("INTERVAL 1 DAY"),
            "message_content": F.concat(F.lit("again "), "tool_id"),
            "date": F.date_add("date", 1),
        }
    )


def _rows(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """Conversations as log documents, flattened and stored, as upserts read their rows several times
    and flattening is most of the work."""
    docs = event_log.documents_from_conversations(spark, sf_dir)
    rows = flatten_documents(docs, F.lit(EXTRACTED_AT), python_json=False)
    rows.write.parquet(f"{folder}/rows")
    return spark.read.schema(rows.schema).parquet(f"{folder}/rows")


def table_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written, merged, pruned and compacted; the rows of all four versions, each read as of its number.

    The first version's reader is opened before the table changes.
    """
    folder = scratch_folder(spark, "table-versions")
    rows, table = _rows(spark, sf_dir, folder), _bronze(spark, folder)
    table.append(rows, tag="first")
    table.append(rows, tag="first")
    before = table.read()
    table.upsert(_again(rows).unionByName(rows.where(F.col("type") == "tool_use")), "_id", LATEST)
    table.delete(F.col("type") == "tool_result")
    table.compact(files_at_most=0)
    parts = [before, *[table.read(v) for v in (2, 3, 4)]]
    return reduce(DataFrame.unionByName, [p.select(F.lit(v).alias("version"), "_id", "type", "session_id", "date", "message_content") for v, p in enumerate(parts, 1)])


def delta_tool_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tools from state tables after a delta of late rows, of older versions that lay in another session,
    and of a new day."""
    folder = scratch_folder(spark, "delta-models")
    rows, table = _rows(spark, sf_dir, folder), _bronze(spark, folder)
    late, last = F.crc32("_id") % 10 == 0, F.col("date") >= "2024-03-02"
    names = ("usage_cells", "duration_counts", "file_cells", "activity_rollup")
    state = DeltaState(spark, table, f"{folder}/state", f"{folder}/models", f"{folder}/staging", Options(as_of=AS_OF), names)
    older = rows.where(late).withColumns({"extracted_at": F.col("extracted_at") - F.expr("INTERVAL 1 DAY"), "session_id": F.lit("moved"), "message_content": F.lit("older")})
    table.overwrite(rows.where(~late & ~last).unionByName(older))
    state.refresh()
    table.upsert(rows.where(late | last), "_id", LATEST)
    state.refresh()
    return state.models()["agg_tool_efficiency"]


def landing_inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation documents delivered in two batches, then all again by another stream with new content,
    and a batch that runs twice: every id once, as first delivered, with its stream and batch."""
    path = f"{scratch_folder(spark, 'landing')}/landing"
    docs = event_log.documents_from_conversations(spark, sf_dir)
    even = F.crc32("_id") % 2 == 0
    documents.insert_landing(docs.where(even), path, 0, "a")
    documents.insert_landing(docs.unionByName(docs.withColumn("timestamp", F.lit(""))), path, 1, "a")
    documents.insert_landing(docs.where(even), path, 1, "a")
    documents.insert_landing(docs.withColumn("entry", F.lit("{}")), path, 0, "b")
    return documents.read_landing(spark, path).select("_id", "type", "sessionId", "projectId", "timestamp", "stream", "batch", F.sha2("entry", 256).alias("entry"))
