"""Streams: log tail into the landing table, and windowed views of a document stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracemill.functions.expressions import parse_timestamp
from tracemill.operators.quality import write_dead_letters
from tracemill.schemas import DOCUMENT
from tracemill.sources import documents
from tracemill.sources.session_log import Positions


def deliver(dead_letters: str, landing: str, stream: str, only_new: bool = False):
    """Batch writer: documents to their batch folder, malformed lines to the dead letters.

    The checkpoint fixes which bytes a batch holds, and the batch number names the folder,
    so a batch that runs twice leaves the documents once. With `only_new`, documents whose id
    any stream has delivered before are left out.
    """
    put = documents.insert_landing if only_new else documents.write_landing

    def write(lines: DataFrame, batch: int) -> None:
        now = F.current_timestamp()
        put(documents.to_documents(lines, now), landing, batch, stream)
        bad = documents.malformed(lines)
        write_dead_letters(bad, f"{dead_letters}/stream={stream}/batch={batch}", F.to_date(now), "malformed line", "overwrite")

    return write


def start_tail(
    spark: SparkSession,
    logs: str,
    landing: str,
    checkpoint: str,
    dead_letters: str,
    interval: str | None = "5 seconds",
    only_new: bool = True,
    **options: str,
) -> StreamingQuery:
    """Follow the logs. Without an interval: read one batch of what is there and stop.
    Files that are read again, say after the checkpoint was lost, add no document twice.

    The positions reached are stored beside the checkpoint; the two belong together.
    """
    positions = documents.qualified(spark, f"{checkpoint.rstrip('/')}_positions")
    writer = (
        documents.stream_log(spark, logs, positions, **options)
        .writeStream.foreachBatch(deliver(dead_letters, landing, Positions(positions).stream_id(), only_new))
        .option("checkpointLocation", checkpoint)
    )
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start()


def tail_once(spark: SparkSession, logs: str, landing: str, checkpoint: str, dead_letters: str, **options: str) -> None:
    """Read all that is there, batch after batch."""
    while True:
        query = start_tail(spark, logs, landing, checkpoint, dead_letters, interval=None, **options)
        query.awaitTermination()
        if not sum(p.numInputRows for p in query.recentProgress):
            break


def stream_landing(spark: SparkSession, landing: str) -> DataFrame:
    """Delivered documents as a stream; landing files never change once written."""
    return spark.readStream.schema(DOCUMENT).option("recursiveFileLookup", "true").parquet(landing)


def with_event_time(docs: DataFrame, lateness: str = "1 day") -> DataFrame:
    at = F.coalesce(parse_timestamp(F.col("timestamp")), F.col("ingestedAt"))
    return docs.withColumn("event_time", at).withWatermark("event_time", lateness)


def without_repeats(docs: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Each document id once, as long as repeats come within the lateness."""
    return with_event_time(docs, lateness).dropDuplicatesWithinWatermark(["_id"])


def activity_stream(docs: DataFrame, period: str = "1 hour", lateness: str = "1 day") -> DataFrame:
    """User and assistant messages per project and tumbling period."""
    return (
        with_event_time(docs, lateness)
        .groupBy("projectId", F.window("event_time", period))
        .agg(
            F.count_if(F.col("type") == "user").alias("user"),
            F.count_if(F.col("type") == "assistant").alias("assistant"),
        )
        .select("projectId", F.col("window.start").alias("period_start"), "user", "assistant")
    )


def progress(query: StreamingQuery) -> dict:
    """Counters of a stream: latest batch, its time, state, and rows over the batches that Spark still
    remembers (a hundred); the landing table has the total."""
    last = query.lastProgress
    return {
        "batch": last.batchId if last else None,
        "recent_rows": sum(p.numInputRows for p in query.recentProgress),
        "at": last.timestamp if last else None,
        "active": query.isActive,
    }
