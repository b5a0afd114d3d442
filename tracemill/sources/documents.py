"""Log lines to documents, and the landing table of delivered documents."""

from __future__ import annotations

import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.functions import rules
from tracemill.operators.merge import insert_new, table_exists
from tracemill.schemas import DOCUMENT
from tracemill.sources.session_log import SessionLogSource
from tracemill.sources.snapshots import SnapshotTable

RETENTION_DAYS = 7
ENTRY = "_id string, type string, sessionId string, timestamp string"


def qualified(spark: SparkSession, path: str) -> str:
    """The path with scheme and authority, on the file system that Spark resolves it to."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toString()


def read_log(spark: SparkSession, path: str, **options: str) -> DataFrame:
    spark.dataSource.register(SessionLogSource)
    return spark.read.format("session_log").options(**options).load(qualified(spark, path))


def stream_log(spark: SparkSession, path: str, positions: str, **options: str) -> DataFrame:
    """Lines as they come. `positions` is a folder of the stream's own, kept as long as its checkpoint."""
    spark.dataSource.register(SessionLogSource)
    options = options | {"positions": qualified(spark, positions)}
    return spark.readStream.format("session_log").options(**options).load(qualified(spark, path))


def project_id(path: Column) -> Column:
    found = F.regexp_extract(path, rules.PROJECT_REGEX, 1)
    return F.when(found == "", "unknown").otherwise(found)


def is_entry(line: Column) -> Column:
    """The line holds one JSON object."""
    parsed = F.try_parse_json(line)
    return F.coalesce(F.try_variant_get(parsed, "$", "map<string,variant>").isNotNull(), F.lit(False))


def not_blank(lines: DataFrame) -> DataFrame:
    return lines.where(F.trim(F.regexp_replace("line", r"\s+", "")) != "")


def to_documents(lines: DataFrame, ingested_at: Column) -> DataFrame:
    """Documents of well-formed lines. A line without an id of its own gets one made from
    its place in the file, the same on every replay."""
    e = F.from_json("line", ENTRY)
    own = F.nullif(e["_id"], F.lit(""))
    place = F.md5(F.concat_ws(":", "source_file", F.col("byte_offset").cast("string")))
    columns = {
        "_id": F.coalesce(own, place),
        "type": e["type"],
        "sessionId": e["sessionId"],
        "projectId": project_id(F.col("source_file")),
        "timestamp": e["timestamp"],
        "ingestedAt": ingested_at,
        "sourceFile": F.col("source_file"),
        "entry": F.col("line"),
    }
    good = lines.where(is_entry(F.col("line")))
    return good.select(*[columns[f.name].alias(f.name) for f in DOCUMENT.fields])


def malformed(lines: DataFrame) -> DataFrame:
    return not_blank(lines).where(~is_entry(F.col("line")))


def write_landing(docs: DataFrame, path: str, batch: int, stream: str = "manual") -> None:
    """Each delivery of a stream has its own folder; a repeated delivery replaces it, so nothing is
    stored twice, and a new stream, which counts from 0 again, does not replace another's. Files are
    sorted by project, so a filter on it skips row groups."""
    docs.sortWithinPartitions("projectId", "timestamp").write.mode("overwrite").parquet(f"{path}/stream={stream}/batch={batch}")


KEYS = T.StructType([T.StructField("_id", T.StringType()), T.StructField("bucket", T.IntegerType())])
KEY_BUCKETS = 64
#: Up to so many ids of a delivery are looked up by their Bloom filters; more are joined.
LOOKED_UP = 1000


def landing_keys(spark: SparkSession, path: str) -> SnapshotTable:
    """Ids of all delivered documents, beside the landing table: bucketed, sorted, with Bloom filters."""
    return SnapshotTable(spark, f"{path.rstrip('/')}_keys", KEYS, "bucket", ("_id",), ("_id",), bloom=("_id",))


def _with_bucket(ids: DataFrame) -> DataFrame:
    return ids.select("_id").distinct().withColumn("bucket", F.pmod(F.xxhash64("_id"), F.lit(KEY_BUCKETS)).cast("int"))


def _known(keys: SnapshotTable, incoming: DataFrame) -> DataFrame:
    """Those of the incoming ids that were delivered before. Buckets, file bounds and, for small
    deliveries, Bloom filters keep most of the key table unread; for large ones both sides are joined by bucket and id."""
    by_bucket = incoming.groupBy("bucket").agg(F.min("_id").alias("least"), F.max("_id").alias("most"), F.count("*").alias("n"))
    bounds = by_bucket.collect()  # a row per bucket
    if not bounds:
        return incoming.select("_id")
    near = [(F.col("bucket") == r["bucket"]) & (F.col("_id_min") <= r["most"]) & (F.col("_id_max") >= r["least"]) for r in bounds]
    stored = keys.read(where=reduce(lambda a, b: a | b, near))
    if sum(r["n"] for r in bounds) <= LOOKED_UP:
        return stored.where(F.col("_id").isin([r["_id"] for r in incoming.collect()])).select("_id")
    return stored.join(incoming, ["bucket", "_id"], "left_semi").select("_id")


def insert_landing(docs: DataFrame, path: str, batch: int, stream: str = "manual") -> bool:
    """Deliver the documents whose id the landing table does not have; of several with one id the latest.

    A delivery is published by its ids: one that died before is made again, one that is repeated after
    does nothing (False). So a file read again, by another stream too, adds no row.
    """
    spark, tag = docs.sparkSession, f"{stream}/{batch}"
    keys = landing_keys(spark, path)
    if keys.has_tag(tag):
        return False
    incoming = _with_bucket(docs)
    fresh = insert_new(_known(keys, incoming), docs, "_id", ("timestamp", "ingestedAt"))
    write_landing(fresh, path, batch, stream)
    written = spark.read.schema(DOCUMENT).parquet(f"{path}/stream={stream}/batch={batch}")
    keys.append(_with_bucket(written), tag=tag)
    return True


def read_landing(spark: SparkSession, path: str) -> DataFrame:
    if not table_exists(spark, path):
        return spark.createDataFrame([], DOCUMENT).withColumns({"stream": F.lit(""), "batch": F.lit(0)})
    folders = [T.StructField("stream", T.StringType()), T.StructField("batch", T.IntegerType())]
    return spark.read.schema(T.StructType([*DOCUMENT.fields, *folders])).parquet(path)


def since(docs: DataFrame, mark: datetime.datetime | None) -> DataFrame:
    """Documents delivered at the mark or later; all without a mark. The mark itself is
    included, because more documents may carry the same instant; the merge drops repeats."""
    return docs if mark is None else docs.where(F.col("ingestedAt") >= F.lit(mark))


def _string(value: Column, path: str) -> Column:
    """A scalar as text; null for objects and lists, whose text would be JSON."""
    nested = F.try_variant_get(value, path, "map<string,variant>").isNotNull() | F.try_variant_get(value, path, "array<variant>").isNotNull()
    return F.when(~nested, F.try_variant_get(value, path, "string"))


def _block_texts(blocks: Column, inner: bool = True) -> Column:
    """The strings of a list and the texts of its blocks, one a line; results may hold a list of their own."""

    def text(block: Column) -> Column:
        found = [_string(block, "$"), _string(block, "$.text"), _string(block, "$.thinking"), _string(block, "$.content")]
        if inner:
            found.append(_block_texts(F.try_variant_get(block, "$.content", "array<variant>"), inner=False))
        return F.coalesce(*found)

    return F.array_join(F.transform(blocks, text), "\n")


def with_message_text(docs: DataFrame) -> DataFrame:
    """Add the message as text for the search: the string, an object's plain content, or the texts
    of its blocks. Keys, roles and escapes are not text."""
    entry = F.try_parse_json("entry")
    blocks = F.try_variant_get(entry, "$.message.content", "array<variant>")
    return docs.withColumn("message", F.coalesce(_string(entry, "$.message"), _string(entry, "$.message.content"), _block_texts(blocks)))


def retained(docs: DataFrame, synced_until: datetime.datetime | None, now: datetime.datetime, days: int = RETENTION_DAYS) -> DataFrame:
    """What a send buffer still holds: without documents that were extracted and are older than the
    limit. The landing table itself keeps every document; searches and backfills read it."""
    if synced_until is None:
        return docs
    old = F.lit(now - datetime.timedelta(days=days))
    return docs.where(~((F.col("ingestedAt") <= F.lit(synced_until)) & (F.col("ingestedAt") < old)))


def ingest_status(docs: DataFrame, synced_until: datetime.datetime | None) -> DataFrame:
    """Pending and synced documents and the last synced delivery."""
    done = F.lit(False) if synced_until is None else F.col("ingestedAt") <= F.lit(synced_until)
    return docs.agg(
        F.count_if(~done).alias("pending"),
        F.count_if(done).alias("synced"),
        F.max(F.when(done, F.col("ingestedAt"))).alias("last_sync_at"),
    )
