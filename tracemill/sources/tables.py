"""The append-only table of flattened rows with a log of its appends, and its statistics."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.operators.merge import table_exists
from tracemill.schemas import BRONZE

LAYOUT = T.StructType([*BRONZE.fields, T.StructField("version", T.IntegerType())])
COMMIT = "version int, committed_at timestamp, operation string, added_records bigint, high_water_mark timestamp"


def commits(spark: SparkSession, path: str) -> DataFrame:
    """The log of appends. Empty when there is none yet."""
    if not table_exists(spark, f"{path}/commits"):
        return spark.createDataFrame([], COMMIT)
    return spark.read.schema(COMMIT).parquet(f"{path}/commits")


def current_version(spark: SparkSession, path: str) -> int:
    return commits(spark, path).agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]


def high_water_mark(spark: SparkSession, path: str) -> datetime.datetime | None:
    """Newest delivery time of all appends; None asks for a full read."""
    return commits(spark, path).agg(F.max("high_water_mark")).first()[0]


def append(rows: DataFrame, path: str, operation: str = "append") -> dict:
    """Append rows as a new version, in day partitions, and log it.

    Rows become visible with the log entry. An append that failed half way is overwritten
    by the next one, which takes the same version number.
    """
    spark = rows.sparkSession
    version = current_version(spark, path) + 1
    data = f"{path}/data"
    rows.withColumn("version", F.lit(version)).hint("rebalance", "date").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("date", "version").parquet(data)
    written = spark.read.schema(LAYOUT).parquet(data).where(F.col("version") == version)
    stats = written.agg(F.count(F.lit(1)), F.max("ingested_at")).first()
    now = datetime.datetime.now(datetime.timezone.utc)
    log = spark.createDataFrame([(version, now, operation, stats[0], stats[1])], COMMIT)
    log.coalesce(1).write.mode("append").parquet(f"{path}/commits")
    return {"version": version, "added_records": stats[0], "high_water_mark": stats[1]}


def snapshot(spark: SparkSession, path: str, as_of_version: int | None = None) -> DataFrame:
    """All logged rows, or those up to a version. Versions are folders, so the others are
    not read."""
    last = current_version(spark, path)
    wanted = last if as_of_version is None else min(as_of_version, last)
    return spark.read.schema(LAYOUT).parquet(f"{path}/data").where(F.col("version") <= wanted).drop("version")


def snapshot_since(spark: SparkSession, path: str, version: int, until: int) -> DataFrame:
    """Logged rows of later versions than the given one, up to `until`."""
    fresh = F.col("version").between(version + 1, until)
    return spark.read.schema(LAYOUT).parquet(f"{path}/data").where(fresh).drop("version")


def rows_at(spark: SparkSession, path: str, mark: datetime.datetime) -> DataFrame:
    """Logged rows delivered at the mark, from the versions that reached it; the others are not read."""
    reached = commits(spark, path).where(F.col("high_water_mark") >= F.lit(mark)).agg(F.min("version"), F.max("version")).first()
    return snapshot_since(spark, path, reached[0] - 1, reached[1]).where(F.col("ingested_at") >= F.lit(mark))


def history(spark: SparkSession, path: str, limit: int = 10) -> DataFrame:
    """The latest appends."""
    return commits(spark, path).orderBy(F.desc("version")).limit(limit)


def describe(spark: SparkSession, path: str) -> dict:
    """Fields, partitioning and append count, from schema and log only."""
    log = commits(spark, path)
    last = log.orderBy(F.desc("version")).first()
    info = {"location": path, "partition_spec": ["date"], "snapshot_count": log.count()}
    if last:
        info["schema_fields"] = BRONZE.fieldNames()
        info["current_snapshot_id"] = last["version"]
        info["snapshot_timestamp"] = last["committed_at"]
    return info


def date_range(bronze: DataFrame) -> DataFrame:
    return bronze.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.min("date").alias("min_date"),
        F.max("date").alias("max_date"),
        F.count_distinct("date").alias("date_count"),
    )


def top_projects(bronze: DataFrame, limit: int = 10) -> DataFrame:
    counted = bronze.groupBy("project_id").agg(F.count(F.lit(1)).alias("count"))
    return counted.orderBy(F.desc("count"), "project_id").limit(limit)


def type_distribution(bronze: DataFrame) -> DataFrame:
    return bronze.groupBy("type").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"))
