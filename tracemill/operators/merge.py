"""Keyed merges into day-partitioned Parquet tables.

Only the days touched by a merge are read and rewritten. Their new content is stored beside the
table first and declared complete by a marker; then the day folders are replaced from it. A merge that
dies before the marker has changed nothing; one that dies later is finished by the next merge, or by
`recover`, from the stored days. So no row depends on a folder that is being replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def latest_per_id(rows: DataFrame, key: str = "_id", by: tuple[str, ...] = ("extracted_at", "ingested_at")) -> DataFrame:
    """One row per key: the latest one; the remaining columns settle ties.

    A maximum is combined before the shuffle, so many copies of one key cost one row per
    task, where a window would bring all copies into one task.
    """
    rest = [c for c in rows.columns if c != key and c not in by]
    best = F.max(F.struct(*by, *rest))
    return rows.groupBy(key).agg(best.alias("_best")).select(
        *[F.col(key) if c == key else F.col("_best")[c].alias(c) for c in rows.columns]
    )


def insert_new(existing: DataFrame, incoming: DataFrame, key: str = "_id", by: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose key the table does not have yet; of several versions the latest by the columns given,
    then by the others."""
    return latest_per_id(incoming.join(existing.select(key), key, "left_anti"), key, by)


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether the path, or a path matching the pattern, exists."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target)
    return found is not None and len(found) > 0


def remove_folder(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _days(rows: DataFrame, column: str) -> set:
    """Distinct partition days; a table has few of them however many rows it holds."""
    return {r[0] for r in rows.select(column).distinct().collect()}


def write_days(rows: DataFrame, path: str, day: str, whole: bool = False) -> None:
    """Overwrite the days that occur in the rows, or the whole table.

    Rebalancing by day gives few files per day, and Spark splits a large day over several
    tasks instead of gathering it in one. Files are sorted by session, so a filter on it
    skips row groups.
    """
    order = [c for c in (day, "session_id") if c in rows.columns]
    spread = rows.hint("rebalance", day).sortWithinPartitions(*order)
    mode = "static" if whole else "dynamic"
    spread.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy(day).parquet(path)


def _pending(path: str) -> tuple[str, str]:
    """Folder of a merge's stored days, and the marker that says they are complete."""
    return f"{path.rstrip('/')}__merge/days", f"{path.rstrip('/')}__merge/complete"


def recover(spark: SparkSession, path: str, day: str) -> bool:
    """Finish a merge that died after its days were stored; tells whether there was one."""
    stored, marker = _pending(path)
    if not table_exists(spark, marker):
        return False
    emptied = [r["day"] for r in spark.read.schema("day string").json(marker).collect() if r["day"] is not None]
    if table_exists(spark, f"{stored}/{day}=*"):
        write_days(spark.read.parquet(stored), path, day)
    for gone in sorted(emptied):
        remove_folder(spark, f"{path}/{day}={gone}")
    # The marker goes first: days without it are leftovers that the next merge overwrites.
    remove_folder(spark, marker)
    remove_folder(spark, stored)
    spark.catalog.refreshByPath(path)
    return True


def replace_by_key(spark: SparkSession, path: str, incoming: DataFrame, key: str, day: str) -> dict:
    """Delete the rows whose key occurs in `incoming`, then add all incoming rows.

    `incoming` should be a stored table: it is read several times. An old row is removed
    from its own day even when the incoming row lies on another one.
    """
    recover(spark, path, day)
    if not table_exists(spark, path):
        write_days(incoming, path, day)
        return {"touched_days": len(_days(incoming, day))}
    existing = spark.read.schema(incoming.schema).parquet(path)
    keys = incoming.select(key).distinct()
    # Finding the old days reads two narrow columns.
    old_days = _days(existing.select(key, day).join(keys, key, "left_semi"), day)
    new_days = _days(incoming, day)
    if None in new_days:
        raise ValueError(f"{day} must be set in every row")
    touched = existing.where(F.col(day).isin(list(old_days | new_days)))
    kept = touched.join(keys, key, "left_anti")
    stored, marker = _pending(path)
    write_days(kept.select(*incoming.columns).unionByName(incoming), stored, day, whole=True)
    filled = _days(spark.read.schema(incoming.schema).parquet(stored), day)
    emptied = old_days - filled
    rows = [(str(d),) for d in sorted(emptied)] or [(None,)]
    spark.createDataFrame(rows, "day string").coalesce(1).write.mode("overwrite").json(marker)
    recover(spark, path, day)
    return {"touched_days": len(old_days | new_days), "emptied_days": len(emptied)}


def upsert(spark: SparkSession, path: str, incoming: DataFrame, staging: str, key: str = "_id", day: str = "date") -> dict:
    """Insert or replace by key, all columns; of several versions the latest stays.

    The resolved rows are stored under `staging` first. That cuts their lineage in a way
    that survives the loss of executors.
    """
    recover(spark, path, day)
    versions = incoming
    if table_exists(spark, path):
        existing = spark.read.schema(incoming.schema).parquet(path)
        keys = incoming.select(key).distinct()
        # Two narrow columns tell the days; only those days are read with all columns.
        days = _days(existing.select(key, day).join(keys, key, "left_semi"), day)
        same = existing.where(F.col(day).isin(list(days))).join(keys, key, "left_semi")
        versions = incoming.unionByName(same.select(*incoming.columns))
    latest_per_id(versions, key).write.mode("overwrite").parquet(staging)
    return replace_by_key(spark, path, spark.read.parquet(staging), key, day)


def merged(existing: DataFrame, incoming: DataFrame, key: str = "_id") -> DataFrame:
    """The result of an upsert as a query, without writing."""
    return latest_per_id(existing.unionByName(incoming), key)


def late_window(rows: DataFrame, newest: Column, day: str = "partition_date") -> DataFrame:
    """Rows from one day before the newest stored day on."""
    return rows.where(F.col(day) >= F.date_sub(newest, 1))
