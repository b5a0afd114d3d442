"""Data checks as result tables: (suite, check, column, failed, total, success).

All row checks of a table run in one aggregation pass. Uniqueness and references need a
shuffle each, on the checked key.
"""

from __future__ import annotations

import datetime
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RowCheck:
    """Fails on every row where `bad` is true."""

    name: str
    column: str
    bad: Column


def not_null(column: str) -> RowCheck:
    return RowCheck("not_null", column, F.col(column).isNull())


def accepted_values(column: str, values: list) -> RowCheck:
    """Null passes."""
    return RowCheck("accepted_values", column, ~F.col(column).isin(values))


def between(column: str, low=None, high=None) -> RowCheck:
    bad = F.lit(False)
    if low is not None:
        bad = bad | (F.col(column) < low)
    if high is not None:
        bad = bad | (F.col(column) > high)
    return RowCheck("between", column, bad)


def not_before(column: str, other: str) -> RowCheck:
    """column >= other wherever both are set."""
    return RowCheck("not_before", column, F.col(column) < F.col(other))


def _result(suite, check, column, failed, total) -> list[Column]:
    return [
        F.lit(suite).alias("suite"),
        F.lit(check).alias("check"),
        F.lit(column).alias("column"),
        failed.cast("bigint").alias("failed"),
        total.cast("bigint").alias("total"),
        (failed == 0).alias("success"),
    ]


def run_row_checks(df: DataFrame, suite: str, checks: list[RowCheck]) -> DataFrame:
    counts = df.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(c.bad).alias(f"f{i}") for i, c in enumerate(checks)],
    )
    results = [
        F.struct(F.lit(c.name).alias("check"), F.lit(c.column).alias("column"), F.col(f"f{i}").alias("failed"))
        for i, c in enumerate(checks)
    ]
    return counts.select("total", F.explode(F.array(*results)).alias("r")).select(
        F.lit(suite).alias("suite"), "r.check", "r.column", "r.failed", "total", (F.col("r.failed") == 0).alias("success")
    )


def unique(df: DataFrame, suite: str, column: str) -> DataFrame:
    """Failed: number of values that occur more than once. Nulls are left out."""
    per_value = df.where(F.col(column).isNotNull()).groupBy(column).count()
    return per_value.agg(
        F.count_if(F.col("count") > 1).alias("failed"), F.coalesce(F.sum("count"), F.lit(0)).alias("total")
    ).select(*_result(suite, "unique", column, F.col("failed"), F.col("total")))


def relationship(df: DataFrame, suite: str, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Failed: rows whose value is set but missing in the parent.

    Rows are counted per value before the join, so a frequent value is one row in it.
    """
    values = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).count()
    known = parent.select(F.col(parent_column).alias("_v")).distinct().withColumn("_known", F.lit(True))
    return (
        values.join(known, "_v", "left")
        .agg(
            F.coalesce(F.sum(F.when(F.col("_known").isNull(), F.col("count"))), F.lit(0)).alias("failed"),
            F.coalesce(F.sum("count"), F.lit(0)).alias("total"),
        )
        .select(*_result(suite, "relationships", column, F.col("failed"), F.col("total")))
    )


def columns_match(df: DataFrame, suite: str, expected: list[str]) -> DataFrame:
    """Failed: columns on one side only. Needs the schema, not the data."""
    wrong = len(set(df.columns) ^ set(expected))
    return df.sparkSession.range(1).select(
        *_result(suite, "columns_match_set", "", F.lit(wrong), F.lit(len(expected)))
    )


def column_type(df: DataFrame, suite: str, column: str, accepted: list[str]) -> DataFrame:
    wrong = int(df.schema[column].dataType.typeName() not in accepted)
    return df.sparkSession.range(1).select(*_result(suite, "column_type", column, F.lit(wrong), F.lit(1)))


def row_count_between(df: DataFrame, suite: str, low: int = 0, high: int | None = None) -> DataFrame:
    counted = df.agg(F.count(F.lit(1)).alias("total"))
    bad = F.col("total") < low
    if high is not None:
        bad = bad | (F.col("total") > high)
    return counted.select(*_result(suite, "row_count_between", "", bad.cast("int"), F.col("total")))


def freshness(
    df: DataFrame, as_of: datetime.datetime, column: str = "extracted_at", warn_hours: int = 24, error_hours: int = 48
) -> DataFrame:
    """Age of the newest load and its status; a table without loads is an error."""
    age = (F.unix_micros(F.lit(as_of)) - F.unix_micros("latest")) / F.lit(3.6e9)
    return (
        df.agg(F.max(column).alias("latest"))
        .withColumn("age_hours", age)
        .withColumn(
            "status",
            F.when(F.col("age_hours") <= warn_hours, "pass").when(F.col("age_hours") <= error_hours, "warn").otherwise("error"),
        )
    )


def combine(results: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, results)


def summary(results: DataFrame) -> DataFrame:
    """Per suite and overall: number of checks, passed checks, success."""
    passed = F.count_if("success")
    per = lambda df, *keys: df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("checks"), passed.alias("passed"), F.every("success").alias("success")
    )
    return per(results, "suite").unionByName(per(results.withColumn("suite", F.lit("all")), "suite"))


def split_rows(df: DataFrame, good: Column) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the others for the dead-letter store. A null predicate is not good."""
    ok = F.coalesce(good, F.lit(False))
    return df.where(ok), df.where(~ok)


def write_dead_letters(bad: DataFrame, path: str, day: Column, reason: str, mode: str = "append") -> None:
    bad.withColumns({"reason": F.lit(reason), "date": day}).write.mode(mode).partitionBy("date").json(path)
