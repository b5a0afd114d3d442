"""The tool category table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracemill.functions import rules
from tracemill.schemas import TOOL_CATEGORIES


def tool_categories(spark: SparkSession, csv_path: str | None = None) -> DataFrame:
    """The built-in table, or a replacement with the same columns from a CSV file."""
    if csv_path:
        return spark.read.schema(TOOL_CATEGORIES).csv(csv_path, header=True)
    return spark.createDataFrame(rules.TOOL_CATEGORIES, TOOL_CATEGORIES)
