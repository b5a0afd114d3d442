"""Exact continuous median per group without holding a group in one task.

`percentile` keeps every distinct value of a group in one buffer. Here values (whole
microseconds) are counted per group, the counts are summed in bins of 2^24
microseconds, the bins that hold the two middle ranks are found from the bin counts,
and only values of those bins are ranked. A task therefore orders at most the bins of
one group, or the at most 2^24 distinct values of one bin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN_BITS = 24


def _running(count: str, keys: list[str], order: str) -> Column:
    return F.sum(count).over(Window.partitionBy(*keys).orderBy(order))


def exact_median(rows: DataFrame, groups: list[str], micros: str, name: str) -> DataFrame:
    """One row per group with the median of `micros`, as a double in microseconds.

    Null values are skipped; a group without values gives no row.
    """
    # A constant key lets a global median share the code; it never forms a hot group
    # because only counts per distinct value or bin are shuffled by it.
    keys = groups or ["_all"]
    source = rows if groups else rows.withColumn("_all", F.lit(0))
    counts = (
        source.where(F.col(micros).isNotNull())
        .groupBy(*keys, F.col(micros).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    out = _median(counts, keys, name)
    return out if groups else out.drop("_all")


def median_of_counts(counts: DataFrame, groups: list[str], micros: str, n: str, name: str) -> DataFrame:
    """The same from values that were counted before; counts of one value add up, and may be taken away again
    by negative ones. A value whose count is zero is not there."""
    added = counts.where(F.col(micros).isNotNull()).groupBy(*groups, F.col(micros).alias("_v")).agg(F.sum(n).alias("_n"))
    return _median(added.where("_n > 0"), groups, name)


def _median(counts: DataFrame, keys: list[str], name: str) -> DataFrame:
    counts = counts.withColumn("_bin", F.shiftright("_v", BIN_BITS))
    bins = counts.groupBy(*keys, "_bin").agg(F.sum("_n").alias("_n"))
    placed = bins.select(
        *keys,
        "_bin",
        _running("_n", keys, "_bin").alias("_upto"),
        F.col("_n").alias("_in_bin"),
        F.sum("_n").over(Window.partitionBy(*keys)).alias("_total"),
    )
    # Zero-based middle ranks; equal when the count is odd.
    low = F.floor((F.col("_total") - 1) / 2)
    high = F.floor(F.col("_total") / 2)
    start = F.col("_upto") - F.col("_in_bin")
    middle = placed.where(
        ((start <= low) & (low < F.col("_upto"))) | ((start <= high) & (high < F.col("_upto")))
    ).select(*keys, "_bin", start.alias("_start"), low.alias("_low"), high.alias("_high"))
    ranked = (
        counts.join(middle, [*keys, "_bin"])
        .withColumn("_end", F.col("_start") + _running("_n", [*keys, "_bin"], "_v"))
        .withColumn("_begin", F.col("_end") - F.col("_n"))
    )
    covers = lambda rank: (F.col("_begin") <= F.col(rank)) & (F.col(rank) < F.col("_end"))
    return ranked.groupBy(*keys).agg(
        (
            (F.max(F.when(covers("_low"), F.col("_v"))) + F.max(F.when(covers("_high"), F.col("_v")))) / F.lit(2.0)
        ).alias(name)
    )
