"""Row number, lag and lead inside ordered groups, safe against one huge group.

A window function puts a whole group into one task. That is the best plan while every
group is of moderate size. Rows without a session all share one group, though, and a
single session may hold a large part of the data, so `order_within` first counts rows
per group. When a group is above the limit, the groups are cut into consecutive slices
of the order, the window runs inside each slice, and a summary with one row per slice
(row count, first row, last row) supplies what crosses a slice border:

    row number  = rows in earlier slices + row number in the slice
    lag of the first row of a slice  = last row of the slice before
    lead of the last row of a slice  = first row of the slice after

A slice is one hour of a group. An hour that is itself above the limit is cut further
at sampled values of (microsecond in the hour, hash of the document), so rows with one
common timestamp are split as well. The sample is picked by hash and sorted, hence the
cuts are a pure function of the data: a recomputed task finds the same slices.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.functions.expressions import null_safe_key

HOT_ROWS_CONF = "spark.tracemill.hotGroupRows"
HOT_ROWS_DEFAULT = 5_000_000
HOUR_MICROS = 3_600_000_000
TIE_BITS = 28
SAMPLES_PER_SLICE = 16
NO_TIMESTAMP_HOUR = 1 << 40  # sorts after every real hour


@dataclass(frozen=True)
class Shift:
    """Value of `column` in the next (`by=1`) or previous (`by=-1`) row.

    `within` narrows the group by one more column.
    """

    column: str
    by: int
    within: str | None = None


def hot_rows_limit(spark: SparkSession) -> int:
    return int(spark.conf.get(HOT_ROWS_CONF, str(HOT_ROWS_DEFAULT)))


def tie_hash(doc: Column) -> Column:
    """Seven hex digits that order documents of one timestamp."""
    return F.substring(F.md5(doc), 1, 7)


def order_columns(ts: str, doc: str, block: str) -> list[Column]:
    return [F.col(ts).asc_nulls_last(), tie_hash(F.col(doc)), F.col(doc), F.col(block)]


def has_hot_group(rows: DataFrame, group: str, limit: int) -> bool:
    """Whether some group has more than `limit` rows: one narrow, pre-aggregated pass."""
    return not rows.groupBy(group).count().where(F.col("count") > limit).isEmpty()


def order_within(
    rows: DataFrame,
    group: str,
    *,
    sequence: str | None = None,
    shifts: dict[str, Shift] | None = None,
    ts: str = "effective_timestamp",
    doc: str = "doc_id",
    block: str = "block_index",
    hot_rows: int | None = None,
    split: bool | None = None,
) -> DataFrame:
    """Add a row number and shifted columns in the order (ts, document, block).

    `split` forces one of the two plans; by default the group sizes decide.
    """
    shifts = shifts or {}
    limit = hot_rows or hot_rows_limit(rows.sparkSession)
    if split is None:
        split = has_hot_group(rows, group, limit)
    if not split:
        return _plain(rows, group, sequence, shifts, order_columns(ts, doc, block))
    return _sliced(rows, group, sequence, shifts, ts, doc, block, limit)


def _plain(rows, group, sequence, shifts, order):
    columns = {}
    if sequence:
        columns[sequence] = F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("bigint")
    for name, s in shifts.items():
        keys = [group] if s.within is None else [group, s.within]
        columns[name] = F.lead(s.column, s.by).over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumns(columns)


def _with_slices(rows, group, ts, doc, limit):
    """Add _group, _hour and _sub; the last two number the slices in order."""
    micros = F.unix_micros(F.col(ts))
    tie = F.conv(tie_hash(F.col(doc)), 16, 10).cast("bigint")
    rows = rows.withColumns(
        {
            "_group": null_safe_key(F.col(group)),
            "_hour": F.coalesce(F.floor(micros / F.lit(HOUR_MICROS)), F.lit(NO_TIMESTAMP_HOUR)),
            # Other digits than those that order the documents: a sample picked by the
            # ordering digits would lie at one end of the order.
            "_pick": F.conv(F.substring(F.md5(F.col(doc)), 9, 7), 16, 10).cast("bigint"),
            "_place": F.coalesce(F.pmod(micros, F.lit(HOUR_MICROS)), F.lit(0)) * (1 << TIE_BITS) + tie,
        }
    )
    keys = ["_group", "_hour"]
    # Short lists as a rule (total / limit rows at most); their size decides how they are joined.
    hot = rows.groupBy(*keys).count().where(F.col("count") > limit).select(*keys)
    sampled = rows.where(F.col("_pick") < max(1, (SAMPLES_PER_SLICE << TIE_BITS) // limit))
    cuts = (
        sampled.join(hot, keys, "left_semi")
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list("_place")).alias("_sample"))
        .select(*keys, F.expr(f"array_distinct(filter(_sample, (x, i) -> i % {SAMPLES_PER_SLICE} = 0))").alias("_cuts"))
    )
    return (
        rows.join(cuts, keys, "left")
        .withColumn("_sub", F.coalesce(F.expr("size(filter(_cuts, c -> c <= _place))"), F.lit(0)))
        .drop("_cuts", "_place", "_pick")
    )


def _edge_row(order, columns, ends):
    """First (F.min) or last (F.max) row of a slice as a struct of the wanted columns."""
    fields = [*order, *[F.col(c) for c in columns]]
    named = [f.alias(f"o{i}") if i < len(order) else f for i, f in enumerate(fields)]
    return ends(F.struct(*named))


def _sliced(rows, group, sequence, shifts, ts, doc, block, limit):
    rows = _with_slices(rows, group, ts, doc, limit)
    # Inside one slice timestamps are all null or all set, so plain order is enough.
    order = [F.col(ts), tie_hash(F.col(doc)), F.col(doc), F.col(block)]
    scopes = {}
    for name, s in shifts.items():
        scopes.setdefault(s.within, {})[name] = s
    if sequence or not scopes:
        scopes.setdefault(None, {})

    kept = rows.columns
    out = rows
    results = {}
    for scope, members in scopes.items():
        within = [] if scope is None else ["_scope"]
        # The scope column is null-safe too, so the summaries join on plain equality.
        if scope is not None:
            out = out.withColumn("_scope", null_safe_key(F.col(scope)))
            source = rows.withColumn("_scope", null_safe_key(F.col(scope)))
        else:
            source = rows
        slice_keys = ["_group", "_hour", "_sub", *within]
        tag = f"_{scope or 'all'}"
        local = Window.partitionBy(*slice_keys).orderBy(*order)
        out = out.withColumns(
            {
                f"{tag}_n": F.row_number().over(local),
                f"{tag}_more": F.lead(F.lit(1)).over(local),
                **{f"_s_{n}": F.lead(s.column, s.by).over(local) for n, s in members.items()},
            }
        )
        back = [s.column for s in members.values() if s.by < 0]
        ahead = [s.column for s in members.values() if s.by > 0]
        aggs = [F.count(F.lit(1)).alias("_rows")]
        aggs += [_edge_row(order, dict.fromkeys(back), F.max).alias("_last")] if back else []
        aggs += [_edge_row(order, dict.fromkeys(ahead), F.min).alias("_first")] if ahead else []
        across = Window.partitionBy("_group", *within).orderBy("_hour", "_sub")
        edges = source.groupBy(*slice_keys).agg(*aggs)
        carried = {
            f"{tag}_before": F.sum("_rows").over(across) - F.col("_rows"),
            **({f"{tag}_prev": F.lag("_last").over(across)} if back else {}),
            **({f"{tag}_next": F.lead("_first").over(across)} if ahead else {}),
        }
        edges = edges.select(*slice_keys, *[c.alias(n) for n, c in carried.items()])
        out = out.join(edges, slice_keys).drop("_scope")
        if scope is None and sequence:
            results[sequence] = (F.col(f"{tag}_before") + F.col(f"{tag}_n")).cast("bigint")
        for n, s in members.items():
            crosses = F.col(f"{tag}_n") == 1 if s.by < 0 else F.col(f"{tag}_more").isNull()
            edge = F.col(f"{tag}_{'prev' if s.by < 0 else 'next'}")[s.column]
            results[n] = F.when(crosses, edge).otherwise(F.col(f"_s_{n}"))
    visible = [c for c in kept if c not in ("_group", "_hour", "_sub")]
    return out.select(*visible, *[c.alias(n) for n, c in results.items()])
