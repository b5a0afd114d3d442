"""The plan for huge groups against the plain window, on awkward orders."""

import random

import pytest

from tracemill.operators.ordered import Shift, has_hot_group, order_within

SCHEMA = "session_id string, effective_timestamp timestamp, doc_id string, block_index int, tool string, role string"


def rows(spark, seed, sessions, spread_seconds, n=400):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        at = None if rnd.random() < 0.05 else 1_700_000_000 + rnd.randrange(spread_seconds)
        out.append(
            (rnd.choice(sessions), at, f"d{rnd.randrange(n // 2)}", i, rnd.choice(["a", "b", None]), rnd.choice(["u", "v", None]))
        )
    df = spark.createDataFrame(out, SCHEMA.replace("timestamp timestamp", "timestamp bigint"))
    return df.withColumn("effective_timestamp", df["effective_timestamp"].cast("timestamp"))


@pytest.mark.parametrize("hot_rows", [3, 40, 10_000])
@pytest.mark.parametrize("spread", [1, 3000, 400_000])
def test_split_plan_equals_plain_window(spark, hot_rows, spread):
    df = rows(spark, spread, [None, None, None, "", "s1", "s2"], spread)
    ask = dict(
        sequence="n",
        shifts={
            "prev_role": Shift("role", -1),
            "prev_at": Shift("effective_timestamp", -1),
            "next_role": Shift("role", 1),
            "next_same": Shift("effective_timestamp", 1, within="tool"),
        },
    )
    plain = order_within(df, "session_id", split=False, **ask)
    cut = order_within(df, "session_id", split=True, hot_rows=hot_rows, **ask)
    assert cut.columns == plain.columns
    assert sorted(map(repr, cut.collect())) == sorted(map(repr, plain.collect()))


def test_group_sizes_decide(spark):
    df = rows(spark, 1, [None, "s1"], 3000)
    assert has_hot_group(df, "session_id", 100)
    assert not has_hot_group(df, "session_id", 400)
    chosen = order_within(df, "session_id", sequence="n", hot_rows=100)
    assert "_hour" in chosen._jdf.queryExecution().analyzed().toString()


def test_a_slice_holds_few_rows(spark):
    """All rows share one session and one instant: the document hash still cuts them."""
    from pyspark.sql import functions as F

    from tracemill.operators.ordered import _with_slices

    df = spark.range(4000).select(
        F.lit("s").alias("session_id"),
        F.lit(1_700_000_000).cast("timestamp").alias("effective_timestamp"),
        F.concat(F.lit("d"), "id").alias("doc_id"),
    )
    sizes = _with_slices(df, "session_id", "effective_timestamp", "doc_id", 200).groupBy("_sub").count()
    assert sizes.agg(F.max("count")).first()[0] < 800
    assert sizes.count() > 10
