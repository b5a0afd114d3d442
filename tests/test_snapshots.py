import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.sources import documents
from tracemill.sources.snapshots import Conflict, SnapshotTable
from tracemill.streaming import tail

SCHEMA = T.StructType(
    [T.StructField("k", T.StringType()), T.StructField("v", T.LongType()), T.StructField("at", T.TimestampType()), T.StructField("d", T.DateType())]
)
DAY = datetime.date(2024, 1, 1)


def rows(spark, keys, v, hour=0):
    at = datetime.datetime(2024, 1, 1, hour, tzinfo=datetime.timezone.utc)
    return spark.createDataFrame([(f"k{i}", v, at, DAY + datetime.timedelta(days=i % 3)) for i in keys], SCHEMA)


def values(df):
    return {r["k"]: r["v"] for r in df.collect()}


@pytest.fixture
def table(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"), SCHEMA, "d", ("k", "at"), ("k",), "at", ("k",))
    table.append(rows(spark, range(12), 1), tag="a")
    return table


def test_readers_keep_their_version(spark, table):
    before = table.read()
    table.merge(rows(spark, [0, 3], 2), "k")
    assert values(before) == {f"k{i}": 1 for i in range(12)} == values(table.read(1))
    assert values(table.read()) == {f"k{i}": 2 if i in (0, 3) else 1 for i in range(12)}
    # Only the one day that holds both keys was rewritten.
    assert [r["removed_files"] for r in table.history().collect()] == [1, 0]


def test_a_tag_is_appended_once(spark, table):
    assert table.append(rows(spark, range(12), 1), tag="a") is None and table.current() == 1
    table.append(rows(spark, [20], 5, 7), tag="b")
    assert table.read().count() == 13
    assert table.high_water_mark() == datetime.datetime(2024, 1, 1, 7, tzinfo=datetime.timezone.utc)


def test_the_first_of_two_writers_wins(spark, table):
    other = SnapshotTable.open(spark, table.path)
    assert other == table
    base = other.current()
    table.append(rows(spark, [30], 1))
    with pytest.raises(Conflict):
        other._commit(base, rows(spark, [31], 1), [], "append", None)
    assert "k31" not in values(table.read())
    assert table.expire(10, unpublished_hours=0)["dropped_folders"] == 1
    assert table.read().count() == 13


def test_a_change_that_dies_changes_nothing(spark, table, monkeypatch):
    def die(self, record):
        raise RuntimeError("died")

    monkeypatch.setattr(SnapshotTable, "_publish", die)
    with pytest.raises(RuntimeError):
        table.merge(rows(spark, range(6), 9), "k")
    monkeypatch.undo()
    assert values(table.read()) == {f"k{i}": 1 for i in range(12)}
    table.merge(rows(spark, range(6), 9), "k")
    assert sum(values(table.read()).values()) == 6 * 9 + 6


def test_upsert_takes_the_latest_and_moves_days(spark, table):
    moved = rows(spark, [1], 4, 2).withColumn("d", F.lit(DAY + datetime.timedelta(days=30)))
    table.upsert(rows(spark, [1], 3, 1).unionByName(moved).unionByName(rows(spark, [50], 5)), "k", ("at",))
    table.upsert(rows(spark, [1, 2], 8).withColumn("at", F.lit(datetime.datetime(2020, 1, 1))), "k", ("at",))
    got = {r["k"]: (r["v"], r["d"]) for r in table.read().collect()}
    assert got["k1"] == (4, DAY + datetime.timedelta(days=30)) and got["k2"][0] == 1 and got["k50"][0] == 5 and len(got) == 13


def test_delete_and_partitions(spark, table):
    assert table.delete(F.col("k") == "none") is None
    table.delete(F.col("v") == 1, "all")
    assert table.read().count() == 0 and table.files().count() == 0
    table.append(rows(spark, range(12), 2))
    table.replace_partitions(rows(spark, [0], 7), [DAY])
    assert values(table.read()) == {"k0": 7} | {f"k{i}": 2 for i in range(12) if i % 3}


def test_keys_are_replaced_within_a_bound(spark, table):
    keys = spark.createDataFrame([("k0",), ("k1",), ("k99",)], "_key string")
    table.replace_keys(keys, F.col("k"), rows(spark, [0], 6), F.col("d") <= DAY + datetime.timedelta(days=1))
    assert values(table.read()) == {"k0": 6} | {f"k{i}": 1 for i in range(2, 12)}


def test_file_bounds_leave_files_out(spark, table):
    table.append(rows(spark, range(100, 103), 1, 5))
    near = table.read(where=F.col("at_max") >= F.lit("2024-01-01 05:00:00").cast("timestamp"))
    assert sorted(values(near)) == ["k100", "k101", "k102"] and len(near.inputFiles()) == 3 < table.files().count()


def test_compaction_expiry_and_checkpoints(spark, table, monkeypatch):
    from tracemill.sources import snapshots

    monkeypatch.setattr(snapshots, "CHECKPOINT_EVERY", 3)
    for i in range(5):
        table.append(rows(spark, range(100 * i + 100, 100 * i + 103), i))
    before, old = values(table.read()), values(table.read(4))
    assert table._checkpoints() == [3, 6] and table.files().count() == 18
    table.compact()
    assert values(table.read()) == before and table.files().count() == 3
    assert table.expire(keep=2, unpublished_hours=0)["oldest"] == 6 and values(table.read()) == before and values(table.read(6)) == before
    assert table.expire(keep=1, unpublished_hours=0) == {"oldest": 7, "deleted_files": 18, "dropped_folders": 6}
    assert values(table.read()) == before and len(old) == 21
    with pytest.raises(ValueError):
        table.read(4)
    table.append(rows(spark, [900], 1))
    assert table.read().count() == len(before) + 1


def test_difference_reads_changed_files_only(spark, table):
    table.merge(rows(spark, [0], 2), "k")
    gone, new = table.difference(1)
    assert len(gone.inputFiles()) == len(new.inputFiles()) == 1
    assert {(r["k"], r["v"]) for r in new.collect()} - {(r["k"], r["v"]) for r in gone.collect()} == {("k0", 2)}


def test_files_read_again_add_no_document(spark, tmp_path):
    """Another stream, a batch that runs twice, one that died before its ids were published, large and small deliveries."""
    lines = spark.range(1500).selectExpr("'/logs/projects/a/s.jsonl' AS source_file", "id AS byte_offset", "concat('{\"type\":\"user\",\"n\":', id, '}') AS line")
    landing, dead = str(tmp_path / "landing"), str(tmp_path / "dead")
    first, other = (tail.deliver(dead, landing, s, only_new=True) for s in "ab")
    first(lines.where("byte_offset < 1200"), 0)
    first(lines.where("byte_offset between 1190 and 1210"), 1)
    first(lines.where("byte_offset between 1190 and 1210"), 1)
    other(lines, 0)
    other(lines.limit(0), 1)
    got = documents.read_landing(spark, landing)
    assert got.count() == got.select("_id").distinct().count() == 1500
    assert {(r["stream"], r["batch"]): r["count"] for r in got.groupBy("stream", "batch").count().collect()} == {("a", 0): 1200, ("a", 1): 11, ("b", 0): 289}
    # The documents of a batch that died lie there without their ids; the batch is made again.
    extra = lines.limit(3).withColumn("byte_offset", F.col("byte_offset") + 10_000)
    documents.write_landing(documents.to_documents(extra, F.current_timestamp()), landing, 2, "b")
    other(extra, 2)
    assert documents.read_landing(spark, landing).count() == 1503
