import datetime
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tracemill.operators import merge
from tracemill.operators.median import exact_median
from tracemill.schemas import BRONZE

DAY = datetime.date(2025, 1, 2)


def bronze(spark, *rows):
    filled = [tuple({"extracted_at": at(0), "date": DAY, **r}.get(n) for n in BRONZE.fieldNames()) for r in rows]
    return spark.createDataFrame(filled, BRONZE)


def at(hours):
    return datetime.datetime(2025, 1, 2, tzinfo=datetime.timezone.utc) + datetime.timedelta(hours=hours)


def contents(df):
    return {r["_id"]: (r["message_content"], r["date"]) for r in df.collect()}


def test_upsert_writes_updates_and_moves(spark, tmp_path):
    path, staging = str(tmp_path / "t"), str(tmp_path / "staging")
    next_day = DAY + datetime.timedelta(days=1)
    third = DAY + datetime.timedelta(days=2)
    merge.upsert(
        spark, path,
        bronze(
            spark,
            {"_id": "a", "message_content": "one"},
            {"_id": "b", "message_content": "two"},
            {"_id": "c", "message_content": "alone", "date": next_day},
        ),
        staging,
    )
    incoming = bronze(
        spark,
        {"_id": "a", "message_content": "older", "extracted_at": at(1)},
        {"_id": "a", "message_content": "newer", "extracted_at": at(2)},
        {"_id": "c", "message_content": "moved", "extracted_at": at(2), "date": third},
        {"_id": "e", "message_content": "new", "date": third},
    )
    stats = merge.upsert(spark, path, incoming, staging)
    expected = {"a": ("newer", DAY), "b": ("two", DAY), "c": ("moved", third), "e": ("new", third)}
    assert contents(spark.read.parquet(path)) == expected
    assert stats["emptied_days"] == 1
    merge.upsert(spark, path, incoming, staging)
    assert contents(spark.read.parquet(path)) == expected
    assert spark.read.parquet(path).count() == 4


def test_a_late_replay_of_an_old_version_changes_nothing(spark, tmp_path):
    path, staging = str(tmp_path / "t"), str(tmp_path / "staging")
    merge.upsert(spark, path, bronze(spark, {"_id": "a", "message_content": "new", "extracted_at": at(5)}), staging)
    merge.upsert(spark, path, bronze(spark, {"_id": "a", "message_content": "old", "extracted_at": at(1)}), staging)
    assert contents(spark.read.parquet(path))["a"][0] == "new"


def test_replace_by_key_keeps_repeated_new_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = "k string, v int, d date"
    merge.replace_by_key(spark, path, spark.createDataFrame([("x", 1, DAY), ("y", 2, DAY)], schema), "k", "d")
    merge.replace_by_key(spark, path, spark.createDataFrame([("x", 3, DAY), ("x", 4, DAY)], schema), "k", "d")
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(path).collect()) == [("x", 3), ("x", 4), ("y", 2)]


def test_latest_per_id_settles_ties_by_the_other_columns(spark):
    df = bronze(spark, {"_id": "a", "message_content": "x"}, {"_id": "a", "message_content": "y"}).repartition(2)
    assert contents(merge.latest_per_id(df))["a"][0] == "y"


def test_exact_median(spark):
    rnd = random.Random(7)
    data = [(g, rnd.randrange(1 << s)) for g, s, n in [("a", 40, 501), ("b", 40, 500), ("c", 3, 200), ("d", 30, 1)] for _ in range(n)]
    data += [("e", None), ("n", -5), ("n", -(1 << 30)), ("z", 1), ("z", 3)]
    df = spark.createDataFrame(data, "g string, v bigint")
    got = {r["g"]: r["m"] for r in exact_median(df, ["g"], "v", "m").collect()}
    want = {g: float(statistics.median([v for h, v in data if h == g])) for g in "abcdnz"}
    assert got == want
    assert exact_median(df, [], "v", "m").first()["m"] == statistics.median([v for _, v in data if v is not None])


def test_median_of_nothing_has_no_row(spark):
    assert exact_median(spark.createDataFrame([(None,)], "v bigint"), [], "v", "m").count() == 0


@pytest.mark.parametrize("dies_at", ["storing", "publishing", "cleaning"])
def test_a_merge_that_dies_loses_nothing(spark, tmp_path, monkeypatch, dies_at):
    """Old rows that stay, of days that are rewritten, survive a death at any step, and the rerun finishes."""
    path, schema = str(tmp_path / "t"), "k string, v int, d date"
    other = datetime.date(2024, 1, 2)
    merge.replace_by_key(spark, path, spark.createDataFrame([("a", 1, DAY), ("b", 1, DAY), ("c", 1, other)], schema), "k", "d")
    incoming = spark.createDataFrame([("b", 2, DAY), ("c", 2, DAY)], schema)
    real_write, real_remove = merge.write_days, merge.remove_folder

    def write(rows, target, day, whole=False):
        if dies_at == "publishing" and target == path:
            real_remove(spark, f"{path}/d={DAY}")  # the folder is gone, its successor is not there yet
            raise RuntimeError("died")
        real_write(rows, target, day, whole)
        if dies_at == "storing" and target != path:
            raise RuntimeError("died")

    def remove(session, folder):
        if dies_at == "cleaning" and "__merge" not in folder:
            raise RuntimeError("died")
        real_remove(session, folder)

    monkeypatch.setattr(merge, "write_days", write)
    monkeypatch.setattr(merge, "remove_folder", remove)
    with pytest.raises(RuntimeError):
        merge.replace_by_key(spark, path, incoming, "k", "d")
    monkeypatch.undo()
    assert merge.recover(spark, path, "d") is (dies_at != "storing")
    if dies_at == "storing":
        merge.replace_by_key(spark, path, incoming, "k", "d")
    spark.catalog.refreshByPath(path)
    assert sorted(tuple(r) for r in spark.read.schema(schema).parquet(path).collect()) == [("a", 1, DAY), ("b", 2, DAY), ("c", 2, DAY)]
    assert merge.recover(spark, path, "d") is False


def test_insert_new_takes_the_latest_version(spark):
    existing = spark.createDataFrame([("a", 1, 1)], "_id string, at int, v int")
    incoming = spark.createDataFrame([("a", 9, 9), ("b", 1, 7), ("b", 2, 3), ("b", 2, 2)], "_id string, at int, v int")
    assert [tuple(r) for r in merge.insert_new(existing, incoming, by=("at",)).collect()] == [("b", 2, 3)]
