"""The log tail: growing files, half lines, bad lines, restarts, splits."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tracemill.sources import documents
from tracemill.sources.session_log import ByteRange, SessionLogStream, read_lines
from tracemill.streaming import tail


def line(i):
    body = {"role": "user", "content": f"é message {i}"}
    return json.dumps({"type": "user", "sessionId": "s", "timestamp": f"2024-01-01T10:00:{i:02d}Z", "message": body}, ensure_ascii=False)


class Logs:
    def __init__(self, spark, root):
        self.spark, self.root = spark, str(root)
        self.landing = f"{root}/landing"
        self.file = f"{root}/projects/alpha/s.jsonl"
        os.makedirs(os.path.dirname(self.file))

    def add(self, text, file=None):
        with open(file or self.file, "a") as f:
            f.write(text)

    def tail(self, **options):
        tail.tail_once(self.spark, f"{self.root}/projects", self.landing, f"{self.root}/cp", f"{self.root}/dead", **options)
        return documents.read_landing(self.spark, self.landing)


@pytest.fixture
def logs(spark, tmp_path):
    return Logs(spark, tmp_path)


@pytest.mark.parametrize("split", ["7", "60", "100000"])
def test_growing_file(spark, logs, split):
    logs.add("".join(line(i) + "\n" for i in range(3)))
    assert logs.tail(splitBytes=split).count() == 3
    logs.add(line(3) + "\n" + line(4) + "\n" + line(5)[:15])
    assert logs.tail(splitBytes=split).count() == 5
    logs.add(line(5)[15:] + "\r\n\n{bad\n5\n")
    got = logs.tail(splitBytes=split)
    assert sorted(r["timestamp"][-3:-1] for r in got.collect()) == [f"{i:02d}" for i in range(6)]
    assert got.select("projectId").distinct().first()[0] == "alpha"
    assert logs.tail(splitBytes=split).count() == 6
    dead = spark.read.json(f"{logs.root}/dead")
    assert sorted(r["line"] for r in dead.collect()) == ["5", "{bad"]
    # The batch read gives the same documents with the same ids.
    batch = documents.to_documents(documents.read_log(spark, f"{logs.root}/projects", splitBytes=split), F.current_timestamp())
    assert {(r["_id"], r["entry"]) for r in batch.collect()} == {(r["_id"], r["entry"]) for r in got.collect()}


def test_new_files_join_in(logs):
    logs.add(line(0) + "\n")
    assert logs.tail().count() == 1
    other = f"{logs.root}/projects/beta/t.jsonl"
    os.makedirs(os.path.dirname(other))
    logs.add(line(1) + "\n", other)
    logs.add("ignored\n", f"{logs.root}/projects/beta/notes.txt")
    assert sorted(r["projectId"] for r in logs.tail().collect()) == ["alpha", "beta"]


def test_a_batch_that_runs_again_is_stored_once(spark, logs):
    logs.add(line(0) + "\n" + line(1) + "\n")
    lines = documents.read_log(spark, f"{logs.root}/projects")
    write = tail.deliver(f"{logs.root}/dead", logs.landing, "a")
    write(lines, 4)
    write(lines, 4)
    assert documents.read_landing(spark, logs.landing).count() == 2
    # Another stream, say with a fresh checkpoint, counts from the start without replacing anything.
    tail.deliver(f"{logs.root}/dead", logs.landing, "b")(lines.limit(1), 4)
    assert documents.read_landing(spark, logs.landing).count() == 3


def stream(tmp_path, **limits):
    options = {"split_bytes": 1 << 20, "settle_days": 1, "max_files": 100, "max_bytes": 1 << 30} | limits
    return SessionLogStream(str(tmp_path / "logs"), str(tmp_path / "positions"), **options)


def lines_of(reader, start, end):
    return sorted(t for p in reader.partitions({"version": start}, {"version": end}) for _, t in read_lines(p, reader.root))


def test_old_files_that_turn_up_late_are_read(tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    old, new, late = logs / "old.jsonl", logs / "new.jsonl", logs / "late.jsonl"
    old.write_bytes(b"a\nunfinished")
    new.write_bytes(b"b\nhalf")
    os.utime(old, (1_000_000, 1_000_000))
    reader = stream(tmp_path)
    assert reader.latestOffset() == {"version": 1} == reader.latestOffset()
    assert lines_of(reader, 0, 1) == [b"a", b"b", b"unfinished"]
    late.write_bytes(b"c\n")
    os.utime(late, (500_000, 500_000))
    assert stream(tmp_path).latestOffset() == {"version": 2}
    assert lines_of(reader, 1, 2) == [b"c"]
    with open(old, "ab") as f:
        f.write(b" line\nd\n")
    # The earlier reader first offers what was stored since, then what is new.
    assert [reader.latestOffset()["version"] for _ in range(3)] == [2, 3, 3]
    assert lines_of(reader, 2, 3) == [b"d", b"unfinished line"]


def test_truncated_files_start_again(tmp_path):
    (tmp_path / "logs").mkdir()
    file = tmp_path / "logs" / "x.jsonl"
    file.write_bytes(b"one\ntwo\n")
    reader = stream(tmp_path)
    assert lines_of(reader, 0, reader.latestOffset()["version"]) == [b"one", b"two"]
    file.write_bytes(b"new\n")
    assert lines_of(reader, 1, reader.latestOffset()["version"]) == [b"new"]


def test_batches_are_limited_and_survive_restarts(tmp_path):
    (tmp_path / "logs").mkdir()
    for i in range(25):
        (tmp_path / "logs" / f"{i:02}.jsonl").write_bytes(b"%02d\n" % i)
    seen, version = [], 0
    for limits in ({"max_files": 4}, {"max_bytes": 7}, {"max_bytes": 1}) * 9:
        reader = stream(tmp_path, **limits)
        reached = reader.latestOffset()["version"]
        got = lines_of(reader, version, reached)
        assert len(got) <= {"max_files": 4, "max_bytes": 2}[next(iter(limits))]
        seen, version = seen + got, reached
    assert seen == sorted(seen) == [b"%02d" % i for i in range(25)]


def test_a_version_that_spark_did_not_log_is_offered_again(tmp_path):
    (tmp_path / "logs").mkdir()
    file = tmp_path / "logs" / "x.jsonl"
    file.write_bytes(b"one\n")
    assert stream(tmp_path).latestOffset() == {"version": 1}
    file.write_bytes(b"one\ntwo\n")
    restarted = stream(tmp_path)
    assert lines_of(restarted, 0, restarted.latestOffset()["version"]) == [b"one", b"two"]


def test_the_tail_reads_all_in_limited_batches(logs):
    for i in range(7):
        logs.add(line(i) + "\n", f"{logs.root}/projects/alpha/{i}.jsonl")
    got = logs.tail(maxFilesPerBatch="3")
    assert got.count() == 7 and got.select("batch").distinct().count() == 3


def test_every_split_size_reads_every_line_once(tmp_path):
    data = b"".join(bytes([97 + i % 26]) * (i % 9) + b"\n" for i in range(60)) + b"end"
    path = tmp_path / "x.jsonl"
    path.write_bytes(data)
    want = []
    position = 0
    for piece in data.split(b"\n"):
        want.append((position, piece))
        position += len(piece) + 1
    for size in (1, 2, 3, 5, 8, 13, 1000):
        cuts = list(range(0, len(data), size)) + [len(data)]
        ranges = [ByteRange(str(path), a, b, len(data), a == 0) for a, b in zip(cuts, cuts[1:])]
        assert [r for p in ranges for r in read_lines(p, str(tmp_path))] == want


def test_windowed_views(spark, logs):
    logs.add("".join(line(i) + "\n" for i in range(4)))
    logs.tail()
    docs = tail.stream_landing(spark, logs.landing)
    for name, df, mode in [("once", tail.without_repeats(docs), "append"), ("hourly", tail.activity_stream(docs), "complete")]:
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        query.awaitTermination()
        assert tail.progress(query)["recent_rows"] == 4
    assert spark.table("once").count() == 4
    assert [(r["user"], r["assistant"]) for r in spark.table("hourly").collect()] == [(4, 0)]
