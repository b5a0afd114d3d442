"""One document per shape of the message field."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from tracemill.operators.flatten import flatten_documents
from tracemill.schemas import BRONZE, DOCUMENT

EXTRACTED = datetime.datetime(2025, 1, 2, 12, tzinfo=datetime.timezone.utc)


@pytest.fixture
def flatten(spark):
    def run(message="absent", python_json=True, **doc):
        entry = {} if message == "absent" else {"message": message}
        row = {"_id": "d", "type": "user", "ingestedAt": None, **doc, "entry": json.dumps(entry)}
        df = spark.createDataFrame([tuple(row.get(f) for f in DOCUMENT.fieldNames())], DOCUMENT)
        rows = flatten_documents(df, F.lit(EXTRACTED), python_json).collect()
        return sorted(rows, key=lambda r: (len(r["_id"]), r["_id"]))

    return run


def blocks(*items):
    return {"role": "assistant", "content": list(items)}


def text(value):
    return {"type": "text", "text": value}


def use(name="Read", given=None, **more):
    return {"type": "tool_use", "id": "t1", "name": name, "input": given, **more}


def test_schema(flatten):
    assert flatten("x")[0].__fields__ == BRONZE.fieldNames()


def test_missing_and_null_message(flatten):
    for rows in (flatten(), flatten(None)):
        assert len(rows) == 1
        assert (rows[0]["type"], rows[0]["message_role"], rows[0]["message_content"]) == ("user", None, None)


def test_plain_string(flatten):
    [r] = flatten("Hello")
    assert (r["type"], r["message_role"], r["message_content"], r["message_raw"]) == ("user", "user", "Hello", None)


def test_string_that_looks_like_json(flatten):
    [r] = flatten('{"role": "user"}')
    assert r["message_content"] == '{"role": "user"}'


def test_string_without_type(flatten):
    [r] = flatten("Hello", type=None)
    assert (r["type"], r["message_role"]) == ("unknown", None)


def test_role_and_string(flatten):
    message = {"role": "user", "content": "What is é?"}
    [r] = flatten(message)
    assert (r["message_role"], r["message_content"], r["message_raw"]) == ("user", "What is é?", json.dumps(message))


def test_empty_role_falls_back_to_type(flatten):
    [r] = flatten({"role": "", "content": "x"}, type="assistant")
    assert (r["type"], r["message_role"]) == ("assistant", "assistant")


def test_system_role_has_no_message_role(flatten):
    [r] = flatten({"role": "system", "content": "x"})
    assert (r["type"], r["message_role"]) == ("system", None)


def test_text_blocks_are_joined(flatten):
    [r] = flatten(blocks(text("a"), "b", text("")))
    assert (r["message_content"], r["message_role"], r["type"], r["message_raw"]) == ("a\nb\n", "assistant", "user", None)


def test_text_block_without_text_still_counts(flatten):
    [r] = flatten(blocks({"type": "text"}))
    assert r["message_content"] == ""


def test_tool_use_between_texts(flatten):
    block = use(given={"path": "/f.txt", "n": [1, 2.0, True, None]})
    a, b, c = flatten(blocks(text("a"), block, {"type": "thinking"}, text("b"), text("c")), type="assistant")
    assert [r["_id"] for r in (a, b, c)] == ["d", "d_1", "d_2"]
    assert (b["type"], b["message_role"], b["tool_name"], b["tool_id"]) == ("tool_use", "assistant", "Read", "t1")
    assert b["message_content"] == json.dumps(block["input"])
    assert b["message_raw"] == json.dumps(block)
    assert (a["message_content"], c["message_content"]) == ("a", "b\nc")


def test_unknown_block_does_not_split_text(flatten):
    [r] = flatten(blocks(text("a"), {"type": "image"}, 5, None, text("b")))
    assert r["message_content"] == "a\nb"


@pytest.mark.parametrize("empty", [None, {}, [], "", 0, False])
def test_empty_tool_input(flatten, empty):
    [r] = flatten(blocks(use(given=empty)))
    assert r["message_content"] is None


def test_string_tool_input_is_quoted(flatten):
    [r] = flatten(blocks(use(given="ls")))
    assert r["message_content"] == '"ls"'


def result(*content):
    block = {"type": "tool_result", "tool_use_id": "t1"}
    return {**block, "content": content[0]} if content else block


@pytest.mark.parametrize(
    "block, expected",
    [
        (result("done"), "done"),
        (result(), ""),
        (result(None), "None"),
        (result(["a", text("b"), {"type": "image"}, 7]), "a\nb"),
        (result([]), ""),
        (result({"k": True, "z": [None, 1.5]}), "{'k': True, 'z': [None, 1.5]}"),
        (result(7), "7"),
        (result(True), "True"),
    ],
)
def test_tool_result(flatten, block, expected):
    [r] = flatten(blocks(block))
    assert (r["type"], r["message_role"], r["tool_use_id"], r["tool_name"]) == ("tool_result", "user", "t1", None)
    assert r["message_content"] == expected
    assert r["message_raw"] == json.dumps(block)


def test_no_known_block(flatten):
    for content in ([], [{"type": "thinking"}], [1]):
        [r] = flatten(blocks(*content))
        assert (r["type"], r["message_content"]) == ("user", None)


def test_object_without_content(flatten):
    [r] = flatten({"role": "user"})
    assert (r["type"], r["message_role"], r["message_content"], r["message_raw"]) == ("user", None, None, None)


@pytest.mark.parametrize("content, expected", [(5, "5"), (True, "True"), ({"a": "b"}, "{'a': 'b'}"), (2.0, "2.0")])
def test_content_of_another_type(flatten, content, expected):
    message = {"role": "user", "content": content}
    [r] = flatten(message)
    assert (r["message_content"], r["message_raw"]) == (expected, json.dumps(message))


@pytest.mark.parametrize("message", [[1, "a"], 5, True])
def test_message_of_another_type(flatten, message):
    [r] = flatten(message)
    assert (r["type"], r["message_role"], r["message_content"]) == ("unknown", None, None)
    assert r["message_raw"] == json.dumps(message)


def test_many_blocks_keep_their_order(flatten):
    items = [b for i in range(15) for b in (text(f"t{i}"), use(f"tool{i}"))]
    rows = flatten(blocks(*items))
    assert [r["_id"] for r in rows] == ["d"] + [f"d_{i}" for i in range(1, 30)]
    assert [r["tool_name"] for r in rows if r["tool_name"]] == [f"tool{i}" for i in range(15)]


def test_compact_form_stays_in_the_jvm(flatten):
    [r] = flatten(blocks(use(given={"b": 1, "a": "x"})), python_json=False)
    assert r["message_content"] == '{"b":1,"a":"x"}'


@pytest.mark.parametrize(
    "stamp, expected",
    [
        ("2025-01-02T10:00:00Z", "2025-01-02 10:00:00"),
        ("2025-01-02T12:00:00+02:00", "2025-01-02 10:00:00"),
        ("2025-01-02T10:00:00.123456", "2025-01-02 10:00:00.123456"),
        ("2025-01-02 10:00", "2025-01-02 10:00:00"),
        ("2025-01-02T12+02", "2025-01-02 10:00:00"),
        ("2025-01-02T12:00+0200", "2025-01-02 10:00:00"),
        ("2025-01-02", "2025-01-02 00:00:00"),
        ("not a time", None),
        ("2025", None),
        ("", None),
        (None, None),
    ],
)
def test_timestamps(spark, stamp, expected):
    from tracemill.functions.expressions import parse_timestamp

    df = spark.createDataFrame([(stamp,)], "t string").select(parse_timestamp(F.col("t")).cast("string").alias("t"))
    assert df.first()["t"] == expected


def test_date_falls_back_to_delivery_then_extraction(flatten):
    at = datetime.datetime(2025, 1, 1, 5, tzinfo=datetime.timezone.utc)
    assert flatten("x", timestamp="2024-12-31T23:59:59Z", ingestedAt=at)[0]["date"] == datetime.date(2024, 12, 31)
    assert flatten("x", timestamp="bad", ingestedAt=at)[0]["date"] == datetime.date(2025, 1, 1)
    assert flatten("x")[0]["date"] == datetime.date(2025, 1, 2)
