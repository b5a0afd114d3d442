import pytest
from pyspark.sql import functions as F

from tracemill.operators import search
from tracemill.operators.search import LogFilter
from tracemill.sources.event_log import documents_from_events


def matches(spark, text, query):
    df = spark.createDataFrame([(text,)], "t string")
    return df.select(search.keyword_match(F.col("t"), query).alias("m")).first()["m"]


@pytest.mark.parametrize(
    "text, query, hit",
    [
        ("Fix the login page", "login", True),
        ("Fix the login page", "log", False),
        ("Fix the login page", "nothing LOGIN", True),
        ("Fix the login page", '"login page"', True),
        ("Fix the login page", '"page login"', False),
        ("Fix the login page", "login -page", False),
        ("Fix the login page", "login -pages", True),
        ("Über café", "café", True),
        ("cafés", "café", False),
        ("a.b", "a.b", True),
        ("anything", "", False),
        ("anything", "-other", False),
        (None, "x", False),
    ],
)
def test_keyword_match(spark, text, query, hit):
    assert matches(spark, text, query) is hit


@pytest.mark.parametrize("order", ["asc", "desc"])
def test_pages_cover_everything_once(spark, sf_dir, order):
    docs = documents_from_events(spark, sf_dir).where("timestamp is not null").cache()
    f = LogFilter("p3")
    seen, cursor = [], None
    while True:
        rows = search.page(docs, f, cursor=cursor, limit=30, order=order).collect()
        seen += [(r["timestamp"], r["_id"]) for r in rows]
        if not rows[0]["has_more"]:
            break
        cursor = rows[0]["next_cursor"]
        assert search.decode_cursor(cursor) == seen[-1]
    assert seen == sorted(seen, reverse=order == "desc")
    assert len(seen) == len(set(seen)) == search.match_count(docs, f).first()["total"]


def test_bad_requests(spark, sf_dir):
    docs = documents_from_events(spark, sf_dir)
    with pytest.raises(ValueError):
        LogFilter("")
    with pytest.raises(ValueError):
        search.page(docs, LogFilter("p3"), limit=101)
    with pytest.raises(ValueError):
        search.page(docs, LogFilter("p3"), cursor="%%%")
    with pytest.raises(ValueError):
        search.message_activity(docs, LogFilter("p3"), "month")
    with pytest.raises(ValueError):
        search.message_activity(docs, LogFilter("p3"), periods=91)


def test_export_writes_json(spark, sf_dir, tmp_path):
    docs = documents_from_events(spark, sf_dir)
    search.export_json(docs, LogFilter("p3"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == search.export_rows(docs, LogFilter("p3")).count()


def test_search_reads_texts_of_landing_documents(spark):
    """Strings, string contents and blocks are searched; JSON keys, roles and escapes are not."""
    import json

    from tracemill.schemas import DOCUMENT

    bodies = {
        "plain": "first\nfix it",
        "object": {"role": "user", "content": "second\nfix it"},
        "blocks": {"role": "assistant", "content": [{"type": "text", "text": "third"}, {"type": "text", "text": "fix it"}, {"type": "tool_use", "name": "Bash"}]},
        "none": None,
    }
    rows = [(i, "user", "s", "p", "2024-01-01", None, "f", json.dumps({"message": m})) for i, m in bodies.items()]
    docs = spark.createDataFrame([*rows, ("broken", "user", "s", "p", "2024-01-01", None, "f", "{")], DOCUMENT)
    found = lambda query: sorted(r["_id"] for r in search.matching(docs, LogFilter("p", search=query)).collect())
    assert found("fix") == ["blocks", "object", "plain"]
    assert found("nfix") == found("content") == found("role") == found("text") == []
    assert found("third") == ["blocks"] and found('"second"') == ["object"]


def test_export_limit_is_a_parameter(spark, sf_dir, tmp_path):
    docs = documents_from_events(spark, sf_dir)
    total = search.export_rows(docs, LogFilter("p3")).count()
    assert search.export_json(docs, LogFilter("p3"), str(tmp_path / "a"), limit=5) is True
    assert spark.read.json(str(tmp_path / "a")).count() == 5
    assert search.export_json(docs, LogFilter("p3"), str(tmp_path / "b"), limit=total) is False
