import pytest
from pyspark.sql import functions as F

from tracemill.functions.stems import stem
from tracemill.operators import text_index
from tracemill.operators.search import LogFilter
from tracemill.operators.text_index import Query, TextIndex
from tracemill.sources.event_log import documents_from_conversations

TEXTS = {
    "a": "Fixing the login pages",
    "b": "the login page was fixed",
    "c": "page login, page",
    "d": "Über cafés: fix_it café",
    "e": "",
    "f": None,
    "g": "one login one page one login page one",
    "h": "nothing here",
}


def test_stems(spark):
    pairs = {
        "caresses": "caress", "ponies": "poni", "ties": "tie", "cats": "cat", "gas": "gas", "this": "this", "kiwis": "kiwi",
        "agreed": "agre", "feed": "feed", "hopping": "hop", "hoped": "hope", "hoping": "hope", "failing": "fail", "filing": "file",
        "tabled": "tabl", "tables": "tabl", "fixes": "fix", "leaves": "leav", "parsing": "pars", "parse": "pars", "luxuriated": "luxuriat", "sized": "size", "cry": "cri", "by": "by", "say": "say", "us": "us", "glass": "glass",
        "plotted": "plot", "sing": "sing", "bed": "bed", "123": "123", "cafés": "cafés",
    }
    rows = spark.createDataFrame(list(pairs.items()), "w string, s string")
    assert [tuple(r) for r in rows.withColumn("got", stem(F.col("w"))).where("got != s").collect()] == []


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, "p" if i != "h" else "q", "s1" if i in "abc" else None, f"2024-01-0{k + 1}T00:00:00.000Z" if i != "d" else None, t) for k, (i, t) in enumerate(TEXTS.items())]
    return spark.createDataFrame(rows, "_id string, projectId string, sessionId string, timestamp string, message string")


@pytest.fixture(scope="module")
def index(spark, docs, tmp_path_factory):
    """Three deliveries, the second one twice."""
    index = TextIndex(spark, str(tmp_path_factory.mktemp("index")), buckets=8)
    for i, part in enumerate(("a,b,c", "d,e", "d,e", "f,g,h")):
        assert index.add(docs.where(F.col("_id").isin(part.split(","))), f"s/{i - (i > 1)}") is (i != 2)
    return index


@pytest.mark.parametrize(
    "query, ids",
    [
        ("login", "abcg"),
        ("FIX", "ab"),
        ("fixes cafés", "abd"),
        ("café", "d"),
        ("fix_it", "d"),
        ("login -fixing", "cg"),
        ('"login page"', "bcg"),
        ('"login pages"', "a"),
        ('"page login"', "c"),
        ('"login page" -was', "cg"),
        ('"login page" "one login"', "g"),
        ('"one login page one" nothing', "g"),
        ("nothing", ""),
        ("-login", ""),
        ("", ""),
        ("!?", ""),
    ],
)
def test_words_phrases_and_exclusions_equal_the_scan(spark, docs, index, query, ids):
    f = LogFilter("p", search=query)
    found = lambda df: "".join(sorted(r["_id"] for r in df.collect()))
    assert found(index.matching(f)) == found(text_index.scan(docs, f)) == found(index.documents(docs, f)) == ids


def test_fields_filter(spark, docs, index):
    ids = lambda **f: sorted(r["_id"] for r in index.matching(LogFilter("p", search="login", **f)).collect())
    assert ids(session="s1") == ["a", "b", "c"] and ids(start="2024-01-02", end="2024-01-03") == ["b", "c"]
    assert index.matching(LogFilter("q", search="nothing")).count() == 1


def test_only_the_buckets_of_the_terms_are_read(spark, index):
    f = LogFilter("p", search="login")
    (_, bucket), = index._terms(Query.parse("login")).values()
    found = index.matching(f)
    assert found.inputFiles() and all(f"/bucket={bucket}/" in name for name in found.inputFiles())
    pushed = found._jdf.queryExecution().toString().split("PushedFilters: ")[1].split("\n")[0]
    assert "EqualTo(term,login)" in pushed and "EqualTo(projectId,p)" in pushed
    assert len(found.inputFiles()) < index.table.files().count()


def test_compaction_changes_no_answer(spark, docs, tmp_path):
    index = TextIndex(spark, str(tmp_path / "i"), buckets=1)
    for i in TEXTS:
        index.add(docs.where(F.col("_id") == i), i)
    ask = lambda: sorted(r["_id"] for r in index.matching(LogFilter("p", search="login fix")).collect())
    before, files = ask(), index.table.files().count()
    index.compact()
    assert ask() == before == ["a", "b", "c", "g"] and index.table.files().count() == 1 < files


def test_new_deliveries_of_a_landing_table(spark, docs, tmp_path):
    index = TextIndex(spark, str(tmp_path / "i"), buckets=2)
    landing = docs.withColumn("stream", F.lit("s")).withColumn("batch", F.when(F.col("_id") < "d", 0).otherwise(1))
    assert index.add_new(landing.where("batch = 0")) == ["s/0"]
    assert index.add_new(landing) == ["s/1"] and index.add_new(landing) == []
    assert index.matching(LogFilter("p", search="login")).count() == 4


def test_conversations(spark, sf_dir, tmp_path):
    docs = documents_from_conversations(spark, sf_dir)
    index = TextIndex(spark, str(tmp_path / "i"))
    index.add(docs, "all")
    for query in ("lead heads -und", '"des la"', 'the "que la" -et', "de"):
        f = LogFilter("p3", search=query)
        assert sorted(index.matching(f).collect()) == sorted(text_index.scan(docs, f).select(*text_index.KEY).collect())
