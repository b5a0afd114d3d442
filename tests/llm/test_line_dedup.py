from tools.check import compare
from tracemill.llm import line_dedup
from tracemill.llm.queries import ORACLE, op6_line_dedup


def test_query_equals_sql(spark, duck, sf_dir):
    ok, note = compare(spark, duck, op6_line_dedup, ORACLE["op6_line_dedup"], sf_dir)
    assert ok, note


def dedup(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint, gone int")
    return sorted((r["doc_id"], r["text"], r["n_chars"]) for r in line_dedup.without_repeats(docs).collect())


def test_later_passages_go_and_overlaps_merge(spark):
    rows = [(2, "x\na\nb\nc\nd\ny", 0, 1), (1, "a\nb\nc\nd\nz", 0, 1), (3, "a\nb\nq", 0, 1), (4, "c\n \nd\nz", 0, 1)]
    assert dedup(spark, rows) == [(1, "a\nb\nc\nd\nz", 9), (2, "x\ny", 3), (3, "a\nb\nq", 5), (4, " ", 1)]


def test_repeats_within_a_text(spark):
    assert dedup(spark, [(1, "a\na\na\na\na", 0, 1)]) == [(1, "a", 1)]
    assert dedup(spark, [(1, "a\nb\nc\na\nb\nc", 0, 1)]) == [(1, "a\nb\nc", 5)]


def test_odd_rows(odd, empty):
    out = line_dedup.without_repeats(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    texts = {r["doc_id"]: r["text"] for r in out.where("doc_id in (1, 2, 3, 12)").collect()}
    assert texts == {1: None, 2: "", 3: " \n\t ", 12: "same line"}
    assert line_dedup.without_repeats(empty).count() == 0


def test_rows_sharing_an_id_keep_their_own_texts(spark):
    rows = [(1, "a\nb\nc", 0, 1), (2, "a\nb\nc\nd", 0, 1), (2, "e\nf\ng\nh", 0, 1), (2, "e\nf\ng\nh", 0, 1), (None, "e\nf\ng\ni", 0, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint, gone int")
    got = sorted((r["doc_id"] or 0, r["text"]) for r in line_dedup.without_repeats(docs).collect())
    assert got == [(0, "e\nf\ng\ni"), (1, "a\nb\nc"), (2, "d"), (2, "h"), (2, "h")]


def test_no_python_on_the_main_path(spark, sf_dir):
    plan = op6_line_dedup(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
