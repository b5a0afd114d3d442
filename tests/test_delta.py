"""State tables after deltas against the models built from all of bronze."""

import datetime

import pytest
from pyspark.sql import functions as F

from tracemill import stored_queries
from tracemill.operators.flatten import flatten_documents
from tracemill.operators.median import median_of_counts
from tracemill.plans import pipeline
from tracemill.plans.catalog import Lineage, Options
from tracemill.plans.delta import STATES, DeltaState
from tracemill.plans.pipeline import Job
from tracemill.schemas import BRONZE
from tracemill.sources import documents, event_log, tables
from tracemill.sources.event_log import bronze_from_events
from tracemill.sources.snapshots import SnapshotTable

LATEST = ("extracted_at", "ingested_at")
COMPARED = [
    "activity_rollup", "int_sessions_computed", "dim_sessions", "dim_date", "dim_projects", "dim_tools", "fct_messages", "fct_tool_calls",
    "fct_file_operations", "agg_session_metrics", "agg_tool_efficiency", "agg_code_changes", "agg_daily_summary", "agg_hourly_activity",
]


def contents(df):
    return sorted(map(repr, df.drop("computed_at").collect()))


@pytest.fixture(scope="module")
def state(spark, sf_dir, tmp_path_factory):
    """Bronze without late rows, without the last days, and with some rows in a session that they leave later."""
    root = str(tmp_path_factory.mktemp("delta"))
    bronze = SnapshotTable(spark, f"{root}/bronze", BRONZE, "date", (), ("session_id",))
    state = DeltaState(spark, bronze, f"{root}/state", f"{root}/models", f"{root}/staging", Options(as_of=datetime.date(2024, 2, 1)))
    rows = bronze_from_events(spark, sf_dir)
    late = (F.crc32("_id") % 9 == 0) & (F.col("date") > "2024-01-20")
    older = rows.where(late & F.col("session_id").isNotNull()).withColumns(
        {"extracted_at": F.col("extracted_at") - F.expr("INTERVAL 1 DAY"), "session_id": F.lit("left"), "project_id": F.lit("p99")}
    )
    bronze.overwrite(rows.where(~late & (F.col("date") < "2024-01-29")).unionByName(older))
    assert state.refresh()["result"] == "rebuilt"
    bronze.upsert(rows.where(late), "_id", LATEST)
    return state


def test_deltas_equal_a_full_refresh_and_read_touched_days_only(spark, state):
    report = state.refresh()
    assert report["result"].startswith("merged")
    everything = state.bronze.files().select("date").distinct().count()
    assert report["days"] < everything and report["bronze_files"] < state.bronze.files().count()
    assert state.refresh()["result"] == "nothing new"
    got, want = state.models(), Lineage(state.bronze.read(), state.options)
    for name in COMPARED:
        assert contents(got[name].select(*want[name].columns)) == contents(want[name]), name
    assert got["dim_sessions"].where("session_id = 'left'").count() == 0


def test_a_refresh_that_dies_is_made_again(spark, sf_dir, state, monkeypatch):
    rows = bronze_from_events(spark, sf_dir)
    state.bronze.upsert(rows.where(F.col("date") >= "2024-01-29"), "_id", LATEST)
    done = []

    def some(self, write):
        for name in list(STATES)[:4]:
            write(name)
            done.append(name)
        raise RuntimeError("died")

    monkeypatch.setattr(DeltaState, "_each", some)
    with pytest.raises(RuntimeError):
        state.refresh()
    monkeypatch.undo()
    assert len(done) == 4 and state.refresh()["result"].startswith("merged")
    got, want = state.models(), Lineage(state.bronze.read(), state.options)
    for name in ["fct_messages", "dim_sessions", "agg_daily_summary", "agg_tool_efficiency"]:
        assert contents(got[name].select(*want[name].columns)) == contents(want[name]), name


def test_compaction_touches_no_session(spark, state):
    state.bronze.compact(files_at_most=0)
    assert state.refresh()["result"] == "merged 0 sessions"


def test_medians_of_counts_add_and_subtract(spark):
    counts = [("a", 5, 2), ("a", 9, 1), ("a", 1, 4), ("a", 1, -4), ("a", 7, 1), ("b", 3, 1), ("b", 3, -1), ("c", None, 5)]
    df = spark.createDataFrame(counts, "g string, v bigint, n bigint")
    assert [tuple(r) for r in median_of_counts(df, ["g"], "v", "n", "m").collect()] == [("a", 6.0)]


def test_idle_runs_append_nothing(spark, sf_dir, tmp_path):
    """Documents of the instant reached last are not appended again; a new one of that instant is."""
    job = Job(str(tmp_path))
    docs = event_log.documents_from_conversations(spark, sf_dir)
    last = F.col("_id") == docs.agg(F.max("_id")).first()[0]
    documents.write_landing(docs.where(~last), job.landing, 0)
    first = pipeline.extract(spark, job)
    assert pipeline.extract(spark, job) == {"version": 1, "added_records": 0, "high_water_mark": first["high_water_mark"]}
    documents.write_landing(docs.where(last), job.landing, 1)
    assert 0 < pipeline.extract(spark, job)["added_records"] < 5
    assert pipeline.extract(spark, job)["added_records"] == 0 and tables.current_version(spark, job.flattened) == 2
    loaded = pipeline.load(spark, job)
    assert pipeline.load(spark, job)["bronze_version"] == loaded["bronze_version"] == 1


@pytest.mark.parametrize("query", [stored_queries.delta_tool_efficiency, stored_queries.table_versions])
def test_stored_queries_flatten_a_document_once(spark, sf_dir, monkeypatch, query):
    """Upserts read their rows several times; the documents behind them are flattened once."""
    seen = spark.sparkContext.accumulator(0)

    def counted(docs, *args, **kwargs):
        def count(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        return flatten_documents(docs.mapInArrow(count, docs.schema), *args, **kwargs)

    monkeypatch.setattr(stored_queries, "flatten_documents", counted)
    assert query(spark, sf_dir).count() > 0
    assert seen.value == spark.read.parquet(f"{sf_dir}/conversations.parquet").count()
