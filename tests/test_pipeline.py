import datetime
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tracemill.plans import checks
from tracemill.plans.catalog import MODELS, Lineage, Options, ancestors
from tracemill.plans.pipeline import ChecksFailed, Job, read_bronze, run_pipeline, stored_models
from tracemill.sources import documents, event_log, tables

FACTS = ["fct_messages", "fct_tool_calls", "fct_file_operations"]
COMPARED = [*FACTS, "dim_sessions", "dim_projects", "agg_code_changes", "agg_daily_summary"]


def contents(df):
    return sorted(map(repr, df.drop("computed_at").collect()))


@pytest.fixture(scope="module")
def job(spark, sf_dir, tmp_path_factory):
    """Two deliveries, each followed by a run; the second run merges."""
    job = Job(str(tmp_path_factory.mktemp("job")), options=Options(as_of=datetime.date(2024, 4, 1)))
    docs = event_log.documents_from_conversations(spark, sf_dir)
    late = F.col("timestamp") >= "2024-03-01T10:03"
    documents.write_landing(docs.where(~late), job.landing, 0)
    run_pipeline(spark, job)
    shifted = docs.where(late).withColumn("ingestedAt", F.col("ingestedAt") + F.expr("INTERVAL 1 HOUR"))
    documents.write_landing(shifted, job.landing, 1)
    report = run_pipeline(spark, job)
    assert report["transform"]["fct_messages"]["result"].startswith("merged")
    return job


def test_incremental_equals_full_refresh(spark, job):
    before = {n: contents(stored_models(spark, job)[n]) for n in COMPARED}
    run_pipeline(spark, replace(job, full_refresh=True, skip_extract=True))
    after = stored_models(spark, job)
    for name in COMPARED:
        assert contents(after[name]) == before[name], name


def test_stored_models_equal_lazy_models(spark, job):
    stored, lazy = stored_models(spark, job), Lineage(read_bronze(spark, job), job.options)
    for name in COMPARED:
        want = lazy[name]
        assert contents(stored[name].select(*want.columns)) == contents(want), name


def test_versions_and_time_travel(spark, job):
    info = tables.describe(spark, job.flattened)
    assert info["snapshot_count"] == 2 and len(info["schema_fields"]) == 15
    first, both = tables.snapshot(spark, job.flattened, 1), tables.snapshot(spark, job.flattened)
    assert 0 < first.count() < both.count()
    assert [r["version"] for r in tables.history(spark, job.flattened).collect()] == [2, 1]
    assert read_bronze(spark, job).count() == read_bronze(spark, job).select("_id").distinct().count()


def test_skipping_and_selection(spark, job):
    report = run_pipeline(spark, replace(job, skip_extract=True, skip_load=True, select="dim_tools"))
    assert report["extraction"] == report["load"] == {"skipped": True}
    assert list(report["transform"]) == ["int_tool_usage", "dim_tools"]


def test_sql_over_views(spark, job):
    stored_models(spark, job).register_views(["fct_messages", "dim_sessions"])
    sql = "SELECT count(*) FROM fct_messages m JOIN dim_sessions s USING (session_key)"
    assert spark.sql(sql).first()[0] == spark.table("fct_messages").where("session_key is not null").count()


def test_status_counts_everything(spark, job):
    docs = documents.read_landing(spark, job.landing)
    mark = tables.high_water_mark(spark, job.flattened)
    row = documents.ingest_status(docs, mark).first()
    assert (row["pending"], row["synced"]) == (0, docs.count())


def test_checks_of_the_stored_models(spark, job):
    results = checks.declared_checks(stored_models(spark, job), ["dim_date", "dim_sessions", "agg_daily_summary"])
    assert results.where("not success").count() == 0


def test_the_job_checks_what_it_stored(spark, job):
    only = replace(job, skip_extract=True, skip_load=True, skip_transform=True)
    report = run_pipeline(spark, only)["checks"]
    assert report["checks"] > 100
    broken = read_bronze(spark, job).limit(1).withColumn("type", F.lit("odd"))
    wrong = replace(only, root=job.root + "-wrong")
    broken.write.partitionBy("date").parquet(wrong.bronze)
    found = run_pipeline(spark, wrong)["checks"]["failed"]
    assert {(f["suite"], f["check"], f["column"]) for f in found} >= {("bronze", "accepted_values", "type")}
    with pytest.raises(ChecksFailed):
        run_pipeline(spark, replace(wrong, fail_on_checks=True))


def test_ancestors_come_first():
    order = ancestors("agg_daily_summary")
    for name in order:
        assert all(order.index(p) < order.index(name) for p in MODELS[name].inputs if p in MODELS)


def test_empty_landing(spark, tmp_path):
    job = Job(str(tmp_path), options=Options(as_of=datetime.date(2024, 4, 1)))
    report = run_pipeline(spark, job)
    assert report["extraction"]["added_records"] == 0
    models = stored_models(spark, job)
    assert models["agg_hourly_activity"].count() == 168
    assert models["dim_tools"].where("usage_tier = 'unused'").count() == 15
    assert models["agg_code_changes"].first()["total_operations"] == 0


def test_declared_counts():
    rules = checks.DECLARED.values()
    count = lambda kind: sum(len(r.get(kind, [])) for r in rules)
    assert [count(k) for k in ("not_null", "unique", "accepted", "refers")] == [91, 20, 30, 10]


def test_backfill_appends_again_and_the_merge_drops_repeats(spark, job):
    before = read_bronze(spark, job).select("_id").collect()
    report = run_pipeline(spark, replace(job, full_backfill=True, skip_transform=True))
    assert report["extraction"]["added_records"] == len(before)
    assert sorted(read_bronze(spark, job).select("_id").collect()) == sorted(before)


def test_display_order(spark, job):
    days = [r["date_key"] for r in stored_models(spark, job).in_display_order("agg_daily_summary").collect()]
    assert days == sorted(days, reverse=True)


def test_seed_from_csv(spark, tmp_path):
    from tracemill.sources.seeds import tool_categories

    (tmp_path / "seed.csv").write_text("tool_name,tool_category,description\nRead,file_operations,Read things\n")
    assert [tuple(r) for r in tool_categories(spark, str(tmp_path / "seed.csv")).collect()] == [
        ("Read", "file_operations", "Read things")
    ]
    assert tool_categories(spark).count() == 15
