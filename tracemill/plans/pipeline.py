"""The batch job: extract log documents, load them into bronze, rebuild the models."""

from __future__ import annotations

import datetime
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions.expressions import null_safe_key
from tracemill.operators import merge
from tracemill.operators.flatten import flatten_documents
from tracemill.plans import checks
from tracemill.plans.delta import STATES, DeltaState
from tracemill.plans.catalog import LONG_TEXTS, MODELS, Lineage, Options, ancestors
from tracemill.schemas import BRONZE
from tracemill.sources import documents, tables
from tracemill.sources.snapshots import SnapshotTable, table_there


@dataclass(frozen=True)
class Job:
    """Folders and switches of one run. All folders lie below `root`, on shared storage."""

    root: str
    full_backfill: bool = False
    full_refresh: bool = False
    skip_extract: bool = False
    skip_load: bool = False
    skip_transform: bool = False
    skip_checks: bool = False
    fail_on_checks: bool = False  # raise if a declared check or a suite fails
    select: str | None = None  # a model, built with everything it reads
    delta: bool = True  # keep state up to date by the sessions that changed; otherwise late days are recomputed
    python_json: bool = True
    options: Options = field(default_factory=Options)

    @property
    def landing(self) -> str:
        return f"{self.root}/landing"

    @property
    def flattened(self) -> str:
        return f"{self.root}/flattened"

    @property
    def bronze(self) -> str:
        return f"{self.root}/bronze"

    def model(self, name: str) -> str:
        return f"{self.root}/models/{name}"

    def staging(self, name: str) -> str:
        return f"{self.root}/staging/{name}"


def extract(spark: SparkSession, job: Job) -> dict:
    """Flatten what was delivered since the last run, or everything.

    Documents of the instant that the last run reached are looked at again, as more of them may have come;
    rows that were appended then are left out, and a run that finds nothing new appends nothing.
    """
    mark = None if job.full_backfill else tables.high_water_mark(spark, job.flattened)
    docs = documents.since(documents.read_landing(spark, job.landing), mark)
    now = datetime.datetime.now(datetime.timezone.utc)
    rows = flatten_documents(docs, F.lit(now), job.python_json)
    if mark is None:
        return tables.append(rows, job.flattened, "backfill")
    rows = unseen(rows, tables.rows_at(spark, job.flattened, mark))
    if rows.isEmpty():
        return {"version": tables.current_version(spark, job.flattened), "added_records": 0, "high_water_mark": mark}
    return tables.append(rows, job.flattened, "append")


def unseen(rows: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows without an equal one in ``seen``, whenever it was extracted."""
    own = lambda df: df.withColumn("_row", F.xxhash64(*[c for c in rows.columns if c != "extracted_at"]))
    return own(rows).join(own(seen).select("_id", "_row"), ["_id", "_row"], "left_anti").select(*rows.columns)


LATEST = ("extracted_at", "ingested_at")


def bronze_table(spark: SparkSession, job: Job) -> SnapshotTable:
    """Bronze: the latest version of each row, in versions that readers can hold on to."""
    return SnapshotTable(spark, job.bronze, BRONZE, "date", ("project_id", "timestamp"), ("session_id",), "ingested_at")


def load(spark: SparkSession, job: Job) -> dict:
    """Bring bronze up to date with the newest append, or rebuild it from all appends.

    The newest version is looked up once: an append that comes meanwhile belongs to the next load. Either way
    the change is one new version of bronze, and an append without rows makes none.
    """
    version, bronze = tables.current_version(spark, job.flattened), bronze_table(spark, job)
    if job.full_refresh or not bronze.exists():
        everything = merge.latest_per_id(tables.snapshot(spark, job.flattened, version))
        stats = {"rebuilt": True, "bronze_version": bronze.overwrite(everything, "rebuild")["version"]}
    else:
        fresh = tables.snapshot_since(spark, job.flattened, _loaded_version(spark, job), version)
        stats = {"rebuilt": False, "bronze_version": bronze.current()}
        if not fresh.isEmpty():
            made = bronze.upsert(fresh, "_id", LATEST)
            stats |= {"bronze_version": made["version"], "rewritten_files": made["removed_files"]}
    _remember_version(spark, job, version)
    return {**stats, "version": version, "rows": bronze.describe().first()["rows"]}


def _loaded_version(spark: SparkSession, job: Job) -> int:
    path = f"{job.root}/loads"
    if not merge.table_exists(spark, path):
        return 0
    return spark.read.schema("version int").parquet(path).agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]


def _remember_version(spark: SparkSession, job: Job, version: int) -> None:
    spark.createDataFrame([(version,)], "version int").coalesce(1).write.mode("append").parquet(f"{job.root}/loads")


def read_bronze(spark: SparkSession, job: Job) -> DataFrame:
    """The current version; a plain folder of day partitions is read as it is."""
    if table_there(spark, job.bronze):
        return bronze_table(spark, job).read()
    return spark.read.schema(BRONZE).parquet(job.bronze)


def touched_sessions(rows: DataFrame, since: datetime.date) -> DataFrame:
    """All rows of the sessions that have rows since the day, so that positions inside the
    session stay right while other sessions are left out."""
    key = null_safe_key(F.col("session_id"))
    recent = rows.where(F.col("partition_date") >= F.lit(since)).select(key.alias("_session")).distinct()
    return rows.withColumn("_session", key).join(recent, "_session", "left_semi").drop("_session")


def fact_table(spark: SparkSession, job: Job, name: str, rows: DataFrame) -> SnapshotTable:
    return SnapshotTable(spark, job.model(name), rows.schema, "date_key", ("project_id", "effective_timestamp"), ("session_id",))


def _has_rows(spark: SparkSession, path: str) -> bool:
    """Whether a fact was stored with rows."""
    return table_there(spark, path) and SnapshotTable.open(spark, path).describe().first()["rows"] > 0


def _write_incremental(spark: SparkSession, job: Job, name: str, models: Lineage) -> tuple[str, DataFrame]:
    """Rebuild the fact, or recompute its late window and replace those rows by key; one new version."""
    path, key = job.model(name), MODELS[name].key
    if job.full_refresh or not _has_rows(spark, path):
        table = fact_table(spark, job, name, models[name])
        table.overwrite(models[name], "rebuild")
        return "rebuilt", table.read()
    # The newest day is in the list of files. As a constant it prunes folders.
    table = SnapshotTable.open(spark, path)
    since = table.files().agg(F.max("date_key")).first()[0] - datetime.timedelta(days=1)
    recent = Lineage(models.bronze, models.options, dict(models.stored))
    recent.stored["message_features"] = touched_sessions(models["message_features"], since)
    rows, staged = recent[name], job.staging(name)
    rows.where(F.col("partition_date") >= F.lit(since)).write.mode("overwrite").parquet(staged)
    table.merge(spark.read.schema(rows.schema).parquet(staged), key)
    return f"merged since {since}", table.read()


def delta_state(spark: SparkSession, job: Job) -> DeltaState:
    return DeltaState(spark, bronze_table(spark, job), f"{job.root}/state", f"{job.root}/models", f"{job.root}/staging", job.options)


def _transform_by_deltas(spark: SparkSession, job: Job) -> dict:
    """Bring the state tables up to date, then write the models that add them up."""
    start, state = time.time(), delta_state(spark, job)
    report = state.rebuild() if job.full_refresh else state.refresh()
    done = {name: {"result": report["result"]} for name, s in STATES.items() if s.user_model}
    done["state"] = {**report, "seconds": round(time.time() - start, 2)}
    models = state.models()
    for name, model in MODELS.items():
        if model.kind == "table" and name not in STATES:
            start = time.time()
            rows = models[name]
            rows.write.mode("overwrite").parquet(job.model(name))
            spark.catalog.refreshByPath(job.model(name))
            models.stored[name] = spark.read.schema(rows.schema).parquet(job.model(name))
            done[name] = {"result": "added up", "seconds": round(time.time() - start, 2)}
    return done


def transform(spark: SparkSession, job: Job) -> dict:
    """Write the stored models: by deltas, or, for a selection or without `delta`, from bronze."""
    if job.delta and not job.select:
        return _transform_by_deltas(spark, job)
    return _transform_in_order(spark, job)


def _transform_in_order(spark: SparkSession, job: Job) -> dict:
    """Write the stored models in order. Each is read back by the models after it, so the
    text of the messages is scanned once per run."""
    models = Lineage(read_bronze(spark, job), job.options)
    done = {}
    wanted = ancestors(job.select) if job.select else list(dict.fromkeys(n for m in MODELS for n in ancestors(m)))
    for name in wanted:
        model = MODELS[name]
        if model.kind == "view":
            continue
        start = time.time()
        path = job.staging(name) if model.kind == "shared" else job.model(name)
        if model.kind == "incremental":
            note, models.stored[name] = _write_incremental(spark, job, name, models)
        else:
            note, rows = "rebuilt", models[name].drop(*LONG_TEXTS)
            rows.write.mode("overwrite").parquet(path)
            spark.catalog.refreshByPath(path)
            models.stored[name] = spark.read.schema(rows.schema).parquet(path)
        done[name] = {"result": note, "seconds": round(time.time() - start, 2)}
    return done


class ChecksFailed(Exception):
    """Raised after a run whose checks failed; the tables are written."""


def check(spark: SparkSession, job: Job) -> dict:
    """Run the suites and the declared checks over the stored models, one model at a time."""
    models = stored_models(spark, job)
    names = [n for n in checks.DECLARED if n in models.stored or MODELS.get(n) and MODELS[n].kind == "view"]
    parts = {"bronze_suite": checks.bronze_suite(models.bronze), "silver_suite": checks.silver_suite(models)}
    results = [r for df in [*parts.values(), *(checks.model_checks(models, n) for n in names)] for r in df.collect()]
    failed = [{k: r[k] for k in ("suite", "check", "column", "failed", "total")} for r in results if not r["success"]]
    if failed and job.fail_on_checks:
        raise ChecksFailed(failed)
    return {"checks": len(results), "failed": failed}


def run_pipeline(spark: SparkSession, job: Job) -> dict:
    """Run the steps that are not skipped and report on each."""
    steps = {
        "extraction": (job.skip_extract, extract),
        "load": (job.skip_load, load),
        "transform": (job.skip_transform, transform),
        "checks": (job.skip_checks, check),
    }
    return {name: {"skipped": True} if skip else step(spark, job) for name, (skip, step) in steps.items()}


def stored_models(spark: SparkSession, job: Job) -> Lineage:
    """The models of the last run, for queries, checks and SQL views."""
    stored = {}
    for name, model in MODELS.items():
        path = job.model(name)
        if model.kind in ("table", "incremental") and table_there(spark, path):
            stored[name] = SnapshotTable.open(spark, path).read()
        elif model.kind == "table" and merge.table_exists(spark, path):
            stored[name] = spark.read.parquet(path)
    return Lineage(read_bronze(spark, job), job.options, stored)
