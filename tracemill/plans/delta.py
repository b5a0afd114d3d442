"""Transform by deltas: state tables that are kept up to date from the rows that changed.

What orders or groups rows does so within a session, or adds up. So the unit of change is the session:
the rows that differ between two versions of bronze name the touched sessions, and only the
days on which these have rows are read. Their facts and their cells replace the old ones. Cells hold counts, sums,
bounds and the keys of distinct counts; medians and modes come from counts per exact value. Every aggregate is
then a sum over cells, which are as small as the sessions and tools in use, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions import expressions as x
from tracemill.functions.expressions import null_safe_key
from tracemill.operators.merge import remove_folder
from tracemill.plans import aggregates, dimensions, facts
from tracemill.plans.catalog import Lineage, Options
from tracemill.sources.snapshots import SnapshotTable, table_there


def session_key() -> Column:
    """The session, rows without one taken together, as the ordered columns take them."""
    return null_safe_key(F.col("session_id"))


def message_cells(messages: DataFrame) -> DataFrame:
    return messages.groupBy("partition_date", "hour_of_day", "day_of_week", "session_id", "project_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("content_length").alias("length"),
        F.count("content_length").alias("measured"),
        x.count_where(F.col("role") == "user").alias("user"),
        x.count_where(F.col("role") == "assistant").alias("assistant"),
        x.count_where(F.col("has_code_block")).alias("code"),
        x.count_where(F.col("is_question")).alias("questions"),
    )


def usage_cells(usage: DataFrame) -> DataFrame:
    micros = x.to_micros(F.col("estimated_execution_seconds"))
    return usage.groupBy("partition_date", "hour_of_day", "day_of_week", "tool_name", "tool_category", "session_id", "project_id").agg(
        F.count(F.lit(1)).alias("n"),
        x.count_where(F.col("is_invocation")).alias("invocations"),
        x.count_where(F.col("is_result")).alias("results"),
        F.sum(micros).alias("micros"),
        F.count(micros).alias("timed"),
        F.max(micros).alias("longest"),
        F.min("effective_timestamp").alias("first_at"),
        F.max("effective_timestamp").alias("last_at"),
        x.count_where(F.col("is_file_operation")).alias("file"),
        x.count_where(F.col("is_search_operation")).alias("search"),
        x.count_where(F.col("is_shell_command")).alias("shell"),
    )


def duration_counts(usage: DataFrame) -> DataFrame:
    """Calls per exact duration: the state of a median."""
    timed = usage.withColumn("micros", x.to_micros(F.col("estimated_execution_seconds"))).where("micros IS NOT NULL")
    return timed.groupBy("partition_date", "tool_name", "tool_category", "session_id", "micros").agg(F.count(F.lit(1)).alias("n"))


def file_cells(operations: DataFrame) -> DataFrame:
    return operations.groupBy("partition_date", "tool_name", *aggregates.FILE_KEYS, "file_path", "session_id", "project_id").agg(
        F.count(F.lit(1)).alias("n"),
        x.count_where(F.col("is_read")).alias("reads"),
        x.count_where(F.col("is_write")).alias("writes"),
        x.count_where(F.col("is_edit")).alias("edits"),
        F.sum("operation_content_length").alias("length"),
    )


@dataclass(frozen=True)
class State:
    """A state table: its day column, and its rows from the models of the touched sessions."""

    day: str
    build: Callable[[Lineage], DataFrame]
    user_model: bool = True


def _once(models: Lineage) -> DataFrame:
    """File operations without the repeats of sessions that lie in several projects."""
    nothing = models["session_fanout"].limit(0)
    return facts.fct_file_operations(models["int_tool_usage"], nothing, models["tool_categories"])


# Facts and session models that users read, then cells. The activity rollup comes last: until it is
# replaced, it tells on which days the touched sessions used to have rows.
STATES: dict[str, State] = {
    "fct_messages": State("date_key", lambda m: m["fct_messages"]),
    "fct_tool_calls": State("date_key", lambda m: m["fct_tool_calls"]),
    "fct_file_operations": State("date_key", lambda m: m["fct_file_operations"]),
    "int_sessions_computed": State("start_date", lambda m: m["int_sessions_computed"]),
    "dim_sessions": State("start_date", lambda m: m["dim_sessions"]),
    "message_cells": State("partition_date", lambda m: message_cells(m["message_features"]), False),
    "usage_cells": State("partition_date", lambda m: usage_cells(m["int_tool_usage"]), False),
    "duration_counts": State("partition_date", lambda m: duration_counts(m["int_tool_usage"]), False),
    "file_cells": State("partition_date", lambda m: file_cells(_once(m)), False),
    "activity_rollup": State("partition_date", lambda m: m["activity_rollup"]),
}


def _repeated(cells: DataFrame, fanout: DataFrame, sums: list[str]) -> DataFrame:
    """Cells as the facts count them: a session that lies in several projects counts once for each."""
    copies = F.coalesce("dimension_rows", F.lit(1))
    return cells.join(fanout, "session_id", "left").withColumns({c: F.col(c) * copies for c in sums}).drop("dimension_rows")


def daily_messages(cells: DataFrame) -> DataFrame:
    return cells.groupBy(F.col("partition_date").alias("date_key")).agg(
        F.sum("n").alias("message_count"),
        F.sum("user").alias("user_messages"),
        F.sum("assistant").alias("assistant_messages"),
        x.ratio(F.sum("length"), F.sum("measured")).alias("avg_content_length"),
        F.sum("length").alias("total_content_length"),
        F.sum("code").alias("messages_with_code"),
        F.sum("questions").alias("question_count"),
    )


def daily_tools(cells: DataFrame) -> DataFrame:
    return cells.groupBy(F.col("partition_date").alias("date_key")).agg(
        F.sum("n").alias("tool_call_count"),
        F.count_distinct("tool_name").alias("unique_tools_used"),
        F.sum("file").alias("file_operations"),
        F.sum("search").alias("search_operations"),
        F.sum("shell").alias("shell_commands"),
        (x.ratio(F.sum("micros"), F.sum("timed")) / F.lit(1e6)).alias("avg_execution_seconds"),
    )


def daily_file_operations(cells: DataFrame) -> DataFrame:
    return cells.groupBy(F.col("partition_date").alias("date_key")).agg(
        F.sum("n").alias("file_operation_count"),
        F.sum("reads").alias("file_reads"),
        F.sum("writes").alias("file_writes"),
        F.sum("edits").alias("file_edits"),
        F.count_distinct("file_path").alias("unique_files_touched"),
    )


def aggregate_models(models: Lineage, cells: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The models that add up cells, as far as the cells at hand allow; ``models`` holds the session models
    and the activity rollup."""
    fanout, out = models["session_fanout"], {}
    usage2 = files2 = messages2 = None
    if "usage_cells" in cells:
        usage2 = _repeated(cells["usage_cells"], fanout, ["n", "invocations", "results", "micros", "timed", "file", "search", "shell"])
    if "file_cells" in cells:
        files2 = _repeated(cells["file_cells"], fanout, ["n", "reads", "writes", "edits", "length"])
        out["agg_code_changes"] = aggregates.code_changes(files2)
    if usage2 is not None and files2 is not None:
        statistics = dimensions.tool_statistics_of_cells(cells["usage_cells"])
        file_types = dimensions.file_types_of_cells(cells["file_cells"].where(F.col("file_type_category").isNotNull()))
        out["dim_tools"] = dimensions.tools_with_use(models["tool_categories"], statistics, file_types)
        if "duration_counts" in cells:
            durations2 = _repeated(cells["duration_counts"], fanout, ["n"])
            out["agg_tool_efficiency"] = aggregates.tool_efficiency(usage2, durations2, out["dim_tools"])
    if "message_cells" in cells:
        messages2 = _repeated(cells["message_cells"], fanout, ["n", "length", "measured", "user", "assistant", "code", "questions"])
    if usage2 is not None and files2 is not None and messages2 is not None and "dim_sessions" in models.stored:
        sessions = models["dim_sessions"]
        daily = (aggregates.daily_sessions(sessions), daily_messages(messages2), daily_tools(usage2), daily_file_operations(files2))
        out["agg_daily_summary"] = aggregates.daily_summary(models["dim_date"], *daily)
        hourly = (aggregates.hourly_message_cells(cells["message_cells"]), aggregates.hourly_tool_cells(usage2), aggregates.session_starts(sessions))
        out["agg_hourly_activity"] = aggregates.hourly_activity(*hourly)
    return out


@dataclass(frozen=True)
class DeltaState:
    """State tables below a folder, kept up with a bronze table. ``user_root`` holds those that users read."""

    spark: SparkSession
    bronze: SnapshotTable
    root: str
    user_root: str
    staging: str
    options: Options
    names: tuple[str, ...] = tuple(STATES)  # a choice of them, for jobs that need only some models

    def path(self, name: str) -> str:
        return f"{self.user_root if STATES[name].user_model else self.root}/{name}"

    def read(self, name: str) -> DataFrame:
        return SnapshotTable.open(self.spark, self.path(name)).read()

    def version(self) -> int:
        """The version of bronze that all state tables have taken in; 0 if there is none."""
        path = f"{self.root}/taken_in"
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(path)
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return 0
        return self.spark.read.schema("version bigint").parquet(path).agg(F.max("version")).first()[0] or 0

    def _remember(self, version: int) -> None:
        self.spark.createDataFrame([(version,)], "version bigint").coalesce(1).write.mode("append").parquet(f"{self.root}/taken_in")

    def _between(self) -> list[str]:
        """Models of single rows and ordered rows that the states are built from."""
        usage = {"fct_tool_calls", "fct_file_operations", "usage_cells", "duration_counts", "file_cells"}
        messages = {"fct_messages", "dim_sessions", "message_cells"}
        return [m for m, of in (("message_features", messages), ("int_tool_usage", usage)) if of & set(self.names)]

    def _models(self, bronze: DataFrame) -> Lineage:
        """Models of some rows of bronze; what several states read is stored between."""
        models = Lineage(bronze, self.options)
        for name in self._between():
            path = f"{self.staging}/{name}"
            rows = models[name].drop("message_content", "message_raw", "tool_content", "raw_parameters")
            rows.write.mode("overwrite").parquet(path)
            models.stored[name] = self.spark.read.schema(rows.schema).parquet(path)
        return models

    def _each(self, write: Callable[[str], None]) -> None:
        """All state tables, two at a time; the activity rollup once the others are done."""
        with ThreadPoolExecutor(2) as pool:
            list(pool.map(write, [n for n in self.names if n != "activity_rollup"]))
        write("activity_rollup")

    def rebuild(self) -> dict:
        """All state from all of bronze."""
        version = self.bronze.current()
        models = self._models(self.bronze.read(version))

        def write(name: str) -> None:
            rows = STATES[name].build(models)
            if not table_there(self.spark, self.path(name)):
                remove_folder(self.spark, self.path(name))  # a plain table that an earlier run left
            SnapshotTable(self.spark, self.path(name), rows.schema, STATES[name].day, (), ("session_id",)).overwrite(rows, "rebuild")

        self._each(write)
        self._remember(version)
        return {"result": "rebuilt", "bronze_version": version}

    def _touched(self, since: int) -> DataFrame:
        """Sessions with rows that differ between two versions of bronze, from the files that differ."""
        gone, new = self.bronze.difference(since)
        mark = lambda rows, sign: rows.select(session_key().alias("_session"), F.xxhash64(*rows.columns).alias("_row"), F.lit(sign).alias("_n"))
        both = mark(gone, -1).unionByName(mark(new, 1))
        changed = both.groupBy("_session", "_row").agg(F.sum("_n").alias("_n")).where("_n != 0").select("_session").distinct()
        path = f"{self.staging}/touched_sessions"
        changed.write.mode("overwrite").parquet(path)
        return self.spark.read.schema("_session string").parquet(path)

    def refresh(self) -> dict:
        """Take in what has changed in bronze since the last time; a run that died is simply made again."""
        since, version = self.version(), self.bronze.current()
        if since == version:
            return {"result": "nothing new", "bronze_version": version}
        if not since or since < self.bronze.versions()[0] or not all(table_there(self.spark, self.path(n)) for n in self.names):
            return self.rebuild()
        touched = self._touched(since)
        # Days are few whatever the number of rows.
        old = self.read("activity_rollup").withColumn("_session", session_key()).join(touched, "_session", "left_semi").select("partition_date")
        gone, new = self.bronze.difference(since)
        days = [r[0] for r in old.union(gone.select("date")).union(new.select("date")).distinct().collect()]
        rows = self.bronze.read(version, F.col("date").isin(days)).withColumn("_session", session_key()).join(touched, "_session", "left_semi").drop("_session")
        models = self._models(rows)

        def replace(name: str) -> None:
            table = SnapshotTable.open(self.spark, self.path(name))
            table.replace_keys(touched, session_key(), STATES[name].build(models), F.col(STATES[name].day).isin(days))

        self._each(replace)
        self._remember(version)
        return {"result": f"merged {touched.count()} sessions", "bronze_version": version, "days": len(days), "bronze_files": len(rows.inputFiles())}

    def models(self) -> Lineage:
        """All models, from the state tables."""
        models = Lineage(self.bronze.read(), self.options)
        cells = {}
        for name in self.names:
            (models.stored if STATES[name].user_model else cells)[name] = self.read(name)
        models.stored.update(aggregate_models(models, cells))
        return models
