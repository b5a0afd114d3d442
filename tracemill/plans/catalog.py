"""Names, inputs and builders of all models, and the lazy graph over them."""

from __future__ import annotations

import datetime
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.plans import aggregates, dimensions, facts, silver, staging
from tracemill.sources.seeds import tool_categories


@dataclass(frozen=True)
class Options:
    """Run settings handed to the builders."""

    as_of: datetime.date | None = None
    hot_rows: int | None = None
    split: bool | None = None

    @property
    def today(self) -> Column:
        return F.lit(self.as_of) if self.as_of else F.current_date()

    @property
    def order(self) -> dict:
        return {"hot_rows": self.hot_rows, "split": self.split}


@dataclass(frozen=True)
class Model:
    """`kind` is view (never stored), shared (stored during a run without its long texts, for
    the models after it), table, or incremental (stored, merged on `key`)."""

    inputs: tuple[str, ...]
    build: Callable[..., DataFrame]
    kind: str = "view"
    key: str | None = None
    stands_in: str | None = None  # a stored model that has these columns and more


LONG_TEXTS = ["message_content", "message_raw", "tool_content", "raw_parameters"]

MODELS: dict[str, Model] = {
    "tool_categories": Model((), lambda o: None),
    "entries": Model(("bronze",), lambda o, b: staging.staged_entries(b)),
    "stg_conversations": Model(("bronze",), lambda o, b: staging.stg_conversations(b)),
    "stg_messages": Model(("entries",), lambda o, e: staging.stg_messages(e, **o.order)),
    "stg_tool_calls": Model(("entries",), lambda o, e: staging.stg_tool_calls(e, **o.order)),
    "int_messages_enriched": Model(("entries",), lambda o, e: silver.int_messages_enriched(e, **o.order)),
    # The enriched messages in two steps; the first needs no shuffle.
    "message_features": Model(("entries",), lambda o, e: silver.message_features(e), "shared"),
    "ordered_messages": Model(
        ("message_features",), lambda o, m: staging.with_message_order(m, **o.order)
    ),
    "int_tool_usage": Model(
        ("entries", "tool_categories"), lambda o, e, c: silver.int_tool_usage(e, c, **o.order), "shared"
    ),
    "activity_rollup": Model(("entries",), lambda o, e: silver.activity_rollup(e), "table"),
    "session_messages": Model(("entries",), lambda o, e: silver.session_messages(e)),
    "session_tools": Model(("entries",), lambda o, e: silver.session_tools(e)),
    "int_sessions_computed": Model(
        ("activity_rollup", "session_messages", "session_tools"),
        lambda o, r, m, t: silver.int_sessions_computed(r, m, t),
        "table",
    ),
    "session_fanout": Model(("activity_rollup",), lambda o, r: facts.session_fanout(r), "table"),
    "dim_date": Model(("activity_rollup",), lambda o, r: dimensions.dim_date(r, o.today), "table"),
    "dim_projects": Model(
        ("activity_rollup", "int_sessions_computed"),
        lambda o, r, s: dimensions.dim_projects(r, s, o.today),
        "table",
    ),
    "dim_sessions": Model(
        ("int_sessions_computed", "message_features"),
        lambda o, s, m: dimensions.dim_sessions(s, m),
        "table",
    ),
    "dim_tools": Model(
        ("tool_categories", "int_tool_usage"), lambda o, c, u: dimensions.dim_tools(c, u), "table"
    ),
    "fct_messages": Model(
        ("ordered_messages", "session_fanout"),
        lambda o, m, f: facts.fct_messages(m, f),
        "incremental",
        "message_key",
    ),
    # The fact without its ordered columns, for aggregates that do not read them.
    "message_measures": Model(
        ("message_features", "session_fanout"),
        lambda o, m, f: facts.with_session_key(m, f).withColumn("date_key", F.col("partition_date")),
        stands_in="fct_messages",
    ),
    "fct_tool_calls": Model(
        ("int_tool_usage", "session_fanout", "tool_categories"),
        lambda o, u, f, c: facts.fct_tool_calls(u, f, c),
        "incremental",
        "tool_call_key",
    ),
    "fct_file_operations": Model(
        ("int_tool_usage", "session_fanout", "tool_categories"),
        lambda o, u, f, c: facts.fct_file_operations(u, f, c),
        "incremental",
        "file_operation_key",
    ),
    "agg_session_metrics": Model(("dim_sessions",), lambda o, s: aggregates.agg_session_metrics(s), "table"),
    "agg_tool_efficiency": Model(
        ("fct_tool_calls", "dim_tools"), lambda o, c, t: aggregates.agg_tool_efficiency(c, t), "table"
    ),
    "agg_code_changes": Model(
        ("fct_file_operations",), lambda o, f: aggregates.agg_code_changes(f), "table"
    ),
    "agg_daily_summary": Model(
        ("dim_date", "dim_sessions", "message_measures", "fct_tool_calls", "fct_file_operations"),
        lambda o, *inputs: aggregates.agg_daily_summary(*inputs),
        "table",
    ),
    "agg_hourly_activity": Model(
        ("message_features", "fct_tool_calls", "dim_sessions"),
        lambda o, *inputs: aggregates.agg_hourly_activity(*inputs),
        "table",
    ),
}


# The order in which a reader sees a table; stored tables are unordered.
DISPLAY_ORDER = {
    "dim_date": [F.asc, "date_key"],
    "agg_daily_summary": [F.desc, "date_key"],
    "agg_hourly_activity": [F.asc, "day_of_week", "hour_of_day"],
    "agg_tool_efficiency": [F.desc, "total_calls"],
}


def ancestors(name: str) -> list[str]:
    """The model and everything it reads, inputs first."""
    seen: list[str] = []

    def visit(n: str) -> None:
        if n in MODELS and n not in seen:
            for parent in MODELS[n].inputs:
                visit(parent)
            if MODELS[n].stands_in:
                visit(MODELS[n].stands_in)
            if n not in seen:
                seen.append(n)

    visit(name)
    return seen


@dataclass
class Lineage:
    """Builds models on demand from a bronze table; stored ones are used as they are."""

    bronze: DataFrame
    options: Options = field(default_factory=Options)
    stored: dict[str, DataFrame] = field(default_factory=dict)
    built: dict[str, DataFrame] = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        if name == "bronze":
            return self.bronze
        if name in self.stored:
            return self.stored[name]
        if name not in self.built:
            model = MODELS[name]
            if model.stands_in in self.stored:
                return self.stored[model.stands_in]
            if name == "tool_categories":
                self.built[name] = tool_categories(self.bronze.sparkSession)
            else:
                self.built[name] = model.build(self.options, *[self[i] for i in model.inputs])
        return self.built[name]

    def in_display_order(self, name: str) -> DataFrame:
        if name not in DISPLAY_ORDER:
            return self[name]
        direction, *columns = DISPLAY_ORDER[name]
        return self[name].orderBy(*[direction(c) for c in columns])

    def register_views(self, names: list[str] | None = None) -> None:
        """Temp views, so that any SQL text can run over the models."""
        for name in names or list(MODELS):
            self[name].createOrReplaceTempView(name)
