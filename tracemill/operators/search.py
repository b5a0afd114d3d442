"""Filters, keyword search, key-based pages and activity charts over log documents.

Document timestamps are ISO text and are compared as text.
"""

from __future__ import annotations

import base64
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions import expressions as x
from tracemill.sources.documents import with_message_text

MAX_PAGE = 100
MAX_PERIODS = 90
# A word ends where no letter, digit or underscore follows.
EDGE = r"[^\p{L}\p{N}_]"


@dataclass(frozen=True)
class LogFilter:
    """Which documents to look at. Dates are ISO days, both inclusive."""

    project: str
    session: str | None = None
    search: str | None = None
    start: str | None = None
    end: str | None = None

    def __post_init__(self):
        if not self.project:
            raise ValueError("a project is required")


def keyword_match(text: Column, query: str) -> Column:
    """Any plain word matches; every quoted phrase must occur; no -word may occur.

    With phrases given, plain words do not widen the match.
    """
    folded = F.lower(text)
    phrases = [p.lower() for p in re.findall(r'"([^"]+)"', query)]
    rest = re.sub(r'"[^"]*"', " ", query).lower().split()
    words = lambda parts: [w for p in parts for w in re.findall(r"\w+", p)]
    banned = words(p[1:] for p in rest if p.startswith("-"))
    wanted = words(p for p in rest if not p.startswith("-"))

    def any_of(terms: list[str]) -> Column:
        return folded.rlike(f"(^|{EDGE})({'|'.join(re.escape(t) for t in terms)})({EDGE}|$)")

    hit = F.lit(bool(phrases or wanted))
    for p in phrases:
        hit = hit & folded.contains(p)
    if wanted and not phrases:
        hit = hit & any_of(wanted)
    if banned:
        hit = hit & ~any_of(banned)
    return F.coalesce(hit, F.lit(False))


def _base(docs: DataFrame, f: LogFilter) -> DataFrame:
    docs = docs.where(F.col("projectId") == f.project)
    if f.session:
        docs = docs.where(F.col("sessionId") == f.session)
    if f.search:
        if "message" not in docs.columns:
            docs = with_message_text(docs)
        docs = docs.where(keyword_match(F.col("message"), f.search))
    return docs


def _between(docs: DataFrame, f: LogFilter) -> DataFrame:
    if f.start:
        docs = docs.where(F.col("timestamp") >= f.start)
    if f.end:
        docs = docs.where(F.col("timestamp") <= f"{f.end}T23:59:59.999Z")
    return docs


def matching(docs: DataFrame, f: LogFilter) -> DataFrame:
    return _between(_base(docs, f), f)


def match_count(docs: DataFrame, f: LogFilter) -> DataFrame:
    """All matches, wherever the page stands."""
    return matching(docs, f).agg(F.count(F.lit(1)).alias("total"))


def encode_cursor(timestamp: str, doc_id: str) -> str:
    return base64.b64encode(f"{timestamp}|{doc_id}".encode()).decode()


def decode_cursor(cursor: str) -> tuple[str, str]:
    try:
        timestamp, doc_id = base64.b64decode(cursor, validate=True).decode().split("|")
    except ValueError as error:
        raise ValueError("invalid cursor") from error
    return timestamp, doc_id


def page(
    docs: DataFrame, f: LogFilter, *, cursor: str | None = None, limit: int = 50, order: str = "desc"
) -> DataFrame:
    """At most `limit` documents in (timestamp, id) order after the cursor.

    Each row tells whether more follow and the cursor of the next page. One row more than
    the page is fetched for that, so the window at the end sees at most 101 rows.
    """
    if not 1 <= limit <= MAX_PAGE:
        raise ValueError(f"limit must be between 1 and {MAX_PAGE}")
    if order not in ("asc", "desc"):
        raise ValueError("order must be asc or desc")
    ts, key = F.col("timestamp"), F.col("_id")
    found = matching(docs, f)
    if cursor:
        at, last = decode_cursor(cursor)
        past = (ts < at) | ((ts == at) & (key < last)) if order == "desc" else (ts > at) | ((ts == at) & (key > last))
        found = found.where(past)
    by = [ts.desc(), key.desc()] if order == "desc" else [ts.asc(), key.asc()]
    fetched = found.orderBy(*by).limit(limit + 1).withColumn("_row", F.row_number().over(Window.orderBy(*by)))
    everything = Window.partitionBy(F.lit(0))
    more = F.max("_row").over(everything) > limit
    last_row = F.max(F.when(F.col("_row") == limit, F.concat_ws("|", ts, key))).over(everything)
    return (
        fetched.withColumns(
            {"has_more": more, "next_cursor": F.when(more, F.base64(last_row.cast("binary")))}
        )
        .where(F.col("_row") <= limit)
        .drop("_row")
    )


def export_rows(docs: DataFrame, f: LogFilter, limit: int | None = None) -> DataFrame:
    """Matching documents, newest delivered first; all of them, or at most `limit`. The dates bound
    the delivery time, the end taken as given."""
    found = _base(docs, f)
    if f.start:
        found = found.where(F.col("ingestedAt") >= F.lit(f.start).cast("timestamp"))
    if f.end:
        found = found.where(F.col("ingestedAt") <= F.lit(f.end).cast("timestamp"))
    found = found.orderBy(F.desc("ingestedAt"), F.desc("_id"))
    return found if limit is None else found.limit(limit)


def export_json(docs: DataFrame, f: LogFilter, path: str, limit: int | None = None) -> bool:
    """Write the export; tells whether more documents match than the limit lets through."""
    export_rows(docs, f, limit).write.mode("overwrite").json(path)
    return limit is not None and export_rows(docs, f, limit + 1).count() > limit


def message_activity(docs: DataFrame, f: LogFilter, granularity: str = "day", periods: int = 14) -> DataFrame:
    """User and assistant messages per period for the last periods, oldest first.

    A period counts as soon as it has any document.
    """
    if granularity not in ("hour", "day", "week"):
        raise ValueError("granularity must be hour, day or week")
    if not 1 <= periods <= MAX_PERIODS:
        raise ValueError(f"periods must be between 1 and {MAX_PERIODS}")
    at = x.parse_timestamp(F.col("timestamp"))
    return (
        matching(docs, f)
        .select("type", x.period(at, granularity).alias("periodStart"))
        .where(F.col("periodStart").isNotNull())
        .groupBy("periodStart")
        .agg(
            F.count_if(F.col("type") == "user").alias("user"),
            F.count_if(F.col("type") == "assistant").alias("assistant"),
        )
        .orderBy(F.desc("periodStart"))
        .limit(periods)
        .select(x.period_label(F.col("periodStart"), granularity).alias("period"), "periodStart", "user", "assistant")
        .orderBy("periodStart")
    )


def activity_total(activity: DataFrame) -> DataFrame:
    return activity.agg(x.zero(F.sum(F.col("user") + F.col("assistant"))).alias("totalMessages"))


def projects(docs: DataFrame) -> DataFrame:
    return docs.select("projectId").distinct().orderBy("projectId")


def sessions(docs: DataFrame, project: str) -> DataFrame:
    found = docs.where((F.col("projectId") == project) & (F.col("sessionId") != ""))
    return found.select("sessionId").distinct().orderBy("sessionId")


def documents_per_project(docs: DataFrame) -> DataFrame:
    return docs.groupBy("projectId").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"))
