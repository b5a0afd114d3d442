"""Keyword search through an inverted index: postings of stemmed words, kept up by each delivery.

A posting holds a term, a word of that stem, a document's key and fields to filter on, and the word's
places in the message. Postings lie in buckets by term, sorted by term and project, in a table of
versions; a search reads the buckets of its terms and skips the rest of their rows by
file and row-group bounds. It never opens the messages. `scan` answers the same questions from the messages.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.functions.stems import stem, words
from tracemill.operators.search import LogFilter
from tracemill.sources.documents import with_message_text
from tracemill.sources.snapshots import SnapshotTable

BUCKETS = 64
KEY = ["_id", "projectId", "sessionId", "timestamp"]
POSTING = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("term", "word", *KEY)]
    + [T.StructField("places", T.ArrayType(T.IntegerType())), T.StructField("bucket", T.IntegerType())]
)
_WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class Query:
    """Any word matches, by its stem; every phrase must occur, word for word; no banned word may occur.

    With phrases given, words do not widen the match.
    """

    words: tuple[str, ...]
    phrases: tuple[tuple[str, ...], ...]
    banned: tuple[str, ...]

    @staticmethod
    def parse(text: str) -> Query:
        """Double quotes hold a phrase; a minus before a word bans it."""
        phrases = [tuple(_WORD.findall(p.lower())) for p in re.findall(r'"([^"]+)"', text)]
        parts = re.sub(r'"[^"]*"', " ", text).lower().split()
        found = lambda keep: tuple(dict.fromkeys(w for p in parts if p.startswith("-") is not keep for w in _WORD.findall(p)))
        return Query(found(True), tuple(p for p in phrases if p), found(False))

    @property
    def all_words(self) -> list[str]:
        return list(dict.fromkeys([*self.words, *self.banned, *(w for p in self.phrases for w in p)]))


def _field_filter(f: LogFilter) -> Column:
    """Project, session and days, as the paged search takes them."""
    keep = F.col("projectId") == f.project
    if f.session:
        keep &= F.col("sessionId") == f.session
    if f.start:
        keep &= F.col("timestamp") >= f.start
    if f.end:
        keep &= F.col("timestamp") <= f"{f.end}T23:59:59.999Z"
    return keep


def _shifted(places: str, by: int) -> Column:
    return F.transform(places, lambda p: p - by)


def postings(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row per document and distinct word. Documents without words have none."""
    if "message" not in docs.columns:
        docs = with_message_text(docs)
    each = docs.select(*KEY, F.posexplode(words(F.col("message"))).alias("place", "word"))
    # Places of a word are gathered per document, whose rows are in one task: most of it is combined before the shuffle.
    found = each.groupBy("word", *KEY).agg(F.sort_array(F.collect_list("place")).alias("places"))
    term = stem(F.col("word"))
    return found.withColumn("term", term).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")).select(*POSTING.fieldNames())


def scan(docs: DataFrame, f: LogFilter) -> DataFrame:
    """Documents that match the search, from their messages."""
    query = Query.parse(f.search or "")
    if "message" not in docs.columns:
        docs = with_message_text(docs)
    found = words(F.col("message"))
    stems = F.transform(found, stem)
    any_of = lambda wanted: F.arrays_overlap(stems, F.array(*[stem(F.lit(w)) for w in wanted]))
    hit = F.lit(bool(query.words or query.phrases))
    spaced = F.concat(F.lit(" "), F.array_join(found, " "), F.lit(" "))
    for phrase in query.phrases:
        hit &= spaced.contains(f" {' '.join(phrase)} ")
    if query.words and not query.phrases:
        hit &= any_of(query.words)
    if query.banned:
        hit &= ~any_of(query.banned)
    return docs.where(_field_filter(f)).where(F.coalesce(hit, F.lit(False)))


class TextIndex:
    """The index below a folder. Deliveries may come in any order and again; each is indexed once.

    A document id should be delivered once; of a repeated id the places add up.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.buckets = spark, buckets
        self.table = SnapshotTable(spark, path, POSTING, "bucket", ("term", "projectId"), ("term", "projectId", "timestamp"))

    def add(self, docs: DataFrame, delivery: str) -> bool:
        """Index a delivery; False if it has been indexed before."""
        return self.table.append(postings(docs, self.buckets), tag=delivery) is not None

    def add_new(self, landing: DataFrame) -> list[str]:
        """Index the deliveries of a landing table (columns ``stream`` and ``batch``) that the index lacks, as one change each."""
        known = {r["tag"] for r in self.table.history().select("tag").collect()}
        there = [(r["stream"], r["batch"]) for r in landing.select("stream", "batch").distinct().orderBy("stream", "batch").collect()]
        fresh = [(s, b) for s, b in there if f"{s}/{b}" not in known]
        for stream, batch in fresh:
            self.add(landing.where((F.col("stream") == stream) & (F.col("batch") == batch)), f"{stream}/{batch}")
        return [f"{s}/{b}" for s, b in fresh]

    def compact(self) -> None:
        """Fewer, larger files in buckets that many deliveries have added to."""
        self.table.compact()

    def _terms(self, query: Query) -> dict[str, tuple[str, int]]:
        """Stem and bucket of each word of a query; no table is read."""
        rows = self.spark.createDataFrame([(w,) for w in query.all_words], "word string").withColumn("term", stem(F.col("word")))
        placed = rows.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int"))
        return {r["word"]: (r["term"], r["bucket"]) for r in placed.collect()}

    def matching(self, f: LogFilter) -> DataFrame:
        """``_id, projectId, sessionId, timestamp`` of the documents that match."""
        query = Query.parse(f.search or "")
        nothing = self.spark.createDataFrame([], T.StructType([x for x in POSTING.fields if x.name in KEY])).select(*KEY)
        if not (query.words or query.phrases):
            return nothing
        terms = self._terms(query)
        near = [
            (F.col("bucket") == b) & (F.col("term_min") <= t) & (F.col("term_max") >= t) & (F.col("projectId_min") <= f.project) & (F.col("projectId_max") >= f.project)
            for t, b in set(terms.values())
        ]
        wanted = sorted({t for t, _ in terms.values()})
        rows = self.table.read(where=reduce(lambda a, b: a | b, near)).where(F.col("term").isin(wanted)).where(_field_filter(f))
        has = lambda some: F.max(F.col("term").isin([terms[w][0] for w in some]))
        hits: dict[str, Column] = {"_banned": has(query.banned) if query.banned else F.lit(False)}
        if query.phrases:
            for i, phrase in enumerate(query.phrases):
                for k, word in enumerate(phrase):
                    begins = F.when(F.col("word") == word, _shifted("places", k))
                    hits[f"_p{i}_{k}"] = F.flatten(F.collect_list(begins))
        else:
            hits["_any"] = has(query.words)
        grouped = rows.groupBy(*KEY).agg(*[c.alias(n) for n, c in hits.items()])
        found = grouped.where(~F.col("_banned"))
        if not query.phrases:
            found = found.where("_any")
        for i, phrase in enumerate(query.phrases):
            starts = reduce(F.array_intersect, [F.col(f"_p{i}_{k}") for k in range(len(phrase))])
            found = found.where(F.size(starts) > 0)
        return found.select(*KEY)

    def documents(self, docs: DataFrame, f: LogFilter) -> DataFrame:
        """The matching rows of a table of documents."""
        keys = self.matching(f).select("_id", F.col("projectId").alias("_project"))
        same = (docs["_id"] == keys["_id"]) & (docs["projectId"] == keys["_project"])
        return docs.where(F.col("projectId") == f.project).join(keys, same, "left_semi")
