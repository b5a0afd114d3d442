"""Repeated passages of lines, found as overlapping three-line windows. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import check_columns

LINES = 3
#: A line that holds anything but ASCII white space.
FULL_LINE = r"[^\x20\x09-\x0D]"


def _full_lines(lines: Column) -> Column:
    """An array of ``(i, a, b)`` per full line: its position and two hashes."""
    numbered = F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    return F.transform(
        F.filter(numbered, lambda e: e["x"].rlike(FULL_LINE)),
        lambda e: F.struct(e["i"].alias("i"), F.xxhash64(e["x"]).alias("a"), F.xxhash64(F.lit(1), e["x"]).alias("b")),
    )


def repeated_lines(docs: DataFrame) -> DataFrame:
    """``(doc_id, version, gone)``: positions, from 0, of lines in windows that occurred earlier.

    ``version`` is a hash of the text, so rows that share a doc_id are told apart unless their texts
    are equal; equal rows are one occurrence. Windows are compared by 128 bits of hash. Occurrences are
    ordered by (doc_id, version, position), nulls first; every occurrence after the first is removed,
    and overlapping ones add up. Counts and first places are combined before the shuffle.
    """
    hashed = docs.where("text is not null").select(
        "doc_id", F.xxhash64("text").alias("version"), _full_lines(F.split("text", "\n")).alias("h")
    )
    size = F.greatest(F.size("h") - (LINES - 1), F.lit(0))
    parts = [F.slice("h", i + 1, size).alias(f"l{i}") for i in range(LINES)]
    windows = hashed.where(F.size("h") >= LINES).select("doc_id", "version", F.inline(F.arrays_zip(*parts)))
    lines = [F.col(f"l{i}") for i in range(LINES)]
    windows = windows.select(
        F.xxhash64(*[x["a"] for x in lines]).alias("h1"),
        F.xxhash64(*[x["b"] for x in lines]).alias("h2"),
        F.struct("doc_id", "version", lines[0]["i"].alias("at")).alias("place"),
        F.array(*[x["i"] for x in lines]).alias("rows"),
    )
    repeated = windows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("place").alias("first")).where("n > 1").drop("n")
    later = windows.join(repeated, ["h1", "h2"]).where("place != first")
    rows = later.select("place.doc_id", "place.version", F.explode("rows").alias("i"))
    return rows.groupBy("doc_id", "version").agg(F.collect_set("i").alias("gone"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` as ``row`` (a struct of all columns), with ``new_text``, ``n_lines`` and ``n_removed``.

    Lines lie between line feeds. Lines of white space only belong to no window and stay. Texts of fewer
    than three full lines, empty ones and null stay as they are (null: 0 lines); a text whose lines all go is empty.
    Every row of ``docs`` is returned, whatever its columns are called; empty tables give empty results.
    """
    check_columns(docs, "doc_id", "text")
    gone = repeated_lines(docs).select(F.struct("doc_id", "version").alias("key"), "gone")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.struct("doc_id", F.xxhash64("text").alias("version")).alias("k"))
    same = F.col("k.doc_id").eqNullSafe(F.col("key.doc_id")) & (F.col("k.version") == F.col("key.version"))
    lines = F.split("row.text", "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    return (
        rows.join(gone, same, "left")
        .select("row", "gone", F.when(F.col("gone").isNotNull(), lines).alias("lines"))
        .select(
            "row",
            F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n")).alias("new_text"),
            F.coalesce(F.length("row.text") - F.length(F.replace("row.text", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("bigint").alias("n_lines"),
            F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_removed"),
        )
    )


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the texts after removal, and ``n_chars`` counted anew where there is such a column."""
    fresh = {"text": F.col("new_text"), "n_chars": F.length("new_text").cast("bigint")}
    return dedup_lines(docs).select(*[fresh.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


ORACLE_SQL = r"""
WITH line AS (
  SELECT doc_id, i - 1 AS i, string_split(text, chr(10))[i] AS x
  FROM (SELECT doc_id, text, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL)
), full_line AS (
  SELECT doc_id, i, x,
    lead(x) OVER w AS x2, lead(x, 2) OVER w AS x3, lead(i) OVER w AS i2, lead(i, 2) OVER w AS i3
  FROM line WHERE regexp_matches(x, '[^\x20\x09-\x0D]') WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY x, x2, x3 ORDER BY doc_id, i) AS nth FROM full_line WHERE i3 IS NOT NULL
), gone AS (
  SELECT DISTINCT doc_id, unnest([i, i2, i3]) AS i FROM placed WHERE nth > 1
), kept AS (
  SELECT l.doc_id, string_agg(l.x, chr(10) ORDER BY l.i) AS t, count(*) AS n
  FROM line l ANTI JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id
)
SELECT d.doc_id,
  CAST(CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS BIGINT) AS n_lines,
  CAST(CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) - coalesce(k.n, 0) END AS BIGINT) AS n_removed,
  sha256(CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.t, '') END) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
