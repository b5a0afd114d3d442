"""Periodic runs of words: seeds on diagonals, extended to maximal stretches.

A run of period q is a stretch on diagonal q (words i and i + q are equal) of at least max(12 - q, q)
places. Equal k-grams of one document lie on such a diagonal, so each class of lags is seeded with
grams no longer than the overlap its runs guarantee: six words for lags below 8, and 2^t words for
lags from 2^t to 2^(t+1) - 1. Grams are named by prefix doubling, over the texts of a block at once.

Pairs stay linear in the text. For lags below 8 the next occurrence of a gram is the only partner: a nearer one
would give the run a smaller period. For longer lags one of the pair is a head, that is, an occurrence with no
equal gram at most half a gram before it. A stretch holds a gram that does not overlap itself that far, and then each
of its occurrences is a head; or the stretch lies in two runs of a smaller period and begins where one of them
begins, which is a head of that run. A run of period p has p heads with up to 2^t / p partners each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import blocks, byte_column, check_columns, ranges

MIN_LENGTH = 12
WORD = r"([^\x20\x09-\x0D]+)"
BLOCK_BYTES = 1 << 20
_SHORT_LAGS, _SHORT_GRAM = 8, 6
_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False

Runs = tuple[np.ndarray, np.ndarray, np.ndarray]


def words_of(data: np.ndarray, bounds: np.ndarray) -> tuple[pa.BinaryArray, np.ndarray]:
    """All words of the texts, and the n+1 bounds of each text's words."""
    inside = _IS_WORD[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = bounds[:-1][bounds[:-1] < len(data)]
    first[cuts] = inside[cuts]
    starts = np.flatnonzero(first)
    packed = data[inside]
    before = np.cumsum(inside) - inside
    offsets = np.append(before[starts], len(packed)).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(packed)])
    return words, np.searchsorted(starts, bounds)


class Grams:
    """Names of the 2^t-grams of every place; equal names within a level mean equal grams of one text. -1: occurs once."""

    def __init__(self, words: np.ndarray, text: np.ndarray):
        self.n = len(words)
        self.levels = [self._names(np.arange(self.n), text * (int(words.max(initial=0)) + 1) + words)]

    def _names(self, places: np.ndarray, keys: np.ndarray) -> np.ndarray:
        out = np.full(self.n, -1, np.int32)
        if len(keys):
            _, names, count = np.unique(keys, return_inverse=True, return_counts=True)
            often = count[names] > 1
            out[places[often]] = names[often]
        return out

    def _joined(self, names: np.ndarray, shift: int) -> np.ndarray:
        """Names of the grams made of the named ones at a place and ``shift`` words on."""
        places = np.flatnonzero((names[: max(self.n - shift, 0)] >= 0) & (names[shift:] >= 0)) if self.n > shift else np.zeros(0, np.int64)
        return self._names(places, names[places].astype(np.int64) * self.n + names[places + shift])

    def grow(self) -> bool:
        """Adds a level; False if none of its grams occurs twice."""
        self.levels.append(self._joined(self.levels[-1], 1 << (len(self.levels) - 1)))
        return bool((self.levels[-1] >= 0).any())

    def six(self) -> np.ndarray:
        return self._joined(self.levels[2], 2)

    def equal(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        names, size = self.levels[level], 1 << level
        ok = (a >= 0) & (b + size <= self.n)
        x, y = names[np.where(ok, a, 0)], names[np.where(ok, b, 0)]
        return ok & (x == y) & (x >= 0)

    def extend(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First place and end, on the side of ``a``, of the stretch around a place where a and b agree."""
        left, right = a.copy(), a.copy()
        lag = b - a
        for level in range(len(self.levels) - 1, -1, -1):
            size = 1 << level
            for _ in range(1 + (level == len(self.levels) - 1)):
                right += size * self.equal(level, right, right + lag)
                left -= size * self.equal(level, left - size, left - size + lag)
        return left, right


def _spread(order: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(at, hi - lo), order[ranges(lo, hi - lo)]


def _pairs(names: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places of equal grams of ``least`` words at lags from ``least`` to twice that, one of them a head."""
    n = len(names)
    places = np.flatnonzero(names >= 0)
    order = places[np.argsort(names[places], kind="stable")]
    base = names[order].astype(np.int64) * (4 * n)
    key = base + order + n  # places lie between n and 2n within the range of a name
    head = np.ones(len(order), bool)
    head[1:] = np.diff(key) > least // 2
    at, base = order[head], base[head] + n
    later = _spread(order, at, np.searchsorted(key, base + at + least), np.searchsorted(key, base + at + 2 * least))
    floor = base - n
    sooner = _spread(order, at, np.searchsorted(key, np.maximum(base + at - 2 * least + 1, floor)), np.searchsorted(key, np.maximum(base + at - least + 1, floor)))
    return np.concatenate([later[0], sooner[1]]), np.concatenate([later[1], sooner[0]])


def _uncovered(a: np.ndarray, b: np.ndarray, gram: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that no earlier pair of their lag covers: a gram covers its places and the one behind it."""
    lag = np.sort((b - a).astype(np.int64) * (n + 1) + a)
    a, lag = lag % (n + 1), lag // (n + 1)
    fresh = np.ones(len(a), bool)
    fresh[1:] = (lag[1:] != lag[:-1]) | (a[1:] > a[:-1] + gram)
    return a[fresh], a[fresh] + lag[fresh]


def find_runs(words: np.ndarray, bounds: np.ndarray, min_length: int = MIN_LENGTH) -> Runs:
    """Start (place in ``words``), length and smallest period of all runs, by start and period."""
    n, sizes = len(words), np.diff(bounds)
    text = np.repeat(np.arange(len(sizes)), sizes)
    grams, seeds, longest = Grams(words, text), [], int(sizes.max(initial=0))
    while grams.grow():
        level = len(grams.levels) - 1
        size = 1 << level
        if 2 * size > longest:
            break
        if level == 2:
            names = grams.six()
            places = np.flatnonzero(names >= 0)
            order = places[np.argsort(names[places], kind="stable")]
            near = (names[order[1:]] == names[order[:-1]]) & (order[1:] - order[:-1] < _SHORT_LAGS)
            seeds.append(_uncovered(order[:-1][near], order[1:][near], _SHORT_GRAM, n))
        elif size >= _SHORT_LAGS:
            seeds.append(_uncovered(*_pairs(grams.levels[level], size), size, n))
    if not seeds:
        return (np.zeros(0, np.int64),) * 3
    a, b = (np.concatenate(x) for x in zip(*seeds, strict=True))
    period = b - a
    start, until = grams.extend(a, b)
    length = until - start + period
    good = length >= np.maximum(min_length, 2 * period)
    start, length, period = start[good], length[good], period[good]
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[new], length[new], period[new]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n places lie in one of the spans."""
    change = np.bincount(starts, minlength=n + 1) - np.bincount(ends, minlength=n + 1)
    return np.cumsum(change[:n]) > 0


def collapse(docs: DataFrame, min_length: int = MIN_LENGTH, keep: tuple[str, ...] | None = None) -> DataFrame:
    """``row`` (a struct of the columns ``keep``, all by default), ``n_words``, ``runs``, ``collapsed``.

    Words lie between ASCII white space. ``runs`` are ``(start, length, period)`` in words, by start and period: maximal
    stretches with that smallest period, of at least ``min_length`` words and two periods. ``collapsed`` is the
    words that no run holds after its first period, joined by one space. Null, empty and blank texts have no words,
    no runs and an empty collapsed text; rows that share a doc_id or are equal are separate; an empty table gives no
    rows; other columns may have any name. A text is read whole, in memory in proportion to it. No shuffle.
    """
    check_columns(docs, "text")
    names = docs.columns if keep is None else keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", BLOCK_BYTES):
            words, bounds = words_of(*byte_column(batch.column(1)))
            coded = words.dictionary_encode()
            start, length, period = find_runs(coded.indices.to_numpy().astype(np.int64), bounds, min_length)
            left = ~covered(len(words), start + period, start + length)
            upto = np.append(0, np.cumsum(left))[bounds]
            joined = pa.LargeListArray.from_arrays(pa.array(upto), words.filter(pa.array(left)))
            row = np.searchsorted(bounds, start, side="right") - 1
            spans = pa.StructArray.from_arrays([pa.array(x) for x in (start - bounds[row], length, period)], ["start", "length", "period"])
            per_row = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)), spans)
            texts = pa.compute.binary_join(joined, pa.scalar(b" ", pa.large_binary())).cast(pa.large_string()).cast(pa.string())
            yield pa.record_batch([batch.column(0), pa.array(np.diff(bounds)), per_row, texts], ["row", "n_words", "runs", "collapsed"])

    frame = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), "text")
    kind = frame.schema["row"].dataType.simpleString()
    schema = f"row {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    return frame.mapInArrow(run, schema)


def longest(runs: Column) -> Column:
    """The run of greatest length, then smallest start, then period; null if there is none."""
    return F.get(F.array_sort(F.transform(runs, lambda r: F.struct(-r["length"], r["start"], r["period"], r["length"].alias("length")))), 0)


def digest(runs: Column) -> Column:
    line = F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return F.sha2(F.array_join(line, ""), 256)


def with_repeated_tails(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``; where 10 divides h = crc32(doc_id), the words from a = g % n on repeat with period p.

    g = floor(h / 10), p = 1 + floor((n - a) / (3 + g % 8)), n the number of words. A null doc_id changes nothing.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    chosen = docs.select("doc_id", "text", h.alias("h")).withColumn("w", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(1))))
    placed = chosen.withColumn("g", F.floor(F.col("h") / 10)).withColumn("a", F.col("g") % F.greatest(F.size("w"), F.lit(1)))
    period = placed.withColumn("p", 1 + F.floor((F.size("w") - F.col("a")) / (3 + F.col("g") % 8)))
    words = F.transform("w", lambda x, i: F.when(i < F.col("a"), x).otherwise(F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return period.select("doc_id", F.when(F.size("w") > 0, F.array_join(words, " ")).otherwise(F.col("text")).alias("text"))


ORACLE_SQL = r"""
WITH RECURSIVE table_step AS (
  SELECT range AS b, 0 AS step, range AS c FROM range(256)
  UNION ALL
  SELECT b, step + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM table_step WHERE step < 8
), crc_table AS (
  SELECT list(c ORDER BY b) AS crc FROM table_step WHERE step = 8
), doc AS (
  SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    xor(list_reduce(list_prepend(4294967295, [ord(x) FOR x IN string_split(CAST(doc_id AS VARCHAR), '')]),
      lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1])), 4294967295) AS h
  FROM documents, crc_table
), drawn AS (
  SELECT d, doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS changed, h // 10 AS g, (h // 10) % greatest(len(w), 1) AS a FROM doc
), word AS (
  SELECT d, n, i, CASE WHEN changed AND i >= a THEN w[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] ELSE w[i + 1] END AS x
  FROM (SELECT *, unnest(range(n)) AS i FROM drawn)
), diagonal AS (
  SELECT a.d, a.i, b.i - a.i AS q, a.i - row_number() OVER (PARTITION BY a.d, b.i - a.i ORDER BY a.i) AS island
  FROM word a JOIN word b ON a.d = b.d AND a.x = b.x AND b.i > a.i AND 2 * (b.i - a.i) <= a.n
), stretch AS (
  SELECT d, min(i) AS s, q, count(*) + q AS len FROM diagonal GROUP BY d, q, island HAVING count(*) >= q AND count(*) + q >= 12
), run AS (
  SELECT d, s, len, min(q) AS q FROM stretch GROUP BY d, s, len
), dropped AS (
  SELECT DISTINCT d, unnest(range(s + q, s + len)) AS i FROM run
), kept AS (
  SELECT w.d, string_agg(w.x, ' ' ORDER BY w.i) AS t FROM word w ANTI JOIN dropped g ON w.d = g.d AND w.i = g.i GROUP BY w.d
), summary AS (
  SELECT d, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS lines,
    arg_min({'s': s, 'len': len, 'q': q}, {'a': -len, 'b': s, 'c': q}) AS top
  FROM run GROUP BY d
)
SELECT r.doc_id, coalesce(u.n_runs, 0) AS n_runs, u.top.s AS start, CAST(u.top.len AS BIGINT) AS length, u.top.q AS period,
  CAST(1000 * u.top.len // u.top.q AS BIGINT) AS exponent_milli, sha256(coalesce(u.lines, '')) AS runs_sha256, sha256(coalesce(k.t, '')) AS collapsed_sha256
FROM drawn r LEFT JOIN summary u ON r.d = u.d LEFT JOIN kept k ON r.d = k.d
"""
