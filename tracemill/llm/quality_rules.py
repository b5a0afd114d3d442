"""Quality rules: counts on words and lines, and a log-likelihood ratio of hashed n-grams.

The ratio compares two multinomials over hashed words and word pairs, one of trusted texts and one
of the whole corpus, per n-gram of a text. Counts cover all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracemill.llm.common import blocks, byte_column, check_columns, find

BUCKET_BITS = 16
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
#: Mean log ratio per n-gram below which a text is turned down. Trusted texts lie around 0.
MIN_RATIO = -0.08
#: Added to either side of a ratio, in n-grams of trusted texts.
SHRINK = 12.0
#: Trusted ids are broadcast up to this number (8 bytes each), and joined by a shuffle beyond it.
BROADCAST_IDS = 1_000_000
BLOCK_BYTES = 2 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SLOTS = 64
_TABLE = np.random.default_rng(715517).integers(0, 1 << 64, _SLOTS * 256, np.uint64)
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


@dataclass
class Words:
    """The words of a block of texts: where they start and end, and whose they are."""

    data: np.ndarray
    bounds: np.ndarray
    start: np.ndarray
    size: np.ndarray
    owner: np.ndarray

    def hashes(self, data: np.ndarray) -> np.ndarray:
        """64-bit tabulation hashes of the words as they are spelt in ``data``."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        inside = ~_SPACE[self.data]
        offset = np.arange(len(data))[inside] - np.repeat(self.start, self.size)
        value = _TABLE[(offset & (_SLOTS - 1)) << 8 | data[inside]]
        if self.size.max() > _SLOTS:
            value = value * (offset // _SLOTS * 2 + 1).astype(np.uint64)
        return _mixed(np.add.reduceat(value, np.cumsum(self.size) - self.size) + self.size.astype(np.uint64))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX[1]
    return h ^ (h >> np.uint64(29))


def words(data: np.ndarray, bounds: np.ndarray) -> Words:
    """Maximal runs of bytes other than ASCII white space, cut at the text bounds."""
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    before = np.append(False, inside)
    after = np.append(inside, False)
    start = np.flatnonzero(after & (~before | edge))
    end = np.flatnonzero(before & (~after | edge))
    return Words(data, bounds, start, end - start, np.searchsorted(bounds, start, "right") - 1)


def ngrams(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Owner and bucket of every word and of every pair of neighbouring words, A-Z lower-cased."""
    h = w.hashes(_LOWER[w.data])
    pair = w.owner[1:] == w.owner[:-1]
    two = _mixed(h[:-1] * _MIX[0] + h[1:] * _MIX[2])[pair]
    bucket = np.concatenate([h, two]) >> np.uint64(64 - BUCKET_BITS)
    return np.concatenate([w.owner, w.owner[1:][pair]]), bucket.astype(np.int64)


def repeated_words(w: Words, texts: int) -> np.ndarray:
    """Per text the words in three-word windows that it holds twice or more."""
    out = np.zeros(texts, np.int64)
    if len(w.start) < 3:
        return out
    h = w.hashes(w.data)
    same = w.owner[2:] == w.owner[:-2]
    window = _mixed(h[:-2] * _MIX[0] + _mixed(h[1:-1] * _MIX[1]) + h[2:] * _MIX[2]) + _mixed(w.owner[:-2].astype(np.uint64) * _MIX[0])
    at = np.flatnonzero(same)
    _, back, times = np.unique(window[at], return_inverse=True, return_counts=True)
    at = at[times[back] > 1]
    covered = np.zeros(len(h), bool)
    for k in range(3):
        covered[at + k] = True
    return np.bincount(w.owner[covered], minlength=texts)


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def base_counts(w: Words, raw: bytes) -> dict[str, np.ndarray]:
    texts = len(w.bounds) - 1
    n_words = np.bincount(w.owner, minlength=texts)
    owner = np.repeat(np.arange(texts), np.diff(w.bounds))
    chars = ((w.data & 0xC0) != 0x80) & ~_SPACE[w.data]
    return {
        "n_words": n_words,
        "word_chars": np.bincount(owner[chars], minlength=texts),
        "n_symbols": np.bincount(owner[_SYMBOL[w.data]], minlength=texts),
        "n_dup_lines": np.array([duplicate_lines(raw[a:b]) for a, b in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True)], np.int64),
        "n_repeat_words": repeated_words(w, texts),
    }


def fit(docs: DataFrame, trusted: DataFrame) -> np.ndarray:
    """The log ratio of each bucket, from every row of ``docs`` and those whose doc_id is in ``trusted``.

    Each task adds up its rows and hands out one count per bucket; these are summed by bucket, and
    the 65,536 sums come to the driver. A bucket's ratio is that of its trusted count to the count its share of the
    corpus leads to expect, both raised by ``SHRINK``, so buckets seen a few times say little. Without trusted texts all ratios are 0.
    """
    check_columns(docs, "doc_id", "text")
    check_columns(trusted, "doc_id")
    ids = trusted.select(F.col("doc_id").alias("trusted_id")).where("trusted_id is not null").distinct()
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    rows = docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids, F.col("doc_id") == F.col("trusted_id"), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << BUCKET_BITS), np.int64)
        for batch in blocks(batches, "text", BLOCK_BYTES):
            owner, bucket = ngrams(words(*byte_column(batch.column(0))))
            total[0] += np.bincount(bucket, minlength=1 << BUCKET_BITS)
            good = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), bool)
            total[1] += np.bincount(bucket[good[owner]], minlength=1 << BUCKET_BITS)
        at = np.flatnonzero(total[0])
        yield pa.record_batch([pa.array(x) for x in (at, total[0][at], total[1][at])], ["bucket", "n", "m"])

    found = rows.select("text", F.col("trusted_id").isNotNull().alias("good")).mapInArrow(run, "bucket bigint, n bigint, m bigint")
    sums = found.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).toArrow()
    total = np.zeros((2, 1 << BUCKET_BITS))
    for k, name in enumerate(("n", "m")):
        total[k][sums["bucket"].to_numpy()] = sums[name].to_numpy()
    if not total[1].any():
        return np.zeros(1 << BUCKET_BITS)
    expected = total[0] * (total[1].sum() / total[0].sum())
    return np.log((total[1] + SHRINK) / (expected + SHRINK))


def assess(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """``row`` (a struct of all columns), the counts, ``ratio``, ``base_failed`` and ``kept`` for every row.

    Null and empty texts have no words, ratio 0 and fail. Rows are judged one by one, so repeated
    rows agree and any column names will do.
    """
    check_columns(docs, "doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "row.text", BLOCK_BYTES):
            w = words(*byte_column(find(batch, "row.text")))
            counts = base_counts(w, w.data.tobytes())
            owner, bucket = ngrams(w)
            grams = np.bincount(owner, minlength=batch.num_rows)
            ratio = np.bincount(owner, shared.value[bucket], batch.num_rows) / np.maximum(grams, 1)
            failed = (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEATED_PERCENT * counts["n_words"])
            columns = [batch.column(0), *map(pa.array, counts.values()), pa.array(ratio), pa.array(failed), pa.array(~failed & (ratio >= MIN_RATIO))]
            yield pa.record_batch(columns, ["row", *counts, "ratio", "base_failed", "kept"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    schema = StructType(list(rows.schema.fields))
    for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"):
        schema = schema.add(name, "long")
    return rows.mapInArrow(run, schema.add("ratio", "double").add("base_failed", "boolean").add("kept", "boolean"))
