"""Packing documents into training sequences: concatenate and cut.

All documents, each followed by an end id, form one stream that is cut into windows of equal
length. Pass one encodes and notes each document's place within its partition; the totals of the
partitions, one number a task, give every partition's place in the stream. Pass two cuts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm import bpe
from tracemill.llm.common import Scratch, blocks, byte_column, check_columns

WINDOW = 1024
END_ID = 0
_BATCH = 1 << 20


def tokens(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """``(doc_id, part, local, n, ids)``: ids with the end id, and their place within the partition."""
    check_columns(docs, "doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(bpe.load(path))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe._encoder(shared)
        part, before = TaskContext.get().partitionId(), 0
        for batch in blocks(batches, "text", bpe.BLOCK_BYTES):
            ids, bounds = encoder.encode(*byte_column(batch.column(1)))
            raw, count = ids.astype("<u4").tobytes(), np.diff(bounds) + 1
            values = [raw[4 * a : 4 * b] + end for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            local = before + np.cumsum(count) - count
            before += int(count.sum())
            columns = [batch.column(0), pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(local), pa.array(count), pa.array(values, pa.binary())]
            yield pa.record_batch(columns, ["doc_id", "part", "local", "n", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, part int, local bigint, n bigint, ids binary")


def _bases(stored: DataFrame) -> Broadcast:
    """Where each partition starts in the stream. One number per task of pass one comes to the driver."""
    totals = {r["part"]: r["total"] for r in stored.groupBy("part").agg(F.sum("n").alias("total")).collect()}
    base = np.zeros(max(totals, default=-1) + 2, np.int64)
    for part, total in totals.items():
        base[part + 1] = total
    return stored.sparkSession.sparkContext.broadcast(np.cumsum(base))


def pack(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids])``.

    A document of n ids with its end id lies in one piece per window it touches; each id in exactly one.
    Only the last sequence is short. Null and empty texts are one end id; rows of equal or null
    doc_id are separate documents; an empty table gives no rows; other columns are ignored.
    """
    stored = Scratch(docs.sparkSession).save(tokens(docs, path, end_id))
    bases = _bases(stored)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = bases.value
        for batch in blocks(batches, "ids", _BATCH):
            part, local, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
            row, start, length, where = _pieces(base[part] + local, n, window)
            raw, at = byte_column(batch.column(4))
            view, begin = memoryview(raw), at[row] + 4 * start
            spans = list(zip(begin.tolist(), (begin + 4 * length).tolist(), strict=True))
            crc = np.fromiter((zlib.crc32(view[a:b]) for a, b in spans), np.int64, len(spans))
            columns = [batch.column(0).take(pa.array(row)), *map(pa.array, (start, length, crc, n[row], where // window, where % window))]
            if with_ids:
                columns.append(pa.array([bytes(view[a:b]) for a, b in spans], pa.binary()))
            yield pa.record_batch(columns, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]
    schema = f"doc_id {kind}, " + ", ".join(f"{n} {'binary' if n == 'ids' else 'bigint'}" for n in names[1:])
    return stored.mapInArrow(run, schema)


def _pieces(place: np.ndarray, n: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, start in the document, length and place in the stream of every piece."""
    count = (place + n - 1) // window - place // window + 1
    row = np.repeat(np.arange(len(n)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    where = np.where(nth == 0, place[row], (place[row] // window + nth) * window)
    until = np.minimum((where // window + 1) * window, place[row] + n[row])
    return row, where - place[row], until - where, where


def sequences(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """``(sequence_id, ids)``: the windows themselves, unpadded (only the last can be short).

    A window whose ids all pass through one task is written there. The others leave a boundary
    record per task; those alone are shuffled, and joined by window (at most ``window`` records each).
    """
    stored = Scratch(docs.sparkSession).save(tokens(docs, path, end_id))
    bases = _bases(stored)
    end = int(bases.value[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, buffer, first = bases.value, b"", 0
        for batch in blocks(batches, "ids", _BATCH):
            rows = []
            part, local = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            for place, ids in zip((base[part] + local).tolist(), batch.column(4).to_pylist(), strict=True):
                if place != first + len(buffer) // 4:
                    rows += _cut(first, buffer, window, end)
                    buffer, first = b"", place
                buffer += ids
                whole = (first + len(buffer) // 4) // window * window - first
                if whole > 0:
                    rows += _cut(first, buffer[: 4 * whole], window, end)
                    buffer, first = buffer[4 * whole :], first + whole
            yield _records(rows)
        yield _records(_cut(first, buffer, window, end))

    rows = Scratch(docs.sparkSession).save(stored.mapInArrow(run, "sequence_id bigint, offset bigint, complete boolean, ids binary"))
    joined = rows.where("!complete").groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    whole = F.aggregate("p", F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["ids"]))
    return rows.where("complete").select("sequence_id", "ids").unionByName(joined.select("sequence_id", whole.alias("ids")))


def _cut(first: int, buffer: bytes, window: int, end: int) -> list[tuple[int, int, bool, bytes]]:
    out, at, n = [], 0, len(buffer) // 4
    while at < n:
        place = first + at
        size = min(window - place % window, n - at)
        complete = place % window == 0 and (size == window or place + size == end)
        out.append((place // window, place % window, complete, buffer[4 * at : 4 * (at + size)]))
        at += size
    return out


def _records(rows: list[tuple[int, int, bool, bytes]]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ([], [], [], [])
    return pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.bool_(), pa.binary()), strict=True)], ["sequence_id", "offset", "complete", "ids"])
