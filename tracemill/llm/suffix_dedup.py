"""Exact removal of long repeated byte strings with suffix arrays.

A string of ``LENGTH`` bytes is repeated if it also starts at another place of the corpus. Which
strings could be equal is told by their minimiser, the smallest hash among their ``GRAM``-byte strings: equal
strings have equal minimisers. Neighbouring starts with one minimiser form a run, about one per 85 bytes.
Runs whose minimiser occurs once are done with. The bytes of the others (one copy of equal
runs, with their number) go to shards by minimiser; each shard builds a suffix array by
Larsson-Sadakane refinement and finds equal strings from Kasai's common prefixes. A minimiser with more bytes
than one shard holds is dealt over several, whose sorted lists are merged by binary search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracemill.llm.common import Scratch, blocks, byte_column, check_columns, find, ranges

LENGTH = 200
GRAM = 32
SHARD_BYTES = 1 << 19
BLOCK_BYTES = 1 << 20
SAMPLE = 32
_RANDOM = np.random.default_rng(20011)
_BYTE = _RANDOM.integers(0, 1 << 64, 256, np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = [np.uint64(int(x) | 1) for x in _RANDOM.integers(1 << 62, 1 << 63, 8, np.uint64)]
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(29))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def runs(data: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Minimiser, content hash, text, first start, number of starts and places of every run, starts counted in ``data``.

    Places are where the minimiser itself lies in the run, counted up to two. Only with two can strings of one run be equal.
    """
    spare = np.zeros(length, np.uint8)
    h = _BYTE[np.concatenate([data, spare])]
    size, level = 1, 0
    while size < gram:
        step = min(size, gram - size)
        h = h * _STEP[level] + np.append(h[step:], np.zeros(step, np.uint64))
        size, level = size + step, level + 1
    h = _mixed(h)
    plain = h.copy()
    width, size = length - gram + 1, 1
    while size < width:
        step = min(size, width - size)
        h[:-step] = np.minimum(h[:-step], h[step:])
        size += step
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = np.flatnonzero(np.arange(len(data)) + length <= bounds[1:][owner])
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none, none
    key, text = h[at], owner[at]
    head = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (text[1:] != text[:-1])))
    count = np.diff(np.append(head, len(at)))
    first = at[head]
    span = count + width - 1
    places = np.minimum(np.add.reduceat(plain[ranges(first, span)] == np.repeat(key[head], span), np.cumsum(span) - span, dtype=np.int64), 2)
    prefix = np.append(np.uint64(0), np.cumsum(_mixed(_BYTE)[data] * _powers(_BASE, len(data))))
    end = first + count + length - 1
    content = (prefix[end] - prefix[first]) * _powers(_INVERSE, len(data))[first]
    return key[head].view(np.int64), _mixed(content + count.astype(np.uint64)).view(np.int64), text[head], first, count, places


class SuffixArray:
    """Suffixes of several byte strings, each ending in a mark of its own that equals nothing."""

    def __init__(self, parts: list[bytes]):
        sizes = np.array([len(p) for p in parts], np.int64)
        self.data = np.frombuffer(b"".join(parts), np.uint8)
        self.part = np.repeat(np.arange(len(parts)), sizes)
        self.end = np.repeat(np.cumsum(sizes), sizes)
        self.start = np.cumsum(sizes) - sizes
        self.order = self._sorted(len(parts))

    def _sorted(self, parts: int) -> np.ndarray:
        """Larsson-Sadakane: a group of suffixes equal so far keeps its slots, and is split by the ranks of what follows."""
        n = len(self.data)
        place = np.arange(n)
        depth = 7
        padded = np.concatenate([self.data, np.zeros(depth, np.uint8)]).astype(np.int64) + 1
        first = np.zeros(n, np.int64)
        for k in range(depth):
            first = first << 9 | np.where(place + k < self.end, padded[k : k + n], 0)
        order = np.argsort(first, kind="stable")
        value = first[order]
        rank = np.empty(n, np.int64)
        slots, group = np.arange(n), self._groups(value)
        rank[order] = slots[group]
        while True:
            single = np.append(group[1:] != group[:-1], True) & np.append(True, group[1:] != group[:-1])
            slots = slots[~single]
            if not len(slots):
                return order
            suffix = order[slots]
            ahead = suffix + depth
            inside = ahead < self.end[suffix]
            follow = np.where(inside, rank[np.minimum(ahead, n - 1)] + parts, self.part[suffix])
            value = rank[suffix] * (n + parts) + follow
            sort = np.argsort(value, kind="stable")
            suffix, group = suffix[sort], self._groups(value[sort])
            order[slots] = suffix
            rank[suffix] = slots[group]
            depth *= 2

    @staticmethod
    def _groups(value: np.ndarray) -> np.ndarray:
        """For each place of a sorted array the first place of its value."""
        head = np.append(True, value[1:] != value[:-1])
        return np.maximum.accumulate(np.where(head, np.arange(len(value)), 0))

    def common_prefixes(self, cap: int) -> np.ndarray:
        """Kasai: bytes each suffix shares with the one before it in order, up to ``cap``; in text order.

        The next suffix of a text shares at most one byte less. Every ``SAMPLE``-th suffix is compared from its
        first byte, the others from what their sample leaves.
        """
        n = len(self.data)
        before = np.full(n, -1)
        before[self.order[1:]] = self.order[:-1]
        raw = np.append(self.data, np.zeros(8, np.uint8))
        words = np.zeros(n, np.uint64)
        for k in range(8):
            words |= raw[k : k + n].astype(np.uint64) << np.uint64(8 * k)
        out = np.zeros(n, np.int64)
        into = np.arange(n) - self.start[self.part]
        phase = into % SAMPLE
        for chosen in (np.flatnonzero(phase == 0), np.flatnonzero(phase != 0)):
            back = phase[chosen]
            out[chosen] = np.where(back > 0, np.maximum(out[chosen - back] - back, 0), 0)
            self._extend(out, chosen[before[chosen] >= 0], before, words, cap)
        return out

    def _extend(self, out: np.ndarray, at: np.ndarray, before: np.ndarray, words: np.ndarray, cap: int) -> None:
        limit = np.minimum(np.minimum(self.end[at] - at, self.end[before[at]] - before[at]), cap)
        while len(at):
            live = out[at] < limit
            out[at[~live]] = limit[~live]
            at, limit = at[live], limit[live]
            if not len(at):
                return
            differ = words[at + out[at]] ^ words[before[at] + out[at]]
            low = differ & (~differ + np.uint64(1))
            same = np.where(differ == 0, 8, np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)).astype(np.int64) // 8)
            out[at] = np.minimum(out[at] + same, limit)
            at, limit = at[differ == 0], limit[differ == 0]

    def classes(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes of at least ``length`` bytes in order, and a number that equal ``length``-byte beginnings share."""
        shared = self.common_prefixes(length)[self.order]
        number = np.cumsum(shared < length)
        full = self.end[self.order] - self.order >= length
        return self.order[full], number[full]


def _spans(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one past last position of each run of true values."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _prints(array: SuffixArray, at: np.ndarray, length: int) -> np.ndarray:
    """64-bit fingerprints of the strings at some places."""
    prefix = np.append(np.uint64(0), np.cumsum(_mixed(_BYTE)[array.data] * _powers(_BASE, len(array.data))))
    return _mixed((prefix[at + length] - prefix[at]) * _powers(_INVERSE, len(array.data))[at])


_MATCHED = "key bigint, seg bigint, n int, spans array<struct<a:int,b:int>>, slice int, prints binary, places array<int>"


def _match(length: int):
    def solve(rows: list[dict]) -> pa.RecordBatch:
        array = SuffixArray([r["bytes"] for r in rows])
        times = np.array([r["times"] for r in rows], np.int64)
        order, number = array.classes(length)
        number = np.unique(number, return_inverse=True)[1]
        total = np.bincount(number, times[array.part[order]])
        repeated = np.zeros(len(array.data), bool)
        repeated[order] = total[number] > 1
        shards = np.array([r["shards"] for r in rows], np.int64)
        # Of each class one member goes to the merge, as another shard may hold the string too.
        member = np.zeros(len(array.data), bool)
        member[order] = np.append(True, number[1:] != number[:-1])[: len(order)] & (shards[array.part[order]] > 1)
        members = np.flatnonzero(member)
        member_prints = _prints(array, members, length) if len(members) else members
        mine = np.searchsorted(members, np.append(array.start, len(array.data)))
        out = []
        for i, row in enumerate(rows):
            a = int(array.start[i])
            b = a + row["n"]
            begin, end = _spans(repeated[a:b])
            base = {"key": row["key"], "seg": row["seg"], "n": row["n"]}
            if len(begin):
                out.append(base | {"spans": [{"a": x, "b": y} for x, y in zip(begin.tolist(), end.tolist(), strict=True)]})
            if mine[i] < mine[i + 1]:
                at, prints = members[mine[i] : mine[i + 1]] - a, member_prints[mine[i] : mine[i + 1]]
                order_ = np.argsort(prints, kind="stable")
                prints, at = prints[order_], at[order_]
                slices = (prints >> np.uint64(33)).astype(np.int64) % int(shards[i])
                for s in np.unique(slices).tolist():
                    out.append(base | {"slice": s, "prints": prints[slices == s].tobytes(), "places": at[slices == s].tolist()})
        return _batch(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            for row in batch.to_pylist():
                group = (row["key"], row["shard"])
                if size >= SHARD_BYTES and group != last:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size, last = size + len(row["bytes"]), group
        if held:
            yield solve(held)

    return run


_ARROW = pa.schema([
    ("key", pa.int64()), ("seg", pa.int64()), ("n", pa.int32()), ("spans", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))),
    ("slice", pa.int32()), ("prints", pa.binary()), ("places", pa.list_(pa.int32())),
])


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r.get(f.name) for r in rows], f.type) for f in _ARROW], schema=_ARROW)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings of one minimiser that several shards hold, found in their lists of one slice of the hash range."""

    def solve(rows: list[dict]) -> pa.RecordBatch:
        lists = [np.frombuffer(r["prints"], np.uint64) for r in rows]
        merged = np.sort(np.concatenate(lists))
        out = []
        for row, prints in zip(rows, lists, strict=True):
            found = np.searchsorted(merged, prints, "right") - np.searchsorted(merged, prints, "left") > 1
            flags = np.zeros(row["n"], bool)
            flags[np.array(row["places"], np.int64)[found]] = True
            begin, end = _spans(flags)
            if len(begin):
                out.append({"key": row["key"], "seg": row["seg"], "n": row["n"], "spans": [{"a": x, "b": y} for x, y in zip(begin.tolist(), end.tolist(), strict=True)]})
        return _batch(out)

    held, last = [], None
    for batch in batches:
        for row in batch.to_pylist():
            if held and (row["key"], row["slice"]) != last:
                yield solve(held)
                held = []
            held.append(row)
            last = (row["key"], row["slice"])
    if held:
        yield solve(held)


def _version() -> Column:
    return F.xxhash64("text").alias("version")


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``(doc_id, version, spans)``: byte ranges (a, b) covered by repeated strings, possibly overlapping.

    ``version`` is a hash of the text; rows of equal doc_id and text are separate occurrences with equal spans.
    """
    check_columns(docs, "doc_id", "text")
    if not 8 <= gram <= length:
        raise ValueError("gram must lie between 8 and length")
    scratch = Scratch(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.where(F.octet_length("text") >= length).select("doc_id", _version(), "text")

    def find_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", BLOCK_BYTES):
            data, bounds = byte_column(batch.column(2))
            key, seg, text, first, count, places = runs(data, bounds, length, gram)
            rows = pa.array(text)
            start = (first - bounds[text]).astype(np.int32)
            yield pa.record_batch([pa.array(key), pa.array(seg), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(start), pa.array(count.astype(np.int32)), pa.array(places.astype(np.int8))], ["key", "seg", "doc_id", "version", "start", "n", "places"])

    found = scratch.save(texts.mapInArrow(find_runs, f"key bigint, seg bigint, doc_id {kind}, version bigint, start int, n int, places tinyint"))
    twice = found.groupBy("key").agg(F.sum("places").alias("places")).where("places > 1").select("key")
    candidates = scratch.save(found.drop("places").join(twice, "key"))
    scratch.drop(found)
    segments = scratch.save(candidates.groupBy("key", "seg", "n").agg(F.count("*").alias("times"), F.min(F.struct("doc_id", "version", "start")).alias("at")))
    large = segments.groupBy("key").agg(F.sum(F.col("n") + (length - 1)).alias("size")).where(F.col("size") > SHARD_BYTES)
    large = large.select("key", F.ceil(F.col("size") / SHARD_BYTES).cast("int").alias("shards"))
    dealt = segments.join(large, "key", "left").withColumn("shards", F.coalesce("shards", F.lit(1)))
    dealt = dealt.withColumn("shard", F.pmod("seg", "shards").cast("int"))
    cuts = dealt.groupBy("at.doc_id", "at.version").agg(F.collect_list(F.struct("at.start", "n", "key", "seg", "times", "shards", "shard")).alias("cuts"))
    same = F.col("t.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("t.version") == F.col("c.version"))
    # Of equal rows one is cut: the first of a text's copies is any of them.
    once = texts.alias("t").join(cuts.alias("c"), same).select("t.doc_id", "t.version", "text", "cuts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, wanted in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                raw = text.as_py().encode()
                rows += [c | {"bytes": raw[c["start"] : c["start"] + c["n"] + length - 1]} for c in wanted]
            kinds = {"key": pa.int64(), "seg": pa.int64(), "n": pa.int32(), "times": pa.int64(), "shards": pa.int32(), "shard": pa.int32(), "bytes": pa.binary()}
            yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in kinds.items()], list(kinds))

    pieces = once.select("text", "cuts").mapInArrow(cut, "key bigint, seg bigint, n int, times bigint, shards int, shard int, bytes binary")
    matched = scratch.save(pieces.repartition("key", "shard").sortWithinPartitions("key", "shard", "seg", "n").mapInArrow(_match(length), _MATCHED))
    crossing = matched.where("slice is not null").repartition("key", "slice").sortWithinPartitions("key", "slice", "seg", "n").mapInArrow(_merge, _MATCHED)
    spans = matched.where("spans is not null").select("key", "seg", "n", "spans").unionByName(crossing.select("key", "seg", "n", "spans"))
    hits = candidates.join(spans, ["key", "seg", "n"]).select("doc_id", "version", "start", F.explode("spans").alias("s"))
    spans = hits.select("doc_id", "version", F.struct((F.col("start") + F.col("s.a")).alias("a"), (F.col("start") + F.col("s.b") + (length - 1)).alias("b")).alias("span"))
    return spans.groupBy("doc_id", "version").agg(F.collect_set("span").alias("spans"))


def remove(text: bytes, spans: list[dict]) -> tuple[bytes, int, int]:
    """The bytes outside all spans, and the number of bytes and of maximal runs removed."""
    kept, at, removed, count, last = [], 0, 0, 0, -1
    for a, b in sorted((s["a"], s["b"]) for s in spans):
        if a > last:
            count += 1
        if b > at:
            kept.append(text[at : max(a, at)])
            removed += b - max(a, at)
            at = b
        last = max(last, b)
    kept.append(text[at:])
    return b"".join(kept), removed, count


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``row`` (a struct of all columns), ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept`` (binary) for every row.

    Strings are judged on the input: every occurrence goes, the first included. A text is its UTF-8 bytes; null
    and texts shorter than ``length`` lose nothing. Equal rows, also of one doc_id, are each other's copies.
    """
    spans = repeated_spans(docs, length, gram).select(F.struct("doc_id", "version").alias("c"), "spans")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.struct("doc_id", _version()).alias("t"))
    same = F.col("t.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("t.version") == F.col("c.version"))
    joined = rows.join(spans, same, "left").select("row", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "row.text", 8 << 20):
            texts = [(t.as_py() or "").encode() for t in find(batch, "row.text")]
            done = [remove(t, s or []) for t, s in zip(texts, batch.column(1).to_pylist(), strict=True)]
            kept, removed, count = zip(*done, strict=True)
            columns = [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.binary())]
            yield pa.record_batch(columns, ["row", "n_bytes", "n_removed", "n_spans", "kept"])

    schema = StructType(list(joined.select("row").schema.fields))
    for name in ("n_bytes", "n_removed", "n_spans"):
        schema = schema.add(name, "long")
    return joined.mapInArrow(run, schema.add("kept", "binary"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with what is left of the texts (null stays null); bytes of a character cut in two are dropped.

    ``n_chars`` is counted anew if there is such a column.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [raw.as_py().decode("utf-8", "ignore") for raw in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], ["row", "new_text"])

    rows = dedup(docs).select("row", "kept")
    rows = rows.mapInArrow(run, StructType(list(rows.select("row").schema.fields)).add("new_text", "string"))
    text = F.when(F.col("row.text").isNotNull(), F.col("new_text"))
    fresh = {"text": text, "n_chars": F.length(text).cast("bigint")}
    return rows.select(*[fresh.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
