"""Benchmark passages in documents, by Wu-Manber search for many strings at once.

A window is ten consecutive words of an item. Windows of one word count form a search table: a shift for every
hashed block of bytes within the windows' common length, and buckets of windows by the hash of the last block.
Texts, as words each followed by one space, are scanned in many lanes side by side: a lane reads the block
at its place and skips by its shift; where the shift is zero, the bucket's windows are compared byte by byte.

The windows may outgrow a task's memory, so items are dealt into blocks of bounded size. Every text
is searched for every block's windows, one block after the other.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import Scratch, blocks, byte_column, check_columns, ranges

WORDS = 10
#: Item text of one search block; a worker's tables take some eight times that.
ITEM_BYTES = 16 << 20
TEXT_BYTES = 1 << 20
WORD = r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"
_SLICE = 4096  # windows of one row of the item table
_LANE = 512
_SPACE = 0x20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of words, in lower case; all others become a space.
_FOLD = np.full(256, _SPACE, np.uint8)
_FOLD[0x30:0x3A] = np.arange(0x30, 0x3A)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Text:
    """Words of some texts: ``data`` holds each followed by one space, ``start`` and ``end`` their places there."""

    def __init__(self, raw: np.ndarray, bounds: np.ndarray):
        folded = np.insert(_FOLD[raw], bounds[1:], _SPACE)
        inside = folded != _SPACE
        after = np.zeros(len(folded), bool)
        after[1:] = inside[:-1]
        first = np.flatnonzero(inside & ~after)
        self.data = folded[inside | after]
        self.end = np.flatnonzero(self.data == _SPACE)
        self.start = np.append(0, self.end + 1)[: len(self.end)]
        #: n+1 bounds of each text's words; where each word lies in ``raw``
        self.words = np.searchsorted(first, bounds + np.arange(len(bounds)))
        self.last = np.repeat(self.words[1:], np.diff(self.words))

    def windows(self, first: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
        """Start and length, with the space behind, of the windows of ``count`` words from ``first``."""
        return self.start[first], self.end[first + count - 1] + 1 - self.start[first]


def _chunks(lengths: np.ndarray, limit: int = 1 << 22) -> Iterator[slice]:
    """Slices whose lengths add up to about ``limit``."""
    cuts = np.flatnonzero(np.diff(np.cumsum(lengths) // limit)) + 1
    edges = [0, *cuts.tolist(), len(lengths)]
    return (slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a)


def _hashes(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    out = np.zeros(len(start), np.uint64)
    powers = np.cumprod(np.full(int(length.max(initial=0)), 0x100000001B3, np.uint64))
    for part in _chunks(length):
        n = length[part]
        values = (data[ranges(start[part], n)].astype(np.uint64) + np.uint64(1)) * powers[ranges(np.zeros(len(n), np.int64), n)]
        out[part] = np.add.reduceat(values, np.cumsum(n) - n)
    out ^= out >> np.uint64(31)
    return out * _MIX


def _same(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the strings at ``at`` in a and ``bt`` in b, of equal length, agree byte by byte."""
    out = np.zeros(len(at), bool)
    for part in _chunks(length):
        n = length[part]
        equal = a[ranges(at[part], n)] == b[ranges(bt[part], n)]
        out[part] = np.logical_and.reduceat(equal, np.cumsum(n) - n)
    return out


class Table:
    """Wu-Manber tables of the windows of ``count`` words that begin at the words ``first`` of ``text``."""

    def __init__(self, text: Text, first: np.ndarray, item: np.ndarray, count: int):
        self.count, self.source = count, text.data
        start, length = text.windows(first, count)
        self.least = int(min(length.min(), 128))
        self.block = max(2, min(8, self.least // 2))
        self.mask = np.uint64((1 << 8 * self.block) - 1)
        most = self.least - self.block + 1
        bits = int(np.clip(np.ceil(np.log2(4 * len(start) * most + 1)), 12, 24))
        self.down = np.uint64(64 - bits)
        self.shift = np.full(1 << bits, most, np.uint8)
        for at in range(most):
            self.shift[self.slot(text.data, start + at)] = most - 1 - at
        # equal windows become one, known by bucket and hash; those that differ under one key stay apart
        key = self.key(text.data, start, _hashes(text.data, start, length))
        order = np.lexsort((item, key))
        key, start, length, item = key[order], start[order], length[order], item[order]
        of = np.full(len(key), -1)
        while (of < 0).any():
            left = np.flatnonzero(of < 0)
            head = left[np.append(0, np.flatnonzero(key[left][1:] != key[left][:-1]) + 1)]
            mine = head[np.searchsorted(head, left, side="right") - 1]
            same = length[left] == length[mine]
            same[same] = _same(text.data, start[left[same]], text.data, start[mine[same]], length[left[same]])
            of[left[same]] = mine[same]
        kept = np.flatnonzero(of == np.arange(len(of)))
        self.key_of, self.start, self.length = key[kept], start[kept], length[kept]
        owner = np.searchsorted(kept, of)
        by = np.lexsort((item, owner))
        owner, item = owner[by], item[by]
        new = np.append(True, (owner[1:] != owner[:-1]) | (item[1:] != item[:-1]))
        self.items, self.bounds = item[new], np.searchsorted(owner[new], np.arange(len(kept) + 1))

    def slot(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        value = np.zeros(len(at), np.uint64)
        for i in range(self.block):
            value |= data[at + i].astype(np.uint64) << np.uint64(8 * i)
        return ((value * _MIX) >> self.down).astype(np.int64)

    def key(self, data: np.ndarray, start: np.ndarray, hashed: np.ndarray) -> np.ndarray:
        """The bucket in the upper bits, the window's hash below."""
        bucket = self.slot(data, start + self.least - self.block).astype(np.uint64)
        return (bucket << self.down) | (hashed >> (np.uint64(64) - self.down))

    def places(self, data: np.ndarray) -> np.ndarray:
        """Where the blocks in ``data`` allow a window to begin."""
        total = len(data) - self.least + 1
        if total <= 0:
            return np.zeros(0, np.int64)
        wide = np.lib.stride_tricks.as_strided(np.append(data, np.zeros(8, np.uint8)), (len(data) + 1, 8), (1, 1)).view("<u8")[:, 0]
        place, found = np.arange(0, total, _LANE), []
        until = np.minimum(place + _LANE, total)
        ahead = self.least - self.block
        while len(place):
            shift = self.shift[(((wide[place + ahead] & self.mask) * _MIX) >> self.down).astype(np.int64)]
            found.append(place[shift == 0])
            place = place + np.maximum(shift, 1)
            on = place < until
            place, until = place[on], until[on]
        return np.concatenate(found)

    def search(self, text: Text) -> tuple[np.ndarray, np.ndarray]:
        """Word at which a window begins, and the window, for all occurrences."""
        place = self.places(text.data)
        word = np.searchsorted(text.start, place)
        word = np.minimum(word, max(len(text.start) - 1, 0))
        word = word[text.start[word] == place] if len(text.start) else word[:0]
        word = word[word + self.count <= text.last[word]]
        start, length = text.windows(word, self.count)
        enough = length >= self.least
        word, start, length = word[enough], start[enough], length[enough]
        key = self.key(text.data, start, _hashes(text.data, start, length))
        lo, hi = np.searchsorted(self.key_of, key), np.searchsorted(self.key_of, key, side="right")
        mine = np.repeat(np.arange(len(word)), hi - lo)
        window = ranges(lo, hi - lo)
        fits = self.length[window] == length[mine]
        mine, window = mine[fits], window[fits]
        equal = _same(text.data, start[mine], self.source, self.start[window], length[mine])
        return word[mine[equal]], window[equal]


class Index:
    """The tables of one block of items, one for each number of words."""

    def __init__(self, raw: bytes, bounds: np.ndarray, item: np.ndarray, names: list[str]):
        text = Text(np.frombuffer(raw, np.uint8), bounds)
        n = np.diff(text.words)
        self.names, self.tables = names, []
        for count in range(1, WORDS + 1):
            rows = np.flatnonzero(n == count if count < WORDS else n >= WORDS)
            if len(rows):
                many = n[rows] - count + 1
                self.tables.append(Table(text, ranges(text.words[rows], many), np.repeat(item[rows], many), count))

    def hits(self, text: Text) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Starts and ends of hit words; for every table the words and windows of its occurrences."""
        found = [t.search(text) for t in self.tables]
        starts = np.concatenate([np.zeros(0, np.int64), *[w for w, _ in found]])
        ends = np.concatenate([np.zeros(0, np.int64), *[w + t.count for t, (w, _) in zip(self.tables, found, strict=True)]])
        return starts, ends, found

    def items_of(self, found: list[tuple[np.ndarray, np.ndarray]], first: int, until: int) -> np.ndarray:
        """Items with occurrences that begin at a word from ``first`` to ``until``; ``found`` ascends by word."""
        parts = [np.zeros(0, np.int64)]
        for table, (word, window) in zip(self.tables, found, strict=True):
            a, b = np.searchsorted(word, [first, until])
            ids = np.unique(window[a:b])
            parts.append(table.items[ranges(table.bounds[ids], table.bounds[ids + 1] - table.bounds[ids])])
        return np.unique(np.concatenate(parts))


def _sorted(found: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    orders = [np.argsort(word, kind="stable") for word, _ in found]
    return [(word[o], window[o]) for (word, window), o in zip(found, orders, strict=True)]


def _pieces(raw: np.ndarray, limit: int) -> Iterator[tuple[Text, int]]:
    """A long text in pieces that share nine words, each with the number of its first word."""
    begin = number = 0
    while True:
        until = min(begin + limit, len(raw))
        while until < len(raw) and _FOLD[raw[until]] != _SPACE:
            until += 1
        piece = Text(raw[begin:until], np.array([0, until - begin]))
        yield piece, number
        if until == len(raw):
            return
        back = min(WORDS - 1, len(piece.start))
        number += len(piece.start) - back
        inside = _FOLD[raw[begin:until]] != _SPACE
        firsts = np.flatnonzero(inside & ~np.append(False, inside[:-1]))
        begin = begin + int(firsts[-back]) if back else until
        limit = max(limit, 2 * (until - begin))


_INDEX: dict[str, Index] = {}


def _index(name: str, shared: Broadcast) -> Index:
    """A worker keeps the tables of the block that it searches."""
    if name not in _INDEX:
        _INDEX.clear()
        _INDEX[name] = Index(*shared.value)
    return _INDEX[name]


def item_windows(benchmark: DataFrame) -> DataFrame:
    """``(item, text)``: each item's words in lower case; long items in slices that share nine words."""
    words = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
        F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(WORD), F.lit(1)).alias("w"),
    ).where(F.size("w") > 0)
    firsts = F.sequence(F.lit(0), F.greatest(F.size("w") - WORDS, F.lit(0)), F.lit(_SLICE))
    sliced = words.select("item", F.explode(F.transform(firsts, lambda i: F.array_join(F.slice("w", i + 1, F.lit(_SLICE + WORDS - 1)), " "))).alias("text"))
    return sliced.distinct()


def search(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] | None = None) -> DataFrame:
    """``row`` (a struct of the columns ``keep``, all by default), ``n_words``, ``spans``, ``items``.

    ``spans`` are the maximal ``(start, end)`` ranges of hit words, ``items`` the distinct ids, as strings, of items with
    occurring windows. An item of fewer than ten words is one window; one without words (null, empty) has none. Rows of equal
    item_id are one item; a null id is the empty string. Null and empty texts have no words and no hits. Rows of ``docs``
    that share a doc_id or are equal are separate; an empty ``docs`` gives no rows, an empty benchmark no hits; other columns may have
    any name. Long texts are searched in pieces. Of the benchmark one block at a time, bounded by ``ITEM_BYTES``,
    is broadcast; with one block nothing is shuffled, with more only the hits of the others are.
    """
    check_columns(docs, "text")
    check_columns(benchmark, "item_id", "text")
    scratch = Scratch(docs.sparkSession)
    windows = scratch.save(item_windows(benchmark))
    total = windows.agg(F.sum(F.octet_length("text") + F.octet_length("item") + 16)).first()[0] or 0
    n_blocks = max(1, -(-total // ITEM_BYTES))
    columns = docs.columns if keep is None else keep
    row = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")
    if n_blocks == 1:
        return _scan(docs.select(row, "text"), _broadcast(windows))
    block = F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks))
    numbered = scratch.save(docs.select(F.struct(row, F.monotonically_increasing_id().alias("place")).alias("row"), "text"))
    found = []
    for i in range(n_blocks):
        shared = _broadcast(windows.where(block == i))
        hits = _scan(numbered, shared)
        found.append(scratch.save(hits if i == 0 else hits.where(F.size("spans") > 0).select(F.col("row.place").alias("at"), "spans", "items")))
        shared.destroy()
    base, every = found[0], found[1]
    for part in found[2:]:
        every = every.unionByName(part)
    extra = every.groupBy("at").agg(F.flatten(F.collect_list("spans")).alias("spans2"), F.flatten(F.collect_list("items")).alias("items2"))
    none = lambda name: F.coalesce(F.col(name + "2"), F.slice(name, 1, 0))
    joined = base.join(extra, F.col("row.place") == F.col("at"), "left")
    return joined.select("row.row", "n_words", _merged(F.concat("spans", none("spans"))).alias("spans"), F.array_distinct(F.concat("items", none("items"))).alias("items"))


def _merged(spans: Column) -> Column:
    """Overlapping and touching spans made one."""

    def add(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when((F.size(done) > 0) & (F.get(done, F.size(done) - 1)["end"] >= s["start"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(
            F.concat(done, F.array(s))
        )

    return F.aggregate(F.array_sort(spans), F.slice(spans, 1, 0), add)


def n_words_in(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])


def _broadcast(windows: DataFrame) -> Broadcast:
    """One block of item texts, at most about ``ITEM_BYTES``; workers build the tables."""
    rows = windows.select("item", "text").toArrow()
    texts, bounds = byte_column(rows.column(1))
    coded = rows.column(0).combine_chunks().dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    value = (texts.tobytes(), bounds.copy(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist())
    return windows.sparkSession.sparkContext.broadcast(value)


def _scan(rows: DataFrame, shared: Broadcast) -> DataFrame:
    """``rows (row, text)`` searched for the windows of one block."""
    name = uuid.uuid4().hex

    def one(batch: pa.RecordBatch, index: Index) -> Iterator[pa.RecordBatch]:
        raw, bounds = byte_column(batch.column(1))
        if batch.num_rows == 1 and len(raw) > 4 * TEXT_BYTES:
            n, starts, ends, items = 0, [], [], []
            for text, number in _pieces(raw, TEXT_BYTES):
                a, b, found = index.hits(text)
                starts.append(a + number)
                ends.append(b + number)
                items.append(index.items_of(_sorted(found), 0, len(text.start)))
                n = number + len(text.start)
            words, per_row = np.array([0, n]), [np.unique(np.concatenate(items))]
            a, b = np.concatenate(starts), np.concatenate(ends)
        else:
            text = Text(raw, bounds)
            words = text.words
            a, b, found = index.hits(text)
            found = _sorted(found)
            hit = set(np.unique(np.searchsorted(words, a, side="right") - 1).tolist())
            none = np.zeros(0, np.int64)
            per_row = [index.items_of(found, words[i], words[i + 1]) if i in hit else none for i in range(batch.num_rows)]
        yield from _output(batch, words, a, b, per_row, index.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(name, shared)
        for batch in blocks(batches, "text", TEXT_BYTES):
            yield from one(batch, index)

    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(run, f"row {kind}, n_words bigint, spans array<struct<start:bigint,end:bigint>>, items array<string>")


def _output(batch: pa.RecordBatch, words: np.ndarray, starts: np.ndarray, ends: np.ndarray, items: list[np.ndarray], names: list[str]) -> Iterator[pa.RecordBatch]:
    """One row per text, in batches of bounded numbers of items."""
    change = np.bincount(starts, minlength=words[-1] + 1) - np.bincount(ends, minlength=words[-1] + 1)
    inside = np.cumsum(change) > 0
    edge = np.ones(words[-1] + 1, bool)
    edge[1:] = inside[1:] != inside[:-1]
    edge[words[:-1]] = True
    edges = np.flatnonzero(edge)
    first = edges[inside[edges]]
    last = np.append(edges, words[-1])[np.searchsorted(edges, first, side="right")]
    row = np.searchsorted(words, first, side="right") - 1
    spans = pa.StructArray.from_arrays([pa.array(first - words[row]), pa.array(last - words[row])], ["start", "end"])
    upto = np.searchsorted(row, np.arange(batch.num_rows + 1))
    sizes = np.array([len(x) for x in items], np.int64)
    known = pa.array(names, pa.string())
    for part in _chunks(sizes + 1, 1 << 18):
        ids = np.concatenate(items[part])
        bounds = np.append(0, np.cumsum(sizes[part])).astype(np.int32)
        own = upto[part.start : part.stop + 1]
        yield pa.record_batch(
            [
                batch.column(0).slice(part.start, part.stop - part.start),
                pa.array(np.diff(words)[part]),
                pa.ListArray.from_arrays(pa.array((own - own[0]).astype(np.int32)), spans.slice(own[0], own[-1] - own[0])),
                pa.ListArray.from_arrays(pa.array(bounds), known.take(pa.array(ids))),
            ],
            ["row", "n_words", "spans", "items"],
        )


ORACLE_SQL = r"""
WITH word AS (
  SELECT row_number() OVER () AS d, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), item AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), win AS (
  SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS x
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM item WHERE len(w) > 0)
), place AS (
  SELECT d, k, i, array_to_string(w[i : i + k - 1], ' ') AS x
  FROM (SELECT d, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM word, (SELECT DISTINCT k FROM win))
), occurrence AS (
  SELECT p.d, p.i, p.k, v.item FROM place p JOIN win v ON p.k = v.k AND p.x = v.x
), hit AS (
  SELECT d, count(DISTINCT pos) AS n_hit FROM (SELECT DISTINCT d, unnest(range(i, i + k)) AS pos FROM occurrence) GROUP BY d
), named AS (
  SELECT d, count(*) AS n_items, string_agg(item, ',' ORDER BY encode(item)) AS items FROM (SELECT DISTINCT d, item FROM occurrence) GROUP BY d
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM word LEFT JOIN hit USING (d) LEFT JOIN named USING (d)
"""
