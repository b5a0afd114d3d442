"""Byte-level BPE, encoding and decoding, by speculation and verification.

A word's tokens are first proposed by greedy longest match, for all new words of a block at once.
A sequence is what the merges produce exactly if each token encodes itself and each adjacent pair
keeps its border: no merge across the border comes before the merges on either side consume it.
Those pair checks are vectorised; only words with a failing pair are merged exactly.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracemill.llm.common import blocks, byte_column, check_columns, ranges

OTHER, LETTER, NUMBER, SPACE = range(4)
BLOCK_BYTES = 1 << 20
CACHE_WORDS = 200_000
LONG_WORD = 512
_NEVER = np.iinfo(np.int64).max


class Lookup:
    """An immutable map from non-negative int64 keys to int64 values, probed for whole arrays; -1 if absent."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        keys, first = np.unique(np.asarray(keys, np.int64), return_index=True)
        values = np.asarray(values, np.int64)[first]
        bits = max(4, int(np.ceil(np.log2(4 * len(keys) + 1))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int64)
        slot = self._slot(keys)
        while len(keys):
            _, one = np.unique(slot, return_index=True)
            one = one[self.keys[slot[one]] == -1]
            self.keys[slot[one]], self.values[slot[one]] = keys[one], values[one]
            left = np.ones(len(keys), bool)
            left[one] = False
            keys, values, slot = keys[left], values[left], (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], -1)
        at = np.flatnonzero((found != keys) & (found != -1))
        slot = slot[at]
        while len(at):
            slot = (slot + 1) & self.mask
            found = self.keys[slot]
            hit = found == keys[at]
            out[at[hit]] = self.values[slot[hit]]
            go = ~hit & (found != -1)
            at, slot = at[go], slot[go]
        return out


@dataclass
class Model:
    """Tables of one vocabulary. ``rank`` is the merge that makes a token, -1 for single bytes."""

    token_bytes: list[bytes]
    byte_ids: np.ndarray
    left: np.ndarray
    right: np.ndarray
    rank: np.ndarray
    made: np.ndarray
    pairs: Lookup
    trie: Lookup
    ends: np.ndarray
    classes: np.ndarray
    special: dict[bytes, int]


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 stands for itself, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def character_classes(tokenizer: Tokenizer) -> np.ndarray:
    """Letter, number, space or other for each code point, as the tokenizer's own splitting sees it.

    Unicode versions of the libraries differ; the tokenizer itself is asked about code points that
    this Python does not know but a newer table calls letters or numbers.
    """
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    codes = np.arange(0x110000, dtype="<u4")
    known = codes[(codes < 0xD800) | (codes >= 0xE000)].tobytes().decode("utf-32-le")
    for c in regex.findall(r"\s", known):
        out[ord(c)] = SPACE
    for c in regex.findall(r"[\p{L}\p{N}]", known):
        if unicodedata.category(c) == "Cn":
            joins = [len(tokenizer.pre_tokenizer.pre_tokenize_str(x + c)) == 1 for x in "a1"]
            out[ord(c)] = LETTER if joins[0] else NUMBER if joins[1] else OTHER
    return out


@lru_cache(2)
def load(path: str) -> Model:
    """A model from a ``tokenizers`` JSON file with byte-level BPE, no normalizer and the usual word pattern."""
    with open(path, encoding="utf-8") as file:
        text = file.read()
    spec = json.loads(text)
    kind = spec["pre_tokenizer"]
    if spec["model"]["type"] != "BPE" or spec["normalizer"] or kind["type"] != "ByteLevel" or kind["add_prefix_space"] or not kind["use_regex"]:
        raise ValueError(f"{path}: not a plain byte-level BPE vocabulary")
    letters, vocab = _byte_letters(), spec["model"]["vocab"]
    special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
    size = max([*vocab.values(), *special.values()]) + 1
    token_bytes = [b""] * size
    for word, i in vocab.items():
        token_bytes[i] = bytes(letters[c] for c in word)
    for word, i in special.items():
        token_bytes[i] = word
    left, right, rank = np.full(size, -1), np.full(size, -1), np.full(size, -1)
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    first, second = (np.array([vocab[m[k]] for m in merges], np.int64) for k in (0, 1))
    made = np.array([vocab[a + b] for a, b in merges], np.int64)
    for r in range(len(merges) - 1, -1, -1):
        left[made[r]], right[made[r]], rank[made[r]] = first[r], second[r], r
    byte_ids = np.array([vocab[c] for c in sorted(letters, key=letters.get)], np.int64)
    model = Model(token_bytes, byte_ids, left, right, rank, made, Lookup(first << 32 | second, np.arange(len(made))), None, None, character_classes(Tokenizer.from_str(text)), special)
    model.trie, model.ends = _trie(model, _own(model))
    return model


def keeps_border(model: Model, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """Whether tokens a, b stay apart when their bytes are encoded together, by merges ranked below ``before``.

    Goes back in time: the later made of the two tokens at the border is undone, until both are
    bytes. A merge across the border happens if it ranks below the merge that consumes the left
    token, and not above the one that consumes the right token; of equal merges the left one is first.
    """
    good = np.ones(len(a), bool)
    limit = np.full(len(a), _NEVER) if before is None else before
    x, y, until_x, until_y, at = a.copy(), b.copy(), limit.copy(), limit.copy(), np.arange(len(a))
    while len(at):
        r = model.pairs(x << 32 | y)
        bad = (r >= 0) & (r < until_x) & (r <= until_y)
        good[at[bad]] = False
        rx, ry = model.rank[x], model.rank[y]
        go = ~bad & (np.maximum(rx, ry) >= 0)
        x, y, until_x, until_y, at, rx, ry = (v[go] for v in (x, y, until_x, until_y, at, rx, ry))
        back = rx > ry
        until_x, until_y = np.where(back, rx, until_x), np.where(back, until_y, ry)
        x, y = np.where(back, model.right[x], x), np.where(back, y, model.left[y])
    return good


def _own(model: Model) -> np.ndarray:
    """Tokens that encode to themselves; no other token is ever produced."""
    good = model.rank < 0
    good[list(model.special.values())] = False
    merged = np.flatnonzero(model.rank >= 0)
    fits = np.zeros(len(good), bool)
    fits[merged] = keeps_border(model, model.left[merged], model.right[merged], model.rank[merged])
    for t in model.made.tolist():
        good[t] = fits[t] and good[model.left[t]] and good[model.right[t]]
    return np.flatnonzero(good)


def _trie(model: Model, tokens: np.ndarray) -> tuple[Lookup, np.ndarray]:
    nodes, ends = {}, [-1]
    for t in tokens.tolist():
        node = 0
        for byte in model.token_bytes[t]:
            node = nodes.setdefault(node << 8 | byte, len(nodes) + 1)
            if node == len(ends):
                ends.append(-1)
        if node:
            ends[node] = t
    return Lookup(np.array(list(nodes)), np.array(list(nodes.values()))), np.array(ends, np.int64)


def word_starts(text: str, codes: np.ndarray, segment: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where words start, among code points; ``segment`` marks the first of each text.

    Words are runs of letters, of numbers or of other marks, each with one space before it; the
    English contractions after an apostrophe; and white space, of which the last before a word stands apart.
    """
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes[codes]
    space = kind == SPACE
    start = segment.copy()
    start[1:] |= (kind[1:] != kind[:-1]) & ~((codes[:-1] == 32) & ~space[1:])
    start[1:-1] |= space[1:-1] & space[:-2] & ~space[2:] & ~segment[2:]
    at = np.flatnonzero(codes == 39)
    if len(at):
        before = np.where(at > 0, at - 1, 0)
        free = segment[at] | (kind[before] == LETTER) | (kind[before] == NUMBER) | (space[before] & (codes[before] != 32))
        for i in at[free].tolist():
            pair, one = text[i + 1 : i + 3], text[i + 1 : i + 2]
            size = 1 if one and one in "stmd" else 2 if pair in ("re", "ve", "ll") else 0
            if size and not segment[i + 1 : i + 1 + size].any():
                start[i + 1] = False
                if i + 1 + size < n:
                    start[i + 1 + size] = True
    return np.flatnonzero(start)


_SLOTS = 64
_TABLE = np.random.default_rng(20240229).integers(0, 1 << 64, _SLOTS * 256, np.uint64)


def _distinct_words(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each distinct word, and each word's index among them.

    Words are grouped by a 64-bit tabulation hash; each is then compared with the first of its
    group, and should two words ever share a hash, the block is grouped by the words themselves.
    """
    starts, sizes = cuts[:-1], np.diff(cuts)
    if not len(starts):
        return starts, starts
    offset = np.arange(len(data)) - np.repeat(starts, sizes)
    value = _TABLE[(offset & (_SLOTS - 1)) << 8 | data]
    if sizes.max() > _SLOTS:
        value *= (offset // _SLOTS * 2 + 1).astype(np.uint64)
    _, first, group = np.unique(np.add.reduceat(value, starts) + sizes.astype(np.uint64), return_index=True, return_inverse=True)
    twin = starts[first][group]
    if (sizes[first][group] == sizes).all() and (data[np.repeat(twin, sizes) + offset] == data).all():
        return first, group
    raw, index = data.tobytes(), {}
    group = np.array([index.setdefault(raw[a:b], len(index)) for a, b in zip(starts.tolist(), cuts[1:].tolist(), strict=True)], np.int64)
    return np.unique(group, return_index=True)[1], group


_KEPT: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    """The worker's encoder; later tasks of the same job find the words it knows."""
    model = shared.value
    if id(model) not in _KEPT:
        _KEPT.clear()
        _KEPT[id(model)] = Encoder(model)
    return _KEPT[id(model)]


class Encoder:
    """Encodes blocks of texts; keeps the tokens of up to ``CACHE_WORDS`` words between blocks."""

    def __init__(self, model: Model):
        self.model = model
        self.special = regex.compile(b"|".join(regex.escape(s) for s in model.special)) if model.special else None
        self.lengths = np.array([len(t) for t in model.token_bytes], np.int64)
        self.at = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(model.token_bytes), np.uint8)
        self._reset()

    def _reset(self) -> None:
        self.index = {word: i for i, word in enumerate(self.model.special)}
        self.tokens = np.array(list(self.model.special.values()), np.int64)
        self.count = np.ones(len(self.index), np.int64)

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the n+1 text bounds in it."""
        raw = data.tobytes()
        cuts = self._cuts(raw, data, bounds)
        first, group = _distinct_words(data, cuts)
        begin_at, end_at = cuts[first].tolist(), cuts[first + 1].tolist()
        words = [raw[a:b] for a, b in zip(begin_at, end_at, strict=True)]
        if len(self.index) > CACHE_WORDS:
            self._reset()
        new = [w for w in words if w not in self.index]
        if new:
            tokens, count = self.encode_words(new)
            base = len(self.index)
            self.index.update(zip(new, range(base, base + len(new)), strict=True))
            self.tokens, self.count = np.concatenate([self.tokens, tokens]), np.concatenate([self.count, count])
        which = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))[group]
        begin = np.cumsum(self.count) - self.count
        size = self.count[which]
        ids = self.tokens[ranges(begin[which], size)]
        ends = np.concatenate([[0], np.cumsum(size)])
        return ids, ends[np.searchsorted(cuts[:-1], bounds)]

    def _cuts(self, raw: bytes, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Byte positions of the word starts, and the end."""
        text = raw.decode("utf-8")
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        places = np.flatnonzero((data & 0xC0) != 0x80)
        segment = np.zeros(len(codes), bool)
        first = bounds[:-1][np.diff(bounds) > 0]
        segment[np.searchsorted(places, first)] = True
        found = [m.span() for m in self.special.finditer(raw)] if self.special else []
        edges = np.append(first, len(raw))
        found = [(a, b) for a, b in found if edges[np.searchsorted(edges, a, "right")] >= b]
        inside = []
        for a, b in found:
            i, j = np.searchsorted(places, [a, b]).tolist()
            segment[i] = True
            if j < len(segment):
                segment[j] = True
            inside.append((a, b))
        cuts = places[word_starts(text, codes, segment, self.model.classes)]
        for a, b in inside:
            cuts = cuts[(cuts <= a) | (cuts >= b)]
        return np.append(cuts, len(raw))

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of the words one after the other, and their number per word."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        ends = np.cumsum(sizes)
        owner, token = self._propose(data, ends - sizes, ends)
        same = owner[1:] == owner[:-1]
        a, b = token[:-1][same], token[1:][same]
        pairs, back = np.unique(a << 32 | b, return_inverse=True)
        good = keeps_border(self.model, pairs >> 32, pairs & 0xFFFFFFFF)[back]
        failed = np.unique(owner[:-1][same][~good])
        if len(failed):
            stay = np.ones(len(words), bool)
            stay[failed] = False
            exact_owner, exact = self._merge(words, failed)
            owner, token = np.concatenate([owner[stay[owner]], exact_owner]), np.concatenate([token[stay[owner]], exact])
            order = np.argsort(owner, kind="stable")
            owner, token = owner[order], token[order]
        return token, np.bincount(owner, minlength=len(words))

    def _propose(self, data: np.ndarray, place: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match of all words at once: ``(word, token)`` in order."""
        owners, tokens = [], []
        word = np.arange(len(place))
        live = place < end
        word, place, end = word[live], place[live], end[live]
        while len(word):
            node, depth, best, best_size, at = np.zeros(len(word), np.int64), 0, np.full(len(word), -1), np.zeros(len(word), np.int64), np.arange(len(word))
            while len(at):
                node = self.model.trie(node << 8 | data[place[at] + depth])
                depth += 1
                on = node >= 0
                at, node = at[on], node[on]
                token = self.model.ends[node]
                hit = token >= 0
                best[at[hit]], best_size[at[hit]] = token[hit], depth
                on = place[at] + depth < end[at]
                at, node = at[on], node[on]
            owners.append(word)
            tokens.append(best)
            place = place + best_size
            live = place < end
            word, place, end = word[live], place[live], end[live]
        if not owners:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        owner, token = np.concatenate(owners), np.concatenate(tokens)
        order = np.argsort(owner, kind="stable")
        return owner[order], token[order]

    def _merge(self, words: list[bytes], which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging: short words together, a rank per word and round; long ones each by a heap."""
        long = [w for w in which.tolist() if len(words[w]) > LONG_WORD]
        short = [w for w in which.tolist() if len(words[w]) <= LONG_WORD]
        done = [(np.full(len(t), w), t) for w in long for t in [self._merge_long(words[w])]]
        owner = np.repeat(np.array(short, np.int64), [len(words[w]) for w in short])
        token = self.model.byte_ids[np.frombuffer(b"".join(words[w] for w in short), np.uint8)]
        while len(token):
            rank = self.model.pairs(token[:-1] << 32 | token[1:])
            rank[(rank < 0) | (owner[1:] != owner[:-1])] = _NEVER
            rank = np.append(rank, _NEVER)
            heads = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            least = np.repeat(np.minimum.reduceat(rank, heads), np.diff(np.append(heads, len(owner))))
            still = least < _NEVER
            done.append((owner[~still], token[~still]))
            owner, token, rank, least = owner[still], token[still], rank[still], least[still]
            if not len(token):
                break
            hit = rank == least
            head = hit & ~np.append(False, hit[:-1])
            index = np.arange(len(hit))
            run = np.maximum.accumulate(np.where(head, index, 0))
            hit &= (index - run) % 2 == 0
            token = np.where(hit, self.model.made[np.where(hit, rank, 0)], token)
            stay = ~np.append(False, hit[:-1])
            owner, token = owner[stay], token[stay]
        owner, token = np.concatenate([o for o, _ in done]), np.concatenate([t for _, t in done])
        order = np.argsort(owner, kind="stable")
        return owner[order], token[order]

    def _merge_long(self, word: bytes) -> np.ndarray:
        model = self.model
        token = model.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        after, before = [*range(1, len(token)), -1], list(range(-1, len(token) - 1))
        known: dict[tuple[int, int], int] = {}

        def rank(i: int) -> int:
            pair = (token[i], token[after[i]])
            if pair not in known:
                known[pair] = int(model.pairs(np.array([pair[0] << 32 | pair[1]]))[0])
            return known[pair]

        heap = [(r, i) for i in range(len(token) - 1) if (r := rank(i)) >= 0]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if token[i] < 0 or after[i] < 0 or rank(i) != r:
                continue
            gone = after[i]
            token[i], token[gone], after[i] = int(model.made[r]), -1, after[gone]
            if after[i] >= 0:
                before[after[i]] = i
            for j in (before[i], i):
                if j >= 0 and after[j] >= 0 and (q := rank(j)) >= 0:
                    heapq.heappush(heap, (q, j))
        return np.array([t for t in token if t >= 0], np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids, special tokens included, in UTF-8; malformed sequences become U+FFFD."""
        raw = self.flat[ranges(self.at[ids], self.lengths[ids])].tobytes()
        try:
            raw.decode("utf-8")
            return raw
        except UnicodeDecodeError:
            return raw.decode("utf-8", "replace").encode()


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, ids)`` for every row; ids are unsigned 32-bit little-endian numbers in one binary value.

    As the ``tokenizers`` library encodes with that file, without added special tokens; a special
    token's string in a text becomes its id. Null and empty texts have no ids; repeated doc_ids,
    null ones and other columns do no harm. The vocabulary tables (bounded by the file) are
    broadcast, so executors do not need the file.
    """
    check_columns(docs, "doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in blocks(batches, "text", BLOCK_BYTES):
            ids, bounds = encoder.encode(*byte_column(batch.column(1)))
            raw = ids.astype("<u4").tobytes()
            yield pa.record_batch([batch.column(0), pa.array([raw[4 * a : 4 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.binary())], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary")


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """``rows (doc_id, ids)`` with the column ``decoded``, the text in UTF-8; null ids give empty text."""
    check_columns(rows, "doc_id", "ids")
    shared = rows.sparkSession.sparkContext.broadcast(load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in blocks(batches, "ids", 2 * BLOCK_BYTES):
            texts = [encoder.decode(np.frombuffer(raw.as_py() or b"", "<u4").astype(np.int64)) for raw in batch.column(1)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.binary())], ["doc_id", "ids", "decoded"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", F.col("ids").cast("binary").alias("ids")).mapInArrow(run, f"doc_id {kind}, ids binary, decoded binary")
