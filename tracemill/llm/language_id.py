"""Language identification by compression with per-language zstandard dictionaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import blocks, check_columns, find

#: Bytes of each language's raw-content dictionary, cut from as many texts as give ``SLICE_BYTES`` each.
DICTIONARY_BYTES = 65_536
SLICE_BYTES = 256
#: More languages than this are an error: the driver and each task hold one dictionary of each.
MAX_LANGUAGES = 500
LEVEL = 6
BLOCK_BYTES = 2048
#: Relative difference between the two smallest sizes below which a prediction is marked rejected.
MIN_MARGIN = 0.01
#: Margin at which the score is 1 - 1/e.
MARGIN_SCALE = 0.02
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_NO_WORD = regex.compile(r"[^\p{L}\p{M}]+")


def plain(text: str) -> bytes:
    """Lower-case words of letters and their combining marks (vowel signs too), with one space between them."""
    return _NO_WORD.sub(" ", text.lower()).encode("utf-8", "replace")


def sizes(compressors: list[zstandard.ZstdCompressor], raw: bytes) -> list[int]:
    """Compressed size under each dictionary; every block is coded afresh, so long texts profit all along."""
    parts = [raw[k : k + BLOCK_BYTES] for k in range(0, len(raw), BLOCK_BYTES)]
    return [sum(len(c.compress(p)) for p in parts) for c in compressors]


def compressors(dictionaries: list[bytes]) -> list[zstandard.ZstdCompressor]:
    out = []
    for raw in dictionaries:
        shared = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        shared.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(dict_data=shared, level=LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False))
    return out


def learnable() -> Column:
    """The rows that languages may be learnt from, by the text of doc_id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1


def train(docs: DataFrame, rows: Column | None = None) -> dict[str, bytes]:
    """A dictionary per value of ``lang`` in the rows given, from a bounded sample.

    A hash of the doc_id draws about four times the texts needed of each language (all, if there are few); of these the ones with the
    smallest hash give a slice each. Null languages and texts without letters teach nothing. Every other value of ``lang``
    is learnt; more than ``MAX_LANGUAGES`` raise ValueError.
    """
    check_columns(docs, "doc_id", "text", "lang")
    known = docs.where("lang is not null and text is not null").where(F.lit(True) if rows is None else rows).where(F.col("text").rlike(r"\p{L}"))
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"lang has more than {MAX_LANGUAGES} values")
    if not counts:
        return {}
    wanted = 4 * DICTIONARY_BYTES // SLICE_BYTES
    span = 1 << 32
    bound = docs.sparkSession.createDataFrame([(r["lang"], min(span, -(-span * 4 * wanted // r["n"]))) for r in counts], "lang string, bound bigint")
    draw = F.xxhash64("doc_id", "text")
    drawn = known.select("lang", "text", draw.alias("h")).join(F.broadcast(bound), "lang").where(F.col("h").bitwiseAND(span - 1) < F.col("bound"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slices = []
            for text, h in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                raw = plain(text.as_py())
                at = (h >> 32) % max(1, len(raw) - SLICE_BYTES)
                slices.append(raw[at : at + SLICE_BYTES])
            yield pa.record_batch([batch.column(0), pa.array(slices, pa.binary()), batch.column(2)], ["lang", "slice", "h"])

    slices = drawn.select("lang", "text", "h").mapInArrow(cut, "lang string, slice binary, h bigint").collect()
    out: dict[str, bytes] = {}
    for r in sorted(slices, key=lambda r: (r["lang"], r["h"], bytes(r["slice"]))):
        if len(out.setdefault(r["lang"], b"")) < DICTIONARY_BYTES:
            out[r["lang"]] += bytes(r["slice"])
    return {k: v[:DICTIONARY_BYTES] for k, v in out.items()}


def identify(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """``(doc_id, lang_pred, score, rejected)`` for every row, from the whole text alone.

    The language whose dictionary leaves the fewest bytes; of equal sizes the first by name, with score 0. Null
    texts and texts without a letter are ``und`` with score 0, as is everything if nothing was
    learnt. ``rejected`` marks those and predictions with a narrow margin. Dictionaries are broadcast; their
    number and size are bounded.
    """
    check_columns(docs, "doc_id", "text")
    names = sorted(dictionaries)
    shared = docs.sparkSession.sparkContext.broadcast([dictionaries[n] for n in names])

    def judge(text: str | None, tools: list[zstandard.ZstdCompressor]) -> tuple[str, float, bool]:
        if not names or text is None or not _LETTER.search(text):
            return UNKNOWN, 0.0, True
        found = sorted(zip(sizes(tools, plain(text)), names, strict=True))
        margin = 1 - found[0][0] / found[1][0] if len(found) > 1 else 1.0
        return found[0][1], float(1 - np.exp(-margin / MARGIN_SCALE)), margin < MIN_MARGIN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = compressors(shared.value)
        for batch in blocks(batches, "text", 8 << 20):
            rows = [judge(t.as_py(), tools) for t in find(batch, "text")]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.record_batch([batch.column(0), *columns], ["doc_id", "lang_pred", "score", "rejected"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")
