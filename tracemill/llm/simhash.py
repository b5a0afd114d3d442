"""Near-duplicate texts by SimHash fingerprints and covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tracemill.llm.common import Scratch, blocks, check_columns, find
from tracemill.llm.components import components

RADIUS = 2
BITS = 64
SEED = 42
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_ROWS = 4096


def fingerprint(text: bytes, words: int) -> int:
    """64-bit fingerprint of a text; shingles are counted with their repeats."""
    return _majority(_shingle_hashes(text.translate(_LOWER).split(), words))


def _majority(hashes: np.ndarray) -> int:
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), _ROWS):
        part = hashes[at : at + _ROWS].astype(">u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``(doc_id, fp long)``: A-Z lower-cased, words between ASCII white space, ``words``-word shingles.

    A text with fewer words is one shingle; a text without words, empty or null, has fingerprint 0.
    A bit is set if it is set in more than half of the shingles' XXH64 (seed 42). ``fp`` holds the
    unsigned value in two's complement. Repeated ids are kept as separate rows.
    """
    check_columns(docs, "doc_id", "text")

    kind = docs.schema["doc_id"].dataType
    schema = StructType([StructField("doc_id", kind), StructField("fp", LongType())])
    return docs.select("doc_id", "text").mapInArrow(_printer("text", words, ["doc_id", "fp"]), schema)


def _printer(column: str, words: int, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Puts the fingerprint of ``column`` (a column, or a field of a struct) beside the first column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, column, 4 << 20):
            texts = find(batch, column).cast(pa.large_binary())
            found = np.fromiter((fingerprint(t.as_py() or b"", words) for t in texts), np.uint64, batch.num_rows)
            yield pa.record_batch([batch.column(0), pa.array(found.view(np.int64))], names)

    return run


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """2^(radius+1) - 1 masks such that any ``radius`` bits lie outside at least one of them.

    Bit i has the vector 1 + i mod (2^(radius+1) - 1) over GF(2); mask v holds the bits whose inner
    product with v is 1. The vectors of ``radius`` bits span at most ``radius`` dimensions, so some v
    is orthogonal to all of them. Each mask keeps about 4/7 of the bits (radius 2).
    """
    size = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(bits) if bin((1 + i % size) & v).count("1") & 1) for v in range(1, size + 1)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def links(classes: DataFrame) -> DataFrame:
    """``(a, b)``: links that join all fingerprints (column ``fp``, distinct) within radius 2.

    Fingerprints sharing a masked value in one of the seven tables are candidates. Two values differ in at most
    two bits exactly if they have a common midpoint, a value that differs from either in at most one
    bit; in table v it suffices to flip bits outside mask v. So each candidate emits itself and once its
    flips outside some mask of a table it shares (65 rows at most) and is linked with the smallest fingerprint at each midpoint. All at a
    midpoint lie within radius 2 of each other, so no false link arises and no link
    between components is lost; a crowded table costs rows in proportion to its members, not their
    pairs, and a midpoint has at most 65 members.
    """
    masks = covering_masks()
    table = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)])
    rows = classes.select("fp", F.explode(table).alias("e")).select("fp", "e.t", "e.key")
    crowded = rows.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1").select("t", "key")
    free = F.element_at(F.array(*[F.lit(_signed(~m % (1 << BITS))) for m in masks]), F.col("t") + 1)
    candidates = rows.join(crowded, ["t", "key"]).groupBy("fp").agg(F.bit_or(free).alias("free"))
    bits = F.array(*[F.lit(_signed(1 << i)) for i in range(BITS)])
    flips = F.concat(F.array(F.lit(0).cast("bigint")), F.filter(bits, lambda bit: F.col("free").bitwiseAND(bit) != 0))
    halves = candidates.select("fp", F.explode(flips).alias("flip"))
    halves = halves.select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("midpoint"))
    least = halves.groupBy("midpoint").agg(F.min("fp").alias("least"), F.max("fp").alias("most")).where("least != most").drop("most")
    return halves.join(least, "midpoint").where("fp != least").select(F.col("fp").alias("a"), F.col("least").alias("b")).distinct()


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row; component_id is the smallest doc_id reachable.

    Equal fingerprints form one class, combined before any shuffle, so copies cost one row a task.
    Rows with a null doc_id get a class like any other but never name one, unless all ids of it are null.
    An empty table gives no rows; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    prints = scratch.save(fingerprints(docs, words))
    owners = _owners(prints, F.col("doc_id"), scratch).select("fp", F.col("winner").alias("component_id"))
    return _join_salted(prints, owners, "fp").select("doc_id", "fp", "component_id")


def _owners(prints: DataFrame, rank: Column, scratch: Scratch) -> DataFrame:
    """``(fp, winner)``: for every fingerprint the smallest ``rank`` of all rows of its component, nulls left out."""
    classes = scratch.save(prints.groupBy("fp").agg(F.min(rank).alias("first")))
    parts = scratch.save(components(links(classes.select("fp")), scratch))
    named = classes.join(parts, classes["fp"] == parts["node"]).select("fp", "first", "component")
    smallest = named.groupBy("component").agg(F.min("first").alias("winner"))
    linked = named.join(smallest, "component").select("fp", "winner")
    return classes.join(linked, "fp", "left").select("fp", F.coalesce("winner", "first").alias("winner"))


#: Tasks that the rows of one frequent key are dealt over.
SALTS = 16


def _join_salted(rows: DataFrame, owners: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of ``owners``, one narrow row per key, repeated for each salt."""
    salted = owners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, [key, "salt"]).drop("salt")


def _shingle_hashes(tokens: list[bytes], words: int) -> np.ndarray:
    if not tokens:
        return np.zeros(0, np.uint64)
    shingles = [b" ".join(tokens)] if len(tokens) <= words else map(b" ".join, zip(*(tokens[i:] for i in range(words)), strict=False))
    return np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64)


def keep_one(docs: DataFrame, words: int = 3) -> DataFrame:
    """One row of each component of ``docs``: that of the smallest id, ids before null, with its columns as they are.

    Each row is judged by its own fingerprint: rows that share an id but lie in different components stay
    apart, and so do the groups of rows without an id. Of rows of one id in one component the one with the smallest hash
    of all columns stays. Texts without words are copies of each other. An empty table stays empty.
    """
    check_columns(docs, "doc_id", "text")
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    schema = StructType([*rows.schema.fields, StructField("fp", LongType())])
    prints = scratch.save(rows.mapInArrow(_printer("row.text", words, ["row", "fp"]), schema).withColumn("at", F.monotonically_increasing_id()))
    others = F.to_json(F.struct(*[F.col(f"row.`{c}`") for c in docs.columns if c != "text"]))
    rank = F.struct(F.col("row.doc_id").isNull().alias("none"), F.col("row.doc_id").alias("id"), F.xxhash64("row.text", others).alias("hash"), "at")
    ranked = scratch.save(prints.select("fp", rank.alias("rank")))
    kept = _owners(ranked, F.col("rank"), scratch).select(F.col("winner.at").alias("kept")).distinct()
    gone = ranked.select(F.col("rank.at").alias("at")).join(kept, F.col("at") == F.col("kept"), "left_anti")
    return prints.join(scratch.save(gone), "at", "left_anti").select("row.*")
