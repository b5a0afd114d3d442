"""What the operators share: code and scratch folders that all executors reach, and text columns as Arrow bytes."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows and bytes of one Arrow batch; a longer row is a batch of its own.
ARROW_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "4194304"}


def ship(spark: SparkSession) -> None:
    """Hands this package to the executors, once a session, in case they have no installed copy.

    Also keeps Arrow batches small where the session has no setting of its own: a batch is held on both sides of the worker.
    """
    context = spark.sparkContext
    for name, value in ARROW_BATCH.items():
        if context.getConf().get(name) is None:
            spark.conf.set(name, value)
    if getattr(context, "_llm_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="llm-code-")) / "package.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, str(file.relative_to(package.parent)))
    context.addPyFile(str(archive))
    context._llm_shipped = True


class Scratch:
    """Tables below ``spark.checkpoint.dir``; they cut lineage and outlive lost executors.

    Where the setting is absent (tests in one process) a temporary folder stands in for it.
    ``drop`` removes tables that no later step reads.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="llm-scratch-")
            spark.sparkContext.setCheckpointDir(base)
        self.root = f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"
        self._made = 0

    def save(self, frame: DataFrame) -> DataFrame:
        self._made += 1
        path = f"{self.root}/{self._made}"
        frame.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def drop(self, *frames: DataFrame) -> None:
        jvm = self.spark._jvm
        for frame in frames:
            for folder in {file.rsplit("/", 1)[0] for file in frame.inputFiles()}:
                if self.root.rsplit("/", 1)[1] in folder:
                    path = jvm.org.apache.hadoop.fs.Path(folder)
                    path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def check_columns(frame: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in frame.columns]
    if missing:
        raise ValueError(f"columns {missing} are missing")


def byte_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column in one array, and the n+1 row bounds; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    bounds = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    if data is None or not bounds[-1]:
        return np.zeros(0, np.uint8), bounds - bounds[0]
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def find(batch: pa.RecordBatch, column: str) -> pa.Array:
    """A column, or a field of a struct column."""
    name, _, field = column.partition(".")
    found = batch.column(batch.schema.get_field_index(name))
    return pc.struct_field(found, field) if field else found


def blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of one add up to ``limit`` bytes or are a single row."""
    for batch in batches:
        lengths = np.zeros(batch.num_rows, np.int64)
        if batch.num_rows:
            lengths = np.diff(byte_column(find(batch, column))[1])
        start = size = 0
        for i, n in enumerate(lengths.tolist()):
            if size + n > limit and i > start:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if batch.num_rows > start:
            yield batch.slice(start)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for every (start, length), one after the other."""
    lengths = np.asarray(lengths, np.int64)
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, np.int64)
    out = np.ones(ends[-1], np.int64)
    full = lengths > 0
    first, begin, count = (ends - lengths)[full], np.asarray(starts, np.int64)[full], lengths[full]
    out[first[0]] = begin[0]
    out[first[1:]] = begin[1:] - (begin[:-1] + count[:-1] - 1)
    return np.cumsum(out)
