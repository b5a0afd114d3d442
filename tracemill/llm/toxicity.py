"""Toxicity scores: a linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracemill.llm.common import blocks, byte_column, check_columns, find

ORDERS = (4, 5, 6)
BITS = 20
MIN_DEVIATION = 4
#: Labelled texts the classifier is fitted on, per class at most; those with the smallest id hashes.
SAMPLE_PER_CLASS = 1500
#: Bytes of sampled texts that the fitting task takes at most, both classes together; longer texts are left out first.
SAMPLE_BYTES = 12_000_000
BLOCK_BYTES = 1 << 20
CHUNK_BYTES = 1 << 18
EPOCHS = 150
_LOWER = bytes(c + 32 if 65 <= c <= 90 else 32 if c in b"\t\n\v\f\r" else c for c in range(256))


@dataclass
class Model:
    """``weights`` per n-gram bucket and the intercept; sums over a text are divided by the root of its n-grams."""

    weights: np.ndarray
    bias: float


def grams(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order the bucket of the n-gram at every byte, and whether it lies within its text."""
    data = np.frombuffer(data.tobytes().translate(_LOWER), np.uint8)
    left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(len(data))
    code = np.zeros(len(data), np.uint64)
    wide = np.concatenate([data, np.zeros(max(ORDERS), np.uint8)]).astype(np.uint64)
    for n in range(1, max(ORDERS) + 1):
        code |= wide[n - 1 : n - 1 + len(data)] << np.uint64(8 * (n - 1))
        if n in ORDERS:
            yield (((code + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int32), left >= n


def margins(model: Model, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total, count = np.zeros(len(bounds) - 1), np.zeros(len(bounds) - 1)
    full = np.flatnonzero(np.diff(bounds) > 0)
    for bucket, inside in grams(data, bounds):
        if len(full):
            total[full] += np.add.reduceat(model.weights[bucket] * inside, bounds[full])
            count[full] += np.add.reduceat(inside, bounds[full], dtype=np.int64)
    return model.bias + total / np.sqrt(np.maximum(count, 1))


def score(model: Model, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margins(model, data, bounds), -30, 30)))


def fit(data: np.ndarray, bounds: np.ndarray, toxic: np.ndarray, prior: float) -> Model:
    """A classifier from three quarters of the texts, its scale and intercept from the last quarter of either class."""
    order = np.concatenate([np.flatnonzero(toxic == k) for k in (True, False)])
    nth = np.empty(len(toxic), np.int64)
    nth[order] = np.concatenate([np.arange((toxic == k).sum()) for k in (True, False)])
    held = nth % 4 == 3
    model = _fit(*_some(data, bounds, ~held), toxic[~held], prior)
    if held.any() and 0 < toxic[held].sum() < held.sum():
        few = [np.flatnonzero(held)[k : k + 64] for k in range(0, int(held.sum()), 64)]
        margin = np.concatenate([margins(model, *_some(data, bounds, np.isin(np.arange(len(toxic)), k))) for k in few])
        _calibrate(model, margin, toxic[held], prior)
    return model


def _some(data: np.ndarray, bounds: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    parts = [data[bounds[i] : bounds[i + 1]] for i in np.flatnonzero(which)]
    return np.concatenate([*parts, data[:0]]), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def _calibrate(model: Model, margin: np.ndarray, toxic: np.ndarray, prior: float) -> None:
    """Logistic fit of the labels on the margins by Newton's method, with smoothed targets so that it stays finite."""
    groups = [int((~toxic).sum()), int(toxic.sum())]
    target = np.where(toxic, (groups[1] + 1) / (groups[1] + 2), 1 / (groups[0] + 2))
    cost = np.where(toxic, prior / groups[1], (1 - prior) / groups[0])
    middle, spread = float(margin.mean()), max(float(margin.std()), 1e-9)
    x = np.stack([(margin - middle) / spread, np.ones(len(margin))])
    a = np.array([1.0, 0.0])
    loss = lambda a: float((cost * (np.logaddexp(0, a @ x) - target * (a @ x))).sum())
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ x, -30, 30)))
        move = np.linalg.solve((x * (cost * p * (1 - p))) @ x.T + 1e-9 * np.eye(2), x @ (cost * (p - target)))
        step = 1.0
        while step > 1e-6 and loss(a - step * move) > loss(a):
            step /= 2
        a = a - step * move
        if step * np.abs(move).max() < 1e-9:
            break
    if a[0] > 0:
        model.weights *= np.float32(a[0] / spread)
        model.bias = float((model.bias - middle) * a[0] / spread + a[1])


def _fit(data: np.ndarray, bounds: np.ndarray, toxic: np.ndarray, prior: float) -> Model:
    """Logistic regression from given texts; ``prior`` is the share of toxic texts among all labelled ones.

    The log-count ratio of a bucket compares the shares of texts of either class that hold it.
    Features are these ratios times the bucket's count over the root of the text's n-grams, over the buckets whose presence differs
    between the classes by ``MIN_DEVIATION`` standard errors. Without both classes the score is the prior.
    """
    base = float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))
    size = 1 << BITS
    if toxic.all() or not toxic.any():
        return Model(np.zeros(size, np.float32), base)
    groups = [int((~toxic).sum()), int(toxic.sum())]
    held = np.zeros((2, size), np.int32)
    for keys, _ in _counts(data, bounds):
        for k in (0, 1):
            held[k] += np.bincount((keys & (size - 1))[toxic[keys >> BITS] == k], minlength=size).astype(np.int32)
    share = held.sum(axis=0, dtype=np.float32) / np.float32(len(toxic))
    spread = np.sqrt(share * (1 - share) * (1 / groups[0] + 1 / groups[1])) + 1e-12
    telling = np.abs(held[1] / groups[1] - held[0] / groups[0]) > MIN_DEVIATION * spread
    chosen = np.flatnonzero(telling)
    place = np.full(size, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    held = held[:, chosen]
    del share, spread, telling
    ratio = np.log((held[1] + 1) / (groups[1] + 2)) - np.log((held[0] + 1) / (groups[0] + 2))
    row, bucket, times, total = [], [], [], np.zeros(len(toxic))
    for keys, n in _counts(data, bounds):
        total += np.bincount(keys >> BITS, n, len(toxic))
        use = place[keys & (size - 1)] >= 0
        row.append(keys[use] >> BITS)
        bucket.append(place[keys[use] & (size - 1)])
        times.append(n[use])
    row, bucket, times = np.concatenate(row), np.concatenate(bucket), np.concatenate(times)
    value = times / np.sqrt(total[row]) * ratio[bucket]
    scale = 1 / max(float(np.std(np.bincount(row, value, len(toxic)))), 1e-9)
    value *= scale
    cost = np.where(toxic, prior / groups[1], (1 - prior) / groups[0])
    weight, bias = np.ones(len(chosen)), base
    m, v, mb, vb = np.zeros(len(chosen)), np.zeros(len(chosen)), 0.0, 0.0
    for step in range(1, EPOCHS + 1):
        margin = bias + np.bincount(row, value * weight[bucket], len(toxic))
        error = cost * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - toxic)
        slope = np.bincount(bucket, value * error[row], len(chosen)) + 1e-7 * weight
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        mb, vb = 0.9 * mb + 0.1 * error.sum(), 0.99 * vb + 0.01 * error.sum() ** 2
        rate = 0.3 * (1 - step / (EPOCHS + 1))
        weight -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        bias -= rate * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.99**step)) + 1e-9)
    weights = np.zeros(size, np.float32)
    weights[chosen] = weight * ratio * scale
    return Model(weights, float(bias))


def _counts(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text << BITS | bucket) and its times, over texts of about ``CHUNK_BYTES`` at a time."""
    at = 0
    while at < len(bounds) - 1:
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + CHUNK_BYTES, "right")) - 1)
        part = bounds[at : end + 1]
        owner = np.repeat(np.arange(at, end, dtype=np.int64), np.diff(part))
        found = [owner[inside] << BITS | bucket[inside] for bucket, inside in grams(data[part[0] : part[-1]], part - part[0])]
        yield np.unique(np.concatenate(found), return_counts=True)
        at = end


def learnable() -> Column:
    """The rows that labels may be learnt from, by the text of doc_id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0


def train(docs: DataFrame, labels: DataFrame, rows: Column | None = None) -> Model:
    """A model from a bounded sample of labelled texts.

    ``SAMPLE_PER_CLASS`` labelled ids of each class, those with the smallest hash, come to one task with their
    whole texts, at most ``SAMPLE_BYTES``; it fits the model, and only its weights come to the driver. ``rows`` restricts ``labels``. Ids labelled both ways, null ids and null labels are not used;
    of texts that share an id any may be drawn; without labels the score is one half.
    """
    check_columns(docs, "doc_id", "text")
    check_columns(labels, "doc_id", "toxic")
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.min("toxic").alias("a"), F.max("toxic").alias("b"))
    known = known.where("a = b").select("doc_id", F.col("a").cast("int").alias("toxic")).where(F.lit(True) if rows is None else rows)
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    picked = [r for k in (0, 1) for r in known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_PER_CLASS).collect()]
    if not picked:
        return Model(np.zeros(1 << BITS, np.float32), 0.0)
    schema = known.schema
    sample = docs.sparkSession.createDataFrame(picked, schema)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("toxic", "text", F.xxhash64("doc_id").alias("h"))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    used = texts.withColumn("size", size).orderBy("size", "h").limit(2 * SAMPLE_PER_CLASS)
    used = used.withColumn("sum", F.sum("size").over(Window.orderBy("size", "h", "toxic"))).where(F.col("sum") <= SAMPLE_BYTES)
    prior = counts.get(1, 0) / sum(counts.values())

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches([b.select(["toxic", "text"]) for b in batches], pa.schema([("toxic", pa.int32()), ("text", pa.string())]))
        model = fit(*byte_column(held["text"]), held["toxic"].to_numpy() == 1, prior)
        yield pa.record_batch([pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.bias], pa.float64())], ["weights", "bias"])

    sample = used.select("toxic", "text", "h").coalesce(1).sortWithinPartitions("h", "toxic", "text")
    found = sample.mapInArrow(learn, "weights binary, bias double").first()
    if found is None:
        return fit(*byte_column(pa.array([], pa.string())), np.zeros(0, bool), prior)
    return Model(np.frombuffer(found["weights"], np.float32), found["bias"])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``row`` (a struct of all columns) and ``score`` for every row; null and empty texts score by the intercept alone."""
    check_columns(docs, "doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "row.text", BLOCK_BYTES):
            found = score(shared.value, *byte_column(find(batch, "row.text")))
            yield pa.record_batch([batch.column(0), pa.array(found, pa.float64())], ["row", "score"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.mapInArrow(run, StructType(list(rows.schema.fields)).add("score", "double"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more."""
    return scored(docs, train(docs, labels, learnable())).where(F.col("score") < threshold).select("row.*")
