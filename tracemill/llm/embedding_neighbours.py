"""Near-duplicate vectors by NN-descent.

A neighbour graph starts from hash tables of random hyperplanes and is refined by comparing
neighbours of a common neighbour, until no new links turn up. A list that is full of links may hide
more: the components of such saturated vectors are compared whole, in tiles, with each other too where they
come close, which amounts to enlarging their lists as far as needed. An exact audit of some vectors against all measures recall; while it is too
low, more tables are added.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.common import Scratch, check_columns
from tracemill.llm.components import components

THRESHOLD = 0.95
#: Neighbours a list holds before it counts as saturated.
NEIGHBOURS = 10
#: Neighbours taken from one block of one table or pivot.
PER_BLOCK = 5
#: Two links in a row turn by at most twice the threshold's angle; the graph keeps nothing farther apart.
REACH = math.cos(2 * math.acos(THRESHOLD))
#: Chance of a pair at the threshold to meet in one of the tables of a round, which sets their number.
MEETING = 0.995
AUDITED = 2000
RECALL = 0.999
ROUNDS = 4
STEPS = 12
BLOCK = 512
TILE = 1024


def _unit(raw: list[float | None] | None) -> np.ndarray | None:
    if not raw or any(x is None for x in raw):
        return None
    vector = np.array(raw, np.float64)
    largest = np.abs(vector).max()
    if not np.isfinite(largest) or largest == 0:
        return None
    vector /= largest
    return vector / np.linalg.norm(vector)


def units(vectors: DataFrame) -> DataFrame:
    """``(vec_id, dim, unit)``: unit vectors in doubles, null for vectors that link with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_unit(raw.as_py()) for raw in batch.column(1)]
            yield pa.record_batch(
                [batch.column(0), pa.array([None if u is None else len(u) for u in found], pa.int32()), pa.array([None if u is None else u.tobytes() for u in found], pa.binary())],
                ["vec_id", "dim", "unit"],
            )

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.select("vec_id", "embedding").mapInArrow(run, f"vec_id {kind}, dim int, unit binary")


def _matrix(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)


def _best(ids: np.ndarray, sims: np.ndarray) -> Iterator[tuple[int, int, float]]:
    """The nearest others of each vector of a block, and its linked vector of the smallest id."""
    np.fill_diagonal(sims, -2)
    k = min(PER_BLOCK, len(ids) - 1)
    if k < 1:
        return
    near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    smallest = np.argsort(ids, kind="stable")
    anchor = smallest[np.argmax(sims[:, smallest] >= THRESHOLD, axis=1)]
    row = np.repeat(np.arange(len(ids)), k + 1)
    column = np.concatenate([near, anchor[:, None]], axis=1).ravel()
    keep = sims[row, column] >= REACH
    for i, j in {(int(i), int(j)) for i, j in zip(row[keep], column[keep], strict=True)}:
        yield ids[i].item(), ids[j].item(), float(sims[i, j])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares the vectors of one group (``g1``, ``g2``) with each other, ``BLOCK`` at a time in the order given."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        matrix = _matrix([r[1] for r in rows])
        edges = list(_best(np.array([r[0] for r in rows], np.int64), matrix @ matrix.T))
        return pa.record_batch([pa.array([e[k] for e in edges], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["a", "b", "sim"])

    held, group = [], None
    for batch in batches:
        for g1, g2, vid, unit in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if held and ((g1, g2) != group or len(held) >= BLOCK):
                if len(held) > 1:
                    yield solve(held)
                held = []
            held.append((vid, unit))
            group = (g1, g2)
    if len(held) > 1:
        yield solve(held)


def _tables(classes: DataFrame, first: int, count: int, bits: int) -> DataFrame:
    """Edges found in ``count`` hash tables. Range partitioning splits buckets of any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            codes, lines = [], []
            for dim, raw in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if dim not in planes:
                    planes[dim] = np.stack([np.random.default_rng([dim, t]).standard_normal((bits + 1, dim)) for t in range(first, first + count)])
                value = planes[dim] @ np.frombuffer(raw, np.float64)
                codes.append((((value[:, :bits] >= 0) @ (1 << np.arange(bits))) * 4096 + dim % 4096).tolist())
                lines.append(value[:, bits].tolist())
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(codes, pa.list_(pa.int64())), pa.array(lines, pa.list_(pa.float64()))], ["id", "unit", "codes", "lines"])

    coded = classes.select("id", "dim", "unit").mapInArrow(run, "id bigint, unit binary, codes array<bigint>, lines array<double>")
    rows = coded.select("id", "unit", F.posexplode(F.arrays_zip("codes", "lines")).alias("t", "e")).select("t", F.col("e.codes").alias("code"), "id", "unit", F.col("e.lines").alias("line"))
    rows = rows.withColumn("dim", F.octet_length("unit"))
    dealt = rows.repartitionByRange("t", "code", "dim", "line", "id").sortWithinPartitions("t", "code", "dim", "line", "id")
    return dealt.select((F.col("t") * 100_000 + F.col("dim") / 8).cast("bigint").alias("g1"), F.col("code").alias("g2"), "id", "unit").mapInArrow(_compare, "a bigint, b bigint, sim double")


def _lists(edges: DataFrame) -> DataFrame:
    """Each vector's nearest ``NEIGHBOURS``, and its link of the smallest id; an edge is listed at either end."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim")).groupBy("a", "b").agg(F.max("sim").alias("sim"))
    near = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
    linked = Window.partitionBy("a").orderBy(F.when(F.col("sim") < THRESHOLD, 1).otherwise(0), "b")
    ranked = both.withColumn("r", F.row_number().over(near)).withColumn("s", F.row_number().over(linked))
    return ranked.where((F.col("r") <= NEIGHBOURS) | (F.col("s") == 1)).select("a", "b", "sim")


def _descend(lists: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges between neighbours of a common neighbour, itself included; pivots of any degree go in blocks."""
    around = lists.select("a", F.col("b").alias("id")).unionByName(lists.select(F.col("b").alias("a"), F.col("a").alias("id"))).unionByName(lists.select("a", F.col("a").alias("id"))).distinct()
    rows = around.join(classes.select("id", "unit"), "id").repartition("a").sortWithinPartitions("a", "id")
    return rows.select(F.col("a").alias("g1"), F.lit(0).cast("bigint").alias("g2"), "id", "unit").mapInArrow(_compare, "a bigint, b bigint, sim double")


def _progress(lists: DataFrame) -> tuple:
    """Links of vectors whose lists are not full, and their sum; saturated lists are completed otherwise."""
    linked = lists.where(F.col("sim") >= THRESHOLD).groupBy("a").agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"), F.min("b").alias("least"))
    row = linked.agg(F.count("*"), F.sum(F.when(F.col("n") < NEIGHBOURS, F.col("n"))), F.sum(F.when(F.col("n") < NEIGHBOURS, F.col("h"))), F.sum("least")).first()
    return tuple(row)


def _complete(lists: DataFrame, classes: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``(id, linked)`` and ``(node, component)`` of all vectors with links; saturated components are compared whole.

    A link that neither end lists has a saturated vector at both ends, so components with such vectors
    are compared with each other as well, unless they lie too far apart for a link (``_close``).
    """
    links = lists.where(F.col("sim") >= THRESHOLD).select("a", "b")
    component = scratch.save(components(links, scratch))
    degree = links.groupBy("a").agg(F.count("*").alias("n"))
    full = degree.where(F.col("n") >= NEIGHBOURS).join(component, F.col("a") == F.col("node")).select("component").distinct()
    crowded = scratch.save(component.join(full, "component").join(classes, F.col("node") == F.col("id")).select("id", "component", "dim", "times", "unit"))
    grouped = scratch.save(components(_close(crowded), scratch)).select(F.col("node").alias("component"), F.col("component").alias("together"))
    dealt = crowded.join(grouped, "component", "left").select("id", F.coalesce("together", "component").alias("component"), "times", "unit", F.col("component").alias("own"))
    exact = scratch.save(_tiles(dealt))
    bridges = exact.where("linked is null").select("a", "b").distinct()
    times = classes.select(F.col("id").alias("b"), "times")
    loose = component.join(full, "component", "left_anti").select(F.col("node").alias("a"))
    listed = links.join(loose, "a").join(times, "b").groupBy(F.col("a").alias("id")).agg(F.sum("times").alias("linked"))
    counted = exact.where("linked is not null").groupBy("id").agg(F.sum("linked").alias("linked"))
    if not bridges.isEmpty():
        merged = scratch.save(components(bridges, scratch)).select(F.col("node").alias("component"), F.col("component").alias("merged"))
        component = scratch.save(component.join(merged, "component", "left").select("node", F.coalesce("merged", "component").alias("component")))
    return scratch.save(counted.unionByName(listed)), component


def _close(members: DataFrame) -> DataFrame:
    """``(a, b)``: components that a link could join, by the angle of their pivots and their radii about them.

    A component's pivot is its first vector. Pivots are dealt over tiles, and each pair of tiles is one group.
    """
    width = math.acos(THRESHOLD) + 1e-6
    first = members.where("id = component").select("component", F.col("unit").alias("pivot"))

    def angle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            angles = [math.acos(max(-1.0, min(1.0, float(np.frombuffer(u, np.float64) @ np.frombuffer(p, np.float64))))) for u, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.record_batch([batch.column(0), pa.array(angles, pa.float64())], ["component", "angle"])

    angles = members.join(first, "component").select("component", "unit", "pivot").mapInArrow(angle, "component bigint, angle double")
    pivots = angles.groupBy("component").agg(F.max("angle").alias("radius")).join(members.where("id = component").select("component", "dim", "unit"), "component")
    sizes = pivots.groupBy("dim").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    rows = pivots.join(sizes, "dim").withColumn("tile", F.pmod(F.xxhash64("component"), "tiles").cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least(t, "tile").alias("t1"), F.greatest(t, "tile").alias("t2")))
    dealt = rows.select("dim", F.explode(pairs).alias("p"), "tile", "component", "radius", "unit").select("dim", "p.*", "tile", "component", "radius", "unit")
    group = ["dim", "t1", "t2"]

    def near(held: list[tuple]) -> pa.RecordBatch:
        left = [r for r in held if r[0] == held[0][0]]
        right = [r for r in held if r[0] != held[0][0]] or left
        angles = np.arccos(np.clip(_matrix([r[3] for r in left]) @ _matrix([r[3] for r in right]).T, -1, 1))
        radii = [np.array([r[2] for r in side]) for side in (left, right)]
        i, j = np.nonzero(angles <= radii[0][:, None] + radii[1][None, :] + width)
        names = [np.array([r[1] for r in side], np.int64) for side in (left, right)]
        a, b = names[0][i], names[1][j]
        # A spanning set of what the tile joins.
        root = {n: n for side in names for n in side.tolist()}

        def find(n: int) -> int:
            while root[n] != n:
                root[n] = root[root[n]]
                n = root[n]
            return n

        found = []
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            p, q = find(x), find(y)
            if p != q:
                root[max(p, q)] = min(p, q)
                found.append((x, y))
        return pa.record_batch([pa.array([e[k] for e in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            for d, t1, t2, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (d, t1, t2) != now:
                    yield near(held)
                    held = []
                held.append(tuple(row))
                now = d, t1, t2
        if held:
            yield near(held)

    ordered = dealt.repartition(*group).sortWithinPartitions(*group, "tile", "component")
    return ordered.select(*group, "tile", "component", "radius", "unit").mapInArrow(run, "a bigint, b bigint")


def audit(classes: DataFrame, counts: DataFrame) -> float:
    """Recall of links: the linked vectors counted for ``AUDITED`` vectors, over those found by comparing them with all.

    The vectors compared (those of the smallest id hash) are broadcast; their number is fixed.
    """
    picked = classes.orderBy(F.xxhash64("id"), "id").limit(AUDITED).select("id", "dim", "unit").collect()
    asked: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim in {r["dim"] for r in picked}:
        chosen = [r for r in picked if r["dim"] == dim]
        asked[dim] = np.array([r["id"] for r in chosen], np.int64), _matrix([bytes(r["unit"]) for r in chosen])
    shared = classes.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, ids, times = (np.array(batch.column(i).to_pylist(), np.int64) for i in (1, 0, 3))
            raw = batch.column(2).to_pylist()
            for dim in np.unique(dims).tolist():
                names, matrix = shared.value.get(dim, (np.zeros(0, np.int64), np.zeros((0, dim))))
                total = np.zeros(len(names), np.int64)
                rows = np.flatnonzero(dims == dim)
                for at in range(0, len(rows), BLOCK):
                    part = rows[at : at + BLOCK]
                    linked = (matrix @ _matrix([raw[p] for p in part]).T >= THRESHOLD) & (names[:, None] != ids[part][None, :])
                    total += linked @ times[part]
                yield pa.record_batch([pa.array(names), pa.array(total)], ["id", "true"])

    true = classes.select("id", "dim", "unit", "times").mapInArrow(run, "id bigint, true bigint").groupBy("id").agg(F.sum("true").alias("true"))
    row = true.join(counts, "id", "left").agg(F.sum("true").alias("n"), F.sum(F.least("true", F.coalesce("linked", F.lit(0)))).alias("hits")).first()
    return row["hits"] / row["n"] if row["n"] else 1.0


def _tiles(members: DataFrame) -> DataFrame:
    """Parts of the exact number of linked vectors, ``(id, linked)``, for whole components ``(id, component, times, unit, own)``.

    Rows without a number name two values ``a``, ``b`` of ``own`` that a link joins. Vectors are binned by their angle to the component's first vector. Links join equal or adjacent
    bins only. A crowded bin is dealt over tiles, and each pair of tiles is one group of bounded size.
    """
    spark = members.sparkSession
    width = math.acos(THRESHOLD) * (1 + 1e-9)
    first = members.where("id = component").select("component", F.col("unit").alias("pivot"))

    def angle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = [int(math.acos(max(-1.0, min(1.0, float(np.frombuffer(u, np.float64) @ np.frombuffer(p, np.float64))))) / width) for u, p in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            yield pa.record_batch([*batch.columns[:4], batch.column(5), pa.array(bins, pa.int32())], ["component", "id", "times", "unit", "own", "bin"])

    binned = members.join(first, "component").select("component", "id", "times", "unit", "pivot", "own").mapInArrow(angle, "component bigint, id bigint, times bigint, unit binary, own bigint, bin int")
    binned = Scratch(spark).save(binned)
    sizes = binned.groupBy("component", "bin").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    after = sizes.select("component", (F.col("bin") - 1).alias("bin"), F.col("tiles").alias("next_tiles"))
    before = sizes.select("component", (F.col("bin") + 1).alias("bin"), F.col("tiles").alias("last_tiles"))
    counts = sizes.join(after, ["component", "bin"], "left").join(before, ["component", "bin"], "left").fillna(0, ["next_tiles", "last_tiles"])
    rows = binned.join(counts, ["component", "bin"]).withColumn("tile", F.pmod(F.xxhash64("id"), "tiles"))
    numbers = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    pair = lambda bin1, tile1, bin2, tile2, left: F.struct(bin1.cast("int").alias("b1"), tile1.cast("int").alias("t1"), bin2.cast("int").alias("b2"), tile2.cast("int").alias("t2"), F.lit(left).alias("left"))
    own, tile = F.col("bin"), F.col("tile")
    within = F.transform(numbers("tiles"), lambda t: F.when(t < tile, pair(own, t, own, tile, False)).otherwise(pair(own, tile, own, t, True)))
    forward = F.transform(numbers("next_tiles"), lambda t: pair(own, tile, own + 1, t, True))
    backward = F.transform(numbers("last_tiles"), lambda t: pair(own - 1, t, own, tile, False))
    dealt = rows.select("component", "id", "times", "unit", "own", F.explode(F.concat(within, forward, backward)).alias("p")).select("component", "p.*", "id", "times", "unit", "own")
    key = ["component", "b1", "t1", "b2", "t2"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group = [], None

        def solve() -> pa.RecordBatch:
            sides = [[r for r in held if r[0] is side] for side in (True, False)]
            one = not sides[1]
            if one:
                sides[1] = sides[0]
            ids, times = ([np.array([r[k] for r in s], np.int64) for s in sides] for k in (1, 2))
            out: dict[int, int] = {}
            bridges = np.zeros((0, 2), np.int64)
            if sides[0] and sides[1]:
                linked = _matrix([r[3] for r in sides[0]]) @ _matrix([r[3] for r in sides[1]]).T >= THRESHOLD
                if one:
                    np.fill_diagonal(linked, False)
                found = [(ids[0], linked @ times[1])] + ([] if one else [(ids[1], linked.T @ times[0])])
                out = {i: n for names, sums in found for i, n in zip(names.tolist(), sums.tolist(), strict=True)}
                own = [np.array([r[4] for r in s], np.int64) for s in sides]
                i, j = np.nonzero(linked & (own[0][:, None] != own[1][None, :]))
                bridges = np.unique(np.stack([np.minimum(own[0][i], own[1][j]), np.maximum(own[0][i], own[1][j])], axis=1), axis=0)
            none = [None] * len(bridges)
            ends = [pa.array([None] * len(out) + bridges[:, k].tolist(), pa.int64()) for k in (0, 1)]
            return pa.record_batch([pa.array(list(out) + none, pa.int64()), pa.array(list(out.values()) + none, pa.int64()), *ends], ["id", "linked", "a", "b"])

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for *g, left, vid, times, unit, own in zip(*columns, strict=True):
                if held and g != group:
                    yield solve()
                    held = []
                held.append((left, vid, times, unit, own))
                group = g
        if held:
            yield solve()

    return dealt.repartition(*key).sortWithinPartitions(*key, "id").select(*key, "left", "id", "times", "unit", "own").mapInArrow(count, "id bigint, linked bigint, a bigint, b bigint")


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """``(vec_id, n_links, component_id)`` for every row.

    Equal unit vectors are one class with a count. Vectors that are null, zero or hold null or non-finite
    components have no links and are their own component; so are vectors of another dimension to each other. Rows that share a
    vec_id each count as a vector; rows with a null vec_id have no links. Other columns are ignored.
    """
    check_columns(vectors, "vec_id", "embedding")
    scratch = Scratch(vectors.sparkSession)
    rows = scratch.save(units(vectors))
    usable = rows.where("unit is not null and vec_id is not null")
    classes = scratch.save(usable.groupBy("unit").agg(F.first("dim").alias("dim"), F.min("vec_id").cast("bigint").alias("id"), F.count("*").alias("times")))
    total = classes.count()
    bits = max(1, round(math.log2(max(total, 2) / 16)))
    tables = math.ceil(math.log(1 - MEETING) / math.log(1 - (1 - math.acos(THRESHOLD) / math.pi) ** bits))
    lists, used = None, 0
    for _ in range(ROUNDS):
        fresh = _tables(classes, used, tables, bits)
        used += tables
        lists = scratch.save(_lists(fresh if lists is None else lists.unionByName(fresh)))
        known = None
        for _ in range(STEPS):
            wider = scratch.save(_lists(lists.unionByName(_descend(lists, classes))))
            scratch.drop(lists)
            lists = wider
            reached = _progress(lists)
            if reached == known:
                break
            known = reached
        found, component = _complete(lists, classes, scratch)
        if audit(classes, found) >= RECALL:
            break
    named = classes.join(component, classes["id"] == component["node"], "left").join(found, "id", "left")
    named = named.select("unit", (F.coalesce("linked", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    linked = usable.join(named, "unit").select("vec_id", "n_links", "component_id")
    alone = rows.where("unit is null or vec_id is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").cast("bigint").alias("component_id"))
    return linked.unionByName(alone)
