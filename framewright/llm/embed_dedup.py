"""Embedding near-dedup by an epsilon grid order join.

Unit vectors have cosine >= t exactly where their distance is at most eps = sqrt(2 - 2t). The vectors of each dimension are rotated to
principal axes, the leading ones are cut into grid cells of side eps, and the vectors are sorted by cells in lexicographic
order (range partitions, sorted inside), which makes a sequence of intervals of blocks with bounding boxes. Pairs of sequence intervals are joined recursively:
from groups of range partitions down to intervals as DataFrame joins, and inside the task of a pair of intervals from halves of it down to a few blocks. A
pair goes on only if its boxes are at most eps apart. Boxes have the coordinates on more axes than the grid and the length of what the
axes leave out, which bounds the distance too. What is left is compared by matrix products, with a double-precision check of everything near the threshold.

A task reads its two intervals once, and of them only the blocks near the other's box; it slides over them in memory. An interval has at most
``INTERVAL`` vectors and 32 MB, so a task's memory is bounded, and every interval is sent once for each partner.

The axes come from a bounded sample and decide only what can be skipped, never what links. Equal vectors are compared once and counted
by weight. A comparison returns, for each vector with links, their number and a root that it is connected with: pairs are never
emitted, links are counted where they are found, and connectivity is kept whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, hashed_sample, partitions, salted_left_join, task
from .components import connected_components

BLOCK, INTERVAL, AXES, BOXED, FAN, SAMPLE = 256, 65_536, 8, 16, 4, 20_000
#: Bytes of an interval, and bits of an interval's number inside its range partition.
_BYTES, _INSIDE = 32 << 20, 16
#: Blocks of either side that one matrix product compares.
_LEAF = 4


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, key, vec, dim): the packed vector (as 4-byte floats where they hold it exactly) and its digest; null where the vector can't link."""
    for b in batches:
        keys, vecs, dims = [], [], []
        for v in b.column(1):
            x = None
            if v.is_valid and v.values.null_count == 0 and len(v.values):
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
                if not np.isfinite(x).all() or not x.any():
                    x = None
            if x is None:
                vecs.append(None)
            else:
                with np.errstate(over="ignore"):
                    short = x.astype(np.float32)
                vecs.append(short.tobytes() if (short == x).all() else x.tobytes())
            keys.append(None if x is None else hashlib.md5(x.tobytes()).digest())
            dims.append(None if x is None else len(x))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), pa.array(vecs, pa.binary()), pa.array(dims, pa.int32())], names=["vec_id", "key", "vec", "dim"])


def _unpacked(raw: list[bytes], dim: int) -> np.ndarray:
    out = np.empty((len(raw), dim))
    for row, r in zip(out, raw):
        row[:] = np.frombuffer(r, np.float32 if len(r) == 4 * dim else np.float64)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares can neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def principal_axes(sample: np.ndarray, axes: int) -> np.ndarray:
    """Directions of greatest second moment, greatest first (columns). Without a sample, the first coordinates."""
    d = sample.shape[1]
    if not len(sample):
        return np.eye(d)[:, :axes]
    _, v = np.linalg.eigh(sample.T @ sample)
    return v[:, ::-1][:, :axes]


def coordinates(unit: np.ndarray, axes: np.ndarray, boxed: int) -> np.ndarray:
    """Box coordinates: on the axes (zeros where there are fewer than ``boxed``), and the length of the rest. They never lie further apart than the vectors."""
    p = unit @ axes
    rest = np.sqrt(np.maximum(0.0, 1 - (p * p).sum(axis=1, keepdims=True)))
    return np.concatenate([p, np.zeros((len(p), boxed - p.shape[1])), rest], axis=1)


class _Axes:
    """Axes by dimension; a dimension that isn't in the sample has its first coordinates."""

    def __init__(self, known: dict[int, np.ndarray], boxed: int) -> None:
        self.known, self.boxed = known, boxed

    def coordinates(self, unit: np.ndarray) -> np.ndarray:
        d = unit.shape[1]
        axes = self.known.get(d)
        return coordinates(unit, np.eye(d)[:, : self.boxed] if axes is None else axes, self.boxed)


def _cells(axes: _Axes, eps: float, grid: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, raw = b.column(3).to_numpy(), b.column(1).to_pylist()
            cells = np.zeros((b.num_rows, grid), np.int32)
            for d in np.unique(dims):
                own = np.flatnonzero(dims == d)
                cells[own] = np.floor(axes.coordinates(_unit(_unpacked([raw[i] for i in own], int(d))))[:, :grid] / eps)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(cells), pa.list_(pa.int32()))], names=["rep", "vec", "weight", "dim", "cell"])

    return run


#: Vectors of different dimensions lie this far apart for each unit on a coordinate of their own.
_APART = 10.0


def _blocks(axes: _Axes, size: int) -> Callable:
    """Blocks of the sorted rows of a partition, of one dimension each, numbered by interval: partition, then the part of it that ``INTERVAL`` and ``_BYTES`` allow."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, interval, held, used, room, seq = TaskContext.get().partitionId(), -1, [], 0, 0, 0
        before = None

        def emit(rows: list) -> pa.RecordBatch:
            nonlocal interval, used, before, room, seq
            d = rows[0][3]
            if d != before or used + len(rows) > room:
                interval, used, before, room = interval + 1, 0, d, max(size, min(INTERVAL, _BYTES // (8 * d)))
            used, seq = used + len(rows), seq + 1
            x = _unpacked([r[1] for r in rows], d)
            p = np.concatenate([np.full((len(x), 1), _APART * d), axes.coordinates(_unit(x))], axis=1)
            short = all(len(r[1]) == 4 * d for r in rows)
            cols = [pa.array([part << _INSIDE | interval]), pa.array([seq]), pa.array([d], pa.int32()), *(pa.array([np.array([r[i] for r in rows], np.int64).tobytes()], pa.binary()) for i in (0, 2))]
            cols.append(pa.array([x.astype(np.float32).tobytes() if short else x.tobytes()], pa.binary()))
            return pa.RecordBatch.from_arrays([*cols, pa.array([p.min(axis=0)]), pa.array([p.max(axis=0)])], names=["node", "seq", "dim", "ids", "weights", "vecs", "lo", "hi"])

        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(4))):
                if held and (len(held) == size or held[0][3] != row[3]):
                    yield emit(held)
                    held = []
                held.append(row)
        if held:
            yield emit(held)

    return run


def _gap(a: str, b: str) -> Column:
    """Squared distance of the boxes whose columns have the prefixes a and b."""
    less = lambda x, y: F.zip_with(x, y, lambda u, v: u - v)
    apart = F.zip_with(less(f"{a}lo", f"{b}hi"), less(f"{b}lo", f"{a}hi"), lambda u, v: F.greatest(u, v, F.lit(0.0)))
    return F.aggregate(apart, F.lit(0.0), lambda total, x: total + x * x)


def _near_intervals(blocks: DataFrame, coords: int, limit: float, parts: int) -> DataFrame:
    """(a, b, boxes of both), a <= b: pairs of intervals whose boxes are near, found level by level: a level above the intervals are range partitions, each
    further level has ``2**FAN`` nodes of the one below."""
    box = [F.array(*[f(F.col(n)[i]) for i in range(coords)]).alias(n) for n, f in (("lo", F.min), ("hi", F.max))]
    shifts = [0, _INSIDE]
    while parts > 1 << (shifts[-1] - _INSIDE):
        shifts.append(shifts[-1] + FAN)
    nodes = durable(blocks.groupBy("node").agg(*box))
    levels = [nodes.withColumn("node", F.shiftright("node", s)).groupBy("node").agg(*box) for s in shifts]
    pairs = levels[-1].select(F.col("node").alias("a"), F.col("node").alias("b"))
    for below, (s, up) in zip(reversed(levels[:-1]), reversed(list(zip(shifts, shifts[1:])))):
        children = below.withColumn("parent", F.shiftright("node", up - s))
        left, right = (children.select(F.col("parent").alias(f"{c}p"), F.col("node").alias(c + "n"), F.col("lo").alias(c + "lo"), F.col("hi").alias(c + "hi")) for c in ("a", "b"))
        pairs = pairs.join(left, F.col("a") == F.col("ap")).join(right, F.col("b") == F.col("bp")).filter((F.col("an") <= F.col("bn")) & (_gap("a", "b") <= limit))
        pairs = pairs.select(F.col("an").alias("a"), F.col("bn").alias("b"), *([] if s else ["alo", "ahi", "blo", "bhi"]))
    return pairs


def linked(x: np.ndarray, y: np.ndarray | None, threshold: float, slab: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) of rows of unit matrices with inner product >= threshold; with y None, pairs i < j inside x."""
    z = x if y is None else y
    x4, z4 = x.astype(np.float32), z.astype(np.float32)
    out = [[], []]
    for lo in range(0, len(x), slab):
        i, j = np.nonzero(x4[lo : lo + slab] @ z4.T >= np.float32(threshold - 1e-5))
        i += lo
        if y is None:
            i, j = i[i < j], j[i < j]
        for at in range(0, len(i), 1 << 16):
            a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            sure = np.einsum("ij,ij->i", x[a], z[b]) >= threshold
            out[0].append(a[sure])
            out[1].append(b[sure])
    return (np.concatenate(o) if o else np.empty(0, np.int64) for o in out)


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest node reachable from each of n nodes."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def near_ranges(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray] | None, limit: float, leaf: int = _LEAF) -> Iterator[tuple[int, int, int, int]]:
    """Ranges (i0, i1, j0, j1) of two sequences of boxes (lo, hi) that may hold near pairs, by recursion over halves; with b None, of one sequence with itself (i0 <= j0)."""

    def far(i0: int, i1: int, j0: int, j1: int) -> bool:
        (alo, ahi), (blo, bhi) = a, b or a
        gap = np.maximum(0.0, np.maximum(alo[i0:i1].min(axis=0) - bhi[j0:j1].max(axis=0), blo[j0:j1].min(axis=0) - ahi[i0:i1].max(axis=0)))
        return float((gap * gap).sum()) > limit

    stack = [(0, len(a[0]), 0, len((b or a)[0]))]
    while stack:
        i0, i1, j0, j1 = stack.pop()
        if i0 == i1 or j0 == j1 or far(i0, i1, j0, j1):
            continue
        if max(i1 - i0, j1 - j0) <= leaf:
            yield i0, i1, j0, j1
        elif b is None and i0 == j0:
            half = (i0 + i1) // 2
            stack += [(i0, half, i0, half), (i0, half, half, i1), (half, i1, half, i1)]
        elif i1 - i0 >= j1 - j0:
            half = (i0 + i1) // 2
            stack += [(i0, half, j0, j1), (half, i1, j0, j1)]
        else:
            half = (j0 + j1) // 2
            stack += [(i0, i1, j0, half), (i0, i1, half, j1)]


class _Side:
    """The blocks of one interval that a task has."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def close(self, dim: int) -> None:
        read = lambda i, t: [np.frombuffer(r[i], dtype=t) for r in self.rows]
        ids, weights = read(0, np.int64), read(1, np.int64)
        self.ids, self.weights = np.concatenate(ids), np.concatenate(weights)
        self.ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
        self.unit = _unit(np.concatenate([_unpacked([v[i : i + w] for i in range(0, len(v), w)], dim) for v, w in ((r[2], len(r[2]) // len(n)) for r, n in zip(self.rows, ids))]))
        self.box = tuple(np.array([r[i] for r in self.rows]) for i in (3, 4))


def _links(a: _Side, b: _Side | None, threshold: float, limit: float) -> Iterator[pa.RecordBatch]:
    z = b or a
    for i0, i1, j0, j1 in near_ranges(a.box, b.box if b else None, limit):
        i0, i1, j0, j1 = a.ends[i0], a.ends[i1], z.ends[j0], z.ends[j1]
        ids, weights = a.ids[i0:i1], a.weights[i0:i1]
        if b is None and i0 == j0:
            i, j = linked(a.unit[i0:i1], None, threshold)
        else:
            i, j = linked(a.unit[i0:i1], z.unit[j0:j1], threshold)
            j = j + len(ids)
            ids, weights = np.concatenate([ids, z.ids[j0:j1]]), np.concatenate([weights, z.weights[j0:j1]])
        if len(i):
            n = np.bincount(i, weights[j], len(ids)) + np.bincount(j, weights[i], len(ids))
            # Roots are smallest identifiers: number the nodes in their order.
            order = np.argsort(ids, kind="stable")
            place = np.empty(len(ids), np.int64)
            place[order] = np.arange(len(ids))
            root = ids[order[roots(place[i], place[j], len(ids))[place]]]
            hit = n > 0
            yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(root[hit]), pa.array(n[hit].astype(np.int64))], names=["rep", "root", "n"])


def _join_intervals(threshold: float, limit: float) -> Callable:
    """Rows sorted by pair of intervals: the links of each pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, dim, sides = None, 0, (_Side(), _Side())

        def work() -> Iterator[pa.RecordBatch]:
            held = [s for s in sides if s.rows]
            if held and (len(held) == 2 or pair[0] == pair[1]):
                for s in held:
                    s.close(dim)
                yield from _links(held[0], held[1] if len(held) == 2 else None, threshold, limit)

        for batch in batches:
            c = {n: x.to_pylist() for n, x in zip(batch.schema.names, batch.columns)}
            for r in range(batch.num_rows):
                if (c["a"][r], c["b"][r]) != pair:
                    yield from work()
                    pair, dim, sides = (c["a"][r], c["b"][r]), c["dim"][r], (_Side(), _Side())
                sides[c["side"][r]].rows.append(tuple(c[n][r] for n in ("ids", "weights", "vecs", "lo", "hi")))
        if pair:
            yield from work()

    return run


def embedding_links(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95, block: int = BLOCK, axes: int = AXES, sample: int = SAMPLE, interval: int = INTERVAL) -> DataFrame:
    """One row for each row of ``vectors``: vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do those with a null identifier; each is a component
    of its own. Vectors of different dimensions don't link. Identifiers are numbers (cast to long). Rows that repeat an identifier with the same vector count once.
    An empty table gives an empty result. Other columns, labels included, are ignored.
    """
    spark = vectors.sparkSession
    eps = max(1e-6, float(np.sqrt(max(0.0, 2 - 2 * threshold))))
    rows = durable(vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vec_col}`").cast("array<double>").alias("v")).mapInArrow(task(_clean), "vec_id long, key binary, vec binary, dim int"))
    members = rows.filter("vec_id is not null and key is not null")
    distinct = members.groupBy("key").agg(F.min("vec_id").alias("rep"), F.countDistinct("vec_id").alias("weight"), F.min("vec").alias("vec"), F.first("dim").alias("dim"))
    distinct = durable(distinct.select("rep", "vec", "weight", "dim", "key"))
    total = distinct.count()
    few = hashed_sample(distinct.select("key", "vec", "dim"), "key", sample).toPandas()
    boxed = max(BOXED, axes)
    known = {int(d): principal_axes(_unit(_unpacked([bytes(x) for x in g["vec"]], int(d))), boxed) for d, g in few.groupby("dim")}
    by = _Axes(known, boxed)
    # Pairs of intervals are the tasks: as many intervals as give about one pair for each shuffle partition, more if intervals would grow too large.
    parts = max(-(-total // interval), min(int(np.ceil(np.sqrt(2 * partitions(spark)))), -(-total // (4 * block))), 1)
    coords, limit = boxed + 2, eps * eps + 1e-9
    celled = distinct.select("rep", "vec", "weight", "dim").mapInArrow(task(_cells(by, eps, axes)), "rep long, vec binary, weight long, dim int, cell array<int>")
    blocks = durable(celled.repartitionByRange(parts, "dim", "cell", "rep").sortWithinPartitions("dim", "cell", "rep").mapInArrow(task(_blocks(by, block)), "node long, seq long, dim int, ids binary, weights binary, vecs binary, lo array<double>, hi array<double>"))
    pairs = durable(_near_intervals(blocks, coords, limit, parts))
    # A pair asks for the blocks of either interval that are near the other's box.
    asked = [pairs.select("a", "b", F.lit(s).alias("side"), F.col(own).alias("want"), F.col(other + "lo").alias("plo"), F.col(other + "hi").alias("phi")) for s, own, other in ((0, "a", "b"), (1, "b", "a"))]
    asked = asked[0].unionByName(asked[1].filter("a <> b"))
    x, y = F.shiftright("a", _INSIDE), F.shiftright("b", _INSIDE)
    place = F.floor(y * (y + 1) / 2) + x + F.col("a") % (1 << _INSIDE) + F.col("b") % (1 << _INSIDE)
    tasks = max(1, min(parts * (parts + 1) // 2, 8 * partitions(spark)))
    sent = asked.join(blocks, F.col("want") == F.col("node")).filter(_gap("", "p") <= limit).select("a", "b", "side", "seq", "dim", "ids", "weights", "vecs", "lo", "hi")
    sent = sent.repartitionById(tasks, F.pmod(place, F.lit(tasks)).cast("int")).sortWithinPartitions("a", "b", "side", "seq")
    found = durable(sent.mapInArrow(task(_join_intervals(threshold, limit)), "rep long, root long, n long"))
    n = found.groupBy("rep").agg(F.sum("n").alias("n"))
    comps = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    named = distinct.select("rep", "key", "weight").join(n, "rep", "left").join(comps, F.col("rep") == F.col("node"), "left")
    named = named.select("key", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    keyed = rows.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("key")).alias("key"))
    out = salted_left_join(keyed, named, "key", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id").isNull() | (F.col("vec_id") == F.col("component_id")))
