"""Near-duplicate documents by SimHash and random bit sampling.

1. A document is the set of its five-word shingles (words lowered and stripped of the characters that aren't letters or
   digits; a shorter document is one shingle). Documents with the same set are one class from the start, so copies are never compared.
2. One document of each class gets a 256-bit fingerprint: bit j is the sign of the sum over its shingles of their
   j-th hash bits as +1 and -1. Fingerprints differ in about 256 * angle / pi bits.
3. Each of several tables samples coordinates at random; documents that agree in a table's base coordinates share a bucket. Their number grows with the
   logarithm of the table, so that an even bucket stays small, and the number of tables with it, so that a pair of similarity ``threshold`` shares a
   bucket with probability ``RECALL`` at any size (``plan_tables``).
4. Candidates are pairs within ``max_distance`` bits, found in two passes. In the first, an oversized bucket is capped with additional bits, and a row
   gives at most two pairs: dense groups become connected without their square. The second is the exact way for the rest: whole buckets, however
   large, in blocks, all pairs of rows that have partners and that the first pass left unconnected.
5. A candidate's distance is verified: the exact Jaccard similarity of the shingle sets, which must be ``threshold`` or more. Where a bucket still has very many
   candidates (texts that share most of a template but not enough), its rows are verified in blocks of sets by matrix products instead of pair by pair.
6. Links make classes (connected components); the smallest identifier of a class stays.

``max_distance`` is 4 standard deviations above the expectation at the threshold, so it costs hardly a link.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, fresh, kept, one_blas_thread, salted_left_join, share_below, task
from .components import connected_components

WORDS, BITS, SAMPLED, THRESHOLD = 5, 256, 64, 0.8
#: Least base bits, rows of an even bucket at most, and the recall at the threshold that the number of tables keeps.
BASE_BITS, PER_BUCKET, RECALL = 12, 4096, 0.99
#: Rows of a bucket that are compared at once; groups up to ``SMALL`` are compared many at a time; oversized buckets that the driver lists.
HELD, SMALL, MOST_LARGE = 16_384, 128, 200_000
#: Pairs a row beyond which a bucket counts as dense.
FEW = 16
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], dtype=np.uint64)
_WORD_CACHE = 200_000
_strip = re.compile(r"[\W_]+")


def words_of(text: str | None) -> list[str]:
    """The words that shingles are made of."""
    if not text:
        return []
    return [x for x in _strip.split(text.lower()) if x]


def _mix(x: np.ndarray, m: np.uint64) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * m
    x ^= x >> np.uint64(29)
    x = x * _MIX[1]
    return x ^ (x >> np.uint64(32))


class Shingler:
    def __init__(self) -> None:
        self.cache: dict[str, int] = {}

    def hashes(self, text: str | None, width: int = WORDS) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the shingles of a text; empty without words."""
        words = words_of(text)
        if not words:
            return np.empty(0, dtype=np.uint64)
        get, known = self.cache.get, self.cache
        try:
            h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        except KeyError:
            if len(known) > _WORD_CACHE:
                known.clear()
            for w in set(words).difference(known):
                known[w] = xxhash.xxh64_intdigest(w)
            h = np.fromiter(map(get, words), dtype=np.uint64, count=len(words))
        n = max(1, len(h) - width + 1)
        out = np.zeros(n, dtype=np.uint64)
        for j in range(min(width, len(h))):
            out = _mix(out + h[j : j + n], _MIX[j % 4])
        return np.unique(out)


def shingler() -> Shingler:
    return kept(("shingler",), Shingler)


_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float32)


def fingerprint(shingles: np.ndarray, bits: int = BITS) -> bytes:
    """SimHash of a set of hashes; a tie counts as one."""
    out = []
    for m in _MIX[: bits // 64]:
        raw = _mix(shingles, m).view(np.uint8).reshape(-1, 8)
        if len(raw) <= 512:
            ones = np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int64)
        else:
            ones = np.concatenate([np.bincount(raw[:, i], minlength=256) @ _BYTE_BITS for i in range(8)])
        out.append(np.packbits(2 * ones >= len(raw)).tobytes())
    return b"".join(out)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    s = shingler()
    for b in batches:
        sets, prints = [], []
        for text in b.column(1):
            x = s.hashes(text.as_py())
            sets.append(xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None)
            prints.append(fingerprint(x) if len(x) else None)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary()), pa.array(prints, pa.binary())], names=["doc_id", "shingle_set", "fp"])


def sampled_order(tables: int, sampled: int = SAMPLED, bits: int = BITS, seed: int = 7) -> np.ndarray:
    """Coordinates that each table samples, in order; a table's order is the same however many tables there are."""
    rng = np.random.default_rng(seed)
    return np.stack([rng.permutation(bits)[:sampled] for _ in range(tables)])


def recall(tables: int, base_bits: int, threshold: float = THRESHOLD, bits: int = BITS) -> float:
    """Probability that a pair of similarity ``threshold`` shares a bucket: the mean over its distance, which is binomial, of 1 - (1 - share) ** tables."""
    q = float(np.arccos(2 * threshold / (1 + threshold)) / np.pi)
    d = np.arange(bits + 1)
    logs = np.cumsum(np.r_[0.0, np.log(np.arange(1, bits + 1))])
    weight = np.exp(logs[bits] - logs[d] - logs[bits - d] + d * np.log(q) + (bits - d) * np.log(1 - q))
    share = np.prod([np.maximum(bits - d - i, 0) / (bits - i) for i in range(base_bits)], axis=0)
    return float((weight * (1 - (1 - share) ** tables)).sum())


def plan_tables(n: int, threshold: float = THRESHOLD, least: float = RECALL) -> tuple[int, int]:
    """(tables, base bits) for ``n`` fingerprints: enough bits that an even bucket has ``PER_BUCKET`` rows at most, enough tables that the recall stays."""
    bits = max(BASE_BITS, int(np.ceil(np.log2(max(1, n) / PER_BUCKET))))
    tables = 8
    while recall(tables, bits, threshold) < least:
        tables += 1
    return tables, bits


#: Bits of a group's number: bucket and part of a bucket.
_BUCKET, _PART = 28, 27


def _bits(fp: list[bytes]) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(fp), dtype=np.uint8).reshape(len(fp), BITS // 8), axis=1)


def _value(bits: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Numbers whose binary digits are the given columns (few enough for exact doubles)."""
    return (bits[:, columns] @ (1 << np.arange(len(columns) - 1, -1, -1)).astype(np.float64)).astype(np.int64)


def _numbers(fp: list[bytes], order: np.ndarray, base: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(table, its buckets as numbers that name the table too, all bits) for each table."""
    bits = _bits(fp)
    for t, o in enumerate(order):
        yield t, t << _BUCKET | _value(bits, o[:base]), bits


def _bucket_sizes(order: np.ndarray, base: int, by: bool, only: np.ndarray | None = None) -> Callable:
    """Rows (bucket, by, n): partial counts; ``by`` counts each value of the second column apart, ``only`` leaves other buckets out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def counts() -> pa.RecordBatch:
            x = np.concatenate(held) if held else np.empty((0, 2), np.int64)
            held.clear()
            if not by:
                keys, n = np.unique(x[:, 0], return_counts=True)
                keys = np.stack([keys, np.zeros_like(keys)], axis=1)
            else:
                keys, n = np.unique(x, axis=0, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(n)], names=["bucket", "by", "n"])

        for b in batches:
            if b.num_rows:
                value = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
                for _, x, _ in _numbers(b.column(0).to_pylist(), order, base):
                    keep = np.isin(x, only) if only is not None else slice(None)
                    held.append(np.stack([x[keep], value[keep]], axis=1))
                if sum(map(len, held)) > 1 << 21:
                    yield counts()
        yield counts()

    return run


def oversized(rows: DataFrame, n: int, order: np.ndarray, base: int, held: int) -> dict[int, int]:
    """Buckets of more than ``held`` rows and their sizes, the largest ``MOST_LARGE`` at most. Above a million fingerprints sizes are estimated from one in
    256 or more; a bucket that isn't listed is only held in larger portions, so neither bound costs a pair."""
    share = max(1 / 256, min(1.0, (1 << 20) / max(1, n)))
    some = rows if share == 1 else rows.filter(share_below(F.xxhash64("rep"), F.lit(share)))
    sizes = some.select("fp", F.lit(0).cast("long").alias("by")).mapInArrow(task(_bucket_sizes(order, base, False)), "bucket long, by long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    return {r.bucket: int(r.n / share) for r in sizes.filter(F.col("n") > held * share).orderBy(F.desc("n"), "bucket").limit(MOST_LARGE).collect()}


def _sorted_map(large: dict[int, tuple]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.array(sorted(large), dtype=np.int64)
    return keys, np.array([large[k] for k in keys.tolist()], dtype=np.int64)


def _look_up(x: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of x that are in the sorted keys, and where."""
    if not len(keys):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    rows = np.flatnonzero(keys[at] == x)
    return rows, at[rows]


def _first_tables(order: np.ndarray, base: int, large: dict[int, int], held: int) -> Callable:
    """Rows (rep, fp, grp, capped) for the first pass: oversized buckets are capped with the additional bits that their size calls for."""
    keys, more = _sorted_map({k: (min(_PART - 1, int(np.ceil(np.log2(2 * n / held)))),) for k, n in large.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            for t, x, bits in _numbers(b.column(1).to_pylist(), order, base):
                grp, capped = x << _PART, np.zeros(len(x), dtype=bool)
                rows, at = _look_up(x, keys)
                for e in np.unique(more[at, 0]) if len(rows) else ():
                    own = rows[more[at, 0] == e]
                    grp[own] |= 1 + _value(bits[own], order[t][base : base + e])
                    capped[own] = True
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(grp), pa.array(capped)], names=["rep", "fp", "grp", "capped"])

    return run


def _second_tables(order: np.ndarray, base: int, large: dict[int, tuple[int, int, int]]) -> Callable:
    """Rows (rep, fp, comp, grp, side) for the second pass. ``large`` gives an oversized bucket's largest component, its blocks and the blocks of the other rows.

    The rows of the largest component needn't meet each other: a block of them meets each block of the others (side 0 and 1). Of the others each pair of blocks
    meets (side: the block). The part of a group's number says which: 0 a whole bucket, odd numbers pairs in which only rows of different sides are compared, other even ones a block with itself.
    """
    keys, plan = _sorted_map(large)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            rep, comp = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 2))
            salt = _mix(rep.view(np.uint64), _MIX[2])
            for _, x, _ in _numbers(b.column(1).to_pylist(), order, base):
                rows, at = _look_up(x, keys)
                plain = np.ones(len(x), dtype=bool)
                plain[rows] = False
                index, grp, side = [np.flatnonzero(plain)], [x[plain] << _PART], [np.zeros(int(plain.sum()), np.int64)]
                for i, (top, g, o) in zip(rows.tolist(), plan[at].tolist()):
                    here, main = int(x[i]) << _PART, comp[i] == top
                    s = int(salt[i] % np.uint64(g if main else o))
                    # Numbers: 1 + 2 (s o + block) for the largest component with the others, 1 + 2 (g o + pair) for two blocks of the others.
                    parts = [(1 + 2 * (s * o + k), 0) for k in range(o)] if main else [(1 + 2 * (k * o + s), 1) for k in range(g)] + [((1 if k != s else 2) + 2 * (g * o + min(s, k) * o + max(s, k)), s) for k in range(o)]
                    index.append(np.full(len(parts), i))
                    grp.append(np.array([here | n for n, _ in parts], np.int64))
                    side.append(np.array([n for _, n in parts], np.int64))
                at_ = np.concatenate(index)
                take = pa.array(at_)
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), b.column(2).take(take), pa.array(np.concatenate(grp)), pa.array(np.concatenate(side))], names=["rep", "fp", "comp", "grp", "side"])

    return run


def max_distance(threshold: float = THRESHOLD, bits: int = BITS, sd: float = 4.0) -> int:
    p = float(np.arccos(2 * threshold / (1 + threshold)) / np.pi)
    return int(np.ceil(bits * p + sd * np.sqrt(bits * p * (1 - p))))


def near_pairs(fp: np.ndarray, limit: int, block: int = 1024, apart: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j of fingerprints within ``limit`` bits, block by block. ``apart`` are sorted labels: rows of one label aren't compared."""
    words = fp.view(np.uint64).reshape(len(fp), -1)
    for i in range(0, len(words), block):
        for j in range(i, len(words), block):
            if apart is not None and apart[i] == apart[min(j + block, len(words)) - 1]:
                continue  # all rows of both blocks have one label
            d = np.zeros((len(words[i : i + block]), len(words[j : j + block])), dtype=np.uint16)
            for w in range(words.shape[1]):
                d += np.bitwise_count(words[i : i + block, None, w] ^ words[None, j : j + block, w])
            a, b = np.nonzero(d <= limit)
            a, b = a + i, b + j
            keep = a < b if apart is None else (a < b) & (apart[a] != apart[b])
            yield a[keep], b[keep]


def _in_small(fp: np.ndarray, ends: np.ndarray, limit: int, apart: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The same for many small groups at once; ends[i] is where the group of row i ends."""
    at, out = np.arange(len(fp)), [(np.empty(0, np.int64), np.empty(0, np.int64))]
    d = 1
    while len(at):
        at = at[at + d < ends[at]]
        some = at if apart is None else at[apart[at] != apart[at + d]]
        near = some[np.bitwise_count(fp[some] ^ fp[some + d]).sum(axis=1, dtype=np.int32) <= limit]
        out.append((near, near + d))
        d += 1
    return tuple(np.concatenate(x) for x in zip(*out))


class _Groups:
    """Rows that arrive sorted by group: hands out whole groups, of an unlisted oversized one portions of ``cut`` rows (where that is given)."""

    def __init__(self, batches: Iterator[pa.RecordBatch], cut: int | None = None) -> None:
        self.batches, self.cut = batches, cut

    def __iter__(self) -> Iterator[tuple[list[np.ndarray], bool]]:
        """(columns, whole): whole groups, or a portion of one that was cut (its last portion too)."""
        held: list[list[np.ndarray]] = []
        broken = None  # the group that was cut last

        def close() -> tuple[list[np.ndarray], bool]:
            cols = [np.concatenate(x) for x in zip(*held)]
            held.clear()
            return cols, cols[at][0] != broken

        for b in self.batches:
            if not b.num_rows:
                continue
            cols = [b.column(0).to_numpy(zero_copy_only=False), np.frombuffer(b"".join(b.column(1).to_pylist()), dtype=np.uint64).reshape(b.num_rows, -1)]
            cols += [b.column(i).to_numpy(zero_copy_only=False) for i in range(2, b.num_columns)]
            at = b.schema.names.index("grp")
            if held and held[-1][at][-1] != cols[at][0]:
                yield close()
            change = np.flatnonzero(cols[at][1:] != cols[at][:-1]) + 1
            if len(change) and (held or cols[at][0] == broken):  # the first group goes on from before
                held.append([c[: change[0]] for c in cols])
                yield close()
                cols = [c[change[0] :] for c in cols]
                change = change[1:] - change[0]
            if len(change):
                yield [c[: change[-1]] for c in cols], True
                cols = [c[change[-1] :] for c in cols]
            held.append(cols)
            if self.cut and sum(len(x[0]) for x in held) >= self.cut:
                broken = cols[at][0]
                yield close()
        if held:
            yield close()


def _cuts(grp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cuts = np.flatnonzero(np.r_[True, grp[1:] != grp[:-1], True])
    return cuts, np.diff(cuts)


def _first_pairs(limit: int, held: int, small: int = SMALL) -> Callable:
    """For each row its first partner within ``limit`` bits among the rows before it in its group and among those after it: two pairs a row at most, which hold every row that
    has a partner. A row of a capped bucket, which may have partners elsewhere in it, also gives the pair (rep, rep)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (ids, fp, grp, capped), whole in _Groups(batches, held):
            cuts, sizes = _cuts(grp)
            little = np.repeat(sizes <= small, sizes)
            before, after = np.full(len(ids), -1), np.full(len(ids), -1)

            def note(a: np.ndarray, b: np.ndarray) -> None:
                o = np.lexsort((a, b))
                rows, first = np.unique(b[o], return_index=True)
                seen = before[rows]
                before[rows] = np.where((seen < 0) | (a[o][first] < seen), a[o][first], seen)
                o = np.lexsort((b, a))
                rows, first = np.unique(a[o], return_index=True)
                seen = after[rows]
                after[rows] = np.where((seen < 0) | (b[o][first] < seen), b[o][first], seen)

            own = np.flatnonzero(little)
            if len(own):
                a, b = _in_small(fp[own], np.repeat(np.cumsum(sizes[sizes <= small]), sizes[sizes <= small]), limit, None)
                note(own[a], own[b])
            for i, j in zip(cuts[:-1][sizes > small].tolist(), cuts[1:][sizes > small].tolist()):
                for a, b in near_pairs(np.ascontiguousarray(fp[i:j]), limit):
                    note(a + i, b + i)
            b, a = np.flatnonzero(before >= 0), np.flatnonzero(after >= 0)
            alone = np.flatnonzero(capped | (not whole))
            yield _pairs([(ids[before[b]], ids[b]), (ids[a], ids[after[a]]), (ids[alone], ids[alone])])

    return run


def _cross_pairs(limit: int, small: int = SMALL, few: int = FEW) -> Callable:
    """Every pair within ``limit`` bits of a group's rows of different components, as rows (a, b, dense).

    A group that has more than ``few`` such pairs a row is dense: it gives the rows of its pairs, each with the first of them (dense), instead of the pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (ids, fp, comp, grp, side), _ in _Groups(batches):
            cuts, sizes = _cuts(grp)
            across = (grp[cuts[:-1]] & ((1 << _PART) - 1)) % 2 == 1
            little = (sizes <= small) & ~across
            own = np.flatnonzero(np.repeat(little, sizes))
            if len(own):
                a, b = _in_small(fp[own], np.repeat(np.cumsum(sizes[little]), sizes[little]), limit, comp[own])
                yield _pairs([(ids[own[a]], ids[own[b]])], False)
            for i, j, two in zip(cuts[:-1][~little].tolist(), cuts[1:][~little].tolist(), across[~little].tolist()):
                o = i + np.argsort(comp[i:j], kind="stable")
                found, n, involved = [], 0, np.zeros(j - i, dtype=bool)
                for a, b in near_pairs(np.ascontiguousarray(fp[o]), limit, apart=comp[o]):
                    if two:
                        keep = side[o[a]] != side[o[b]]
                        a, b = a[keep], b[keep]
                    involved[a] = involved[b] = True
                    n += len(a)
                    if n <= few * (j - i):
                        found.append((ids[o[a]], ids[o[b]]))
                if n > few * (j - i):
                    x = ids[o[involved]]
                    yield _pairs([(np.full(len(x), x.min()), x)], True)
                elif n:
                    yield _pairs(found, False)

    return run


def _pairs(out: list, dense: bool | None = None) -> pa.RecordBatch:
    """Distinct pairs (smaller, larger)."""
    x, y = (np.concatenate([o[i] for o in out]) for i in (0, 1))
    both = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
    more = [] if dense is None else [pa.array(np.full(len(both), dense))]
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), *more], names=["a", "b", "dense"][: 2 + len(more)])


def _verify(threshold: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, sims = [], []
            for x, y in zip(b.column(2), b.column(3)):
                p, q = (np.frombuffer(v.as_py(), dtype=np.uint64) for v in (x, y))
                both = len(np.intersect1d(p, q, assume_unique=True))
                sim = both / (len(p) + len(q) - both)
                keep.append(sim >= threshold)
                sims.append(sim)
            m = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(m), b.column(1).filter(m), pa.array(sims, pa.float64()).filter(m)], names=["a", "b", "jaccard"])

    return run


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    s = shingler()
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.hashes(t.as_py()).tobytes() for t in b.column(1)], pa.binary())], names=["rep", "shingles"])


def _verified(sets: DataFrame, candidates: DataFrame, threshold: float, hub: int = 1024) -> DataFrame:
    """(a, b, jaccard) of the candidates whose shingle sets are similar enough. A row with very many partners is salted: each ``hub`` of them have its set in a place of their own."""
    per = candidates.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / hub).alias("parts"))
    salted = durable(candidates.join(per, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("salt")))
    left = salted.select("a", "salt").distinct().join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa")), "a")
    met = salted.join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb")), "b").join(left, ["a", "salt"])
    return durable(met.select("a", "b", "sa", "sb").mapInArrow(task(_verify(threshold)), "a long, b long, jaccard double"))


def _similar(x: list[np.ndarray], y: list[np.ndarray] | None, threshold: float, columns: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, jaccard) of all similar pairs of two lists of sets (or i < j of one), by matrix products over the hashes that two sets or more have."""
    every = x + (y or [])
    size = np.array([len(s) for s in every])
    values, at = np.unique(np.concatenate(every), return_inverse=True)
    row, n = np.repeat(np.arange(len(every)), size), np.bincount(at)
    shared = np.cumsum(n > 1) - 1
    keep = n[at] > 1
    row, at = row[keep], shared[at[keep]]
    o = np.argsort(at, kind="stable")
    row, at = row[o], at[o]
    both = np.zeros((len(x), len(y) if y else len(x)), np.float32)
    for lo in range(0, int(at[-1]) + 1 if len(at) else 0, columns):
        i, j = np.searchsorted(at, [lo, lo + columns])
        m = np.zeros((len(every), columns), np.float32)
        m[row[i:j], at[i:j] - lo] = 1
        both += m[: len(x)] @ (m[len(x) :] if y else m).T
    sim = both / (size[: len(x), None] + (size[len(x) :] if y else size)[None, :] - both)
    i, j = np.nonzero(sim >= threshold - 1e-6)
    if not y:
        i, j = i[i < j], j[i < j]
    inter, s, t = both[i, j].astype(np.float64), size[i], size[j + (len(x) if y else 0)]
    exact = inter / (s + t - inter)
    sure = exact >= threshold
    return i[sure], j[sure], exact[sure]


def _forest(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Which of the links connect what all of them connect, no more than there are nodes."""
    root: dict[int, int] = {}

    def find(v: int) -> int:
        while root.get(v, v) != v:
            root[v] = root.get(root[v], root[v])
            v = root[v]
        return v

    out = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = find(x), find(y)
        if x != y:
            root[y] = x
            out.append(k)
    return out


def _verify_block(threshold: float) -> Callable:
    """Two blocks of a dense cluster (or one with itself): links of rows of different components, a forest of them."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        one_blas_thread()
        rep, comp, own = (table.column(c).to_numpy() for c in ("rep", "comp", "own"))
        sets = [np.frombuffer(v.as_py(), dtype=np.uint64) for v in table.column("shingles")]
        _, i, j = (k.as_py() for k in key)
        left = np.flatnonzero(own == i)
        right = left if i == j else np.flatnonzero(own == j)
        a, b, sim = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        if len(left) and len(right):
            p, q, sim = _similar([sets[k] for k in left], None if i == j else [sets[k] for k in right], threshold)
            a, b = left[p], right[q]
            keep = comp[a] != comp[b]
            a, b, sim = a[keep], b[keep], sim[keep]
            keep = _forest(a, b)
            a, b, sim = a[keep], b[keep], sim[keep]
        x, y = rep[a], rep[b]
        return pa.table({"a": pa.array(np.minimum(x, y), pa.int64()), "b": pa.array(np.maximum(x, y), pa.int64()), "jaccard": pa.array(sim, pa.float64())})

    return run


def _verified_dense(sets: DataFrame, active: DataFrame, edges: DataFrame, threshold: float, block: int = 512) -> DataFrame:
    """(a, b, jaccard): links that connect the rows of dense clusters. A cluster's rows, however many, are compared in pairs of blocks of about ``block`` sets, so neither
    its pairs nor its whole content are ever in one place."""
    clusters = durable(connected_components(edges).withColumnRenamed("component", "cluster"))
    blocks = clusters.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    placed = salted_left_join(clusters, blocks, "cluster", "node").join(active.select("rep", "comp"), F.col("node") == F.col("rep")).drop("node")
    placed = placed.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).join(sets, "rep")
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "rep", "comp", "own", "shingles")
    return durable(placed.groupBy("cluster", "i", "j").applyInArrow(_verify_block(threshold), "a long, b long, jaccard double"))


def _largest_components(active: DataFrame, order: np.ndarray, base: int, large: dict[int, int], held: int) -> dict[int, tuple[int, int, int]]:
    """For each oversized bucket its largest component, and the numbers of blocks of that and of the other rows."""
    if not large:
        return {}
    only = np.array(sorted(large), dtype=np.int64)
    sizes = active.select("fp", "comp").mapInArrow(task(_bucket_sizes(order, base, True, only)), "bucket long, by long, n long").groupBy("bucket", "by").agg(F.sum("n").alias("n"))
    top = sizes.groupBy("bucket").agg(F.max_by("by", F.struct("n", "by")).alias("by"), F.max("n").alias("n"), F.sum("n").alias("total"))
    return {r.bucket: (r.by, max(1, -(-2 * r.n // held)), max(1, -(-2 * (r.total - r.n) // held))) for r in top.collect()}


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, held: int = HELD) -> tuple[DataFrame, DataFrame]:
    """(classes, links).

    classes: one row for each row of ``docs``: doc_id, class_id (smallest doc_id of its class), shingle_class (smallest doc_id with the same
    shingle set), kept (doc_id = class_id). links: pairs (a, b) of shingle classes with their Jaccard similarity that connect the classes; a pair whose ends others connect needn't be among them.

    Null and wordless texts link with nothing: each is its own class. Null identifiers can't be linked: their class is null and they
    are kept. ``held`` bounds the rows of a bucket that a task compares at once and changes no result but by the chance of the buckets. Identifiers are numbers (cast to long). Repeated rows share their class and each is returned. An identifier should name one text; of several, any stands for it. An empty table gives an empty result. Other columns are ignored.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    sketched = durable(rows.mapInArrow(task(_sketch), "doc_id long, shingle_set binary, fp binary"))
    reps = sketched.filter("shingle_set is not null and doc_id is not null").groupBy("shingle_set").agg(F.min("doc_id").alias("rep"), F.first("fp").alias("fp"))
    reps = durable(reps)
    n, limit = reps.count(), max_distance(threshold)
    tables, base = plan_tables(n, threshold)
    order = sampled_order(tables)
    # First pass: two partners a row and table at most, which name every row that has a partner. One partner of each row is verified and connects dense groups.
    tabled = reps.select("rep", "fp").mapInArrow(task(_first_tables(order, base, oversized(reps, n, order, base, held), held)), "rep long, fp binary, grp long, capped boolean")
    first = durable(tabled.repartition("grp").sortWithinPartitions("grp", "rep").mapInArrow(task(_first_pairs(limit, held)), "a long, b long").distinct())
    partners = first.select(F.col("a").alias("i")).unionByName(first.select(F.col("b").alias("i"))).distinct()
    # The texts are read again for the rows that have partners, once for all that follows.
    sets = durable(rows.join(partners, rows.doc_id == partners.i, "left_semi").dropDuplicates(["doc_id"]).mapInArrow(task(_shingle_sets), "rep long, shingles binary"))
    tested = durable(first.filter("a <> b").groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    links = _verified(sets, tested, threshold)
    comps = connected_components(links.select("a", "b"))
    # Second pass: all pairs of those rows that aren't connected yet, whole buckets.
    active = durable(reps.join(partners, reps.rep == partners.i, "left_semi").join(comps, F.col("rep") == F.col("node"), "left").select("rep", "fp", F.coalesce("component", "rep").alias("comp")))
    large = _largest_components(active, order, base, oversized(active, active.count(), order, base, held), held)
    tabled = active.mapInArrow(task(_second_tables(order, base, large)), "rep long, fp binary, comp long, grp long, side long")
    second = durable(tabled.repartition("grp").sortWithinPartitions("grp").mapInArrow(task(_cross_pairs(limit)), "a long, b long, dense boolean").distinct())
    sparse, dense = durable(second.filter("not dense").select("a", "b").join(tested, ["a", "b"], "left_anti")), second.filter("dense").select("a", "b")
    more = [_verified(sets, sparse, threshold)] if not sparse.isEmpty() else []
    more += [_verified_dense(sets, active, dense, threshold)] if not dense.isEmpty() else []
    for found in more:
        links = links.unionByName(found)
    if more:
        comps = connected_components(links.select("a", "b"))
    named = reps.join(comps, reps.rep == comps.node, "left").select("shingle_set", "rep", F.coalesce("component", "rep").alias("class_id"))
    classes = salted_left_join(sketched.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("shingle_set")).alias("shingle_set")), named, "shingle_set", "doc_id").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("rep", "doc_id").alias("shingle_class")
    )
    return classes.withColumn("kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("class_id"))), links


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one document of each class, columns unchanged; rows that repeat a kept identifier stay as they are."""
    (drop,) = fresh(docs, "near_dup_of")
    classes, _ = near_duplicates(docs, id_col, text_col)
    gone = classes.filter("not kept").select(F.col("doc_id").alias(drop)).distinct()
    return docs.join(gone, docs[f"`{id_col}`"] == gone[drop], "left_anti")
