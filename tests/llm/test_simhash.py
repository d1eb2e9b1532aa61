"""Candidate search of the near-dedup against brute force, with buckets that must be cut."""

import random

import numpy as np
import pyarrow as pa
import pytest

from framewright.llm import simhash as sh


def batches(names, columns, size):
    n = len(columns[0])
    col = lambda c: pa.array([x.tobytes() for x in c]) if getattr(c, "ndim", 1) == 2 else pa.array(c)
    return [pa.RecordBatch.from_arrays([col(c[i : i + size]) for c in columns], names=names) for i in range(0, n, size)]


def pairs(out):
    return {(a, b) for r in out for a, b in zip(r.column(0).to_pylist(), r.column(1).to_pylist())}


def rows(seed=5):
    """90 fingerprints in three groups; each has two near ones in its group."""
    r = np.random.default_rng(seed)
    fp = np.repeat(r.integers(0, 2**63, (30, 4)).astype(np.uint64), 3, axis=0)
    fp[:, 1] ^= np.tile(np.array([0, 1, 6], np.uint64), 30)
    return np.arange(90), fp, np.sort(np.arange(90) // 30) << sh._PART


def near(fp, i, j, limit=10):
    return np.bitwise_count(fp[i] ^ fp[j]).sum() <= limit


def test_near_pairs_in_blocks():
    _, fp, grp = rows()
    want = {(i, j) for i in range(90) for j in range(i + 1, 90) if near(fp, i, j)}
    assert {(int(x), int(y)) for a, b in sh.near_pairs(fp, 10, block=16) for x, y in zip(a, b)} == want and len(want) == 90
    label = np.sort(np.random.default_rng(0).integers(0, 4, 90))
    got = {(int(x), int(y)) for a, b in sh.near_pairs(fp, 10, block=7, apart=label) for x, y in zip(a, b)}
    assert got == {(i, j) for i, j in want if label[i] != label[j]}


@pytest.mark.parametrize("size", [1, 7, 30, 1000])
@pytest.mark.parametrize("small", [2, 128])
def test_streamed_groups(size, small):
    ids, fp, grp = rows()
    want = {(i, j) for i in range(90) for j in range(i + 1, 90) if grp[i] == grp[j] and near(fp, i, j)}
    first = pairs(sh._first_pairs(10, 1000, small)(iter(batches(["rep", "fp", "grp", "capped"], [ids, fp, grp, np.zeros(90, bool)], size))))
    # Two pairs a row at most; they connect what all pairs connect and name every row that has a partner.
    assert first <= want and {x for p in first for x in p} == {x for p in want for x in p}
    assert all((3 * k, 3 * k + 1) in first and (3 * k, 3 * k + 2) in first for k in range(30))
    comp = ids % 3 * 10
    cross = pairs(sh._cross_pairs(10, small)(iter(batches(["rep", "fp", "comp", "grp", "side"], [ids, fp, comp, grp, np.zeros(90, np.int64)], size))))
    assert cross == {(i, j) for i, j in want if comp[i] != comp[j]}
    dense = list(sh._cross_pairs(10, small, few=0)(iter(batches(["rep", "fp", "comp", "grp", "side"], [ids, fp, comp, grp, np.zeros(90, np.int64)], size))))
    assert small > 30 or (all(all(r.column(2).to_pylist()) for r in dense) and {x for p in pairs(dense) for x in p} == {x for p in cross for x in p})


@pytest.mark.parametrize("size", [1, 5, 7, 40, 100])
@pytest.mark.parametrize("cut", [8, 13, 50])
def test_cut_groups_name_all_their_rows(size, cut):
    """Portions of an oversized group between two small ones: every row of it is named for the second pass, the last portion's too; the small groups stay whole."""
    ids, fp, _ = rows()
    grp = np.repeat([1, 5, 9], [3, 84, 3])
    got = pairs(sh._first_pairs(10, cut)(iter(batches(["rep", "fp", "grp", "capped"], [ids, fp, grp, np.zeros(90, bool)], size))))
    assert {x for p in got for x in p} == set(range(90))
    assert not any(a == b for a, b in got if a < 3 or a > 86)
    portions = [(c[2][0], c[2][-1], len(c[0]), whole) for c, whole in sh._Groups(iter(batches(["rep", "fp", "grp", "capped"], [ids, fp, grp, np.zeros(90, bool)], size)), cut)]
    assert sum(n for *_, n, _ in portions) == 90 and all(a == b == 5 for a, b, _, whole in portions if not whole)


@pytest.mark.parametrize("blocks", [(1, 1), (3, 1), (1, 3), (4, 3)])
def test_blocks_of_an_oversized_bucket_meet_each_other(blocks):
    """Every pair of rows of different components meets in a group, whatever the blocks; rows of the largest component don't meet each other."""
    r = np.random.default_rng(2)
    ids, fp = np.arange(60), np.repeat(r.integers(0, 2**63, (1, 4)).astype(np.uint64), 60, axis=0)
    comp = np.where(ids < 40, 7, ids)
    order = sh.sampled_order(1)
    (_, bucket, _), = sh._numbers([fp[0].tobytes()], order, 12)
    large = {int(bucket[0]): (7, *blocks)}
    out = list(sh._second_tables(order, 12, large)(iter(batches(["rep", "fp", "comp"], [ids, fp, comp], 13))))
    table = pa.Table.from_batches(out).sort_by("grp")
    got = pairs(sh._cross_pairs(0)(iter(table.to_batches(max_chunksize=11))))
    assert got == {(i, j) for i in range(60) for j in range(i + 1, 60) if comp[i] != comp[j]}
    # A row of the largest component is sent once for each block of the others.
    assert sum(1 for x in table.column("rep").to_pylist() if x == 0) == blocks[1]


def test_plan_keeps_the_recall():
    assert sh.plan_tables(1000)[1] == sh.BASE_BITS
    for n in (10**4, 10**7, 10**9):
        tables, bits = sh.plan_tables(n)
        assert n / 2**bits <= sh.PER_BUCKET and sh.recall(tables, bits) >= sh.RECALL
    # The formula against fingerprints of sets at similarity 0.8.
    r, tables, hit = np.random.default_rng(4), 40, 0
    order = sh.sampled_order(tables)
    for _ in range(400):
        x = r.integers(0, 2**63, 900).astype(np.uint64)
        pair = [sh.fingerprint(np.sort(x[:810])), sh.fingerprint(np.sort(x[90:]))]  # 720 of 900 shared
        hit += any(b[0] == b[1] for _, b, _ in sh._numbers(pair, order, 12))
    assert hit / 400 > sh.recall(tables, 12) - 0.02


def brute(texts, threshold=0.8):
    s = sh.Shingler()
    sets = [set(s.hashes(t).tolist()) for t in texts]
    by, root = {}, list(range(len(texts)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for h in x:
            by.setdefault(h, []).append(i)
    seen = set()
    for own in by.values():
        for k, i in enumerate(own):
            for j in own[k + 1 :]:
                if (i, j) not in seen:
                    seen.add((i, j))
                    if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= threshold:
                        a, b = sorted((find(i), find(j)))
                        root[b] = a
    return {i: find(i) for i in range(len(texts))}


def boilerplate(n, seed, words=60, changes=4):
    r = random.Random(seed)
    base = [f"w{r.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randrange(changes + 1)):
            w[r.randrange(words)] = f"x{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_cut_buckets_lose_no_class(spark):
    """Buckets of at most 4 rows at once, on clusters that share buckets: the classes are those of brute force."""
    texts = [t for k in range(6) for t in boilerplate(40, k)] + boilerplate(60, 99, words=200, changes=30)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    want = brute(texts)
    for held in (4, 64, sh.HELD):
        classes, _ = sh.near_duplicates(docs, held=held)
        got = {r.doc_id: r.class_id for r in classes.collect()}
        wrong = sum(got[i] != want[i] for i in want)
        assert wrong <= 0.01 * len(texts), (held, wrong)


def test_similar_sets_by_products():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 60, 40).astype(np.uint64)) for _ in range(30)] + [np.array([7], np.uint64), np.array([10**12], np.uint64)]
    full = {(i, j): len(set(a) & set(b)) / len(set(a) | set(b)) for i, a in enumerate(sets) for j, b in enumerate(sets)}
    for threshold in (0.3, 0.45, 1.0):
        i, j, sim = sh._similar(sets, None, threshold, columns=7)
        assert dict(zip(zip(i.tolist(), j.tolist()), sim.tolist())) == {k: v for k, v in full.items() if k[0] < k[1] and v >= threshold}
        i, j, _ = sh._similar(sets[:10], sets[10:], threshold)
        assert set(zip(i.tolist(), (j + 10).tolist())) == {(i, j) for (i, j), v in full.items() if i < 10 <= j and v >= threshold}


def test_template_texts_against_brute_force(spark):
    """Texts of one template, most pairs of which are just not similar enough: dense buckets, verified in blocks."""
    texts = boilerplate(700, 5, words=80, changes=3)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    want = brute(texts)
    got = {r.doc_id: r.class_id for r in sh.near_duplicates(docs)[0].collect()}
    assert sum(got[i] != want[i] for i in want) <= 7


def test_a_dense_group_needs_few_links(spark):
    """20,000 texts of one template: 200 million pairs, most of them candidates, but the links that connect classes are few."""
    texts = boilerplate(20_000, 5, words=80, changes=2)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(8)
    classes, links = sh.near_duplicates(docs, held=4096)
    # A text with one change or none is similar to the unchanged one.
    unchanged = min(i for i, t in enumerate(texts) if "x" not in t)
    words = texts[unchanged].split()
    close = {i for i, t in enumerate(texts) if sum(a != b for a, b in zip(t.split(), words)) <= 1}
    got = {r.doc_id: r.class_id for r in classes.collect()}
    assert sum(got[i] == got[unchanged] for i in close) >= 0.999 * len(close) and len(close) > 5000
    assert links.count() <= 20 * len(texts)
