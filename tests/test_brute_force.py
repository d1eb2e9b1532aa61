"""Queries without SQL against slow versions that are written from the rules, on the small tables."""

import hashlib
import math

import numpy as np
import pytest

from framewright.functions import pixels as px
from framewright.operators import media
from framewright.plans.catalog import QUERIES
from framewright.plans.queries_media import images, wav_bytes
from framewright.plans.standins import frames, hashes

SF = "/root/testdata/sf0.001"


def picture(k, h=40, w=56):
    return [[[(k * 31 + ((y * w + x) * 3 + c) * 7) % 256 for c in range(3)] for x in range(w)] for y in range(h)]


def cubic(t, a):
    t = abs(t)
    if t < 1:
        return (a + 2) * t**3 - (a + 3) * t**2 + 1
    return a * t**3 - 5 * a * t**2 + 8 * a * t - 4 * a if t < 2 else 0.0


def shrink(line, size):
    """One line of bytes resampled with fixed-point weights of an antialiased cubic."""
    n, out = len(line), []
    scale = n / size
    wide = max(scale, 1)
    for i in range(size):
        mid = (i + 0.5) * scale
        lo, hi = max(0, int(mid - 2 * wide + 0.5)), min(n, int(mid + 2 * wide + 0.5))
        w = [cubic((j - mid + 0.5) / wide, -0.5) for j in range(lo, hi)]
        total = sum(w)
        fixed = [int(x / total * 2**22 + (0.5 if x >= 0 else -0.5)) for x in w]
        out.append(min(255, max(0, (sum(f * v for f, v in zip(fixed, line[lo:hi])) + 2**21) >> 22)))
    return out


def resize_bytes(img, width, height):
    rows = [list(zip(*[shrink([p[c] for p in row], width) for c in range(3)])) for row in img] if len(img[0]) != width else img
    if len(rows) == height:
        return rows
    cols = [[shrink([row[x][c] for row in rows], height) for c in range(3)] for x in range(width)]
    return [[[cols[x][c][y] for c in range(3)] for x in range(width)] for y in range(height)]


def lookup(line, at, size, mode):
    """Value of a line at target position ``at`` of ``size`` without antialiasing."""
    n = len(line)
    pos = (at + 0.5) * n / size - 0.5
    get = lambda i: line[min(n - 1, max(0, i))]
    if mode == "bilinear":
        pos = max(pos, 0)
        lo = int(pos)
        return get(lo) * (1 - pos + lo) + get(lo + 1) * (pos - lo)
    lo = math.floor(pos)
    return sum(cubic(pos - lo - k, -0.75) * get(lo + k) for k in (-1, 0, 1, 2))


def resized_crop(img, resize, cut, mode):
    top, left = int(0.5 * (resize[0] - cut[0])), int(0.5 * (resize[1] - cut[1]))
    out = np.zeros((3, *cut))
    for c in range(3):
        wide = [[lookup([p[c] / 255 for p in row], left + x, resize[1], mode) for x in range(cut[1])] for row in img]
        for x in range(cut[1]):
            column = [row[x] for row in wide]
            for y in range(cut[0]):
                out[c, y, x] = lookup(column, top + y, resize[0], mode)
    return out


def normalized(img, mean, std):
    return np.array([[[(v / 255 - m) / s for v, m, s in zip(p, mean, std)] for p in row] for row in img])


def patch_rows(pictures):
    """Rows of 14 x 14 patches over pairs of pictures, merged two by two, and the grid."""
    if len(pictures) % 2:
        pictures = [*pictures, pictures[-1]]
    h, w = len(pictures[0]) // 14, len(pictures[0][0]) // 14
    rows = []
    for t in range(0, len(pictures), 2):
        for by in range(0, h, 2):
            for bx in range(0, w, 2):
                for y in (by, by + 1):
                    for x in (bx, bx + 1):
                        rows.append([pictures[t + k][y * 14 + i][x * 14 + j][c] for c in range(3) for k in (0, 1) for i in range(14) for j in range(14)])
    return np.array(rows), [len(pictures) // 2, h, w]


def one(df, key, col):
    r = df.filter(f"p_partkey = {key}").select(col).first()[0]
    return media.tensor_array(r)


@pytest.fixture(scope="module")
def some(spark):
    return images(spark, SF).filter("p_partkey in (3, 77)").cache()


def test_resize(spark):
    got = {r.p_partkey: r for r in QUERIES["t2_resize"](spark, SF).filter("p_partkey in (3, 77)").collect()}
    for k in (3, 77):
        want = np.array(resize_bytes(picture(k), 84, 28), np.uint8)
        assert (got[k].height, got[k].width) == (28, 84) and got[k].digest == hashlib.sha256(want.tobytes()).hexdigest()


def test_resize_crop_and_the_fused_chain(spark, some):
    from pyspark.sql import functions as F

    t = media.to_tensor(F.col("image"))
    for k in (3, 77):
        cubic_ = one(some.select("p_partkey", media.resize_crop(t, (64, 64), (48, 48), "bicubic").alias("t")), k, "t")
        assert np.abs(cubic_[0] - resized_crop(picture(k), (64, 64), (48, 48), "bicubic")).max() < 1e-4
    fused = one(some.select("p_partkey", media.preprocess(F.col("image"), (64, 64), (48, 48), px.IMAGENET_MEAN, px.IMAGENET_STD).alias("t")), 3, "t")
    want = resized_crop(picture(3), (64, 64), (48, 48), "bilinear")
    want = (want - np.array(px.IMAGENET_MEAN)[:, None, None]) / np.array(px.IMAGENET_STD)[:, None, None]
    assert np.abs(fused[0] - want).max() < 1e-4
    # The registered query returns the digests of exactly these tensors.
    digest = {r.p_partkey: r.digest for r in QUERIES["t9_fused_pipeline"](spark, SF).filter("p_partkey = 3").collect()}
    assert digest[3] == hashlib.sha256(fused.tobytes()).hexdigest()


def test_patches_of_images_and_videos(spark, some):
    from pyspark.sql import functions as F

    h, w = (math.ceil(x * math.sqrt(3136 / 2240) / 28) * 28 for x in (40, 56))
    big = {k: normalized(resize_bytes(picture(k), w, h), px.CLIP_MEAN, px.CLIP_STD).tolist() for k in (3, 77)}
    rows, grid = patch_rows([big[3]])
    r = some.filter("p_partkey = 3").select(media.image_patches(F.col("image")).alias("p")).first().p
    assert list(r.grid) == grid and np.abs(media.tensor_array(r) - rows).max() < 1e-4
    # A video of three frames: two pairs, the last frame of an odd number twice.
    three = some.unionByName(some.filter("p_partkey = 3").withColumn("p_partkey", F.lit(90).cast("long"))).withColumn("video", F.lit("v"))
    out = media.video_patches(three, "video", "p_partkey", "image").orderBy("pair").collect()
    rows, grid = patch_rows([big[3], big[77], big[3]])
    assert [list(x.grid) for x in out] == [grid, grid]
    assert np.abs(np.concatenate([media.tensor_array(x) for x in out]) - rows).max() < 1e-4


def test_tiles(spark):
    from pyspark.sql import functions as F

    wide = images(spark, SF, 40, 80).filter("p_partkey = 5").select(media.tiles(F.col("image"), 32).alias("t")).first().t
    got, img = media.tensor_array(wide), picture(5, 40, 80)
    big = resize_bytes(img, 64, 32)
    want = [[row[:32] for row in big], [row[32:] for row in big], resize_bytes(img, 32, 32)]
    assert np.abs(got - np.stack([normalized(t, px.IMAGENET_MEAN, px.IMAGENET_STD).transpose(2, 0, 1) for t in want])).max() < 1e-4


def test_perceptual_hash(spark):
    got = {}
    for r in QUERIES["w2_perceptual_hash"](spark, SF).filter("p_partkey = 3").collect():
        got.update({64 * r.word + b: r.bits >> b & 1 for b in range(64)})
    gray = [[round(0.299 * p[0] + 0.587 * p[1] + 0.114 * p[2]) for p in row] for row in picture(3)]
    n = 128

    def area(line, size):
        out = []
        for i in range(size):
            lo, hi = i * len(line) / size, (i + 1) * len(line) / size
            parts = [(max(0, min(j + 1, hi) - max(j, lo)), v) for j, v in enumerate(line)]
            out.append(sum(w * v for w, v in parts) / sum(w for w, _ in parts))
        return out

    wide = [area(row, n) for row in gray]
    cols = [area([row[x] for row in wide], n) for x in range(n)]
    small = np.array([[float(np.rint(cols[x][y])) for x in range(n)] for y in range(n)])
    base = [[math.cos(math.pi * (2 * i + 1) * k / (2 * n)) * math.sqrt((1 if k == 0 else 2) / n) for i in range(n)] for k in range(16)]
    low = np.array([[sum(base[u][y] * (small[y] * np.array(base[v])).sum() for y in range(n)) for v in range(16)] for u in range(16)])
    want = (low > np.median(low)).ravel()
    # A value that equals the median but for rounding may fall either way.
    sure = np.abs(low.ravel() - np.median(low)) > 1e-6
    assert all(got[i] == want[i] for i in np.flatnonzero(sure))


def test_resampling_follows_the_band_limited_sum(spark):
    """A clip at 44.1 kHz read at 16 kHz against the sum over all samples of a windowed sinc at the source's rate."""
    from pyspark.sql import functions as F

    r = np.random.default_rng(0)
    t = np.arange(900) / 44100
    x = np.round(8000 * np.sin(2 * np.pi * 700 * t) + 4000 * np.sin(2 * np.pi * 3100 * t) + r.normal(0, 5, 900)).astype("<i2")
    df = spark.createDataFrame([(1, wav_bytes(x.tobytes(), 44100))], "k int, content binary").select(media.load_audio(F.col("content"), 16000).alias("a"))
    got = np.array(df.first().a.samples)
    assert len(got) == math.ceil(900 * 16000 / 44100)
    # Away from the ends the two tones, which lie below the new limit, are themselves at the new times.
    at = np.arange(len(got)) / 16000
    want = (8000 * np.sin(2 * np.pi * 700 * at) + 4000 * np.sin(2 * np.pi * 3100 * at)) / 32768
    mid = slice(90, len(got) - 90)
    assert np.abs(got[mid] - want[mid]).max() < 2e-3


# ---- keyframes: the rules one step at a time


def cos(a, b):
    a, b = a.astype(np.float32), b.astype(np.float32)
    return float(np.float32(a @ b) / max(np.float32(np.linalg.norm(a) * np.linalg.norm(b)), np.float32(1e-8)))


def edge(x, at, left, jump=0.015):
    """Boundary of a scene: blocks of ten outward, each read in ascending order behind the value that the block before left."""
    n, carried = len(x), 1.0
    if left:
        hi = at
        for _ in range(30):
            lo = max(0, hi - 10)
            if hi <= lo:
                return 0
            s = [carried, *[cos(x[at], x[i]) for i in range(lo, hi)]]
            hits = [lo + i for i in range(hi - lo) if abs(s[i + 1] - s[i]) > jump]
            if hits:
                return hits[-1]
            carried, hi = s[-1], hi - 10
        return 0
    lo = at + 1
    for _ in range(30):
        hi = min(n, lo + 10)
        if hi <= lo:
            return n - 1
        s = [carried, *[cos(x[at], x[i]) for i in range(lo, hi)]]
        hits = [lo + i for i in range(hi - lo) if abs(s[i + 1] - s[i]) > jump]
        if hits:
            return hits[0]
        carried, lo = s[1], lo + 10
    return n - 1


def scenes(q, x, budget, drop=0.025, jump=0.015):
    sims, free, out, floor, last = [cos(q, v) for v in x], set(range(len(x))), [], None, 0.0
    while len(out) < budget and free:
        at = max(free, key=lambda i: (sims[i], -i))
        if floor is None:
            floor = sims[at] - drop
        elif sims[at] < floor or sims[at] < last:
            break
        else:
            last = sims[at] - 0.01
        lo, hi = edge(x, at, True, jump), edge(x, at, False, jump)
        out.append((lo, at, hi))
        free -= set(range(lo, hi + 1))
    return out


def videos(spark):
    out = {}
    for r in frames(spark, SF).orderBy("video", "frame_idx").collect():
        out.setdefault(r.video, []).append((np.array(r.embedding, np.float32), r.score))
    q = next(np.array(r.embedding, np.float32) for r in frames(spark, SF).filter("vec_id = 0").collect())
    return {v: (np.stack([x for x, _ in rows]), [s for _, s in rows]) for v, rows in out.items()}, q


def collected(df, *cols):
    out = {}
    for r in df.collect():
        out.setdefault(r.video, []).append(tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]])
    return {v: sorted(x) for v, x in out.items()}


def test_scene_intervals(spark):
    data, q = videos(spark)
    got = collected(QUERIES["k2_k3_scene_intervals"](spark, SF), "rank", "left", "cand", "right")
    for v, (x, _) in data.items():
        assert got[v] == [(n, *s) for n, s in enumerate(scenes(q, x, min(8, len(x)), drop=0.2))]


def test_range_keyframes(spark):
    data, q = videos(spark)
    got = collected(QUERIES["k6_k8_range_keyframes"](spark, SF), "frame_idx")
    for v, (x, _) in data.items():
        sims = [cos(q, f) for f in x]
        spans = [(lo, hi) for lo, _, hi in scenes(q, x, min(16, len(x)))]
        mean = [float(np.mean([np.float32(s) for s in sims[lo : hi + 1]])) for lo, hi in spans]
        group = list(range(len(spans)))
        for i in range(len(spans)):
            for j in range(len(spans)):
                if max(spans[i][0], spans[j][0]) <= min(spans[i][1], spans[j][1]) + 30 and abs(mean[i] - mean[j]) < 0.015:
                    old, new = max(group[i], group[j]), min(group[i], group[j])
                    group = [new if g == old else g for g in group]
        merged = [(min(spans[i][0] for i in range(len(spans)) if group[i] == g), max(spans[i][1] for i in range(len(spans)) if group[i] == g)) for g in sorted(set(group))]
        want: list = []
        for lo, hi in merged:
            quota, own = (12 if hi - lo + 1 >= 30 else 6), {lo, hi}
            free = [i for i in range(lo, hi + 1) if i not in own]
            picked = own
            if quota > len(own) and free:
                extra = quota - len(own)
                best = sorted(free, key=lambda i: (-sims[i], i))[: min(max(1, int(extra * 0.4)), len(free))]
                pool, rest = [i for i in free if i not in best], extra - len(best)
                even = pool if rest >= len(free) else [pool[int(k * (len(pool) - 1) / (rest - 1)) if rest > 1 else 0] for k in range(rest)] if rest > 0 and pool else []
                picked = own | set(best) | set(even)
            want += sorted(picked)[:quota][: max(0, 16 - len(want))]
        assert got[v] == sorted(set(want)), v


def test_diverse_keyframes(spark):
    data, q = videos(spark)
    got = collected(QUERIES["k9_diverse_keyframes"](spark, SF), "frame_idx")
    for v, (x, _) in data.items():
        sims = [cos(q, f) for f in x]
        free = set(range(len(x)))
        at = max(free, key=lambda i: (sims[i], -i))
        lo, hi = edge(x, at, True), edge(x, at, False)
        out = sorted(range(lo, hi + 1), key=lambda i: (-sims[i], i))[:2]
        free -= set(range(lo, hi + 1))
        while len(out) < min(16, len(x)) and free:
            at = max(free, key=lambda i: (sims[i], -i))
            lo, hi = edge(x, at, True), edge(x, at, False)
            if min(math.dist(x[at].tolist(), x[i].tolist()) for i in out) >= 0.3:
                out.append(at)
            free -= set(range(lo, hi + 1))
        assert got[v] == sorted(set(out)), v


def halves(scores, idx, total, level=0):
    s = [scores[i] for i in idx]
    if level < 5 and len(idx) > 1 and total // 2 > 0 and total < len(idx):
        top = sum(sorted(s, reverse=True)[:total]) / total
        if top - sum(s) / len(s) <= 0.05 or float(np.std(s)) <= 0:
            half, left = len(idx) // 2, round(total / 2)
            return halves(scores, idx[:half], left, level + 1) + halves(scores, idx[half:], total - left, level + 1)
    return sorted(idx, key=lambda i: (-scores[i], i))[:total]


def test_adaptive_frames_and_the_detection_flow(spark):
    data, _ = videos(spark)
    got = collected(QUERIES["k11_adaptive_frames"](spark, SF), "frame_idx")
    assert got == {v: sorted(halves(s, list(range(len(s))), 24)) for v, (_, s) in data.items()}
    bits = {}
    for r in hashes(spark, SF).orderBy("video", "frame_idx").collect():
        bits.setdefault(r.video, []).append([w >> b & 1 for w in r.bits for b in range(32)])
    flow = collected(QUERIES["r8_detection_flow"](spark, SF), "frame_idx")
    for v, rows in bits.items():
        kept = [0, *[i for i in range(1, len(rows)) if sum(a != b for a, b in zip(rows[i], rows[i - 1])) > 28]] if len(rows) > 1 else []
        scores = [data[v][1][i] for i in kept]
        assert flow.get(v, []) == sorted(kept[i] for i in halves(scores, list(range(len(kept))), 12))


# ---- compression


def parts(x, tau):
    """Components by walking from each token; in order of their smallest tokens."""
    left, out = set(range(len(x))), []
    while left:
        seen, todo = set(), [min(left)]
        while todo:
            i = todo.pop()
            seen.add(i)
            todo += [j for j in left - seen - set(todo) if np.dot(x[i], x[j]) > tau * np.linalg.norm(x[i]) * np.linalg.norm(x[j])]
        left -= seen
        out.append(sorted(seen))
    return out


def back(centers, x):
    own = [[c] for c in centers]
    for v in x:
        own[int(np.argmax([np.dot(v, c) / np.linalg.norm(v) / max(np.linalg.norm(c), 1e-12) for c in centers]))].append(v)
    return [np.mean(o, axis=0) for o in own]


def test_compression_values(spark):
    data, _ = videos(spark)
    f = frames(spark, SF)
    image, exact, video, n = {}, {}, {}, min(len(x) for x, _ in data.values()) // 4
    for target, df in ((image, media.compress_tokens(f, "video", "frame_idx", tau=0.32)), (exact, media.compress_tokens(f, "video", "frame_idx", tau=0.32, ratio=0.3)), (video, media.compress_tokens(f.filter(f"frame_idx < {4 * n}"), "video", "frame_idx", tau=0.3, frames=4))):
        for r in df.orderBy("video", "center").collect():
            target.setdefault(r.video, []).append(r.vec)
    for v, (x, _) in data.items():
        x = x.astype(np.float64)
        whole = back([x[p].mean(axis=0) for p in parts(x, 0.32)], x)
        assert np.allclose(image[v], whole, atol=1e-9)
        k = max(1, math.ceil(len(x) * 0.3))
        if len(whole) > k:
            degree = [sum(np.dot(a, b) > 0.32 * np.linalg.norm(a) * np.linalg.norm(b) for b in whole) for a in whole]
            keep = sorted(sorted(range(len(whole)), key=lambda i: (-degree[i], i))[:k])
            want = back([whole[i] for i in keep], [c for i, c in enumerate(whole) if i not in keep])
        else:
            want = whole + [np.mean(whole, axis=0)] * (k - len(whole))
        assert len(exact[v]) == k and np.allclose(exact[v], want, atol=1e-9)
        y = x[: 4 * n]
        c = np.array([y[n * i : n * i + n][p].mean(axis=0) for i in range(4) for p in parts(y[n * i : n * i + n], 0.3)])
        assert np.allclose(video[v], back([c[p].mean(axis=0) for p in parts(c, 0.3)], y), atol=1e-9)


def test_video_compression_query(spark):
    data, _ = videos(spark)
    got = {}
    for r in QUERIES["c5_compress_video"](spark, SF).orderBy("video", "center").collect():
        got.setdefault(r.video, []).append(r.v0)
    for v, (x, _) in data.items():
        y = x.astype(np.float64).reshape(-1, 16)
        c = np.array([y[4 * i : 4 * i + 4][p].mean(axis=0) for i in range(len(x)) for p in parts(y[4 * i : 4 * i + 4], 0.6)])
        want = [round(float(w[0]), 6) for w in back([c[p].mean(axis=0) for p in parts(c, 0.6)], y)]
        assert np.allclose(got[v], want, atol=2e-6), v


def test_blocked_adjacency(spark):
    x = np.random.default_rng(4).normal(size=(70, 3))
    x[5] = 0
    d = spark.createDataFrame([(1, i, v.tolist()) for i, v in enumerate(x)], "item int, token_idx int, embedding array<double>")
    want = {(i, j) for i in range(70) for j in range(i + 1, 70) if np.dot(x[i], x[j]) > 0.6 * np.linalg.norm(x[i]) * np.linalg.norm(x[j])}
    for block in (1000, 16):
        got = [(r.x, r.y) for r in media.token_edges(d, tau=0.6, block=block).collect()]
        assert len(got) == len(set(got)) and set(got) == want
