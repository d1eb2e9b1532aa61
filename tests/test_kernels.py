"""Numeric kernels against independent slow versions and identities."""

import math
import struct

import numpy as np
import pytest

from framewright.functions import audio, compress, keyframes, pixels
from framewright.functions.sequences import int_linspace
from framewright.types import MediaError


def image(h, w, seed=0):
    return np.random.default_rng(seed).integers(0, 256, (h, w, 3)).astype(np.uint8)


def slow_axis(line, dst):
    """One row of antialiased bicubic resampling, scalar by scalar."""
    src, out = len(line), []
    scale = src / dst
    wide = max(scale, 1)
    for i in range(dst):
        c = (i + 0.5) * scale
        lo, hi = max(0, int(c - 2 * wide + 0.5)), min(src, int(c + 2 * wide + 0.5))
        ws = []
        for j in range(lo, hi):
            x = abs((j - c + 0.5) / wide)
            ws.append(1.5 * x**3 - 2.5 * x * x + 1 if x < 1 else -0.5 * (x**3 - 5 * x * x + 8 * x - 4) if x < 2 else 0.0)
        t = sum(ws)
        fixed = [int(w / t * 2**22 + (0.5 if w >= 0 else -0.5)) for w in ws]
        v = (sum(f * int(line[j]) for f, j in zip(fixed, range(lo, hi))) + 2**21) >> 22
        out.append(min(255, max(0, v)))
    return out


@pytest.mark.parametrize("w,h", [(17, 31), (40, 12), (10, 10), (64, 50)])
def test_resize_equals_the_scalar_version(w, h):
    x = image(23, 29)
    rows = np.stack([np.stack([slow_axis(x[r, :, c], w) for c in range(3)], axis=1) for r in range(23)])
    want = np.stack([np.stack([slow_axis(rows[:, q, c], h) for c in range(3)], axis=1) for q in range(w)], axis=1)
    assert (pixels.resize_bicubic(x, w, h) == want).all()


def test_resize_identities():
    x = image(30, 40)
    assert (pixels.resize_bicubic(x, 40, 30) == x).all()
    assert (pixels.resize_bicubic(np.full((50, 20, 3), 201, np.uint8), 33, 77) == 201).all()
    with pytest.raises(MediaError):
        pixels.resize_bicubic(x, 9, 20)


@pytest.mark.parametrize("mode,a", [("bilinear", None), ("bicubic", -0.75)])
def test_interpolation_rows_sum_to_one_and_match_a_slow_version(mode, a):
    m = pixels.interpolation_matrix(13, 29, mode, 0, 29)
    assert np.allclose(m.sum(axis=1), 1, atol=1e-6)
    line = np.random.default_rng(1).random(13)
    for o in (0, 7, 28):
        s = (o + 0.5) * 13 / 29 - 0.5
        if mode == "bilinear":
            s = max(s, 0)
            i = min(int(s), 12)
            want = line[i] * (1 - (s - i)) + line[min(i + 1, 12)] * (s - i)
        else:
            i, want = math.floor(s), 0
            for k in range(-1, 3):
                x = abs(s - i - k)
                w = (a + 2) * x**3 - (a + 3) * x * x + 1 if x < 1 else a * x**3 - 5 * a * x * x + 8 * a * x - 4 * a
                want += w * line[min(max(i + k, 0), 12)]
        assert m[o] @ line == pytest.approx(want, abs=1e-5)


def test_fused_equals_the_chain_and_window_equals_crop():
    x = image(40, 56)[None]
    mean, std = pixels.IMAGENET_MEAN, pixels.IMAGENET_STD
    chain = pixels.normalize(pixels.resize_crop(pixels.to_tensor(x), (64, 64), (48, 40)), mean, std)
    assert np.array_equal(chain, pixels.fused_preprocess(x, (64, 64), (48, 40), mean, std))
    whole = pixels.resize_crop(pixels.to_tensor(x), (64, 64), (64, 64))
    assert np.allclose(pixels.resize_crop(pixels.to_tensor(x), (64, 64), (48, 40)), whole[:, :, 8:56, 12:52], atol=1e-6)


def test_golden_values():
    assert pixels.smart_size(70, 70, 28, 3136, 1003520) == (56, 56)
    assert pixels.crop_offset(0.5, 11, 10) == 1 and pixels.crop_offset(0.5, 11, 10, "truncate") == 0
    assert pixels.tiles_of(np.zeros((1080, 1920, 3), np.uint8)).shape == (9, 3, 448, 448)
    assert int_linspace(0, 8, 4) == [0, 2, 5, 8] and int_linspace(3, 9, 1) == [3] and int_linspace(0, 1, 0) == []
    assert pixels.unique_frames(np.zeros((1, 64), bool)) == []
    assert compress.target_size(10) == 3 and compress.gated(8193) and not compress.gated(10**6, 0)
    assert audio.pcm_to_float(struct.pack("<h", -32768), 16).tolist() == [-1.0]
    with pytest.raises(MediaError):
        pixels.smart_size(20, 4000)


def test_patchify_is_a_permutation():
    f = np.arange(3 * 3 * 56 * 84, dtype=np.float32).reshape(3, 3, 56, 84)
    p, grid = pixels.patchify(f)
    assert grid == (2, 4, 6) and p.shape == (48, 1176)
    assert np.array_equal(np.sort(p.ravel()), np.sort(np.concatenate([f, f[-1:]]).ravel()))
    assert p[0, 0] == f[0, 0, 0, 0] and p[1, 0] == f[0, 0, 0, 14] and p[2, 0] == f[0, 0, 14, 0] and p[4, 0] == f[0, 0, 0, 28]


def wav(x, rate, kind=1, bits=16, channels=1, extra=b""):
    fmt = struct.pack("<HHIIHH", kind, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    return b"RIFF" + struct.pack("<I", 0) + b"WAVE" + extra + b"fmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", len(x)) + x


def test_wav_formats():
    s = np.array([0, 1, -1, 32767, -32768], np.int16)
    for bits, raw in ((16, s.astype("<i2").tobytes()), (24, b"".join(int(v << 8).to_bytes(3, "little", signed=True) for v in s.tolist())), (32, (s.astype(np.int64) << 16).astype("<i4").tobytes())):
        rate, x = audio.parse_wav(wav(raw, 16000, bits=bits, extra=b"LIST" + struct.pack("<I", 4) + b"abcd"))
        assert rate == 16000 and np.allclose(x[:, 0], s / 32768, atol=1e-6)
    f = np.array([1.5, -2.0], "<f4")
    assert audio.parse_wav(wav(f.tobytes(), 8000, 3, 32))[1].ravel().tolist() == [1.5, -2.0]
    assert audio.to_mono(np.array([[1, 0], [0.5, 0.5]], np.float32)).tolist() == [0.5, 0.5]
    for bad in (b"", b"RIFFxxxxWAVE", wav(b"", 1, 7)):
        with pytest.raises(MediaError):
            audio.parse_wav(bad)


@pytest.mark.parametrize("rate,target", [(48000, 16000), (44100, 16000), (16000, 44100)])
def test_resample_a_tone(rate, target):
    x = np.sin(2 * np.pi * 440 * np.arange(rate) / rate).astype(np.float32)
    y = audio.resample(x, rate, target)
    assert len(y) == math.ceil(rate * target / rate)
    want = np.sin(2 * np.pi * 440 * np.arange(len(y)) / target)
    assert np.abs(y - want)[600:-600].max() < 1e-4


def test_chunks():
    c = audio.chunks(np.ones(70), 10, 3, 1)
    assert [(s, e, len(v)) for s, e, v in c] == [(0, 3, 30), (3, 6, 30), (6, 7, 30)] and c[-1][2].sum() == 10
    assert len(audio.chunks(np.ones(65), 10, 3, 1)) == 2


def unit_rows(n, d=32, seed=0):
    x = np.random.default_rng(seed).standard_normal((n, d)).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_intervals():
    flat = np.ones(100)
    assert keyframes.merge_intervals([(0, 10)], flat) == [(0, 10)]
    assert len(keyframes.merge_intervals([(0, 4), (50, 60)], flat, gap=5)) == 2
    s = np.r_[np.full(7, 0.9), np.full(93, 0.1)]
    assert len(keyframes.merge_intervals([(0, 6), (8, 14)], s)) == 2
    assert keyframes.merge_intervals([(40, 50), (0, 5), (52, 60)], flat) == [(40, 60), (0, 5)]
    assert keyframes.merge_intervals([(40, 50), (0, 9), (52, 60)], flat, gap=31) == [(0, 60)]


@pytest.mark.parametrize("seed", range(4))
def test_keyframe_properties(seed):
    x, q = unit_rows(120, seed=seed), unit_rows(1, seed=99)[0]
    s = keyframes.cosine(q, x)
    for pick in (keyframes.range_keyframes, keyframes.diverse_keyframes):
        out = pick(q, x, 16)
        assert out == sorted(set(out)) and 0 < len(out) <= 16 and all(0 <= i < 120 for i in out)
    assert int(s.argmax()) in keyframes.diverse_keyframes(q, x, 16)
    assert keyframes.diverse_intervals(s, x, 8)[0][1] == int(s.argmax())
    out = keyframes.adaptive_segments(s.astype(float), 24)
    assert len(out) == 24 == len(set(out))
    assert keyframes.adaptive_segments(np.zeros(10), 24) == list(range(10))


def test_boundary_carries_the_value_of_the_block_before():
    """A still scene has no boundary; the left side compares the carried 1 with the farthest frame of the first block."""
    x = np.tile(unit_rows(1), (40, 1))
    assert keyframes.find_boundary(x, 20, True) == 0 and keyframes.find_boundary(x, 20, False) == 39
    y = x.copy()
    y[:15] = unit_rows(1, seed=5)
    assert keyframes.find_boundary(y, 20, True) == 15
    assert keyframes.find_boundary(y, 0, True) == 0 and keyframes.find_boundary(y, 39, False) == 39


def test_resample_interval():
    s = np.linspace(0, 1, 60)
    assert keyframes.resample_interval((3, 3), s, 6) == [3]
    out = keyframes.resample_interval((0, 40), s, 12)
    assert len(out) == 12 and out[0] == 0 and {36, 37, 38, 39} <= set(out) | {40}
    assert keyframes.resample_interval((1, 2, 3), s, 2) == [2, 3] and keyframes.resample_interval((), s, 2) == []


def test_compression():
    r = np.random.default_rng(0)
    x = np.concatenate([1 + 0.01 * r.standard_normal((50, 64)), -1 + 0.01 * r.standard_normal((50, 64))])
    c = compress.compress_image(x)
    assert len(c) == 2 and c[0].mean() > 0.9 and c[1].mean() < -0.9
    ten = compress.to_exact(c, 10)
    assert ten.shape == (10, 64) and np.allclose(ten[2:], c.mean(axis=0))
    adj = np.zeros((4, 4), bool)
    adj[0, 1] = adj[2, 1] = True
    assert compress.components(adj).tolist() == [0, 0, 0, 1]
    assert [sorted(g) for g in compress.sampled_components(adj)] == [[0, 1, 2], [3]]
    assert not compress.adjacency(np.zeros((2, 3))).any()
    assert np.allclose(compress.centers(np.array([[1.0, 1], [1, 3], [-2, -2]]), np.array([0, 0, 1])), [[1, 2], [-2, -2]])
    assert compress.compress_video(x, 2).shape[1] == 64
    with pytest.raises(MediaError):
        compress.compress_video(x, 3)


def test_plan_time_settings():
    from framewright.functions import params

    p = params.vision_params(size={"shortest_edge": 3136, "longest_edge": 50176}, mean=0.5, unknown=1)
    assert (p["min_pixels"], p["max_pixels"], p["mean"]) == (3136, 50176, (0.5, 0.5, 0.5))
    for bad in ({"do_resize": False}, {"std": 0}, {"temporal_patch_size": 3}, {"min_pixels": 10}, {"max_pixels": 4096**2 + 1}):
        with pytest.raises(MediaError):
            params.vision_params(**bad)
    f = np.zeros((12, 14, 3), np.float32)
    assert [len(x) for x in params.frame_lists(f)] == [1] and [len(x) for x in params.frame_lists([f, f])] == [1, 1] and [len(x) for x in params.frame_lists([[f, f], [f]])] == [2, 1]
    assert params.selection_inputs("q", 4, 10) == 4 and params.tile_params(32, 1, 4) == (32, 1, 4)
    for bad in (("", 1, 1), ("q", 0, 1), ("q", 1, 0), ("q", 1, True)):
        with pytest.raises(MediaError):
            params.selection_inputs(*bad)
    with pytest.raises(MediaError):
        params.tile_params(448, 5, 12)
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return 7

    assert params.retry(flaky, wait=0.001) == 7 and len(calls) == 3
