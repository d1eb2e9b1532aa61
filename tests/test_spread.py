"""Small tables whose rows become large media: tasks, joins and memory."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from framewright.functions import audio
from framewright.functions import pixels as px
from framewright.operators import media
from framewright.plans.queries_media import _rounded
from framewright.types import IMAGE

SF = "/root/testdata/sf0.1"


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["s3_s4_a4_load_and_resample", "a6_chunk_rows", "a3_mono", "a1_pcm24_pcm32", "t13_video_patches", "t4_t5_normalize", "t3_t8_to_tensor", "w2_perceptual_hash", "t10_t13_t14_patches", "t2_resize", "t18_tiles", "t6_resize_crop_bicubic", "t12_patch_positions", "t9_fused_pipeline", "t22_tensor_into_bytes"])
def test_work_is_spread_by_rows(spark, name):
    parts = [int(n) for n in re.findall(r"RepartitionByExpression \[.*?\], (\d+)", _plan(queries()[name](spark, SF)))]
    assert parts and min(parts) >= 8  # one file of one row group was one task


def test_chunks_are_counted_without_a_join(spark):
    plan = queries()["a6_chunk_rows"](spark, SF)._jdf.queryExecution()
    assert "Join" not in plan.optimizedPlan().toString() and plan.sparkPlan().toString().count("Window") == 1
    rows = spark.createDataFrame([(k, i, 0.5) for k in (1, 2) for i in range(10 + k)], "k long, i long, v double")
    got = media.chunk_rows(rows, "k", "i", 5, 2)
    assert got.columns == ["k", "chunk", "i", "v", "n"]
    assert sorted((r.k, r.chunk, r.i, r.n) for r in got.collect()) == [(k, i // 5, i, 2 if i >= 10 else 5) for k, n in ((1, 10), (2, 12)) for i in range(n)]


def test_resampling_in_groups_is_the_plain_sum():
    x = np.random.default_rng(0).uniform(-1, 1, 700).astype(np.float32)
    for rate, target in ((44100, 16000), (8000, 44100), (44101, 16000)):
        g = np.gcd(rate, target)
        up, down = target // g, rate // g
        h, taps = audio._filters(up, down)
        padded = np.concatenate([np.zeros(taps), x, np.zeros(taps + 1)])
        want = [padded[o * down // up + 1 : o * down // up + 1 + 2 * taps] @ h[o * down % up] for o in range(-(-len(x) * target // rate))]
        got = audio.resample(x, rate, target)
        assert got.shape == (len(want),) and np.abs(got - np.array(want)).max() < 2e-7


def test_wide_samples_meet_in_their_row(spark):
    assert "Join" not in _plan(queries()["a1_pcm24_pcm32"](spark, SF))
    got = queries()["a1_pcm24_pcm32"](spark, "/root/testdata/sf0.001").filter("i = 7").collect()
    s = lambda k: (k * 7919 + 7 * 104729) % 65536 - 32768
    assert got and all((r.v24, r.v32) == (s(r.c_custkey) * 256 + 7, s(r.c_custkey)) for r in got)


def test_images_of_videos_are_never_broadcast(spark):
    plan = queries()["t13_video_patches"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_video_patches_of_pairs_that_differ_in_size(spark):
    """More pairs than are patched at once, an odd last frame, and second frames of another size."""
    r = np.random.default_rng(0)
    x = [r.integers(0, 256, (30 + k % 2 * 5, 40, 3)).astype(np.uint8) for k in range(301)]
    f = spark.createDataFrame([(1, k, media.image_value(v)) for k, v in enumerate(x)], f"video int, at int, image {IMAGE}").coalesce(1)
    got = {g.pair: g for g in media.video_patches(f, "video", "at", "image").collect()}
    assert sorted(got) == list(range(151))
    for p in (0, 64, 128, 149, 150):
        want, (_, h, w) = px.patches_of(x[2 * p : 2 * p + 2], like=(30, 40))
        assert list(got[p].grid) == [151, h, w] and (media.tensor_array(got[p]) == want).all()


def test_mono_needs_no_shuffle_of_samples(spark):
    plan = queries()["a3_mono"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("HashAggregate") < plan.index("Generate") < plan.index("Exchange")


def test_rounding_of_every_byte_is_that_of_decimals(spark):
    p = spark.range(256).selectExpr("id AS value", "explode(array(0, 1, 2)) AS c")
    n = media.normalize_rows(p, px.IMAGENET_MEAN, px.IMAGENET_STD).union(p.selectExpr("value / 255D", "c"))
    for d in (5, 6):
        assert n.filter(_rounded(F.col("value"), d) != F.round("value", d)).count() == 0


def test_stacks_give_what_single_images_give():
    x = np.random.default_rng(3).integers(0, 256, (5, 40, 80, 3)).astype(np.uint8)
    t, b = px.tiles_stack(x, 32), px.hash_stack(x)
    assert all((px.tiles_of(i, 32) == k).all() for i, k in zip(x, t)) and all((px.perceptual_hash(i) == k).all() for i, k in zip(x, b))


def test_results_of_a_batch_leave_in_slices():
    assert [len(s) for s in media._slices(iter([{"data": b"x"}] * 600))] == [256, 256, 88]
    assert [len(s) for s in media._slices(iter([{"data": b"x" * 10}] * 5), most=20)] == [2, 2, 1]


def test_normal_bytes_are_normalized_bytes():
    """Looked up by byte, planes and patches are what the plain kernels give, bit by bit."""
    x = np.random.default_rng(5).integers(0, 256, (9, 60, 90, 3)).astype(np.uint8)
    assert (px.normal_planes(x, px.IMAGENET_MEAN, px.IMAGENET_STD) == px.normalize(px.to_tensor(x), px.IMAGENET_MEAN, px.IMAGENET_STD)).all()
    for frames in ([x], [x, x[::-1]]):
        got, grid = px.patches_stack(frames)
        for k in range(len(x)):
            want, own = px.patches_of([f[k] for f in frames])
            assert own == grid and (got[k] == want).all()


def test_a_stack_is_worked_on_in_parts_that_fit_the_cache(monkeypatch):
    x = np.random.default_rng(6).integers(0, 256, (7, 40, 56, 3)).astype(np.uint8)
    resized, bits = px.resize_stack(x, 84, 28), px.hash_stack(x)
    monkeypatch.setattr(px, "_NEAR", 1)  # one image at a time
    assert (px.resize_stack(x, 84, 28) == resized).all() and (px.hash_stack(x) == bits).all()
