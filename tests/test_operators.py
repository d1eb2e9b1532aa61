"""DataFrame operators, graphs, sources and streaming."""

import ast
import json
import os
import struct
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.functions import pixels
from framewright.operators import media, relations, retrieval, sampling
from framewright.plans.catalog import ORACLES, QUERIES
from framewright.plans.pipeline import Pipeline, Spec, fuse, first_available, merge_config, pipeline_def, prune
from framewright.sources import media as src
from framewright.streaming import frames as live
from framewright.types import MediaError

SF = "/root/testdata/sf0.001"


def test_nothing_else_needs_the_corpus_package():
    code = "import sys; sys.modules['framewright.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and set(e.oracle_sql()) <= set(q); assert not any(n.startswith('op') for n in q)"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root)
    for folder, _, files in os.walk(os.path.join(root, "framewright")):
        if "llm" not in folder:
            for f in files:
                if f.endswith(".py"):
                    tree = ast.parse(open(os.path.join(folder, f), encoding="utf-8").read())
                    assert not any("llm" in (getattr(n, "module", "") or "") for n in ast.walk(tree) if isinstance(n, ast.ImportFrom))


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.8g}") + 0.0
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df, r = QUERIES[name](spark, SF), duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(r.columns)
    a = sorted((tuple(plain(row[c]) for c in sorted(df.columns)) for row in df.collect()), key=repr)
    at = [r.columns.index(c) for c in sorted(r.columns)]
    b = sorted((tuple(plain(row[i]) for i in at) for row in r.fetchall()), key=repr)
    assert a == b


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs_alike_twice(spark, name):
    rows = [sorted(map(str, QUERIES[name](spark, SF).collect())) for _ in range(2)]
    assert rows[0] and rows[0] == rows[1]


def test_pruning_and_fusion():
    a, b, c = Spec("ToTensor", ["x"], {}, "a"), Spec("ResizeCrop", ["a"], {"resize": (64, 64), "crop": (32, 32)}, "b"), Spec("Normalize", ["b"], {"mean": (0, 0, 0), "std": (1, 1, 1)}, "c")
    unused = Spec("Patches", ["x"], {}, "u")
    assert [s.output for s in prune([c, unused, b, a], ["c"])] == ["a", "b", "c"]
    assert [s.op for s in fuse([a, b, c], ["c"])] == ["ToTensorResizeCropNormalize"]
    assert len(fuse([a, b, c], ["b", "c"])) == 3  # an output is an intermediate
    assert len(fuse([a, b, c, Spec("Normalize", ["a"], {}, "d")], ["c", "d"])) == 4  # a second reader
    cubic = Spec("ResizeCrop", ["a"], {"resize": (64, 64), "crop": (32, 32), "mode": "bicubic"}, "b")
    assert len(fuse([a, cubic, c], ["c"])) == 3  # the fused kernel is bilinear: the chain stays
    with pytest.raises(MediaError):
        prune([a, Spec("ToTensor", ["y"], {}, "a")], ["a"])
    with pytest.raises(MediaError):
        Pipeline(batch_size=1025)
    with pytest.raises(MediaError):
        Pipeline(queue_depth=1)
    assert merge_config({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}} and first_available(None, 0, 1) == 0


def image_rows(spark, n=3, h=40, w=56):
    return src.images_from_arrays(spark, {f"i{k}": np.random.default_rng(k).integers(0, 256, (h, w, 3)).astype(np.uint8) for k in range(n)})


def test_fused_pipeline_equals_unfused_and_kernels(spark):
    @pipeline_def
    def define(size):
        return [Spec("ToTensor", ["image"], {}, "a"), Spec("ResizeCrop", ["a"], {"resize": (size, size), "crop": (32, 32)}, "b"), Spec("Normalize", ["b"], {"mean": pixels.IMAGENET_MEAN, "std": pixels.IMAGENET_STD}, "t")], ["t"]

    df = image_rows(spark)
    out = [[bytes(r.t.data) for r in define(64, auto_fuse=f).run(df).orderBy("path").collect()] for f in (True, False)]
    assert out[0] == out[1]
    x = np.random.default_rng(1).integers(0, 256, (40, 56, 3)).astype(np.uint8)
    assert out[0][1] == pixels.fused_preprocess(x[None], (64, 64), (32, 32), pixels.IMAGENET_MEAN, pixels.IMAGENET_STD).tobytes()


def test_dense_images_equal_long_form(spark):
    df = image_rows(spark, 1)
    t = media.tensor_array(df.select(media.normalize(media.to_tensor(F.col("image"), "NHWC"), pixels.CLIP_MEAN, pixels.CLIP_STD).alias("t")).first().t)
    x = np.random.default_rng(0).integers(0, 256, (40, 56, 3)).astype(np.uint8)
    rows = spark.createDataFrame([(y, c, z, int(x[y, c, z])) for y in range(40) for c in range(56) for z in range(3)], "y long, x long, c long, value long")
    long = media.normalize_rows(rows, pixels.CLIP_MEAN, pixels.CLIP_STD).collect()
    assert max(abs(t[0, r.y, r.x, r.c] - r.value) for r in long) < 1e-5


def test_permissive_kernels_and_nulls(spark):
    df = spark.createDataFrame([(1, b"nonsense"), (2, None)], "i int, content binary")
    with pytest.raises(Exception, match="WAVE"):
        df.select(media.load_audio(F.col("content"))).collect()
    ok = media.per_row(lambda b: {"sample_rate": 1, "samples": [0.0]} if b == b"x" else (_ for _ in ()).throw(MediaError("bad")), "struct<sample_rate: int, samples: array<float>>", permissive=True)
    assert [r.a.sample_rate for r in df.select(ok(F.col("content")).alias("a")).collect()] == [None, None]
    with pytest.raises(MediaError):
        src.images_from_arrays(spark, {"a": np.zeros((20, 20, 4), np.uint8)})


def test_compatible_quirks(spark):
    """What the reproduced behaviour does although one might not expect it, and how to turn it off."""
    one = spark.createDataFrame([(1, 0, [5])], "video int, frame_idx int, bits array<bigint>")
    assert relations.changed_frames(one, "video", "frame_idx", "bits").count() == 0
    assert relations.changed_frames(one, "video", "frame_idx", "bits", strict_compat=False).count() == 1
    e = spark.createDataFrame([(1, 7, 0.5)], "k int, id int, t double")
    s = spark.createDataFrame([(1, 0, 0.0, 1.0), (1, 1, 2.0, 3.0)], "k int, pos int, lo double, hi double")
    assert relations.first_covering(e, s, "k", "t", "id", "pos").count() == 0
    assert relations.first_covering(e, s, "k", "t", "id", "pos", strict_compat=False).first().pos == 0
    assert media.model_inputs("images", "videos") == "videos" and media.model_inputs("images", None) == "images"


def test_zip_strict_raises(spark):
    a = spark.createDataFrame([(1, 0), (1, 1)], "k int, p int")
    with pytest.raises(Exception, match="differ in length"):
        relations.zip_strict(a, a.filter("p = 0").withColumn("v", F.lit(1)), "k", "p").collect()


def test_range_search_in_passes(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "MOST_NUMBERS", 200)
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv"))
    got = {(r.vec_id, r.q) for r in retrieval.range_search(e, q, "embedding", "q", "qv").select("vec_id", "q").collect()}
    x = np.array([r.embedding for r in e.orderBy("vec_id").collect()], dtype=np.float64)
    want = {(i, j) for j in range(0, len(x), 50) for i in range(len(x)) if x[i] @ x[j] > 0.25}
    assert got == want
    # Any number of queries under one identifier, or under none; other dimensions, nulls and empty tables.
    same = q.withColumn("q", F.lit(None).cast("long"))
    assert retrieval.range_search(e, same, "embedding", "q", "qv").count() == len(want)
    odd = spark.createDataFrame([(1, [1.0, 1.0]), (2, None), (3, [None, 9.0]), (4, [3.0])], "i int, v array<double>")
    got = retrieval.range_search(odd, odd.select(F.col("i").alias("q"), F.col("v").alias("qv")), "v", "q", "qv")
    assert sorted((r.i, r.q, r.score) for r in got.collect()) == [(1, 1, 2.0), (4, 4, 9.0)]
    assert retrieval.range_search(odd, odd.filter("i > 9").select(F.col("i").alias("q"), F.col("v").alias("qv")), "v", "q", "qv").count() == 0


def test_sampling_golden_values(spark):
    r = spark.range(1).select(
        sampling.uniform_by_count(F.lit(9), F.lit(4)).alias("a"), sampling.uniform_by_count(F.lit(9), F.lit(1)).alias("b"),
        sampling.frame_indices(F.lit(False), F.lit(30), F.lit(100), F.lit(1), F.lit(3)).alias("c"), sampling.downsample(F.lit(6), F.lit(1)).alias("d"), sampling.downsample(F.lit(2), F.lit(3)).alias("e"), retrieval.clock(F.lit(3661.9)).alias("f"),
    ).first()
    assert (r.a, r.b, r.c, r.d, r.e, r.f) == ([0, 2, 5, 8], [0], [0, 30, 60], [3], None, "01:01:01")
    p = spark.createDataFrame([(1, float(i)) for i in range(10)], "k int, t double")
    s = spark.createDataFrame([(1, 0, 0.0, 9.0)], "k int, s int, lo double, hi double")
    assert [x.i for x in sampling.sample_in_range(p, s, 1, "k", "t", "s").collect()] == [5]
    h = spark.createDataFrame([(1, 0, 6), (1, 5, 6)], "k int, i long, n long")
    assert sorted(x.i for x in sampling.expand_spans(h, 1, "k", "i", "n").collect()) == [0, 1, 4, 5]


def wav(n, rate):
    d = (np.arange(n) % 100 - 50).astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(d)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate * 2, 2, 16) + b"data" + struct.pack("<I", len(d)) + d


def test_audio_files(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.wav").write_bytes(wav(800 * (i + 1), 8000))
    (tmp_path / "x.txt").write_text("no")
    rows = src.read_audio(spark, str(tmp_path), 16000).orderBy("path").collect()
    assert [(r.audio.sample_rate, len(r.audio.samples)) for r in rows] == [(16000, 1600), (16000, 3200), (16000, 4800)]
    c = media.chunk_audio(src.read_audio(spark, str(tmp_path)), "path", "audio", 0.1, 0.05).groupBy("path").count().orderBy("path").collect()
    assert [r["count"] for r in c] == [1, 2, 3]


def test_evaluation_file_and_cache(spark, tmp_path):
    q = [{"video_id": "v", "duration": "long", "questions": [{"question_id": "a", "options": ["A", "B"], "answer": "A"}, {"question_id": "b", "answer": "B"}]}]
    (tmp_path / "q.json").write_text(json.dumps(q))
    assert [r.question_id for r in src.read_evaluation(spark, str(tmp_path / "q.json")).collect()] == ["a", "b"]
    items = spark.createDataFrame([("k1", 2), ("k1", 2), ("k2", 5)], "content_key string, x int")
    path = str(tmp_path / "cache")
    compute = lambda d: d.select("content_key", (F.col("x") * F.col("x")).alias("y"))
    assert sorted((r.content_key, r.y) for r in src.cached(items, path, "content_key", compute).collect()) == [("k1", 4), ("k2", 25)]
    more = items.union(spark.createDataFrame([("k3", 7)], items.schema))
    assert sorted((r.content_key, r.y) for r in src.cached(more, path, "content_key", compute).collect()) == [("k1", 4), ("k2", 25), ("k3", 49)]
    assert spark.read.parquet(path).count() == 3


def test_wanted_frames(spark):
    rows = [(1, 10, [7, 2, 2], 3), (2, 9, None, 4), (3, 9, [], 1), (4, 5, None, 5)]
    v = spark.createDataFrame(rows, "id int, n long, listed array<long>, k int")
    got = {}
    for r in src.wanted_frames(v, "n", "listed", "k").collect():
        got.setdefault(r.id, []).append(r.frame_idx)
    assert got == {1: [2, 7], 2: [0, 2, 5, 8], 3: [0], 4: [0, 1, 2, 3, 4]}
    for listed, k, why in (([10], None, "outside"), ([-1], None, "outside"), (None, None, "neither"), (None, -1, "neither"), (None, 11, "fit"), (None, 0, "fit")):
        one = spark.createDataFrame([(1, 10, listed, k)], "id int, n long, listed array<long>, k int")
        with pytest.raises(Exception, match=why):
            src.wanted_frames(one, "n", "listed", "k").collect()


def test_extraction_cache_is_locked_and_kept_by_rate(spark, tmp_path):
    items = spark.createDataFrame([(b"a",), (b"b",), (b"a",)], "content binary")
    keyed = [items.select(src.frame_cache_key(F.col("content"), fps).alias("k"), "content") for fps in (1, 2.5)]
    assert keyed[0].union(keyed[1]).select("k").distinct().count() == 4
    path, calls = str(tmp_path / "cache"), []

    def compute(todo):
        calls.append(todo.count())
        assert os.path.exists(path + ".lock")
        return todo.select("k", F.length("content").alias("v"))

    for k in (keyed[0], keyed[0], keyed[1]):
        assert src.cached(k, path, "k", compute).count() == 2
    assert calls == [2, 0, 2] and not os.path.exists(path + ".lock")
    open(path + ".lock", "w").close()  # another job's
    with pytest.raises(TimeoutError):
        src.cached(keyed[0], path, "k", compute, wait=0.5)
    assert src.cached(keyed[0], path, "k", compute, wait=0.5, stale=-1).count() == 2  # a dead job's


def test_number_of_audio_files(spark, tmp_path):
    from framewright.plans.queries_media import wav_bytes

    for i in range(3):
        (tmp_path / f"{i}.wav").write_bytes(wav_bytes(b"\0\1" * 8, 8000) if i else b"broken")
    with pytest.raises(MediaError, match="more than"):
        src.read_audio(spark, str(tmp_path), most_files=2)
    rows = src.read_audio(spark, str(tmp_path), most_files=3, permissive=True).select("audio._error", "audio.sample_rate").collect()
    assert sorted((r.sample_rate or 0, r._error is None) for r in rows) == [(0, False), (8000, True), (8000, True)]


def test_sql_names(spark):
    from framewright.plans import sql

    names = sql.register(spark)
    assert len(names) == len(set(names)) >= 13
    src.images_from_arrays(spark, {"a": np.arange(20 * 30 * 3, dtype=np.uint8).reshape(20, 30, 3)}).createOrReplaceTempView("pictures")
    r = spark.sql("SELECT fw_crop(image, 2, 3, 11, 12) AS c, fw_resize(image, 15, 10).width AS w, fw_to_tensor(image).shape AS s FROM pictures").first()
    assert (r.c.height, r.c.width, r.w, list(r.s)) == (11, 12, 15, [1, 3, 20, 30])
    assert spark.sql("SELECT fw_dot(array(1D, 2D), array(3D, 4D)), fw_clock(3661.9D), fw_pcm16(-32768D), fw_crop_offset(0.5D, 11, 10)").first()[:] == (11.0, "01:01:01", -1.0, 1)
    assert [r.i for r in spark.sql("SELECT i FROM fw_even_frames(9, 4) ORDER BY j").collect()] == [0, 2, 5, 8]


def test_video_decoder_plug_in(spark):
    wanted = spark.createDataFrame([("v", i, i // 10 * 10) for i in (3, 7, 25)], "path string, frame_idx int, key_idx int")
    decode = lambda p, ids: ((i, i / 10, np.full((12, 10, 3), i, np.uint8)) for i in ids)
    rows = src.decode_video(wanted, decode).orderBy("frame_idx").collect()
    assert [(r.frame_idx, r.ts, r.image.data[0]) for r in rows] == [(3, 0.3, 3), (7, 0.7, 7), (25, 2.5, 25)]
    with pytest.raises(Exception, match="missing"):
        src.decode_video(wanted, lambda p, ids: iter(())).collect()


def test_streaming_changed_frames(spark, tmp_path):
    schema = "video int, frame_idx long, bits array<bigint>"
    bits = [0, 0, 255, 255, 3, 2**40 - 1]
    folder = str(tmp_path / "in")
    for part in ([0, 1, 2], [3, 4, 5]):
        spark.createDataFrame([(1, i, [bits[i]]) for i in part], schema).coalesce(1).write.mode("append").parquet(folder)
        name = f"q{part[0]}"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    q = live.changed_frames(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted(r.frame_idx for r in spark.table(name).collect()) == [0, 2, 4, 5]


def test_jpeg_files(spark, tmp_path):
    j = spark.sparkContext._jvm
    img = j.java.awt.image.BufferedImage(40, 30, 5)
    for y in range(30):
        for x in range(40):
            img.setRGB(x, y, 200 << 16 | 100 << 8 | 50)
    assert j.javax.imageio.ImageIO.write(img, "jpg", j.java.io.File(str(tmp_path / "a.jpg")))
    (tmp_path / "b.txt").write_text("no")
    r = src.read_images(spark, str(tmp_path)).collect()
    assert len(r) == 1 and (r[0].image.height, r[0].image.width) == (30, 40)
    x = media.image_array(r[0].image.asDict())
    assert np.abs(x.astype(int) - [200, 100, 50]).max() <= 2  # RGB, not the reader's BGR


@pytest.mark.parametrize("name", ["t2_resize", "t6_resize_crop_bicubic", "t9_fused_pipeline", "w2_perceptual_hash"])
def test_image_queries_cover_the_whole_table(spark, name):
    want = {r[0] for r in spark.read.parquet(f"{SF}/part.parquet").select("p_partkey").collect()}
    assert {r.p_partkey for r in QUERIES[name](spark, SF).select("p_partkey").collect()} == want


def test_video_patches_cover_the_whole_table(spark):
    """Two frames to a step of the grid."""
    want = {r[0]: r[1] for r in spark.read.parquet(f"{SF}/part.parquet").groupBy((F.col("p_partkey") % 7).alias("v")).agg(F.count("*")).collect()}
    got = {r.video: int(r.grid.split("x")[0]) for r in QUERIES["t13_video_patches"](spark, SF).collect()}
    assert got == {v: -(-n // 2) for v, n in want.items()}


def test_sampled_components_of_items(spark):
    """The operator applies the anchor sampling to each item; at the query's eps small items are exact up to the numbering."""
    from framewright.functions import compress as cp

    x = {k: np.random.default_rng(k).normal(size=(60, 4)) for k in (1, 2)}
    d = spark.createDataFrame([(k, i, v.tolist()) for k, a in x.items() for i, v in enumerate(a)], "item int, token_idx int, embedding array<double>")
    groups = lambda rows: {k: sorted(sorted(r.token for r in rows if (r["item"], r.component) == (k, c)) for c in {r.component for r in rows if r["item"] == k}) for k in x}
    exact = groups(media.token_components(d, tau=0.9).collect())
    few = media.token_components(d, tau=0.9, eps=1.0).collect()  # 5 anchors
    for k, a in x.items():
        want = cp.sampled_components(cp.adjacency(a, 0.9), 1.0)
        assert sorted((r.component, r.token) for r in few if r["item"] == k) == [(c, i) for c, g in enumerate(want) for i in g]
    assert groups(few) != exact and groups(media.token_components(d, tau=0.9, eps=0.05).collect()) == exact
    q = QUERIES["c3_sampled_components"](spark, SF)
    assert q.count() == spark.read.parquet(f"{SF}/embeddings.parquet").count()
