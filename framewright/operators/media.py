"""Image, audio, keyframe and compression operators: Arrow-batched calls of the numpy kernels.

Pixels travel as binary in IMAGE structs and tensors in TENSOR structs. Image rows are large, so sessions that decode media
should set ``spark.sql.execution.arrow.maxRecordsPerBatch`` to 8 to 32.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import audio as au
from ..functions import compress as cp
from ..functions import keyframes as kf
from ..functions import pixels as px
from ..types import AUDIO, IMAGE, TENSOR, MediaError

_CODES = {"float32": "f4", "uint8": "u1", "int8": "i1"}


def image_array(row) -> np.ndarray:
    """H x W x C bytes of an IMAGE value, planar formats included."""
    h, w, c = row["height"], row["width"], row["nChannels"]
    x = np.frombuffer(row["data"], np.uint8)
    return x.reshape(c, h, w).transpose(1, 2, 0) if str(row["format"]).endswith("PLANAR") else x.reshape(h, w, c)


def image_value(x: np.ndarray, origin: str | None = None, format: str = "RGB") -> dict:  # noqa: A002
    return {"origin": origin, "height": x.shape[0], "width": x.shape[1], "nChannels": x.shape[2], "format": format, "data": np.ascontiguousarray(x).tobytes()}


def tensor_array(row) -> np.ndarray:
    return np.frombuffer(row["data"], "<" + _CODES[row["dtype"]]).reshape(list(row["shape"]))


def tensor_value(x: np.ndarray, format: str = "ND") -> dict:  # noqa: A002
    return {"shape": list(x.shape), "dtype": x.dtype.name, "format": format, "data": np.ascontiguousarray(x).tobytes()}


def per_row(kernel: Callable, schema: str, permissive: bool = False) -> Callable:
    """A pandas UDF that calls ``kernel`` on each row's value; a null gives nulls.

    With ``permissive`` a media error doesn't fail the job: the row's fields are null and a further field ``_error`` has the message (null elsewhere).
    """
    names = [f.split(":")[0].strip() for f in _fields(schema)]
    if permissive:
        schema = schema[: schema.rindex(">")] + ", _error: string>"

    @F.pandas_udf(schema)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for values in batches:
            for some in _slices(_records(values)):
                columns = {n: [] for n in names}
                errors = []
                for v in some:
                    missing, error = v is None or (isinstance(v, dict) and v.get("data", 0) is None), None
                    out = None
                    try:
                        out = None if missing else kernel(v)
                    except MediaError as e:
                        if not permissive:
                            raise
                        error = str(e)
                    for n in names:
                        columns[n].append(None if out is None else out[n])
                    errors.append(error)
                yield pd.DataFrame(columns | ({"_error": errors} if permissive else {}))

    return run


def _records(values) -> Iterator:
    """The rows of a batch one by one, without a copy of the whole batch."""
    if isinstance(values, pd.DataFrame):
        names = list(values.columns)
        return (dict(zip(names, row)) for row in zip(*(values[n] for n in names)))
    return iter(values)


def _slices(records: Iterator, rows: int = 256, most: int = 32 << 20) -> Iterator[list]:
    """The rows of a batch a few at a time, by number and bytes: results leave before the next are made, so a batch's results never lie in memory together."""
    some, size = [], 0
    for r in records:
        some.append(r)
        data = r.get("data") if isinstance(r, dict) else r
        size += len(data) if isinstance(data, (bytes, bytearray)) else 0
        if len(some) == rows or size >= most:
            yield some
            some, size = [], 0
    if some:
        yield some


def stacked(kernel: Callable[[np.ndarray], np.ndarray], image: Column, schema: str, wrap: Callable, permissive: bool = False) -> Column:
    """``kernel`` over stacks of equally large images (n x H x W x C): one call for each shape of a batch, not for each row. Without ``permissive`` only: an error
    must name its own row, so a permissive call goes row by row."""
    if permissive:
        return per_row(lambda i: wrap(kernel(image_array(i)[None])[0], i["origin"], i["format"]), schema, True)(image)

    @F.pandas_udf(schema)
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split(":")[0].strip() for f in _fields(schema)]
        for values in batches:
            for rows in _slices(_records(values)):
                groups: dict = {}
                for k, i in enumerate(rows):
                    if i["data"] is not None:
                        groups.setdefault((i["height"], i["width"], i["nChannels"]), []).append(k)
                out: list = [None] * len(rows)
                for (h, w, c), own in groups.items():
                    many = max(1, min(64, (32 << 20) // max(1, h * w * c)))
                    for at in range(0, len(own), many):
                        some = own[at : at + many]
                        for k, x in zip(some, kernel(np.stack([image_array(rows[k]) for k in some]))):
                            out[k] = wrap(x, rows[k]["origin"], rows[k]["format"])
                yield pd.DataFrame({n: [None if o is None else o[n] for o in out] for n in names})

    return run(image)


def _fields(schema: str) -> list[str]:
    inner, depth, out, word = schema[schema.index("<") + 1 : schema.rindex(">")], 0, [], ""
    for c in inner:
        depth += c == "<"
        depth -= c == ">"
        if c == "," and not depth:
            out.append(word)
            word = ""
        else:
            word += c
    return [*out, word]


def crop(image: Column, top: int, left: int, height: int, width: int, permissive: bool = False) -> Column:
    return stacked(lambda x: px.crop_stack(x, top, left, height, width), image, IMAGE, image_value, permissive)


def resize(image: Column, width: int, height: int, permissive: bool = False) -> Column:
    return stacked(lambda x: px.resize_stack(x, width, height), image, IMAGE, image_value, permissive)


def area_resize(image: Column, width: int, height: int, permissive: bool = False) -> Column:
    """Mean over the source area of each target pixel."""
    return stacked(lambda x: px.area_stack(x, width, height), image, IMAGE, image_value, permissive)


def bounded_resize(image: Column, target_height: int = 720, permissive: bool = False) -> Column:
    """Images whose area exceeds that of a 16:9 frame of ``target_height`` are shrunk to it by area means; others stay as they are."""
    return stacked(lambda x: px.area_stack(x, *px.bounded_size(x.shape[1], x.shape[2], target_height)[::-1]), image, IMAGE, image_value, permissive)


def to_tensor(image: Column, layout: str = "NCHW", permissive: bool = False) -> Column:
    return stacked(lambda x: px.to_tensor(x, layout)[:, None], image, TENSOR, lambda t, *_: tensor_value(t, layout), permissive)


def into_bytes(tensor: Column, permissive: bool = False) -> Column:
    """Floats times 255 as bytes, without clipping; other integers cast."""
    return per_row(lambda t: tensor_value(px.to_bytes(tensor_array(t)), t["format"]), TENSOR, permissive)(tensor)


def normalize(tensor: Column, mean: tuple, std: tuple, scale: float = 1.0, permissive: bool = False) -> Column:
    return per_row(lambda t: tensor_value(px.normalize(tensor_array(t), mean, std, t["format"], scale), t["format"]), TENSOR, permissive)(tensor)


def resize_crop(tensor: Column, resize_to: tuple, crop_to: tuple, mode: str = "bilinear", pos: tuple = (0.5, 0.5), round_mode: str = "truncate", permissive: bool = False) -> Column:
    return per_row(lambda t: tensor_value(px.resize_crop(tensor_array(t), resize_to, crop_to, mode, pos, round_mode), "NCHW"), TENSOR, permissive)(tensor)


def preprocess(image: Column, resize_to: tuple, crop_to: tuple, mean: tuple, std: tuple, permissive: bool = False, **options) -> Column:
    """to_tensor, resize_crop and normalize in one exchange with Python, a stack of images at a time."""
    return stacked(lambda x: px.fused_preprocess(x, resize_to, crop_to, mean, std, **options)[:, None], image, TENSOR, lambda t, *_: tensor_value(t, "NCHW"), permissive)


def set_format(tensor: Column, format: str) -> Column:  # noqa: A002
    """Relabel without moving data; anything but ND needs four dimensions."""
    ok = (F.lit(format) == "ND") | (F.size(tensor["shape"]) == 4)
    return F.when(ok, tensor.withField("format", F.lit(format))).otherwise(F.raise_error(F.lit("only a tensor of four dimensions has that format")))


def num_bytes(value: Column) -> Column:
    return F.length(value["data"])


def tiles(image: Column, size: int = 448, min_num: int = 1, max_num: int = 12, thumbnail: bool = True, permissive: bool = False) -> Column:
    return stacked(lambda x: px.tiles_stack(x, size, min_num, max_num, thumbnail), image, TENSOR, lambda t, *_: tensor_value(t, "NCHW"), permissive)


PATCHES = "struct<shape: array<int>, dtype: string, format: string, data: binary, grid: array<int>>"


def image_patches(image: Column, permissive: bool = False, **options) -> Column:
    """Patches and grid of one image for a vision-language model."""

    def run(x: np.ndarray) -> list:
        p, grid = px.patches_stack([x], **options)
        return [(one, list(grid)) for one in p]

    return stacked(run, image, PATCHES, lambda p, *_: {**tensor_value(p[0]), "grid": p[1]}, permissive)


def video_patches(frames: DataFrame, video: str, index: str, image: str, parts: int | None = None, **options) -> DataFrame:
    """Patches of each video by pairs of its frames in order: video, pair, shape, dtype, format, data, grid (of the whole video). Row-wise one after another the pairs' patches are the video's.

    A task holds two frames, never a video; an odd last frame is paired with itself. All frames take the size of the video's first.
    ``parts`` is the number of partitions for the images; without it Spark chooses by compressed bytes, which may be few.
    """
    from pyspark.sql import Window

    f = frames.select(F.col(video).alias("video"), F.col(index).alias("index"), F.col(image).alias("image"))
    small = f.select("video", "index", F.col("image.height").alias("h"), F.col("image.width").alias("w"))
    own = Window.partitionBy("video").orderBy("index")
    place = small.withColumn("place", F.row_number().over(own) - 1).withColumn("h0", F.first("h").over(own)).withColumn("w0", F.first("w").over(own))
    place = place.withColumn("frames", F.count(F.lit(1)).over(Window.partitionBy("video"))).select("video", "index", "place", "h0", "w0", "frames")
    # The plan's sizes are those of the table that images are made of: without the hint the images themselves may be broadcast.
    by = lambda df, *keys: df.repartition(parts, *keys) if parts else df.repartition(*keys)
    paired = by(f, "video", "index").join(place.hint("merge"), ["video", "index"]).withColumn("pair", F.floor(F.col("place") / 2))
    paired = paired.select("video", "pair", "place", "h0", "w0", "frames", *[F.col(f"image.{n}").alias(n) for n in ("height", "width", "nChannels", "format", "data")])
    paired = by(paired, "video", "pair").sortWithinPartitions("video", "pair", "place")

    def patches(pairs: list[list[dict]]) -> pd.DataFrame:
        groups: dict = {}
        for k, p in enumerate(pairs):
            groups.setdefault((p[0]["h0"], p[0]["w0"], *[(r["height"], r["width"], r["nChannels"]) for r in p]), []).append(k)
        rows: list = [None] * len(pairs)
        for key, own in groups.items():
            many = max(1, min(32, (16 << 20) // max(1, key[2][0] * key[2][1] * key[2][2])))
            for at in range(0, len(own), many):
                some = own[at : at + many]
                frames = [np.stack([image_array(pairs[k][t]) for k in some]) for t in range(len(pairs[some[0]]))]
                out, (_, gh, gw) = px.patches_stack(frames, like=key[:2], **options)
                for k, p in zip(some, out):
                    r = pairs[k][0]
                    rows[k] = (r["video"], r["pair"], *tensor_value(p).values(), [-(-r["frames"] // 2), gh, gw])
        return pd.DataFrame(rows, columns=["video", "pair", "shape", "dtype", "format", "data", "grid"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted, the frames of a pair together; the last pair of a batch waits for the next batch."""
        pairs: list[list[dict]] = []
        for b in batches:
            for r in _records(b):
                if pairs and (pairs[-1][0]["video"], pairs[-1][0]["pair"]) == (r["video"], r["pair"]):
                    pairs[-1].append(r)
                    continue
                if len(pairs) >= 128 or sum(len(x["data"]) for p in pairs[-1:] for x in p) * len(pairs) >= 32 << 20:
                    yield patches(pairs)
                    pairs = []
                pairs.append([r])
        if pairs:
            yield patches(pairs)

    return paired.mapInPandas(run, f"video {frames.schema[video].dataType.simpleString()}, pair long, shape array<int>, dtype string, format string, data binary, grid array<int>")


def model_inputs(images: DataFrame | None, videos: DataFrame | None) -> DataFrame | None:
    """Where both are given videos win and images are dropped, as in the behaviour that is reproduced."""
    return videos if videos is not None else images


def perceptual_hash(image: Column, block: int = 16) -> Column:
    """block * block bits in words of 64, as array<bigint>; bit 0 of a word is its first."""

    @F.pandas_udf("array<bigint>")
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for b in batches:
            for rows in _slices(_records(b), 64):
                groups: dict = {}
                for k, r in enumerate(rows):
                    groups.setdefault((r["height"], r["width"], r["nChannels"]), []).append(k)
                out: list = [None] * len(rows)
                for own in groups.values():
                    bits = px.hash_stack(np.stack([image_array(rows[k]) for k in own]), block)
                    bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 64)))
                    for k, words in zip(own, np.packbits(bits, axis=1, bitorder="little").view("<i8").tolist()):
                        out[k] = words
                yield pd.Series(out)

    return run(image)


# ---- long-form pixels: the same semantics as expressions over (y, x, channel, value) rows


def crop_rows(pixels: DataFrame, top: int, left: int, height: int, width: int) -> DataFrame:
    return pixels.filter(F.col("y").between(top, top + height - 1) & F.col("x").between(left, left + width - 1)).withColumn("y", F.col("y") - top).withColumn("x", F.col("x") - left)


def normalize_rows(pixels: DataFrame, mean: tuple, std: tuple) -> DataFrame:
    """Bytes to 0..1, less the channel's mean, by its deviation."""
    m, s = F.array(*map(F.lit, mean)), F.array(*map(F.lit, std))
    at = (F.col("c") + 1).cast("int")
    return pixels.withColumn("value", (F.col("value") / 255.0 - F.element_at(m, at)) / F.element_at(s, at))


def patch_position(y: Column, x: Column, c: Column, t: Column, gw: Column, gh: Column, patch: int = 14, merge: int = 2) -> Column:
    """struct(row, col) of a pixel in the patch matrix: the patchify permutation as index arithmetic."""
    by, bx = F.floor(y / patch), F.floor(x / patch)
    sy, sx = F.floor(by / merge), F.floor(bx / merge)
    row = ((F.floor(t / 2) * F.floor(gh / merge) + sy) * F.floor(gw / merge) + sx) * merge * merge + by % merge * merge + bx % merge
    col = ((c * 2 + t % 2) * patch + y % patch) * patch + x % patch
    return F.struct(row.cast("long").alias("row"), col.cast("long").alias("col"))


# ---- audio


def resample_audio(audio: Column, rate: int, permissive: bool = False) -> Column:
    """An AUDIO struct at another rate."""
    return per_row(lambda a: {"sample_rate": rate, "samples": au.resample(np.asarray(a["samples"], np.float32), a["sample_rate"], rate)}, AUDIO, permissive)(audio)


def load_audio(content: Column, target: int | None = None, permissive: bool = False) -> Column:
    """AUDIO struct of a WAV file's bytes: mono, resampled on request."""

    def run(data: bytes) -> dict:
        rate, x = au.load(data, target)
        return {"sample_rate": rate, "samples": x.astype(np.float32)}

    return per_row(run, AUDIO, permissive)(content)


def chunk_audio(clips: DataFrame, key: str, audio: str, length: float = 30, least: float = 1, rate: int = 16000) -> DataFrame:
    """(key, chunk, start, end, samples) of each clip at ``rate``."""
    schema = f"{key} {clips.schema[key].dataType.simpleString()}, chunk int, start double, end double, samples array<float>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, a in zip(b[key], b[audio]):
                x = au.resample(np.asarray(a["samples"], np.float32), a["sample_rate"], rate)
                out += [(k, i, s, e, v.astype(np.float32)) for i, (s, e, v) in enumerate(au.chunks(x, rate, length, least))]
            yield pd.DataFrame(out, columns=[key, "chunk", "start", "end", "samples"])

    return clips.select(key, audio).mapInPandas(run, schema)


def pcm16(sample: Column) -> Column:
    """A 16-bit sample as a float within -1..1."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), sample / F.lit(32768.0)))


def mono_rows(samples: DataFrame, key: str, frame: str, value: str) -> DataFrame:
    return samples.groupBy(key, frame).agg(F.avg(value).alias(value))


def chunk_rows(samples: DataFrame, key: str, index: str, size: int, least: int) -> DataFrame:
    """Chunk number of each sample; a last chunk of fewer than ``least`` samples goes. Chunks are counted where their samples are, so no side of a join can be broadcast."""
    from pyspark.sql import Window

    c = samples.withColumn("chunk", F.floor(F.col(index) / size)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(key, "chunk")))
    return c.filter(F.col("n") >= least).select(key, "chunk", *[x for x in samples.columns if x != key], "n")


# ---- keyframes


def vectors(values: list) -> np.ndarray:
    """Rows of an item's vectors; a missing one is a zero vector."""
    size = next((len(v) for v in values if v is not None), 1)
    return np.stack([np.zeros(size, np.float32) if v is None else np.asarray(v, np.float32) for v in values])


def _by_item(frames: DataFrame, key: str, index: str, vec: str, kernel: Callable, columns: str) -> DataFrame:
    """Order-dependent loops over one item's frames; items run in parallel, and one must fit into a worker."""
    names = [c.split()[0] for c in columns.split(", ")]

    def run(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(index)
        x = vectors(pdf[vec].tolist())
        rows = kernel(x, pdf)
        return pd.DataFrame([(k[0], *r) for r in rows], columns=[key, *names])

    return frames.groupBy(key).applyInPandas(run, f"{key} {frames.schema[key].dataType.simpleString()}, {columns}")


def scene_intervals(frames: DataFrame, query: list[float], budget: int, key: str = "video", index: str = "frame_idx", vec: str = "embedding", drop: float = 0.025, jump: float = 0.015) -> DataFrame:
    q = np.array(query, np.float32)
    return _by_item(frames.select(key, index, vec), key, index, vec, lambda x, _: [(n, *map(int, i)) for n, i in enumerate(kf.diverse_intervals(kf.cosine(q, x), x, min(budget, len(x)), drop, jump))], "rank int, left int, cand int, right int")


def merged_intervals(intervals: DataFrame, frames: DataFrame, key: str = "video", index: str = "frame_idx", score: str = "score", gap: int = 30, alike: float = 0.015) -> DataFrame:
    """Union of near intervals with like means; the intervals of an item meet its scores in one task."""

    def run(k: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        sims = b.sort_values(index)[score].to_numpy()
        a = a.sort_values("rank")
        rows = kf.merge_intervals(list(zip(a["left"], a["right"])), sims, gap, alike) if len(a) else []
        return pd.DataFrame([(k[0], n, int(lo), int(hi)) for n, (lo, hi) in enumerate(rows)], columns=[key, "rank", "left", "right"])

    kind = frames.schema[key].dataType.simpleString()
    return intervals.groupBy(key).cogroup(frames.select(key, index, score).groupBy(key)).applyInPandas(run, f"{key} {kind}, rank int, left int, right int")


def keyframes(frames: DataFrame, query: list[float], budget: int, method: str = "range", key: str = "video", index: str = "frame_idx", vec: str = "embedding", **options) -> DataFrame:
    """Keyframes of each item: ``range`` (scenes, merged and resampled) or ``diverse`` (apart from each other)."""
    q = np.array(query, np.float32)
    pick = {"range": kf.range_keyframes, "diverse": kf.diverse_keyframes}[method]
    return _by_item(frames.select(key, index, vec), key, index, vec, lambda x, _: [(int(i),) for i in pick(q, x, min(budget, len(x)), **options)], "frame_idx int")


def adaptive_frames(frames: DataFrame, total: int = 24, key: str = "video", index: str = "frame_idx", score: str = "score", **options) -> DataFrame:
    """Frames by adaptive halving with shared quotas."""

    def run(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        s = pdf.sort_values(index)[score].to_numpy()
        return pd.DataFrame([(k[0], int(i)) for i in kf.adaptive_segments(s, total, **options)], columns=[key, "frame_idx"])

    return frames.select(key, index, score).groupBy(key).applyInPandas(run, f"{key} {frames.schema[key].dataType.simpleString()}, frame_idx int")


def prefix_budget(parts: DataFrame, key: str, order: str, count: str, budget: int) -> DataFrame:
    """How many of each part's items fit into the budget, parts in order."""
    from pyspark.sql import Window

    before = F.coalesce(F.sum(count).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.withColumn("taken", F.greatest(F.lit(0), F.least(F.col(count), budget - before)))


# ---- token compression


def compress_tokens(tokens: DataFrame, key: str = "item", index: str = "token_idx", vec: str = "embedding", tau: float = 0.95, frames: int | None = None, ratio: float | None = None, eps: float | None = None, per_frame: int | None = None) -> DataFrame:
    """(key, center, vec): the centers of each item's tokens, to exactly ceil(n * ratio) ones if asked for. Items of any size are compressed, their similarities in blocks of rows
    (the behaviour that is reproduced leaves items of more than 8192 tokens as they are). A token without a vector counts as a zero vector, which no other resembles.

    Videos are compressed frame by frame first: ``frames`` is the number of frames of each, or ``per_frame`` that of a frame's tokens.
    With ``eps`` the components are found from sampled anchors, as in ``token_components``.
    """

    def kernel(x: np.ndarray, _) -> list:
        c = cp.compress_image(x, tau, eps) if not (frames or per_frame) else cp.compress_video(x, frames or -(-len(x) // per_frame), tau, eps)
        c = c if ratio is None else cp.to_exact(c, cp.target_size(len(x), ratio), tau)
        return [(i, v.tolist()) for i, v in enumerate(c)]

    return _by_item(tokens.select(key, index, vec), key, index, vec, kernel, "center int, vec array<double>")


def token_edges(tokens: DataFrame, key: str = "item", index: str = "token_idx", vec: str = "embedding", tau: float = 0.95, block: int = 1024) -> DataFrame:
    """(key, x, y): an item's tokens x < y of cosine above tau, zero vectors apart.

    A block of tokens is sent once to each pair of blocks that it is in and compared by a matrix product, so no task has more than two blocks, however many tokens an item has.
    """
    kind, place = tokens.schema[key].dataType.simpleString(), tokens.schema[index].dataType.simpleString()
    rows = tokens.select(F.col(key).alias("key"), F.col(index).alias("at"), F.col(vec).alias("vec"))
    sizes = rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    own = rows.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("at"), F.col("blocks")).cast("int"))
    sent = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "at", "vec")

    def run(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["vec"].to_numpy()).astype(np.float64)
        u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        at, side = pdf["at"].to_numpy(), pdf["own"].to_numpy()
        left = np.flatnonzero(side == k[1])
        right = left if k[1] == k[2] else np.flatnonzero(side == k[2])
        a, b = np.nonzero(u[left] @ u[right].T > tau)
        a, b = at[left[a]], at[right[b]]
        if k[1] == k[2]:
            a, b = a[a < b], b[a < b]
        return pd.DataFrame({"key": [k[0]] * len(a), "x": np.minimum(a, b), "y": np.maximum(a, b)})

    return sent.groupBy("key", "i", "j").applyInPandas(run, f"key {kind}, x {place}, y {place}").withColumnRenamed("key", key)


def token_components(tokens: DataFrame, key: str = "item", index: str = "token_idx", vec: str = "embedding", tau: float = 0.95, eps: float | None = None) -> DataFrame:
    """(key, token, component): components of cosine above tau within an item, numbered by their smallest tokens.

    With ``eps`` they are found from sampled anchors (exact where all tokens are anchors) and numbered by their token of greatest degree.
    """

    return _by_item(tokens.select(key, index, vec), key, index, vec, lambda x, _: list(enumerate(map(int, cp.token_labels(x, tau, eps)))), "token int, component int")
