"""Readers and writers: images, WAV files, evaluation sets, decoded video and a content-keyed extraction cache."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.media import image_value, load_audio
from ..types import IMAGE, LIMITS, MediaError, within


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, image) of JPEG files, decoded in the JVM; sides outside the limits are errors. Spark's BGR is turned to RGB."""
    raw = spark.read.format("image").option("pathGlobFilter", "*.{jpg,jpeg,JPG,JPEG}").load(path)

    @F.pandas_udf(IMAGE)
    def rgb(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.to_dict("records"):
                within("image_side", r["width"], r["height"])
                x = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["nChannels"])
                rows.append(image_value(x[..., 2::-1] if r["nChannels"] >= 3 else np.repeat(x, 3, axis=2), r["origin"]))
            yield pd.DataFrame(rows)

    return raw.select(F.col("image.origin").alias("path"), rgb("image").alias("image"))


def images_from_arrays(spark: SparkSession, arrays: dict[str, np.ndarray]) -> DataFrame:
    """Images that the caller holds: contiguous H x W x 3 bytes."""
    rows = []
    for name, x in arrays.items():
        if x.dtype != np.uint8 or x.ndim != 3 or x.shape[2] != 3 or not x.flags["C_CONTIGUOUS"]:
            raise MediaError(f"{name}: an image is a contiguous height x width x 3 array of bytes")
        within("image_side", *x.shape[:2])
        rows.append((name, tuple(image_value(x, name).values())))
    return spark.createDataFrame(rows, f"path string, image {IMAGE}")


def read_audio(spark: SparkSession, path: str | list[str], target: int | None = None, most_files: int | None = None, permissive: bool = False) -> DataFrame:
    """(path, audio) of ``*.wav`` files in a folder, a file or a list of files; any bad file fails the job, unless ``permissive`` puts its error into its row.

    ``most_files`` refuses larger requests when the plan is built (128 in the behaviour that is reproduced; a cluster needs no such limit).
    """
    if target is not None:
        within("sample_rate", target)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path)
    if most_files is not None and (n := files.select("path").count()) > most_files:
        raise MediaError(f"{n} files are more than {most_files}")
    if permissive:
        return files.select("path", load_audio(F.col("content"), target, True).alias("audio"))
    sized = files.withColumn("content", F.when(F.col("length") <= LIMITS["file_bytes"], F.col("content")).otherwise(F.raise_error(F.concat(F.lit("too large: "), "path"))))
    return sized.select("path", load_audio(F.col("content"), target).alias("audio"))


def read_evaluation(spark: SparkSession, path: str) -> DataFrame:
    """One row for each question of a JSON list of videos, the video's fields repeated."""
    schema = "video_id string, duration string, domain string, sub_category string, url string, questions array<struct<question_id: string, task_type: string, question: string, options: array<string>, answer: string>>"
    return spark.read.schema(schema).json(path, multiLine=True).select("video_id", "duration", "domain", "sub_category", "url", F.explode("questions").alias("q")).select("video_id", "duration", "domain", "sub_category", "url", "q.*")


def wanted_frames(videos: DataFrame, count: str, indices: str | None = None, sample: str | None = None) -> DataFrame:
    """The rows of ``videos`` with a column frame_idx for each frame to decode, in order and once each.

    An explicit list (``indices``) wins over a number of evenly spaced frames (``sample``; -1 or null is none). Nothing asked for, an index outside the video or a
    number that isn't within 1 and the video's frames is an error of the row. Column expressions only.
    """
    n = F.col(count).cast("long")
    listed = F.col(indices).cast("array<bigint>") if indices else F.lit(None).cast("array<bigint>")
    k = F.col(sample).cast("long") if sample else F.lit(None).cast("long")
    fail = lambda text: F.raise_error(F.lit(text)).cast("array<bigint>")
    bad = F.exists(listed, lambda i: i.isNull() | (i < 0) | (i >= n))
    even = F.transform(F.sequence(F.lit(0).cast("long"), k - 1), lambda j: F.when(k == 1, 0).otherwise(F.floor(j * (n - 1) / F.greatest(k - 1, F.lit(1)))).cast("bigint"))
    chosen = (
        F.when(F.size(F.coalesce(listed, F.array())) > 0, F.when(bad, fail("a frame lies outside its video")).otherwise(F.array_sort(F.array_distinct(listed))))
        .when(k.isNull() | (k == -1), fail("neither frames nor their number are given"))
        .when((k < 1) | (k > n), fail("the number of frames doesn't fit the video"))
        .otherwise(F.array_distinct(even))
    )
    return videos.withColumn("frame_idx", F.explode(chosen))


def decode_video(frames_wanted: DataFrame, decoder: Callable[[str, list[int]], Iterator[tuple[int, float, np.ndarray]]], path: str = "path", index: str = "frame_idx", gop: str = "key_idx") -> DataFrame:
    """(path, frame_idx, ts, image): one task for each group of pictures that holds a wanted frame.

    Video codecs aren't part of this library: ``decoder(path, indices)`` yields (index, seconds, RGB array). Filter the wanted indices
    before, so that other groups are never opened; a wanted frame that the decoder doesn't give fails the task.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        wanted = sorted(set(pdf[index].tolist()))
        rows = [(key[0], int(i), float(t), image_value(x, key[0])) for i, t, x in decoder(key[0], wanted)]
        if sorted(r[1] for r in rows) != wanted:
            raise MediaError(f"{key[0]}: frames are missing")
        return pd.DataFrame(rows, columns=["path", "frame_idx", "ts", "image"])

    return frames_wanted.select(F.col(path).alias("path"), F.col(index).alias(index), F.col(gop).alias(gop)).groupBy("path", gop).applyInPandas(run, f"path string, frame_idx int, ts double, image {IMAGE}")


def content_key(content: Column, suffix: str = "") -> Column:
    return F.concat(F.sha2(content, 256), F.lit(suffix))


def frame_cache_key(content: Column, fps: Column | float) -> Column:
    """Key of a video's frames at a rate: the same content at another rate is another entry."""
    rate = fps if isinstance(fps, Column) else F.lit(float(fps))
    return F.concat(F.sha2(content, 256), F.lit("@"), F.format_string("%.6g", rate.cast("double")))


@contextmanager
def _locked(fs, lock, wait: float, stale: float) -> Iterator[None]:
    """Hold a lock file that only one job can create; one that is older than ``stale`` seconds belongs to a job that died."""
    began = time.time()
    while True:
        try:
            fs.create(lock, False).close()
            break
        except Exception:  # it exists: the JVM's exception has no Python class of its own
            if not fs.exists(lock):
                continue
            if time.time() - fs.getFileStatus(lock).getModificationTime() / 1000 > stale:
                fs.delete(lock, False)
            elif time.time() - began > wait:
                raise TimeoutError(f"{lock} is held by another job") from None
            else:
                time.sleep(0.2)
    try:
        yield
    finally:
        fs.delete(lock, False)


def cached(items: DataFrame, cache_path: str, key: str, compute: Callable[[DataFrame], DataFrame], wait: float = 3600, stale: float = 24 * 3600) -> DataFrame:
    """Results of ``compute`` by content key, from a Parquet cache; only keys that it doesn't have yet are computed, once each, and appended.

    ``compute`` keeps the key column. A lock file beside the cache lets one job at a time look up and append, so no key is computed twice.
    """
    spark = items.sparkSession
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(cache_path)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    with _locked(fs, jvm.org.apache.hadoop.fs.Path(cache_path.rstrip("/") + ".lock"), wait, stale):
        todo = items.dropDuplicates([key])
        if fs.exists(path):
            todo = todo.join(spark.read.parquet(cache_path).select(key), key, "left_anti")
        compute(todo).write.mode("append").parquet(cache_path)
    return items.select(key).distinct().join(spark.read.parquet(cache_path).dropDuplicates([key]), key)


def write_summary(summary: DataFrame, path: str) -> None:
    summary.coalesce(1).write.mode("overwrite").json(path)
