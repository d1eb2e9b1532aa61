"""Similarity search, scene descriptions, prompts and content caches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import DoubleType, StructField, StructType

from .relations import adjacent_dedup, dot
from .sampling import rerank

#: Numbers of the query vectors that go with one pass over the items: 64 MB.
MOST_NUMBERS = 8 << 20


def range_search(items: DataFrame, queries: DataFrame, vec: str, query_id: str, query_vec: str, threshold: float = 0.25) -> DataFrame:
    """Items with an inner product above ``threshold`` (strictly) with a query of their dimension, in double precision.

    The stated queries go to the tasks as matrices and are compared with the items' batches by matrix products: the items are read once and neither shuffled
    nor multiplied beyond their hits. Queries of more than ``MOST_NUMBERS`` numbers are answered in several passes over the items, by a hash of the whole query row, so that
    many queries of one identifier are spread. Null vectors, and vectors that hold nulls, hit nothing.
    """
    stated = queries.select(F.col(query_id).alias("q"), F.col(query_vec).cast("array<double>").alias("qv")).filter("qv is not null and not exists(qv, x -> x is null)")
    numbers = stated.agg(F.coalesce(F.sum(F.size("qv")), F.lit(0))).first()[0]
    passes, out = max(1, -(-numbers // MOST_NUMBERS)), None
    for p in range(passes):
        part = stated if passes == 1 else stated.filter(F.pmod(F.xxhash64("q", "qv"), F.lit(passes)) == p)
        one = _search(items, part.toArrow(), vec, query_id, threshold)
        out = one if out is None else out.unionByName(one)
    return out


def _search(items: DataFrame, stated: pa.Table, vec: str, query_id: str, threshold: float) -> DataFrame:
    by: dict[int, tuple[list, np.ndarray]] = {}
    lengths = np.array(pc.list_value_length(stated["qv"]).to_pylist(), dtype=np.int64)
    for d in np.unique(lengths[lengths > 0]).tolist():
        own = stated.filter(pa.array(lengths == d))
        by[d] = (own["q"].combine_chunks(), np.array(own["qv"].combine_chunks().flatten(), dtype=np.float64).reshape(-1, d))
    at = items.columns.index(vec)
    schema = StructType([*items.schema.fields, StructField(query_id, from_arrow_type(stated.schema.field("q").type)), StructField("score", DoubleType())])
    names = schema.fieldNames()

    def hits(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        column = batch.column(at)
        size = np.array(pc.list_value_length(column).fill_null(-1))
        for d, (ids, matrix) in by.items():
            rows = np.flatnonzero(size == d)
            flat = column.take(pa.array(rows)).flatten()
            x = np.array(flat.to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, d)
            for lo in range(0, len(rows), 512):  # nulls have become NaN, which is above nothing
                score = x[lo : lo + 512] @ matrix.T
                i, j = np.nonzero(score > threshold)
                if len(i):
                    took = batch.take(pa.array(rows[lo + i]))
                    yield pa.RecordBatch.from_arrays([*took.columns, ids.take(pa.array(j)), pa.array(score[i, j])], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from hits(b)

    return items.mapInArrow(run, schema)


def retrieve_and_rerank(docs: DataFrame, query: Column, key: str, index: str, vec: str, text: str | None = None, least: int = 5, threshold: float = 0.25, near: float = 0.97, laps: int = 2, k: int = 10, score: str = "score") -> DataFrame:
    """Short documents out, similar ones kept, near repeats of the candidate before dropped, the best k by score with their original index."""
    if text:
        docs = docs.filter(F.length(text) >= least)
    hits = docs.withColumn("score", dot(F.col(vec), query)).filter(F.col("score") > threshold)
    return rerank(adjacent_dedup(hits, key, index, vec, near, laps), key, index, score, k)


def yes_probability(no: Column, yes: Column) -> Column:
    return 1 / (1 + F.exp(no - yes))


# ---- scenes


def center(box: Column) -> tuple[Column, Column]:
    """Smaller corner plus half the size, in integers."""
    return box[0] + F.floor((box[2] - box[0]) / 2), box[1] + F.floor((box[3] - box[1]) / 2)


def region(box: Column, width: int, height: int) -> Column:
    """Cell of a 3 x 3 grid: "top_left" to "bottom_right", the middle one "middle_middle"."""
    x, y = center(box)
    col = F.when(x < width / 3, "left").when(x > width * 2 / 3, "right").otherwise("middle")
    row = F.when(y < height / 3, "top").when(y > height * 2 / 3, "bottom").otherwise("middle")
    return F.concat_ws("_", row, col)


def relation(a: Column, b: Column) -> Column:
    """Where a lies as seen from b."""
    (ax, ay), (bx, by) = center(a), center(b)
    dx, dy = ax - bx, ay - by
    meet = (a[0] < b[2]) & (b[0] < a[2]) & (a[1] < b[3]) & (b[1] < a[3])
    ratio = F.abs(dx) / (F.abs(dy) + 1e-6)
    return (
        F.when(meet | ((dx == 0) & (dy == 0)), "overlap")
        .when(ratio > 2, F.when(dx > 0, "right").otherwise("left"))
        .when(ratio < 0.5, F.when(dy > 0, "below").otherwise("above"))
        .when((dx > 0) & (dy > 0), "bottom_right")
        .when((dx > 0) & (dy < 0), "top_right")
        .when((dx < 0) & (dy > 0), "bottom_left")
        .otherwise("top_left")
    )


def describe(objects: DataFrame, frame: str, pos: str, label: str, box: str, width: int, height: int) -> DataFrame:
    """``label[id]@region | a @relation_of b | Count:[a:2, b:1]`` for each frame, counts in order of first appearance.

    One shuffle brings a frame's objects together; pairs and counts are expressions over their list.
    """
    listed = objects.groupBy(frame).agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("pos"), F.col(label).alias("label"), F.col(box).alias("box")))).alias("o"))
    named = lambda x: F.format_string("%s[%d]", x["label"], x["pos"])
    texts = lambda a: F.transform(F.array_sort(a), lambda x: x["t"])
    places = texts(F.transform("o", lambda x: F.struct(x["pos"].alias("a"), F.concat(named(x), F.lit("@"), region(x["box"], width, height)).alias("t"))))
    pair = lambda a, b: F.struct(a["pos"].alias("a"), b["pos"].alias("b"), F.concat(named(a), F.lit(" @"), relation(a["box"], b["box"]), F.lit("_of "), named(b)).alias("t"))
    later = lambda a: F.filter("o", lambda b: b["pos"] > a["pos"])
    pairs = texts(F.flatten(F.transform("o", lambda a: F.transform(later(a), lambda b: pair(a, b)))))
    labels = F.array_distinct(F.transform("o", lambda x: x["label"]))
    counts = F.transform(labels, lambda v: F.concat_ws(":", v, F.size(F.filter("o", lambda x: x["label"] == v)).cast("string")))
    text = F.concat_ws(" | ", F.array_join(places, " | "), F.when(F.size(pairs) > 0, F.array_join(pairs, " | ")), F.concat(F.lit("Count:["), F.array_join(counts, ", "), F.lit("]")))
    return listed.select(frame, text.alias("description"))


# ---- prompts and keywords


def clock(seconds: Column) -> Column:
    """HH:MM:SS of whole seconds."""
    s = seconds.cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def document_block(docs: DataFrame, key: str, text: str, ts: str, title: str) -> DataFrame:
    """A prompt section: non-empty documents by time, one to a line."""
    d = docs.filter(F.length(F.trim(text)) > 0)
    lines = F.array_sort(F.collect_list(F.struct(F.col(ts).alias("ts"), F.col(text).alias("t"))))
    return d.groupBy(key).agg(F.concat(F.lit(title + "\n"), F.array_join(F.transform(lines, lambda x: F.concat(F.lit("["), clock(x["ts"]), F.lit("] "), x["t"])), "\n")).alias("block"))


def language_instruction(language: Column) -> Column:
    """The sentence that names the answer's language; an error for others than English and Chinese."""
    return F.when(language == "English", "Answer in English.").when(language == "Chinese", "请用中文回答。").otherwise(F.raise_error(F.concat(F.lit("no instruction for "), language)))


STOP = ("image", "video", "picture", "frame", "scene")
PATTERNS = ("NOUN", "PROPN", "ADJ NOUN", "NOUN NOUN", "PROPN PROPN", "NOUN ADP NOUN", "ADJ NOUN NOUN", "ADJ ADJ NOUN")


def keywords(phrases: DataFrame, key: str, phrase: str, tags: str, stop: tuple[str, ...] = STOP, patterns: tuple[str, ...] = PATTERNS) -> DataFrame:
    """Distinct lowered phrases of one to three words whose part-of-speech tags form one of the patterns and that aren't stop phrases."""
    return phrases.select(key, F.lower(phrase).alias(phrase), F.array_join(tags, " ").alias("p")).filter(F.col("p").isin(*patterns) & ~F.col(phrase).isin(*stop)).select(key, phrase).distinct()


def cache_misses(items: DataFrame, cache: DataFrame, content: list[str], suffix: str = "") -> DataFrame:
    """Distinct contents, by digest, that the cache doesn't have yet: what is left to compute."""
    digest = F.concat(F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in content]), 256), F.lit(suffix))
    return items.withColumn("content_key", digest).dropDuplicates(["content_key"]).join(cache.select("content_key"), "content_key", "left_anti")


def evict_oldest(cache: DataFrame, used: str, most: int) -> DataFrame:
    """The ``most`` entries used last."""
    return cache.orderBy(F.desc(used), "content_key").limit(most)


def related_frames(parts: list[DataFrame], fallback: DataFrame, key: str, index: str) -> DataFrame:
    """Union of frame hits; a key without any gets its fallback frames."""
    hits = parts[0].select(key, index)
    for p in parts[1:]:
        hits = hits.unionByName(p.select(key, index))
    hits = hits.distinct()
    return hits.unionByName(fallback.select(key, index).join(hits.select(key).distinct(), key, "left_anti")).distinct()


def frame_numbers(rows: DataFrame, key: str, order: str, name: str = "frame_idx") -> DataFrame:
    return rows.withColumn(name, (F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1).cast("long"))
