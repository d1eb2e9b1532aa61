"""Joins, aggregates, ordered operators and set operations that act on rows of frames, documents and objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---- joins


def key_frame_of(frames: DataFrame, video: str, pts: str, is_key: str, tie: str) -> DataFrame:
    """Frames with ``frame_idx`` in time order and ``key_idx``, the index of the last key frame at or before each (0 if none): a backward
    as-of lookup by one window, without a join."""
    w = Window.partitionBy(video).orderBy(pts, tie)
    numbered = frames.withColumn("frame_idx", (F.row_number().over(w) - 1).cast("long"))
    carry = Window.partitionBy(video).orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, 0)
    return numbered.withColumn("key_idx", F.coalesce(F.last(F.when(F.col(is_key), F.col("frame_idx")), ignorenulls=True).over(carry), F.lit(0)))


def first_covering(events: DataFrame, spans: DataFrame, key: str, ts: str, event_id: str, pos: str, lo: str = "lo", hi: str = "hi", strict_compat: bool = True) -> DataFrame:
    """(event_id, pos) of the first span, in list order, that covers the event, ends included.

    With ``strict_compat`` a hit of position 0 counts as none, as in the behaviour that is reproduced.
    """
    hit = events.join(spans, key).filter(F.col(ts).between(F.col(lo), F.col(hi))).groupBy(event_id).agg(F.min(pos).alias(pos))
    return hit.filter(F.col(pos) != 0) if strict_compat else hit


def object_pairs(objects: DataFrame, frame: str, pos: str, cols: list[str]) -> DataFrame:
    """Pairs of a frame's objects, the earlier first; columns get the suffixes _a and _b."""
    a, b = (objects.select(frame, F.col(pos).alias(f"{pos}_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in cols]) for s in "ab")
    return a.join(b, frame).filter(F.col(f"{pos}_a") < F.col(f"{pos}_b"))


def zip_strict(a: DataFrame, b: DataFrame, key: str, pos: str) -> DataFrame:
    """Rows of equal position; a key whose sides differ in number raises an error when it is read."""
    na, nb = a.groupBy(key).agg(F.count(F.lit(1)).alias("na")), b.groupBy(key).agg(F.count(F.lit(1)).alias("nb"))
    checked = na.join(nb, key, "full").select(key, F.assert_true(F.col("na").eqNullSafe(F.col("nb")), "the sides differ in length").alias("ok"))
    return a.join(b, [key, pos]).join(checked, key).filter("ok is null").drop("ok")


# ---- aggregates


def label_counts(objects: DataFrame, frame: str, label: str, pos: str) -> DataFrame:
    """``Count:[a:2, b:1]`` for each frame, labels in order of first appearance."""
    per = objects.groupBy(frame, label).agg(F.count(F.lit(1)).alias("n"), F.min(pos).alias("first"))
    listed = F.array_sort(F.collect_list(F.struct("first", F.concat_ws(":", label, F.col("n").cast("string")).alias("t"))))
    return per.groupBy(frame).agg(F.concat(F.lit("Count:["), F.array_join(F.transform(listed, lambda x: x["t"]), ", "), F.lit("]")).alias("counts"))


def mean_vector(rows: DataFrame, key: str, vec: str) -> DataFrame:
    """Unit mean of a key's vectors; null where its norm is below 1e-9. Partial sums are by key and dimension."""
    dims = rows.select(key, F.posexplode(vec).alias("d", "x")).groupBy(key, "d").agg(F.avg(F.col("x").cast("double")).alias("m"))
    packed = dims.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda x: x["m"]).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return packed.withColumn("n", norm).select(key, F.when(F.col("n") >= 1e-9, F.transform("v", lambda x: x / F.col("n"))).alias("mean"))


def masked_mean(rows: DataFrame, key: str, vec: str, mask: str) -> DataFrame:
    """Mean over tokens weighted by mask, the sum of masks being at least 1e-9: one row for each key and dimension."""
    dims = rows.select(key, F.col(mask).cast("double").alias("m"), F.posexplode(vec).alias("d", "x"))
    return dims.groupBy(key, "d").agg((F.sum(F.col("x").cast("double") * F.col("m")) / F.greatest(F.sum("m"), F.lit(1e-9))).alias("mean"))


def segment_stats(rows: DataFrame, key: str, score: str, k: int, tie: str) -> DataFrame:
    """Mean, population deviation and mean of the best k less the mean."""
    r = rows.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), tie)))
    return r.groupBy(key).agg(F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"), (F.avg(F.when(F.col("r") <= k, F.col(score))) - F.avg(score)).alias("stand_out"))


def accuracy(samples: DataFrame, answer: Column, guess: Column, seconds: Column, skip: Column) -> DataFrame:
    """Evaluation summary: a guess is right if its first character is; the denominator is all samples that aren't skipped, processed or not."""
    right = (F.substring(F.trim(answer), 1, 1) == F.substring(F.trim(guess), 1, 1)) & (F.length(F.trim(guess)) > 0)
    return samples.filter(~skip).agg(
        F.count(F.lit(1)).alias("total"),
        F.count(guess).alias("processed"),
        F.coalesce(F.sum(F.when(right, 1).otherwise(0)), F.lit(0)).cast("long").alias("passed"),
        (F.coalesce(F.sum(F.when(right, 1).otherwise(0)), F.lit(0)) / F.count(F.lit(1))).alias("accuracy"),
        F.avg(F.when(guess.isNotNull(), seconds)).alias("avg_seconds"),
    )


def majority(rows: DataFrame, key: str, value: str, pos: str, first: int = 5, default: str = "English") -> DataFrame:
    """The most frequent value of a key's first positions, ties by first appearance; ``default`` where all are null."""
    votes = rows.filter(F.col(pos) < first).groupBy(key, value).agg(F.count(value).alias("n"), F.min(pos).alias("p"))
    w = Window.partitionBy(key).orderBy(F.desc("n"), "p")
    return votes.withColumn("r", F.row_number().over(w)).filter("r = 1").select(key, F.coalesce(value, F.lit(default)).alias("language"))


# ---- ordered operators


def changed_frames(frames: DataFrame, video: str, index: str, bits: str, threshold: int = 5, strict_compat: bool = True) -> DataFrame:
    """Frames whose hash (array<bigint> words) differs from the frame before by more than ``threshold`` bits, and the first.

    With ``strict_compat`` a video of one frame has none, as in the behaviour that is reproduced.
    """
    w = Window.partitionBy(video).orderBy(index)
    prev = F.lag(bits).over(w)
    far = F.aggregate(F.zip_with(prev, F.col(bits), lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, x: a + x)
    marked = frames.withColumn("distance", far).withColumn("frames", F.count(F.lit(1)).over(Window.partitionBy(video)))
    kept = marked.filter(F.col("distance").isNull() | (F.col("distance") > threshold))
    return (kept.filter("frames > 1") if strict_compat else kept).drop("frames")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """Rows of length one; a zero vector stays."""
    n = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n))


def adjacent_dedup(rows: DataFrame, key: str, order: str, vec: str, threshold: float = 0.97, laps: int = 2) -> DataFrame:
    """Drop followers whose cosine with the candidate before, kept or not, is ``threshold`` or more; at most ``laps`` times over what is left.

    A lap that drops nothing changes nothing, so all laps are planned; their windows share one partitioning by the key.
    """
    w = Window.partitionBy(key).orderBy(order)
    for _ in range(laps):
        prev = F.lag(vec).over(w)
        rows = rows.withColumn("near", dot(prev, F.col(vec))).filter(F.col("near").isNull() | (F.col("near") < threshold)).drop("near")
    return rows


def text_lines(boxes: DataFrame, page: str, box: str, text: str, label: str, ratio: float = 0.5) -> DataFrame:
    """Recognised text of each page: boxes by (y, x), a line as long as centers lie within ratio * mean height of its first box's, lines from left to right,
    joined without spaces; ``seal`` boxes left out. An ordered fold over one page's boxes."""
    b = boxes.filter(F.col(label) != "seal")
    rows = b.groupBy(page).agg(
        F.array_sort(F.collect_list(F.struct(F.col(box)[1].alias("y0"), F.col(box)[0].alias("x0"), F.col(box)[3].alias("y1"), F.col(text).alias("t")))).alias("bs"),
        F.avg((F.col(box)[3] - F.col(box)[1]).cast("double")).alias("height"),
    )
    start = F.struct(F.lit(-1).alias("line"), F.lit(0.0).alias("center"), F.array().cast("array<struct<line: int, x0: bigint, t: string>>").alias("out"))

    def fold(acc: Column, x: Column) -> Column:
        c = (x["y0"] + x["y1"]) / 2.0
        same = (acc["line"] >= 0) & (F.abs(c - acc["center"]) < ratio * F.col("height"))
        line = F.when(same, acc["line"]).otherwise(acc["line"] + 1)
        item = F.struct(line.alias("line"), x["x0"].cast("long").alias("x0"), x["t"].alias("t"))
        return F.struct(line.alias("line"), F.when(same, acc["center"]).otherwise(c).alias("center"), F.concat(acc["out"], F.array(item)).alias("out"))

    placed = rows.select(page, F.explode(F.aggregate("bs", start, fold)["out"]).alias("o")).select(page, "o.*")
    lines = placed.groupBy(page, "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "t"))), lambda x: x["t"]), "").alias("t"))
    return lines.groupBy(page).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "t"))), lambda x: x["t"]), "\n").alias("text"))


def roughness(rows: DataFrame, key: str, index: str, score: str) -> DataFrame:
    """Mean absolute first difference, to 4 decimals."""
    d = F.abs(F.col(score) - F.lag(score).over(Window.partitionBy(key).orderBy(index)))
    return rows.withColumn("d", d).groupBy(key).agg(F.round(F.avg("d"), 4).alias("roughness"))


def long_enough(docs: DataFrame, text: str, least: int | None = 5) -> DataFrame:
    """Documents of at least ``least`` characters, other columns (their original index) unchanged; null or negative keeps all."""
    return docs if least is None or least < 0 else docs.filter(F.length(text) >= least)
