"""Index sampling as column expressions and joins (all inside generated code, no Python on the executors)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seq(lo, hi) -> Column:
    """lo..hi inclusive; empty where hi < lo (Spark's own sequence would count down)."""
    lo, hi = (x if isinstance(x, Column) else F.lit(x) for x in (lo, hi))
    return F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))


def int_linspace(lo: Column, hi: Column, k: Column) -> Column:
    """k integers from lo to hi: lo + i * step in double precision, cut; the last is hi, a single one is lo."""
    step = (hi - lo).cast("double") / F.greatest(k - 1, F.lit(1))
    return F.transform(seq(F.lit(0).cast("long"), k.cast("long") - 1), lambda i: F.when((i == k - 1) & (k > 1), hi.cast("long")).otherwise(F.floor(lo + i * step)))


def uniform_by_count(n: Column, s: Column) -> Column:
    """Distinct i * (n - 1) div (s - 1); of one sample, 0."""
    s1 = F.greatest(s - 1, F.lit(1))
    return F.array_distinct(F.transform(seq(F.lit(0).cast("long"), s.cast("long") - 1), lambda i: F.floor(i * (n - 1) / s1)))


def frame_indices(force: Column, avg_fps: Column, total: Column, fps: Column, most: Column) -> Column:
    """Forced: ``most`` evenly spaced, repeats included. Else every max(1, round(avg/fps))-th, at most ``most``. Halves are rounded to even."""
    step = F.greatest(F.lit(1).cast("long"), F.bround(avg_fps / fps).cast("long"))
    count = F.ceil(F.least(total, most * step) / step)
    return F.when(force, int_linspace(F.lit(0), total - 1, most)).otherwise(F.transform(seq(F.lit(0).cast("long"), F.least(count, most.cast("long")) - 1), lambda i: i * step))


def uniform_k(n: Column, k: Column) -> Column:
    return F.when(k >= n, seq(F.lit(0).cast("long"), n.cast("long") - 1)).otherwise(int_linspace(F.lit(0), n - 1, k))


def downsample(n: Column, k: Column) -> Column:
    """Indices of k of n items; null (the caller's error) where k > n or k <= 0; of one, the middle."""
    return F.when((k > n) | (k <= 0), F.lit(None).cast("array<bigint>")).when(k == n, seq(F.lit(0).cast("long"), n.cast("long") - 1)).when(k == 1, F.array(F.floor(n / 2))).otherwise(int_linspace(F.lit(0), n - 1, k))


def crop_offset(pos: Column, size: Column, cut: Column, mode: str = "round") -> Column:
    x = pos * (size - cut)
    return F.greatest(F.lit(0).cast("long"), F.round(x).cast("long") if mode == "round" else x.cast("long"))


def smart_size(h: Column, w: Column, factor: int = 28, min_pixels: int = 3136, max_pixels: int = 1003520) -> Column:
    """struct(h, w) of multiples of ``factor``; null where a side is too small or the ratio above 200."""
    h, w = h.cast("double"), w.cast("double")
    a, b = F.bround(h / factor) * factor, F.bround(w / factor) * factor
    big, small = F.sqrt(h * w / max_pixels), F.sqrt(min_pixels / (h * w))
    pick = lambda x, r: F.when(a * b > max_pixels, F.floor(x / big / factor) * factor).when(a * b < min_pixels, F.ceil(x * small / factor) * factor).otherwise(r).cast("long")
    ok = (F.least(h, w) >= factor) & (F.greatest(h, w) / F.least(h, w) <= 200)
    return F.when(ok, F.struct(pick(h, a).alias("h"), pick(w, b).alias("w")))


def bounded_size(h: Column, w: Column, target: int = 720) -> Column:
    """struct(h, w): kept up to target x (target * 16 div 9) pixels, else shrunk to that area."""
    most = target * (target * 16 // 9)
    k = F.sqrt(F.lit(float(most)) / (h * w))
    fit = h * w <= most
    return F.struct(F.when(fit, h).otherwise(F.floor(h * k)).cast("long").alias("h"), F.when(fit, w).otherwise(F.floor(w * k)).cast("long").alias("w"))


def tile_grid(width: Column, height: Column, min_num: int = 1, max_num: int = 12, size: int = 448) -> Column:
    """struct(cols, rows): an ordered fold over the literal list of ratios; a tie takes the later one if the image has the pixels."""
    ratios = sorted({(i, j) for i in range(1, max_num + 1) for j in range(1, max_num + 1) if min_num <= i * j <= max_num}, key=lambda r: (r[0] * r[1], r))
    start = F.struct(F.lit(1).alias("cols"), F.lit(1).alias("rows"), F.lit(float("inf")).alias("d"))
    ar, area = width / height, width * height

    def fold(acc: Column, r: Column) -> Column:
        d = F.abs(ar - r["i"] / r["j"])
        take = (d < acc["d"]) | ((d == acc["d"]) & (area > 0.5 * size * size * r["i"] * r["j"]))
        return F.struct(F.when(take, r["i"]).otherwise(acc["cols"]).alias("cols"), F.when(take, r["j"]).otherwise(acc["rows"]).alias("rows"), F.when(take, d).otherwise(acc["d"]).alias("d"))

    return F.aggregate(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ratios]), start, fold)


def fps_of(avg: Column, nominal: Column, frames: Column, duration: Column) -> Column:
    """The average rate, else the nominal one, else frames by duration."""
    good = lambda c: F.when(c > 0, c.cast("double"))
    return F.coalesce(good(avg), good(nominal), good(frames) / good(duration))


def frames_of(frames: Column, duration: Column, fps: Column) -> Column:
    return F.when(frames > 0, frames.cast("long")).otherwise((duration * fps).cast("long"))


def rate_of(text: Column) -> Column:
    """"30000/1001" as a number; null for a zero denominator."""
    p = F.split(text, "/")
    d = F.coalesce(F.try_element_at(p, F.lit(2)).cast("double"), F.lit(1.0))
    return F.when(d != 0, p[0].cast("double") / d)


def compress_target(n: Column, ratio: float = 0.3) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.ceil(n * F.lit(ratio)))


def sample_positions(positions: Column, k: Column) -> Column:
    """k positions: evenly spaced ones of a longer list, a shorter list followed by its last one."""
    n = F.size(positions)
    down = F.transform(int_linspace(F.lit(0), n - 1, k), lambda i: positions[i.cast("int")])
    return F.when(n > k, down).otherwise(F.concat(positions, F.array_repeat(F.element_at(positions, -1), (k - n).cast("int"))))


# ---- relations -------------------------------------------------------------------------------------------------


def sample_in_range(points: DataFrame, spans: DataFrame, k: int, key: str, ts: str, span_id: str, lo: str = "lo", hi: str = "hi", tie: str | None = None) -> DataFrame:
    """(key, span_id, i, ts): with equal timestamps in the order of ``tie`` (which is returned too), of a key's points within a closed span all if at most k, else those of rank int((j + 1) * m / (k + 1)).

    The spans of a key meet only that key's points.
    """
    inside = points.join(spans, key).filter(F.col(ts).between(F.col(lo), F.col(hi)))
    w = Window.partitionBy(key, span_id)
    ranked = inside.withColumn("i", (F.row_number().over(w.orderBy(ts, *([tie] if tie else []))) - 1).cast("long")).withColumn("m", F.count(F.lit(1)).over(w))
    wanted = F.transform(seq(F.lit(0).cast("long"), F.lit(k - 1).cast("long")), lambda j: F.floor((j + 1) * F.col("m") / (k + 1)))
    return ranked.filter((F.lit(k) > 0) & ((F.col("m") <= k) | F.array_contains(wanted, F.col("i")))).select(key, span_id, "i", ts, *([tie] if tie else []))


def indices_by_timestamp(points: DataFrame, wanted: DataFrame, key: str, ts: str, index: str) -> DataFrame:
    """The last index of each wanted timestamp of a key, by equality."""
    return wanted.select(key, ts).distinct().join(points.groupBy(key, ts).agg(F.max(index).alias(index)), [key, ts])


def expand_spans(hits: DataFrame, span: int, key: str, index: str, count: str) -> DataFrame:
    """Sorted union of [i - span, i + span] within 0..count-1."""
    lo, hi = F.greatest(F.lit(0).cast("long"), F.col(index) - span), F.least(F.col(count) - 1, F.col(index) + span)
    return hits.select(key, F.explode(seq(lo.cast("long"), hi.cast("long"))).alias(index)).distinct()


def rerank(docs: DataFrame, key: str, index: str, score: str, k: int) -> DataFrame:
    """At most k rows of a key by score, ties by index; a key with no more than k rows keeps their order (rank = index order)."""
    w = Window.partitionBy(key)
    n = F.count(F.lit(1)).over(w)
    by_score, by_index = F.row_number().over(w.orderBy(F.desc(score), index)).cast("long"), F.row_number().over(w.orderBy(index)).cast("long")
    return docs.withColumn("n", n).withColumn("rank", F.when(F.col("n") <= k, by_index).otherwise(by_score)).filter(F.col("rank") <= k).drop("n")


def top_k(rows: DataFrame, key: str, index: str, score: str, k: int) -> DataFrame:
    """The k greatest scores of a key with their place ascending by score; of equal ones the larger index counts as greater."""
    w = Window.partitionBy(key).orderBy(F.desc(score), F.desc(index))
    best = rows.withColumn("down", F.row_number().over(w)).filter(F.col("down") <= k)
    return best.withColumn("place", F.count(F.lit(1)).over(Window.partitionBy(key)) - F.col("down")).drop("down")


def interval_top(rows: DataFrame, key: str, index: str, score: str, k: int = 2) -> DataFrame:
    """The k best of each interval, ties by index."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), index)).cast("long")).filter(F.col("rank") <= k)


def unique_in_order(rows: DataFrame, key: str, value: str, pos: str) -> DataFrame:
    """Each value of a key once, numbered by first appearance."""
    first = rows.groupBy(key, value).agg(F.min(pos).alias("first"))
    return first.withColumn("i", (F.row_number().over(Window.partitionBy(key).orderBy("first")) - 1).cast("long"))
