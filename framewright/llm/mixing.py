"""Mixing sources to target weights by a low-discrepancy schedule.

* Targets: every source asks for a share of all words by weight; no source may give more than ``max_epochs`` times its
  own words, and what it can't give is reshared by weight. That fixed point is min(cap, weight x level) with one level
  for all, found in closed form by sorting the sources by cap/weight.
* Schedule: slot t takes the golden-ratio point frac(t x phi), mapped through the cumulative weights to a source;
  slots are ranked per source.
* Blocks: a source's documents, shuffled by a hash of the identifier and laid end to end, are cut into blocks of
  ``block_words``; the k-th slot of a source takes its k-th block, going round again for a further epoch. The last
  block is cut where the source's target is met, and a source that the points left short of slots gets them at the
  schedule's end, so each source takes its target to the word.

Positions are prefix sums in two levels (source and hash bucket, then inside the bucket), so a source with a third of
all rows is never in one task; slots are ranked in two levels likewise. The only unpartitioned window runs over the table of
sources (one row each). DataFrame functions only; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, fresh, word_count

#: floor(2**30 / golden ratio), odd: multiples modulo 2**30 visit every point once a period.
_GOLDEN, _PERIOD = 663608941, 1 << 30
_CHUNK = 1 << 16


def sized_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """(doc_id, source, size, h, bucket): words of each text, and the document's place in its source's shuffle."""
    doc = F.col(f"`{id_col}`")
    h = F.md5(F.concat(F.lit(seed), F.coalesce(doc.cast("string"), F.lit(""))).cast("binary"))
    return docs.select(doc.alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), word_count(F.col(f"`{text_col}`")).alias("size"), h.alias("h")).withColumn(
        "bucket", F.substring("h", 1, 3)
    )


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """(source, source_size, target, take): one row per source; sources by code point, null last, weigh ``weights`` in turn."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = Window.orderBy(F.asc_nulls_last("source"))
    every = Window.partitionBy()
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.row_number().over(rank) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("w", w).withColumn("cap", F.col("source_size") * max_epochs)
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), F.asc_nulls_last("source"))
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) / F.sum("w").over(
        by_cap.rowsBetween(0, Window.unboundedFollowing)
    )
    return (
        per.withColumn("level", level)
        .withColumn("level", F.max("level").over(every))
        .select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("w") * F.col("level")).alias("target"))
        .withColumn("take", F.floor(F.col("target") + 0.5))
    )


def slot_schedule(targets: DataFrame, block_words: int) -> DataFrame:
    """(source, k, slot): the k-th block of a source is played at ``slot``."""
    spark = targets.sparkSession
    need = targets.withColumn("need", F.ceil(F.col("take") / block_words)).filter("need > 0")
    n, sources = need.agg(F.coalesce(F.sum("need"), F.lit(0)), F.count(F.lit(1))).first()
    cells = max(1024, 4 * sources)
    order = Window.orderBy(F.asc_nulls_last("source"))
    hi = F.sum("need").over(order.rowsBetween(Window.unboundedPreceding, 0))
    spans = need.select("source", "need", ((hi - F.col("need")) / n if n else F.lit(0.0)).alias("lo"), (hi / n if n else F.lit(0.0)).alias("hi"))
    spans = spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * cells), F.least(F.floor(F.col("hi") * cells), F.lit(cells - 1)))))
    t = F.col("slot")
    fine = F.pmod(F.floor(t / _PERIOD) * 648056, F.lit(1 << 20)) / (1 << 20)
    points = spark.range(n).withColumnRenamed("id", "slot").withColumn("x", (F.pmod(F.pmod(t, F.lit(_PERIOD)) * _GOLDEN, F.lit(_PERIOD)) + fine) / _PERIOD).withColumn("cell", F.floor(F.col("x") * cells))
    hit = points.join(spans, "cell").filter("x >= lo and x < hi").select("source", "need", "slot", F.floor(t / _CHUNK).alias("chunk"))
    # Rank in two levels: slots of earlier chunks, then the place inside the chunk.
    hit = hit.withColumn("inside", F.row_number().over(Window.partitionBy("source", "chunk").orderBy("slot")))
    counts = hit.groupBy("source", "chunk").agg(F.count(F.lit(1)).alias("c"))
    before = counts.withColumn("before", F.coalesce(F.sum("c").over(Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    b = before.select(F.col("source").alias("s2"), F.col("chunk").alias("c2"), "before")
    ranked = hit.join(b, hit["source"].eqNullSafe(b["s2"]) & (hit["chunk"] == b["c2"])).select("source", (F.col("before") + F.col("inside") - 1).alias("k"), "slot", "need").filter("k < need")
    got = counts.groupBy("source").agg(F.sum("c").alias("got")).select(F.col("source").alias("s3"), "got")
    short = need.join(got, need["source"].eqNullSafe(got["s3"]), "left").withColumn("got", F.coalesce("got", F.lit(0))).filter("got < need")
    short = short.join(need.select(F.col("source").alias("s4"), F.row_number().over(order).alias("ix")), F.col("source").eqNullSafe(F.col("s4")))
    tail = short.select("source", "ix", F.explode(F.sequence("got", F.col("need") - 1)).alias("k")).select("source", "k", (F.lit(n) + F.col("k") * sources + F.col("ix") - 1).alias("slot"))
    return ranked.select("source", "k", "slot").unionByName(tail)


def mix_schedule(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, block_words: int = 1024, seed: str = "mix") -> DataFrame:
    """The mixture: for each row of ``docs`` its pieces in play order.

    Columns: doc_id, source, size, source_size, target, row_key (names the row, repeated rows included), slot, epoch, start_word,
    n_words. A row of which nothing is taken has one piece with null slot and no words. Null texts have no words, null sources are a source
    of their own that sorts last, null identifiers are shuffled like any other. The result depends on the rows only, not on partitioning.
    An empty table gives an empty result.
    """
    sized = durable(sized_documents(docs, id_col, text_col, source_col, seed))
    targets = source_targets(sized, weights, max_epochs)
    targets = durable(targets)
    buckets = sized.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    buckets = buckets.withColumn("base", F.coalesce(F.sum("in_bucket").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    t = targets.withColumnRenamed("source", "t_source")
    buckets = buckets.join(t, buckets["source"].eqNullSafe(t["t_source"])).select(F.col("source").alias("b_source"), F.col("bucket").alias("b_bucket"), "base", "source_size", "target", "take")
    inside = Window.partitionBy("source", "bucket").orderBy("h", F.asc_nulls_last("doc_id"), "size")
    placed = (
        sized.withColumn("rn", F.row_number().over(inside))
        .withColumn("at", F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .join(buckets, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bucket") == F.col("b_bucket")))
        .withColumn("at", F.col("at") + F.col("base"))
        .withColumn("row_key", F.concat_ws(":", F.coalesce(F.concat(F.lit("v"), "source"), F.lit("n")), "bucket", F.col("rn").cast("string")))
    )
    # Epochs of a document that begin before the source's target is met; a row without any keeps one row.
    last = F.when((F.col("size") > 0) & (F.col("at") < F.col("take")), F.floor((F.col("take") - 1 - F.col("at")) / F.col("source_size")))
    epochs = placed.withColumn("epoch", F.explode_outer(F.when(last.isNotNull(), F.sequence(F.lit(0).cast("long"), last))))
    begin = F.col("at") + F.col("epoch") * F.col("source_size")
    end = F.least(begin + F.col("size"), F.col("take"))
    pieces = (
        epochs.withColumn("begin", begin)
        .withColumn("end", end)
        .withColumn("k", F.explode_outer(F.when(F.col("epoch").isNotNull(), F.sequence(F.floor(F.col("begin") / block_words), F.floor((F.col("end") - 1) / block_words)))))
        .withColumn("from", F.greatest(F.col("begin"), F.col("k") * block_words))
        .withColumn("to", F.least(F.col("end"), (F.col("k") + 1) * block_words))
    )
    slots = slot_schedule(targets, block_words).select(F.col("source").alias("s_source"), F.col("k").alias("s_k"), "slot")
    return pieces.join(slots, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("k") == F.col("s_k")), "left").select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        "row_key",
        "slot",
        "epoch",
        (F.col("from") - F.col("begin")).alias("start_word"),
        F.when(F.col("slot").isNotNull(), F.col("to") - F.col("from")).otherwise(0).alias("n_words"),
    )


def taken_words(schedule: DataFrame) -> DataFrame:
    """One row for each row of the documents: doc_id, source, size, source_size, target, taken."""
    return (
        schedule.groupBy("row_key")
        .agg(*[F.first(c).alias(c) for c in ("doc_id", "source", "size", "source_size", "target")], F.sum("n_words").cast("long").alias("taken"))
        .drop("row_key")
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """``docs`` as the mixture has them: each row as often as it is taken whole (a cut one counts from half its words on), columns unchanged.

    Rows are counted one by one, those with a null or repeated identifier too. Rows alike in identifier, source and number of words have equal standing in
    the schedule: the copies of such a group go to its rows in the order of their texts' hashes, most copies first.
    """
    key, copies, place, size = fresh(docs, "mix_key", "mix_copies", "mix_place", "mix_size")
    taken = taken_words(mix_schedule(docs, id_col, text_col, source_col, **options)).filter("size > 0")
    per_row = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    times = taken.groupBy(_alike("doc_id", "source", F.col("size")).alias(key)).agg(F.sort_array(F.collect_list(per_row), asc=False).alias(copies)).filter(F.col(copies)[0] > 0)
    out = docs.withColumn(size, word_count(F.col(f"`{text_col}`"))).filter(F.col(size) > 0).withColumn(key, _alike(id_col, source_col, F.col(size))).join(times, key)
    out = out.withColumn(place, F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64(F.col(f"`{text_col}`").cast("string")))))
    out = out.withColumn(copies, F.col(copies)[F.col(place) - 1]).filter(F.col(copies) > 0)
    return out.withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*[f"`{c}`" for c in docs.columns])


def _alike(id_col: str, source_col: str, size: Column) -> Column:
    """One string for each identifier, source and size, nulls apart from all else."""
    doc, source = (F.col(f"`{c}`").cast("string") for c in (id_col, source_col))
    return F.concat_ws(":", size.cast("string"), F.coalesce(F.length(doc), F.lit(-1)).cast("string"), F.coalesce(doc, F.lit("")), F.coalesce(F.concat(F.lit("v"), source), F.lit("n")))
