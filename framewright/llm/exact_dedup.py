"""Exact deduplication by content sort.

Texts are normalised by deleting ASCII white space. Sampled splitters range-partition the normalised bytes
(``repartitionByRange``), Spark's external sort puts equal contents next to each other inside a partition, and the
window operator compares each row's whole content with its neighbour's to end a group: that comparison alone decides equality.

Splitters are samples that the driver holds, about a hundred for each partition, so they are made of bounded parts: the first
``PREFIX`` bytes, then a 64-bit hash that orders contents with the same beginning. The sort goes on with the whole bytes. Equal contents have equal
parts, so they are in one partition, whatever the number of partitions.

Skew: a content that fills more than half a partition's share of a sample of the rows is heavy, and only heavy contents get a salt in their sort key, so
they spread over the partitions. Each (content, salt) run elects a leader by the same comparison of neighbours; the leaders of heavy
contents, one a run, are then sorted and compared whole among themselves, which joins the runs across partition boundaries. A digest only
carries a heavy group's result back to its rows.

The text is shuffled once, as it is, and normalised again after the shuffle. DataFrame functions only; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, fresh, partitions

#: Bytes of a content that a splitter holds.
PREFIX = 16
#: Sampled rows for each shuffle partition in the search for heavy contents, and the least number of them that makes a content heavy.
SAMPLED, LEAST = 128, 32


def normalised(text: Column) -> Column:
    """The text without space, tab, line feed, vertical tab, form feed and carriage return; null is empty."""
    out = F.coalesce(text, F.lit(""))
    for code in (32, 10, 9, 13, 11, 12):
        out = F.replace(out, F.lit(chr(code)), F.lit(""))
    return out


def content_hash(norm: Column) -> Column:
    """Orders contents with the same beginning. Contents that share it are still told apart, by comparison."""
    return F.xxhash64(norm)


def heavy_contents(docs: DataFrame, text_col: str = "text") -> list[int]:
    """Hashes of the contents that have more than half a partition's share of the sampled rows or bytes.

    The sample has about ``SAMPLED`` rows for each shuffle partition, of which a heavy content has ``LEAST`` or, for one that is heavy by its bytes, two at least.
    Shares add up to one, so there are at most 4 heavy contents for each partition, however large the table. Only the plan depends on the sample, never the result.
    """
    parts, total = partitions(docs.sparkSession), docs.count()
    if not total:
        return []
    text = F.col(f"`{text_col}`")
    some = docs.select(text.alias("t")).sample(min(1.0, SAMPLED * parts / total), seed=1).select(content_hash(normalised(F.col("t"))).alias("h"), F.coalesce(F.octet_length("t"), F.lit(0)).cast("long").alias("b"))
    per = durable(some.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.sum("b").alias("b")))
    n, b = per.agg(F.sum("n"), F.sum("b")).first()
    if not n:
        return []
    by_rows = (F.col("n") >= LEAST) & (F.col("n") > n / (2 * parts))
    by_bytes = (F.col("n") >= 2) & (F.col("b") > max(1, b) / (2 * parts))
    return [r.h for r in per.filter(by_rows | by_bytes).select("h").collect()] if parts > 1 else []


def content_sort(docs: DataFrame, id_col: str, text_col: str, heavy: list[int], names: dict[str, str]) -> DataFrame:
    """``docs`` in the order of the content sort with further columns, whose names ``names`` gives: norm, n (code points of the original text),
    rn (place in its run, the best first), members (rows of its run) and, where there are ``heavy`` contents, is_heavy and salt."""
    c = {k: F.col(v) for k, v in names.items()}
    text, doc = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    norm = normalised(text)
    keyed, keys = docs.withColumn(names["head"], F.substring(norm.cast("binary"), 1, PREFIX)).withColumn(names["h"], content_hash(norm)), _keys(names, heavy)
    if heavy:
        # Rows without an identifier are spread by the partition that they come from.
        salt = F.pmod(F.xxhash64(doc, F.spark_partition_id()), F.lit(partitions(docs.sparkSession)))
        keyed = keyed.withColumn(names["is_heavy"], c["h"].isin(heavy)).withColumn(names["salt"], F.when(c["is_heavy"], salt.cast("int")).otherwise(0))
    placed = keyed.repartitionByRange(*keys)
    placed = placed.withColumn(names["norm"], normalised(text)).withColumn(names["n"], F.length(F.coalesce(text, F.lit(""))).cast("long"))
    run = Window.partitionBy(*keys, names["norm"])
    return placed.withColumn(names["rn"], F.row_number().over(run.orderBy(c["n"].desc(), doc.asc_nulls_last()))).withColumn(names["members"], F.count(F.lit(1)).over(run))


def _keys(names: dict[str, str], heavy: list[int]) -> list[str]:
    return [names[k] for k in (("head", "h", "salt") if heavy else ("head", "h"))]


def _names(docs: DataFrame) -> dict[str, str]:
    keys = ("head", "h", "is_heavy", "salt", "norm", "n", "rn", "members")
    return dict(zip(keys, fresh(docs, *keys)))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, n_chars_original.

    Of equal contents the row with most code points in the original text stays, then the smallest identifier.
    Null texts equal empty ones. Null identifiers sort last. Repeated rows (same identifier and content) are members
    like any other; exactly one row of a group is kept. An empty table gives an empty result. Other columns are ignored,
    whatever their names.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    names = {k: k for k in _names(rows)}
    heavy = heavy_contents(rows)
    run = Window.partitionBy(*_keys(names, heavy), "norm").orderBy(F.desc("n"), F.asc_nulls_last("doc_id"))
    done = content_sort(rows, "doc_id", "text", heavy, names).withColumn("keep_id", F.first("doc_id").over(run))
    digest = F.sha2(F.col("norm").cast("binary"), 256)
    if not heavy:
        return _result(done.withColumn("sha", digest).withColumn("kept", F.col("rn") == 1).withColumnRenamed("members", "group_size"))
    small = durable(
        done.select("doc_id", "keep_id", "n", "head", "h", "salt", "rn", "members", "is_heavy", digest.alias("sha"), F.when(F.col("is_heavy") & (F.col("rn") == 1), F.col("norm")).alias("norm"))
    )
    light = small.filter(~F.col("is_heavy")).withColumn("kept", F.col("rn") == 1).withColumnRenamed("members", "group_size")
    # One leader for each run of a heavy content, no more than there are partitions: neighbours in this sort are compared whole again.
    group = Window.partitionBy("head", "h", "norm")
    best = group.orderBy(F.desc("n"), F.asc_nulls_last("doc_id"), "salt")
    leaders = small.filter(F.col("is_heavy") & (F.col("rn") == 1)).select(
        F.col("sha").alias("l_sha"), F.col("salt").alias("l_salt"), F.first("doc_id").over(best).alias("keep_id"), F.first("salt").over(best).alias("keep_salt"), F.sum("members").over(group).alias("group_size")
    )
    joined = small.filter("is_heavy").drop("keep_id", "members").join(leaders, (F.col("sha") == F.col("l_sha")) & (F.col("salt") == F.col("l_salt")))
    joined = joined.withColumn("kept", (F.col("rn") == 1) & (F.col("salt") == F.col("keep_salt")))
    return _result(light).unionByName(_result(joined))


def _result(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept", F.col("sha").alias("text_sha256"), F.col("n").alias("n_chars_original"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with all their columns: one sort, through which the rows go whole.

    Of rows that also tie in identifier and length, any one stays.
    """
    names = _names(docs)
    c = {k: F.col(v) for k, v in names.items()}
    heavy = heavy_contents(docs, text_col)
    first = content_sort(docs, id_col, text_col, heavy, names).filter(c["rn"] == 1)
    if heavy:
        first = durable(first)
        best = Window.partitionBy(names["head"], names["h"], names["norm"]).orderBy(c["n"].desc(), F.col(f"`{id_col}`").asc_nulls_last(), c["salt"])
        again = first.filter(c["is_heavy"]).withColumn(names["rn"], F.row_number().over(best)).filter(c["rn"] == 1)
        first = first.filter(~c["is_heavy"]).unionByName(again)
    return first.select(*[f"`{x}`" for x in docs.columns])
