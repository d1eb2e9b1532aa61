"""The driver's tables seen as media metadata: frames, objects, documents and spans. Each view has the same SQL beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relations import dot
from ..operators.retrieval import frame_numbers


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(rows: DataFrame, key: str, each: int = 2000) -> DataFrame:
    """``rows`` by ``key`` in one partition for about every ``each`` of them, however few files or row groups they come from.

    For tables of short rows that become large media: their bytes say nothing of the work. What is grouped by the key later needs no further shuffle.
    """
    return rows.repartition(max(1, -(-rows.count() // each)), key)


def query_vector(spark: SparkSession, sf: str) -> DataFrame:
    """One row: the vector of vec_id 0 (the smallest identifier)."""
    return table(spark, sf, "embeddings").filter("vec_id = 0").select(F.col("embedding").alias("qv")).limit(1)


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """video, frame_idx, vec_id, embedding, score (similarity with the query vector, 6 decimals; null without such a vector)."""
    f = frame_numbers(table(spark, sf, "embeddings").withColumnRenamed("label", "video"), "video", "vec_id")
    return f.join(F.broadcast(query_vector(spark, sf)), F.lit(True), "left").withColumn("score", F.round(dot(F.col("embedding"), F.col("qv")), 6)).drop("qv")


FRAMES_SQL = """SELECT vec_id, label AS video, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_idx, embedding,
  round(list_dot_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS score FROM embeddings"""


def points(spark: SparkSession, sf: str) -> DataFrame:
    """Events as frames: user_id, i (in time order), event_id, t (seconds), is_key."""
    e = table(spark, sf, "events").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), (F.col("event_type") == "signup").alias("is_key"))
    return frame_numbers(e.withColumn("o", F.struct("t", "event_id")), "user_id", "o", "i").drop("o")


POINTS_SQL = """SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, event_type = 'signup' AS is_key, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) - 1 AS i FROM events"""


def spans(spark: SparkSession, sf: str) -> DataFrame:
    """Three spans for each user: user_id, pos, lo, hi."""
    r = points(spark, sf).groupBy("user_id").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    r = r.withColumn("pos", F.explode(F.array(*[F.lit(i) for i in range(3)])))
    lo = F.col("a") + F.col("pos") * (F.col("b") - F.col("a")) / 4
    return r.select("user_id", "pos", lo.alias("lo"), (lo + (F.col("b") - F.col("a")) / 3).alias("hi"))


SPANS_SQL = f"""SELECT user_id, pos, a + pos * (b - a) / 4 AS lo, a + pos * (b - a) / 4 + (b - a) / 3 AS hi
  FROM (SELECT user_id, min(t) AS a, max(t) AS b FROM ({POINTS_SQL}) GROUP BY user_id), (SELECT unnest([0, 1, 2]) AS pos)"""


def objects(spark: SparkSession, sf: str) -> DataFrame:
    """Detected objects: frame, pos, label, box [x1, y1, x2, y2] in 640 x 480."""
    x, y = F.col("l_partkey") * 7 % 600, F.col("l_suppkey") * 13 % 400
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("frame"),
        F.col("l_linenumber").alias("pos"),
        F.concat("l_returnflag", "l_linestatus").alias("label"),
        F.array(x, y, x + F.col("l_quantity").cast("long") + 10, y + F.col("l_linenumber") * 9 + 10).alias("box"),
    )


OBJECTS_SQL = """SELECT l_orderkey AS frame, l_linenumber AS pos, l_returnflag || l_linestatus AS label,
  [l_partkey * 7 % 600, l_suppkey * 13 % 400, l_partkey * 7 % 600 + CAST(floor(l_quantity) AS BIGINT) + 10, l_suppkey * 13 % 400 + l_linenumber * 9 + 10] AS box FROM lineitem"""


def hashes(spark: SparkSession, sf: str) -> DataFrame:
    """Frames with a 64-bit hash in two words: components above the frame's median."""
    f = frames(spark, sf)
    s = F.array_sort(F.transform("embedding", lambda x: x.cast("double")))
    med = (s[31] + s[32]) / 2
    word = lambda a: F.aggregate(F.sequence(F.lit(0), F.lit(31)), F.lit(0).cast("bigint"), lambda acc, i: acc + F.when(F.element_at(F.col("embedding"), i + a + 1).cast("double") > F.col("med"), F.pow(F.lit(2.0), i).cast("bigint")).otherwise(0))
    return f.withColumn("med", med).withColumn("bits", F.array(word(0), word(32))).select("video", "frame_idx", "bits")


HASH_SQL = f"""SELECT video, frame_idx, list_transform(embedding, lambda x: x::DOUBLE > med) AS bits FROM (
  SELECT *, (list_sort(embedding::DOUBLE[])[32] + list_sort(embedding::DOUBLE[])[33]) / 2 AS med FROM ({FRAMES_SQL}))"""
