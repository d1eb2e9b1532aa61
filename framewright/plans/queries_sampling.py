"""Queries of the index sampling, join, aggregate and ordered operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relations as rel
from ..operators import retrieval as ret
from ..operators import sampling as smp
from ..sources import media as src
from .catalog import query
from .sql import register
from .standins import FRAMES_SQL, HASH_SQL, OBJECTS_SQL, POINTS_SQL, SPANS_SQL, frames, hashes, objects, points, query_vector, spans, table

_P = "SELECT p_partkey, {} AS idx FROM part"
#: int_linspace(0, n - 1, k) in DuckDB.
_LIN = "list_transform(range(0, {k}), lambda i: CASE WHEN i = {k} - 1 AND {k} > 1 THEN CAST({n} - 1 AS BIGINT) ELSE CAST(floor(0 + i * (CAST({n} - 1 AS DOUBLE) / greatest({k} - 1, 1))) AS BIGINT) END)"


def _part(spark, sf, idx):
    return table(spark, sf, "part").select("p_partkey", F.posexplode(idx).alias("pos", "idx")).withColumn("pos", F.col("pos").cast("long"))


def _part_sql(expr: str) -> str:
    return f"SELECT p_partkey, pos - 1 AS pos, l[pos] AS idx FROM (SELECT p_partkey, l, unnest(range(1, len(l) + 1)) AS pos FROM (SELECT p_partkey, {expr} AS l FROM part))"


N, K = "(p_size * 3 + 1)", "(p_partkey % 9 + 1)"


@query("x1_uniform_by_count", f"SELECT DISTINCT p_partkey, unnest(list_transform(range(0, {K}), lambda i: i * ({N} - 1) // greatest({K} - 1, 1))) AS idx FROM part")
def x1(spark, sf):
    return _part(spark, sf, smp.uniform_by_count(F.expr(N), F.expr(K))).drop("pos")


_X2 = f"""CASE WHEN p_partkey % 2 = 0 THEN {_LIN.format(n='(p_size * 20)', k='(p_size % 11 + 1)')}
 ELSE list_transform(range(0, least(CAST(ceil(least(p_size * 20, (p_size % 11 + 1) * stp) / CAST(stp AS DOUBLE)) AS BIGINT), CAST(p_size % 11 + 1 AS BIGINT))), lambda i: i * stp) END"""


@query("x2_frame_indices", f"SELECT p_partkey, pos - 1 AS pos, l[pos] AS idx FROM (SELECT p_partkey, l, unnest(range(1, len(l) + 1)) AS pos FROM (SELECT p_partkey, {_X2} AS l FROM (SELECT *, greatest(1, CAST(round_even((24 + p_size % 7) / CAST(1 + p_partkey % 5 AS DOUBLE), 0) AS BIGINT)) AS stp FROM part)))")
def x2(spark, sf):
    return _part(spark, sf, smp.frame_indices(F.expr("p_partkey % 2 = 0"), F.expr("24 + p_size % 7"), F.expr("p_size * 20"), F.expr("1 + p_partkey % 5"), F.expr("p_size % 11 + 1")))


@query("x3_uniform_k", _part_sql(f"CASE WHEN {K} >= {N} THEN range(0, {N}) ELSE {_LIN.format(n=N, k=K)} END"))
def x3(spark, sf):
    return _part(spark, sf, smp.uniform_k(F.expr(N), F.expr(K)))


@query("x4_downsample", _part_sql(f"CASE WHEN {K} > p_size THEN NULL WHEN {K} = p_size THEN range(0, p_size) WHEN {K} = 1 THEN [p_size // 2] ELSE {_LIN.format(n='p_size', k=K)} END"))
def x4(spark, sf):
    return _part(spark, sf, smp.downsample(F.col("p_size"), F.expr(K)))


@query(
    "x5_j4_sample_in_range",
    f"""WITH q AS (SELECT p.user_id, s.pos, p.t, p.event_id, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY p.user_id, s.pos) AS m FROM ({POINTS_SQL}) p JOIN ({SPANS_SQL}) s ON p.user_id = s.user_id AND p.t BETWEEN s.lo AND s.hi
  WINDOW w AS (PARTITION BY p.user_id, s.pos ORDER BY p.t, p.event_id)) SELECT user_id, pos, i, t, event_id FROM q WHERE m <= 4 OR i IN ((1 * m) // 5, (2 * m) // 5, (3 * m) // 5, (4 * m) // 5)""",
)
def x5(spark, sf):
    return smp.sample_in_range(points(spark, sf), spans(spark, sf), 4, "user_id", "t", "pos", tie="event_id")


@query("x6_j3_indices_by_timestamp", f"WITH p AS ({POINTS_SQL}) SELECT user_id, t, max(i) AS i FROM p WHERE (user_id, t) IN (SELECT (user_id, t) FROM p WHERE event_id % 10 = 0) GROUP BY ALL")
def x6(spark, sf):
    p = points(spark, sf)
    return smp.indices_by_timestamp(p, p.filter("event_id % 10 = 0"), "user_id", "t", "i")


@query("x7_r7_expand_spans", f"WITH p AS ({POINTS_SQL}), n AS (SELECT user_id, count(*) AS n FROM p GROUP BY 1) SELECT DISTINCT user_id, unnest(range(greatest(0, i - 2), least(n - 1, i + 2) + 1)) AS i FROM p JOIN n USING (user_id) WHERE is_key")
def x7(spark, sf):
    p = points(spark, sf)
    return smp.expand_spans(p.filter("is_key").join(p.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")), "user_id"), 2, "user_id", "i", "n")


@query("x8_rerank", f"""SELECT video, frame_idx, score, rank FROM (SELECT *, CASE WHEN count(*) OVER (PARTITION BY video) <= 12 THEN row_number() OVER (PARTITION BY video ORDER BY frame_idx)
  ELSE row_number() OVER (PARTITION BY video ORDER BY score DESC, frame_idx) END AS rank FROM ({FRAMES_SQL})) WHERE rank <= 12""")
def x8(spark, sf):
    return smp.rerank(frames(spark, sf).select("video", "frame_idx", "score"), "video", "frame_idx", "score", 12)


@query("x9_interval_top", f"SELECT * FROM (SELECT video * 1000 + frame_idx // 10 AS seg, frame_idx, score, row_number() OVER (PARTITION BY video * 1000 + frame_idx // 10 ORDER BY score DESC, frame_idx) AS rank FROM ({FRAMES_SQL})) WHERE rank <= 2")
def x9(spark, sf):
    return smp.interval_top(frames(spark, sf).select((F.col("video") * 1000 + F.floor(F.col("frame_idx") / 10)).alias("seg"), "frame_idx", "score"), "seg", "frame_idx", "score")


@query("x10_top_k", f"SELECT video, frame_idx, score, count(*) OVER (PARTITION BY video) - down AS place FROM (SELECT *, row_number() OVER (PARTITION BY video ORDER BY score DESC, frame_idx DESC) AS down FROM ({FRAMES_SQL})) WHERE down <= 7")
def x10(spark, sf):
    return smp.top_k(frames(spark, sf).select("video", "frame_idx", "score"), "video", "frame_idx", "score", 7)


@query("x11_unique_in_order", "SELECT conv_id, role, first, row_number() OVER (PARTITION BY conv_id ORDER BY first) - 1 AS i FROM (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY ALL)")
def x11(spark, sf):
    return smp.unique_in_order(table(spark, sf, "conversations"), "conv_id", "role", "turn")


@query("x12_time_range_sampling", f"""WITH f AS (SELECT user_id, t, lo, hi, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS r, count(*) OVER (PARTITION BY user_id) AS n FROM ({POINTS_SQL}) p JOIN (SELECT user_id, lo, hi FROM ({SPANS_SQL}) WHERE pos = 1) USING (user_id) WHERE t BETWEEN lo AND hi)
  SELECT user_id, r, t FROM f WHERE list_contains({_LIN.format(n='n', k='least(n, 5)')}, r)""")
def x12(spark, sf):
    f = points(spark, sf).join(spans(spark, sf).filter("pos = 1"), "user_id").filter("t between lo and hi")
    f = ret.frame_numbers(f.withColumn("o", F.struct("t", "event_id")), "user_id", "o", "r").join(f.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")), "user_id")
    return f.filter(F.array_contains(smp.int_linspace(F.lit(0), F.col("n") - 1, F.least("n", F.lit(5))), F.col("r"))).select("user_id", "r", "t")


# ---- plan-time sizes


@query("t7_crop_offset", "SELECT p_partkey, greatest(0, CAST(round(p_size % 5 / 4.0::DOUBLE * (p_size * 7 + 30 - 20)) AS BIGINT)) AS rounded, greatest(0, CAST(trunc(p_size % 5 / 4.0::DOUBLE * (p_size * 7 + 30 - 20)) AS BIGINT)) AS truncated FROM part")
def t7(spark, sf):
    pos, size = F.expr("p_size % 5 / 4.0D"), F.expr("p_size * 7 + 30")
    return table(spark, sf, "part").select("p_partkey", smp.crop_offset(pos, size, F.lit(20)).alias("rounded"), smp.crop_offset(pos, size, F.lit(20), "truncate").alias("truncated"))


_HW = "(p_size * 31 + 5)::DOUBLE AS h, (p_partkey % 1900 + 20)::DOUBLE AS w"


@query(
    "t11_smart_size",
    f"""WITH s AS (SELECT p_partkey, {_HW} FROM part), r AS (SELECT *, round_even(h / 28, 0) * 28 AS a, round_even(w / 28, 0) * 28 AS b FROM s)
 SELECT p_partkey, CAST(CASE WHEN a * b > 1003520 THEN floor(h / sqrt(h * w / 1003520) / 28) * 28 WHEN a * b < 3136 THEN ceil(h * sqrt(3136 / (h * w)) / 28) * 28 ELSE a END AS BIGINT) AS h,
 CAST(CASE WHEN a * b > 1003520 THEN floor(w / sqrt(h * w / 1003520) / 28) * 28 WHEN a * b < 3136 THEN ceil(w * sqrt(3136 / (h * w)) / 28) * 28 ELSE b END AS BIGINT) AS w FROM r WHERE least(h, w) >= 28 AND greatest(h, w) / least(h, w) <= 200""",
)
def t11(spark, sf):
    s = table(spark, sf, "part").select("p_partkey", smp.smart_size(F.expr("p_size * 31 + 5"), F.expr("p_partkey % 1900 + 20")).alias("s"))
    return s.filter("s is not null").select("p_partkey", "s.h", "s.w")


_RATIOS = "[" + ", ".join(f"{{'k': {n}, 'i': {i}, 'j': {j}}}" for n, (i, j) in enumerate(sorted({(i, j) for i in range(1, 13) for j in range(1, 13) if i * j <= 12}, key=lambda r: (r[0] * r[1], r)))) + "]"


@query(
    "t17_tile_grid",
    f"""WITH RECURSIVE s AS (SELECT p_partkey, (p_partkey % 1900 + 20)::DOUBLE AS w, (p_size * 31 + 5)::DOUBLE AS h FROM part), r AS (SELECT unnest({_RATIOS}) AS x),
 f AS (SELECT p_partkey, w, h, 0 AS k, 1 AS cols, 1 AS rws, CAST('infinity' AS DOUBLE) AS d FROM s UNION ALL
 SELECT p_partkey, w, h, k + 1, CASE WHEN t THEN i ELSE cols END, CASE WHEN t THEN j ELSE rws END, CASE WHEN t THEN nd ELSE d END FROM (
   SELECT f.*, x.i AS i, x.j AS j, abs(w / h - x.i / x.j::DOUBLE) AS nd, abs(w / h - x.i / x.j::DOUBLE) < d OR (abs(w / h - x.i / x.j::DOUBLE) = d AND w * h > 0.5::DOUBLE * 448 * 448 * x.i * x.j) AS t FROM f JOIN r ON x.k = f.k))
 SELECT p_partkey, cols, rws AS rows FROM f WHERE k = (SELECT count(*) FROM r)""",
)
def t17(spark, sf):
    return table(spark, sf, "part").select("p_partkey", smp.tile_grid(F.expr("cast(p_partkey % 1900 + 20 as double)"), F.expr("cast(p_size * 31 + 5 as double)")).alias("g")).select("p_partkey", "g.cols", "g.rows")


@query("t21_bounded_size", f"SELECT p_partkey, CAST(CASE WHEN h * w <= 921600 THEN h ELSE floor(h * sqrt(921600::DOUBLE / (h * w))) END AS BIGINT) AS h, CAST(CASE WHEN h * w <= 921600 THEN w ELSE floor(w * sqrt(921600::DOUBLE / (h * w))) END AS BIGINT) AS w FROM (SELECT p_partkey, {_HW} FROM part)")
def t21(spark, sf):
    return table(spark, sf, "part").select("p_partkey", smp.bounded_size(F.expr("p_size * 31 + 5"), F.expr("p_partkey % 1900 + 20")).alias("s")).select("p_partkey", "s.h", "s.w")


@query(
    "s7_s8_probe",
    """WITH s AS (SELECT p_partkey, p_partkey % 3 = 0 AS na, p_partkey % 5 = 0 AS nn, p_size + 23.5::DOUBLE AS avg, (p_size * 1000) || '/' || (CASE WHEN p_size % 7 = 0 THEN 0 ELSE 1001 END) AS rate, p_size * 10 AS n, p_retailprice / 10 AS d FROM part),
 f AS (SELECT *, coalesce(CASE WHEN NOT na THEN avg END, CASE WHEN NOT nn AND split_part(rate, '/', 2) <> '0' THEN split_part(rate, '/', 1)::DOUBLE / split_part(rate, '/', 2)::DOUBLE END, n / d) AS fps FROM s)
 SELECT p_partkey, round(fps, 6) AS fps, CASE WHEN p_partkey % 2 = 0 THEN n ELSE CAST(trunc(d * fps) AS BIGINT) END AS frames FROM f""",
)
def s7(spark, sf):
    t = table(spark, sf, "part").select(
        "p_partkey",
        F.when(F.expr("p_partkey % 3 != 0"), F.expr("p_size + 23.5D")).alias("avg"),
        F.when(F.expr("p_partkey % 5 != 0"), smp.rate_of(F.concat((F.col("p_size") * 1000).cast("string"), F.lit("/"), F.expr("if(p_size % 7 = 0, 0, 1001)").cast("string")))).alias("nominal"),
        F.expr("p_size * 10").alias("n"),
        F.expr("p_retailprice / 10").alias("d"),
    ).withColumn("fps", smp.fps_of(F.col("avg"), F.col("nominal"), F.col("n"), F.col("d")))
    return t.select("p_partkey", F.round("fps", 6).alias("fps"), smp.frames_of(F.when(F.expr("p_partkey % 2 = 0"), F.col("n")), F.col("d"), F.col("fps")).alias("frames"))


@query("s9_second_indices", "SELECT p_partkey, s, CAST(trunc(s * fps) AS BIGINT) AS idx, round(CAST(trunc(s * fps) AS BIGINT) / fps, 6) AS ts FROM (SELECT p_partkey, p_size + 23.976::DOUBLE AS fps, unnest(range(0, p_size % 6 + 1)) AS s FROM part)")
def s9(spark, sf):
    t = table(spark, sf, "part").select("p_partkey", F.expr("p_size + 23.976D").alias("fps"), F.explode(F.sequence(F.lit(0).cast("long"), F.expr("cast(p_size % 6 as bigint)"))).alias("s"))
    return t.select("p_partkey", "s", (F.col("s") * F.col("fps")).cast("long").alias("idx"), F.round((F.col("s") * F.col("fps")).cast("long") / F.col("fps"), 6).alias("ts"))


@query("c7_c8_target_and_positions", f"SELECT p_partkey, greatest(1, CAST(ceil(p_size * 0.3::DOUBLE) AS BIGINT)) AS k, pos - 1 AS pos, l[pos] AS idx FROM (SELECT *, unnest(range(1, len(l) + 1)) AS pos FROM (SELECT p_partkey, p_size, CASE WHEN p_size > {K} THEN list_transform({_LIN.format(n='p_size', k=K)}, lambda i: i + 100) ELSE list_concat(range(100, 100 + p_size), list_transform(range(0, {K} - p_size), lambda i: 99 + p_size)) END AS l FROM part))")
def c7(spark, sf):
    t = table(spark, sf, "part").withColumn("l", smp.sample_positions(F.expr("sequence(100L, 99L + p_size)"), F.expr(K)))
    return t.select("p_partkey", smp.compress_target(F.col("p_size")).alias("k"), F.posexplode("l").alias("pos", "idx")).withColumn("pos", F.col("pos").cast("long"))


# ---- joins


@query("s6_j1_key_frame_of", f"SELECT user_id, event_id, i AS frame_idx, coalesce(last_value(CASE WHEN is_key THEN i END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS key_idx FROM ({POINTS_SQL})")
def j1(spark, sf):
    return rel.key_frame_of(points(spark, sf).drop("i"), "user_id", "t", "is_key", "event_id").select("user_id", "event_id", "frame_idx", "key_idx")


@query("j2_first_covering", f"SELECT event_id, min(pos) AS pos FROM ({POINTS_SQL}) p JOIN ({SPANS_SQL}) s ON p.user_id = s.user_id AND t BETWEEN lo AND hi GROUP BY 1 HAVING min(pos) <> 0")
def j2(spark, sf):
    return rel.first_covering(points(spark, sf), spans(spark, sf), "user_id", "t", "event_id", "pos")


_J5 = "SELECT e.vec_id, q.vec_id AS query_id, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q WHERE list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) > 0.25"


@query("j5_r2_range_search", _J5)
def j5(spark, sf):
    e = table(spark, sf, "embeddings")
    qs = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
    return ret.range_search(e, qs, "embedding", "query_id", "qv").select("vec_id", "query_id", F.round("score", 6).alias("score"))


@query("r3_query_union", f"SELECT vec_id, count(*) AS queries, max(score) AS best FROM ({_J5}) GROUP BY 1")
def r3(spark, sf):
    return j5(spark, sf).groupBy("vec_id").agg(F.count(F.lit(1)).alias("queries"), F.max("score").alias("best"))


@query(
    "r3_average_query",
    """WITH d AS (SELECT i, avg(embedding[i]::DOUBLE) AS m FROM (SELECT embedding, unnest(range(1, 65)) AS i FROM embeddings WHERE vec_id % 50 = 0) GROUP BY 1), n AS (SELECT sqrt(sum(m * m)) AS n FROM d),
 q AS (SELECT list(m / n ORDER BY i) AS q FROM d, n) SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], q), 6) AS score FROM embeddings, q WHERE list_dot_product(embedding::DOUBLE[], q) > 0.25""",
)
def r3b(spark, sf):
    e = table(spark, sf, "embeddings")
    q = rel.mean_vector(e.filter("vec_id % 50 = 0").withColumn("g", F.lit(0)), "g", "embedding")
    return ret.range_search(e, q, "embedding", "g", "mean").select("vec_id", F.round("score", 6).alias("score"))


@query("j6_r10_object_relations", f"""WITH o AS (SELECT *, box[1] + (box[3] - box[1]) // 2 AS cx, box[2] + (box[4] - box[2]) // 2 AS cy FROM ({OBJECTS_SQL})), p AS (SELECT a.frame, a.pos AS pos_a, b.pos AS pos_b, a.cx - b.cx AS dx, a.cy - b.cy AS dy,
  a.box[1] < b.box[3] AND b.box[1] < a.box[3] AND a.box[2] < b.box[4] AND b.box[2] < a.box[4] AS meet FROM o a JOIN o b ON a.frame = b.frame AND a.pos < b.pos), r AS (SELECT *, abs(dx) / (abs(dy) + 1e-6::DOUBLE) AS q FROM p)
  SELECT frame, pos_a, pos_b, CASE WHEN meet OR (dx = 0 AND dy = 0) THEN 'overlap' WHEN q > 2 THEN CASE WHEN dx > 0 THEN 'right' ELSE 'left' END WHEN q < 0.5 THEN CASE WHEN dy > 0 THEN 'below' ELSE 'above' END
  WHEN dx > 0 AND dy > 0 THEN 'bottom_right' WHEN dx > 0 AND dy < 0 THEN 'top_right' WHEN dx < 0 AND dy > 0 THEN 'bottom_left' ELSE 'top_left' END AS relation FROM r""")
def j6(spark, sf):
    return rel.object_pairs(objects(spark, sf), "frame", "pos", ["box"]).select("frame", "pos_a", "pos_b", ret.relation(F.col("box_a"), F.col("box_b")).alias("relation"))


@query("j8_zip_strict", "SELECT a.conv_id, a.turn, a.role, length(b.text) AS n FROM conversations a JOIN conversations b USING (conv_id, turn)")
def j8(spark, sf):
    c = table(spark, sf, "conversations")
    return rel.zip_strict(c.select("conv_id", "turn", "role"), c.select("conv_id", "turn", F.length("text").cast("long").alias("n")), "conv_id", "turn")


# ---- aggregates

_G1 = f"SELECT frame, 'Count:[' || string_agg(label || ':' || n, ', ' ORDER BY first, label || ':' || n) || ']' AS counts FROM (SELECT frame, label, count(*) AS n, min(pos) AS first FROM ({OBJECTS_SQL}) GROUP BY ALL) GROUP BY frame"


@query("g1_label_counts", _G1)
def g1(spark, sf):
    return rel.label_counts(objects(spark, sf), "frame", "label", "pos")


@query("g2_interval_mean", f"SELECT video, frame_idx // 15 AS seg, round(avg(score), 6) AS mean FROM ({FRAMES_SQL}) GROUP BY ALL")
def g2(spark, sf):
    return frames(spark, sf).groupBy("video", F.floor(F.col("frame_idx") / 15).alias("seg")).agg(F.round(F.avg("score"), 6).alias("mean"))


@query("g3_mean_vector", """WITH d AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM (SELECT label, embedding, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY ALL)
  SELECT label, i - 1 AS d, round(m / sqrt(sum(m * m) OVER (PARTITION BY label)), 6) AS x FROM d""")
def g3(spark, sf):
    return rel.mean_vector(table(spark, sf, "embeddings"), "label", "embedding").select("label", F.posexplode("mean").alias("d", "x")).select("label", F.col("d").cast("long").alias("d"), F.round("x", 6).alias("x"))


@query("g4_masked_mean", "SELECT label, i - 1 AS d, round(sum(embedding[i]::DOUBLE * m) / greatest(sum(m), 1e-9), 6) AS mean FROM (SELECT label, embedding, (vec_id % 3 > 0)::INT::DOUBLE AS m, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY label, i")
def g4(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("m", F.expr("if(vec_id % 3 > 0, 1, 0)"))
    return rel.masked_mean(e, "label", "embedding", "m").select("label", F.col("d").cast("long").alias("d"), F.round("mean", 6).alias("mean"))


@query("g7_segment_stats", f"SELECT video, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, round(avg(CASE WHEN r <= 8 THEN score END) - avg(score), 6) AS stand_out FROM (SELECT *, row_number() OVER (PARTITION BY video ORDER BY score DESC, frame_idx) AS r FROM ({FRAMES_SQL})) GROUP BY 1")
def g7(spark, sf):
    s = rel.segment_stats(frames(spark, sf), "video", "score", 8, "frame_idx")
    return s.select("video", *[F.round(c, 6).alias(c) for c in ("mean", "std", "stand_out")])


@query("g8_accuracy", """WITH s AS (SELECT substr('ABCD', CAST(doc_id % 4 + 1 AS INT), 1) AS answer, CASE WHEN doc_id % 7 <> 0 THEN substr('ABCD', CAST(doc_id % 3 + 1 AS INT), 1) || '. option' END AS guess, quality + 0.5 AS sec, doc_id % 5 = 0 AS skip FROM labels)
  SELECT count(*) AS total, count(guess) AS processed, sum(CASE WHEN answer = guess[1:1] THEN 1 ELSE 0 END)::BIGINT AS passed, sum(CASE WHEN answer = guess[1:1] THEN 1 ELSE 0 END) / count(*) AS accuracy, avg(CASE WHEN guess IS NOT NULL THEN sec END)::DOUBLE AS avg_seconds FROM s WHERE NOT skip""")
def g8(spark, sf):
    lab = table(spark, sf, "labels")
    answer, guess = F.expr("substring('ABCD', cast(doc_id % 4 as int) + 1, 1)"), F.when(F.expr("doc_id % 7 != 0"), F.concat(F.expr("substring('ABCD', cast(doc_id % 3 as int) + 1, 1)"), F.lit(". option")))
    return rel.accuracy(lab.withColumn("a", answer).withColumn("g", guess), F.col("a"), F.col("g"), F.col("quality") + F.lit(0.5), F.expr("doc_id % 5 = 0"))


@query("g9_majority", """WITH v AS (SELECT conv_id, CASE WHEN length(text) % 3 = 0 THEN 'Chinese' WHEN length(text) % 3 = 1 THEN 'English' END AS lang, turn FROM conversations WHERE turn < 5),
  c AS (SELECT conv_id, lang, count(lang) AS n, min(turn) AS p FROM v GROUP BY ALL) SELECT conv_id, coalesce(lang, 'English') AS language FROM c QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, p) = 1""")
def g9(spark, sf):
    c = table(spark, sf, "conversations").withColumn("lang", F.when(F.length("text") % 3 == 0, "Chinese").when(F.length("text") % 3 == 1, "English"))
    return rel.majority(c, "conv_id", "lang", "turn")


# ---- ordered operators


@query("w1_changed_frames", f"""WITH h AS ({HASH_SQL}), d AS (SELECT video, frame_idx, list_sum(list_transform(list_zip(bits, lag(bits) OVER (PARTITION BY video ORDER BY frame_idx)), lambda p: (p[1] <> p[2])::INT))::BIGINT AS distance, count(*) OVER (PARTITION BY video) AS n, row_number() OVER (PARTITION BY video ORDER BY frame_idx) AS r FROM h)
  SELECT video, frame_idx, CASE WHEN r > 1 THEN distance END AS distance FROM d WHERE n > 1 AND (r = 1 OR distance > 31)""")
def w1(spark, sf):
    return rel.changed_frames(hashes(spark, sf), "video", "frame_idx", "bits", 31).select("video", "frame_idx", F.col("distance").cast("long").alias("distance"))


def _laps(rows: str, key: str, order: str, threshold: float, laps: int) -> str:
    for _ in range(laps):
        rows = f"SELECT * EXCLUDE (prv) FROM (SELECT *, lag(embedding) OVER (PARTITION BY {key} ORDER BY {order}) AS prv FROM ({rows})) WHERE prv IS NULL OR list_dot_product(prv::DOUBLE[], embedding::DOUBLE[]) < {threshold}"
    return rows


@query("w3_adjacent_dedup", f"SELECT video, frame_idx, vec_id FROM ({_laps(FRAMES_SQL, 'video', 'frame_idx', 0.15, 2)})")
def w3(spark, sf):
    return rel.adjacent_dedup(frames(spark, sf), "video", "frame_idx", "embedding", 0.15, 2).select("video", "frame_idx", "vec_id")


@query(
    "w4_g10_text_lines",
    f"""WITH RECURSIVE b AS (SELECT frame, box, label, (box[2] + box[4]) / 2.0::DOUBLE AS c, row_number() OVER (PARTITION BY frame ORDER BY box[2], box[1], box[4], label) AS k, avg(box[4] - box[2]) OVER (PARTITION BY frame) AS h FROM ({OBJECTS_SQL}) WHERE label <> 'RF'),
 f AS (SELECT frame, k, 0 AS line, c AS first, h FROM b WHERE k = 1 UNION ALL SELECT b.frame, b.k, CASE WHEN abs(b.c - f.first) < 2.5 * b.h THEN f.line ELSE f.line + 1 END, CASE WHEN abs(b.c - f.first) < 2.5 * b.h THEN f.first ELSE b.c END, b.h FROM f JOIN b ON b.frame = f.frame AND b.k = f.k + 1),
 l AS (SELECT frame, line, string_agg(label, '' ORDER BY box[1], label) AS t FROM f JOIN b USING (frame, k) GROUP BY ALL) SELECT frame, string_agg(t, chr(10) ORDER BY line) AS text FROM l GROUP BY 1""",
)
def w4(spark, sf):
    o = objects(spark, sf).withColumn("kind", F.when(F.col("label") == "RF", "seal").otherwise("text"))
    return rel.text_lines(o, "frame", "box", "label", "kind", 2.5)


@query("w5_roughness", f"SELECT video, round(avg(abs(score - prv)), 4) AS roughness FROM (SELECT video, score, lag(score) OVER (PARTITION BY video ORDER BY frame_idx) AS prv FROM ({FRAMES_SQL})) GROUP BY 1")
def w5(spark, sf):
    return rel.roughness(frames(spark, sf), "video", "frame_idx", "score")


@query("set_union_of_hits", f"SELECT video, frame_idx FROM ({FRAMES_SQL}) WHERE score > 0.2 UNION SELECT video, frame_idx FROM ({FRAMES_SQL}) WHERE frame_idx % 10 = 0")
def set_union(spark, sf):
    f = frames(spark, sf)
    return f.filter("score > 0.2").select("video", "frame_idx").union(f.filter("frame_idx % 10 = 0").select("video", "frame_idx")).distinct()


@query("set_unselected", f"SELECT video, frame_idx FROM ({FRAMES_SQL}) WHERE NOT (score > 0.2 OR frame_idx % 10 = 0)")
def set_unselected(spark, sf):
    return frames(spark, sf).select("video", "frame_idx").join(set_union(spark, sf), ["video", "frame_idx"], "left_anti")


# ---- retrieval

_FLAG = _laps("SELECT vec_id, 0 AS g, embedding, round(list_dot_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS score FROM embeddings WHERE list_dot_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) > 0.15", "g", "vec_id", 0.97, 2)


@query("flagship_topk_dedup", f"SELECT label, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank, count(*) OVER (PARTITION BY label) AS n FROM ({_laps(FRAMES_SQL.replace('label AS video', 'label') + ' WHERE list_dot_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) > 0.05', 'label', 'vec_id', 0.97, 2)})) WHERE n > 3 AND rank <= 3 UNION ALL SELECT label, vec_id, score, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rank FROM (SELECT *, count(*) OVER (PARTITION BY label) AS n FROM ({_laps(FRAMES_SQL.replace('label AS video', 'label') + ' WHERE list_dot_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) > 0.05', 'label', 'vec_id', 0.97, 2)})) WHERE n <= 3")
def flagship(spark, sf):
    """The best items of each group for a query vector: threshold, two laps of dedup, rerank."""
    e = table(spark, sf, "embeddings").join(F.broadcast(query_vector(spark, sf)))
    best = ret.retrieve_and_rerank(e, F.col("qv"), "label", "vec_id", "embedding", threshold=0.05, k=3)
    return best.select("label", "vec_id", F.round("score", 6).alias("score"), "rank")


@query("r1_unit_rows", "SELECT vec_id, i - 1 AS d, round(embedding[i]::DOUBLE * 3 / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * 9), 6) AS x FROM (SELECT *, unnest(range(1, 65)) AS i FROM embeddings)")
def r1(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("v", F.transform("embedding", lambda x: x.cast("double") * 3))
    return e.select("vec_id", F.posexplode(rel.unit(F.col("v"))).alias("d", "x")).select("vec_id", F.col("d").cast("long").alias("d"), F.round("x", 6).alias("x"))


@query("r5_yes_probability", "SELECT p_partkey, round(1 / (1 + exp(p_size / 10.0::DOUBLE - p_retailprice / 1000)), 6) AS p FROM part")
def r5(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.round(ret.yes_probability(F.expr("p_size / 10.0D"), F.expr("p_retailprice / 1000")), 6).alias("p"))


@query("r6_related_frames", f"""WITH p AS ({POINTS_SQL}), h AS (SELECT user_id, i FROM p WHERE is_key UNION SELECT p.user_id, i FROM p JOIN ({SPANS_SQL}) s ON p.user_id = s.user_id AND t BETWEEN lo AND hi WHERE s.pos = 2 AND p.user_id % 3 = 0),
  n AS (SELECT user_id, count(*) AS n FROM p GROUP BY 1) SELECT user_id, i FROM h UNION SELECT user_id, unnest({_LIN.format(n='n', k='least(n, 32)')}) AS i FROM n WHERE user_id NOT IN (SELECT user_id FROM h)""")
def r6(spark, sf):
    p = points(spark, sf)
    ranged = p.join(spans(spark, sf).filter("pos = 2 and user_id % 3 = 0"), "user_id").filter("t between lo and hi")
    even = p.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.explode(smp.int_linspace(F.lit(0), F.col("n") - 1, F.least("n", F.lit(32)))).alias("i"))
    return ret.related_frames([p.filter("is_key"), ranged], even, "user_id", "i")


_REGION = "CASE WHEN cy < 160 THEN 'top' WHEN cy > 320 THEN 'bottom' ELSE 'middle' END || '_' || CASE WHEN cx < 640 / 3.0::DOUBLE THEN 'left' WHEN cx > 1280 / 3.0::DOUBLE THEN 'right' ELSE 'middle' END"


@query("r9_region", f"SELECT frame, pos, {_REGION} AS region FROM (SELECT *, box[1] + (box[3] - box[1]) // 2 AS cx, box[2] + (box[4] - box[2]) // 2 AS cy FROM ({OBJECTS_SQL}))")
def r9(spark, sf):
    return objects(spark, sf).select("frame", "pos", ret.region(F.col("box"), 640, 480).alias("region"))


@query(
    "r11_scene_description",
    f"""WITH o AS (SELECT *, box[1] + (box[3] - box[1]) // 2 AS cx, box[2] + (box[4] - box[2]) // 2 AS cy FROM ({OBJECTS_SQL})), p AS (SELECT a.frame, a.pos AS pa, b.pos AS pb, a.label AS la, b.label AS lb, a.cx - b.cx AS dx, a.cy - b.cy AS dy,
 a.box[1] < b.box[3] AND b.box[1] < a.box[3] AND a.box[2] < b.box[4] AND b.box[2] < a.box[4] AS meet FROM o a JOIN o b ON a.frame = b.frame AND a.pos < b.pos), r AS (SELECT *, abs(dx) / (abs(dy) + 1e-6::DOUBLE) AS q FROM p),
 s AS (SELECT *, CASE WHEN meet OR (dx = 0 AND dy = 0) THEN 'overlap' WHEN q > 2 THEN CASE WHEN dx > 0 THEN 'right' ELSE 'left' END WHEN q < 0.5 THEN CASE WHEN dy > 0 THEN 'below' ELSE 'above' END
  WHEN dx > 0 AND dy > 0 THEN 'bottom_right' WHEN dx > 0 AND dy < 0 THEN 'top_right' WHEN dx < 0 AND dy > 0 THEN 'bottom_left' ELSE 'top_left' END AS relation FROM r),
 a AS (SELECT frame, string_agg(label || '[' || pos || ']@' || {_REGION}, ' | ' ORDER BY pos, label || '[' || pos || ']@' || {_REGION}) AS t FROM o GROUP BY 1), b AS (SELECT frame, string_agg(la || '[' || pa || '] @' || relation || '_of ' || lb || '[' || pb || ']', ' | ' ORDER BY pa, pb, la || '[' || pa || '] @' || relation || '_of ' || lb || '[' || pb || ']') AS t FROM s GROUP BY 1)
 SELECT a.frame, concat_ws(' | ', a.t, b.t, c.counts) AS description FROM a LEFT JOIN b ON a.frame = b.frame LEFT JOIN ({_G1}) c ON a.frame = c.frame""",
)
def r11(spark, sf):
    return ret.describe(objects(spark, sf), "frame", "pos", "label", "box", 640, 480)


@query(
    "s5_wanted_frames",
    """WITH v AS (SELECT p_partkey, p_size + 3 AS n, p_partkey % 3 AS kind FROM part), l AS (SELECT p_partkey, unnest([n - 1, 0, n // 2, 0]) AS i FROM v WHERE kind = 0),
 e AS (SELECT p_partkey, CASE WHEN k = 1 THEN 0 ELSE j * (n - 1) // greatest(k - 1, 1) END AS i FROM (SELECT *, unnest(range(0, k)) AS j FROM (SELECT *, CASE WHEN kind = 1 THEN 1 ELSE 4 END AS k FROM v WHERE kind > 0)))
 SELECT DISTINCT p_partkey, CAST(i AS BIGINT) AS frame_idx FROM (SELECT * FROM l UNION ALL SELECT * FROM e)""",
)
def s5(spark, sf):
    """A third of the videos asks for a list (which wins over its number), the others for one frame or four."""
    v = table(spark, sf, "part").select("p_partkey", (F.col("p_size") + 3).cast("long").alias("n"), (F.col("p_partkey") % 3).alias("kind"))
    v = v.withColumn("listed", F.when(F.col("kind") == 0, F.array(F.col("n") - 1, F.lit(0).cast("long"), F.floor(F.col("n") / 2), F.lit(0).cast("long"))))
    v = v.withColumn("k", F.when(F.col("kind") == 0, 2).when(F.col("kind") == 1, 1).otherwise(4))
    return src.wanted_frames(v, "n", "listed", "k").select("p_partkey", "frame_idx")


@query(
    "sql_functions",
    """SELECT p_partkey, p_size, printf('%02d:%02d:%02d', p_partkey * 37 // 3600, p_partkey * 37 % 3600 // 60, p_partkey * 37 % 60) AS clock, greatest(1, CAST(ceil(p_size * 0.3::DOUBLE) AS BIGINT)) AS target, i
 FROM (SELECT *, unnest(range(greatest(0, p_size - 2), least(29, p_size + 2) + 1)) AS i FROM part)""",
)
def sql_functions(spark, sf):
    """Scalar and table functions by their SQL names."""
    register(spark)
    table(spark, sf, "part").createOrReplaceTempView("fw_part")
    return spark.sql("SELECT p_partkey, p_size, fw_clock(p_partkey * 37D) AS clock, fw_compress_target(p_size, 0.3D) AS target, s.i FROM fw_part, LATERAL fw_span(p_size, 2, 30) s")
