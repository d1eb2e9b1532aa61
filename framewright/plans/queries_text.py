"""Queries of the document, prompt, evaluation, JSON and cache operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import parse_query, squash_controls
from ..operators import relations as rel
from ..operators import retrieval as ret
from .catalog import query
from .standins import table


@query("doc_length_filter", "SELECT conv_id, turn, length(text) AS n FROM conversations WHERE length(text) >= 40")
def doc_filter(spark, sf):
    return rel.long_enough(table(spark, sf, "conversations"), "text", 40).select("conv_id", "turn", F.length("text").cast("long").alias("n"))


@query("r4_retrieve_and_rerank", """WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), d AS (SELECT vec_id, label, embedding, list_dot_product(embedding::DOUBLE[], q) AS score, coalesce(substr(text, 1, 2000000), '') AS text FROM embeddings JOIN documents ON vec_id = doc_id, q),
  h AS (SELECT * FROM d WHERE length(text) >= 300 AND score > 0.02), a AS (SELECT *, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS prv FROM h), b AS (SELECT * EXCLUDE (prv) FROM a WHERE prv IS NULL OR list_dot_product(prv::DOUBLE[], embedding::DOUBLE[]) < 0.4)
  SELECT label, vec_id, round(score, 6) AS score, rank FROM (SELECT *, CASE WHEN count(*) OVER (PARTITION BY label) <= 5 THEN row_number() OVER (PARTITION BY label ORDER BY vec_id) ELSE row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) END AS rank FROM b) WHERE rank <= 5""")
def r4(spark, sf):
    q = table(spark, sf, "embeddings").filter("vec_id = 0").select(F.col("embedding").alias("qv"))
    d = table(spark, sf, "embeddings").join(table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "text"), "vec_id").join(F.broadcast(q))
    return ret.retrieve_and_rerank(d, F.col("qv"), "label", "vec_id", "embedding", "text", 300, 0.02, 0.4, 1, 5).select("label", "vec_id", F.round("score", 6).alias("score"), "rank")


@query("r13_clock", "SELECT p_partkey, lpad((s // 3600)::VARCHAR, 2, '0') || ':' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS clock FROM (SELECT p_partkey, CAST(trunc(p_retailprice * 7.3::DOUBLE) AS BIGINT) AS s FROM part)")
def r13(spark, sf):
    return table(spark, sf, "part").select("p_partkey", ret.clock(F.expr("p_retailprice * 7.3D")).alias("clock"))


@query("r13_document_block", """SELECT conv_id, 'Transcript' || chr(10) || string_agg('[00:' || lpad((turn * 7 // 60)::VARCHAR, 2, '0') || ':' || lpad((turn * 7 % 60)::VARCHAR, 2, '0') || '] ' || text, chr(10) ORDER BY turn, text) AS block FROM conversations WHERE length(trim(text)) > 0 GROUP BY 1""")
def r13b(spark, sf):
    return ret.document_block(table(spark, sf, "conversations").withColumn("ts", F.col("turn") * 7), "conv_id", "text", "ts", "Transcript")


@query("r14_language_instruction", "SELECT doc_id, CASE WHEN lang = 'en' THEN 'Answer in English.' ELSE '请用中文回答。' END AS instruction FROM documents")
def r14(spark, sf):
    return table(spark, sf, "documents").select("doc_id", ret.language_instruction(F.when(F.col("lang") == "en", "English").otherwise("Chinese")).alias("instruction"))


@query("r15_keywords", """WITH p AS (SELECT p_partkey, lower(CASE WHEN p_partkey % 11 = 0 THEN 'Video' ELSE p_name END) AS phrase, CASE p_partkey % 5 WHEN 0 THEN 'NOUN' WHEN 1 THEN 'ADJ NOUN' WHEN 2 THEN 'VERB' WHEN 3 THEN 'NOUN ADP NOUN' ELSE 'DET NOUN' END AS t FROM part)
  SELECT DISTINCT p_partkey, phrase FROM p WHERE t IN ('NOUN', 'ADJ NOUN', 'NOUN ADP NOUN') AND phrase NOT IN ('image', 'video', 'picture', 'frame', 'scene')""")
def r15(spark, sf):
    tags = F.split(F.expr("case p_partkey % 5 when 0 then 'NOUN' when 1 then 'ADJ NOUN' when 2 then 'VERB' when 3 then 'NOUN ADP NOUN' else 'DET NOUN' end"), " ")
    p = table(spark, sf, "part").select("p_partkey", F.when(F.expr("p_partkey % 11 = 0"), "Video").otherwise(F.col("p_name")).alias("phrase"), tags.alias("tags"))
    return ret.keywords(p, "p_partkey", "phrase", "tags")


@query("r16_cache_misses", "SELECT DISTINCT sha256(role || '|' || text) || '-v1' AS content_key FROM conversations WHERE sha256(role || '|' || text) || '-v1' NOT IN (SELECT sha256(role || '|' || text) || '-v1' FROM conversations WHERE conv_id % 2 = 0)")
def r16(spark, sf):
    c = table(spark, sf, "conversations")
    known = c.filter("conv_id % 2 = 0").select(F.concat(F.sha2(F.concat_ws("|", "role", "text"), 256), F.lit("-v1")).alias("content_key")).distinct()
    return ret.cache_misses(c, known, ["role", "text"], "-v1").select("content_key")


@query("r16_evict_oldest", "SELECT content_key, used FROM (SELECT sha256(conv_id::VARCHAR) AS content_key, max(turn) AS used FROM conversations GROUP BY conv_id) ORDER BY used DESC, content_key LIMIT 25")
def r16b(spark, sf):
    c = table(spark, sf, "conversations").groupBy(F.sha2(F.col("conv_id").cast("string"), 256).alias("content_key")).agg(F.max("turn").alias("used"))
    return ret.evict_oldest(c, "used", 25)


@query("f_squash_controls", "SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\n\\f\\r\\x08\\t\\v\\a]+', ' ', 'g')) AS digest FROM documents")
def squash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(squash_controls(F.coalesce("text", F.lit(""))), 256).alias("digest"))


@query("f_suffix_and_nul", "SELECT page_id, regexp_matches(lower(url), '\\.(jpg|jpeg)$') AS jpeg, contains(url, '#') AS mark FROM pages")
def suffix(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.lower("url").rlike("\\.(jpg|jpeg)$").alias("jpeg"), F.contains("url", F.lit("#")).alias("mark"))


@query("s11_explode_questions", "SELECT item_id, q, CASE WHEN q % 2 = 0 THEN 'even' ELSE 'odd' END AS task FROM benchmark, (SELECT unnest([0, 1, 2]) AS q)")
def s11(spark, sf):
    raw = table(spark, sf, "benchmark").select("item_id", F.to_json(F.array(*[F.struct(F.lit(i).alias("q"), F.lit("even" if i % 2 == 0 else "odd").alias("task")) for i in range(3)])).alias("j"))
    parsed = raw.select("item_id", F.explode(F.from_json("j", "array<struct<q: int, task: string>>")).alias("x"))
    return parsed.select("item_id", "x.q", "x.task")


@query("f_parse_query", """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 1 WHEN p_partkey % 3 = 1 THEN 2 ELSE 0 END AS n, p_partkey % 3 = 0 AS every FROM part""")
def json_query(spark, sf):
    """A subtitle request is a list, the word "all", or broken JSON."""
    j = F.expr("""case p_partkey % 3 when 0 then '{"sub": {"relevant_subtitles": "all", "retrieve_related_frames": true}}' when 1 then '{"sub": {"relevant_subtitles": ["a", "b"]}}' else '{"sub": {"relev' end""")
    q = table(spark, sf, "part").select("p_partkey", parse_query(j).alias("q"))
    return q.select("p_partkey", F.coalesce(F.size("q.relevant_subtitles"), F.lit(0)).alias("n"), F.coalesce(F.element_at("q.relevant_subtitles", 1) == "all", F.lit(False)).alias("every"))
