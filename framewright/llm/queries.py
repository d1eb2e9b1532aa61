"""The registered queries of the corpus operators: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .embed_dedup import embedding_links
from .exact_dedup import exact_dedup
from .langid import identify
from .mixing import mix_schedule, taken_words
from .packing import pack_documents
from .pii import detect_pii, digest
from .simhash import near_duplicates
from .token_counts import token_counts
from .toxicity import score_toxicity
from .warc import derive, responses


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), g AS (
  SELECT doc_id, n, norm,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id ASC NULLS LAST) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size,
         row_number() OVER (PARTITION BY norm ORDER BY n DESC, doc_id ASC NULLS LAST) AS rn
  FROM d
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, rn = 1 AS kept, sha256(norm) AS text_sha256 FROM g
"""


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes, _ = near_duplicates(table(spark, sf_dir, "documents"))
    return classes.select("doc_id", "class_id", "shingle_class", "kept")


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
         ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' ')) END) AS sh
  FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b USING (sh) WHERE a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT x, y, shared = a.n AND shared = b.n AS same FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE shared / CAST(a.n + b.n - shared AS DOUBLE) >= 0.8
), c AS (
  SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT c.x, l.y FROM c JOIN l ON c.y = l.x
), k AS (
  SELECT x AS doc_id, min(y) AS class_id FROM c GROUP BY 1
), e AS (
  SELECT x AS doc_id, min(y) AS twin FROM l WHERE same GROUP BY 1
)
SELECT d.doc_id, k.class_id, least(d.doc_id, coalesce(e.twin, d.doc_id)) AS shingle_class, d.doc_id = k.class_id AS kept
FROM documents d JOIN k USING (doc_id) LEFT JOIN e USING (doc_id)
"""


def op3_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = derive(responses(table(spark, sf_dir, "pages")))
    return records.withColumn("text", F.col("block").cast("string")).drop("block")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(detect_pii(table(spark, sf_dir, "documents")))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(table(spark, sf_dir, "embeddings"))


OP6_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
), u AS (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v
), l AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) >= 0.95 * a.n * b.n
), c AS (
  SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT c.x, l.y FROM c JOIN l ON c.y = l.x
)
SELECT x AS vec_id, coalesce(any_value(n.n), 0) AS n_links, min(y) AS component_id, min(y) = x AS kept
FROM c LEFT JOIN (SELECT x AS i, count(*) AS n FROM l GROUP BY 1) n ON n.i = c.x GROUP BY x
"""


def op7_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = taken_words(mix_schedule(table(spark, sf_dir, "documents")))
    return taken.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", "taken")


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), s AS (
  SELECT source, sum(size) AS source_size, 1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS w FROM d GROUP BY source
), l AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
         / CAST(sum(w) OVER (ORDER BY 3 * source_size / w, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM s
), t AS (
  SELECT source, CAST(source_size AS BIGINT) AS source_size, least(CAST(3 * source_size AS DOUBLE), w * max(level) OVER ()) AS target FROM l
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS take,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id NULLS LAST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CASE WHEN size = 0 THEN 0 ELSE (take // source_size) * size + least(greatest(take % source_size - pos, 0), size) END AS taken
FROM p
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_warc_derivatives": op3_warc_derivatives,
    "op4_language_id": op4_language_id,
    "op5_pii": op5_pii,
    "op6_embedding_near_dedup": op6_embedding_near_dedup,
    "op7_harmonic_packing": op7_harmonic_packing,
    "op8_token_counts": op8_token_counts,
    "op9_toxicity": op9_toxicity,
    "op10_mixing": op10_mixing,
}
ORACLES: dict[str, str] = {"op1_exact_dedup": OP1_SQL, "op2_simhash_near_dedup": OP2_SQL, "op6_embedding_near_dedup": OP6_SQL, "op10_mixing": OP10_SQL}
