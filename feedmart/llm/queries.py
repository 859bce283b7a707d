"""Queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, centroids, chat, chunks, exact_dedup, licenses, mixing, packing, pii, setsketch, simhash, spelling, toxicity
from .common import table

#: Session setting that holds the key of surrogates, and what stands in where it is unset.
SURROGATE_KEY, DEFAULT_KEY = "spark.feedmart.surrogateKey", "documents-1"


def tokenizer_files() -> dict[str, str]:
    """Paths of the public vocabulary; they are parameters of the operator."""
    import public_tokenizers as P

    return {"tokenizer_json": P.path("byte_bpe_50k.json"), "ranks": P.path("byte_bpe_50k.tiktoken"), "pattern": P.PATTERN}


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.surrogates(table(spark, sf_dir, "documents"), spark.conf.get(SURROGATE_KEY, DEFAULT_KEY))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), **tokenizer_files())


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), keep="max")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.repeated_passages(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, most=4)


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select(*(F.col(c).cast(t).alias(c) for c, t in extra.dtypes))
    return chat.digests(chat.format_chats(chat.turn_records(rows.unionByName(extra))))


def op8_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.nearest(rows, rows.filter("vec_id % 20 = 0"), k=20)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op12_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, least=0.8)


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"), k=8, rounds=10, width=64, scale=1024, salt="3:")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_pii_surrogates, op2_license_scan, op3_packing, op4_exact_dedup, op5_substring_dedup, op6_simhash, op7_chat_formatting, op8_rp_forest, op9_toxicity, op10_mixing, op11_spelling_variants, op12_setsketch, op13_centroids, pipeline]
    return {f.__name__: f for f in found}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4_SQL = f"""
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, {_LOWER} AS norm FROM documents)
WINDOW same AS (PARTITION BY norm)
"""

OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce('=' || source, '') AS source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS key FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source = '', source) - 1) % 3 + 1 AS INT)]::DOUBLE AS weight
  FROM d GROUP BY source
), f AS (SELECT *, 2.0::DOUBLE * source_size AS full_size FROM s
), l AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS total,
         coalesce(sum(full_size) OVER (ORDER BY full_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS full_before,
         sum(weight) OVER (ORDER BY full_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left,
         row_number() OVER (ORDER BY full_size / weight, source) AS rn
  FROM f
), v AS (SELECT *, (total - full_before) / weight_left AS lev FROM l
), c AS (SELECT *, arg_min(lev, CASE WHEN lev * weight <= full_size THEN rn END) OVER () AS cut_level FROM v
), t AS (
  SELECT source, source_size, CASE WHEN cut_level IS NULL THEN full_size ELSE least(full_size, cut_level * weight) END AS target FROM c
), r AS (
  SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
         row_number() OVER (PARTITION BY d.source ORDER BY size, key, doc_id)::DOUBLE AS place
  FROM d JOIN t ON d.source = t.source
)
SELECT doc_id, size, source_size, target,
       CAST(floor(shift + rate * place) - floor(shift + rate * (place - 1)) AS BIGINT) * size AS taken
FROM (SELECT *, CAST(('0x' || substr(md5('mix:' || source), 1, 8)) AS BIGINT)::DOUBLE / 4294967296.0::DOUBLE AS shift FROM r)
"""


OP12_SQL = f"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), t AS MATERIALIZED (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY array_to_string(w, ' ')) AS node, w FROM d WHERE len(w) > 0
), s AS MATERIALIZED (
  SELECT DISTINCT node, unnest(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' '))) AS shingle FROM t WHERE doc_id = node
), n AS MATERIALIZED (SELECT node, count(*) AS n FROM s GROUP BY node
), pairs AS (SELECT a.node AS u, b.node AS v, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.node < b.node GROUP BY ALL
), links AS MATERIALIZED (
  SELECT u, v FROM pairs JOIN n x ON x.node = u JOIN n y ON y.node = v WHERE 100 * shared >= 80 * (x.n + y.n - shared)
), step AS MATERIALIZED (SELECT u, v FROM links UNION ALL SELECT v, u FROM links
), reach(node, low) AS (
  SELECT node, node FROM n UNION SELECT step.v, reach.low FROM reach JOIN step ON step.u = reach.node WHERE reach.low < step.v
), c AS (SELECT node, min(low) AS low FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.low, d.doc_id) AS component_id, d.doc_id = coalesce(c.low, d.doc_id) AS kept
FROM d LEFT JOIN t ON t.doc_id = d.doc_id LEFT JOIN n ON n.node = t.node LEFT JOIN c ON c.node = t.node
"""


def _centroid_sql(rounds: int) -> str:
    """Each round is a pair of tables: vectors with their nearest centroid, and the centroids that follow."""
    tables = [
        "v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS k, v AS c FROM v QUALIFY row_number() OVER (ORDER BY sha256('3:' || vec_id), v) <= 8)",
    ]
    for r in range(rounds + 1):
        gap = "list_inner_product(v, v) - 2 * list_inner_product(v, c) + list_inner_product(c, c)"
        tables.append(f"a{r} AS MATERIALIZED (SELECT vec_id, v, unnest(x) FROM (SELECT vec_id, v, min({{'d': {gap}, 'k': k}}) AS x FROM v, c{r} GROUP BY vec_id, v))")
        if r < rounds:
            sums = f"SELECT k, i, floor(sum(x) / count(*)) AS m FROM (SELECT k, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY k, i"
            tables.append(f"c{r + 1} AS MATERIALIZED (SELECT k, list(m ORDER BY i) AS c FROM ({sums}) GROUP BY k UNION ALL SELECT k, c FROM c{r} WHERE k NOT IN (SELECT k FROM a{r}))")
    joined = "array_to_string(list_transform(c, lambda x: x::BIGINT), ',')"
    return "WITH " + ", ".join(tables) + (
        f" SELECT vec_id, k::INT AS cluster, d::BIGINT AS distance, sum(d) OVER (PARTITION BY k)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha256({joined}) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (k)"
    )


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_dedup": OP4_SQL, "op10_mixing": OP10_SQL, "op12_setsketch": OP12_SQL, "op13_centroids": _centroid_sql(10)}
