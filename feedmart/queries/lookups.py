"""Queries of look-up joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import lexicons as L
from ..operators import joins as J
from ..operators import rows as R
from ..registry import DDL
from .common import PUB, published, query, sql_tokens, table

WORDS = ["license", "the ", "que", "und", "version", "mit"]


@query(f"WITH {PUB}, w(entry) AS (VALUES ('license'), ('the '), ('que'), ('und'), ('version'), ('mit')) SELECT entry, count(*) AS rows FROM pub JOIN w ON contains(lower(description), entry) GROUP BY entry")
def lexicon_hit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.lexicon_hits(published(spark, sf_dir).select("description"), "description", WORDS).groupBy("entry").agg(F.count(F.lit(1)).alias("rows"))


@query("SELECT c_custkey, CASE lower(c_mktsegment) WHEN 'building' THEN 'Academic' WHEN 'machinery' THEN 'Science & Tech' ELSE 'Student Life' END AS category, n_name AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def dimension_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = J.map_dim(table(spark, sf_dir, "customer"), "c_mktsegment", {"BUILDING": "Academic", "machinery": "Science & Tech"}, "category", L.DEFAULT_CATEGORY)
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("key"), F.col("n_name").alias("value"))
    return J.map_dim(c.withColumn("_nation", F.col("c_nationkey").cast("string")), "_nation", n, "nation").select("c_custkey", "category", "nation")


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 4 WHEN 'click' THEN 3 END AS priority, event_type = 'view' AS critical FROM events WHERE event_type IN ('view', 'click') UNION ALL SELECT event_id, NULL, NULL FROM events WHERE event_type NOT IN ('view', 'click')")
def registry_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    reg = spark.createDataFrame([(0, "view", "View", 4, 1, 1, True, True, True), (1, "click", "Click", 3, 1, 1, True, True, False)], DDL)
    return J.with_registry(table(spark, sf_dir, "events"), reg, "event_type").select("event_id", "priority", "critical")


@query(f"WITH {PUB} SELECT id, lang AS category, CASE WHEN lang = 'fr' THEN lang END AS matched_category, source FROM pub")
def tool_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.to_tool_rows(published(spark, sf_dir), "FR").select("id", "category", "matched_category", "source")


@query(f"WITH {PUB} SELECT id, count(DISTINCT token) AS n_tokens FROM pub LEFT JOIN ({sql_tokens('(SELECT id, concat_ws(chr(32), title, organizer, description, location, lang) AS whole FROM pub)', 'id', 'whole')}) USING (id) GROUP BY id")
def event_token_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct tokens of whole events."""
    return published(spark, sf_dir).select("id", F.size(J.event_tokens()).cast("long").alias("n_tokens"))
