"""The given tables in the parts that the operators expect, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TODAY = "2024-01-10"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as published events: the text's first line is the title."""
    d = table(spark, sf_dir, "documents")
    hour = (F.col("doc_id") % 12 + 1).cast("string")
    return d.select(
        F.col("doc_id").cast("string").alias("id"), F.substring_index("text", "\n", 1).alias("title"), F.concat(F.lit("unit "), "source").alias("organizer"),
        F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("doc_id") % 60).cast("int")).alias("date"),
        F.when(F.col("doc_id") % 7 == 0, "All day").when(F.col("doc_id") % 11 == 0, "TBD").otherwise(F.concat(hour, F.lit(":"), F.lpad((F.col("doc_id") % 60).cast("string"), 2, "0"), F.when(F.col("doc_id") % 2 == 0, " PM").otherwise(" AM"))).alias("time"),
        F.concat(F.lit("hall "), "lang").alias("location"), F.col("text").alias("description"), F.array("lang").alias("tags"), F.concat(F.lit("https://example.org/"), F.col("doc_id").cast("string")).alias("url"), "source",
        F.lit(None).cast("date").alias("end_date"), F.lit(None).cast("array<date>").alias("dates"),
    )


PUB = """pub AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, string_split(text, chr(10))[1] AS title, 'unit ' || source AS organizer, CAST(DATE '2024-01-01' + CAST(doc_id % 60 AS INT) AS DATE) AS date,
    CASE WHEN doc_id % 7 = 0 THEN 'All day' WHEN doc_id % 11 = 0 THEN 'TBD' ELSE (doc_id % 12 + 1) || ':' || lpad(CAST(doc_id % 60 AS VARCHAR), 2, '0') || CASE WHEN doc_id % 2 = 0 THEN ' PM' ELSE ' AM' END END AS time,
    CASE WHEN doc_id % 7 = 0 THEN -1 WHEN doc_id % 11 = 0 THEN 99999 ELSE ((doc_id % 12 + 1) % 12 + CASE WHEN doc_id % 2 = 0 THEN 12 ELSE 0 END) * 60 + doc_id % 60 END AS mins,
    'hall ' || lang AS location, text AS description, [lang] AS tags, lang, 'https://example.org/' || doc_id AS url, source, doc_id
  FROM documents)"""


def sql_stem(w: str) -> str:
    """SQL of the stem of a word expression."""
    pairs = "|".join(c * 2 for c in "bcdfghjklmnpqrstvwxyz")
    one = (
        f"(CASE WHEN len({w}) <= 3 THEN {w} WHEN {w} LIKE '%sses' AND len({w}) > 6 THEN left({w}, len({w}) - 2) WHEN {w} LIKE '%ies' AND len({w}) > 4 THEN left({w}, len({w}) - 3) || 'i' "
        f"WHEN {w} LIKE '%s' AND {w} NOT LIKE '%ss' AND {w} NOT LIKE '%us' AND len({w}) > 4 THEN left({w}, len({w}) - 1) ELSE {w} END)"
    )
    base = lambda k: f"left({one}, len({one}) - {k})"
    und = lambda k: f"(CASE WHEN len({base(k)}) < 3 THEN {one} WHEN len({base(k)}) >= 4 AND regexp_matches({base(k)}, '({pairs})$') THEN left({base(k)}, len({base(k)}) - 1) ELSE {base(k)} END)"
    return f"(CASE WHEN len({one}) <= 3 THEN {one} WHEN {one} LIKE '%ing' AND len({one}) > 6 THEN {und(3)} WHEN {one} LIKE '%ed' AND {one} NOT LIKE '%ing' AND len({one}) > 5 THEN {und(2)} ELSE {one} END)"


def sql_tokens(source: str, keys: str, text: str) -> str:
    """SQL of rows ``keys, token``: the distinct stems of a text."""
    from ..lexicons import STOP_WORDS

    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    split = f"SELECT DISTINCT {keys}, unnest(string_split(regexp_replace(strip_accents(lower({text})), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' ')) AS w FROM {source}"
    return f"SELECT DISTINCT {keys}, token FROM (SELECT {keys}, {sql_stem('w')} AS token FROM ({split}) WHERE len(w) >= 2 AND w NOT IN ({stops})) WHERE len(token) >= 2"
