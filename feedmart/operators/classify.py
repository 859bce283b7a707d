"""Category evidence of rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicons as L
from ..functions import text as X


def _keyword_hits(df: DataFrame, key: str) -> DataFrame:
    """``key, category, points``: occurrences of every keyword by itself, weighted by field.

    A keyword stands between ASCII word edges, so its first word is one of the
    text's: only keywords whose first word occurs are looked for by pattern.
    """
    words = [(c, w) for c, ws in L.KEYWORDS.items() for w in ws]
    first = lambda w: re.split("[^a-z0-9_]+", w)[0]
    pairs = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(w).alias("word"), F.lit(first(w)).alias("first"), F.lit(X.words(w.replace("-", r"\-"), "")).alias("pattern")) for c, w in words])
    firsts = F.array(*[F.lit(w) for w in sorted({first(w) for _, w in words})])
    fields = F.array(*[F.struct(F.lit(float(p)).alias("points"), F.lower(F.coalesce(F.col(f), F.lit(""))).alias("text")) for f, p in L.KEYWORD_WEIGHTS.items()])
    stacked = df.select(key, F.explode(fields).alias("f")).select(key, "f.points", "f.text").withColumn("words", F.array_intersect(F.split("text", "[^a-z0-9_]+"), firsts)).filter(F.size("words") > 0)
    hits = stacked.select(key, "points", "text", F.explode(F.filter(pairs, lambda p: F.array_contains("words", p["first"]) & F.col("text").contains(p["word"]))).alias("p"))
    return hits.select(key, "p.category", (F.col("points") * F.regexp_count("text", F.col("p.pattern"))).alias("points"))


def category_scores(df: DataFrame, key: str = "id", categories: str = "categories") -> DataFrame:
    """``key, category, score`` above zero: the organiser's category, source tags and keywords, summed per row and category."""
    organizer = X.first_match("organizer", [(f"{i}", p) for i, (p, _) in enumerate(L.ORGANIZER_MAP)])
    by_number = F.element_at(F.array(*[F.lit(c) for _, c in L.ORGANIZER_MAP]), organizer.cast("int") + 1)
    owner = df.select(key, F.when(organizer.isNotNull(), by_number).alias("category"), F.lit(float(L.ORGANIZER_MAP_WEIGHT)).alias("points")).filter("category is not null")
    table = F.create_map(*[F.lit(x) for pair in L.SOURCE_TAGS.items() for x in pair])
    tags = df.select(key, F.explode(categories).alias("tag")).select(key, F.try_element_at(table, F.lower(F.trim("tag"))).alias("category"), F.lit(float(L.SOURCE_TAG_WEIGHT)).alias("points")).filter("category is not null")
    points = owner.unionByName(tags).unionByName(_keyword_hits(df, key))
    return points.groupBy(key, "category").agg(F.sum("points").alias("score")).filter("score > 0")


def rank_tags(scores: DataFrame, key: str = "id") -> DataFrame:
    """``key, tags``: categories by falling score, ties in the fixed order."""
    place = F.array_position(F.array(*[F.lit(c) for c in L.CATEGORIES]), F.col("category"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("down"), place.alias("place"), "category")))
    return scores.groupBy(key).agg(F.transform(ordered, lambda s: s["category"]).alias("tags"))


def derive_tags(df: DataFrame, key: str = "id", categories: str = "categories") -> DataFrame:
    """``key, tags`` of every row; rows without evidence get none."""
    tags = rank_tags(category_scores(df, key, categories), key)
    return df.select(key).join(tags, key, "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def infer_category(tags: str | Column) -> Column:
    return F.coalesce(F.get(tags, F.lit(0)), F.lit(L.DEFAULT_CATEGORY))
