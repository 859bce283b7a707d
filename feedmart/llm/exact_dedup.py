"""Exact deduplication by 128-bit content hash, with bytes compared inside groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, cut, filled


def md5_128(text: Column) -> Column:
    """The 16 bytes of MD5."""
    return F.unhex(F.md5(text.cast("binary")))


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "min",
    digest: Callable[[Column], Column] = md5_128,
) -> DataFrame:
    """Groups equal texts and names the row of each group that stays.

    Texts are equal when identical after lower-casing A-Z. The groups come from
    a shuffle on the 128-bit hash with the text itself as second grouping key,
    so two texts share a group only if their bytes agree; equal copies are
    combined before the shuffle. Rows then find their group by hash alone, save
    for hashes under which more than one text was seen: those rows are matched
    by hash and text.

    Returns one row per input row: ``doc_id, keep_id, group_size, kept,
    text_sha256``. Null texts count as empty. A null id never wins against
    another id; a group of null ids only keeps one of them. Rows that repeat
    the winning id and its text count in ``group_size`` and exactly one of
    them is kept. An empty table gives no rows.
    """
    best = {"min": F.min, "max": F.max}[keep]
    rows = docs.select(F.col(id_col).alias("id"), ascii_lower(filled(text_col)).alias("norm")).withColumn("h", digest(F.col("norm")))
    groups = cut(
        rows.groupBy("h", "norm")
        .agg(best("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("h", "keep_id", "group_size", F.sha2(F.col("norm"), 256).alias("text_sha256"))
    )
    clashing = groups.groupBy("h").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("h")
    found = rows.select("id", "h")
    if clashing.isEmpty():
        found = found.join(groups, "h")
    else:
        plain = found.join(clashing, "h", "left_anti").join(groups, "h")
        apart = rows.join(clashing, "h", "left_semi")
        by_text = apart.groupBy("h", "norm").agg(best("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        apart = apart.join(by_text, ["h", "norm"]).withColumn("text_sha256", F.sha2(F.col("norm"), 256))
        found = plain.unionByName(apart.select(*plain.columns))
    # Rows that repeat the winning id are counted, and one of each is kept.
    named = ["id", "keep_id", "group_size", "text_sha256"]
    losers = found.filter(~F.col("id").eqNullSafe(F.col("keep_id"))).select(*named, F.lit(False).alias("kept"))
    winners = (
        found.filter(F.col("id").eqNullSafe(F.col("keep_id")))
        .groupBy(*named)
        .agg(F.count(F.lit(1)).alias("times"))
        .select(*named, F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("k"))
        .select(*named, (F.col("k") == 1).alias("kept"))
    )
    return winners.unionByName(losers).select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def distinct_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """The whole rows that stay, with their columns as they came.

    One shuffle: rows are ranked by id within hash and text, and each task
    passes on at most the best row of a group, so a group of any size is
    spread. Of rows that repeat id and text any one stays.
    """
    order = F.col("_id").desc_nulls_last() if keep == "max" else F.col("_id").asc_nulls_last()
    whole = F.struct(*[docs[c] for c in docs.columns]).alias("_row")
    rows = docs.select(whole, F.col(id_col).alias("_id"), ascii_lower(filled(text_col)).alias("_norm"))
    rows = rows.withColumn("_h", md5_128(F.col("_norm")))
    best = F.row_number().over(Window.partitionBy("_h", "_norm").orderBy(order))
    return rows.withColumn("_n", best).filter("_n = 1").select("_row.*")
