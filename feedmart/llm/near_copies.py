"""One document of each group of near-duplicates by Jaccard similarity of word shingles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, filled
from .setsketch import near_classes
from .simhash import fingerprint_links


def simhash_pairs(nodes: DataFrame, most: int = 4) -> DataFrame:
    """``u, v`` of the nodes ``node, fp`` whose fingerprints are equal or linked through the inverted index over byte positions: a star for each fingerprint, a pair for each link."""
    heads = cut(nodes.groupBy("fp").agg(F.min("node").alias("head")))
    alike = nodes.join(heads, "fp").filter("node <> head").select(F.col("head").alias("u"), F.col("node").alias("v"))
    side = lambda name: heads.select(F.col("fp").alias(f"fp_{name}"), F.col("head").alias(name))
    links = fingerprint_links(heads.select("fp"), most).toDF("fp_u", "fp_v").join(side("u"), "fp_u").join(side("v"), "fp_v")
    return alike.unionByName(links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))).filter("u <> v").distinct()


def distinct_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """The whole rows that stay where one document of each group of near copies does, columns as they came.

    Texts are linked where the Jaccard similarity of their distinct shingles is
    at least ``least``. SimHash fingerprints within 4 bits give the first
    candidates; SetSketch bands add the pairs that are further apart, as a
    similarity of 0.8 mostly is; the sets decide on both.
    The row with the smallest id stays, a null id last, ties by the text's
    MD5. Rows are told apart by id and text, so a row that repeats an id with
    another text is a document of its own; rows that repeat both id and text
    of the one that stays, stay too, as exact deduplication removes them. All
    texts without words, null ones too, are one group.
    """
    known, found = near_classes(docs, id_col, text_col, shingle, least, simhash_pairs)
    placed = known.join(found.hint("merge"), "node", "left").select(F.col("doc_id").alias("_id"), F.col("raw").alias("_key"), F.coalesce("component", "node", F.lit(-1)).alias("component"))
    placed = cut(placed.distinct())
    order = F.struct(F.col("_id").isNull(), "_id", "_key")
    best = placed.groupBy("component").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("component", "best")
    gone = cut(placed.join(cut(best), "component").filter(order != F.col("best")).select("_id", "_key"))
    key = F.unhex(F.md5(filled(text_col).cast("binary")))
    return docs.join(gone, (key == gone["_key"]) & docs[id_col].cast("long").eqNullSafe(gone["_id"]), "left_anti")
