"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, filled, word_count

#: Sizes of one source are summed up in so many to a block, and then the blocks.
SIZE_BLOCK = 1024
#: Ranks within one source and size are formed in so many slices of the id's
#: hash, so that a source of any size is ranked by many tasks.
SLICE_DIGITS = 3


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """``source, source_size, target`` from rows of ``source, source_size``.

    ``source`` is ``=`` and the name, or empty for null. Sources in order of
    code points, null last, get ``weights`` in turn. The
    targets share ``share`` times all sizes by weight; none goes above ``most``
    times its source's size, what exceeds it is shared again by weight. That
    fixed point is ``least(most * size, level * weight)``: in order of
    ``most * size / weight`` the first sources are full, and the ``level`` of
    the first source that is not spreads what they leave over the others. One row per source, the only unpartitioned
    windows here.
    """
    order = Window.orderBy((F.col("source") == ""), F.col("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", w).withColumn("full", F.lit(float(most)) * F.col("source_size"))
    everything = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    up = Window.partitionBy(F.lit(0)).orderBy((F.col("full") / F.col("weight")).asc(), F.col("source"))
    s = (
        s.withColumn("total", F.lit(float(share)) * F.sum("source_size").over(everything))
        .withColumn("full_before", F.coalesce(F.sum("full").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(up.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("full_before")) / F.col("weight_left"))
    )
    fits = F.col("level") * F.col("weight") <= F.col("full")
    place = F.when(fits, F.struct((F.col("full") / F.col("weight")).alias("ratio"), "source"))
    s = s.withColumn("cut_level", F.min_by("level", place).over(everything))
    target = F.when(F.col("cut_level").isNull(), F.col("full")).otherwise(F.least(F.col("full"), F.col("cut_level") * F.col("weight")))
    return s.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    seed: str = "mix",
    keep_row: bool = False,
) -> DataFrame:
    """How many copies of each document the mix takes.

    Every document of a source has the same expected number of copies, its
    source's target over its size. Within a source the documents are put in
    order of size, then of the MD5 of their id and text; the expected copies are summed
    up in that order, one random offset per source is added, and a document is
    emitted once per integer crossed. As neighbours in the order have like
    sizes, what one document takes above its share the next ones take below
    theirs: summed by parts, the words taken differ from the target by at most
    the size of the source's largest document, whatever the offset (from the
    MD5 of seed and source). Nothing is chosen after looking at the outcome, so
    every document's expected copies are exactly the rate.

    The place of a document in the order is a sum of counts, each bounded
    whatever the source's size: blocks of sizes before its own, sizes before
    its own in the block, slices of its size before its own, and its rank in
    the slice.

    Returns ``doc_id, size, source_size, target, copies, taken`` per row (with
    ``row``, the whole input row, if ``keep_row``). Null texts have size 0;
    null is a source of its own; rows that repeat an id are documents of their
    own. A source of size 0 has target 0 and is not taken.
    """
    content = F.md5(filled(text_col).cast("binary"))
    key = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), content).cast("binary"))
    whole = [F.struct(*[docs[c] for c in docs.columns]).alias("row")] if keep_row else []
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("source"),  # null: empty
        word_count(filled(text_col)).alias("size"),
        key.alias("key"),
        *whole,
    ).withColumn("slice", F.substring("key", 1, SLICE_DIGITS))
    rows = rows if keep_row else cut(rows)
    slices = rows.groupBy("source", "size", "slice").agg(F.count(F.lit(1)).alias("n"))
    slices = cut(slices) if keep_row else slices
    steps = slices.groupBy("source", "size").agg(F.sum("n").alias("n"))
    earlier = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    steps = steps.withColumn("block", F.floor(F.col("size") / SIZE_BLOCK))
    blocks = steps.groupBy("source", "block").agg(F.sum("n").alias("n"))
    blocks = blocks.select("source", "block", F.coalesce(F.sum("n").over(earlier("source").orderBy("block")), zero).alias("blocked"))
    before = steps.select("source", "block", "size", F.coalesce(F.sum("n").over(earlier("source", "block").orderBy("size")), zero).alias("smaller"))
    before = before.join(blocks, ["source", "block"]).select("source", "size", (F.col("smaller") + F.col("blocked")).alias("smaller"))
    inside = slices.select("source", "size", "slice", F.coalesce(F.sum("n").over(earlier("source", "size").orderBy("slice")), zero).alias("sliced"))
    sources = steps.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    targets = source_targets(sources, weights, share, most)
    hashed = F.md5(F.concat(F.lit(f"{seed}:"), F.col("source")).cast("binary"))
    targets = targets.withColumns(
        {
            "rate": F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0),
            "offset": F.conv(F.substring(hashed, 1, 8), 16, 10).cast("double") / F.lit(2.0**32),
        }
    )
    floor_at = lambda place: F.floor(F.col("offset") + F.col("rate") * place.cast("double"))
    places = (
        inside.join(before, ["source", "size"])
        .join(targets, "source")
        .select("source", "size", "slice", (F.col("sliced") + F.col("smaller")).alias("ahead"), "source_size", "target", "rate", "offset")
    )
    rank = F.row_number().over(Window.partitionBy("source", "size", "slice").orderBy("key", F.col("id").asc_nulls_last()))
    placed = rows.withColumn("rank", rank).join(places, ["source", "size", "slice"])
    placed = placed.withColumn("place", F.col("ahead") + F.col("rank"))
    crossed = floor_at(F.col("place")) - floor_at(F.col("place") - 1)
    return placed.withColumn("copies", crossed).select(
        F.col("id").alias("doc_id"),
        "size",
        "source_size",
        "target",
        "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
        *(["row"] if keep_row else []),
    )


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every input row as many times as it is taken, columns as they came."""
    taken = mix(docs, keep_row=True, **options)
    return taken.select(F.explode(F.expr("if(copies > 0, sequence(1, copies), array())")).alias("copy"), "row").select("row.*")
