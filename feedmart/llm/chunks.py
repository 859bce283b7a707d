"""Substring deduplication by content-defined chunking with a gear rolling hash.

A variation of the usual boundary rule: a boundary is not where the rolling
hash falls below a threshold, which leaves chunks of any length, but at the
least hash among some word ends in a row, which bounds them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, filled

#: Bytes that the rolling hash covers, and word ends among which each run of so many has a boundary.
REACH, WITHIN = 8, 12
#: One random number a byte, from a fixed seed.
GEAR = np.random.default_rng(20240601).integers(0, 1 << 32, 256, np.uint32)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
SCHEMA = "doc_id long, text_key long, start int, length int, words int, d1 long, d2 long"


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """Gear hash at each byte over the last ``REACH`` bytes: the sum of ``GEAR[byte] << distance``, formed by doubling."""
    h = GEAR[data]
    step = 1
    while step < REACH:
        shifted = np.zeros_like(h)
        shifted[step:] = h[:-step] << np.uint32(step)
        h = h + shifted
        step *= 2
    return h


def boundaries(data: np.ndarray, within: int = WITHIN) -> np.ndarray:
    """Ends of chunks: the last bytes of blank runs whose gear hash is the least among some ``within`` word ends in a row, and the text's end.

    The choice looks at ``within`` words and ``REACH`` bytes at most, so an
    insertion changes the boundaries near it only, and no chunk is longer than
    ``within`` words and their blanks.
    """
    blank = _BLANK[data]
    ends = np.flatnonzero(blank[:-1] & ~blank[1:]) if len(data) > 1 else np.empty(0, np.int64)
    if len(ends) >= within:
        order = (gear_hashes(data)[ends].astype(np.uint64) << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(len(ends), dtype=np.uint64))
        least, span = order, 1
        while span < within:
            step = min(span, within - span)
            least = np.minimum(least[:-step], least[step:])
            span += step
        ends = ends[np.unique(np.uint64(0xFFFFFFFF) - (least & np.uint64(0xFFFFFFFF))).astype(np.int64)]
    elif len(ends):
        ends = ends[:0]
    return np.append(ends + 1, len(data)) if len(data) else np.empty(0, np.int64)


def chunk_rows(text: bytes, within: int) -> list[tuple[int, int, int, int, int]]:
    """(start, length, words, digest halves) of a text's chunks, in order."""
    data = np.frombuffer(text, np.uint8)
    ends = boundaries(data, within)
    if not len(ends):
        return []
    starts = np.concatenate(([0], ends[:-1]))
    blank = _BLANK[data]
    first = ~blank & np.concatenate(([True], blank[:-1]))
    words = np.add.reduceat(first.astype(np.int32), starts)
    out = []
    for s, e, w in zip(starts.tolist(), ends.tolist(), words.tolist(), strict=True):
        digest = xxhash.xxh3_128_digest(text[s:e])
        out.append((s, e - s, w, int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)))
    return out


def chunk(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", within: int = WITHIN, once: bool = False) -> DataFrame:
    """Rows of ``SCHEMA``: each text's chunks with place in UTF-8 bytes, words and 128-bit digest. Empty texts have none.

    ``doc_id`` and ``text_key``, a hash of the text, tell rows apart whose ids
    repeat or are null. With ``once`` a digest comes once a row.
    """
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    types = [pa.int64(), pa.int64(), *[pa.int32()] * 3, pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: list[list] = [[] for _ in names]
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)
        for batch in batches:
            for doc, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                found = chunk_rows(text.as_py(), within)
                if once:
                    found = [*{row[3:]: row for row in found}.values()]
                if found:
                    for column, values in zip(columns, ([doc] * len(found), [key] * len(found), *zip(*found, strict=True)), strict=True):
                        column.extend(values)
                if len(columns[0]) > 50_000:
                    yield flush()
                    columns = [[] for _ in names]
        yield flush()

    text = filled(text_col)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.xxhash64(text).alias("text_key"), text.cast("binary").alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", within: int = WITHIN, min_words: int = 23) -> DataFrame:
    """Passages that stand in more than one row.

    Chunks are compared by digest alone. A digest seen in two rows is repeated;
    neighbouring repeated chunks of a row form a passage, and passages of at
    least ``min_words`` words are returned. A boundary depends on the
    ``REACH`` bytes before it (four words at most) and is met within
    ``within`` words, so a shared passage of 51 words keeps 51 - 4 - 2 * 12 =
    23 between its first and last boundary, wherever it stands; shorter
    repeats are not found reliably and not returned. Boundaries stand at blanks
    only: text without blanks (Han or Japanese writing, long hexadecimals,
    minified code) is one chunk of one word, so what repeats inside it is not
    found. The counts per digest are
    combined before their shuffle, and chunks meet them in a join that Spark
    may split, so a digest of any frequency is spread.

    Returns ``doc_id, text_key, start, length, n_words, n_chunks, first_doc_id,
    kept``, one row per passage: a hash of the whole text, place and length in
    UTF-8 bytes, the smallest id among the passage's digests (null ids come
    first), and whether this row has the smallest id for all of them. Rows
    that repeat an id with another text are rows of their own; rows that
    repeat id and text count as two and give their passages once. A passage
    that repeats inside one row only is not returned. Null and empty texts and
    empty tables give no rows.
    """
    once = chunk(docs, id_col, text_col, within, once=True)
    by_digest = once.groupBy("d1", "d2").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n"))
    repeated = cut(by_digest.filter("n > 1").select("d1", "d2", "low"))
    own = chunk(docs, id_col, text_col, within).join(repeated, ["d1", "d2"]).select("doc_id", "text_key", "start", "length", "words", "low")
    row = Window.partitionBy("doc_id", "text_key").orderBy("start")
    ends = F.lag(F.col("start") + F.col("length")).over(row)
    begun = F.coalesce((F.col("start") > ends).cast("int"), F.lit(1))
    runs = (
        own.distinct()
        .withColumn("begun", begun)
        .withColumn("island", F.sum("begun").over(row))
        .groupBy("doc_id", "text_key", "island")
        .agg(
            F.min("start").cast("long").alias("start"),
            F.sum("length").alias("length"),
            F.sum("words").alias("n_words"),
            F.count(F.lit(1)).alias("n_chunks"),
            F.min("low").alias("first_doc_id"),
            F.min((F.col("low") == F.col("doc_id")).cast("int")).alias("kept"),
        )
        .filter(F.col("n_words") >= min_words)
    )
    id_of = lambda c: F.when(F.col(c) > -(1 << 63), F.col(c)).alias(c)
    return runs.select(id_of("doc_id"), "text_key", "start", "length", "n_words", "n_chunks", id_of("first_doc_id"), (F.col("kept") == 1).alias("kept"))


def drop_passages(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text`` of every row with its passages that are not the first copy cut out. All rows that share the smallest id of a passage keep it."""
    cuts = passages.filter("not kept").groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias("cuts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, places in zip(batch.column(1), batch.column(2), strict=True):
                data, at, kept = text.as_py(), 0, []
                for p in places.as_py() or []:
                    kept.append(data[at : p["start"]])
                    at = p["start"] + p["length"]
                out.append(b"".join([*kept, data[at:]]).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(filled(text_col)).alias("text_key"), filled(text_col).cast("binary").alias("text"))
    same = F.col("r.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("r.text_key") == F.col("c.text_key"))
    joined = rows.alias("r").join(cuts.alias("c"), same, "left").select("r.doc_id", "text", "cuts")
    return joined.mapInArrow(run, "doc_id long, text string")
