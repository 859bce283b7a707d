"""Word shingles of texts, and pairs verified on them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Size of the bitmap by which texts that no pair needs are passed over, and texts that a task remembers as handed on.
BITS, REMEMBERED = 1 << 22, 100_000
#: Hash of a word, and the odd factor of the polynomial over words.
_WORD, _BASE = xxhash.xxh64_intdigest, np.uint64(0x9E3779B97F4A7C15)


def shingles_of(text: bytes, shingle: int = 5) -> set[bytes]:
    """Distinct shingles of a UTF-8 text: A-Z lower-cased, words between ASCII blanks; a shorter text is one shingle."""
    words = text.lower().split()
    return {b" ".join(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))} if words else {b""}


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles: a polynomial over the XXH64 of their words."""
    words = text.lower().split()
    h = np.fromiter(map(_WORD, words), np.uint64, len(words)) if words else np.zeros(1, np.uint64)
    out = np.zeros(max(1, len(h) - shingle + 1), np.uint64)
    for k in range(min(shingle, len(h))):
        out = out * _BASE + h[k : k + len(out)]
    return np.unique(out.view(np.int64))


def _slot(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(BITS)).cast("int")


def _bitmap(need: DataFrame, column: str) -> Broadcast[np.ndarray]:
    """``BITS`` hash values of the column, packed: all that is gathered, whatever the number of rows."""
    bits = np.zeros(BITS, bool)
    bits[need.select(_slot(column).alias("slot")).distinct().toArrow()["slot"].to_numpy()] = True
    return need.sparkSession.sparkContext.broadcast(np.packbits(bits))


def among(rows: DataFrame, column: str, need: DataFrame, change: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, ddl: str = "") -> DataFrame:
    """The rows without most of those whose ``column`` is not in ``need``, before they are shuffled; rows that meet a bit by chance fall out in the join.

    ``change`` makes rows of ``ddl`` of what stays of a batch, in the same
    pass: a Python step upon another takes a worker more for each core of an
    executor, and Spark keeps these for the stages that follow.
    """
    shared, names = _bitmap(need, column), rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            chosen = batch.filter(pa.array(held[batch.column(batch.num_columns - 1).to_numpy()]))
            if chosen.num_rows:
                chosen = pa.RecordBatch.from_arrays(chosen.columns[:-1], names=names)
                yield chosen if change is None else change(chosen)

    return rows.withColumn("_slot", _slot(column)).mapInArrow(run, rows.schema if change is None else ddl)


def maybe_needed(rows: DataFrame, need: DataFrame) -> DataFrame:
    """Rows ``key, text`` without most of those whose key is not in ``need``, before texts are shuffled.

    A bitmap stands for the keys, as in ``among``. Of equal keys a task hands on one.
    """
    shared = _bitmap(need, "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen = np.unpackbits(shared.value).astype(bool), set()
        for batch in batches:
            chosen = batch.filter(pa.array(held[batch.column(2).to_numpy()]))
            fresh = []
            for key in chosen.column(0).to_pylist():
                fresh.append(key not in seen)
                if len(seen) < REMEMBERED:
                    seen.add(key)
            chosen = chosen.filter(pa.array(fresh, pa.bool_()))
            yield pa.RecordBatch.from_arrays([chosen.column(0), chosen.column(1)], names=["key", "text"])

    return rows.select("key", "text", _slot("key").alias("slot")).mapInArrow(run, "key string, text binary")


def verified(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, shingle: int, least: float) -> DataFrame:
    """Those of the pairs ``u, v`` of nodes whose texts have similarity ``least``; hashes rule out, shingles decide."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def of(node: int, text: pa.Scalar) -> np.ndarray:
            if node not in held:
                if len(held) >= 500:
                    held.clear()
                held[node] = shingle_hashes(text.as_py(), shingle)
            return held[node]

        for batch in batches:
            keep = []
            for u, v, a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                x, y = of(u, a), of(v, b)
                both = len(np.intersect1d(x, y, assume_unique=True))
                alike = both / (len(x) + len(y) - both) >= least - 1e-6
                if alike:
                    p, q = shingles_of(a.as_py(), shingle), shingles_of(b.as_py(), shingle)
                    both = len(p & q)
                    alike = both / (len(p) + len(q) - both) >= least
                keep.append(alike)
            chosen = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([chosen.column(0), chosen.column(1)], names=["u", "v"])

    need = cut(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(nodes.select("node", "key"), "node"))
    texts = cut(maybe_needed(rows.select("key", "text"), need).join(need, "key").groupBy("node").agg(F.first("text").alias("text")))
    side = lambda name, text: texts.select(F.col("node").alias(name), F.col("text").alias(text))
    return pairs.join(side("u", "a"), "u").join(side("v", "b"), "v").select("u", "v", "a", "b").mapInArrow(run, "u long, v long")
