"""Harmonic packing of tokenized documents into sequences."""

from __future__ import annotations

import base64
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, filled

END = b"\0\0\0\0"
#: Documents that one worker packs by class, and positions that one task of the gap join covers, in sequences.
SLICE_ROWS, BUCKET = 20_000, 8
#: Kinds of a piece: a sequence of its own, a whole document for the bins of its class, and tokens that fill gaps.
WHOLE, CLASSED, FILLER = 0, 1, 2
_NAMED = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64()}
_SQL = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary"}
_PIECES = _NAMED | {"kind": pa.int32(), "part": pa.int64(), "at": pa.int64(), "ids": pa.binary()}
_BINS = _NAMED | {"part": pa.int64(), "bin": pa.int64(), "offset": pa.int64(), "gap_at": pa.int64()}


def _schema(fields: dict) -> str:
    return ", ".join(f"{name} {_SQL[t]}" for name, t in fields.items())


def _batch(rows: list[tuple], fields: dict) -> pa.RecordBatch:
    columns = [*zip(*rows, strict=True)] if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, fields.values(), strict=True)], names=[*fields])


def packed_encoder(json_path: str, ranks_path: str | None, pattern: str | None):
    """text -> little-endian unsigned 32-bit ids, as ``tokenizers`` gives them for the vocabulary in ``json_path``.

    With the same vocabulary as ranks, ``tiktoken`` does the work: it gives the
    same ids four times faster (a test compares both on characters of every
    class). Texts that hold a special token's string go to ``tokenizers``.
    """
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(json_path)
    slow = lambda text: array("I", exact.encode(text, add_special_tokens=False).ids).tobytes()
    if ranks_path is None:
        return slow
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, f)}
    fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    special = [t.content for t in exact.get_added_tokens_decoder().values()]

    def encode(text: str) -> bytes:
        return slow(text) if any(s in text for s in special) else array("I", fast.encode_ordinary(text)).tobytes()

    return encode


class Balance:
    """Decides on the fly which pieces fill gaps, so that these come near the gaps that bins will have.

    A document of class k leaves ``capacity / k - length`` of its share of a
    bin empty. What remains of documents above ``capacity`` always fills gaps;
    where that is too little, whole pieces of long documents do, then documents
    above half a sequence, then any.
    """

    def __init__(self, capacity: int):
        self.capacity, self.open = capacity, 0.0

    def kind(self, length: int, of_long: bool) -> int:
        c = self.capacity
        if length == c:
            kind = FILLER if of_long and self.open > c else WHOLE
        elif of_long or self.open > (1 if 2 * length > c else 2) * c:
            kind = FILLER
        else:
            kind = CLASSED
            self.open += c / (c // length) - length
        self.open -= length if kind == FILLER else 0
        return kind


def tokenized_pieces(docs: DataFrame, encoder_args: tuple, capacity: int) -> DataFrame:
    """Rows of ``_PIECES``; Arrow batches in, Arrow batches out. ``at`` numbers the whole pieces of a task and sums up its filling tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, balance, part = packed_encoder(*encoder_args), Balance(capacity), TaskContext.get().partitionId()
        at = {WHOLE: 0, CLASSED: 0, FILLER: 0}
        for batch in batches:
            rows, held = [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                view = memoryview(encode(text.as_py()) + END)
                n = len(view) // 4
                for start in range(0, n, capacity):
                    length = min(capacity, n - start)
                    ids, kind = view[4 * start : 4 * (start + length)], balance.kind(length, n > capacity)
                    rows.append((doc, start, length, zlib.crc32(ids), n, kind, part, at[kind], bytes(ids) if kind == FILLER else None))
                    at[kind] += length if kind == FILLER else 1
                    held += len(ids) if kind == FILLER else 0
                if len(rows) >= 20_000 or held >= 1 << 24:
                    yield _batch(rows, _PIECES)
                    rows, held = [], 0
            yield _batch(rows, _PIECES)

    return docs.mapInArrow(run, _schema(_PIECES))


def class_bins(pieces: DataFrame, capacity: int) -> DataFrame:
    """Rows of ``_BINS``: each worker fills the bins of every class with its fixed count of documents, whatever other workers do.

    A document of length n is of class ``k = capacity // n`` and shares its bin
    with k - 1 others. Of each class at most k - 1 documents are left to a
    worker; these are laid into bins of their own by best fit, longest first.
    A row without ``doc_id`` stands for the gap of a bin: its ``offset``, its
    ``length`` and, in ``gap_at``, the sum of the worker's gaps before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, bins, gaps = TaskContext.get().partitionId(), 0, 0
        waiting: dict[int, list[tuple]] = {}

        def closed(members: list[tuple]) -> list[tuple]:
            nonlocal bins, gaps
            rows, at = [], 0
            for m in members:
                rows.append((*m, part, bins, at, None))
                at += m[2]
            if at < capacity:
                rows.append((None, None, capacity - at, None, None, part, bins, at, gaps))
            gaps, bins = gaps + capacity - at, bins + 1
            return rows

        for batch in batches:
            rows = []
            for member in zip(*(batch.column(i).to_pylist() for i in range(len(_NAMED))), strict=True):
                k = capacity // member[2]
                waiting.setdefault(k, []).append(member)
                if len(waiting[k]) == k:
                    rows += closed(waiting.pop(k))
            yield _batch(rows, _BINS)
        by_room: dict[int, list[list[tuple]]] = {}
        for member in sorted((m for members in waiting.values() for m in members), key=lambda m: -m[2]):
            room = next((r for r in range(member[2], capacity) if by_room.get(r)), capacity)
            members = by_room[room].pop() if room < capacity else []
            members.append(member)
            by_room.setdefault(room - member[2], []).append(members)
        yield _batch([r for room in sorted(by_room) for members in by_room[room] for r in closed(members)], _BINS)

    return pieces.mapInArrow(run, _schema(_BINS))


def _placed(rows: DataFrame, part: str, at: str, length: str) -> DataFrame:
    """``rows`` with ``pos``: ``at`` plus all lengths of the parts before. One row per task is summed up."""
    totals = rows.groupBy(part).agg(F.sum(length).alias("_n"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return rows.join(totals, part).withColumn("pos", F.col(at) + F.col("_before")).drop("_before")


def cut_to_gaps(pairs: DataFrame) -> DataFrame:
    """The piece of ``ids`` from ``skip`` with ``length`` tokens, with its checksum."""
    fields = _NAMED | {"sequence_id": pa.int64(), "offset": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, start, length, total, seq, offset, skip = (batch.column(c) for c in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "skip"))
            spans = zip(batch.column("ids"), skip.to_pylist(), length.to_pylist(), strict=True)
            crc = [zlib.crc32(ids.as_buffer()[4 * s : 4 * (s + n)]) for ids, s, n in spans]
            yield pa.RecordBatch.from_arrays([doc, start, length, pa.array(crc, pa.int64()), total, seq, offset], names=[*fields])

    chosen = pairs.select("doc_id", (F.col("start") + F.col("skip")).alias("start"), "length", "doc_tokens", "sequence_id", "offset", "skip", "ids")
    return chosen.mapInArrow(run, _schema(fields))


def pack(
    docs: DataFrame,
    tokenizer_json: str,
    ranks: str | None = None,
    pattern: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 1024,
) -> DataFrame:
    """Packs all documents into sequences of at most ``capacity`` tokens.

    A document is its text's ids and a closing id 0. Documents that fit in a
    sequence stay whole: they are partitioned into the reciprocal classes
    (capacity/(k+1), capacity/k], and every worker fills its own bins of class
    k with k of them (``class_bins``). Documents above ``capacity`` are cut
    into whole sequences, and what remains of them fills the gaps that bins
    leave: gaps and filling tokens are both numbered by position, laid over
    each other in a join on ranges of positions, and what is left of the
    filling tokens makes sequences of its own. Padding is then the last
    sequence only. Where long documents are too few to fill all gaps, further
    pieces fill them (``Balance``), so that each task of the first pass leaves
    about two sequences of gaps at most.

    Returns ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset`` per piece; sequence ids are distinct but not dense. Null and empty
    texts are the closing id alone. Null ids and rows that repeat an id are
    packed each. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), filled(text_col).alias("text"))
    pieces = cut(tokenized_pieces(rows, (tokenizer_json, ranks, pattern), capacity))
    named, kind = [*_NAMED], F.col("kind")
    number = lambda part, n, of: ((part * F.lit(1 << 32) + n) * 3 + F.lit(of)).cast("long").alias("sequence_id")
    whole = pieces.filter(kind == WHOLE).select(*named, number(F.col("part"), F.col("at"), WHOLE), F.lit(0).cast("long").alias("offset"))
    classed = pieces.filter(kind == CLASSED).select(*named)
    workers = max(1, -(-classed.count() // SLICE_ROWS))
    bins = cut(class_bins(classed.repartition(workers), capacity))
    in_bins = bins.filter("doc_id is not null or start is not null").select(*named, number(F.col("part"), F.col("bin"), CLASSED), "offset")
    open_bins = bins.filter("start is null").select("part", number(F.col("part"), F.col("bin"), CLASSED), F.col("offset").alias("used"), F.col("length").alias("gap"), "gap_at")
    gaps = _placed(open_bins, "part", "gap_at", "gap").withColumnRenamed("pos", "gap_pos")
    room = open_bins.agg(F.coalesce(F.sum("gap"), F.lit(0))).first()[0]
    filling = _placed(pieces.filter(kind == FILLER).withColumnRenamed("length", "n"), "part", "at", "n")
    filling = filling.select("doc_id", "start", "doc_tokens", "n", "ids", "pos")
    in_bucket = lambda at, n: F.explode(F.sequence(F.floor(at / F.lit(BUCKET * capacity)), F.floor((at + n - 1) / F.lit(BUCKET * capacity))))
    first, last = F.greatest("pos", "gap_pos"), F.least(F.col("pos") + F.col("n"), F.col("gap_pos") + F.col("gap"))
    met = (
        filling.filter(F.col("pos") < room)
        .withColumn("bucket", in_bucket(F.col("pos"), F.col("n")))
        .join(gaps.withColumn("bucket", in_bucket(F.col("gap_pos"), F.col("gap"))), "bucket")
        .filter((first < last) & (F.floor(first / F.lit(BUCKET * capacity)) == F.col("bucket")))
        .withColumns({"skip": first - F.col("pos"), "length": last - first, "offset": F.col("used") + first - F.col("gap_pos")})
    )
    # What lies beyond all gaps makes sequences of its own.
    begin = F.greatest(F.col("pos"), F.lit(room))
    count = lambda at: F.floor((at - room) / F.lit(capacity))
    opens: Column = F.lit(room) + F.col("bin") * capacity
    first, last = F.greatest(begin, opens), F.least(F.col("pos") + F.col("n"), opens + capacity)
    beyond = (
        filling.filter(F.col("pos") + F.col("n") > room)
        .withColumn("bin", F.explode(F.sequence(count(begin), count(F.col("pos") + F.col("n") - 1))))
        .withColumns({"skip": first - F.col("pos"), "length": last - first, "offset": first - opens, "sequence_id": F.col("bin") * 3 + FILLER})
    )
    used = ["doc_id", "start", "doc_tokens", "ids", "skip", "length", "sequence_id", "offset"]
    return whole.unionByName(in_bins).unionByName(cut_to_gaps(met.select(*used).unionByName(beyond.select(*used))))
