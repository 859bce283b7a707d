"""SimHash near-duplicates through a byte-position inverted index with count filtering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, filled
from .components import components

BYTES = 8
#: Postings of more fingerprints than this are linked through midpoints, which
#: is exact too and linear in their number.
PAIRWISE = 64
_ROWS = 1 << 16


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit hashes have each bit set, lowest bit first."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _ROWS):
        part = np.unpackbits(hashes[at : at + _ROWS].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(part) // 255 * 255
        if whole:  # up to 255 rows are added up inside single bytes, eight at a time
            sums = part[:whole].view(np.uint64).reshape(-1, 255, 8).sum(axis=1, dtype=np.uint64)
            total += sums.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
        total += part[whole:].sum(axis=0, dtype=np.int64)
    return total


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """64-bit SimHash of a UTF-8 text: A-Z lower-cased, words between ASCII blanks, shingles with repeats, XXH64 of seed 42."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        parts = [b" ".join(words)]
    else:
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        parts = [line[s:e] for s, e in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(p, 42) for p in parts], np.uint64)
    bits = bit_counts(hashes) * 2 > len(hashes)
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """``doc_id, fp`` (signed 64 bits) per input row; null text: empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), filled(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(keys, values, whole) of key-sorted batches, cut between runs of a key; ``whole`` is false while a run goes on beyond ``_ROWS``."""
    keys, values = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.concatenate((keys, batch.column(0).to_numpy()))
        values = np.concatenate((values, batch.column(1).to_numpy()))
        at = int(np.searchsorted(keys, keys[-1]))
        if at:
            yield keys[:at], values[:at], True
            keys, values = keys[at:], values[at:]
        elif len(keys) > _ROWS:
            yield keys, values, False
            keys, values = keys[:0], values[:0]
    if len(values):
        yield keys, values, True


def index_links(distinct: DataFrame, most: int, pairwise: int = PAIRWISE) -> DataFrame:
    """``kind, u, v`` from the inverted index over byte positions.

    Two fingerprints that differ in at most ``most`` bits differ in at most as
    many bytes, so at least ``8 - most`` positional bytes are shared: the
    guaranteed minimum of the count filter. Postings are kept per choice of so
    many positions with their bytes, which finds exactly the pairs that reach
    the minimum without tallying those that share fewer bytes. In a posting
    list the shared bytes of each pair are tallied and its distance verified;
    a list gives a star for each group of fingerprints that its verified pairs
    join (kind 0). Members of lists above ``pairwise`` are given as (kind 1):
    their links come from ``midpoint_links``, which needs no pairs, so the work
    of a list grows with its length only. Both ways give the same links; the
    tests run each way alone.
    """
    shared = BYTES - most
    choices = [*combinations(range(BYTES), shared)]
    picked = [sum(0xFF << (8 * p) for p in c) for c in choices]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    keys = F.array(*[F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(signed(m)))) for k, m in enumerate(picked)])
    postings = distinct.select(F.explode(keys).alias("key"), "fp")
    # The key is a hash of choice and bytes; lists that meet by chance only hold more pairs to verify.
    postings = postings.repartition("key").sortWithinPartitions("key", "fp")

    def star(members: np.ndarray) -> list[tuple[int, int]]:
        x = members[:, None] ^ members[None, :]
        tally = np.zeros(x.shape, np.uint8)
        for p in range(BYTES):
            tally += ((x >> np.uint64(8 * p)) & np.uint64(0xFF)) == 0
        near = (tally >= shared) & (np.bitwise_count(x) <= most)
        group = np.arange(len(members))
        while True:
            low = np.where(near, group[None, :], len(members)).min(axis=1)
            low = np.minimum(low, low[low])
            if (low == group).all():
                break
            group = low
        return [(g, k) for k, g in enumerate(group.tolist()) if g != k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "u", "v"]
        make = lambda kind, u, v: pa.RecordBatch.from_arrays([pa.array(np.full(len(u), kind, np.int64)), pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=names)
        hot: int | None = None
        for keys, values, whole in _runs(batches):
            fps = values.view(np.uint64)
            if not whole or (hot is not None and len(keys) and keys[0] == hot):
                cut_at = len(values) if not whole else int(np.searchsorted(keys, hot, side="right"))
                yield make(1, fps[:cut_at], fps[:cut_at])
                hot = int(keys[0]) if not whole else None
                keys, fps = keys[cut_at:], fps[cut_at:]
                if not len(fps):
                    continue
            starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            sizes = np.diff(np.append(starts, len(keys)))
            two = starts[sizes == 2]
            a, b = fps[two], fps[two + 1]
            x = a ^ b
            tally = sum((((x >> np.uint64(8 * p)) & np.uint64(0xFF)) == 0).astype(np.uint8) for p in range(BYTES))
            ok = (tally >= shared) & (np.bitwise_count(x) <= most)
            us, vs = [a[ok]], [b[ok]]
            for s, n in zip(starts[(sizes > 2) & (sizes <= pairwise)].tolist(), sizes[(sizes > 2) & (sizes <= pairwise)].tolist(), strict=True):
                members = fps[s : s + n]
                if found := star(members):
                    found = np.array(found)
                    us.append(members[found[:, 0]])
                    vs.append(members[found[:, 1]])
            u, v = np.concatenate(us), np.concatenate(vs)
            if len(u):
                u, v = np.unique(np.stack((u, v)), axis=1)
                yield make(0, np.ascontiguousarray(u), np.ascontiguousarray(v))
            many = np.concatenate([fps[s : s + n] for s, n in zip(starts[sizes > pairwise].tolist(), sizes[sizes > pairwise].tolist(), strict=True)] or [fps[:0]])
            if len(many):
                many = np.unique(many)
                yield make(1, many, many)

    return postings.mapInArrow(run, "kind long, u long, v long")


def midpoint_links(members: DataFrame, most: int) -> DataFrame:
    """``u, v`` links that join the same fingerprints as all pairs within ``most`` bits would.

    Two fingerprints are within ``most`` bits exactly if some value is within
    half of that of both, so every fingerprint is dealt to all values around
    it, and each value links those it got to the smallest. Linear in the
    fingerprints, and a value never gets more of them than there are values
    around it. ``most`` must be even.
    """
    if most % 2:
        raise ValueError("midpoints need an even distance")
    radius = most // 2
    masks = np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(64), r)], np.uint64)

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fps in np.array_split(batch.column(0).to_numpy().view(np.uint64), max(1, batch.num_rows // 64)):
                near = (fps[:, None] ^ masks[None, :]).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(near.view(np.int64)), pa.array(np.repeat(fps, len(masks)).view(np.int64))], names=["key", "fp"])

    dealt = members.select("fp").mapInArrow(around, "key long, fp long").repartition("key").sortWithinPartitions("key", "fp")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, values, _ in _runs(batches):
            starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            low = np.repeat(values[starts], np.diff(np.append(starts, len(keys))))
            apart = np.bitwise_count(low.view(np.uint64) ^ values.view(np.uint64))
            pairs = np.unique(np.stack((low, values))[:, (apart > 0) & (apart <= most)], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[0])), pa.array(np.ascontiguousarray(pairs[1]))], names=["u", "v"])

    return dealt.mapInArrow(link, "u long, v long")


def fingerprint_links(distinct: DataFrame, most: int, pairwise: int = PAIRWISE) -> DataFrame:
    """``u, v`` links that join the distinct fingerprints ``fp`` as all pairs within ``most`` bits would."""
    found = cut(index_links(distinct, most, pairwise).distinct())
    many = found.filter("kind = 1").select(F.col("u").alias("fp"))
    return found.filter("kind = 0").select("u", "v").unionByName(midpoint_links(many, most).distinct())


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, most: int = 4, pairwise: int = PAIRWISE
) -> DataFrame:
    """``doc_id, fingerprint, component_id`` per input row.

    Documents with equal fingerprints collapse to one node before anything is
    compared, so exact copies cost nothing further. Distinct fingerprints are
    linked at ``most`` or fewer differing bits through the inverted index (see
    ``index_links``), those of large posting lists through midpoints, which
    needs an even ``most`` (an odd one raises ``ValueError``), and components
    are the closure of the links. ``component_id`` is the smallest id that is
    reachable. No link is capped or lost.

    Null and empty texts have fingerprint zero and link like any other; null
    ids never are the smallest unless a component has no other id (then null);
    repeated rows give a row each; an empty table gives no rows.
    """
    rows = cut(fingerprints(docs, id_col, text_col, shingle))
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("low"))
    joined = components(fingerprint_links(nodes.select("fp"), most, pairwise), "u", "v")
    named = nodes.join(joined, nodes["fp"] == joined["node"], "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))
    named = cut(named)
    lowest = cut(named.groupBy("component").agg(F.min("low").alias("component_id")))  # cut, so that the join can be split
    named = named.join(lowest, "component").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
