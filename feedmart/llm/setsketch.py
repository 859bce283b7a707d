"""MinHash near-duplicates through SetSketch registers: bands of them give candidates, their joint likelihood sifts, the sets decide."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.groups import top_n
from .common import Tables, cut, filled, release
from .components import components
from .shingles import among, shingle_hashes, verified
from .simhash import fingerprint

#: Registers, their base, their rate and the largest value of one.
REGISTERS, BASE, RATE, TOP = 256, 1.001, 20.0, 65535
#: Registers of a band. A pair of similarity 0.8 shares none of the 51 bands once in 600 million.
BAND = 5
BANDS = REGISTERS // BAND
#: A pair is sifted out where twice the gap of log-likelihood between its best similarity and the wanted one is above this: a true
#: pair goes so once in 4 * 10^9. Pairs of fewer shingles than ``FEW`` together are never sifted.
GAP, FEW = 40.0, 64
#: Cells over which a set's hashes are counted, in a byte each: two sets share no more than the sum of the smaller counts.
CELLS = 512
#: Texts of one band that are compared at once, and how many partners in other components a text is verified with, round by round; the last is every one.
BLOCK, PARTNERS = 64, (64, None)
#: Blocks of one list that a task compares with others; a list of no more blocks is compared with itself in one row.
RUN = 16


def enough(least: float) -> float:
    """Equal registers below this many rule a similarity out before its likelihood is formed: ten standard deviations."""
    return REGISTERS * least - 10 * (REGISTERS * least * (1 - least)) ** 0.5


_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


#: Half-byte functions of the four rounds by which an element's own permutation of the registers is formed.
_ROUNDS = (_mix(np.arange(1, 4097, dtype=np.uint64)) & np.uint64(15)).astype(np.uint8).reshape(256, 16)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Registers of a set of 64-bit hashes.

    Each element draws ``REGISTERS`` exponential values, one from each of the
    intervals that hold a like share of the distribution, in rising order, and
    lays them into the registers in an order of its own. A register keeps the
    least value x as ``floor(1 - log_BASE(x))``, cut to its range. As all
    elements draw from the same interval at the same step, a register that one
    step has filled is final, and steps end when all registers are full: the
    work is that of the larger of the set and ``REGISTERS * log REGISTERS``.
    Registers of a union are the larger ones of its parts.
    """
    least = np.full(REGISTERS, np.inf)
    h = _mix(hashes.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    keys = _mix(h ^ np.uint64(0x5851F42D4C957F2D)).view(np.uint8).reshape(-1, 8)
    step = 0
    wide = max(1, 4096 // max(1, len(h)))
    while step < REGISTERS and len(h):
        at = np.arange(step, min(REGISTERS, step + wide))
        draw = _mix(h[:, None] + (at.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95)[None])
        left, right = np.broadcast_to(at >> 4, draw.shape), np.broadcast_to(at & 15, draw.shape)
        for k in range(4):
            left, right = right, left ^ _ROUNDS[keys[:, k, None], right]
        slot = (left.astype(np.uint64) << np.uint64(4)) | right.astype(np.uint64)
        # Register, step and draw in one number: the first of each register is its least value.
        order = np.sort(((slot << np.uint64(56)) | (at.astype(np.uint64) << np.uint64(48))[None] | (draw >> np.uint64(16))).ravel())
        where = (order >> np.uint64(56)).astype(np.int64)
        first = np.flatnonzero(np.diff(where, prepend=-1))
        slots, found = where[first], order[first]
        fresh = np.isinf(least[slots])
        slots, found = slots[fresh], found[fresh]
        steps = ((found >> np.uint64(48)) & np.uint64(255)).astype(np.float64)
        unit = ((found & np.uint64((1 << 48) - 1)).astype(np.float64) + 0.5) / (1 << 48)
        least[slots] = -np.log((REGISTERS - steps - unit) / REGISTERS) / RATE
        if not np.isinf(least).any():
            break
        step += wide
    with np.errstate(divide="ignore"):
        return np.clip(np.floor(1 - np.log(least) / log(BASE)), 0, TOP).astype(np.uint16)


def cell_counts(hashes: np.ndarray) -> np.ndarray:
    return np.minimum(np.bincount((_mix(hashes.view(np.uint64)) & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS), 255).astype(np.uint8)


#: Equal half-bytes in an exclusive or of two bytes.
_ALIKE = np.array([(x >> 4 == 0) + (x & 15 == 0) for x in range(256)], np.uint8)


def marks(registers: np.ndarray) -> np.ndarray:
    """The lowest four bits of each register, two in a byte: equal registers have equal ones, so these are no fewer."""
    low = (registers & 15).astype(np.uint8)
    return low[:, ::2] | (low[:, 1::2] << 4)


def likelihood_gap(greater: np.ndarray, less: np.ndarray, n_u: np.ndarray, n_v: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(similarity of greatest likelihood, twice the log-likelihood it has above that of similarity ``least``, 0 where it is larger itself).

    From the numbers of registers in which the first or the second sketch is
    greater, and both sizes, which are known. Pairs whose sizes rule ``least``
    out have an infinite gap.
    """
    u, v = n_u / (n_u + n_v), n_v / (n_u + n_v)
    equal = REGISTERS - greater - less
    share = lambda x: -np.log1p(-x * (BASE - 1) / BASE) / log(BASE)

    def likelihood(j: np.ndarray) -> np.ndarray:
        up, down = share(np.maximum(u - v * j, 1e-12)), share(np.maximum(v - u * j, 1e-12))
        return greater * np.log(up) + less * np.log(down) + equal * np.log(np.maximum(1 - up - down, 1e-12))

    most = np.minimum(u / v, v / u)
    low, high = np.zeros(len(u)), most.copy()
    for _ in range(40):  # the likelihood is concave
        a, b = low + (high - low) / 3, high - (high - low) / 3
        up = likelihood(a) < likelihood(b)
        low, high = np.where(up, a, low), np.where(up, high, b)
    best = (low + high) / 2
    gap = np.where(best >= least, 0.0, 2 * (likelihood(best) - likelihood(np.minimum(least, most))))
    return best, np.where(most < least - 1e-9, np.inf, gap)


def sifted(a: np.ndarray, b: np.ndarray, cells_a: np.ndarray, cells_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(which pairs stay, their estimated similarity): by the likelihood of their registers, and by what their cells let them share at most.

    The second bound is no estimate: no pair of similarity ``least`` falls to
    it. A count of 255 stands for any larger one, so with it there is no bound.
    """
    best, gap = likelihood_gap((a > b).sum(axis=1), (a < b).sum(axis=1), n_a.astype(float), n_b.astype(float), least)
    near = np.minimum(n_a, n_b) >= least * np.maximum(n_a, n_b) - 1e-9
    stays = near & ((gap <= GAP) | (n_a + n_b < FEW))
    some = np.flatnonzero(stays)
    most = np.minimum(cells_a[some], cells_b[some]).sum(axis=1, dtype=np.int64)
    whole = (cells_a[some].max(axis=1, initial=0) == 255) | (cells_b[some].max(axis=1, initial=0) == 255)
    stays[some] = whole | (most >= least * (n_a[some] + n_b[some] - most) - 1e-6)
    return stays, best


def sketched(rows: DataFrame, shingle: int, simhash: bool = False) -> DataFrame:
    """``doc_id, raw, norm, n, sketch, fp`` of every row ``doc_id, raw, text``: MD5 of its words, number of shingles, registers and cells, SimHash if asked for; no words give null ones."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple[int, bytes, int | None]] = {}
        for batch in batches:
            norms, sizes, made, prints = [], [], [], []
            for value in batch.column(2):
                words = value.as_py().lower().split()
                if not words:
                    norms.append(None), sizes.append(0), made.append(None), prints.append(None)
                    continue
                line = b" ".join(words)
                norm = hashlib.md5(line).digest()
                if norm not in held:
                    if len(held) >= 1000:
                        held.clear()
                    own = shingle_hashes(line, shingle)
                    bits = int(np.uint64(fingerprint(line, shingle)).view(np.int64)) if simhash else None
                    held[norm] = len(own), sketch(own).tobytes() + cell_counts(own).tobytes(), bits
                norms.append(norm), sizes.append(held[norm][0]), made.append(held[norm][1]), prints.append(held[norm][2])
            columns = [pa.array(norms, pa.binary()), pa.array(sizes, pa.int64()), pa.array(made, pa.binary()), pa.array(prints, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "raw", "norm", "n", "sketch", "fp"])

    return rows.select("doc_id", "raw", "text").mapInArrow(run, "doc_id long, raw binary, norm binary, n long, sketch binary, fp long")


def _bytes(column: pa.Array, width: int) -> np.ndarray:
    """A row of ``width`` bytes for each value, with no Python object made of any."""
    own = column.cast(pa.binary(width))
    return np.frombuffer(own.buffers()[1], np.uint8)[own.offset * width : (own.offset + len(own)) * width].reshape(-1, width)


def _parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Registers and cells."""
    both = _bytes(column, 2 * REGISTERS + CELLS)
    return both.view(np.uint16)[:, :REGISTERS], both[:, 2 * REGISTERS :]


def _sift_pairs(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """``u, v, like`` of the pairs ``u, v`` whose sketches allow the similarity."""
    known = among(nodes.select("node", "n", "sketch"), "node", pairs.select(F.explode(F.array("u", "v")).alias("node")))
    side = lambda name: known.select(F.col("node").alias(name), F.col("n").alias(f"n_{name}"), F.col("sketch").alias(f"s_{name}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                (a, cells_a), (b, cells_b) = _parts(batch.column(4)), _parts(batch.column(5))
                stays, like = sifted(a, b, cells_a, cells_b, batch.column(2).to_numpy(), batch.column(3).to_numpy(), least)
                stays = pa.array(stays)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(stays), batch.column(1).filter(stays), pa.array(like).filter(stays)], names=["u", "v", "like"])

    return pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "n_u", "n_v", "s_u", "s_v").mapInArrow(run, "u long, v long, like double")


def _block_pairs(members: DataFrame, parts: DataFrame) -> DataFrame:
    """``band, key, first, held``: pairs of blocks of one band's list, with what ``parts`` has of each member.

    ``held`` has the members of both blocks, those of the one before those of
    the other, and ``first`` how many the one has; it is 0 for a block that
    meets itself, which is held once. ``parts`` may have more rows than those
    of members. Lists of up to ``RUN * BLOCK`` texts are one block that meets
    itself; longer ones are cut into blocks of about ``BLOCK`` texts.
    """
    counts = members.groupBy("band", "key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    placed = members.join(counts, ["band", "key"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    held = placed.join(parts, "node")
    gathered_rows = F.collect_list(F.struct("node", "component", *[c for c in parts.columns if c != "node"]))
    # Sketches are the bulk of what is held, so they are dealt once: a list of up to ``RUN`` blocks meets in one row, blocks of
    # longer ones are gathered where they are compared, and neither is written.
    alone = held.filter(F.col("blocks") <= RUN).groupBy("band", "key").agg(gathered_rows.alias("held")).select("band", "key", F.lit(0).alias("first"), "held")
    # Runs of ``RUN`` blocks meet all blocks from their own on; as many tasks share a list as it has runs. Both sides are dealt
    # here, as a join that Spark splits by size on both sides makes tasks by the square of a list's size.
    several = held.filter(F.col("blocks") > RUN).withColumn("run", F.floor(F.col("block") / RUN).cast("int"))
    keys = ["band", "key", "run"]
    dealt = lambda rows, block, name: rows.repartition(*keys).groupBy(*keys, "block").agg(gathered_rows.alias(name)).withColumnRenamed("block", block)
    one = dealt(several, "b_u", "h_u")
    other = dealt(several.withColumn("run", F.explode(F.sequence(F.lit(0), F.col("run")))), "b_v", "h_v")
    same = F.col("b_u") == F.col("b_v")
    first = F.when(same, 0).otherwise(F.size("h_u")).alias("first")
    pairs = one.join(other.hint("merge"), keys).filter("b_u <= b_v").select("band", "key", first, F.when(same, F.col("h_u")).otherwise(F.concat("h_u", "h_v")).alias("held"))
    return alone.unionByName(pairs)


def _pairs_of(batch: pa.RecordBatch, least: float) -> Iterator[tuple[np.ndarray, ...]]:
    """Places of texts that are to be compared, in different components and of like size, and their row, from one pair of blocks after the other."""
    held = batch.column(3)
    component, size = (held.values.field(k).to_numpy() for k in (1, 2))
    ends = held.offsets.to_numpy()
    for row, first in enumerate(batch.column(2).to_pylist()):
        a, d = ends[row : row + 2]
        b, c = (a + first, a + first) if first else (d, a)
        x, y = size[a:b, None], size[None, c:d]
        near = (component[a:b, None] != component[None, c:d]) & (np.minimum(x, y) >= least * np.maximum(x, y) - 1e-9)
        i, j = np.nonzero(near if first else np.triu(near, 1))
        yield i + a, j + c, np.full(len(i), row)


def _gathered(pairs: Iterator[tuple[np.ndarray, ...]]) -> Iterator[list[np.ndarray]]:
    """The same in portions of bounded size."""
    held: list[tuple[np.ndarray, ...]] = []
    portion = lambda: [np.concatenate(c) for c in zip(*held, strict=True)]
    for p in pairs:
        held.append(p)
        if sum(len(h[0]) for h in held[-64:]) >= 8192 or len(held) >= 4096:
            every, held = portion(), []
            yield from ([c[at : at + 8192] for c in every] for at in range(0, len(every[0]), 8192))
    if held:
        every = portion()
        yield from ([c[at : at + 8192] for c in every] for at in range(0, len(every[0]), 8192))


def _partnered(members: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """``band, key, node`` of the members of lists that may have a link there to another component: by the marks of their sketches, an eighth of these.

    Most texts that meet in a list by chance have no partner in it, so their
    sketches are not dealt. Equal marks are no fewer than equal registers, so
    no pair goes here that ``_between`` would keep.
    """

    def marked(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = marks(_parts(batch.column(2))[0])
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([m.tobytes() for m in made], pa.binary())], names=["node", "n", "mark"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            held = batch.column(3)
            mark = _bytes(held.values.field(3), REGISTERS // 2)
            met = np.zeros(len(mark), bool)
            for i, j, _ in _gathered(_pairs_of(batch, least)):
                new = ~(met[i] & met[j])
                i, j = i[new], j[new]
                some = _ALIKE[mark[i] ^ mark[j]].sum(axis=1, dtype=np.int64) >= enough(least)
                met[i[some]] = met[j[some]] = True
            at = np.flatnonzero(met)
            row = pa.array(np.searchsorted(held.offsets.to_numpy(), at, "right") - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), held.values.field(0).take(pa.array(at))], names=["band", "key", "node"])

    parts = among(nodes.select("node", "n", "sketch"), "node", members, marked, "node long, n long, mark binary")
    return _block_pairs(members, parts).mapInArrow(run, "band int, key long, node long").distinct()


def _between(members: DataFrame, nodes: DataFrame, least: float, partners: int | None) -> DataFrame:
    """``u, v, like`` of pairs in one band's list that are in different components and whose sketches allow the similarity; of each ``u`` the likeliest ``partners``.

    Blocks of lists are compared inside a task, register by register. Only what
    stays is handed on. A pair is looked at in the first band that it shares,
    so it comes once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            held = batch.column(3).values
            registers, cells = _parts(held.field(3))
            size = held.field(2).to_numpy()
            bands = batch.column(0).to_numpy()
            for i, j, row in _gathered(_pairs_of(batch, least)):
                equal = registers[i] == registers[j]
                whole = equal[:, : BANDS * BAND].reshape(len(i), BANDS, BAND).all(axis=2)
                some = np.flatnonzero((equal.sum(axis=1) >= enough(least)) & (whole.argmax(axis=1) == bands[row]))
                i, j = i[some], j[some]
                stays, like = sifted(registers[i], registers[j], cells[i], cells[j], size[i], size[j], least)
                i, j, like = i[stays], j[stays], like[stays]
                if partners is not None and len(i):
                    order = np.lexsort((-like, i))
                    i, j, like = i[order], j[order], like[order]
                    start = np.flatnonzero(np.diff(i, prepend=-1))
                    ahead = np.arange(len(i)) - np.repeat(start, np.diff(np.append(start, len(i))))
                    i, j, like = (c[ahead < partners] for c in (i, j, like))
                yield pa.RecordBatch.from_arrays([held.field(0).take(pa.array(i)), held.field(0).take(pa.array(j)), pa.array(like)], names=["u", "v", "like"])

    found = _block_pairs(members, among(nodes.select("node", "n", "sketch"), "node", members)).mapInArrow(run, "u long, v long, like double")
    return found if partners is None else top_n(found, ["u"], [F.col("like").desc(), "v"], partners)


def node_components(nodes: DataFrame, rows: DataFrame, shingle: int, least: float, proposed: DataFrame | None = None) -> DataFrame:
    """``node, component`` of the nodes that have links; ``nodes`` has ``node, key, n, sketch``, ``rows`` ``key, text`` of each node's text.

    Pairs ``u, v`` that another method proposes are verified before all else;
    what they join is not compared again.

    First each band's list is compared with its member that shares the most
    lists with others (of copies of one text that is that text), for each text
    only with the likeliest one, which joins large groups of copies by as many
    comparisons as they have texts. Then the lists that still hold several
    components are searched for pairs between two of them that the sketches
    allow: members that their marks leave a partner there are compared by whole
    sketches, each text's likeliest few are verified and joined first, then more,
    and in the end every pair whose components that has not joined. So no pair
    that shares a band and may be linked between components goes unread, and a
    large group is joined before its pairs are many.
    """
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.struct(k.alias("band"), F.xxhash64(F.substr(F.col("sketch"), k * (2 * BAND) + 1, F.lit(2 * BAND))).alias("key")))
    postings = nodes.select("node", F.explode(bands).alias("b")).select("node", "b.band", "b.key")
    lists = postings.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    shared = cut(postings.join(cut(lists).hint("merge"), ["band", "key"]))
    met = shared.groupBy("node").agg(F.sum(F.col("size") - 1).alias("met"))
    hubs = shared.join(cut(met).hint("merge"), "node").groupBy("band", "key").agg(F.max(F.struct("met", "node")).alias("hub")).select("band", "key", F.col("hub.node").alias("hub"))
    first = shared.join(cut(hubs).hint("merge"), ["band", "key"]).filter("node <> hub").select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b"), "node").groupBy("a", "b").agg(F.min("node").alias("v"))
    first = first.select(F.when(F.col("v") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("u"), "v")
    begun = None
    if proposed is not None:
        begun = cut(verified(cut(proposed), nodes, rows, shingle, least))
        known = components(begun, "u", "v")
        at = lambda name: known.select(F.col("node").alias(name), F.col("component").alias(f"c_{name}"))
        first = first.join(at("u").hint("merge"), "u", "left").join(at("v").hint("merge"), "v", "left").filter("c_u is null or c_v is null or c_u <> c_v").select("u", "v")
    likely = _sift_pairs(cut(first), nodes, least)
    likely = cut(likely.groupBy("v").agg(F.max(F.struct("like", "u")).alias("best")).select("best.u", "v"))
    links = cut(verified(likely, nodes, rows, shingle, least))
    links = links if begun is None else links.unionByName(begun)
    joined = components(links, "u", "v")
    release(nodes.sparkSession)
    may = shared.select("band", "key", "node")
    for partners in PARTNERS:
        marked = cut(may.join(joined.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node")))
        mixed = cut(marked.groupBy("band", "key").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a <> b").select("band", "key"))
        met = cut(marked.join(mixed.hint("merge"), ["band", "key"]))
        if partners == PARTNERS[0]:  # components only grow, so who has no partner now has none later
            may = cut(_partnered(met, nodes, least))
            met = cut(met.join(may.hint("merge"), ["band", "key", "node"]))
        tried = cut(_between(met, nodes, least, partners).select("u", "v"))
        release(nodes.sparkSession)
        more = cut(verified(tried, nodes, rows, shingle, least))
        if more.limit(1).count():
            links = links.unionByName(more)
            joined = components(links, "u", "v")
        if partners is None:
            break
        # A pair that was left out has a text with all its partners tried, so only such texts' lists are searched again.
        full = cut(tried.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= partners).select(F.col("u").alias("node")))
        if not full.limit(1).count():
            break
        again = cut(may.join(full.hint("merge"), "node").select("band", "key").distinct())
        may = cut(may.join(again.hint("merge"), ["band", "key"]).select("band", "key", "node"))
    return joined


def near_classes(docs: DataFrame, id_col: str, text_col: str, shingle: int, least: float, proposing: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(``doc_id, raw, n, node`` of every row, ``node, component`` of nodes with links); rows without words have no node. ``proposing`` gives pairs from the nodes' ``node, fp``."""
    release(docs.sparkSession)
    text = filled(text_col).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.md5(text)).alias("raw"), text.alias("text"))
    # Sketches are most of what is held: rows' own are dropped once texts of the same words are one node, nodes' own at the end.
    tables = Tables(docs.sparkSession, "sketches")
    placed = tables.write(sketched(rows, shingle, proposing is not None))
    worded = placed.filter("n > 0")
    nodes = worded.groupBy("norm").agg(F.min(F.struct("raw", "n", "sketch", "fp")).alias("x"))
    nodes = tables.write(nodes.select(F.monotonically_increasing_id().alias("node"), "norm", F.hex("x.raw").alias("key"), "x.n", "x.sketch", "x.fp"))
    known = cut(placed.join(nodes.select("norm", "node"), "norm", "left").select("doc_id", "raw", "n", "node"))
    tables.drop(placed)
    proposed = None if proposing is None else proposing(nodes.select("node", "fp"))
    found = node_components(nodes, rows.select(F.hex("raw").alias("key"), "text"), shingle, least, proposed)
    return known, tables.close(found)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, least: float = 0.8) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, a row per document.

    Documents are linked where the sets of their distinct shingles of words
    (A-Z lower-cased, between ASCII blanks; a shorter text is one shingle) have
    a Jaccard similarity of ``least`` or more; ``component_id`` is the smallest
    id that links reach. Texts of the same words are one node. Candidates share
    a band of SetSketch registers; every link is confirmed on the full sets.

    Null texts and such without words have no shingle and no link: they are
    their own component. Rows of one id are documents of their own, so several
    of one id may be kept; where a component has rows without id, null ids come
    last. An empty table gives no rows; other columns are never read.
    """
    known, found = near_classes(docs, id_col, text_col, shingle, least)
    known = cut(known.join(found.hint("merge"), "node", "left").select("doc_id", "n", F.coalesce("component", "node").alias("component")))
    low = known.filter("component is not null").groupBy("component").agg(F.min("doc_id").alias("low"))
    out = known.join(low.hint("merge"), "component", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("low")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
