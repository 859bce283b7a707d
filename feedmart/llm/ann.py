"""Approximate nearest neighbours by a forest of random-projection trees."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Rows of one block, and queries of one block, that meet in one group, at most on the average; blocks of rows at least.
BLOCK_ROWS, BLOCK_QUERIES, BLOCKS = 65_536, 32_768, 16
#: Queries whose bounds are formed at once.
TOGETHER = 16
#: Queries, at most, whose true neighbours are found by brute force to set how many leaves a search visits.
PROBES = 128


@dataclass
class Forest:
    """Complete trees: node k of a tree has children 2k+1 and 2k+2. A tree has one random direction a level, ``planes[tree, level]``, and ``cuts[tree, node]``."""

    planes: np.ndarray
    cuts: np.ndarray
    depth: int
    reach: float  # length that the added component fills up to

    def values(self, x: np.ndarray, added: bool = True) -> np.ndarray:
        """Rows projected on each tree's directions: [row, tree, level].

        A component is added to rows that makes them equally long, so that the
        largest inner product is the nearest one; queries have zero there.
        """
        out = np.einsum("nd,tkd->ntk", x, self.planes[:, :, :-1], optimize=True)
        if added:
            rest = np.sqrt(np.maximum(0.0, self.reach**2 - (x * x).sum(axis=1)))
            out += rest[:, None, None] * self.planes[None, :, :, -1]
        return out

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row in each tree, counted from 0."""
        values, out = self.values(x), np.zeros((len(x), len(self.planes)), np.int64)
        for t in range(len(self.planes)):
            for level in range(self.depth):
                out[:, t] = 2 * out[:, t] + (values[:, t, level] > self.cuts[t, 2**level - 1 + out[:, t]])
        return out

    def bounds_of(self, queries: np.ndarray) -> np.ndarray:
        """[query, tree, leaf]: the largest margin by which a way to the leaf lies on the other side of a cut than the query."""
        values = self.values(queries, added=False)
        bound = np.full((len(queries), len(self.planes), 1), -math.inf)
        for level in range(self.depth):
            margin = values[:, :, level, None] - self.cuts[None, :, 2**level - 1 : 2 ** (level + 1) - 1]
            bound = np.stack((np.maximum(bound, margin), np.maximum(bound, -margin)), axis=3).reshape(*bound.shape[:2], -1)
        return bound

    def bounds(self, query: np.ndarray) -> np.ndarray:
        """The same of one query: [tree, leaf]."""
        return self.bounds_of(query[None, :])[0]

    def reached(self, queries: np.ndarray, visits: int) -> np.ndarray:
        """[query, ``tree * leaves + leaf``]: whether a leaf is among the first ``visits`` of the queue; leaves that tie with the last are."""
        bound = self.bounds_of(queries).reshape(len(queries), -1)
        if visits >= bound.shape[1]:
            return np.ones(bound.shape, bool)
        last = np.partition(bound, visits - 1, axis=1)[:, visits - 1]
        return bound <= (last + 1e-9 * (1.0 + abs(last)))[:, None]

    def search(self, query: np.ndarray, visits: int) -> np.ndarray:
        """Numbers ``tree * leaves + leaf`` of the first leaves that a priority queue over all trees gives, smallest bound first.

        The queue holds a node under its bound; a child's bound is never below
        its parent's, so the order in which leaves leave the queue is that of
        the leaves' own bounds (``queue_order`` says it as a queue).
        """
        bound = self.bounds(query).ravel()
        if visits >= len(bound):
            return np.arange(len(bound))
        first = np.argpartition(bound, visits - 1)[:visits]
        return np.sort(first)

    def queue_order(self, query: np.ndarray, visits: int) -> list[int]:
        """The same by one shared priority queue, node by node."""
        values = self.values(query[None, :], added=False)[0]
        queue = [(-math.inf, 0, t, 0) for t in range(len(self.planes))]
        found: list[int] = []
        while queue and len(found) < visits:
            bound, level, t, node = heapq.heappop(queue)
            if level == self.depth:
                found.append(t * 2**self.depth + node)
                continue
            m = values[t, level] - self.cuts[t, 2**level - 1 + node]
            heapq.heappush(queue, (max(bound, m), level + 1, t, 2 * node))
            heapq.heappush(queue, (max(bound, -m), level + 1, t, 2 * node + 1))
        return found


def fit_forest(sample: np.ndarray, trees: int, depth: int, reach: float, seed: int = 7) -> Forest:
    """Random unit directions, cut at the median of the sampled rows that reach the node."""
    rng = np.random.default_rng(seed)
    planes = rng.standard_normal((trees, depth, sample.shape[1] + 1))
    planes /= np.linalg.norm(planes, axis=2, keepdims=True)
    forest = Forest(planes, np.zeros((trees, 2**depth - 1)), depth, reach)
    values = forest.values(sample)
    for t in range(trees):
        groups = [np.arange(len(sample))]
        for level in range(depth):
            below = []
            for k, rows in enumerate(groups):
                v = values[rows, t, level]
                at = float(np.median(v)) if len(rows) else 0.0
                forest.cuts[t, 2**level - 1 + k] = at
                below += [rows[v <= at], rows[v > at]]
            groups = below
    return forest


def _matrix(column: pa.Array, dim: int, kind: type = np.float64) -> np.ndarray:
    """Rows of packed components as a matrix of doubles; shorter vectors end in zeros."""
    out = np.zeros((len(column), dim))
    for k, v in enumerate(column):
        x = np.frombuffer(v.as_buffer(), kind)
        out[k, : len(x)] = x
    return out


def component_type(rows: DataFrame, vector_col: str) -> type:
    """What components are packed as: floats stay floats, all else becomes doubles."""
    return np.float32 if dict(rows.dtypes)[vector_col] == "array<float>" else np.float64


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k largest scores, ties to the smaller id; all that tie at the cut are looked at."""
    if k < len(scores):
        at = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def usable_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, v`` (components packed as ``component_type``), ``norm`` of vectors that take part.

    Null, empty and zero vectors and such with null or non-finite components
    take no part.
    """

    kind = component_type(rows, vector_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, packed, norms = [], [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                values = v.values
                if values is None or values.null_count or not len(values):
                    continue
                x = values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # one zero only
                norm = float(np.sqrt((x * x).sum()))
                if math.isfinite(norm) and norm > 0:
                    ids.append(i)
                    packed.append(x.astype(kind).tobytes())
                    norms.append(norm)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(packed, pa.binary()), pa.array(norms, pa.float64())], names=["vec_id", "v", "norm"])

    chosen = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return chosen.filter("vec_id is not null and vector is not null").mapInArrow(run, "vec_id long, v binary, norm double")


def probe_leaves(entries: DataFrame, dim: int, k: int, forest: Forest, recall: float, kind: type = np.float64) -> int:
    """The fewest visits with which a bounded number of queries find the share ``recall`` of their true ``k`` neighbours.

    The probes are the entries with the smallest hash; their neighbours come
    from one pass over all entries that keeps ``k`` a task.
    """
    probes = entries.orderBy(F.xxhash64("v", F.lit(1)), "entry").limit(PROBES).select("entry", "v").collect()
    own, q = np.array([r["entry"] for r in probes]), _matrix(pa.array([bytes(r["v"]) for r in probes], pa.binary()), dim, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple[float, int, bytes]]] = [[] for _ in own]
        for batch in batches:
            if batch.num_rows:
                ids = batch.column(0).to_numpy()
                dots = q @ _matrix(batch.column(1), dim, kind).T
                for p in range(len(own)):
                    dots[p, ids == own[p]] = -math.inf
                    found = _best(dots[p], ids, k)
                    held[p] = sorted([*held[p], *((-dots[p, i], int(ids[i]), batch.column(1)[int(i)].as_py()) for i in found)])[:k]
        rows = [(p, s, i, v) for p, found in enumerate(held) for s, i, v in found if s < math.inf]
        columns = [*zip(*rows, strict=True)] if rows else [()] * 4
        types = [pa.int64(), pa.float64(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["p", "down", "entry", "v"])

    near = entries.select("entry", "v").mapInArrow(run, "p long, down double, entry long, v binary")
    place = F.row_number().over(Window.partitionBy("p").orderBy("down", "entry"))
    near = near.withColumn("n", place).filter(F.col("n") <= k).select("p", "v").toArrow()  # PROBES * k rows at most
    visits = []
    p_of, leaves = near["p"].to_numpy(), forest.leaves(_matrix(near["v"].combine_chunks(), dim, kind)) if near.num_rows else np.empty((0, 1), np.int64)
    for p in range(len(own)):
        bound = forest.bounds(q[p])
        rank = np.empty(bound.size, np.int64)
        rank[np.argsort(bound.ravel(), kind="stable")] = np.arange(1, bound.size + 1)
        rank = rank.reshape(bound.shape)
        visits += [int(rank[np.arange(len(bound)), at].min()) for at in leaves[p_of == p]]
    return sorted(visits)[max(0, math.ceil(recall * len(visits)) - 1)] if visits else 1


def nearest(
    rows: DataFrame,
    queries: DataFrame,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    trees: int = 16,
    leaf_rows: int = 32,
    recall: float = 0.95,
    max_sample: int = 65_536,
) -> DataFrame:
    """The ``k`` rows with the largest inner product for each query, itself excluded.

    The forest is fitted on a sample of at most ``max_sample`` distinct vectors
    (those with the smallest hash); every row is indexed in every tree. Trees
    are as deep as leaves of ``leaf_rows`` rows need at any number of rows, as
    far as the sample leaves eight rows to a leaf. A query visits leaves in the
    order of one priority queue over all trees; how many is set by
    ``probe_leaves`` so that ``recall`` of the true neighbours are met. The
    rows of visited leaves are scored exactly, in double precision. Directions
    of vectors without structure tell little, so there a high recall needs a
    large share of all rows, which falls slowly as rows grow (figures in the
    README).

    Every row is dealt once, with its leaves in all trees, to one of a number
    of blocks of rows; a query meets each block, so that neither its leaves nor
    a row per tree are ever written. A task sorts its block by leaf in each
    tree, finds the query's leaves, scores each row in them once, and hands on
    one list of the best ``k + 1``, in which all ties at the cut were looked
    at. What is shuffled is the rows once a block of ``BLOCK_QUERIES`` queries
    and the queries and their lists once a block of ``BLOCK_ROWS`` rows.

    Equal vectors are one entry of the index with their ``k + 1`` smallest
    ids, and equal queries are searched once, so copies neither fill leaves nor
    crowd out anything. A query takes part if some row has its vector. Vectors of different lengths are compared as if the
    shorter ended in zeros; memory goes by the longest.

    Returns ``query_id, rank, vec_id, score``; ties go to the smaller id; fewer
    rows where there are fewer candidates found. See ``usable_vectors`` for
    rows that take no part. Of rows that repeat an id and vector one counts.
    """
    kind = component_type(rows, vector_col)
    queries = queries.select(F.col(id_col), F.col(vector_col).cast(rows.schema[vector_col].dataType).alias(vector_col))
    asked = usable_vectors(queries, id_col, vector_col).select(F.col("vec_id").alias("query_id"), "v")
    few = F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id"))
    entries = usable_vectors(rows, id_col, vector_col).withColumn("n", few).filter(F.col("n") <= k + 1).groupBy("v", "norm").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
    entries = entries.join(asked.select("v", F.lit(True).alias("wanted")).distinct(), "v", "left")
    entries = cut(entries.select(F.element_at("ids", 1).alias("entry"), "v", "norm", "ids", F.col("wanted").isNotNull().alias("wanted")))
    n, reach, dim, searched = entries.agg(F.count(F.lit(1)), F.max("norm"), F.max(F.length("v") / np.dtype(kind).itemsize), F.count_if("wanted")).first()
    if not n or not searched:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, order = int(dim), F.xxhash64("v")
    share = (max_sample + 8 * math.sqrt(max_sample)) / n  # of the hashes, so that not every task hands on max_sample rows
    few = entries.filter(order <= F.lit(int((2 * share - 1) * 2**63))) if share < 1 else entries
    sampled = few.orderBy(order, "entry").limit(max_sample).select("v").toArrow()
    sample = _matrix(sampled["v"].combine_chunks(), dim, kind)
    depth = max(0, min(math.floor(math.log2(n / leaf_rows)), math.floor(math.log2(max(1, len(sample) / 8)))))
    fitted = fit_forest(sample, trees if depth else 1, depth, float(reach))
    visits, leaves = probe_leaves(entries, dim, k, fitted, recall, kind), 2**depth
    forest, used = rows.sparkSession.sparkContext.broadcast(fitted), len(fitted.planes)
    code = np.uint16 if leaves <= 1 << 16 else np.uint32
    row_blocks, query_blocks = max(BLOCKS, math.ceil(n / BLOCK_ROWS)), math.ceil(searched / BLOCK_QUERIES)
    heads = asked.join(entries.filter("wanted").select("v", "entry"), "v").select("query_id", "entry").distinct()

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = forest.value.leaves(_matrix(batch.column(1), dim, kind)).astype(code)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x.tobytes() for x in leaf], pa.binary())], names=["entry", "v", "leaf"])

    block = lambda of, seed, blocks: F.pmod(F.xxhash64(of, F.lit(seed)), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    members = entries.select("entry", "v").mapInArrow(index, "entry long, v binary, leaf binary")
    members = members.select(block("entry", 1, row_blocks).alias("rb"), every(query_blocks).alias("qb"), "entry", "v", "leaf")
    seekers = entries.filter("wanted").select(every(row_blocks).alias("rb"), block("entry", 2, query_blocks).alias("qb"), "entry", "v")
    found_type = pa.list_(pa.struct([("down", pa.float64()), ("entry", pa.int64())]))

    def score(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        names, out = [], []
        if left.num_rows and right.num_rows:
            x, ids, m = _matrix(right["v"].combine_chunks(), dim, kind), right["entry"].to_numpy(), right.num_rows
            leaf = np.frombuffer(b"".join(right["leaf"].to_pylist()), code).reshape(m, used)
            # Rows by leaf, tree after tree; the rows of leaf f of tree t are sizes[t * leaves + f] from starts[t * leaves + f].
            by_leaf = np.concatenate([np.argsort(leaf[:, t], kind="stable").astype(np.int32) for t in range(used)])
            sizes = np.concatenate([np.bincount(leaf[:, t], minlength=leaves) for t in range(used)])
            starts, seen = np.cumsum(sizes) - sizes, np.zeros(m, bool)
            theirs, wide = left["v"].combine_chunks(), visits > leaves / 16  # one product of matrices is quicker than many rows picked
            for begin in range(0, left.num_rows, TOGETHER):
                q = _matrix(theirs[begin : begin + TOGETHER], dim, kind)
                products = q @ x.T if wide else None
                for b, (query, reached) in enumerate(zip(left["entry"][begin : begin + TOGETHER].to_pylist(), forest.value.reached(q, visits), strict=True)):
                    own = np.flatnonzero(reached & (sizes > 0))
                    number = sizes[own]
                    seen[by_leaf[np.repeat(starts[own] - (np.cumsum(number) - number), number) + np.arange(number.sum())]] = True
                    at = np.flatnonzero(seen)
                    seen[at] = False
                    if not len(at):
                        continue
                    # Products alone may differ in the last digits by how rows are blocked: all near the cut are scored again, each alone.
                    rough = products[b, at] if wide else x[at] @ q[b]
                    if k + 1 < len(at):
                        at = at[rough >= np.partition(rough, -k - 1)[-k - 1] - 1e-9 * (1.0 + abs(rough).max())]
                    exact = (x[at] * q[b]).sum(axis=1)
                    best = _best(exact, ids[at], k + 1)
                    names.append(query)
                    out.append([{"down": -s, "entry": i} for s, i in zip(exact[best].tolist(), ids[at][best].tolist(), strict=True)])
        return pa.table({"query": pa.array(names, pa.int64()), "found": pa.array(out, found_type)})

    keys = ["rb", "qb"]
    lists = seekers.groupBy(*keys).cogroup(members.groupBy(*keys)).applyInArrow(score, "query long, found array<struct<down:double,entry:long>>")
    scored = lists.groupBy("query").agg(F.slice(F.sort_array(F.flatten(F.collect_list("found"))), 1, k + 1).alias("found"))
    scored = scored.select("query", F.explode("found").alias("x")).select("query", "x.entry", (-F.col("x.down")).alias("score"))
    scored = scored.join(entries.select("entry", "ids"), "entry").select("query", "score", F.explode("ids").alias("vec_id"))
    placed = scored.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id"))).filter(F.col("n") <= k + 1)
    found = placed.groupBy("query").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("down"), "vec_id"))).alias("found"))
    out = heads.join(found, F.col("entry") == F.col("query")).select("query_id", F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("found"))
    return out.select("query_id", F.posexplode("found").alias("at", "x")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.down")).alias("score")
    )
