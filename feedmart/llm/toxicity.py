"""Toxicity scores from the nearest labelled examples by the cosine of label-weighted TF-IDF vectors.

A departure from plain TF-IDF: a word's idf is raised by its tie to the label
(``TIE``), so neighbours, cosines and evidence are those of such vectors. Words
are runs of letters and apostrophes; digits and signs are in no word.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, filled

_SPLIT = bytes(c if c >= 0x80 or chr(c).isalpha() or c == 0x27 else 0x20 for c in range(256))
#: Share of a word's weight that its tie to the label adds, times the square of the tie's z-score. Chosen on folds of the training rows.
TIE = 1.0
#: Parts into which the examples are split to calibrate: each part is voted on by the others.
PARTS = 4


def words_of(text: str) -> list[bytes]:
    """Lower-cased runs of letters."""
    return text.lower().encode("utf-8", "replace").translate(_SPLIT).split()


def word_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a text's distinct words, and how often each occurs."""
    own = Counter(words_of(text))
    return np.fromiter(map(xxhash.xxh64_intdigest, own), np.uint64, len(own)).view(np.int64), np.fromiter(own.values(), np.int64, len(own))


class BlockMaxIndex:
    """Exact top-k inner products over sparse vectors.

    Examples are laid out by ``layout``, likely neighbours together, and cut
    into blocks of ``block``. The longest posting lists, of the ``common``
    commonest terms, are written out as a matrix with a place for every
    example, and summed up for many queries at once. All other postings are
    kept by block, with the largest weight of each block that holds the term.
    A block's bound is its largest sum over common terms, which is exact, and
    the query's other weights times these maxima. Blocks are visited in falling
    order of the bound until none reaches the k-th score found.
    """

    def __init__(self, sizes: np.ndarray, terms: np.ndarray, weights: np.ndarray, layout: np.ndarray, n_terms: int, block: int = 64, common: int = 512):
        """``sizes`` has each example's number of terms, ``terms`` and ``weights`` have those of all in a row; ``layout`` the examples in their order."""
        self.n, self.block, self.layout = len(sizes), block, layout
        self.blocks = max(1, -(-self.n // block))
        place = np.empty(self.n, np.int64)
        place[layout] = np.arange(self.n)
        at = place[np.repeat(np.arange(self.n), sizes)]
        often = np.argsort(-np.bincount(terms, minlength=n_terms), kind="stable")[:common]
        self.column = np.full(n_terms, -1)
        self.column[often] = np.arange(len(often))
        own = self.column[terms]
        self.matrix = np.zeros((self.blocks * block, len(often)))
        self.matrix[at[own >= 0], own[own >= 0]] = weights[own >= 0]
        at, terms, weights = at[own < 0], terms[own < 0], weights[own < 0]
        order = np.lexsort((at, terms))
        self.places, self.weights, terms = at[order].astype(np.int32), weights[order], terms[order]
        pair = terms * self.blocks + self.places // block
        starts = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1]))) if len(pair) else np.empty(0, np.int64)
        self.pair_blocks = self.places[starts] // block  # 32 bits, as the model is sent to every task
        self.pair_maxima = np.maximum.reduceat(self.weights, starts) if len(pair) else np.empty(0)
        self.term_starts = np.searchsorted(terms[starts], np.arange(n_terms + 1))
        self.pair_starts = np.append(starts, len(pair)).astype(np.int32)

    @staticmethod
    def _spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All positions of the spans in a row, and the span of each."""
        sizes = ends - starts
        span = np.repeat(np.arange(len(sizes)), sizes)
        return np.arange(len(span)) + (starts - (np.cumsum(sizes) - sizes))[span], span

    def search(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[list[tuple[float, int]]]:
        """For each query (terms, weights): (score, example), best first, ties to the smaller example; only examples that share a term."""
        out = []
        for begin in range(0, len(queries), 64):
            some = queries[begin : begin + 64]
            q = np.zeros((len(some), self.matrix.shape[1]))
            for row, (terms, weights) in zip(q, some, strict=True):
                own = self.column[terms]
                row[own[own >= 0]] = weights[own >= 0]
            sums = q @ self.matrix.T
            tops = sums.reshape(len(some), self.blocks, self.block).max(axis=2)
            for base, top, (terms, weights) in zip(sums, tops, some, strict=True):
                rare = self.column[terms] < 0
                out.append(self._finish(base, top, terms[rare], weights[rare], k))
        return out

    def _finish(self, scores: np.ndarray, top: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int) -> list[tuple[float, int]]:
        """Adds the other terms where bounds ask for it, and picks the best. ``scores`` has the sums over common terms."""
        pairs, of = self._spans(self.term_starts[terms], self.term_starts[terms + 1])
        blocks, own = self.pair_blocks[pairs], weights[of]
        bound = top + np.bincount(blocks, own * self.pair_maxima[pairs], self.blocks)
        visited, least = np.zeros(self.blocks, bool), 1e-12
        chosen = np.zeros(self.blocks, bool)
        chosen[np.argpartition(-bound, min(8, self.blocks - 1))[:8]] = True
        chosen &= bound > least
        while chosen.any():
            picked = chosen[blocks]
            postings, of_pair = self._spans(self.pair_starts[pairs[picked]], self.pair_starts[pairs[picked] + 1])
            np.add.at(scores, self.places[postings], self.weights[postings] * own[picked][of_pair])
            visited |= chosen
            found = scores.reshape(self.blocks, self.block)[visited].ravel()
            if k <= len(found):
                least = max(least, np.partition(found, -k)[-k] - 1e-9)
            chosen = ~visited & (bound >= least)
        at = np.flatnonzero((scores >= least) & np.repeat(visited, self.block))
        found = np.round(scores[at], 12)
        examples = self.layout[at]
        return [(float(found[i]), int(examples[i])) for i in np.lexsort((examples, -found))][:k]


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising steps through (x, y) by pooling neighbours: first and last x of each pool with its mean, as points to interpolate between."""
    order = np.argsort(x, kind="stable")
    pools: list[tuple[float, float, float, float]] = []  # first x, last x, mean, number
    for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
        pool = (a, a, b, 1.0)
        while pools and (pools[-1][2] >= pool[2] or pools[-1][1] == pool[0]):
            first, _, mean, n = pools.pop()
            pool = (first, pool[1], (mean * n + pool[2] * pool[3]) / (n + pool[3]), n + pool[3])
        pools.append(pool)
    return np.array([e for p in pools for e in p[:2]]), np.array([p[2] for p in pools for _ in range(2)])


@dataclass
class Examples:
    """Labelled examples in a row: ids, labels, each one's number of words, and these words (numbers in ``words``, sorted hashes) with their counts."""

    ids: np.ndarray
    labels: np.ndarray
    sizes: np.ndarray
    terms: np.ndarray
    counts: np.ndarray
    words: np.ndarray

    def part(self, keep: np.ndarray) -> Examples:
        inside = np.repeat(keep, self.sizes)
        return Examples(self.ids[keep], self.labels[keep], self.sizes[keep], self.terms[inside], self.counts[inside], self.words)


class Model:
    """Votes of the nearest examples by the cosine of label-weighted TF-IDF vectors over all words.

    A word's weight in a text is ``(1 + log count) * idf``, and the words that
    toxic examples hold more often than others weigh more, by their z-score. A
    word that no example holds has the greatest idf and counts in the norm.
    """

    def __init__(self, examples: Examples, idf: np.ndarray, k: int):
        self.ids, self.labels, self.words, self.k = examples.ids, examples.labels, examples.words, k
        n, bad = len(self.ids), float(self.labels.sum())
        self.share = bad / n if n else 0.0
        of = np.repeat(np.arange(n), examples.sizes)
        held = np.bincount(examples.terms, minlength=len(self.words)) + 0.5
        toxic = np.bincount(examples.terms, self.labels[of], len(self.words)) + 0.5
        odds = np.log(toxic / (bad + 1.0) * (n - bad + 1.0) / (held - toxic + 0.5))
        z = np.maximum(0.0, odds / np.sqrt(1.0 / toxic + 1.0 / (held - toxic + 0.5)))
        self.weight = idf * np.append(1.0 + TIE * z * z, 1.0)  # the last is that of unknown words
        weights = (1.0 + np.log(examples.counts)) * self.weight[examples.terms]
        weights /= np.sqrt(np.bincount(of, weights * weights, n))[of]
        # Examples of one label that agree in their weightiest common word lie together.
        common = np.argsort(-held, kind="stable")[:64]
        rank = np.full(len(self.words), len(common))
        rank[common] = np.arange(len(common))
        first = np.zeros((n, len(common) + 1))
        first[of, rank[examples.terms]] = weights
        first[:, -1] = 0.0
        layout = np.lexsort((np.arange(n), first.argmax(axis=1), self.labels))
        self.index = BlockMaxIndex(examples.sizes, examples.terms, weights, layout, len(self.words))
        self.steps: tuple[np.ndarray, np.ndarray] | None = None

    def vector(self, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the known words and their weights in the unit vector of all words."""
        unknown = len(self.words)
        terms = np.searchsorted(self.words, hashes)
        terms = np.where(self.words[np.minimum(terms, unknown - 1)] == hashes, terms, unknown) if unknown else np.full(len(hashes), unknown)
        weights = (1.0 + np.log(counts)) * self.weight[terms]
        weights /= np.sqrt((weights * weights).sum()) or 1.0
        return terms[terms < unknown], weights[terms < unknown]

    def vote(self, near: list[tuple[float, int]]) -> float:
        """Share of toxic neighbours weighted by nearness, with one neighbour at the greatest distance that votes as all examples do."""
        total, toxic = 1.0, self.share
        for cosine, example in near:
            weight = 1.0 / (0.05 + 1.0 - min(1.0, cosine))
            total, toxic = total + weight, toxic + weight * self.labels[example]
        return float(toxic / total)

    def near(self, texts: list[str]) -> list[list[tuple[float, int]]]:
        return self.index.search([self.vector(*word_counts(t)) for t in texts], self.k) if len(self.ids) else [[] for _ in texts]

    def scores(self, texts: list[str]) -> list[tuple[float, list[tuple[int, float, int]]]]:
        """Calibrated score of each text, and evidence: (example id, cosine, label) of the three nearest."""
        out = []
        for near in self.near(texts):
            voted = self.vote(near)
            score = voted if self.steps is None else float(np.interp(voted, *self.steps))
            out.append((min(1.0, max(0.0, score)), [(int(self.ids[e]), c, int(self.labels[e])) for c, e in near[:3]]))
        return out


_EVIDENCE = "array<struct<doc_id long, cosine double, toxic int>>"
_SHAPE = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))


def gather_examples(examples: DataFrame) -> Examples:
    """The examples' words by hash; a bounded number of rows, so they come to the driver."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [word_counts(t.as_py()) for t in batch.column(2)]
            columns = [batch.column(0), batch.column(1), pa.array([h for h, _ in own], pa.list_(pa.int64())), pa.array([c for _, c in own], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "toxic", "words", "counts"])

    rows = examples.select("doc_id", F.col("toxic").cast("int").alias("toxic"), "text")
    own = rows.mapInArrow(split, "doc_id long, toxic int, words array<long>, counts array<long>").toArrow().sort_by("doc_id")
    flat = lambda name: np.concatenate([np.zeros(0, np.int64), *(c.flatten().to_numpy() for c in own[name].chunks)])
    sizes = np.concatenate([np.zeros(0, np.int64), *(c.value_lengths().to_numpy() for c in own["words"].chunks)]).astype(np.int64)
    words, terms = np.unique(flat("words"), return_inverse=True)
    return Examples(np.array(own["doc_id"].to_pylist(), np.int64), np.array(own["toxic"].to_pylist(), float), sizes, terms, flat("counts"), words)


def document_frequencies(texts: DataFrame, words: np.ndarray) -> tuple[int, np.ndarray]:
    """Number of all texts, and of those that hold each of the given words (sorted hashes). Tasks count on their own arrays."""
    shared = texts.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n = shared.value, 0
        held = np.zeros(len(known) + 1, np.int64)
        for batch in batches:
            n += batch.num_rows
            for text in batch.column(0):
                if len(known):
                    hashes = np.fromiter(map(xxhash.xxh64_intdigest, set(words_of(text.as_py()))), np.uint64).view(np.int64)
                    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                    held[at[known[at] == hashes]] += 1
        held[-1] = n
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], names=["term", "n"])

    counted = texts.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # a row per word of the examples
    df = np.zeros(len(words) + 1, np.int64)
    df[counted["term"].to_numpy()] = counted["n"].to_numpy()
    return int(df[-1]), df[:-1]


def calibration(examples: DataFrame, own: Examples, idf: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Steps from vote to score. Each part of the examples is voted on by a model of the other parts, ties of words to the label included."""
    part = np.random.default_rng(5).permutation(len(own.ids)) % PARTS
    rows, votes, marks = examples.select("doc_id", F.col("toxic").cast("int").alias("toxic"), "text"), [0.0, 1.0], [0.0, 1.0]
    for p in range(PARTS):  # one model at a time is built and sent out
        shared = examples.sparkSession.sparkContext.broadcast((Model(own.part(part != p), idf, k), own.ids[part == p]))

        def vote(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            other, ids = shared.value
            for batch in batches:
                chosen = batch.filter(pa.array(np.isin(batch.column(0).to_numpy(), ids)))
                found = [other.vote(near) for near in other.near(chosen.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([chosen.column(1), pa.array(found, pa.float64())], names=["toxic", "vote"])

        voted = rows.mapInArrow(vote, "toxic int, vote double").toArrow()
        votes, marks = [*voted["vote"].to_pylist(), *votes], [*voted["toxic"].to_pylist(), *marks]
        shared.destroy()
    order = np.lexsort((marks, votes))  # tasks may end in any order
    return isotonic(np.array(votes)[order], np.array(marks, float)[order])


def text_key(text: str | Column) -> Column:
    """MD5 of a text; null counts as empty."""
    return F.md5(filled(text).cast("binary"))


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    held_out: int = 2,
    folds: int = 4,
    max_examples: int = 4096,
    k: int = 15,
    with_text_key: bool = False,
) -> DataFrame:
    """Scores every row's whole text against the nearest labelled examples.

    Labelled rows whose CRC32 of the id modulo ``folds`` is ``held_out`` are
    never learnt from. Of the others the ``max_examples`` with the smallest
    hash of the id are the examples: a bounded sample, which makes the index
    and all that is broadcast bounded. Every text is searched by all its words
    (``Model``) for the ``k`` examples of largest label-weighted cosine, exactly, through a
    block-max index; document frequencies count all rows. The votes of the
    neighbours are weighted by distance and calibrated (``calibration``).

    Two passes over the texts: one counts documents per word, one searches.

    Returns ``doc_id, held_out, score, predicted, evidence`` per input row;
    ``evidence`` lists up to three nearest examples. ``with_text_key`` adds
    ``text_key``, the MD5 of the text, under which a caller finds the row again
    whatever its id. Null texts count as empty; a text without words has no
    neighbours and gets the calibrated score of that. Ids with several labels
    count as toxic if one is, ids with several texts by the greatest of them;
    null ids are scored and never learnt from. Without labels every score is 0.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held_out, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), filled(text_col).alias("text"))
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).dropna()
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(~held)
    marks = marks.join(rows.select("doc_id"), "doc_id", "left_semi")
    marks = cut(marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples))  # two numbers a row: bounded, and small enough to broadcast
    examples = rows.join(F.broadcast(marks), "doc_id").groupBy("doc_id", "toxic").agg(F.max("text").alias("text"))
    examples = cut(examples.repartition(32, "doc_id"))
    own = gather_examples(examples)
    n, df = document_frequencies(rows, own.words)
    idf = np.log((1.0 + n) / (1.0 + np.append(df, 0))) + 1.0
    steps = calibration(examples, own, idf, k)
    model = Model(own, idf, k)
    model.steps = steps
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "held_out", "score", "predicted", "evidence", *(["text_key"] if with_text_key else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for at in range(0, batch.num_rows, 64) for x in shared.value.scores(batch.column(3).slice(at, 64).to_pylist())]
            scores = np.array([s for s, _ in found], float)
            evidence = pa.array([[{"doc_id": d, "cosine": c, "toxic": t} for d, c, t in near] for _, near in found], _SHAPE)
            columns = [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array((scores >= 0.3).astype(np.int32)), evidence]
            yield pa.RecordBatch.from_arrays([*columns, *([batch.column(2)] if with_text_key else [])], names=names)

    schema = f"doc_id long, held_out boolean, score double, predicted int, evidence {_EVIDENCE}" + (", text_key string" if with_text_key else "")
    key = text_key("text") if with_text_key else F.lit("")
    return rows.select("doc_id", held.alias("held_out"), key.alias("text_key"), "text").mapInArrow(run, schema)
