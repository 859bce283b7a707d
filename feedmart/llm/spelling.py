"""Spelling variants: words one edit apart, found through a bit-sliced position index."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: Words that a task gathers before it hands them on, and words of one piece of an index.
FLUSH, SEGMENT = 200_000, 1024
#: Letters at either end that one edit cannot touch both of.
ENDS = 3


def lower_ascii(word: str) -> str:
    return word.lower() if word.isascii() else word.translate(_LOWER)


def altered(doc_id: int | None, word: str, every: int) -> str:
    """The word, without one letter where ``every`` divides the checksum of document and word."""
    h = crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
    at = h % len(word)
    return word[:at] + word[at + 1 :] if h % every == 0 else word


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 6, least_count: int = 5, every: int = 199) -> DataFrame:
    """``word, n`` of all words of at least ``least_length`` letters with at least ``least_count`` occurrences.

    Counts are summed up within tasks before they are shuffled, so a word that
    every text holds sends a row per task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = defaultdict(int)

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([*total], pa.string()), pa.array([*total.values()], pa.int64())], names=["word", "n"])
            total.clear()
            return made

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own: dict[str, int] = defaultdict(int)
                for found in RUN.finditer(text.as_py()):
                    if len(word := found[0]) >= least_length:
                        own[word] += 1
                lowered: dict[str, int] = defaultdict(int)
                for word, n in own.items():
                    lowered[lower_ascii(word)] += n
                for word, n in lowered.items():
                    if len(word := altered(doc_id, word, every)) >= least_length:
                        total[word] += n
                if len(total) >= FLUSH:
                    yield out()
        yield out()

    rows = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


class PositionIndex:
    """Words as bits: for each position and letter a bitset of the words that have it there.

    Words stand in order of falling count, then in code-point order, so the
    lowest bit of a set is its most frequent word.
    """

    def __init__(self, words: list[tuple[str, int]]):
        self.words = sorted(words, key=lambda w: (-w[1], w[0]))
        self.place = {w: 1 << k for k, (w, _) in enumerate(self.words)}
        self.every = (1 << len(self.words)) - 1
        letters: dict[tuple[int, str], list[int]] = defaultdict(list)
        lengths: dict[int, list[int]] = defaultdict(list)
        heads: dict[str, list[int]] = defaultdict(list)
        for k, (word, _) in enumerate(self.words):
            lengths[len(word)].append(k)
            heads[word[:ENDS]].append(k)
            for at, letter in enumerate(word, 1):
                letters[at, letter].append(k)
        self.letters, self.lengths, self.heads = ({key: self._set(ks) for key, ks in found.items()} for found in (letters, lengths, heads))

    def _set(self, places: list[int]) -> int:
        bits = bytearray(len(self.words) // 8 + 1)
        for k in places:
            bits[k >> 3] |= 1 << (k & 7)
        return int.from_bytes(bits, "little")

    def near(self, query: str) -> int:
        """Bitset of the words that differ from the query by exactly one inserted, deleted or replaced letter.

        After each letter of the query: ``same`` holds the words that begin
        with what was read; ``swapped``, ``longer`` and ``shorter`` those that
        do so with one letter replaced, one letter more or one letter less, so
        that the query's letters stand one place on or back in them. One step
        moves the four sets of all words at once.
        """
        at = self.letters.get
        same = longer = self.every
        swapped = shorter = 0
        for k, letter in enumerate(query, 1):
            here = at((k, letter), 0)
            swapped = swapped & here | same & ~here
            shorter = shorter & at((k - 1, letter), 0) | same
            same &= here
            longer = longer & at((k + 1, letter), 0) | same
            if not (swapped or shorter or same or longer):
                return 0
        n = len(query)
        size = self.lengths.get
        return (swapped & size(n, 0) | shorter & size(n - 1, 0) | longer & size(n + 1, 0)) & ~self.place.get(query, 0)


def near_words(vocab: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """``word, n_near, best``: how many words are one edit away, and the most frequent of them as a struct of ``minus`` (its count, negative) and ``word``.

    One edit leaves the first three letters or the last three as they are, so
    each word is indexed and sought under both ends; under the last letters
    words of the same first ones are passed over, so each is counted once. An
    end that many words have is split into pieces of about ``segment`` words,
    and each piece meets the end's words in pieces of that size: no task holds
    more, whatever the vocabulary.
    """
    ends = vocab.select("word", "n", F.explode(F.array(F.concat(F.lit("p"), F.substring("word", 1, ENDS)), F.concat(F.lit("s"), F.substring("word", -ENDS, ENDS)))).alias("end"))
    sizes = ends.groupBy("end").agg(F.ceil(F.count(F.lit(1)) / segment).cast("int").alias("pieces")).filter("pieces > 1")
    sized = ends.join(cut(sizes), "end", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("word"), F.col("pieces")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("pieces") - 1), lambda k: k != F.col("own"))
    meets = F.concat(
        F.array(F.struct(F.col("own").alias("piece"), F.col("own").alias("chunk"))), F.transform(others, lambda k: F.struct(F.col("own").alias("piece"), k.alias("chunk"))), F.transform(others, lambda k: F.struct(k.alias("piece"), F.col("own").alias("chunk")))
    )
    rows = sized.select("end", "word", "n", "own", F.explode(meets).alias("m")).select("end", "m.piece", "m.chunk", "word", "n", (F.col("m.piece") == F.col("own")).alias("held"), (F.col("m.chunk") == F.col("own")).alias("sought"))

    def looked_up(rows: list[dict]) -> Iterator[tuple[str, int, int, str]]:
        index = PositionIndex([(r["word"], r["n"]) for r in rows if r["held"]])
        apart = rows[0]["end"][0] == "s"
        for r in rows:
            if r["sought"] and (near := index.near(r["word"]) & ~(index.heads.get(r["word"][:ENDS], 0) if apart else 0)):
                word, n = index.words[(near & -near).bit_length() - 1]
                yield r["word"], near.bit_count(), -n, word

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (r for batch in batches for r in batch.to_pylist())
        made: list[tuple] = []
        for _, group in groupby(each, key=lambda r: (r["end"], r["piece"], r["chunk"])):
            made += looked_up([*group])
            if len(made) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made, strict=True)], names=["word", "n_near", "minus", "near"])
                made = []
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made, strict=True)], names=["word", "n_near", "minus", "near"])

    dealt = rows.repartition("end", "piece", "chunk").sortWithinPartitions("end", "piece", "chunk")
    found = dealt.mapInArrow(run, "word string, n_near long, minus long, near string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("minus", F.col("near").alias("word"))).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of the links ``word, form``: the end of each chain, by doubling; chains have no circle, as counts rise along them."""
    cur = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        step = cur.select(F.col("word").alias("root"), F.col("root").alias("on"))
        cur = cut(cur.join(step.hint("merge"), "root", "left").select("word", F.coalesce("on", "root").alias("root"), F.col("on").isNotNull().alias("moved")))
        if not cur.filter("moved").limit(1).count():
            return cur.select("word", "root")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 6, least_count: int = 5, every: int = 199, factor: int = 5) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word.

    Words are maximal runs of Latin letters, A-Z lower-cased; runs whose
    checksum with their document's id ``every`` divides lose one letter. Those
    of at least ``least_length`` letters and ``least_count`` occurrences count.
    ``form`` is the most frequent word one edit away, ties to the smaller one
    in code-point order, if it occurs at least ``factor`` times as often;
    ``root`` ends the chain of forms.

    Null texts have no words; a null id stands as no text before the colon.
    Repeated rows count as often as they stand. An empty table gives no rows,
    and other columns are never read. A word is one edit from itself never.
    """
    if least_length < 2 * ENDS:
        raise ValueError(f"words of fewer than {2 * ENDS} letters may have both ends changed by one edit")
    vocab = cut(word_counts(docs, id_col, text_col, least_length, least_count, every))
    near = near_words(vocab)
    best_n, wanted = -F.col("best.minus"), F.col("n") * factor
    named = vocab.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(best_n >= wanted, F.col("best.word")).alias("form"), F.when(best_n >= wanted, best_n).alias("form_n"))
    named = cut(named)
    ends = roots(named.filter("form is not null"))
    return named.join(ends.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
