"""Exact dedup, mixing and packing against brute force."""

from __future__ import annotations

import collections
import hashlib
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from feedmart.llm import exact_dedup as X
from feedmart.llm import mixing as M
from feedmart.llm import packing as P
from feedmart.llm.queries import tokenizer_files

DDL = "doc_id long, text string, source string, h string, norm string"
LONG = "word " * 30_000
ROWS = [(1, "Hello", "a"), (2, "hello", "a"), (3, "HELLO", None), (4, "É", "a"), (5, "é", "b"), (6, None, "b"), (7, "", "b"), (8, LONG, "c"), (9, LONG.upper(), "c"), (9, LONG.upper(), "c"), (None, "hello", "c"), (None, None, None), (12, "x  y\tz", "d")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "clash", "clash") for r in ROWS], DDL)


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.mark.parametrize("digest", [X.md5_128, lambda c: F.octet_length(c).cast("string").cast("binary")])
@pytest.mark.parametrize("keep", ["max", "min"])
def test_exact_dedup(docs, digest, keep):
    """With a digest of the length alone, texts under one digest must still be told apart by their bytes."""
    groups = collections.defaultdict(list)
    for i, t, _ in ROWS:
        groups[lowered(t)].append(i)
    best = {t: (max if keep == "max" else min)([i for i in ids if i is not None], default=None) for t, ids in groups.items()}
    got = collections.defaultdict(list)
    for r in X.exact_dedup(docs, keep=keep, digest=digest).collect():
        got[r.text_sha256].append((r.doc_id, r.keep_id, r.group_size, r.kept))
    assert len(got) == len(groups)
    for t, ids in groups.items():
        rows = got[hashlib.sha256(t.encode()).hexdigest()]
        assert sorted(map(str, ids)) == sorted(str(r[0]) for r in rows)
        assert {r[1:3] for r in rows} == {(best[t], len(ids))}
        assert [r[0] for r in rows if r[3]] == [best[t]]


def test_distinct_rows(docs):
    got = X.distinct_rows(docs, keep="max")
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0, r.h) for r in got.collect()) == [(3, "clash"), (4, "clash"), (5, "clash"), (7, "clash"), (9, "clash"), (12, "clash")]


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert X.exact_dedup(none).count() == 0 and X.distinct_rows(none).count() == 0
    assert M.mix(none).count() == 0 and M.mixed_rows(none).count() == 0
    assert P.pack(none, **tokenizer_files()).count() == 0


def targets(sizes):
    """Sources in order get 5, 2, 1; what exceeds twice a size is shared again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        left = total - sum(2 * sizes[s] for s in full)
        w = sum(weight[s] for s in order if s not in full)
        out = {s: 2 * sizes[s] if s in full else left * weight[s] / w for s in order}
        over = {s for s in order if s not in full and out[s] > 2 * sizes[s]}
        if not over:
            return out
        full |= over


def test_mixing(spark, docs):
    many = spark.range(6000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 17 + 1).cast("int")).alias("text"), F.when(F.col("id") % 10 < 6, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 5).cast("string"))).alias("source"), F.lit("x").alias("size"))
    for df in (docs, many):
        rows = [(r.doc_id, len((r.text or "").split()), r.source) for r in df.select("doc_id", "text", "source").collect()]
        sizes = collections.Counter()
        for _, n, s in rows:
            sizes[s] += n
        want = targets(sizes)
        got = M.mix(df).collect()
        assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(i), n) for i, n, _ in rows)
        source_of = {(i, n): s for i, n, s in rows}
        taken = collections.Counter()
        for r in got:
            s = source_of[r.doc_id, r.size]
            assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 and 0 <= r.copies <= 2 and r.taken == r.copies * r.size
            taken[s] += r.taken
        largest = {s: max(n for _, n, x in rows if x == s) for s in sizes}
        assert all(abs(taken[s] - want[s]) <= largest[s] for s in sizes)
        again = M.mix(df.repartition(3)).collect()
        assert sorted((str(r.doc_id), r.taken) for r in again) == sorted((str(r.doc_id), r.taken) for r in got)
        mixed = M.mixed_rows(df)
        assert mixed.columns == df.columns and mixed.count() == sum(r.copies for r in got)


def check_packing(df, files):
    """Every document's ids are covered once, sequences are gapless; gives (share of padding, whole documents that were cut, documents)."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(files["tokenizer_json"])
    given = collections.Counter()
    for r in df.select("doc_id", "text").collect():
        given[r.doc_id, (*tok.encode(r.text or "", add_special_tokens=False).ids, 0)] += 1
    by_id = collections.defaultdict(list)
    for i, ids in given:
        by_id[i].append(ids)
    covered, by_bin = collections.Counter(), collections.defaultdict(list)
    pieces = P.pack(df, **files).collect()
    for r in pieces:
        by_bin[r.sequence_id].append((r.offset, r.length))
        same = [ids for ids in by_id[r.doc_id] if len(ids) == r.doc_tokens and zlib.crc32(struct.pack(f"<{r.length}I", *ids[r.start : r.start + r.length])) == r.ids_crc32]
        assert same
        covered[r.doc_id, r.doc_tokens] += r.length
    want = collections.Counter()
    for (i, ids), n in given.items():
        want[i, len(ids)] += n * len(ids)
    assert covered == want
    for places in by_bin.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    used = sum(want.values())
    return 1 - used / 1024 / max(1, len(by_bin)), sum(r.length < r.doc_tokens <= 1024 for r in pieces), sum(given.values())


def test_packing(spark, docs):
    files = tokenizer_files()
    extra = spark.createDataFrame([(100 + i, "Ünïcode wörds, <|endoftext|> 12\n\n x" * (i % 9) + "tail", "z", "c", "c") for i in range(60)], DDL)
    padding, cut_short, _ = check_packing(docs.unionByName(extra), files)
    assert padding < 0.02 and not cut_short


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_packing_edges(spark, adaptive):
    """No leftover, nothing at all, one row, null and repeated ids, and short documents only."""
    files = tokenizer_files()
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        table = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, length string, part string")
        full = " word" * 1023  # with the closing id exactly a sequence
        assert check_packing(table([(1, full, "x", "y")]), files) == (0.0, 0, 1)
        assert check_packing(table([(k, full * 3, "x", "y") for k in range(3)]), files)[1] == 0
        assert P.pack(table([]), **files).count() == 0
        check_packing(table([(None, None, None, None)]), files)
        check_packing(table([(None, "a b", "", "")] * 700 + [(7, "c " * 2000, "", "")] * 5), files)
        padding, _, n = check_packing(table([(k, " word" * (519 + k % 5), "", "") for k in range(1000)]), files)
        assert n == 1000 and padding < 0.03
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)


def test_packing_keeps_documents_whole(spark):
    padding, cut_short, n = check_packing(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), tokenizer_files())
    assert padding < 0.02 and cut_short < 0.02 * n


def test_fast_ids_equal_tokenizers():
    from tokenizers import Tokenizer

    files = tokenizer_files()
    tok, encode = Tokenizer.from_file(files["tokenizer_json"]), P.packed_encoder(*files.values())
    texts = [f"a{chr(c)}a 1{chr(c)}1 {chr(c)} {chr(c)}{chr(c)}\n{chr(c)}!" for c in [*range(0x3000), *range(0x1F300, 0x1F400), 0xFEFF, 0xE000]]
    for t in texts:
        ids = tok.encode(t, add_special_tokens=False).ids
        assert encode(t) == struct.pack(f"<{len(ids)}I", *ids)
