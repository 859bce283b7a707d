"""SimHash links and repeated passages against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from feedmart.llm import chunks as C
from feedmart.llm import components as K
from feedmart.llm import simhash as S

DDL = "doc_id long, text string, fp string, u string"


def fingerprint(text):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    parts = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closure(fps):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(fps))]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(400)] + ["É", "ß"]
    base = [" ".join(rng.choices(vocab, k=rng.choice([1, 3, 4, 40, 200]))) for _ in range(60)]
    near = []
    for _ in range(60):  # copies with one word changed
        words = base[rng.randrange(6)].split()
        words[rng.randrange(len(words))] = rng.choice(vocab)
        near.append(" ".join(words))
    texts = base + near + base[:5] + [base[7].upper(), None, "", "  \n", "word " * 20_000]
    return [(i * 3, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("pairwise", [64, 1])
def test_near_duplicates(spark, rows, pairwise):
    """With lists of one fingerprint at most compared in pairs, all links come through midpoints."""
    df = spark.createDataFrame([(i, t, "c", "c") for i, t in rows], DDL)
    fps = [fingerprint(t) for _, t in rows]
    roots = closure(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.near_duplicates(df, pairwise=pairwise).collect()}
    assert got == {i: (f"{f:016x}", rows[roots[k]][0]) for k, ((i, _), f) in enumerate(zip(rows, fps, strict=True))}


def test_planted_distances(spark):
    """Fingerprints at every distance from 0 to 6 link exactly up to 4, by either way."""
    rng = random.Random(5)
    links = []
    for most_pairs in (64, 1):
        fps = [rng.getrandbits(64) for _ in range(40)]
        fps += [f ^ sum(1 << b for b in rng.sample(range(64), d)) for f in fps[:28] for d in range(1, 7)]
        signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
        found = S.index_links(spark.createDataFrame(signed, "fp long"), 4, most_pairs).distinct()
        many = found.filter("kind = 1").selectExpr("u as fp")
        both = found.filter("kind = 0").select("u", "v").union(S.midpoint_links(many, 4))
        comp = {r.node % (1 << 64): r.component for r in K.components(both, "u", "v").collect()}
        roots = closure(fps)
        for i in range(len(fps)):
            for j in range(i):
                assert (comp.get(fps[i], fps[i]) == comp.get(fps[j], fps[j])) == (roots[i] == roots[j] or fps[i] == fps[j])
        links.append(both.count())
    assert all(links)


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 100), (7, 7)] + [(500, 500 + i) for i in range(1, 300)]
    got = {r.node: r.component for r in K.components(spark.createDataFrame(chain, "a long, b long"), "a", "b").collect()}
    assert all(got[i] == 0 for i in range(61)) and got[200] == 100 and all(got[500 + i] == 500 for i in range(300))


def test_empty_and_null(spark):
    df = spark.createDataFrame([(None, None, "", ""), (4, "", "", ""), (4, "", "", "")], DDL)
    assert sorted((r.doc_id or 0, r.component_id) for r in S.near_duplicates(df).collect()) == [(0, 4), (4, 4), (4, 4)]
    assert S.near_duplicates(df.limit(0)).count() == 0 and C.repeated_passages(df).count() == 0 and C.repeated_passages(df.limit(0)).count() == 0


def test_gear_hash_rolls():
    data = np.frombuffer(random.Random(1).randbytes(300), np.uint8)
    whole = C.gear_hashes(data)
    for i in (40, 200, 299):
        want = sum(int(C.GEAR[data[i - k]]) << k for k in range(C.REACH)) % (1 << 32)
        assert whole[i] == want


def test_chunks_resist_shifts():
    rng = random.Random(2)
    text = " ".join(f"word{rng.randrange(900)}" for _ in range(800))
    a = {r[3:] for r in C.chunk_rows(text.encode(), C.WITHIN)}
    b = {r[3:] for r in C.chunk_rows(("odd " + text[:900] + " more words " + text[900:]).encode(), C.WITHIN)}
    assert len(a & b) > 0.9 * len(a)
    rows = C.chunk_rows(text.encode(), C.WITHIN)
    assert b"".join(text.encode()[s : s + n] for s, n, *_ in rows) == text.encode() and sum(r[2] for r in rows) == 800 and max(r[2] for r in rows) <= C.WITHIN + 1


def test_repeated_passages(spark):
    """Every document with 51 shared words is found, whatever stands around them; others are not."""
    rng = random.Random(8)
    words = lambda n: " ".join(f"t{rng.randrange(5000)}" for _ in range(n))
    shared = [words(51) for _ in range(30)]
    rows = [(2 * k, f"{words(rng.randrange(80))} {shared[k % 30]} {words(rng.randrange(80))}") for k in range(90)]
    rows += [(1001 + 2 * k, f"{words(100)} {shared[k % 30][:60]} {words(50)}") for k in range(20)]
    long = words(20_000)
    rows += [(5000, long + " " + shared[0]), (5001, None), (5002, "")]
    found = C.repeated_passages(spark.createDataFrame([(i, t, "c", "c") for i, t in rows], DDL))
    got = found.collect()
    assert {r.doc_id for r in got} == {2 * k for k in range(90)} | {5000}
    text = dict(rows)
    for r in got:
        part = text[r.doc_id].encode()[r.start : r.start + r.length].decode()
        assert len(part.split()) == r.n_words and any(part.strip() in s or s in part for s in shared)
    kept = {r.doc_id for r in got if r.kept}
    assert kept == {2 * k for k in range(30)}
    cut = {r.doc_id: r.text for r in C.drop_passages(spark.createDataFrame([(i, t, "c", "c") for i, t in rows], DDL), found).collect()}
    assert cut[0] == text[0] and len(cut[178].split()) <= len(text[178].split()) - 23 and cut[5002] == ""


def islands(rows, within, least):
    """Passages by chunk lists and a count of rows per digest, nothing else."""
    chunks = [C.chunk_rows((t or "").encode(), within) for _, t in rows]
    held = {}
    for k, found in enumerate(chunks):
        for c in found:
            held.setdefault(c[3:], set()).add(k)
    ids = [i for i, _ in rows]
    low = {d: min((ids[k] is not None, ids[k] or 0) for k in ks) for d, ks in held.items() if len(ks) > 1}
    out = set()
    for k, found in enumerate(chunks):
        run = []
        for c in [*found, None]:
            if c is not None and c[3:] in low:
                run.append(c)
                continue
            if run and sum(x[2] for x in run) >= least:
                first = min(low[x[3:]] for x in run)
                kept = all(low[x[3:]] == (ids[k] is not None, ids[k] or 0) for x in run)
                out.add((ids[k], rows[k][1], run[0][0], sum(x[1] for x in run), sum(x[2] for x in run), len(run), first[1] if first[0] else None, kept))
            run = []
    return out


def test_passages_equal_brute_force(spark):
    """Ids that repeat with other texts, null ids, repeated rows, repeats inside one row, and short words."""
    rng = random.Random(12)
    words = lambda n, v=4000: " ".join(f"t{rng.randrange(v)}" for _ in range(n))
    shared = words(120)
    rows = [(7, f"{words(30)} {shared} {words(40)}"), (7, f"{words(50)} {shared}"), (7, words(90)), (None, f"{shared} {words(10)}"), (None, words(60)), (3, f"{words(5)} {shared}")]
    twice = words(60)
    rows += [(20, f"{twice} {words(20)} {twice}"), (21, words(70)), (22, None), (23, "")] + [(24, words(80))] * 2
    rows += [(100 + k, words(rng.randrange(200), 40)) for k in range(30)]
    df = spark.createDataFrame([(i, t, "c", "c") for i, t in rows], DDL)
    keys = {r.text: r.k for r in df.selectExpr("text", "xxhash64(coalesce(text, '')) as k").collect()}
    got = {(r.doc_id, r.text_key, r.start, r.length, r.n_words, r.n_chunks, r.first_doc_id, r.kept) for r in C.repeated_passages(df.repartition(3)).collect()}
    assert got == {(i, keys[t], *rest) for i, t, *rest in islands(rows, C.WITHIN, 23)}
    assert {i for i, *_ in got} >= {7, 3, None, 24} and 20 not in {i for i, *_ in got}


def test_shared_passages_keep_23_words():
    """Whatever the words' lengths and what stands around: between the first and last common boundary of 51 words lie 23 at least."""
    rng = random.Random(13)
    word = lambda most: "".join(rng.choice("abc") for _ in range(rng.randint(1, most)))
    for _ in range(1500):
        most = rng.choice([1, 2, 3, 9])
        shared = " ".join(word(most) for _ in range(51))
        found = []
        for _ in range(2):
            before, after = (" ".join(word(most) for _ in range(rng.randrange(1, 40))) for _ in range(2))
            text = f"{before} {shared} {after}".encode()
            at = len(before) + 1
            found.append({(s - at, n, w) for s, n, w, *_ in C.chunk_rows(text, C.WITHIN) if s >= at and s + n <= at + len(shared)})
        assert sum(w for _, _, w in found[0] & found[1]) >= 23
