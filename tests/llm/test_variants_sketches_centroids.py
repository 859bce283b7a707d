"""Spelling variants, SetSketch near-duplicates and centroid clustering against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from feedmart.llm import centroids as K
from feedmart.llm import setsketch as M
from feedmart.llm import spelling as V

DDL = "doc_id long, text string, word string, node long, band int"


def edits_of_one(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(rows: list[tuple[int | None, str | None]], least: int = 6, count: int = 5, every: int = 199) -> set[tuple]:
    n: Counter[str] = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
            if h % every == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            n[low] += 1
    n = Counter({w: k for w, k in n.items() if len(w) >= least and k >= count})
    near = {w: [x for x in n if edits_of_one(w, x)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None

    def root(w: str) -> str:
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


@pytest.fixture(scope="module")
def spelled():
    rng = random.Random(5)
    letters = "abcdeiorstéÉ×"
    base = ["".join(rng.choices(letters, k=rng.randint(5, 12))) for _ in range(60)] + ["international", "internationale", "x" * 400, "x" * 401, "aaaaaa", "aaaaaaa", "aaaaaaaa"]
    weights = [rng.choice([1, 2, 9, 60]) for _ in base]

    def typo(w: str) -> str:
        k = rng.randrange(len(w))
        return rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1 :]])

    words = base + [typo(w) for w in base for _ in range(4)]
    texts = [" ".join(rng.choices(words, weights=[*weights, *[0.5] * (len(words) - len(base))], k=150)).replace("a", rng.choice("aA")) for _ in range(40)]
    return [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, texts[4]), (77, None), (78, ""), (79, "one-two 3 中文")]


@pytest.mark.parametrize("segment", [V.SEGMENT, 4])
def test_variants(spark, spelled, segment, monkeypatch):
    """All words, forms, roots and counts, with whole ends and with ends split into pieces of four words."""
    monkeypatch.setattr(V, "SEGMENT", segment)
    monkeypatch.setattr(V.near_words, "__defaults__", (segment,))
    df = spark.createDataFrame([(i, t, "c", 1, 2) for i, t in spelled], DDL).repartition(3)
    got = V.spelling_variants(df)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = [tuple(r) for r in got.collect()]
    want = brute_variants(spelled)
    assert len(rows) == len(want) and set(rows) == want and sum(r[1] is not None for r in rows) > 10
    assert V.spelling_variants(df.limit(0)).count() == 0


def test_position_index():
    """Every word against every other, lengths from one letter up."""
    rng = random.Random(2)
    words = sorted({"".join(rng.choices("abé", k=rng.randint(1, 7))) for _ in range(400)})
    index = V.PositionIndex([(w, rng.randint(1, 5)) for w in words])
    for q in [*words, "zzz", "aaaaaaaaaaaa"]:
        bits = index.near(q)
        assert {w for k, (w, _) in enumerate(index.words) if bits >> k & 1} == {w for w in words if edits_of_one(q, w)}
    with pytest.raises(ValueError):
        V.spelling_variants(None, least_length=5)


def _shingles(text: str | None, k: int = 4) -> set[tuple[str, ...]]:
    w = [x for x in re.split("[ \t-\r]+", "".join(c.lower() if c.isascii() else c for c in text or "")) if x]
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_components(texts: list[str | None], ids: list[int], k: int = 4) -> list[int]:
    sets = [_shingles(t, k) for t in texts]
    low = list(range(len(sets)))

    def root(i: int) -> int:
        while low[i] != i:
            i = low[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                low[root(i)] = root(j)
    best: dict[int, int] = {}
    for i in range(len(sets)):
        best[root(i)] = min(best.get(root(i), ids[i]), ids[i])
    return [best[root(i)] for i in range(len(sets))]


@pytest.fixture(scope="module")
def near():
    """Chains of copies with changed words, one large group, short texts at the very edge of 0.8, and odd ones."""
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(3000)}"
    texts: list[str | None] = []
    for base in range(30):
        words = [word() for _ in range(rng.choice([5, 8, 12, 60, 150]))]
        for _ in range(150 if base == 0 else rng.randint(1, 6)):
            texts.append(" ".join(words))
            words = [*words]
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = word()
            if rng.random() < 0.3:
                words.append(word())
    texts += ["a b c d e f g h", "a b c d e f g h i", "A\tB  c d\n", "a b c d", "a b", "a b", None, "", " \n ", "É b c d", "é b c d", "tok " * 30_000, texts[3], texts[3].upper()]
    return texts


@pytest.mark.parametrize("block", [M.BLOCK, 3])
def test_near_duplicates(spark, near, block, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", block)
    ids = [7 * i % 1009 for i in range(len(near))]
    want = brute_components(near, ids)
    df = spark.createDataFrame([(i, t, "c", 1, 2) for i, t in zip(ids, near, strict=True)], DDL).repartition(3)
    got = M.near_duplicates(df)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    rows = {r.doc_id: r for r in got.collect()}
    assert len(rows) == len(near) and {i: rows[i].component_id for i in ids} == dict(zip(ids, want, strict=True))
    assert all(rows[i].n_shingles == len(_shingles(t)) and rows[i].kept == (i == rows[i].component_id) for i, t in zip(ids, near, strict=True))
    assert len(set(want)) < len(near) - 20


def test_long_lists(spark, near, monkeypatch):
    """Lists of several runs of blocks give what lists in one row give, and no sketch is dealt twice on the way to either."""
    monkeypatch.setattr(M, "BLOCK", 3)
    monkeypatch.setattr(M, "RUN", 2)
    ids = list(range(len(near)))
    df = spark.createDataFrame([(i, t, "c", 1, 2) for i, t in zip(ids, near, strict=True)], DDL).repartition(3)
    got = {r.doc_id: r.component_id for r in M.near_duplicates(df).collect()}
    assert got == dict(zip(ids, brute_components(near, ids), strict=True))
    nodes = spark.createDataFrame([], "node long, n long, sketch binary")
    plan = M._between(spark.createDataFrame([], "band int, key long, node long, component long"), nodes, 0.8, None)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(band" in line]
    # Three forms of lists, each dealt once with its sketches, and before that twice by rows without sketches.
    assert len(dealt) == 9


def test_sketches_go_to_partners_only(spark, monkeypatch):
    """Of texts that meet in bands by chance, only those with a likely partner there hand on whole sketches; again only in lists of a text whose partners were too many."""
    rng = random.Random(3)
    monkeypatch.setattr(M, "BAND", 1)  # nearly all texts meet
    monkeypatch.setattr(M, "BANDS", 20)
    common = [f"c{k}" for k in range(40)]
    texts = [" ".join([*common, *(f"w{rng.randrange(10**6)}" for _ in range(100))]) for _ in range(40)]
    words = [f"x{k}" for k in range(120)]
    group = []
    for k in range(6):  # a chain: each is near the next one only
        group.append(" ".join(words[10 * k :] + [f"y{j}" for j in range(10 * k)]))
    texts += group
    seen, between = [], M._between

    def counted(members, nodes, least, partners):
        seen.append((partners, members.select("node").distinct().count()))
        return between(members, nodes, least, partners)

    monkeypatch.setattr(M, "_between", counted)
    monkeypatch.setattr(M, "PARTNERS", (1, None))
    df = spark.createDataFrame([(i, t, "c", 1, 2) for i, t in enumerate(texts)], DDL).repartition(2)
    got = {r.doc_id: r.component_id for r in M.near_duplicates(df).collect()}
    assert got == dict(enumerate(brute_components(texts, list(range(len(texts))))))
    assert seen and all(n <= len(group) for _, n in seen)


def test_marks():
    """Equal marks are no fewer than equal registers."""
    rng = np.random.default_rng(8)
    a = rng.integers(0, 65536, (200, M.REGISTERS)).astype(np.uint16)
    b = np.where(rng.random(a.shape) < 0.6, a, rng.integers(0, 65536, a.shape)).astype(np.uint16)
    met = M._ALIKE[M.marks(a) ^ M.marks(b)].sum(axis=1, dtype=np.int64)
    assert (met == ((a & 15) == (b & 15)).sum(axis=1)).all() and (met >= (a == b).sum(axis=1)).all()


def stacked(plan: str) -> int:
    """The most Python steps upon each other in one stage of a plan: a task runs a Python worker for each."""
    most, path = 0, []
    for line in plan.splitlines():
        name = line.lstrip(" :+-*")
        depth = len(line) - len(name)
        path = [(d, n) for d, n in path if d < depth]
        above = path[-1][1] if path else 0
        path.append((depth, 0 if "Exchange" in name[:20] else above + ("MapInArrow" in name[:20])))
        most = max(most, path[-1][1])
    return most


def test_one_python_worker_a_task(spark):
    """No step on lists of sketches puts Python steps upon each other, and a block that meets itself is held once."""
    nodes = spark.createDataFrame([(k, 5, bytes(2 * M.REGISTERS + M.CELLS)) for k in range(4)], "node long, n long, sketch binary")
    members = spark.createDataFrame([(0, 1, k, k) for k in range(3)], "band int, key long, node long, component long")
    for step in (M._partnered(members, nodes, 0.8), M._between(members, nodes, 0.8, 64)):
        assert stacked(step._jdf.queryExecution().executedPlan().toString()) == 1
    rows = M._block_pairs(members, nodes).collect()
    assert [(r.first, sorted(h.node for h in r.held)) for r in rows] == [(0, [0, 1, 2])]


@pytest.mark.parametrize("run", [2, 1000])
def test_pairs_of_lists(spark, run, monkeypatch):
    """Each two texts of a list in different components come once, whether their blocks meet in one row or several."""
    monkeypatch.setattr(M, "BLOCK", 2)
    monkeypatch.setattr(M, "RUN", run)
    members = spark.createDataFrame([(b, 7, k, k % 9) for b in (0, 1) for k in range(20 - 15 * b)], "band int, key long, node long, component long")
    met = []
    for batch in M._block_pairs(members, spark.createDataFrame([(k, 5) for k in range(20)], "node long, n long")).toArrow().to_batches():
        node, band = batch.column(3).values.field(0).to_pylist(), batch.column(0).to_pylist()
        met += [(band[r], *sorted((node[i], node[j]))) for p in M._pairs_of(batch, 0.8) for i, j, r in zip(*map(np.ndarray.tolist, p), strict=True)]
    assert sorted(met) == [(b, u, v) for b in (0, 1) for u in range(20 - 15 * b) for v in range(u + 1, 20 - 15 * b) if u % 9 != v % 9]


def test_parts():
    """Registers and cells come back from a slice of a column as they were written."""
    rng = np.random.default_rng(2)
    registers, cells = rng.integers(0, 65536, (5, M.REGISTERS)).astype(np.uint16), rng.integers(0, 256, (5, M.CELLS)).astype(np.uint8)
    column = pa.array([a.tobytes() + b.tobytes() for a, b in zip(registers, cells, strict=True)])
    for kind in (pa.binary(), pa.large_binary()):
        a, b = M._parts(column.cast(kind).slice(1, 3))
        assert (a == registers[1:4]).all() and (b == cells[1:4]).all()
    assert M._parts(column.slice(2, 0))[0].shape == (0, M.REGISTERS)


def test_near_duplicates_edges(spark):
    """No rows; null and repeated ids."""
    empty = spark.createDataFrame([], DDL)
    assert M.near_duplicates(empty).count() == 0
    df = spark.createDataFrame([(None, "a b c d e", "", 0, 0), (4, "a b c d e", "", 0, 0), (4, "x y z", "", 0, 0), (None, None, "", 0, 0)], DDL)
    got = sorted([tuple(r) for r in M.near_duplicates(df).collect()], key=repr)
    assert got == sorted([(None, 2, 4, False), (4, 2, 4, True), (4, 1, 4, True), (None, 0, None, True)], key=repr)


def test_sketches():
    """Merged registers are those of the union, shared ones follow the similarity, and its estimate is near."""
    rng = np.random.default_rng(4)
    for n in (1, 3, 40, 3000):
        a, b = (np.unique(rng.integers(-(2**63), 2**63 - 1, n)) for _ in range(2))
        assert (np.maximum(M.sketch(a), M.sketch(b)) == M.sketch(np.union1d(a, b))).all()
    for share in (0.3, 0.8, 0.95):
        equal, found = [], []
        for _ in range(60):
            both, own = rng.integers(-(2**63), 2**63 - 1, int(1000 * share)), rng.integers(-(2**63), 2**63 - 1, 1000 - int(1000 * share))
            a, b = np.sort(np.append(both, own[: len(own) // 2])), np.sort(np.append(both, own[len(own) // 2 :]))
            x, y = M.sketch(a), M.sketch(b)
            equal.append((x == y).mean())
            found.append(M.likelihood_gap(np.array([(x > y).sum()]), np.array([(x < y).sum()]), np.array([float(len(a))]), np.array([float(len(b))]), 0.8))
        assert abs(np.mean(equal) - share) < 0.02 and abs(np.mean([f[0][0] for f in found]) - share) < 0.02
        assert (max(f[1][0] for f in found) < M.GAP) == (share >= 0.8)


def brute_clusters(vectors: list[tuple[int | None, list | None]]) -> set[tuple]:
    kept = [(i, [int(np.floor(1024.0 * x)) for x in v]) for i, v in vectors if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest()
    cents = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:8]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(cents))
    for _ in range(10):
        groups: dict[int, list] = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        for k, members in groups.items():
            cents[k] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    last = [(i, *near(v)) for i, v in kept]
    own = Counter()
    for _, d, k in last:
        own[k] += d
    return {(i, k, d, own[k], sum(own.values()), hashlib.sha256(",".join(map(str, cents[k])).encode()).hexdigest()) for i, d, k in last}


def test_centroids(spark):
    """All columns, with ties, repeated and malformed vectors, and fewer vectors than centroids."""
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((5, 64))
    rows: list[tuple] = [(i, [float(x) for x in np.float32(centres[i % 5] + rng.standard_normal(64) * 0.3)]) for i in range(200)]
    rows += [(200 + i, [float(i % 2)] * 64) for i in range(20)] + [(300, rows[0][1]), (None, rows[1][1]), (301, None), (302, []), (303, [1.0] * 63), (304, [float("nan")] * 64), (305, [float("inf")] + [0.0] * 63), (306, [None] + [0.0] * 63), (307, [-0.0004] * 64)]
    ddl = "vec_id long, embedding array<double>, v string, cluster string, distance int"
    df = spark.createDataFrame([(*r, "c", "c", 0) for r in rows], ddl).repartition(3)
    got = K.cluster(df)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert {tuple(r) for r in got.collect()} == brute_clusters(rows)
    few = [r for r in rows if r[0] in (1, 2, 3)]
    assert {tuple(r) for r in K.cluster(df.filter("vec_id in (1, 2, 3)")).collect()} == brute_clusters(few)
    assert K.cluster(df.limit(0)).count() == 0
    assert K.cluster(spark.createDataFrame([(1, [1e300] * 64, "", "", 0), (2, [0.5] * 64, "", "", 0)], ddl)).count() == 1


def test_bounds_rule_out():
    """Fewer distances than rows times centroids where centroids stand apart, and the same answers."""
    rng = np.random.default_rng(7)
    cents = rng.integers(-3000, 3000, (8, 64))
    x = cents[rng.integers(0, 8, 500)] + rng.integers(-200, 200, (500, 64))
    axes = np.linalg.eigh(np.cov(x.T.astype(float)))[1][:, ::-1]
    lead = x @ axes[:, :16]
    rest = np.sqrt(np.maximum((x.astype(float) ** 2).sum(axis=1) - (lead**2).sum(axis=1), 0))
    best, distance, work = K.nearest_centroids(x, lead, rest, cents, axes)
    every = ((x[:, None] - cents[None]) ** 2).sum(axis=2)
    assert (best == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all() and work < 2 * len(x)
