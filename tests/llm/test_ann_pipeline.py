"""Forest search against brute force, and the pipeline's stages."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from feedmart.llm import ann as A
from feedmart.llm import queries as Q

SF = "/root/testdata/sf0.001"


def test_forest_recall(spark):
    """On directionless vectors, the worst case, at least nine tenths of the nearest are found."""
    x = np.random.default_rng(1).standard_normal((6000, 24)).astype(np.float32) * np.linspace(0.5, 1.5, 6000)[:, None].astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, score int")
    got = A.nearest(df, df.filter("vec_id % 100 = 0"), k=20).collect()  # the registered setting
    y = x.astype(np.float64)
    hit = 0
    for q in range(0, 6000, 100):
        rows = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == [*range(1, 21)] and q not in {r.vec_id for r in rows}
        for r in rows:
            assert abs(r.score - float((y[q] * y[r.vec_id]).sum())) < 1e-9
        assert [(-r.score, r.vec_id) for r in rows] == sorted((-r.score, r.vec_id) for r in rows)
        dots = y @ y[q]
        dots[q] = -np.inf
        hit += len({r.vec_id for r in rows} & {*np.argsort(-dots)[:20].tolist()})
    assert hit >= 0.9 * 60 * 20


def test_queue_and_depth():
    """The leaves of a search are those that the priority queue gives, and the share of rows that it takes falls as rows grow."""
    rng, shares = np.random.default_rng(2), []
    for n in (1000, 16_000):
        x = rng.standard_normal((n, 16))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        forest = A.fit_forest(x, 8, int(np.log2(n / 32)), 1.0)
        leaves, needed = forest.leaves(x), []
        assert leaves.max() == 2**forest.depth - 1 and np.bincount(leaves[:, 0]).max() <= 64  # depth is rounded down, so leaves hold 32 to 63 rows
        for q in x[:20]:
            order = forest.queue_order(q, 60)
            bounds = forest.bounds(q).ravel()  # leaves may have one bound, that of a cut above both, so places may differ at the end
            assert np.allclose(bounds[order], np.sort(bounds[forest.search(q, 60)])) and len({*order}) == 60
            rank = np.empty((8, 2**forest.depth), int)
            rank.ravel()[np.argsort(forest.bounds(q).ravel(), kind="stable")] = np.arange(rank.size)
            best = rank[np.arange(8), leaves].min(axis=1)
            cut = np.sort(best[np.argsort(-(x @ q))[1:21]])[17]
            needed.append((best <= cut).mean())
        shares.append(np.mean(needed))
    assert shares[1] < 0.8 * shares[0]


def test_lengths_and_ties(spark):
    """A shorter vector counts as ended by zeros; of vectors with equal products the smaller ids come first, in leaves of any size."""
    rng = np.random.default_rng(4)
    rows = [(i, [1.0, float(rng.integers(0, 2)), *(0.25 * rng.integers(-8, 9, 2)).tolist()]) for i in range(900)] + [(900, [2.0]), (901, [1.0, 0.0])]
    df = spark.createDataFrame([(i, v) for i, v in rows], "vec_id long, embedding array<double>")
    x = np.array([v + [0.0] * (4 - len(v)) for _, v in rows])
    got: dict[int, list] = {}
    for r in A.nearest(df, df.filter("vec_id % 100 < 2 and vec_id >= 800"), k=10, recall=1.0, leaf_rows=8).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert set(got) == {800, 801, 900, 901}
    for q, found in got.items():
        dots = x @ x[q]
        assert found[0][0] == max(np.delete(dots, q)) and found == sorted(found, key=lambda r: (-r[0], r[1]))
    assert [v for _, v in got[900]] == [i for i in range(900)][:9] + [9]


def test_vectors_are_not_dealt_by_tree(spark, monkeypatch):
    """Vectors are shuffled a few times, not once a tree and block of queries, and results don't depend on the sizes of blocks."""
    x = np.random.default_rng(6).standard_normal((4000, 64)).astype(np.float32)
    x[3990:] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4).cache()
    queries, bus = df.filter("vec_id % 10 = 0"), spark.sparkContext._jsc.sc().listenerBus()
    df.count()

    def written() -> int:
        bus.waitUntilEmpty()
        return spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()

    rows = lambda: sorted(map(tuple, A.nearest(df, queries, k=5).collect()))
    before = written()
    first = rows()
    assert written() - before < 8 * x.nbytes and len(first) == 5 * 400
    monkeypatch.setattr(A, "BLOCK_ROWS", 150)
    monkeypatch.setattr(A, "BLOCK_QUERIES", 90)
    assert rows() == first


def test_copies_and_odd_vectors(spark):
    rows = [(i, [1.0, 0.0]) for i in range(40)] + [(40, [0.0, 1.0]), (41, None), (42, [0.0, 0.0]), (43, [float("nan"), 1.0]), (44, [None, 1.0]), (45, []), (46, [0.5, 0.5]), (46, [0.5, 0.5]), (None, [1.0, 1.0])]
    df = spark.createDataFrame([(*r, "c") for r in rows], "vec_id long, embedding array<double>, rank string")
    got = {}
    for r in A.nearest(df, df, k=3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got[0] == [1, 2, 3] and got[2] == [0, 1, 3] and got[39] == [0, 1, 2] and got[40] == [46, 0, 1] and set(got) == {*range(41), 46}
    few = df.filter("vec_id in (0, 40)")
    assert A.nearest(few, few, k=3).count() == 2 and A.nearest(df.limit(0), df.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    bad = {r.doc_id for r in Q.op9_toxicity(spark, SF).filter("predicted = 1").collect()}
    columns, rows = docs.columns, {r.doc_id: r for r in docs.collect()}
    after = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, after[-1], SF).cache()
        assert name == "packing" or out.columns == columns
        after.append(out)
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    assert ids(after[1]) == sorted(set(rows) - bad)
    low = lambda t: "".join(c.lower() if c.isascii() else c for c in t)
    best = {}
    for i in ids(after[1]):
        best[low(rows[i].text)] = max(i, best.get(low(rows[i].text), -1))
    assert ids(after[2]) == sorted(best.values())
    assert set(ids(after[3])) <= set(ids(after[2])) and len(ids(after[3])) > 0.9 * len(ids(after[2]))
    assert set(ids(after[4])) <= set(ids(after[3])) and after[4].count() > len(ids(after[3]))
    copies = {i: ids(after[4]).count(i) for i in set(ids(after[4]))}
    packed = after[5].groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
    assert {r.doc_id: r.n for r in packed} == {r.doc_id: copies[r.doc_id] * r.t for r in packed} and {r.doc_id for r in packed} == set(copies)


def _groups(texts: dict[int, str]) -> dict[int, int]:
    """Smallest id of each text's component, by all pairs of five-word shingle sets."""
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in ((i, t.lower().split()) for i, t in texts.items())}
    low = {i: i for i in sets}
    pairs = [(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8]
    while any(low[i] != low[j] for i, j in pairs):
        for i, j in pairs:
            low[i] = low[j] = min(low[i], low[j])
    return low


def test_near_stage_equals_brute_force(spark):
    """Copies with a few changed words, chains of them and one large group, against Jaccard over all pairs."""
    rng = np.random.default_rng(3)
    texts: dict[int, str] = {}
    for base in range(40):
        words = rng.integers(0, 5000, int(rng.integers(4, 160))).tolist()
        for _ in range(60 if base == 0 else int(rng.integers(1, 8))):
            texts[len(texts)] = " ".join(f"w{w}" for w in words)
            words = [*words]
            for _ in range(int(rng.integers(0, 4))):
                words[int(rng.integers(0, len(words)))] = int(rng.integers(0, 5000))
    texts = {i: t for i, t in texts.items() if t not in [texts[j] for j in range(i)]}
    low = _groups(texts)
    assert 40 < len(set(low.values())) < len(texts)
    docs = spark.createDataFrame([(i, t, "c") for i, t in texts.items()], "doc_id long, text string, source string")
    out = corpus_pipeline.remove_near_copies(spark, docs.repartition(3), SF)
    assert sorted(r.doc_id for r in out.collect()) == sorted(set(low.values()))


def test_near_stage_goes_by_fingerprints(spark, monkeypatch):
    """SimHash links alone join copies with one changed word among many; without bands these are all that is found."""
    from feedmart.llm import setsketch

    monkeypatch.setattr(setsketch, "_between", lambda members, *_: members.select(F.col("node").alias("u"), F.col("node").alias("v"), F.lit(0.0).alias("like")))
    monkeypatch.setattr(setsketch, "_sift_pairs", lambda pairs, *_: pairs.select("u", "v", F.lit(0.0).alias("like")).filter("false"))
    rng = np.random.default_rng(5)
    a, b = ([f"w{w}" for w in rng.integers(0, 9000, 1500)] for _ in range(2))
    texts = [" ".join(w) for w in (a, [*a[:-1], "changed"], ["other", *a[1:]], b)]
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    out = corpus_pipeline.remove_near_copies(spark, docs.repartition(2), SF)
    assert sorted(r.doc_id for r in out.collect()) == [0, 3]


def test_stages_with_repeated_and_null_ids(spark):
    """A row is its id and text: what one row loses, another row of that id keeps; null ids take part."""
    rng = np.random.default_rng(8)
    text = lambda n=120: [f"v{w}" for w in rng.integers(0, 9000, n)]
    near = lambda words: [*words[:-1], "changed"]
    a, b, c, d = text(), text(), text(), text()
    join = " ".join
    rows = [(1, join(a)), (5, join(near(a))), (5, join(b)), (None, join([*a[:-1], "other"])), (None, join(c)), (None, join(near(c))), (7, join(d)), (7, join(near(d))), (8, None), (9, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.remove_near_copies(spark, docs.repartition(3), SF).collect()]
    assert (1, join(a)) in kept and (5, join(b)) in kept and (5, join(near(a))) not in kept
    assert sum(i is None for i, _ in kept) == 1 and sum(i == 7 for i, _ in kept) == 1 and sum(i in (8, 9) for i, _ in kept) == 1 and len(kept) == 5
    exact = corpus_pipeline.remove_copies(spark, docs.unionByName(docs), SF)
    assert exact.count() == len(rows) - 1  # null and empty are one text
    mixed = corpus_pipeline.mix_sources(spark, docs, SF)
    assert mixed.columns == docs.columns and {(r.doc_id, r.text) for r in mixed.collect()} <= set(rows)
    packed = corpus_pipeline.pack_sequences(spark, docs, SF)
    assert packed.groupBy("doc_id").count().count() == len({i for i, _ in rows})
