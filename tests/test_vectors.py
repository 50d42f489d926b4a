import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logloom.functions import vectors as vec
from logloom.operators import embed as em, knn


def brute(queries, vectors, k):
    hits = set()
    for qid, q in queries:
        q = np.array(q, dtype=float)
        if not q.any():
            continue
        near = []
        for vid, v in vectors:
            v = np.array(v, dtype=float)
            if v.any():
                cosine = q @ v / np.sqrt(q @ q) / np.sqrt(v @ v)
                near.append((round(max(0.0, 1 - cosine), 9), vid))
        hits |= {(qid, vid, rank + 1) for rank, (_, vid) in enumerate(sorted(near)[:k])}
    return hits


def frames(spark, queries, vectors):
    return (
        spark.createDataFrame(queries, "query_id long, query_vec array<float>").repartition(3),
        spark.createDataFrame(vectors, "vec_id long, vec array<float>").repartition(3),
    )


def clustered(rng, n, start=0):
    """A third of all vectors are copies of one; some are zero; the rest form clusters."""
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = []
    for i in range(n):
        if i % 3 == 0:
            v = [1.0, 2.0, 0.0, 0.0, -1.0, 0.5]
        elif i % 29 == 0:
            v = [0.0] * 6
        else:
            v = [c + rng.gauss(0, 0.05) for c in centres[i % 5]]
        rows.append((start + i, [float(np.float32(x)) for x in v]))
    return rows


@pytest.mark.parametrize("sizes", [{}, {"block_rows": 20, "query_rows": 11, "max_pivots": 9}, {"block_rows": 50, "max_pivots": 2}, {"block_rows": 50, "cell_rows": 3}])
def test_knn_is_exact_with_copies_and_zero_vectors(spark, sizes):
    rng = random.Random(5)
    queries, vectors = clustered(rng, 60, 1000), clustered(rng, 240)
    q, v = frames(spark, queries, vectors)
    got = {(r.query_id, r.vec_id, r["rank"]) for r in knn.knn_join(q, v, 4, **sizes).collect()}
    assert got == brute(queries, vectors, 4)


@pytest.mark.parametrize("width", [2, 4, 24])
def test_knn_over_many_cells_is_exact(spark, width):
    rng = random.Random(width)
    rows = [(i, [float(np.float32(rng.gauss(0, 1))) for _ in range(width)]) for i in range(3000)]
    q, v = frames(spark, [(i, x) for i, x in rows[::40]], rows)
    got = {(r.query_id, r.vec_id, r["rank"]) for r in knn.knn_join(q, v, 5, block_rows=400, query_rows=20, cell_rows=4).collect()}
    assert got == brute([(i, x) for i, x in rows[::40]], rows, 5)


def test_work_of_a_query_does_not_grow_with_the_table(spark):
    """Vectors looked at for each query, in tables of 4,000 and 64,000 rows."""
    rng = np.random.default_rng(3)
    looked = []
    for n in (4_000, 64_000):
        x = rng.standard_normal((n, 4)).astype(np.float32)
        vectors = spark.createDataFrame(pa.table({"vec_id": np.arange(n), "vec": list(x)}))
        tree = knn.pivot_tree(vectors, n // knn.CELL_ROWS)
        knn.placed_vectors(vectors, tree)
        assert len(tree.cells) == n // knn.CELL_ROWS and tree.count.sum() == n
        unit = x / np.linalg.norm(x, axis=1)[:, None]
        q = unit[:200]
        kth = np.sort(1 - q @ unit.T, axis=1)[:, 4]
        home = sum(tree.count[c].sum() for c in tree.home_cells(q, 5))
        opened = sum(tree.count[cells].sum() for _, cells in tree.open_cells(q, kth))
        looked.append((home + opened) / len(q))
    assert looked[1] < 1.5 * looked[0] and looked[1] < 1000


def test_pivots_are_compared_with_those_near_queries_only(monkeypatch):
    """Products made to route a few queries, in a tree of 4,096 cells; and every vector is in the cell of its nearest pivots."""
    rng = np.random.default_rng(4)
    unit = rng.standard_normal((20_000, 4))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    tree = knn.PivotTree.of(unit[:4096])
    cell, reach, top_reach = tree.place(unit)
    home = (unit @ tree.top.T).argmax(axis=1)
    for i in range(0, 20_000, 997):
        near = np.sqrt(np.maximum(0, 2 - 2 * tree.cells[tree.children(home[i])] @ unit[i]))
        assert reach[i] == pytest.approx(near.min(), abs=1e-7) and near[cell[i] - tree.first[home[i]]] == pytest.approx(near.min(), abs=1e-7)
    found = np.unique(cell)
    tree.measured(pa.table({"cell": found, "n": np.bincount(cell)[found], "radius": [reach[cell == c].max() for c in found], "least": [reach[cell == c].min() for c in found], "top_radius": [top_reach[cell == c].max() for c in found]}), 1000)
    made, distances = [], knn._distances
    monkeypatch.setattr(knn, "_distances", lambda x, y: made.append(len(x) * len(y)) or distances(x, y))
    q = unit[5000:5010]
    kth = np.sort(1 - q @ unit.T, axis=1)[:, 4]
    opened = [set() for _ in q]
    for row, cells in tree.open_cells(q, kth):
        for r, c in zip(row, cells):
            opened[r].add(c)
    assert sum(made) < 4096 * 10
    for i, x in enumerate(q):
        assert set(cell[np.argsort(1 - unit @ x)[:5]]) <= opened[i]
    for x, cells in zip(q, tree.home_cells(q, 5)):
        n = tree.count[cells]
        assert n.sum() >= 20 > n.sum() - n.max() and (np.diff(cells) > 0).all() and cell[np.argmax(unit @ x)] in cells


def test_means_of_narrow_vectors_need_no_object_aggregate(spark):
    rows = [(i % 7 if i % 11 else None, [float(i), float(i * i % 13), -1.5]) for i in range(500)]
    vectors = spark.createDataFrame(rows, "k long, v array<double>")
    apart = em.mean_pool(vectors, "k", "v", width=3)
    assert "ObjectHashAggregate" not in apart._jdf.queryExecution().toString()
    means, whole = ({r.k: (r.mean_vector, r.n_vectors) for r in x.collect()} for x in (apart, em.mean_pool(vectors, "k", "v")))
    assert means.keys() == whole.keys()
    for k, (mean, n) in whole.items():
        assert means[k] == (pytest.approx(mean), n)


def test_queries_that_no_bound_helps_hold_no_lists_of_cells(spark):
    """Vectors without structure: pairs of queries and cells stay few, and the result is exact."""
    rng = np.random.default_rng(8)
    n = 6_000
    x = rng.standard_normal((n, 48)).astype(np.float32)
    vectors = spark.createDataFrame(pa.table({"vec_id": np.arange(n), "vec": list(x)}))
    tree = knn.pivot_tree(vectors, n // 4)
    placed = knn.placed_vectors(vectors, tree, 500)
    queries = vectors.selectExpr("vec_id AS query_id", "vec AS query_vec", "0.9D AS kth")
    assert placed.count() == n
    routed = knn._routed(queries, tree, 5)
    assert routed.agg(F.sum(F.size("cells"))).first()[0] <= 2 * n
    got = knn.knn_join(queries.drop("kth").where("query_id % 30 = 0"), vectors, 5, block_rows=500, cell_rows=4, query_rows=64).collect()
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = np.round(1 - unit[::30] @ unit.T, 9)
    want = {(30 * i, int(v), r + 1) for i, row in enumerate(near) for r, v in enumerate(np.lexsort((np.arange(n), row))[:5])}
    assert {(r.query_id, r.vec_id, r["rank"]) for r in got} == want


def test_vectors_are_not_copied_for_queries_that_meet_all_of_them(spark, monkeypatch):
    """Rows of vectors that searches are given, if no bound helps and memory holds few of the queries at once; hits as in brute force."""
    rng = np.random.default_rng(12)
    n, copies, search = 3_000, [], knn._search
    x = rng.standard_normal((n, 48)).astype(np.float32)
    x[2_000:2_400] = x[:400] + 0.2 * rng.standard_normal((400, 48)).astype(np.float32)
    vectors = spark.createDataFrame(pa.table({"vec_id": np.arange(n), "vec": list(x)}))

    def counted(routed, placed, k):
        copies.append(placed.agg(F.sum("n_slices")).first()[0] or 0)
        return search(routed, placed, k)

    monkeypatch.setattr(knn, "_search", counted)
    monkeypatch.setattr(knn, "SIDE_BYTES", 200 * 8 * 48, raising=False)
    monkeypatch.setattr(knn.knn_join, "__defaults__", tuple(200 * 8 * 48 if d == getattr(knn, "ROUND_BYTES", None) else d for d in knn.knn_join.__defaults__))
    queries = vectors.selectExpr("vec_id AS query_id", "vec AS query_vec")
    got = knn.knn_join(queries, vectors, 4, block_rows=500, cell_rows=4).collect()
    assert sum(copies) <= 2 * n
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = np.round(np.maximum(0, 1 - unit @ unit.T), 9)
    want = {(i, int(v), r + 1) for i, row in enumerate(near) for r, v in enumerate(np.lexsort((np.arange(n), row))[:4])}
    assert {(r.query_id, r.vec_id, r["rank"]) for r in got} == want


@pytest.mark.parametrize("sizes", [{}, {"block_rows": 50, "cell_rows": 3}, {"block_rows": 50, "cell_rows": 3, "round_bytes": 1000}])
def test_knn_within_a_distance(spark, sizes):
    rng = random.Random(6)
    queries, vectors = clustered(rng, 60, 1000), clustered(rng, 240)
    q, v = frames(spark, queries, vectors)
    all_hits = knn.knn_join(q, v, 4).collect()
    for within in (0.0, 0.002, 0.5):
        got = {(r.query_id, r.vec_id, r["rank"]) for r in knn.knn_join(q, v, 4, within=within, **sizes).collect()}
        assert got == {(r.query_id, r.vec_id, r["rank"]) for r in all_hits if r.distance <= within}


def test_knn_with_fewer_vectors_than_k_and_with_none(spark):
    q, v = frames(spark, [(1, [1.0, 0.0])], [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0])])
    assert knn.knn_join(q, v, 5).count() == 2
    assert knn.knn_join(q, v, 5, block_rows=1).count() == 2
    assert knn.knn_join(q, v.where("false"), 5).count() == 0


def test_knn_plan(spark):
    q, v = frames(spark, [(1, [1.0, 0.0])], [(1, [1.0, 0.0])])
    plan = knn.knn_join(q, v, 2)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_unit_norm_and_distance(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    a = vec.unit(F.col("a"))
    rows = df.select(a.alias("u"), vec.cosine_distance(a, vec.unit(F.col("b"))).alias("d")).collect()
    assert rows[0].u == pytest.approx([0.6, 0.8]) and rows[0].d == pytest.approx(0.04)
    assert rows[1].u == [0.0, 0.0] and rows[1].d == 1.0
    assert spark.range(1).select(vec.zero_vector(3).alias("z")).first().z == [0.0] * 3


def test_mean_pool(spark):
    rng = random.Random(9)
    rows = [("hot" if i % 3 else "cold", [rng.random() for _ in range(4)]) for i in range(200)]
    got = em.mean_pool(spark.createDataFrame(rows, "k string, v array<double>").repartition(6), "k", "v").collect()
    for r in got:
        assert r.mean_vector == pytest.approx(np.mean([v for k, v in rows if k == r.k], axis=0).tolist())


def test_embedding_pools_chunks_and_zeroes_failures(spark):
    def make():
        def embed(chunks):
            if any("bad" in c for c in chunks):
                raise RuntimeError("no service")
            return [[len(c), 1.0] for c in chunks]

        return embed

    texts = ["x" * 10, "y" * 1500, "", None, "z" * 900 + "bad", "q" * 700 + "r"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = em.embed_texts(df, "text", make, 2, normalize=False, spread_by="i").orderBy("i").collect()
    assert got[0].embedding == [10.0, 1.0] and got[0].n_chunks == 1
    assert got[1].embedding == pytest.approx([np.mean([800, 800, 100]), 1.0], abs=1e-3)
    assert got[2].embedding == got[3].embedding == [0.0, 0.0] and got[2].n_chunks == 0
    assert got[4].embedding == [0.0, 0.0] and got[4].embed_error == "no service"
    assert got[5].n_chunks == 2
    unit = em.embed_texts(df, "text", make, 2).where("i = 0").first().embedding
    assert np.linalg.norm(unit) == pytest.approx(1.0)


def test_hashing_embedder_counts_words_with_few_kept_places(monkeypatch):
    monkeypatch.setattr(em, "CACHED_WORDS", 2)
    text = "Alpha beta_GAMMA alpha 12 delta, beta"
    want = np.zeros(8)
    for token in ("alpha", "beta", "gamma", "alpha", "12", "delta", "beta"):
        digest = hashlib.md5(token.encode()).hexdigest()
        want[int(digest[:8], 16) % 8] += 1 if digest[8] < "8" else -1
    found = em.hashing_embedder(8)()([text, "", "..."])
    assert [list(x) for x in found] == [list(want), [0.0] * 8, [0.0] * 8]


def test_wrong_vector_width_is_an_error_row(spark):
    df = spark.createDataFrame([("a",)], "text string")
    row = em.embed_texts(df, "text", lambda: lambda chunks: [[1.0] for _ in chunks], 3).first()
    assert row.embedding == [0.0] * 3 and "expected 3" in row.embed_error


def test_embedding_calls_are_bounded_and_fail_alone(spark, tmp_path):
    """Long texts take several calls, short ones share them; a call is repeated, and a text that always fails does not harm its neighbours."""
    log = str(tmp_path / "calls")

    def make():
        tries = {}

        def embed(chunks):
            with open(log, "a") as f:
                f.write(f"{len(chunks)}\n")
            key = tuple(chunks)
            tries[key] = tries.get(key, 0) + 1
            if any("bad" in c for c in chunks) or ("once" in chunks[0] and tries[key] == 1):
                raise RuntimeError("refused")
            return [[float(len(c)), float(c.count("x"))] for c in chunks]

        return embed

    texts = ["x" * 9_500, "short", "bad " * 300, "", None, "once", "tail x"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").coalesce(1)
    found = em.embed_texts(df, "text", make, 2, normalize=False, calls=em.Calls(4, 2, 0.0)).orderBy("i").collect()
    assert [r.n_chunks for r in found] == [14, 1, 2, 0, 0, 1, 1]
    assert [bool(r.embed_error) for r in found] == [False, False, True, False, False, False, False]
    for r, text in zip(found, texts):
        chunks = [text[i : i + 800] for i in range(0, len(text), 700)] if text and "bad" not in text else []
        mean = np.mean([[len(c), c.count("x")] for c in chunks], axis=0) if chunks else [0, 0]
        assert r.embedding == pytest.approx(list(mean))
    assert max(int(n) for n in open(log)) == 4


def test_common_words_are_hashed_once(monkeypatch):
    hashed, md5 = [], em.hashlib.md5
    monkeypatch.setattr(em, "CACHED_WORDS", 8)
    monkeypatch.setattr(em.hashlib, "md5", lambda x: hashed.append(x) or md5(x))
    embed = em.hashing_embedder(16)()
    for i in range(60):
        embed([f"Common_a{i} b{i}", f"common c{i} É² \U00010400x 日本", ""])
    assert hashed.count(b"common") == 1
    assert {"é²".encode(), "\U00010428x".encode(), "日本".encode(), b"a7", b"c59"} <= set(hashed)
