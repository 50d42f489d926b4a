"""Merkle proofs against a plain tree, near duplicates by cover trees against all pairs."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.llm import cover_tree, merkle
from logloom.llm.catalog import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, idx long"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_proofs(trees, fanout=16):
    """{(tree, place): (subroot, siblings, steps)} and the root."""

    def climb(digests):
        levels = []
        while len(digests) > 1:
            levels.append(digests)
            digests = [sha(*digests[i : i + fanout]) for i in range(0, len(digests), fanout)]
        return levels, digests[0]

    def steps(levels, i):
        out = []
        for level in levels:
            start = i - i % fanout
            run = level[start : start + fanout]
            out.append((i % fanout, run[: i % fanout] + run[i % fanout + 1 :]))
            i //= fanout
        return out

    climbed = [climb(t) for t in trees]
    upper, root = climb([top for _, top in climbed])
    found = {}
    for t, (levels, top) in enumerate(climbed):
        for i in range(len(trees[t])):
            found[t, i] = (top, steps(levels, i) + steps(upper, t))
    return found, root


def refold(digest, steps):
    for place, others in steps:
        digest = sha(*others[:place], digest, *others[place:])
    return digest


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def corpus(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choice([None, "", "a", "b", "ß", "z"]) if rng.random() < 0.6 else "hot"
        text = rng.choice([None, "", "ÄÖ Word " * rng.randint(1, 40), "Word", "x" * rng.randint(1, 9)])
        rows.append((rng.choice([None, i, i, i]), text, rng.choice([None, "en"]), source, rng.choice([None, 7, i]), "theirs", i))
    return rows + rows[:5]


@pytest.mark.parametrize("n, slice_leaves", [(0, 8), (1, 8), (40, 7), (900, 50), (900, 4096)])
def test_proofs_equal_those_of_a_plain_tree(spark, tmp_path, monkeypatch, n, slice_leaves):
    rows = corpus(n, n)[: n + 5 if n > 1 else n]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(merkle.manifest, "__defaults__", (slice_leaves,))
    found = QUERIES["op12_merkle_manifest"](spark, str(tmp_path)).collect()
    assert len(found) == len(rows)
    leaf = [sha(*map(field, (r[0], r[3], r[2], r[4], r[1]))) for r in rows]
    lower = [None if r[1] is None else "".join(c.lower() if c.isascii() else c for c in r[1]) for r in rows]
    claimed = [
        sha(*map(field, (r[0], r[3], r[2], r[4], low))) if zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 5 == 0 else x
        for r, low, x in zip(rows, lower, leaf)
    ]
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = [
        sorted((i for i, r in enumerate(rows) if r[3] == s), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, leaf[i]))
        for s in sources
    ]
    if not rows:
        return
    proofs, root = plain_proofs([[leaf[i] for i in t] for t in trees])
    expected = []
    for t, members in enumerate(trees):
        for place, i in enumerate(members):
            top, steps = proofs[t, place]
            digest = sha(*[s for _, others in steps for s in others])
            folded = refold(claimed[i], steps)
            expected.append((rows[i][0], leaf[i], top, root, digest, folded, folded == root))
    key = lambda r: tuple(map(str, r))
    got = [(r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in found]
    assert sorted(got, key=key) == sorted(expected, key=key)


def test_a_slice_fetches_only_what_it_cannot_derive(spark):
    rows = spark.range(1000).select(F.lit("g").alias("group"), F.col("id").alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"))
    found = merkle.manifest(rows, slice_leaves=100)
    lacking = merkle.lacking(found).collect()
    assert len(lacking) == len(set(lacking))
    for s in range(10):
        wanted = {(r.level, r.idx) for r in lacking if r.slice == s}
        lo, hi, n, least = s * 100, s * 100 + 99, 1000, set()
        level = 0
        while n > 1:
            least |= {(level, i) for i in [*range(lo - lo % 16, lo), *range(hi + 1, min(n, hi - hi % 16 + 16))]}
            lo, hi, n, level = lo // 16, hi // 16, -(-n // 16), level + 1
        assert wanted == least


def vectors_of(seed, width):
    rng = np.random.default_rng(seed)
    spread = rng.standard_normal((150, width))
    near = [c + 0.05 * rng.standard_normal((rng.integers(1, 12), width)) for c in spread[:30]]
    edge = [c + 0.32 * rng.standard_normal((8, width)) / math.sqrt(width) * np.linalg.norm(c) for c in spread[30:50]]
    hub = spread[50] + 0.01 * rng.standard_normal((200, width))  # a large group within one node
    chain = np.array([np.cos(i / 8) * spread[51] + np.sin(i / 8) * spread[52] for i in range(20)])
    copies = np.repeat(spread[60:61], 40, axis=0)
    return np.concatenate([spread, *near, *edge, hub, chain, copies, 3 * spread[:5], -spread[:5]]).astype(np.float32)


def brute(vectors, similarity):
    x = vectors.astype(np.float64)
    cosine = (x @ x.T) / np.outer(*[np.sqrt((x * x).sum(1))] * 2)
    near = cosine >= similarity
    np.fill_diagonal(near, False)
    root = list(range(len(x)))
    changed = True
    while changed:
        low = [min(root[i], *(root[j] for j in np.flatnonzero(near[i]))) if near[i].any() else root[i] for i in range(len(x))]
        changed, root = low != root, low
    return near.sum(1).tolist(), root


@pytest.mark.parametrize("width, block_bytes, similarity", [(16, 2 << 20, 0.95), (16, 8000, 0.95), (3, 2000, 0.99), (40, 30000, 0.5)])
def test_links_equal_those_of_all_pairs(spark, width, block_bytes, similarity):
    vectors = vectors_of(width, width)
    n, root = brute(vectors, similarity)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    random.Random(1).shuffle(rows)
    found = cover_tree.near_duplicates(spark.createDataFrame(rows, "vec_id long, vec array<float>"), similarity, block_bytes).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in found} == {i: (n[i], root[i]) for i in range(len(vectors))}


def test_trees_are_stored_once_and_not_copied_for_their_pairs(spark, monkeypatch):
    """Plans of all steps over vectors of which no block rules out another; rounds of a tree or two give the same."""
    x = np.random.default_rng(11).standard_normal((600, 12)).astype(np.float32)
    x[300:400] = x[:100] + 0.01
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    vectors = spark.createDataFrame(rows, "node long, vec array<float>").select(
        "node", F.lit(1).cast("long").alias("n"), "vec", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(1), "vec").alias("h2")
    )
    plans, trees, cut = [], [], cover_tree.cut_lineage

    def recorded(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        out = cut(df)
        trees.extend([out.count()] * ("tree" in out.columns))
        return out

    monkeypatch.setattr(cover_tree, "cut_lineage", recorded)
    classes = cut(vectors)
    found = cover_tree.linked(classes, 0.95, block_bytes=6000)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert trees[0] > 8
    assert not [p for p in plans if "Exchange" in p and any("FileScan" in line and "tree" in line for line in p.splitlines())]
    n_plans = len(plans)
    again = cover_tree.linked(classes, 0.95, block_bytes=6000, round_bytes=1)
    assert len(plans) - n_plans > trees[0]
    expected = {i: n for i, n in enumerate(brute(x, 0.95)[0]) if n}
    for df in (found, again):
        assert {r.node: r.n for r in df.groupBy("node").agg(F.sum("links").alias("n")).collect()} == expected


def test_every_pair_of_places_is_searched_once():
    for n in (1, 2, 3, 8, 9):
        own = [[cover_tree._own_pair(p, q, n) for p in range(n)] for q in range(n)]
        assert all(own[q][p] + own[p][q] == (2 if p == q else 1) for p in range(n) for q in range(n))
        assert max(map(sum, own)) - min(map(sum, own)) <= 1


def test_nodes_hold_their_invariants():
    vectors = vectors_of(7, 8).astype(np.float64)
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    limit = math.sqrt(0.1)
    order, levels = cover_tree.build_tree(unit, limit)
    assert sorted(order) == list(range(len(unit)))
    x = unit[order]
    for level, radius in zip(levels, [2.0, *cover_tree.radii(limit), 0.0]):
        assert (level["end"][:-1] == level["start"][1:]).all() and level["end"][-1] == len(x)
        for s, e, r in zip(level["start"], level["end"], level["radius"]):
            far = np.linalg.norm(x[s:e] - x[s], axis=1).max()
            assert far <= r + 1e-7 and r <= radius + 1e-7
    for upper, lower in zip(levels, levels[1:]):  # centres stay centres
        assert set(upper["start"]) <= set(lower["start"])


def test_large_groups_are_not_spelt_out():
    unit = np.eye(1, 8) + 1e-3 * np.random.default_rng(1).standard_normal((3000, 8))
    tree = cover_tree.Tree.build(np.arange(3000), np.ones(3000, np.int64), unit, math.sqrt(0.1))
    node, links, root = cover_tree.traverse(tree, tree, 0.95)
    assert len(node) == 3000 and (links == 2999).all() and (root == 0).all()


def test_vectors_without_a_direction_and_other_edges(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [
        (5, None), (4, [0.0, 0.0]), (3, [nan, 1.0]), (2, [inf, 1.0]), (1, [None, 1.0]), (0, []),
        (9, [1.0, 0.0]), (8, [1.0, 0.0]), (8, [2.0, 0.0]), (None, [1.0, 0.01]), (7, [1.0, 0.0, 0.0]), (6, [1e-30, 0.0]), (10, [3e38, 3e38]),
    ]
    schema = "vec_id long, embedding array<float>, label int, node long, cell long, n_links string"
    spark.createDataFrame([(*r, 0, 1, 2, "x") for r in rows], schema).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = QUERIES["op13_embedding_near_dedup"](spark, str(tmp_path)).collect()
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in found), key=str)
    expected = [
        *((i, 0, i, True) for i in (0, 1, 2, 3, 4, 5, 7, 10)),
        (9, 4, 6, False), (8, 4, 6, False), (8, 4, 6, False), (None, 4, 6, False), (6, 4, 6, True),
    ]
    assert got == sorted(expected, key=str)
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert QUERIES["op13_embedding_near_dedup"](spark, f"{tmp_path}/none").collect() == []
