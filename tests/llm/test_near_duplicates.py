"""N-gram join, components and decontamination against brute force."""

import random

import numpy as np
import pytest

from logloom.llm import decontaminate, ngram_join
from logloom.llm.components import components

VOCABULARY = [f"w{i}" for i in range(400)]


def sets_of(text, k):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute_components(texts, k, share, over):
    sets = [sets_of(t, k) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and over * len(a & b) >= share * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def corpus(seed):
    rng = random.Random(seed)
    texts = []
    base = [[rng.choice(VOCABULARY) for _ in range(rng.randint(3, 120))] for _ in range(25)]
    passage = [rng.choice(VOCABULARY) for _ in range(60)]
    for words in base:
        for _ in range(rng.randint(1, 4)):
            copy = list(words)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(VOCABULARY)
            texts.append(" ".join(copy))
        texts.append(" ".join(passage + words[:10]))
    hub = [rng.choice(VOCABULARY) for _ in range(80)]
    for _ in range(60):  # one large group of near copies
        copy = list(hub)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(80)] = rng.choice(VOCABULARY)
        texts.append(" ".join(copy))
    texts += ["", " \n\t", None, "one", "ONE", "one two", "one two three four", "x " * 3000, "x " * 3000 + "y", *texts[:7]]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("k, share, over", [(4, 85, 100), (5, 80, 100)])
def test_components_match_brute_force(spark, k, share, over):
    texts = corpus(k)
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id bigint, text string, node int, g int")
    roots, sizes = brute_components(texts, k, share, over)
    rows = ngram_join.component_ids(ngram_join.near_duplicates(docs.repartition(5), k, (share, over))).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == {i: (sizes[i], roots[i]) for i in range(len(texts))}


def test_last_round_finds_what_pivots_miss(spark, monkeypatch):
    texts = corpus(9)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    roots, _ = brute_components(texts, 4, 60, 100)
    for pairs, rounds, short in ((0, 2, 0), (10**9, 6, 3)):
        monkeypatch.setattr(ngram_join, "SHORT_LIST", short)
        monkeypatch.setattr(ngram_join, "PAIRS_PER_ENTRY", pairs)
        monkeypatch.setattr(ngram_join, "PIVOT_ROUNDS", rounds)
        rows = ngram_join.component_ids(ngram_join.near_duplicates(docs, 4, (60, 100))).collect()
        assert {r.doc_id: r.component_id for r in rows} == dict(enumerate(roots))


def test_one_of_each_keeps_rows_whole(spark):
    same = "a b c d e f g h"
    rows = [(5, same, 1), (3, same, 2), (3, same, 2), (None, same, 4), (8, None, 5), (8, None, 5), (9, "", 6), (None, "p q r s t u", 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, key int")
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(
        [(3, same, 2), (8, None, 5), (8, None, 5), (9, "", 6), (None, "p q r s t u", 7)], key=str
    )
    assert ngram_join.one_of_each(docs.limit(0)).count() == 0


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)] + [(7, 7), (201, 200), (200, 201)]
    found = components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    expected = {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 150)}, 200: 200, 201: 200}
    assert len(found) == len(expected) and {r.node: r.root for r in found} == expected
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def naive_tiles(a, b, least):
    used_a, used_b, found = set(), set(), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in used_a and j + n not in used_b:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return found
        found.append(best)
        used_a |= set(range(i, i + n))
        used_b |= set(range(j, j + n))


def test_tiles_match_the_plain_algorithm():
    rng = random.Random(11)
    for _ in range(150):
        letters = rng.choice([3, 6, 20])
        a = [rng.randrange(letters) for _ in range(rng.randint(0, 25))]
        b = [rng.randrange(letters) for _ in range(rng.randint(0, 40))]
        if a and rng.random() < 0.6:
            cut = rng.randrange(len(a))
            b = b[:10] + a[cut:] + b[10:20] + a[:cut] + b[20:]
        found = decontaminate.tiles(np.array(a, np.uint64), np.array(b, np.uint64), 4)
        expected = naive_tiles(a, b, 4)
        assert [t[0] for t in found] == [t[0] for t in expected]
        covered_a = [x for n, i, _ in found for x in range(i, i + n)]
        covered_b = [x for n, _, j in found for x in range(j, j + n)]
        assert len(set(covered_a)) == len(covered_a) and len(set(covered_b)) == len(covered_b)
        assert all(a[i : i + n] == b[j : j + n] for n, i, j in found)


def test_contaminated_documents(spark):
    rng = random.Random(2)
    item = [f"q{i}" for i in range(30)]
    filler = lambda n: [rng.choice(VOCABULARY) for _ in range(n)]
    docs = {
        1: " ".join(filler(50) + item + filler(50)),
        2: " ".join(filler(20) + item[15:] + filler(200) + item[:15]),  # turned around
        3: " ".join(filler(20) + [w.upper() + "," for w in item] + filler(20)),
        4: " ".join(filler(400)),
        5: " ".join(filler(30) + item[:7] + filler(30)),  # too little of it
        6: "", 7: None, 8: " ".join(filler(60_000) + item), 9: "short item",
    }
    rows = [(i, t, "x") for i, t in docs.items()] + [(1, docs[1], "y"), (None, docs[1], "z")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, item string")
    items = spark.createDataFrame(
        [(70, " ".join(item)), (71, " ".join(item)), (72, None), (73, "short item"), (None, " ".join(f"z{i}" for i in range(20)))],
        "item_id bigint, text string",
    )
    found = decontaminate.document_coverage(table, items).collect()
    assert len(found) == len(rows)
    assert {r.doc_id for r in found if r.contaminated} == {1, 2, 3, 8, None}
    assert all((r.item_id, r.n_items, r.coverage) == (70, 1, 1.0) for r in found if r.contaminated)
    kept = decontaminate.without_benchmark(table, items)
    assert kept.columns == table.columns and sorted(r.doc_id for r in kept.collect()) == [4, 5, 6, 7, 9]
    assert decontaminate.without_benchmark(table, items.limit(0)).count() == len(rows)
    assert decontaminate.document_coverage(table.limit(0), items).count() == 0
