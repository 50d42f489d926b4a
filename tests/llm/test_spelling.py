"""Spelling variants against all pairs of words, the query against a plain reading of its contract."""

import random
import re
import zlib
from collections import Counter

import pytest

from logloom.llm import spelling
from logloom.llm.catalog import QUERIES


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts):
    near = {w: [x for x in counts if abs(len(x) - len(w)) < 2 and one_edit(w, x)] for w in counts}
    best = {w: min(near[w], key=lambda x: (-counts[x], x)) if near[w] else None for w in counts}
    form = {w: b if b and counts[b] >= 2 * counts[w] else None for w, b in best.items()}
    out = []
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out)


def words_of(seed, n, alphabet, lengths):
    rng = random.Random(seed)
    words = {"".join(rng.choice(alphabet) for _ in range(rng.randint(*lengths))) for _ in range(n)}
    for w in sorted(words)[: n // 2]:
        for _ in range(3):
            i = rng.randrange(len(w))
            words.add(rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice(alphabet) + w[i:], w[:i] + rng.choice(alphabet) + w[i + 1 :]]))
    return {w: rng.choice([1, 1, 2, 4, 4, 8, 16, 100]) for w in words if w}


CASES = [
    (words_of(1, 300, "abcdeé÷×Ÿ"[:-1], (1, 7)), 8192, 60_000),
    (words_of(2, 300, "abc", (3, 6)), 20, 50),  # most blocks are sliced
    (words_of(3, 300, "abcdefghijklmnopqrstuvwxyzàéÀ", (4, 9)), 8192, 100),
    ({"a" * 70_000 + "b": 9, "a" * 70_000: 3, "c" + "a" * 69_999 + "b": 4, "b" * 70_001: 1}, 8192, 60_000),
    ({"alone": 5}, 8192, 60_000),
    ({}, 8192, 60_000),
]


@pytest.mark.parametrize("counts, block_words, task_words", CASES)
def test_variants_equal_those_of_all_pairs(spark, counts, block_words, task_words):
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    found = spelling.variants(words, block_words, task_words).collect()
    assert sorted(map(tuple, found)) == brute(counts)


def test_chains_are_followed_to_their_end(spark):
    """Each word is the form of the one before it, thirty in a row; many words hang on one root."""
    chain = {"x" * i: 3 * 2**i for i in range(5, 35)}
    star = {"root" * 3 + chr(97 + i): 3 for i in range(26)} | {"root" * 3: 1000}
    counts = chain | star
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    found = {r.word: r.root for r in spelling.variants(words).collect()}
    assert {found[w] for w in chain} == {"x" * 34} and {found[w] for w in star} == {"root" * 3}


def test_query_follows_its_contract(spark, tmp_path):
    rng = random.Random(5)
    stock = list(words_of(6, 60, "abcdefé", (4, 8)))
    texts = [" ".join(rng.choices(stock, k=rng.randint(1, 200))) for _ in range(150)]
    texts += [None, "", "12 !", "École ÉCOLE école x" * 40, "Hello,hello-HELLO" * 90, "z" * 200_000, *texts[:4]]
    docs = [(rng.choice([None, i, i, i]), t, "theirs", 1) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, word string, n int").write.parquet(f"{tmp_path}/documents.parquet")
    upper = {i: i + 32 for i in range(65, 91)}
    counts = Counter()
    for doc_id, text, *_ in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(upper)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= 5
    found = QUERIES["op11_spelling_variant_grouping"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found)) == brute({w: n for w, n in counts.items() if n >= 3})


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert QUERIES["op11_spelling_variant_grouping"](spark, str(tmp_path)).collect() == []
