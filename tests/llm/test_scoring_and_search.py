"""Language model, neighbours, licenses and page texts against brute force."""

import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logloom.llm import collision_search, hash_arrays, licenses, ngram_model, site_tree

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
TEXTS = ["the cat sat", "The cat ran\n", "", None, "a a a a b", "the the the cat", "x" * 3000, "the cat sat", " \t", "é ü the"]


def plain_model(texts):
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) + [None] for t in texts]
    single = collections.Counter(w for t in tokens for w in t)
    pairs = collections.Counter(p for t in tokens for p in zip([0, *t], t))
    context, left = collections.defaultdict(lambda: [0, 0, 0, 0]), collections.Counter()
    for (u, w), n in pairs.items():
        context[u][0] += n
        context[u][min(n, 3)] += 1
        left[w] += 1

    def found(values):
        return ngram_model.discounts([sum(v == k for v in values) for k in (1, 2, 3, 4)])

    d, e = found(pairs.values()), found(left.values())

    def less(n, cut):
        return n - cut[min(n, 3) - 1] if n else 0.0

    share = sum(e[min(n, 3) - 1] for n in left.values()) / len(pairs) if pairs else 1.0

    def probability(u, w):
        alone = less(left[w], e) / max(1, len(pairs)) + share / (len(single) + 1)
        if u not in context:
            return alone
        total, *kinds = context[u]
        return (less(pairs[u, w], d) + sum(x * n for x, n in zip(d, kinds)) * alone) / total

    return single, probability


@pytest.mark.parametrize("trained", [TEXTS, TEXTS[:2], []])
def test_scores_match_the_plain_model(spark, trained):
    rng = random.Random(4)
    more = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 60))) for _ in range(30)] if trained else []
    single, probability = plain_model([*trained, *more])
    model = ngram_model.train(spark.createDataFrame([(t,) for t in [*trained, *more]], "text string").repartition(3))
    texts = [*TEXTS, *more, "unseen words", "the unseen cat"]
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id bigint, text string, score string")
    rows = ngram_model.score(docs, model).collect()
    n, v = sum(single.values()), len(single)
    assert len(rows) == len(texts)
    for r in rows:
        tokens = re.findall(r"[^\x20\x09-\x0D]+", (texts[r.doc_id] or "").translate(LOWER)) + [None]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(single[w] > 0 for w in tokens), n)
        assert math.isclose(r.base_score, sum(math.log10((single[w] + 1) / (n + v + 1)) for w in tokens), abs_tol=1e-9)
        expected = sum(math.log10(probability(u, w)) for u, w in zip([0, *tokens], tokens))
        assert math.isclose(r.score, expected, rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(r.perplexity, 10 ** (-expected / len(tokens)), rel_tol=1e-6)
    if trained:
        for u in ("the", 0, "never"):
            assert math.isclose(sum(probability(u, w) for w in [*single, "never"]), 1.0)
    assert ngram_model.score(docs.limit(0), model).count() == 0


def plain_triples(texts):
    """Probability of a word after two others, by the definition."""
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) + [None] for t in texts]
    triples = collections.Counter(p for t in tokens for p in zip([0, 0, *t], [0, *t], t))
    pairs = collections.Counter((v, w) for _, v, w in triples)
    single = collections.Counter(w for _, w in pairs)
    words = {w for t in tokens for w in t}

    def level(counts, lower):
        d = ngram_model.discounts([sum(v == k for v in counts.values()) for k in (1, 2, 3, 4)])
        total, rest = collections.Counter(), collections.Counter()
        for gram, n in counts.items():
            total[gram[:-1]] += n
            rest[gram[:-1]] += d[min(n, 3) - 1]

        def probability(gram):
            context, n = gram[:-1], counts.get(gram, 0)
            if not total[context]:
                return lower(gram[1:])
            return ((n - d[min(n, 3) - 1] if n else 0) + rest[context] * lower(gram[1:])) / total[context]
        return probability

    return words, level(triples, level(pairs, level({(w,): n for w, n in single.items()}, lambda _: 1 / (len(words) + 1))))


def test_triples_match_the_plain_model(spark):
    rng = random.Random(5)
    texts = [*TEXTS, *(" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 60))) for _ in range(30))]
    words, probability = plain_triples(texts)
    model = ngram_model.train(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), order=3)
    asked = [*texts, "unseen words", "the unseen cat sat", "a b unseen a b"]
    docs = spark.createDataFrame(list(enumerate(asked)), "doc_id bigint, text string")
    for r in ngram_model.score(docs, model).collect():
        t = re.findall(r"[^\x20\x09-\x0D]+", (asked[r.doc_id] or "").translate(LOWER)) + [None]
        expected = sum(math.log10(probability(g)) for g in zip([0, 0, *t], [0, *t], t))
        assert math.isclose(r.score, expected, rel_tol=1e-9, abs_tol=1e-9)
    for context in ((0, 0), ("a", "b"), ("the", "never")):
        assert math.isclose(sum(probability((*context, w)) for w in [*words, "never"]), 1.0)
    empty = ngram_model.train(docs.limit(0), order=3)
    assert ngram_model.score(docs, empty).count() == len(asked)


def test_planes_and_sorted_files(spark, tmp_path):
    rng = np.random.default_rng(2)
    for values in (np.empty(0, np.uint64), np.zeros(3, np.uint64), rng.integers(0, 2**63, 50).astype(np.uint64)):
        assert hash_arrays.unpack_planes(hash_arrays.pack_planes(values))[0].tolist() == values.tolist()
        ordered = np.sort(values)
        assert hash_arrays.unpack_sorted(hash_arrays.pack_sorted(ordered))[0].tolist() == ordered.tolist()
    keys = rng.integers(-(2**63), 2**63, 500)
    table = spark.createDataFrame([(int(k),) for k in [*keys, *keys[:9]]] + [(None,)], "key bigint")
    files = hash_arrays.hash_set(table, str(tmp_path), 4)
    other = rng.integers(-(2**63), 2**63, 100)
    asked = np.concatenate([keys[::3], other]).view(np.uint64)
    assert files.contains(asked).tolist() == [True] * len(keys[::3]) + [False] * 100
    empty = hash_arrays.hash_set(table.limit(0), str(tmp_path), 4)
    assert not empty.contains(asked).any()


def exact_neighbours(ids, vectors, queries, k):
    found = {}
    for q in queries:
        score = (vectors * vectors[q]).sum(axis=1)
        score[q] = -np.inf
        found[int(ids[q])] = [(int(ids[i]), score[i]) for i in np.lexsort((ids, -score))[:k] if score[i] > -np.inf]
    return found


def test_counts_take_a_byte(tmp_path):
    """Arrays of mostly small numbers, whatever the others' size, in one byte each."""
    values = np.random.default_rng(1).integers(0, 9, 10_003).astype(np.uint64)
    values[[0, 77, 4_000, 10_002]] = [255, (1 << 40) + 3, 256, 254]
    stored = hash_arrays.NarrowArray(str(tmp_path), hash_arrays.write_narrow(str(tmp_path), "counts", values))
    at = np.random.default_rng(2).permutation(np.arange(len(values)))
    assert len(stored) == len(values) and (stored[at] == values[at]).all()
    assert (stored[np.array([[0, 1], [77, 4_000]])] == values[[[0, 1], [77, 4_000]]]).all()
    assert sum(f.stat().st_size for f in tmp_path.iterdir()) < 1.05 * len(values)
    empty = hash_arrays.NarrowArray(str(tmp_path), hash_arrays.write_narrow(str(tmp_path), "none", values[:0]))
    assert len(empty) == 0 and len(empty[np.empty(0, np.int64)]) == 0


def test_recall_of_the_search(spark):
    rng = np.random.default_rng(8)
    n = 3000
    vectors = rng.normal(size=(n, 24)) * rng.uniform(0.2, 3, size=(n, 1))
    vectors[100:1100] = vectors[100]  # a third is one vector
    ids = rng.permutation(n) + 5
    table = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, vectors)], "vec_id bigint, vec array<double>")
    asked = np.flatnonzero(ids % 20 == 0)
    queries = table.where("vec_id % 20 = 0").selectExpr("vec_id AS query_id", "vec AS query_vec")
    rows = collision_search.search(table, queries, k=10, block_rows=500).collect()
    expected = exact_neighbours(ids, vectors, asked, 10)
    by: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: r.rank):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert by.keys() == expected.keys() and all(len(v) == 10 for v in by.values())
    hits = sum(len({a for a, _ in by[q]} & {a for a, _ in expected[q]}) for q in by)
    assert hits >= 0.9 * 10 * len(by)
    place = {int(i): v for i, v in zip(ids, vectors)}
    for q, near in by.items():
        assert near == sorted(near, key=lambda x: (-x[1], x[0]))
        assert all(math.isclose(s, float((place[q] * place[a]).sum()), rel_tol=1e-12) for a, s in near)
    hot = [q for q in by if np.array_equal(place[q], vectors[100])]
    for q in hot:  # ties of equal vectors go to the smaller ids
        assert [a for a, _ in by[q]] == [a for a, _ in expected[q]]


def test_work_of_a_search_without_structure(monkeypatch):
    """Vectors that no window tells apart: queries begin at the width that others have needed instead of widening six times."""
    rng = np.random.default_rng(3)
    n = 3000
    vectors = rng.normal(size=(n, 64))
    vectors /= np.sqrt((vectors**2).sum(axis=1))[:, None]
    block = collision_search._Block.__new__(collision_search._Block)
    norms = np.sqrt((vectors**2).sum(axis=1))
    raised = np.c_[vectors, np.sqrt(np.maximum(0, norms.max() ** 2 - norms**2))]
    projected = (raised @ collision_search._projections(collision_search.PROJECTIONS, 65)).T
    block.unique, block.radius, block.ids, block.first = vectors, float(norms.max()), np.arange(n), np.arange(n + 1)
    block.ranked = np.argsort(projected, axis=1, kind="stable")
    block.projected = np.take_along_axis(projected, block.ranked, axis=1)
    counted, bincount = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda x, *a, **b: counted.append(len(x)) or bincount(x, *a, **b))
    asked = np.arange(0, n, 10)
    found, scores = block.search(asked, vectors[asked], 20)
    assert len(counted) < 4 * len(asked)
    assert sum(counted) < 0.7 * n * collision_search.PROJECTIONS * len(asked)
    expected = exact_neighbours(np.arange(n), vectors, asked, 20)
    hits = sum(len(set(a.tolist()) & {i for i, _ in expected[int(q)]}) for q, a in zip(asked, found))
    assert hits >= 0.95 * 20 * len(asked)
    assert all(s == (vectors[q] * vectors[i]).sum() for q, a, b in zip(asked, found, scores) for i, s in zip(a, b))


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (20, [2.0, 1.0]),
        (40, [1.0]), (60, [-1.0, 0.0]), (None, [9.0, 9.0]), (20, [3.0, 1.0]), (80, [0.0, 0.0]), (7, [1.0]),
    ]
    table = spark.createDataFrame(rows, "vec_id bigint, vec array<float>")
    queries = table.where("vec_id % 20 = 0").selectExpr("vec_id AS query_id", "vec AS query_vec")
    found = {(r.query_id, r.rank): (r.vec_id, r.score) for r in collision_search.search(table, queries, k=5).collect()}
    assert found == {
        (0, 1): (20, 2.0), (0, 2): (60, -1.0), (20, 1): (0, 2.0), (20, 2): (60, -2.0), (40, 1): (7, 1.0),
        (60, 1): (0, -1.0), (60, 2): (20, -2.0),
    }
    assert collision_search.search(table.limit(0), queries).count() == 0
    assert collision_search.search(table, queries.limit(0)).count() == 0


def test_license_phrases_and_notices(spark):
    texts = [
        "CC-BY cc by, All Rights\nReserved.", "general public license general public", None, "", "cc  by" * 3, "x " * 50_000 + "cc by",
        "Permission is hereby granted, free of charge, to any fine person obtaining a copy of this software and documentation files",
        "Licensed under the GNU General Public License, version 3.", "This work is licensed under CC BY-NC 4.0", "all rights not reserved",
        "released under the MIT License. Released under the mit license", "le mit license", "cc byé", "general public" * 2,
    ]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "cc by", 2)], "doc_id bigint, text string, row int")
    rows = {r.doc_id: r for r in licenses.scan(docs.repartition(3)).collect()}
    assert len(rows) == len(texts) + 1
    for i, text in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        at = [(k, label) for p, label in licenses.PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = rows[i]
        assert (r.n_words, r.n_base) == (len(w), len(at))
        assert (r.first_word, r.last_word) == (min((k for k, _ in at), default=None), max((k for k, _ in at), default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in at}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    labels = {i: rows[i].labels for i in rows}
    assert labels[6] == "mit" and labels[7] == "gpl,gpl-3.0" and labels[8] == "cc-by,cc-by-nc-4.0" and labels[10] == "mit"
    assert labels[9] == labels[11] == labels[12] == "" and rows[None].labels == "cc-by"
    assert sum(s.label == "mit" for s in rows[10].spans) == 2
    assert licenses.scan(docs.limit(0)).count() == 0


def test_one_word_put_into_a_notice(spark):
    # before the first pair that neither holds a version nor a name with relatives
    at = {"licensed under cc by nc 4 0": [1, 2], "licensed under the gnu general public license version 3": [1, 2, 3, 5, 6, 7]}
    at["licensed under the gnu general public license version 2"] = at["licensed under the gnu general public license version 3"]
    at["licensed under the apache license version 2 0"] = [1, 2, 3, 4, 5, 6]
    texts = [
        (" ".join([*w[:k], "fine", *w[k:]]), label)
        for notice, label in licenses.NOTICES for w in [notice.split()] for k in at.get(notice, range(1, len(w)))
    ]
    texts += [("Licensed under the Apache Software License, Version 2.0", "apache-2.0")]
    others = [
        "licensed under the GNU Lesser General Public License version 3", "licensed under CC BY-NC-SA 4.0",
        "licensed under the apache license version 2 1", "licensed under the GNU general public license version 4",
        "released under the bsd license",
    ]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*(t for t, _ in texts), *others])], "doc_id bigint, text string")
    rows = {r.doc_id: set(r.labels.split(",")) for r in licenses.scan(docs).collect()}
    assert [t for i, (t, label) in enumerate(texts) if label not in rows[i]] == []
    named = {label for _, label in licenses.NOTICES}
    assert [rows[len(texts) + i] & named for i in range(len(others))] == [set()] * len(others)


ARTICLE = "<article><header><h1>Head &amp; line</h1></header><p><b>One<br>two.<p>Three\n  four<aside>no</aside></p>{}</article>"
FRAME = (
    "<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a='</p><article>';</script></head><body class='has-sidebar'>"
    "<header><p>Site</p></header><nav><ul><li><a href='/'>x</a><li>y</ul></nav>{}<div class='ad-box'>Buy</div>"
    "<section id=comments><p>First!</p></section><footer>&copy; end</footer></body></html>"
)


def page_text(spark, pages):
    table = spark.createDataFrame([(i, u, h, "old") for i, (u, h) in enumerate(pages)], "page_id bigint, url string, html string, text string")
    rows = {r.page_id: r.text for r in site_tree.main_text(table.repartition(2)).collect()}
    assert len(rows) == len(pages)
    return [rows[i] for i in range(len(pages))]


def test_article_of_a_page(spark):
    pages = [
        ("http://a.b/1", FRAME.format(ARTICLE.format(""))),
        ("http://a.b/2", FRAME.format(ARTICLE.format("<div class='share'>Share</div><form>mail</form><!-- x --><p>Last &lt;5")))[:]
        , ("http://a.b/3", FRAME.format(ARTICLE.format("")).split("</article>")[0]),  # cut off
        (None, None), ("not a url", ""), ("http://c/", "plain &eacute; text <b>bold</b>"),
        ("http://c/x", "<main><p>in main</p><nav>n</nav></main><p>out</p>"),
        ("http://c/y", "<div><article class=comment>c</article><article><p>real article text</article></div>"),
        ("http://c/z", "<p>a < b and <i>c</i>d</p><p hidden>h</p>" + "<div>" * 300 + "deep"),
    ]
    head = "Head & line\nOne two.\nThree four"
    assert page_text(spark, pages) == [
        head, head + "\nLast <5", head, "", "", "plain é text bold", "in main", "real article text", "a < b and cd\ndeep",
    ]


def test_template_branches_of_a_site_without_article_marks(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    pages, expected = [], []
    for i in range(30):
        body = [" ".join(word() for _ in range(12)) for _ in range(3)]
        pages.append(
            (f"https://Site.example:80/{i}", "<body><div class='top'><span>Welcome to the site</span></div><div class='text'>"
             + "".join(f"<p>{b}</p>" for b in body) + "</div><div class='low'><p>Legal text of the site</p></div></body>")
        )
        expected.append("\n".join(body))
    assert page_text(spark, pages) == expected
    assert site_tree.main_text(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


@pytest.mark.parametrize("inside, expected", [
    ("one <svg class='i' /> two", "one\ntwo"), ("one <svg><svg><text>no</text></svg>no</svg> two", "one\ntwo"),
    ("one <svg> two", "one\ntwo"), ("one <template/> two", "one\ntwo"), ("one <object data='x'/> two", "one two"),
    ("one <template>no<template>no</template>no</template> two", "one\ntwo"), ("one <iframe src='x'> two", "one\ntwo"),
    ("one <object data='x'><object>two</object> three</object> four", "one two three four"), ("one <math/> two", "one two"),
    ("so <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation encoding='tex'>no</annotation></math> holds", "so x=1 holds"),
    ("one <script>no", "one"), ("one <script>'<svg>'</script><svg>no</svg> two", "one\ntwo"),
])
def test_elements_that_are_skipped_end_where_they_close(inside, expected):
    assert site_tree.Page(f"<body><article><p>{inside}</p></article></body>").text(frozenset()) == expected


def test_fixed_frame_around_different_texts_stays(spark):
    rng = random.Random(16)
    line = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(9))
    tags = ["h1", "p", "h2", "p", "h3", "p", "ul", "p", "h4", "p", "h5", "p", "pre", "p"]
    pages, expected = [], []
    for i in range(6):
        texts = [line() for _ in tags]
        pages.append((f"http://fixed/{i}", "<body>" + "".join(f"<{t}>{x}</{t}>" for t, x in zip(tags, texts)) + "<div class='low'>Same</div></body>"))
        expected.append("\n".join(texts))
    # text beside fixed elements
    for i in range(6):
        text = line()
        pages.append((f"http://beside/{i}", f"<body>{text}" + "".join(f"<{t}></{t}>" for t in tags) + "</body>"))
        expected.append(text)
    assert page_text(spark, pages) == expected


def test_copies_of_a_page_do_not_empty_a_host(spark):
    rng = random.Random(17)
    line = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(9))
    frame = "<body><div class='a'><h1>{}</h1></div><p>{}</p><ul><li>{}</ul><div class='low'>Same</div></body>"
    texts = [[line() for _ in range(3)] for _ in range(40)]
    pages = [(f"http://copies/{i}", frame.format(*texts[min(i, 39)])) for i in range(100)]
    expected = ["\n".join(texts[min(i, 39)]) for i in range(100)]
    equal = [("http://equal/x", "<body><p>One text</p><p>One text</p></body>")] * 4
    assert page_text(spark, pages + equal) == expected + ["One text\nOne text"] * 4


def test_page_of_many_open_tags_is_read_in_time(spark):
    text = page_text(spark, [("http://a/", "<article><p>" + "<b" * 5000 + " x='" * 2000 + "<p>end")])
    assert len(text) == 1


def test_hosts():
    assert [site_tree.host_of(u) for u in ("HTTP://u@A.b:1/x?y", "a.b/c", None, "")] == ["a.b:1", "", "", ""]


def test_count_blocks_are_tighter_than_what_the_shuffle_makes_of_them():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 40, 20_000).astype(np.uint64))
    counts = np.minimum(rng.zipf(2.0, len(keys)), 1 << 40).astype(np.int64)
    batch = hash_arrays.count_blocks(keys, counts, np.zeros(len(keys), np.int64))
    (block,) = batch.column(1).to_pylist()
    plain = hash_arrays.pack_sorted(keys) + hash_arrays.pack_planes(counts)
    assert len(block) < len(pa.compress(plain, codec="lz4", asbytes=True))
    found = hash_arrays.read_counts(block)
    assert (found[0] == keys).all() and (found[1].astype(np.int64) == counts).all()
    assert hash_arrays.unsqueeze(hash_arrays.squeeze(b"")) == b""


def test_collisions_are_counted_without_lists_of_places(monkeypatch):
    rng = np.random.default_rng(5)
    n, p = 700, collision_search.PROJECTIONS
    block = collision_search._Block.__new__(collision_search._Block)
    block.unique = np.zeros((n, 2))
    block.ranked = np.argsort(rng.normal(size=(p, n)), axis=1)
    low, high = np.sort(rng.integers(0, n + 1, (2, p)), axis=0)
    low[:3], high[:3] = (0, n, 5), (n, n, 5)  # a whole window and two empty ones
    expected = np.bincount(np.concatenate([r[a:b] for r, a, b in zip(block.ranked, low, high)]), minlength=n)

    def listed(*args, **kwargs):
        raise AssertionError("places were listed")

    monkeypatch.setattr(np, "bincount", listed)
    assert block._collisions(low, high).tolist() == expected.tolist()
