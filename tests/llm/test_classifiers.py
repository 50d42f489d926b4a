"""Language ID and toxicity: held-out accuracy, exactness of the parts, unusual rows."""

import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row, functions as F

from logloom.llm import language, toxicity, worker_memory
from logloom.llm.samples import narrow, remainder, smallest_keys, text_sample

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").cache()


@pytest.fixture(scope="module")
def field(docs):
    return language.train(docs, per_language=60)


def test_held_out_languages(docs, field):
    found = language.predict(docs, field).where(remainder(4) == 2).collect()
    assert len(found) > 200
    assert np.mean([r.lang_pred == r.lang for r in found]) >= 0.98
    assert all(0 <= r.score <= 1 for r in found)


def test_marginals_are_those_of_all_labelings(field):
    rng = np.random.default_rng(1)
    n = len(field.languages)
    scores = rng.normal(size=(9, n)).astype(np.float32)
    lengths = np.array([4, 0, 5])
    found = field.marginals(scores, lengths)
    assert np.allclose(found.sum(axis=1), 1, atol=1e-5)
    for begin, length in ((0, 4), (4, 5)):
        total = np.zeros((length, n))
        for labels in np.ndindex(*[n] * length):
            weight = np.exp(
                sum(scores[begin + i, k] for i, k in enumerate(labels))
                + sum(field.transitions[x, y] for x, y in zip(labels, labels[1:]))
            )
            for i, k in enumerate(labels):
                total[i, k] += weight
        assert np.allclose(total / total.sum(axis=1, keepdims=True), found[begin : begin + length], atol=1e-4)


def test_words_of_switched_text_get_their_language(docs, field):
    texts = {r.lang: r.text for r in docs.where((remainder(4) == 2) & (F.length("text") > 500)).collect()}
    names = sorted(texts)[:2]
    parts = [" ".join(texts[n].split()[:40]) for n in names]
    mixed = " ".join(parts)
    (_, data, start, end, first), *_ = language.words.parts(pa.array([mixed]), language.words.LETTERS)
    scores = field.emissions(data, start, end, language.words.word_hashes(data, start, end))
    best = field.marginals(scores, np.diff(first)).argmax(axis=1)
    switch = int(np.searchsorted(start, len(parts[0].encode())))
    for name, half in zip(names, (best[:switch], best[switch:])):
        assert np.mean(half == field.languages.index(name)) > 0.8


ROWS = [
    (1, None, "en", 1), (2, "", None, 2), (3, "12 +% \n", "en", 3), (None, "the and of", None, 4), (5, "日本", "en", 5),
    (6, "the " * 40_000, "en", 6), (7, "le de la", "fr", 7), (7, "le de la", "fr", 7), (8, "é", None, 8),
]


def test_unusual_texts_have_a_language_or_none(spark, field):
    table = spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string, _letters int")
    found = language.predict(table, field)
    assert found.columns == [*table.columns, "lang_pred", "score"]
    rows = found.collect()
    assert sorted(str(r[:4]) for r in rows) == sorted(str(r) for r in ROWS)
    assert {r._letters for r in rows if r.lang_pred == "und"} == {1, 2, 3}
    assert all(r.score == 0 for r in rows if r.lang_pred == "und")
    assert language.predict(table.limit(0), field).count() == 0
    assert {r.lang_pred for r in language.predict(table, None).collect()} == {"und"}
    assert language.train(table.limit(0)) is None
    assert language.train(table.where("text = '' OR text IS NULL")) is None
    small = language.train(table, per_language=2)
    assert language.predict(table, small).count() == len(ROWS)


@pytest.fixture(scope="module")
def examples(spark, docs):
    return toxicity.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))


def test_held_out_toxicity(spark):
    # the smaller tables have too few toxic rows to measure on
    larger = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{larger}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    held_out = docs.where(remainder(5) == 0).join(labels, "doc_id")
    found = toxicity.predict(held_out, model).collect()
    toxic = [r for r in found if r.toxic == 1]
    clean = [r for r in found if r.toxic == 0]
    assert len(toxic) > 80 and len(clean) > 600
    assert np.mean([r.predicted for r in clean]) <= 0.01
    assert np.mean([r.predicted for r in toxic]) >= 0.88
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and len(r.evidence) == toxicity.NEIGHBOURS for r in found)


def test_neighbours_by_blocks_are_exact(docs, examples):
    column = pa.array([r.text for r in docs.limit(150).collect()] + ["", "idiot", None])
    whole = examples.blocks.transpose(1, 0, 2).reshape(examples.blocks.shape[1], -1)[:, : len(examples.ids)]
    for _, vectors in examples.vectors(column):
        for terms, weights in vectors:
            places, cosines = examples.nearest(terms, weights, 7)
            exact = weights @ whole[terms]
            order = np.lexsort((np.arange(len(exact)), -exact))[:7]
            assert np.allclose(cosines, exact[order], atol=1e-5)
            assert abs(np.sqrt(weights @ weights) - 1) < 1e-4 or not weights.any()


def test_rare_terms_of_examples_find_them(spark):
    texts = {i: " ".join(f"w{i}x{k}" for k in range(20)) for i in range(1, 41)}
    docs = spark.createDataFrame([*texts.items(), (500, "w1x3 of no example"), (501, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 2)) for i in texts], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels)
    used = {int(i) for i in model.ids}
    asked = spark.createDataFrame([(i, f"some w{i}x7 here w{i}x9") for i in sorted(used)], "doc_id bigint, text string")
    assert {r.doc_id: r.evidence[0] for r in toxicity.predict(asked, model).collect()} == {i: i for i in used}
    terms = toxicity.example_terms(docs.where("doc_id = 1").collect())
    frequency, n = toxicity.document_frequencies(docs.repartition(3), terms)
    (_, _, hashes, _), *_ = toxicity._terms(pa.array(["w1x3", "w1x4"]))
    by = dict(zip(terms.tolist(), frequency.tolist()))
    assert n == 42 and by[int(hashes[0])] == 2 and by[int(hashes[1])] == 1


def test_unusual_texts_are_scored(spark, examples):
    table = spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string, score int")
    rows = toxicity.predict(table.withColumnRenamed("score", "x"), examples).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.predict(table, examples).columns == ["doc_id", "text", "lang", "score", "predicted", "evidence"]
    assert toxicity.predict(table.limit(0), examples).count() == 0
    assert {r.score for r in toxicity.predict(table, None).collect()} == {0.0}
    labels = spark.createDataFrame([(1, 0), (6, 1), (6, 0), (7, None), (None, 1), (5, 0)], "doc_id bigint, toxic int")
    assert toxicity.train(table, labels.limit(0)) is None
    tiny = toxicity.train(table, labels)
    assert toxicity.predict(table, tiny).count() == len(ROWS)


def test_samples_are_bounded_and_distinct(spark):
    rows = [(i, f"text {i % 30}", i % 2) for i in range(200)] + [(900, "long " * 20_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, label int")
    found = text_sample(docs, narrow(docs), 10)
    assert len(found) == 20 == len({(r.text, r.label) for r in found})
    assert found == text_sample(docs.repartition(7), narrow(docs), 10)


def test_few_rows_besides_the_sample_meet_in_one_task(spark):
    rows = spark.range(60_000).select((F.col("id") % 3 == 0).cast("int").alias("label"), F.xxhash64("id").alias("key"), F.col("id").alias("doc_id"))
    for label, kept in ((0, 1500), (1, 1500)):
        keys = sorted(r.key for r in rows.where(F.col("label") == label).collect())
        found = sorted(r.key for r in smallest_keys(rows, kept).where(F.col("label") == label).collect())
        assert found == keys[: len(found)] and kept <= len(found) < kept + 60
    assert smallest_keys(rows, 100_000).count() == 60_000


@pytest.mark.parametrize("share", [30, 50, 70])
def test_equal_evidence_gives_the_base_rate(share):
    """Labels that no word tells apart: texts with the shared words, unknown words or none score about the share of toxic rows."""
    rows = [Row(doc_id=i, text=f"same words here today x{i}", label=int(i % 10 < share // 10)) for i in range(400)]
    terms = toxicity.example_terms(rows)
    model = toxicity.fit(rows, {0: 1000 * (100 - share), 1: 1000 * share}, terms, np.full(len(terms), 5), 1000)
    asked = ["same words here", "", "never heard", None]
    scores = []
    for _, vectors in model.vectors(pa.array(asked)):
        for terms_of, weights in vectors:
            places, cosines = model.with_ties(terms_of, weights, toxicity.NEIGHBOURS)
            scores.append(model.score(model.vote(places, cosines, toxicity.NEIGHBOURS)))
    assert scores == pytest.approx([share / 100] * 4, abs=0.08)


def test_expected_pairs_are_those_of_all_labelings():
    rng = np.random.default_rng(4)
    rows, length, n = 3, 5, 3
    scores = rng.normal(0, 2, (rows * length, n)).astype(np.float32)
    transitions = rng.normal(0, 1.5, (n, n)).astype(np.float32)
    empty = np.empty((0, n), np.float32)
    field = language.Field(["a", "b", "c"], empty, np.empty(0, np.uint64), empty, empty, transitions)
    expected = np.zeros((n, n))
    for row in range(rows):
        own, total, counts = scores[row * length : (row + 1) * length].astype(float), 0.0, np.zeros((n, n))
        for labels in itertools.product(range(n), repeat=length):
            weight = np.exp(sum(own[i, x] for i, x in enumerate(labels)) + sum(transitions[x, y] for x, y in zip(labels, labels[1:])))
            total += weight
            for x, y in zip(labels, labels[1:]):
                counts[x, y] += weight
        expected += counts / total
    assert field.pairs(scores, rows) == pytest.approx(expected, rel=1e-4)


def test_words_are_looked_up_once(monkeypatch):
    """Known terms by distinct words: the same as by all of them, with one look-up for each distinct word and prefix."""
    rng = np.random.default_rng(4)
    some = ["alpha", "Bravissimo", "congratulations", "d2", "\u00e9t\u00e9s", "intermittently", "zz"]
    column = pa.array([" ".join(rng.choice(some, 200)) for _ in range(30)] + [None, "", "!?"], pa.string())
    terms = np.unique(np.concatenate([h for _, _, h, _ in toxicity._terms(column)]))[::2]
    (_, owner, hashes, _), = toxicity._terms(column)
    kept, at = toxicity._places(terms, hashes)
    asked, places = [], toxicity._places
    monkeypatch.setattr(toxicity, "_places", lambda t, h: asked.append(len(h)) or places(t, h))
    (lo, owners, found, n), = toxicity._known_terms(column, terms)
    assert (lo, n) == (0, 33)
    assert (np.sort(owners * len(terms) + found) == np.sort(owner[kept] * len(terms) + at)).all()
    assert sum(asked) <= 6 * len(some)
    assert not len(next(toxicity._known_terms(column, terms[:0]))[1])


def test_texts_that_bounds_do_not_help_go_through_whole_lists(monkeypatch):
    """The votes are those of the visits by bounds; only the first texts look at bounds."""
    rng = np.random.default_rng(8)
    known = [f"word{i}" for i in range(900)]
    rows = [Row(doc_id=i, text=" ".join(rng.choice(known, 40)), label=int(i % 3 == 0)) for i in range(700)]
    terms = toxicity.example_terms(rows)
    model = toxicity.fit(rows, {0: 2000, 1: 1000}, terms, np.full(len(terms), 5), 3000)
    asked = pa.array([" ".join(rng.choice(known, 30)) for _ in range(120)] + ["", "never heard"])
    (_, vectors), = model.vectors(asked)
    expected = [model.with_ties(t, w, 15) for t, w in vectors]
    visits, cosines = [], toxicity.Examples._cosines
    monkeypatch.setattr(toxicity.Examples, "_cosines", lambda *x: visits.append(1) or cosines(*x))
    found = list(model.votes(vectors, 15))
    assert [v for v, _ in found] == pytest.approx([model.vote(p, c, 15) for p, c in expected], abs=1e-5)
    assert all((a == b).mean() > 0.9 for (_, a), (b, _) in zip(found, expected))  # places within rounding may change order
    assert len(visits) <= 2 * toxicity.PILOTS


def test_counting_frequencies_gives_back_other_caches():
    freed = []
    worker_memory.keep("another operator", lambda: freed.append(1))
    terms = np.unique(np.concatenate([h for _, _, h, _ in toxicity._terms(pa.array(["one two"]))]))
    batch = pa.RecordBatch.from_arrays([pa.array(["one two one", None, "two three"])], names=["text"])
    counted = toxicity._counted(iter([batch]), terms).to_pydict()
    assert freed == [1]
    assert sorted(counted["n"]) == [1, 2, 3] and counted["n"][counted["term"].index(-1)] == 3


def test_sampled_texts_do_not_reach_the_driver(spark, docs, monkeypatch):
    collected, collect = [], type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda frame: collected.append(frame.columns) or collect(frame))
    made, create = [], type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda *x, **y: made.append(x) or create(*x, **y))
    assert language.train(docs, per_language=5) is not None
    assert toxicity.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"), per_label=5) is not None
    assert collected and all("text" not in columns for columns in collected) and not made
