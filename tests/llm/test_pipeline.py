"""The pipeline on planted cases, and all registered queries on the smallest data."""

import random
import zlib

import duckdb
import pytest

import corpus_pipeline
from logloom.llm.catalog import QUERIES
from logloom.llm.catalog_sql import ORACLE_SQL

DATA = "/root/testdata/sf0.001"
TOXIC = ["moron", "scum", "idiot", "trash", "loser"]


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = random.Random(12)
    vocabulary = {
        lang: ["".join(rng.choice(letters) for _ in range(rng.randint(3, 8))) for _ in range(400)]
        for lang, letters in (("en", "abcdefghijklm"), ("fr", "nopqrstuvwxyzé"))
    }
    text = lambda lang, n: [rng.choice(vocabulary[lang]) for _ in range(n)]
    items = [text("en", 25) for _ in range(4)]
    rows, labels, gone = [], [], {}
    for i in range(300):
        lang = "en" if i % 3 else "fr"
        words = text(lang, 150 if i == 2 else rng.randint(20, 200))
        toxic = i % 6 == 1
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(TOXIC))
            gone[i] = "toxic"
        rows.append((i, " ".join(words), lang))
        if i % 2:
            labels.append((i, 1, int(toxic)))
    original = rows[2][1].split()
    for i in range(400, 420):
        copy = list(original)
        if i % 2:
            copy[i % len(copy)] = "changed"
        rows.append((i, " ".join(copy), "en"))
        gone[i] = "copy"
    for i in range(500, 508):
        rows.append((i, " ".join(text("en", 30) + items[i % 4] + text("en", 40)), "en"))
        gone[i] = "leak"
    rows += [(600, None, "en"), (601, "", "fr"), (602, "12 34 +-", None), (603, rows[5][1] * 1, None)]
    gone |= {600: "und", 601: "und", 602: "und", 603: "copy"}
    folder = tmp_path_factory.mktemp("planted")
    docs = spark.createDataFrame([(a, b, c, "s", 0, 1) for a, b, c in rows], "doc_id bigint, text string, lang string, source string, score int, _p int")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), {r[0] for r in rows}, gone


def test_stages_drop_what_is_planted_and_nothing_else(spark, planted, tmp_path):
    folder, every, gone = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    dropped = {}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "toxicity", "ngram_jaccard_join", "decontamination", "best_fit_packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns
        dropped |= {i: name for i in before - {r.doc_id for r in docs.select("doc_id").collect()}}
    kind = {"und": "language_id", "toxic": "toxicity", "copy": "ngram_jaccard_join", "leak": "decontamination"}
    expected = {i: kind[k] for i, k in gone.items()}
    assert {i: n for i, n in dropped.items() if expected.get(i) != n} == {}
    assert {i: n for i, n in expected.items() if i not in dropped} == {}
    packed = corpus_pipeline.packed(spark, docs, folder).collect()
    assert {r.doc_id for r in packed} == every - set(gone)


def test_run_does_the_same_as_its_stages(spark, planted):
    folder, every, gone = planted
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in rows} == every - set(gone)
    assert {"sequence_id", "offset"} <= set(rows[0].asDict())


def test_packed_sequences_hold_their_ids(spark, planted):
    docs = spark.read.parquet(f"{planted[0]}/documents.parquet").where("doc_id < 40")
    rows = corpus_pipeline.packed(spark, docs, planted[0]).collect()
    assert rows and all(len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 for r in rows)


def test_stages_on_an_empty_table(spark, planted, tmp_path):
    folder = planted[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"op11_spelling_variant_grouping"}))
def test_registered_query(spark, name):
    """Every row of the table, or every query, is in the result; words of op11 are compared with SQL."""
    rows = QUERIES[name](spark, DATA).collect()
    places = {
        "op5_nearest_neighbours": ("embeddings", "query_id"), "op10_html_extraction": ("pages", "page_id"),
        "op13_embedding_near_dedup": ("embeddings", "vec_id"),
    }
    table, key = places.get(name, ("documents", "doc_id"))
    ids = {r[0] for r in spark.read.parquet(f"{DATA}/{table}.parquet").collect()}
    found = {r[key] for r in rows}
    assert found == ({i for i in ids if i % 20 == 0} if key == "query_id" else ids)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_registered_query_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    found = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    rows = QUERIES[name](spark, DATA).select(*columns).collect()
    assert sorted(map(tuple, rows), key=repr) == sorted(found.fetchall(), key=repr)
    con.close()
