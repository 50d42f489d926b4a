"""Triage by lines against triage of whole logs; matches and chunks across slices."""

import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from logloom import schemas, session
from logloom.functions import text as tx
from logloom.operators import embed as em, long_logs as ll, skew
from logloom.plans import triage
from logloom.plans.triage import triage_lines, triage_logs
from logloom.sources.run_logs import document_logs

PIECES = ["TESTCASE:", "TESTCASE: a", "b FAILED", "FAILED", " \t", "", "TESTCASE: x FAILED", "word", "TESTCASE: y FAILED TESTCASE:", "PASSED", " "]


def as_lines(logs):
    return logs.select("run_id", F.posexplode(F.split("log_content", "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("long"))


def random_logs(spark, seed, n=60):
    rng = random.Random(seed)
    return spark.createDataFrame(
        [(f"r{i}", "\n".join(" ".join(rng.choices(PIECES, k=rng.randint(1, 2))) for _ in range(rng.randint(1, 30)))) for i in range(n)],
        "run_id string, log_content string",
    )


@pytest.mark.parametrize("slice_lines", [2, 3, 7, 50_000])
def test_names_across_lines_and_slices(spark, slice_lines):
    logs = random_logs(spark, slice_lines)
    expected = {r.run_id: r.found for r in logs.select("run_id", tx.failed_testcases(F.col("log_content")).alias("found")).collect()}
    found = {r.run_id: r.found for r in ll.failed_names(as_lines(logs), slice_lines).collect()}
    assert found == {k: v for k, v in expected.items() if v}
    assert any("\n" in m for r in logs.collect() for m in re.findall(r"TESTCASE:\s*.*?\s*FAILED", r.log_content))


@pytest.mark.parametrize("slice_lines", [3, 50_000])
def test_chunks_across_lines_and_slices(spark, slice_lines):
    rng = random.Random(4)
    logs = spark.createDataFrame(
        [(f"r{i}", "\n".join("é" * rng.choice([0, 0, 3, 40, 799, 801, 2500]) + str(j) * rng.randint(0, 2) for j in range(rng.randint(1, 40)))) for i in range(30)],
        "run_id string, log_content string",
    )
    expected = logs.select("run_id", F.posexplode(tx.chunks_of(F.col("log_content"))).alias("chunk_no", "chunk"))
    lines = as_lines(logs).repartition(5)
    found = ll.log_chunks(lines, ll.log_sizes(lines), slice_lines=slice_lines)
    assert {tuple(r) for r in found.select("run_id", "chunk_no", "chunk").collect()} == {tuple(r) for r in expected.collect()}
    make, whole = em.hashing_embedder(16), em.embed_texts(logs, "log_content", em.hashing_embedder(16), 16)
    pooled = em.embed_chunks(found.select("run_id", "chunk"), "run_id", make, 16, calls=em.Calls(chunks=7))
    expected = {r.run_id: (r.embedding, r.n_chunks) for r in whole.where("n_chunks > 0").collect()}
    assert {r.run_id: (r.embedding, r.n_chunks) for r in pooled.collect()} == expected


def rows_of(df):
    return sorted(str(r) for r in df.select(*sorted(df.columns)).collect())


def test_lines_give_the_same_rows_as_whole_logs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    logs = document_logs(docs).select("run_id", "log_content").unionByName(random_logs(spark, 1))
    logs = logs.unionByName(spark.createDataFrame([("blank", " \n\t\n")], logs.schema))
    past = em.embed_texts(
        docs.limit(40).select(
            F.col("doc_id").cast("string").alias("id"), F.col("text").alias("document"), F.lit("s").alias("summary"), F.lit(None).cast("string").alias("resolution")
        ), "document", em.hashing_embedder(16), 16,
    )
    tips = spark.createDataFrame([("global_tips", "test_error_3", "check the cable", None, "old")], schemas.TIPS)
    stamp = F.lit("2024-01-01").cast("timestamp_ntz")
    whole = triage_logs(logs, past, tips, em.hashing_embedder(16), 16, updated_at=stamp)
    by_line = triage_lines(as_lines(logs).repartition(4), past, tips, em.hashing_embedder(16), 16, updated_at=stamp, slice_lines=11)
    for name in ("failures", "tickets", "texts", "tips", "outcomes", "error_details", "rejected"):
        a, b = getattr(whole, name), getattr(by_line, name)
        assert rows_of(a) == rows_of(b) and a.count() > 0, name
    short = triage_lines(as_lines(logs), past, tips, em.hashing_embedder(16), 16, updated_at=stamp, document_chars=500).outcomes
    assert short.where("document IS NULL").count() > 100
    same = [c for c in short.columns if c not in ("id", "document")]
    assert rows_of(short.select(same)) == rows_of(whole.outcomes.select(same))


def test_lines_leave_no_copies_of_the_texts_behind(spark, monkeypatch):
    """Tables that triage stores and does not delete hold each text once, and no error lines of tests that did not fail."""
    logs = spark.range(400).select(
        F.concat(F.lit("r"), "id").alias("run_id"),
        F.concat(
            F.lit("TESTCASE: a PASSED\nError: "), F.sha2(F.col("id").cast("string"), 256), F.lit("\nTESTCASE: b "),
            F.when(F.col("id") % 2 == 0, "FAILED").otherwise("PASSED"), F.lit("\nError: disk "), F.sha2(F.concat(F.lit("x"), "id"), 256),
        ).alias("log_content"),
    )
    past = em.embed_texts(
        spark.createDataFrame([("1", "old issue", "s", None)], "id string, document string, summary string, resolution string"), "document", em.hashing_embedder(16), 16
    )
    tips = spark.createDataFrame([], schemas.TIPS)
    stored = []

    def recorded(df, cut=session.cut_lineage):
        stored.append(cut(df))
        return stored[-1]

    for module in (triage, skew, ll):
        monkeypatch.setattr(module, "cut_lineage", recorded, raising=False)
    done = triage_lines(as_lines(logs), past, tips, em.hashing_embedder(16), 16, updated_at=F.lit("2024-01-01").cast("timestamp_ntz"))
    there = [df for df in stored if Path(df.inputFiles()[0].removeprefix("file://")).exists()]
    assert len(there) < len(stored)
    texts = [c for df in there for c in df.columns if c in ("line", "chunk", "log_content")]
    assert texts == ["log_content"]
    assert sum(df.count() for df in there if "marker_no" in df.columns) == 200
    assert done.outcomes.count() == 400
    details = {(r.run_id, r.test_name, r.n) for r in done.error_details.collect()}
    assert details == {(f"r{i}", "b", 1) for i in range(0, 400, 2)}
