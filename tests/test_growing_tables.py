"""Tables that grow: folders by prefix, one row per key, compaction, states at a time."""

import datetime as dt
import random

from logloom import schemas
from logloom.operators import memory as mem
from logloom.operators.latest import as_of, latest_per_key
from logloom.sources import tables

NAMES = [f.name for f in schemas.VECTORS]


def records(spark, ids, collection="log_templates"):
    return spark.createDataFrame(
        [(i, [1.0, 2.0], "t", "s", "s", "c", None, None, f"doc {i}", collection, "outcome") for i in ids], schemas.VECTORS
    )


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_an_append_reads_only_its_own_folders(spark, tmp_path):
    path = str(tmp_path / "v")
    tables.append_vectors(records(spark, [f"id{i}" for i in range(600)]), path)
    tables.append_vectors(records(spark, [f"x{i}" for i in range(50)], "1e2"), path)
    batch = records(spark, ["id7", "new"]).withColumn("prefix", tables.prefix_of("id"))
    prefixes = sorted({r.prefix for r in batch.collect()})
    found = tables.stored_ids(batch, path)
    plan = plan_of(found)
    assert "PartitionFilters" in plan and all(p in plan for p in prefixes) and "PushedFilters: [In(id, " in plan
    assert [r.id for r in found.collect()] == ["id7"]
    tables.append_vectors(batch.select(NAMES), path)
    assert tables.open_collection(spark, path).count() == 601
    assert tables.open_collection(spark, path, "1e2").count() == 50


def test_compaction_keeps_all_rows(spark, tmp_path):
    path = str(tmp_path / "v")
    for part in range(4):
        tables.append_vectors(records(spark, [f"id{i}" for i in range(part * 30, part * 30 + 60)]), path)
    before = sorted(map(str, tables.open_collection(spark, path).collect()))
    n_files = len(list((tmp_path / "v").rglob("*.parquet")))
    assert tables.compact_vectors(spark, path, least_files=2) > 0
    assert len(list((tmp_path / "v").rglob("*.parquet"))) < n_files
    assert sorted(map(str, tables.open_collection(spark, path).collect())) == before and len(before) == 150
    assert tables.compact_vectors(spark, path, least_files=2) == 0
    tables.append_vectors(records(spark, ["id3"]), path)
    assert tables.open_collection(spark, path).count() == 150


def test_tips_stay_one_row_per_key(spark, tmp_path):
    path, rng = str(tmp_path / "t"), random.Random(2)
    day = dt.datetime(2024, 1, 1)
    every = []
    for _ in range(4):
        rows = [("global_tips", rng.choice([None, "a", "b", *map(str, range(40))]), f"tip {rng.random()}", day + dt.timedelta(rng.randrange(9)), f"r{rng.randrange(5)}") for _ in range(60)]
        every += rows
        batch = spark.createDataFrame(rows, schemas.TIPS)
        for _ in range(2):
            tables.put_tips(batch, path)
            stored = tables.open_table(spark, path, schemas.TIPS)
            assert stored.groupBy("namespace", "key").count().where("count > 1").isEmpty()
    expected = {}
    for row in every:
        k = row[:2]
        expected[k] = max(expected.get(k, row), row, key=lambda r: (r[3], r[4], r[2]))
    assert {(r.namespace, r.key): tuple(r) for r in stored.collect()} == expected
    tables.put_tips(spark.createDataFrame([], schemas.TIPS), path)
    assert tables.open_table(spark, path, schemas.TIPS).count() == len(expected)


def test_latest_and_state_at_a_time(spark):
    rng = random.Random(8)
    rows = [(rng.choice([None, "a", "b", "c"]), rng.randrange(12), rng.choice([None, "x", "y"]), rng.random()) for _ in range(200)]
    df = spark.createDataFrame(rows, "k string, ts int, run string, v double").repartition(5)
    rank = lambda r: (r[1], r[2] is not None, r[2] or "", r[3])
    latest = {k: max((r for r in rows if r[0] == k), key=rank) for k in {r[0] for r in rows}}
    assert {r.k: tuple(r) for r in latest_per_key(df, ["k"], ["ts", "run"]).collect()} == latest
    times = [(k, t) for k in ("a", "b", "z") for t in (-1, 0, 5, 11, 50)]
    found = as_of(df.dropDuplicates(["k", "ts", "run"]), ["k"], ["ts", "run"], spark.createDataFrame(times, "k string, at int")).collect()
    got = {(r.k, r.at): (r.ts, r.run) for r in found}
    expected = {}
    for k, t in times:
        seen = [r for r in rows if r[0] == k and r[1] <= t]
        if seen:
            expected[k, t] = max(seen, key=rank)[1:3]
    assert got == expected
