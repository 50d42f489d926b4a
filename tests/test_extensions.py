"""Hot keys, value sets, codes, trends, clusters and anomalies against plain Python."""

import datetime as dt
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom import schemas
from logloom.operators import augment as ag, clusters as cl, skew, templates as tp, trends as tr
from logloom.operators.embed import hashing_embedder
from logloom.plans import knowledge


def plan_of(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_only_hot_keys_are_repeated(spark, how):
    keys = ["hot"] * 500 + ["warm"] * 60 + [f"k{i % 50}" for i in range(100)] + [None, "lost"]
    rows = spark.createDataFrame(list(enumerate(keys)), "i int, k string").repartition(4)
    lookup = spark.createDataFrame([("hot", "a"), ("hot", "b"), ("warm", "c"), *[(f"k{i}", str(i)) for i in range(40)], ("unasked", "z")], "k string, v string")
    plain = sorted(map(str, rows.join(lookup, "k", how).collect()))
    for hot_rows in (1_000_000, 50, 300):
        assert sorted(map(str, skew.salted_lookup(rows, lookup, "k", F.col("i"), how, hot_rows).collect())) == plain
    hot = skew.hot_keys(rows, ["k"], 50)
    assert {r.k: r._salts for r in hot.collect()} == {"hot": 10, "warm": 2}
    copies = Counter((r.k, r.v) for r in skew.repeated(lookup, hot, ["k"]).collect())
    assert copies.pop(("hot", "a")) == copies.pop(("hot", "b")) == 10 and copies.pop(("warm", "c")) == 2 and set(copies.values()) == {1}


def test_lookup_without_hot_keys_is_a_plain_join(spark):
    rows = spark.createDataFrame([(i, f"k{i}") for i in range(100)], "i int, k string")
    lookup = spark.createDataFrame([(f"k{i}", i) for i in range(100)], "k string, v int")
    assert "explode" not in plan_of(skew.salted_lookup(rows, lookup, "k", F.col("i"), hot_rows=10))
    assert "explode" in plan_of(skew.salted_lookup(rows.withColumn("k", F.lit("k1")), lookup, "k", F.col("i"), hot_rows=10))


def test_value_sets_agree_with_exact_values(spark):
    rng = random.Random(4)
    texts = [f"code {min(int(rng.paretovariate(0.8)), 9999)} on node{rng.randrange(9)} took {rng.randrange(10**6)} ms" for _ in range(6000)]
    texts += [f"disk sda{i % 40} of host{i % 2} has {i} bytes" for i in range(200)]
    lines = spark.createDataFrame([("r", i, t) for i, t in enumerate(texts)], "run_id string, line_no long, line string").repartition(6)
    found = knowledge.extract(lines, spark.createDataFrame([], schemas.SME))
    exact = {}
    for r in found.values.collect():
        exact.setdefault((r.template, r.variable), Counter())[r.value] += r.n
    sets = {(r.template, r.variable): r for r in found.value_sets.collect()}
    assert set(sets) == set(exact) and len(sets) >= 3
    for key, counts in exact.items():
        r, n = sets[key], sum(counts.values())
        assert r.n == n and abs(r.n_distinct - len(counts)) <= max(1, tp.DISTINCT_BOUND * len(counts))
        assert all(abs(x.n - counts[x.value]) <= 3.5 * n / tp.TRACKED for x in r.top)
        best = counts.most_common(1)[0]
        assert best[0] in {x.value for x in r.top} or best[1] <= 3.5 * n / tp.TRACKED
    pending = {r.template for r in found.pending.collect()}
    assert pending == {t for t, _ in exact}
    assert sum(found.members.groupBy("merged").count().select(F.sum("count")).first()) == found.members.count()


def test_codes_of_the_caller(spark):
    templates = spark.createDataFrame(
        [("SQL injection in <PATH>", "ERROR", "Database", "s"), ("login <NUM> denied", "WARN", "Auth", "s"), ("a sql-Injection, in one more place", "INFO", "System", "s")],
        "template string, severity string, causality string, summary string",
    )
    codes = spark.createDataFrame(
        [("A03", "sql injection"), ("A03", "SQL  Injection"), ("A01", "denied"), ("X", "injection in one more place here"), ("Y", "injection in one more place"), ("Z", ""), ("W", None), ("N", "log")],
        "code string, phrase string",
    )
    found = {r.template: r.own_codes for r in ag.match_codes(templates, codes).collect()}
    assert found == {"SQL injection in <PATH>": ["A03"], "login <NUM> denied": ["A01"], "a sql-Injection, in one more place": ["A03", "Y"]}
    augmented = ag.augment(templates, codes).where("variant_no > 0").collect()
    reported = {}
    for r in augmented:
        reported.setdefault(r.template, set()).add(r.context.after[0].removeprefix("reported code: "))
    assert all(reported[t] <= set(found[t]) for t in found)
    assert ag.augment(templates).where("variant_no > 0").count() == len(augmented)
    pending = templates.withColumn("template_id", tp.template_id(F.col("template"))).withColumn("source", F.lit("SME"))
    pending = pending.withColumn("values", F.array().cast("array<map<string,string>>")).withColumn("context", F.lit(None).cast(tp.CONTEXT_TYPE))
    none = spark.createDataFrame([], "template_id string, action string, field string, value string, decided_at timestamp_ntz")
    records = knowledge.index_reviewed(pending, none, hashing_embedder(8), 8, codes=codes)
    assert records.count() == 3 + len(augmented)


def test_trends(spark):
    start = dt.datetime(2024, 1, 1)
    hours = {"up": [1] * 10 + [9] * 5, "flat": [2] * 15, "gap": [0, 0, 4] + [0] * 12}
    rows = [(k, start + dt.timedelta(hours=h, minutes=m)) for k, counts in hours.items() for h, n in enumerate(counts) for m in range(n)]
    rows += [(None, start), ("up", None)]
    series = tr.time_series(spark.createDataFrame(rows, "k string, ts timestamp_ntz"), "k", "ts")
    points = tr.change_points(series, "k")
    for k, counts in hours.items():
        got = sorted(((r.bucket, r.n, r.deviation, r.is_change) for r in points.where(F.col("k") == k).collect()))
        sums = np.cumsum(counts)
        deviation = [15 * int(s) - (i + 1) * sum(counts) for i, s in enumerate(sums)]
        assert [g[1] for g in got] == counts and [g[2] for g in got] == deviation
    levels = {r.k: (r.change_at, r.before, r.after) for r in tr.levels(points, "k").collect()}
    assert levels["up"] == (start + dt.timedelta(hours=9), 1.0, 9.0) and "flat" not in levels
    assert tr.change_points(tr.time_series(spark.createDataFrame([], "k string, ts timestamp_ntz"), "k", "ts"), "k").count() == 0


def test_groups_along_a_long_chain(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, 1001), (1003, 1002), (1001, 1002)] + [(5000, i) for i in range(5001, 5100)]
    random.Random(1).shuffle(links)
    found = {r.id: r.root for r in cl.joined_groups(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(201)}, **{i: 1000 for i in range(1000, 1004)}, **{i: 5000 for i in range(5000, 5100)}}


def test_density_clusters(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((3, 12))
    x = np.concatenate([c + 0.1 * rng.standard_normal((n, 12)) for c, n in zip(centres, (40, 25, 3))] + [rng.standard_normal((10, 12)), np.zeros((1, 12))])
    found = {r.id: (r.cluster, r.is_core) for r in cl.density_clusters(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, vec array<double>")).collect()}
    assert len(found) == len(x)
    assert {found[i][0] for i in range(40)} == {0} and {found[i][0] for i in range(40, 65)} == {40}
    assert all(found[i] == (None, False) for i in range(65, len(x)))  # too few, scattered, or without a direction


def test_run_anomalies(spark):
    counts = [(f"r{i}", t, 5) for i in range(9) for t in ("a", "b")] + [("r9", "a", 5), ("r9", "odd", 5), ("s", "a", 1)]
    peers = [(f"r{i}", "g") for i in range(10)] + [("s", "h")]
    found = {r.run_id: r for r in cl.run_anomalies(spark.createDataFrame(counts, "run_id string, template string, n long"), spark.createDataFrame(peers, "run_id string, group string")).collect()}
    rare = {"a": math.log(11 / 11), "b": math.log(11 / 9), "odd": math.log(11)}
    assert found["r9"].rarity == pytest.approx((rare["a"] + rare["odd"]) / 2) and found["r0"].rarity == pytest.approx(rare["b"] / 2)
    assert found["r9"].score == pytest.approx(3.0) and found["s"].score == 0.0 and found["r9"].n_lines == 10
