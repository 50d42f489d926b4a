import random

import pytest
from pyspark.sql import functions as F

from logloom.operators import verdict as vd
from logloom.operators.ordered import latest_marker, neighbours, number_lines
from logloom.operators.skew import salted_lookup

# logs of our own: one test of each outcome, only passed tests, and lines that all start with blanks
MIXED = """
2023-11-05 07:00:01 runner ready
TESTCASE: checkout_total FAILED
Error: expected 12.50, found 12.05
TESTCASE: checkout_empty PASSED
"""
PASSING = """
TESTCASE: search_by_name PASSED
TESTCASE: search_by_code PASSED
"""
INDENTED = """
\t  TESTCASE: export_csv FAILED
\t  Error: disk quota reached
"""


def records(spark, *logs):
    rows = spark.createDataFrame([(str(i), log) for i, log in enumerate(logs)], "run_id string, log_content string")
    found = vd.verdict_records(vd.scan_lines(vd.explode_logs(rows))).orderBy("run_id").collect()
    return found if len(found) > 1 else found[0]


def test_line_numbers_of_a_hot_run(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else f"r{i % 5}", i // 40, i) for i in range(900)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "run_id string, part int, pos int").repartition(7)
    got = {(r.run_id, r.pos): r.line_no for r in number_lines(df, "run_id", "part", ["pos"]).collect()}
    for run in {r[0] for r in rows}:
        for n, pos in enumerate(sorted(p for r, _, p in rows if r == run)):
            assert got[run, pos] == n


def test_latest_marker_crosses_slices(spark):
    rng = random.Random(2)
    rows = [(f"r{n % 2}", n // 2, rng.random() < 0.05) for n in range(400)]
    df = spark.createDataFrame(rows, "run_id string, line_no long, mark boolean").repartition(5)
    got = latest_marker(df, F.col("mark"), slice_lines=7).collect()
    assert len(got) == 400
    for r in got:
        marks = [n for run, n, m in rows if run == r.run_id and m and n <= r.line_no]
        assert r.marker_no == (max(marks) if marks else None)


def test_neighbours(spark):
    lines = spark.createDataFrame([("a", i, f"l{i}") for i in range(5)], "run_id string, line_no long, line string")
    spots = spark.createDataFrame([("a", 0), ("a", 3)], "run_id string, line_no long")
    got = sorted((r.line_no, r.offset, r.line) for r in neighbours(spots, lines, 1, 2).collect())
    assert got == [(0, 0, "l0"), (0, 1, "l1"), (0, 2, "l2"), (3, -1, "l2"), (3, 0, "l3"), (3, 1, "l4")]


def test_salted_lookup_equals_plain_join(spark):
    rows = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(300)], "k string, i int")
    table = spark.createDataFrame([("hot", "H")] + [(f"k{i}", "x") for i in range(0, 300, 6)], "k string, v string")
    for how in ("inner", "left"):
        assert sorted(salted_lookup(rows, table, "k", F.col("i"), how).collect(), key=lambda r: r.i) == sorted(
            rows.join(table, "k", how).collect(), key=lambda r: r.i
        )


def test_sample_logs(spark):
    mixed, passing, indented = records(spark, MIXED, PASSING, INDENTED)
    assert (mixed.overall_status, mixed.test_status, mixed.total, mixed.failed) == ("SOME_FAILED", "failed", 2, 1)
    assert mixed.failed_tests == ["checkout_total"] and mixed.pass_rate == 50.0
    assert mixed.per_test == {"checkout_total": "FAILED", "checkout_empty": "PASSED"}
    assert (passing.overall_status, passing.test_status, passing.failed_tests) == ("ALL_PASSED", "passed", None)
    assert indented.failed_tests == ["export_csv"]


def test_summary_block_decides_and_the_last_one_wins(spark):
    log = (
        "Test case A: PASSED\nTEST EXECUTION SUMMARY\nTotal test cases: 9\nPassed: 9\nFailed: 0\nPass rate: 100%\n"
        "== Test Execution  Summary ==\n total TEST cases : 3\npassed: 2\nFAILED: 1\n"
    )
    r = records(spark, log)
    assert (r.overall_status, r.total, r.passed, r.failed, r.pass_rate) == ("SOME_FAILED", 3, 2, 1, 66.67)
    assert "summary block" in r.notes and "total=1" in r.notes


def test_a_cut_off_summary_falls_back_to_the_complete_one(spark):
    log = "TEST EXECUTION SUMMARY\nTotal test cases: 2\nPassed: 2\nFailed: 0\nTEST EXECUTION SUMMARY\nTotal test cases: 5\n"
    r = records(spark, log)
    assert (r.total, r.overall_status) == (2, "ALL_PASSED")


@pytest.mark.parametrize(
    "log, status, total, passed, failed",
    [
        ("Test case A: PASSED\nOutput validation PASSED\n", "ALL_PASSED", 1, 1, 0),
        ("test  CASE  A b :  passed \r\nTESTCASE: c\tFAILED  ", "SOME_FAILED", 2, 1, 1),
        ("Test case A: FAILED\nTest case A: PASSED", "ALL_PASSED", 1, 1, 0),
        ("Test case A: PASSED\nTest case A: PASSED\nTest case B: SKIPPED", "SOME_FAILED", 2, 1, 0),
        ("nothing here", "UNKNOWN", None, None, None),
        ("Failed: 3 of them\nPassed: 2", "UNKNOWN", None, None, None),
    ],
)
def test_rules(spark, log, status, total, passed, failed):
    r = records(spark, log)
    assert (r.overall_status, r.total, r.passed, r.failed) == (status, total, passed, failed)
    assert r.test_status == ("passed" if status == "ALL_PASSED" else "failed")


def test_one_grammar_only(spark):
    rows = spark.createDataFrame([("r", "Test case A: PASSED\nTESTCASE: b FAILED")], "run_id string, log_content string")
    facts = vd.scan_lines(vd.explode_logs(rows), grammars=("test_case",))
    assert [r.test_name for r in vd.tests_of(facts).collect()] == ["A"]


def test_failed_list_fallbacks(spark):
    rows = spark.createDataFrame(
        [
            (1, ["a"], {"b": "FAILED"}, "TESTCASE: c FAILED"),
            (2, [], {"b": "Failed", "x": "PASSED"}, "TESTCASE: c FAILED"),
            (3, None, {}, "TESTCASE: c FAILED"),
            (4, None, None, "clean"),
        ],
        "run_id int, failed_tests array<string>, per_test map<string,string>, log_content string",
    )
    got = [r.failed_list for r in vd.failed_with_fallback(rows).orderBy("run_id").collect()]
    assert got == [["a"], ["b"], ["c"], []]
