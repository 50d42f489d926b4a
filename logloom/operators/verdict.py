"""Pass/fail verdict of each run from its log lines.

Lines are (run_id, line_no, line). Every aggregation works on numbers only and
combines before the shuffle, so a run that owns most lines costs no more than
its distinct test names.
"""

from pyspark.sql import Column, DataFrame, functions as F

from logloom.functions import text as tx
from logloom.operators.ordered import latest_marker

SPACES = " \t\u000b\u000c\r\n"
STAMP = r"^\s*(?:\[[^\]]*\]\s*)?"
STATUSES = ["PASSED", "FAILED", "SKIPPED"]
HEADER = "header"
ERROR_LINE = r"^\s*(?:Error|Stacktrace):"

GRAMMARS = {
    "test_case": STAMP + r"test\s+case\s+(\S.*?)\s*:\s*(passed|failed|skipped)\s*$",
    "testcase": STAMP + r"testcase:\s*(\S.*?)\s+(passed|failed|skipped)\s*$",
}

SUMMARY_HEADER = r"(?i)\btest\s+execution\s+summary\b"
SUMMARY_FIELD = (
    r"(?i)" + STAMP + r"(total\s+test\s+cases|passed|failed|pass\s+rate)\s*:\s*"
    r"([0-9]+(?:\.[0-9]+)?)\s*%?\s*$"
)


def explode_logs(logs: DataFrame) -> DataFrame:
    """Whole logs (run_id, log_content) to lines (run_id, line_no, line)."""
    return logs.select(
        "run_id", F.posexplode(tx.lines_of(F.col("log_content"))).alias("line_no", "line")
    ).withColumn("line_no", F.col("line_no").cast("long"))


def scan_lines(
    lines: DataFrame, grammars: tuple[str, ...] = ("test_case", "testcase")
) -> DataFrame:
    """What triage needs to know of the lines, from one pass over them.

    Keeps the first line of each run and every line that may be a test, summary or error
    line: (run_id, line_no, test_name, status, field, value, error). The rest of the
    operators read this much smaller table, so store it or cut its lineage.
    """
    line = F.col("line")
    # every status word ends in "ED": a cheap look before the patterns run
    maybe_test = F.upper(F.substring(F.rtrim(line, F.lit(SPACES)), -2, 2)) == "ED"
    header = F.lower(line).contains("summary") & line.rlike(SUMMARY_HEADER)
    field, error = line.rlike(SUMMARY_FIELD), line.rlike(ERROR_LINE)
    kept = lines.where((F.col("line_no") == 0) | maybe_test | header | field | error)
    names = [F.regexp_extract(line, "(?i)" + GRAMMARS[g], 1) for g in grammars]
    name = F.when(maybe_test, F.coalesce(*[F.nullif(n, F.lit("")) for n in names]))
    words = F.when(field, F.regexp_replace(F.regexp_extract(line, SUMMARY_FIELD, 1), r"\s+", " "))
    return kept.select(
        "run_id",
        "line_no",
        name.alias("test_name"),
        F.when(maybe_test, F.upper(F.regexp_extract(line, r"(?i)(passed|failed|skipped)\s*$", 1))).alias("status"),
        F.when(header, F.lit(HEADER)).otherwise(F.nullif(F.lower(words), F.lit(""))).alias("field"),
        F.when(field, F.regexp_extract(line, SUMMARY_FIELD, 2).try_cast("double")).alias("value"),
        F.when(error, line).alias("error"),
    )


def tests_of(facts: DataFrame) -> DataFrame:
    """Lines that report one test: (run_id, line_no, test_name, status)."""
    return facts.where("test_name IS NOT NULL").select("run_id", "line_no", "test_name", "status")


def per_test(tests: DataFrame) -> DataFrame:
    """One row per (run, test): the last status and the first line."""
    code = sum(
        (F.when(F.col("status") == s, F.lit(i)).otherwise(F.lit(0)) for i, s in enumerate(STATUSES)),
        F.lit(0),
    )
    # line number and status share one BIGINT, which keeps this a hash aggregate
    latest = F.max(F.col("line_no") * 4 + code)
    return (
        tests.groupBy("run_id", "test_name")
        .agg(latest.alias("_latest"), F.min("line_no").alias("first_line"))
        .select(
            "run_id",
            "test_name",
            F.element_at(
                F.array(*map(F.lit, STATUSES)), (F.col("_latest") % 4 + 1).cast("int")
            ).alias("status"),
            "first_line",
            F.floor(F.col("_latest") / 4).alias("last_line"),
        )
    )


def test_counts(outcomes: DataFrame) -> DataFrame:
    """Distinct tests, passes and failures of each run."""
    return outcomes.groupBy("run_id").agg(
        F.count("*").alias("n_tests"),
        F.count_if(F.col("status") == "PASSED").alias("n_passed"),
        F.count_if(F.col("status") == "FAILED").alias("n_failed"),
    )


def last_summary(facts: DataFrame) -> DataFrame:
    """The last complete summary block of each run that has one."""
    block_lines = facts.where("field IS NOT NULL").select("run_id", "line_no", "field", "value")
    placed = latest_marker(block_lines, F.col("field") == HEADER).where("marker_no IS NOT NULL")

    def first_value(name: str) -> Column:
        here = F.col("field") == name
        return F.min_by(F.when(here, F.col("value")), F.when(here, F.col("line_no")))

    blocks = (
        placed.groupBy("run_id", "marker_no")
        .agg(
            first_value("total test cases").alias("total"),
            first_value("passed").alias("passed"),
            first_value("failed").alias("failed"),
            first_value("pass rate").alias("rate"),
        )
        .where("total IS NOT NULL AND passed IS NOT NULL AND failed IS NOT NULL")
    )
    return blocks.groupBy("run_id").agg(
        *[F.max_by(c, "marker_no").alias("sum_" + c) for c in ("total", "passed", "failed")],
        # a block without a rate must not lend an older block's rate
        F.max_by(F.coalesce("rate", F.lit(-1.0)), "marker_no").alias("sum_rate"),
    )


def stamp_seconds(line: Column) -> Column:
    """Seconds since 1970 of a leading [yyyy-MM-dd HH:mm:ss], else NULL."""
    stamp = F.regexp_extract(line, r"^\s*\[(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})\]", 1)

    def part(start: int) -> Column:
        return F.substring(stamp, start, 2).cast("int")

    day = F.unix_date(F.substring(stamp, 1, 10).try_cast("date")).cast("long")
    return F.when(
        stamp != "", day * 86400 + part(12) * 3600 + part(15) * 60 + part(18)
    )


def run_times(lines: DataFrame) -> DataFrame:
    """Seconds between the first and the last time stamp of each run."""
    seconds = F.when(F.col("line").contains("["), stamp_seconds(F.col("line")))
    return lines.groupBy("run_id").agg((F.max(seconds) - F.min(seconds)).alias("elapsed_seconds"))


def verdict(facts: DataFrame, outcomes: DataFrame | None = None) -> DataFrame:
    """One row per run: status, counts, pass rate and the rule that decided.

    A summary block decides when present, else the test lines, else UNKNOWN.
    """
    if outcomes is None:
        outcomes = per_test(tests_of(facts))
    runs = facts.where("line_no = 0").select("run_id")
    joined = runs.join(test_counts(outcomes), "run_id", "left").join(
        last_summary(facts), "run_id", "left"
    )
    by_summary = F.col("sum_total").isNotNull()
    by_tests = F.col("n_tests").isNotNull()
    total = F.coalesce(F.col("sum_total").cast("long"), F.col("n_tests"))
    passed = F.coalesce(F.col("sum_passed").cast("long"), F.col("n_passed"))
    failed = F.coalesce(F.col("sum_failed").cast("long"), F.col("n_failed"))
    computed = F.when(total > 0, F.round(passed.cast("double") / total * 100, 2))
    differs = by_summary & by_tests & (
        (F.col("n_tests") != total) | (F.col("n_passed") != passed) | (F.col("n_failed") != failed)
    )
    rule = (
        F.when(by_summary, F.lit("summary block"))
        .when(by_tests, F.lit("per-test lines"))
        .otherwise(F.lit("no summary block and no per-test lines"))
    )
    note = F.when(
        differs,
        F.format_string(
            "per-test lines give total=%d passed=%d failed=%d",
            F.col("n_tests"), F.col("n_passed"), F.col("n_failed"),
        ),
    )
    overall = (
        F.when(~by_summary & ~by_tests, F.lit("UNKNOWN"))
        .when((failed == 0) & (passed == total), F.lit("ALL_PASSED"))
        .otherwise(F.lit("SOME_FAILED"))
    )
    return joined.select(
        "run_id",
        overall.alias("overall_status"),
        tx.collapse_status(overall).alias("test_status"),
        total.alias("total"),
        passed.alias("passed"),
        failed.alias("failed"),
        F.coalesce(F.when(F.col("sum_rate") >= 0, F.col("sum_rate")), computed).alias("pass_rate"),
        F.concat_ws("; ", rule, note).alias("notes"),
    )


def failed_tests(outcomes: DataFrame) -> DataFrame:
    """(run_id, test_name, first_line) of every test whose last status is FAILED."""
    return outcomes.where("status = 'FAILED'").select("run_id", "test_name", "first_line")


def failed_lists(failures: DataFrame) -> DataFrame:
    """Distinct failed names of each run in order of first line."""
    ordered = F.sort_array(F.collect_list(F.struct("first_line", "test_name")))
    return failures.groupBy("run_id").agg(
        F.transform(ordered, lambda x: x["test_name"]).alias("failed_tests")
    )


def verdict_records(facts: DataFrame, outcomes: DataFrame | None = None) -> DataFrame:
    """The verdict with its failed-test list and per-test map."""
    if outcomes is None:
        outcomes = per_test(tests_of(facts))
    # one row per distinct test of the run, so the map has no repeated keys
    entries = F.sort_array(F.collect_list(F.struct("test_name", "status")))
    failed = F.collect_list(
        F.when(F.col("status") == "FAILED", F.struct("first_line", "test_name"))
    )
    lists = outcomes.groupBy("run_id").agg(
        tx.none_if_empty(F.transform(F.sort_array(failed), lambda x: x["test_name"])).alias("failed_tests"),
        F.map_from_entries(entries).alias("per_test"),
    )
    return verdict(facts, outcomes).join(lists, "run_id", "left")


def failed_with_fallback(records: DataFrame, found: Column | None = None) -> DataFrame:
    """Add ``failed_list``: the recorded list, else FAIL entries of the map, else the
    names found by pattern in the whole log (``found``, if that was done before), else []."""
    from_map = F.map_keys(
        F.map_filter("per_test", lambda _, status: F.upper(status).contains("FAIL"))
    )
    if found is None:
        found = tx.failed_testcases(F.col("log_content"))
    return records.withColumn(
        "failed_list",
        F.coalesce(
            tx.none_if_empty(F.col("failed_tests")),
            tx.none_if_empty(from_map),
            tx.none_if_empty(found),
            F.array().cast("array<string>"),
        ),
    )
