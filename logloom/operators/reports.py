"""Pass and failure reports, tickets and display texts."""

from pyspark.sql import Column, DataFrame, functions as F

from logloom.functions import text as tx
from logloom.operators import verdict as vd
from logloom.operators.enrich import CAUSALITY_RULES, first_match
from logloom.operators.ordered import SLICE_LINES, latest_marker
from logloom.operators.skew import salted_lookup
from logloom.operators.templates import mask

# Fixed value: the state of a new ticket.
CREATED = "created"


def passed_and_failed(verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Everything that did not pass takes the failure path."""
    passed = F.col("test_status") == "passed"
    return verdicts.where(passed), verdicts.where(~F.coalesce(passed, F.lit(False)))


def pass_reports(verdicts: DataFrame, times: DataFrame) -> DataFrame:
    """(run_id, summary_report) of passed runs; ``times`` comes from ``run_times``."""
    passed, _ = passed_and_failed(verdicts)
    time = F.coalesce(
        F.concat(F.col("elapsed_seconds").cast("string"), F.lit(" s")), F.lit("not available")
    )
    return passed.join(times, "run_id", "left").select(
        "run_id",
        F.concat(
            F.lit("Total tests: "), F.col("total").cast("string"),
            F.lit("\nExecution time: "), time,
            F.lit("\nHighlights: all tests passed, decided by "), F.col("notes"),
        ).alias("summary_report"),
    )


def error_details(facts: DataFrame, failures: DataFrame) -> DataFrame:
    """Error lines of failed tests, counted by masked text.

    An error line belongs to the last test line before it. Counts are combined per test
    line first, so the join to test names sees few rows even if one test writes most lines.
    Lines below tests that did not fail are left out before anything is stored.
    Returns (run_id, test_name, message, n, first_line, example).
    """
    # twice the line number, and one more for failed tests: the marker tells which test line it is and whether that failed
    failed = F.when(F.col("test_name").isNotNull() & (F.col("status") == "FAILED"), 1).otherwise(0)
    marked = latest_marker(
        facts.where("test_name IS NOT NULL OR error IS NOT NULL").select(
            "run_id", "line_no", (F.col("line_no") * 2 + failed).alias("_place"), "test_name", "error"
        ),
        F.col("test_name").isNotNull(), line_no="_place", slice_lines=2 * SLICE_LINES,
    )
    placed = marked.where("error IS NOT NULL AND marker_no % 2 = 1").withColumnRenamed("error", "line")
    placed = placed.withColumn("marker_no", F.floor(F.col("marker_no") / 2))
    counted = placed.groupBy("run_id", "marker_no", mask(F.col("line")).alias("message")).agg(
        F.count("*").alias("n"),
        F.min("line_no").alias("at"),
        F.min_by("line", "line_no").alias("example"),
    )
    failed_lines = vd.tests_of(facts).where("status = 'FAILED'").select(
        "run_id", F.col("line_no").alias("marker_no"), "test_name"
    )
    found = salted_lookup(counted, failed_lines, ["run_id", "marker_no"], F.col("message"))
    per_test = found.groupBy("run_id", "test_name", "message").agg(
        F.sum("n").alias("n"),
        F.min("at").alias("first_line"),
        F.min_by("example", "at").alias("example"),
    )
    failed_tests = failures.select("run_id", "test_name")
    return salted_lookup(per_test, failed_tests, ["run_id", "test_name"], F.col("message"), "left_semi")


def test_explanations(failures: DataFrame, details: DataFrame) -> DataFrame:
    """(run_id, test_name, first_line, explanation) of each failed test.

    The text has a fixed size: how many error lines of how many kinds, the first and the last
    kind, and the likely causes with their counts. The kinds themselves stay in ``details``.
    """
    cause = first_match(F.col("message"), CAUSALITY_RULES, "Application")
    totals = (
        details.withColumn("cause", cause)
        .groupBy("run_id", "test_name", "cause")
        .agg(
            F.sum("n").alias("n"),
            F.count("*").alias("kinds"),
            F.min(F.struct("first_line", "example")).alias("first"),
            F.max(F.struct("first_line", "example")).alias("last"),
        )
    )
    counts = F.transform(
        F.sort_array(F.collect_list(F.struct("cause", "n"))),
        lambda c: F.concat(c["cause"], F.lit(" x"), c["n"].cast("string")),
    )
    per_test = totals.groupBy("run_id", "test_name").agg(
        F.concat(
            F.sum("n").cast("string"), F.lit(" error lines of "), F.sum("kinds").cast("string"),
            F.lit(" kinds; first: "), F.min("first")["example"], F.lit("; last: "), F.max("last")["example"],
            F.lit("; likely causes: "), F.array_join(counts, ", "),
        ).alias("errors")
    )
    return failures.join(per_test, ["run_id", "test_name"], "left").select(
        "run_id", "test_name", "first_line",
        F.coalesce("errors", F.lit("no error lines")).alias("explanation"),
    )


def failure_reports(
    verdicts: DataFrame, explanations: DataFrame, context: DataFrame | None = None
) -> DataFrame:
    """(run_id, failure_report) of runs that did not pass.

    A run's text has one line per distinct failed test; all other detail stays in rows.
    """
    _, failed = passed_and_failed(verdicts)
    line = F.concat(F.lit("- "), F.col("test_name"), F.lit(": "), F.col("explanation"))
    ordered = F.sort_array(F.collect_list(F.struct("first_line", "test_name", line.alias("text"))))
    listed = explanations.groupBy("run_id").agg(
        F.array_join(F.transform(ordered, lambda r: r["text"]), "\n").alias("listed")
    )
    reports = failed.join(listed, "run_id", "left")
    text = F.concat(
        F.lit("Status: "), F.col("overall_status"), F.lit(" ("), F.col("notes"), F.lit(")\nFailed tests:\n"),
        F.coalesce("listed", F.lit("None identified")),
    )
    if context is not None:
        reports = reports.join(context, "run_id", "left")
        known = F.nullif(F.col("historical_context"), F.lit(""))
        text = F.concat(text, F.coalesce(F.concat(F.lit("\nHistory:\n"), known), F.lit("")))
    return reports.select("run_id", text.alias("failure_report"))


def plan_tickets(explanations: DataFrame) -> DataFrame:
    """One ticket per failed test of a run; (run_id, testcase) is the key, the id may repeat."""
    name = F.col("test_name")
    return explanations.select(
        "run_id",
        tx.ticket_id(name).alias("ticket_id"),
        F.concat(F.lit("Test failed: "), name).alias("summary"),
        F.concat(F.lit("Run "), F.col("run_id"), F.lit(": "), F.col("explanation")).alias("description"),
        name.alias("testcase"),
        F.lit(CREATED).alias("status"),
        "first_line",
    )


def ticket_results(results: DataFrame, tool: str = "create_jira_ticket") -> DataFrame:
    """Tickets from tool results (run_id, seq, name, content), as VARIANT; other tools are dropped."""
    from logloom.functions.json_text import json_or_raw

    return results.where(F.col("name") == tool).select(
        "run_id", "seq", json_or_raw(F.col("content")).alias("ticket")
    )


def with_and_without_tickets(runs: DataFrame, tickets: DataFrame) -> tuple[DataFrame, DataFrame]:
    planned = tickets.select("run_id")
    return runs.join(planned, "run_id", "left_semi"), runs.join(planned, "run_id", "left_anti")


def ticket_text(
    ticket_id: Column, summary: Column, status: Column, description: Column, details: Column
) -> Column:
    blank = F.lit("")
    block = F.when(details != "", F.concat(F.lit("\nDetails: "), details)).otherwise(blank)
    return F.concat(
        F.lit("Ticket: "), F.coalesce(ticket_id, F.lit("N/A")),
        F.lit("\nSummary: "), F.coalesce(summary, blank),
        F.lit("\nStatus: "), F.coalesce(status, blank),
        F.lit("\nDescription: "), F.coalesce(description, blank), block, F.lit("\n"),
    )


def ticket_lists(runs: DataFrame, tickets: DataFrame) -> DataFrame:
    """(run_id, n_tickets, tickets_text); runs without tickets say so."""
    def optional(name: str) -> Column:
        return F.col(name) if name in tickets.columns else F.lit(None).cast("string")

    text = ticket_text(
        F.col("ticket_id"), F.col("summary"), F.col("status"), F.col("description"),
        tx.ticket_details(optional("details"), optional("error_details")),
    )
    ordered = F.sort_array(F.collect_list(F.struct("first_line", "testcase", text.alias("text"))))
    listed = tickets.groupBy("run_id").agg(
        F.count("*").alias("n_tickets"),
        F.array_join(F.transform(ordered, lambda r: r["text"]), "\n").alias("listed"),
    )
    return runs.select("run_id").join(listed, "run_id", "left").select(
        "run_id",
        F.coalesce("n_tickets", F.lit(0)).alias("n_tickets"),
        F.coalesce("listed", F.lit("No Tickets Created")).alias("tickets_text"),
    )


def display_texts(runs: DataFrame) -> DataFrame:
    """Status, success and failure texts of runs (test_status, failed_list, summary_report, failure_report)."""
    bullets = F.array_join(F.transform("failed_list", lambda t: F.concat(F.lit("- "), t)), "\n")
    failed = F.when(F.size("failed_list") > 0, F.concat(F.lit("Failed Testcases\n"), bullets)).otherwise(
        F.lit("No Failed Tests")
    )
    return runs.select(
        "run_id",
        F.concat(
            F.lit("Test Status: "), F.upper(F.coalesce("test_status", F.lit("unknown"))), F.lit("\n"), failed
        ).alias("status_text"),
        F.concat(
            F.lit("Success Report\n"),
            F.coalesce(F.nullif("summary_report", F.lit("")), F.lit("No Success Report Generated")),
        ).alias("success_text"),
        F.concat(
            F.lit("Failure Report\n"),
            F.when(~tx.is_blank(F.col("failure_report")), F.col("failure_report"))
            .otherwise(F.lit("No Failure Report Generated")),
        ).alias("failure_text"),
    )
