"""Run logs derived from the ``events`` and ``documents`` tables."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from logloom.operators.ordered import number_lines


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


EVENT_LINES = """
WITH stamped AS (
  SELECT ts, event_id, user_id, event_type, substring(CAST(ts AS STRING), 1, 19) AS stamp FROM {events}),
named AS (
  SELECT *, concat('run_', user_id, '_', replace(substring(stamp, 1, 10), '-', '')) AS run_id,
    concat('test_', event_type, '_', event_id % 7) AS test, user_id % 17 <> 0 AS tested,
    CASE WHEN event_type = 'error' THEN 'FAILED' WHEN event_id % 11 = 0 THEN 'SKIPPED' ELSE 'PASSED' END AS status
  FROM stamped),
worded AS (
  SELECT *, CASE WHEN NOT tested THEN concat('[', stamp, '] INFO heartbeat ', event_id)
      WHEN user_id % 2 = 0 THEN concat('[', stamp, '] TESTCASE: ', test, ' ', status)
      ELSE concat('Test case ', test, ': ', status) END AS main
  FROM named),
body AS (
  SELECT run_id, 0 AS blk, ts, event_id, posexplode(array(
      main,
      CASE WHEN tested AND status = 'FAILED' THEN concat('Error: code ', event_id % 5, ' value ', event_id) END,
      CASE WHEN tested AND event_id % 5 = 0 THEN 'Output validation PASSED' END,
      CASE WHEN tested AND event_id % 13 = 0 THEN main END)) AS (k, line)
  FROM worded),
totals AS (
  SELECT run_id, max(ts) AS ts, max(event_id) AS event_id, count(*) AS n,
    count_if(status = 'PASSED') AS p, count_if(status = 'FAILED') AS f
  FROM named WHERE user_id % 3 = 0 AND tested GROUP BY run_id),
endings AS (
  SELECT run_id, 1 AS blk, ts, event_id, posexplode(array('TEST EXECUTION SUMMARY',
      concat('Total test cases: ', n + 1), concat('Passed: ', n + 1), 'Failed: 0', 'Pass rate: 100.0')) AS (k, line)
  FROM totals
  UNION ALL
  SELECT run_id, 2 AS blk, ts, event_id, posexplode(array('TEST EXECUTION SUMMARY',
      concat('Total test cases: ', n), concat('Passed: ', p), concat('Failed: ', f))) AS (k, line)
  FROM totals)
SELECT *, blk * 1000000000L + unix_micros(CAST(ts AS TIMESTAMP)) DIV 60000000 AS slice
FROM (SELECT * FROM body WHERE line IS NOT NULL UNION ALL SELECT * FROM endings)
"""


def event_lines(events: DataFrame) -> DataFrame:
    """One run per user and day, with unnumbered lines: (run_id, line) and the columns that order them.

    Each event writes up to four lines; some runs end with two summary blocks, the first of them wrong.
    """
    return events.sparkSession.sql(EVENT_LINES, events=events)


def event_log_lines(events: DataFrame) -> DataFrame:
    """(run_id, line_no, line). Lines are numbered by minute slices, so no run needs one task."""
    lines = event_lines(events)
    return number_lines(lines, "run_id", "slice", ["blk", "ts", "event_id", "k"]).select(
        "run_id", "line_no", "line"
    )


def document_logs(documents: DataFrame) -> DataFrame:
    """One whole log per document, made row by row: (run_id, doc_id, log_content).

    Every third line of a document becomes a test line and the one after it an
    error line; documents with ``doc_id % 11 = 0`` keep their text, so they hold no test.
    """
    doc = F.col("doc_id")
    status = lambda i: (
        F.when(doc % 4 == 0, "PASSED")
        .when((doc + i) % 5 == 0, "FAILED")
        .when((doc + i) % 7 == 0, "SKIPPED")
        .otherwise("PASSED")
    )

    def tagged(line, i):
        test = F.concat(
            F.lit("[2024-06-01 10:"), F.lpad((F.floor(i / 60) % 60).cast("string"), 2, "0"), F.lit(":"),
            F.lpad((i % 60).cast("string"), 2, "0"), F.lit("] TESTCASE: test_error_"),
            (i % 9).cast("string"), F.lit(" "), status(i), F.lit("\n"), line,
        )
        return F.when(i % 3 == 0, test).when(i % 3 == 1, F.concat(F.lit("Error: "), line)).otherwise(line)

    marked = F.array_join(F.transform(F.split("text", "\n"), tagged), "\n")
    return documents.select(
        F.concat(F.lit("doc_"), doc.cast("string")).alias("run_id"),
        "doc_id",
        F.when(doc % 11 == 0, F.col("text")).otherwise(marked).alias("log_content"),
    )
