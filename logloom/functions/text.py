"""String columns: decoding, guards, chunking, prefixes, ids."""

from pyspark.sql import Column, functions as F

# Fixed values of the chunker and the report prefixes.
CHUNK_SIZE = 800
CHUNK_OVERLAP = 100
TEMPLATE_PREFIX = 500
SUMMARY_PREFIX = 200
CAUSALITY_PREFIX = 500
TICKET_BUCKETS = 10000

# Fixed value: the failed-test pattern. (?d) keeps "." from stopping at \r, (?U) lets \s match every Unicode space.
FAILED_TESTCASE = r"(?d)(?U)TESTCASE:\s*(.*?)\s*FAILED"


def is_blank(text: Column) -> Column:
    """True when the text is missing or holds white space only (trim strips spaces only)."""
    return ~F.coalesce(text.rlike(r"(?U)\S"), F.lit(False))


def decode_utf8(content: Column) -> Column:
    """Bytes to text, leaving out what is not UTF-8 (and genuine U+FFFD)."""
    return F.replace(F.make_valid_utf8(content.cast("string")), F.lit("�"), F.lit(""))


def failed_testcases(log: Column) -> Column:
    """Every ``TESTCASE: <name> FAILED`` of a whole log, in order, repeats kept."""
    return F.regexp_extract_all(log, F.lit(FAILED_TESTCASE), 1)


def lines_of(text: Column) -> Column:
    # one kind of line end first: Java splits at a single character without a pattern
    plain = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.split(plain, "\n")


def prefix(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def none_if_empty(array: Column) -> Column:
    return F.when(F.size(array) > 0, array)


def joined_or(array: Column, empty: str) -> Column:
    """Newline join with a text for the empty case."""
    return F.when(F.size(array) > 0, F.array_join(array, "\n")).otherwise(F.lit(empty))


def stable_hash(text: Column) -> Column:
    """The first 32 bits of md5 as a non-negative BIGINT; the same in every engine."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def ticket_id(testcase: Column) -> Column:
    return F.concat(F.lit("TEST-"), (stable_hash(testcase) % TICKET_BUCKETS).cast("string"))


def record_id(*parts: Column) -> Column:
    """A repeatable id, so that a retried append can be recognised."""
    return F.sha2(F.concat_ws("\u0001", *parts), 256)


def chunks_of(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Overlapping slices, one every ``size - overlap`` characters; [] for no text."""
    step = size - overlap
    last = F.floor((F.length(text) - 1) / step).cast("int")
    slices = F.transform(
        F.sequence(F.lit(0), last), lambda i: F.substring(text, i * step + 1, F.lit(size))
    )
    return F.when(F.length(text) > 0, slices).otherwise(F.array().cast("array<string>"))


def severity_of_status(status: Column) -> Column:
    return F.when(status == "failed", F.lit("high")).otherwise(F.lit("low"))


def collapse_status(overall: Column) -> Column:
    """Only ALL_PASSED passes; SOME_FAILED, UNKNOWN and NULL all fail."""
    return F.when(overall == "ALL_PASSED", F.lit("passed")).otherwise(F.lit("failed"))


def chosen_report(failure: Column, summary: Column) -> Column:
    """The failure report, else the pass summary, else NULL; '' counts as missing."""
    return F.coalesce(F.nullif(failure, F.lit("")), F.nullif(summary, F.lit("")))


def ticket_details(details: Column, error_details: Column) -> Column:
    return F.coalesce(details, error_details, F.lit(""))
