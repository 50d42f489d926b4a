"""Log and SME files."""

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logloom import schemas
from logloom.functions import text as tx
from logloom.operators.ordered import number_lines


# The messages about the expert table.
NO_SME = "No SME reference data provided."
SME_LOADED = "Successfully loaded SME reference data from {}."


def run_name(folder: str) -> Column:
    """run_id of a file: its decoded path below the input folder, ending included."""
    whole = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    root = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:/*", "/", folder).rstrip("/") + "/"
    at = F.instr(whole, root)
    below = F.substr(whole, at + len(root), F.length(whole))
    return F.when(at > 0, below).otherwise(F.element_at(F.split(whole, "/"), -1)).alias("run_id")


def pasted_logs(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    """Logs typed in by hand: one (run_id, log_text) per run."""
    return spark.createDataFrame(rows, "run_id string, log_text string")


def uploaded_logs(spark: SparkSession, folder: str) -> DataFrame:
    """(run_id, file_text) of every .txt or .log file, in upper or lower case."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{[tT][xX][tT],[lL][oO][gG]}").load(folder)
    return files.select(run_name(folder), tx.decode_utf8(F.col("content")).alias("file_text"))


def choose_input(pasted: DataFrame, uploaded: DataFrame) -> DataFrame:
    """One log per run; an uploaded file wins over pasted text, and no text is ''."""
    return pasted.join(uploaded, "run_id", "full_outer").select(
        "run_id", F.coalesce("file_text", "log_text", F.lit("")).alias("log_content")
    )


def split_blank(logs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(logs to analyse, rejected blank logs with a warning)."""
    blank = tx.is_blank(F.col("log_content"))
    rejected = logs.where(blank).select("run_id", F.lit("Please paste some logs first.").alias("warning"))
    return logs.where(~blank), rejected


def read_whole_logs(spark: SparkSession, folder: str) -> DataFrame:
    """One row per file; for files that fit into a row."""
    return spark.read.text(folder, wholetext=True).select(run_name(folder), F.col("value").alias("log_content"))


def read_log_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(run_id, line_no, line) of files of any size; a big file is read by many tasks.

    Within a split the row ids rise with the file position, and splits are ordered by offset.
    """
    rows = spark.read.text(folder).select(
        run_name(folder),
        F.col("_metadata.file_block_start").alias("split_start"),
        F.monotonically_increasing_id().alias("row_id"),
        F.col("value").alias("line"),
    )
    return number_lines(rows, "run_id", "split_start", ["row_id"]).select("run_id", "line_no", "line")


def read_sme(spark: SparkSession, path: str | None, file_format: str = "csv") -> tuple[DataFrame, str]:
    """The expert table and a message; a missing or unreadable path, or one without a column, gives an empty table.

    Columns are taken by name, in any order and case.
    """
    empty = spark.createDataFrame([], schemas.SME)
    if not path:
        return empty, NO_SME
    reader = spark.read
    if file_format == "csv":
        reader = reader.option("header", True).option("multiLine", True).option("escape", '"')
    try:
        rows = reader.format(file_format).load(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return empty, NO_SME
        return empty, f"Error loading SME table: {error.getCondition()}"
    named = {c.strip().lower(): c for c in rows.columns}
    missing = [f for f in empty.columns if f not in named]
    if missing:
        return empty, f"Error loading SME table: no column {', '.join(missing)}"
    columns = [F.col(f"`{named[f]}`").cast("string").alias(f) for f in empty.columns]
    return rows.select(*columns), SME_LOADED.format(path)
