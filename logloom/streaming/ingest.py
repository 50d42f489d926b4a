"""Triage of logs as they arrive, by the same batch functions."""

import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from logloom import schemas
from logloom.functions import text as tx
from logloom.operators.embed import EmbedderFactory
from logloom.operators.memory import runs_as_of
from logloom.plans.triage import triage_logs
from logloom.session import cut_lineage
from logloom.sources import tables
from logloom.sources.files import run_name


#: files of any age count as new when they appear
EVER = "36500d"


def log_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """(run_id, log_content) of each file that appears in the folder, whatever its time stamp.

    The stream's own record of file paths keeps a file from being read twice; run_id is the path
    below the folder.
    """
    return (
        spark.readStream.format("text")
        .option("wholetext", True)
        .option("maxFilesPerTrigger", files_per_batch)
        .option("maxFileAge", EVER)
        .load(folder)
        .select(run_name(folder), F.col("value").alias("log_content"))
    )


#: what a batch writes, each in folders by batch_id
SINKS = ("runs", "tickets", "error_details", "rejected", "batch_tips", "outcomes", "run_history")


def committed(spark: SparkSession, store: str, name: str) -> DataFrame:
    """Rows of a sink that belong to batches with a commit marker; half-written batches do not show."""
    return spark.read.parquet(f"{store}/{name}").join(spark.read.parquet(f"{store}/commits").select("batch_id"), "batch_id", "left_semi")


def thread_states(spark: SparkSession, store: str, times: DataFrame) -> DataFrame:
    """The last state of each thread at a time, from the committed batches: ``times`` is (thread_id, at)."""
    history = committed(spark, store, "run_history").select(*[f.name for f in schemas.RUN_HISTORY])
    return runs_as_of(history, times)


def promote(spark: SparkSession, store: str) -> None:
    """Merge the tips of all committed batches into the tips that later runs look up. Doing it again changes nothing."""
    if not tables.exists(spark, f"{store}/commits"):
        return
    marks, done = spark.read.parquet(f"{store}/commits").select("batch_id", "attempt"), f"{store}/promoted"
    if tables.exists(spark, done):
        marks = marks.join(spark.read.parquet(done), ["batch_id", "attempt"], "left_anti")
    marks = cut_lineage(marks)
    if marks.isEmpty():
        return
    tips = spark.read.parquet(f"{store}/batch_tips").join(marks.select("batch_id"), "batch_id", "left_semi")
    tables.put_tips(tips, f"{store}/tips")
    marks.coalesce(1).write.mode("append").parquet(done)


def triage_batch(
    store: str, make_embedder: EmbedderFactory, dim: int, as_of: datetime | None = None
) -> Callable[[DataFrame, int], None]:
    """Handler of micro-batches.

    Every batch replaces its own folder of each sink and sets its commit marker last, so a batch that is run again leaves the same tables. A batch looks up
    the vectors and tips of what was there before ``as_of`` (the time the handler is made), not of its fellow batches: batches may run in any order.
    """
    as_of = as_of or datetime.now(timezone.utc).replace(tzinfo=None)

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        history = tables.open_collection(spark, f"{store}/vectors")
        tips = tables.open_table(spark, f"{store}/tips", schemas.TIPS)
        logs = cut_lineage(batch.select("run_id", "log_content"))
        if tables.exists(spark, f"{store}/commits"):
            marks = spark.read.parquet(f"{store}/commits")
            # runs of other batches are not triaged again
            logs = logs.join(committed(spark, store, "runs").where(F.col("batch_id") != batch_id).select("run_id"), "run_id", "left_anti")
            # vectors of batches since then, and of this one, are not history yet
            late = marks.where((F.col("committed_at") >= F.lit(as_of)) | (F.col("batch_id") == batch_id)).select("batch_id")
            fellows = spark.read.parquet(f"{store}/outcomes").join(late, "batch_id", "left_semi").select("id")
            history = history.join(fellows, "id", "left_anti")
        done = triage_logs(logs, history, tips, make_embedder, dim, updated_at=F.lit(as_of).cast("timestamp_ntz"))
        verdicts = done.runs.select(
            "run_id", "overall_status", "test_status", "total", "passed", "failed", "pass_rate", "notes",
            "summary_report", "failure_report",
        )
        folder = F.nullif(F.regexp_extract("run_id", "^(.*)/", 1), F.lit(""))  # logs of one folder are one thread
        states = done.runs.select(
            F.coalesce(folder, F.col("run_id")).alias("thread_id"), "run_id", F.lit(as_of).cast("timestamp_ntz").alias("ts"), "test_status",
            tx.chosen_report(F.col("failure_report"), F.col("summary_report")).alias("report"),
        )
        sinks = (verdicts, done.tickets.drop("first_line"), done.error_details, done.rejected, done.tips, done.outcomes, states)
        for name, rows in zip(SINKS, sinks):
            rows.write.mode("overwrite").parquet(f"{store}/{name}/batch_id={batch_id}")
        tables.append_vectors(spark.read.parquet(f"{store}/outcomes/batch_id={batch_id}"), f"{store}/vectors")
        mark = spark.range(1).select(F.lit(uuid.uuid4().hex).alias("attempt"), F.localtimestamp().alias("committed_at"))
        mark.coalesce(1).write.mode("overwrite").parquet(f"{store}/commits/batch_id={batch_id}")

    return handle


def start_triage(
    logs: DataFrame, store: str, checkpoint: str, make_embedder: EmbedderFactory, dim: int
) -> StreamingQuery:
    """Work off everything that has arrived, then stop; run it on a schedule or change the trigger.

    The stream's keyed state remembers the runs it has seen, so a run that arrives twice is triaged once. Tips of earlier calls are merged first.
    """
    promote(logs.sparkSession, store)
    return (
        logs.dropDuplicates(["run_id"]).writeStream.foreachBatch(triage_batch(store, make_embedder, dim))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
