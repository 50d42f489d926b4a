"""Memory of past runs: tips, thread history, messages, context text, outcome records."""

from pyspark.sql import Column, DataFrame, functions as F

from logloom.functions import text as tx
from logloom.operators.embed import EmbedderFactory, embed_texts
from logloom.operators.latest import as_of, latest_per_key
from logloom.operators.ordered import number_lines
from logloom.operators.skew import salted_lookup

# Worded here: the header of past issues in the context.
SEMANTIC_HEADER = "\n--- Semantic Memory ---\n"
# Namespace and key of the tips store, and the header of the tips.
TIPS_NAMESPACE = "global_tips"
LAST_SUCCESS = "last_success"
TIPS_HEADER = "\n--- Short-Term Memory (Global Tips) ---\n"
WHITE_SPACE = " \t\n\u000b\u000c\r"


def new_tips(runs: DataFrame, failures: DataFrame) -> DataFrame:
    """Tips a batch of runs writes: each failed test's own explanation, and a passed run's report as last_success.

    ``runs`` has run_id, test_status, report and updated_at, ``failures`` run_id, test_name and explanation. Reports hold
    the tips of earlier runs, so they are not stored as tips again.
    """
    reported = runs.where("report IS NOT NULL")
    per_test = reported.drop("report").join(
        failures.select("run_id", F.col("test_name").alias("key"), F.col("explanation").alias("report")), "run_id"
    )
    passed = (
        reported.where("test_status = 'passed'")
        .join(failures.select("run_id"), "run_id", "left_anti")
        .withColumn("key", F.lit(LAST_SUCCESS))
    )
    columns = ["key", F.col("report").alias("analysis"), "updated_at", "run_id"]
    return per_test.select(*columns).unionByName(passed.select(*columns)).select(
        F.lit(TIPS_NAMESPACE).alias("namespace"), "*"
    )


def latest_tips(tips: DataFrame) -> DataFrame:
    return latest_per_key(tips, ["namespace", "key"], ["updated_at", "run_id"])


def latest_runs(history: DataFrame) -> DataFrame:
    """The last state of each thread."""
    return latest_per_key(history, ["thread_id"], ["ts", "run_id"])


def runs_as_of(history: DataFrame, times: DataFrame) -> DataFrame:
    """The state in which each thread stood at a time: ``times`` is (thread_id, at)."""
    return as_of(history, ["thread_id"], ["ts", "run_id"], times)


def tips_for_failures(failures: DataFrame, tips: DataFrame) -> DataFrame:
    """(run_id, test_name, first_line, analysis); tests without a tip are left out.

    ``tips`` has one row per key. One test may fail in most runs, so its rows are spread.
    """
    lookup = tips.where(F.col("namespace") == TIPS_NAMESPACE).select(
        F.col("key").alias("test_name"), F.coalesce("analysis", F.lit("No details")).alias("analysis")
    )
    return salted_lookup(failures, lookup, "test_name", F.col("run_id"))


def merge_messages(messages: DataFrame) -> DataFrame:
    """History of each run: a later message with a known id replaces it in its place.

    Takes (run_id, seq, message_id, role, content) and returns rows numbered from 0.
    """
    kept = messages.groupBy("run_id", "message_id").agg(
        F.min("seq").alias("place"), F.max_by(F.struct("role", "content"), "seq").alias("m")
    )
    placed = kept.select(
        "run_id", "place", "message_id", "m.role", "m.content",
        F.floor(F.col("place") / 10_000).alias("slice"),
    )
    return number_lines(placed, "run_id", "slice", ["place", "message_id"], "seq").select(
        "run_id", "seq", "message_id", "role", "content"
    )


def prompt_messages(history: DataFrame, runs: DataFrame) -> DataFrame:
    """System message, history and human message of each run, in order.

    ``runs`` has run_id, system and human; ``history`` comes from ``merge_messages``.
    """
    lengths = history.groupBy("run_id").agg(F.count("*").alias("n"))
    sized = runs.join(lengths, "run_id", "left")
    first = sized.select("run_id", F.lit(0).cast("long").alias("seq"), F.lit("system").alias("role"), F.col("system").alias("content"))
    middle = history.join(runs.select("run_id"), "run_id", "left_semi").select(
        "run_id", (F.col("seq") + 1).alias("seq"), "role", "content"
    )
    last = sized.select(
        "run_id", (F.coalesce("n", F.lit(0)) + 1).alias("seq"), F.lit("human").alias("role"), F.col("human").alias("content")
    )
    return first.unionByName(middle).unionByName(last)


def assemble_context(runs: DataFrame, hits: DataFrame, tips: DataFrame, failures: DataFrame) -> DataFrame:
    """(run_id, historical_context) for failed runs.

    ``hits`` has run_id, rank, document, summary and resolution: at most k rows per run.
    ``tips`` has run_id, test_name, first_line, analysis: at most one row per failed test of the run.
    The tips header appears whenever the run has failed tests, found or not.
    """
    shown = F.coalesce("resolution", "summary", F.lit("N/A"))
    hit_text = F.concat(
        F.lit("Past Issue: "), F.coalesce("document", F.lit("")), F.lit("\nResolution/Analysis: "), shown, F.lit("\n\n")
    )
    semantic = hits.groupBy("run_id").agg(_in_order("rank", hit_text).alias("semantic"))
    tip_text = F.concat(F.lit("Tip for "), F.col("test_name"), F.lit(": "), F.col("analysis"), F.lit("\n"))
    tip_block = tips.groupBy("run_id").agg(_in_order("first_line", tip_text, "test_name").alias("tip_text"))
    with_tests = failures.groupBy("run_id").agg(F.lit(True).alias("has_tests"))
    joined = (
        runs.select("run_id").join(semantic, "run_id", "left")
        .join(with_tests, "run_id", "left").join(tip_block, "run_id", "left")
    )
    text = F.concat(
        F.coalesce(F.concat(F.lit(SEMANTIC_HEADER), "semantic"), F.lit("")),
        F.lit("\n"),
        F.when(F.col("has_tests"), F.concat(F.lit(TIPS_HEADER), F.coalesce("tip_text", F.lit(""))))
        .otherwise(F.lit("")),
    )
    return joined.select("run_id", F.btrim(text, F.lit(WHITE_SPACE)).alias("historical_context"))


def _in_order(order: str, text: Column, *ties: str) -> Column:
    """Texts of a group joined in the given order."""
    rows = F.sort_array(F.collect_list(F.struct(F.col(order), *ties, text.alias("text"))))
    return F.array_join(F.transform(rows, lambda r: r["text"]), "")


def outcome_records(
    runs: DataFrame, collection: str, make_embedder: EmbedderFactory | None = None, dim: int = 64
) -> DataFrame:
    """Index records of finished runs (run_id, log_content, test_status, failure_report, summary_report).

    Runs without a report are not committed. An ``embedding`` column that the runs already
    carry, from looking up their history, is used again. Logs too long for a row have no log_content, but a ``log_head`` and a
    ``log_digest``; their records have no document.
    """
    report = tx.chosen_report(F.col("failure_report"), F.col("summary_report"))
    log = F.col("log_content")
    head, content = (F.coalesce(log, F.col(c)) if c in runs.columns else log for c in ("log_head", "log_digest"))
    have = "embedding" in runs.columns
    records = runs.withColumn("report", report).where("report IS NOT NULL").select(
        "run_id",
        tx.record_id(F.lit(collection), F.lit("outcome"), F.col("run_id"), content).alias("id"),
        tx.prefix(head, tx.TEMPLATE_PREFIX).alias("template"),
        tx.severity_of_status(F.col("test_status")).alias("severity"),
        tx.prefix(F.col("report"), tx.SUMMARY_PREFIX).alias("summary"),
        tx.prefix(F.col("report"), tx.CAUSALITY_PREFIX).alias("causality"),
        F.lit(None).cast("string").alias("resolution"),
        F.lit(None).cast("string").alias("source"),
        log.alias("document"),
        F.lit(collection).alias("collection"),
        F.lit("outcome").alias("record_kind"),
        *(["embedding"] if have else []),
    )
    if have or make_embedder is None:
        return records
    return embed_texts(records, "document", make_embedder, dim, spread_by="id")
