"""Triage of a batch of logs: verdict, history, reports, tickets, memory."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from logloom.functions import text as tx
from logloom.operators import long_logs as ll, memory as mem, reports as rp, verdict as vd
from logloom.operators.embed import EmbedderFactory, embed_chunks, embed_texts
from logloom.operators.knn import knn_join, with_records
from logloom.operators.ordered import SLICE_LINES
from logloom.operators.skew import salted_lookup
from logloom.session import cut_lineage, drop_stored

HISTORY_HITS = 2  # fixed value: hits looked up per failed run


@dataclass
class Triage:
    runs: DataFrame  # one row per run, with reports
    failures: DataFrame  # one row per failed test
    tickets: DataFrame  # one row per failed test
    texts: DataFrame  # display texts per run
    tips: DataFrame  # to append to the tips table
    outcomes: DataFrame  # to append to the vector table
    error_details: DataFrame  # one row per failed test and kind of error
    rejected: DataFrame  # blank logs


def history_hits(runs: DataFrame, history: DataFrame, k: int = HISTORY_HITS) -> DataFrame:
    """Hits (run_id, rank, distance, document, summary, resolution) for embedded runs.

    Runs with the same vector are searched once.
    """
    queries = runs.groupBy("embedding").agg(F.min("run_id").alias("query_id"))
    vectors = history.select(F.col("id").alias("vec_id"), F.col("embedding").alias("vec"))
    hits = knn_join(queries.select("query_id", F.col("embedding").alias("query_vec")), vectors, k)
    records = history.select(F.col("id").alias("vec_id"), "document", "summary", "resolution")
    found = with_records(hits, records)
    run = F.col("run_id")
    same = salted_lookup(runs.select("run_id", "embedding"), queries, "embedding", run).select("run_id", "query_id")
    return salted_lookup(same, found, "query_id", run).select(
        "run_id", "rank", "distance", "document", "summary", "resolution"
    )


def triage_logs(
    logs: DataFrame,
    history: DataFrame,
    tips: DataFrame,
    make_embedder: EmbedderFactory,
    dim: int,
    collection: str = "log_templates",
    updated_at=None,
) -> Triage:
    """Triage whole logs (run_id, log_content) against the stored vectors and tips.

    History is read as it was before the batch: nothing is written here, and the caller
    appends ``tips`` and ``outcomes`` afterwards. Each log is embedded once, for both uses.
    """
    blank = tx.is_blank(F.col("log_content"))
    kept = cut_lineage(embed_texts(logs.where(~blank), "log_content", make_embedder, dim, spread_by="run_id"))
    return _triage(kept, vd.explode_logs(kept), logs.where(blank).select("run_id"), history, tips, collection, updated_at)


def triage_lines(
    lines: DataFrame,
    history: DataFrame,
    tips: DataFrame,
    make_embedder: EmbedderFactory,
    dim: int,
    collection: str = "log_templates",
    updated_at=None,
    document_chars: int = ll.DOCUMENT_CHARS,
    slice_lines: int = SLICE_LINES,
) -> Triage:
    """Triage logs that come as lines (run_id, line_no, line), whatever their length; line numbers are dense and start at 0.

    The same rows as ``triage_logs`` gives for the lines joined by newlines. Only logs of more than ``document_chars`` characters differ: their
    outcome has no document and an id from the lines' hashes.
    """
    stored = lines = cut_lineage(lines.select("run_id", "line_no", "line"))
    sizes = cut_lineage(ll.log_sizes(lines))
    rejected = sizes.where("n_filled = 0").select("run_id")
    filled = sizes.where("n_filled > 0")
    # joins with nothing would copy all lines
    taken = lines if rejected.isEmpty() else lines.join(rejected, "run_id", "left_anti")
    # logs that fit a row are embedded as whole texts, all others, and those with repeated or missing lines, by chunks
    whole = (F.col("n_chars") <= document_chars) & (F.col("n_lines") == F.col("last_line") + 1)
    digests = filled.select("run_id", F.col("digest").cast("string").alias("log_digest"), whole.alias("whole"))
    documents = ll.documents(taken, filled, document_chars).join(digests, "run_id")  # before embedding, as texts lie by run there
    vectors = embed_texts(documents.where("whole").drop("whole"), "log_content", make_embedder, dim)
    vectors = vectors.withColumn("log_head", tx.prefix(F.col("log_content"), tx.CHUNK_SIZE))
    chunks, rest = [], filled.where(~whole)
    if not rest.isEmpty():
        chunks = [cut_lineage(ll.log_chunks(taken.join(rest.select("run_id"), "run_id", "left_semi"), rest, slice_lines=slice_lines))]
        heads = chunks[0].where("chunk_no = 0").select("run_id", F.col("chunk").alias("log_head"))
        pooled = embed_chunks(chunks[0], "run_id", make_embedder, dim).join(heads, "run_id", "left").join(digests.drop("whole"), "run_id")
        vectors = vectors.unionByName(pooled.join(documents.where("NOT whole").select("run_id", "log_content"), "run_id", "left"))
    kept = cut_lineage(vectors)
    drop_stored(*chunks)
    return _triage(kept, taken, rejected, history, tips, collection, updated_at, stored, slice_lines)


def _triage(
    kept: DataFrame, lines: DataFrame, rejected: DataFrame, history: DataFrame, tips: DataFrame, collection: str, updated_at,
    stored: DataFrame | None = None, slice_lines: int | None = None,
) -> Triage:
    """Triage embedded logs ``kept``, a stored table, and their lines; no table of the result reads either again.

    With ``slice_lines`` names are looked for in the lines, not in the whole texts; ``stored`` is the table that these lines are read from.
    """
    facts = cut_lineage(vd.scan_lines(lines))
    outcomes = vd.per_test(vd.tests_of(facts))
    verdicts = cut_lineage(vd.verdict(facts, outcomes))
    failures = vd.failed_tests(outcomes)
    _, failed = rp.passed_and_failed(verdicts)
    failed_failures = failures.join(failed.select("run_id"), "run_id", "left_semi")

    hits = history_hits(kept.join(failed.select("run_id"), "run_id", "left_semi"), history)
    known = mem.tips_for_failures(failed_failures, mem.latest_tips(tips))
    context = mem.assemble_context(failed, hits, known, failed_failures)
    details = cut_lineage(rp.error_details(facts, failed_failures))
    explained = cut_lineage(rp.test_explanations(failed_failures, details))
    failure = rp.failure_reports(verdicts, explained, context)
    times, found = vd.run_times(lines), None
    if slice_lines is not None:  # only runs without a list need the pattern
        times = cut_lineage(times)
        found = cut_lineage(ll.failed_names(lines, slice_lines, failures.select("run_id")))
        drop_stored(stored)
    runs = (
        verdicts.join(kept.drop("n_chunks", "embed_error"), "run_id")
        .join(vd.failed_lists(failures), "run_id", "left")
        .join(context, "run_id", "left")
        .join(rp.pass_reports(verdicts, times), "run_id", "left")
        .join(failure, "run_id", "left")
        .withColumn("per_test", F.lit(None).cast("map<string,string>"))
    )
    if found is None:
        runs = vd.failed_with_fallback(runs)
    else:
        runs = vd.failed_with_fallback(runs.join(found, "run_id", "left"), F.col("found")).drop("found")
    runs = cut_lineage(runs.drop("per_test"))
    drop_stored(kept)
    stamp = updated_at if updated_at is not None else F.localtimestamp()
    reported = runs.select(
        "run_id", "test_status",
        tx.chosen_report(F.col("failure_report"), F.col("summary_report")).alias("report"),
        stamp.alias("updated_at"),
    )
    return Triage(
        runs=runs,
        failures=failures,
        tickets=rp.plan_tickets(explained),
        texts=rp.display_texts(runs).join(
            rp.ticket_lists(runs, rp.plan_tickets(explained)), "run_id"
        ),
        tips=mem.new_tips(reported, explained),
        error_details=details,
        outcomes=mem.outcome_records(runs, collection),
        rejected=rejected,
    )
