"""What triage needs of a log's whole text, for logs that come as lines (run_id, line_no, line).

The text of a log is its lines joined by a newline. A log may be longer than any row: chunks, matches across lines and digests are made from
bounded slices of its lines.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from logloom.functions import text as tx
from logloom.operators.ordered import SLICE_LINES, latest_marker, number_lines, running_total
from logloom.session import cut_lineage

DOCUMENT_CHARS = 64_000_000  # longer logs have no document column; their lines stay where they are
MARK = "TESTCASE:"


def log_sizes(lines: DataFrame) -> DataFrame:
    """(run_id, last_line, n_lines, n_chars, n_filled, digest) of each log; ``digest`` depends on all lines and their places."""
    return lines.groupBy("run_id").agg(
        F.max("line_no").alias("last_line"),
        F.count("line").alias("n_lines"),
        (F.sum(F.length("line") + 1) - 1).alias("n_chars"),
        F.count_if(~tx.is_blank(F.col("line"))).alias("n_filled"),
        F.expr("bit_xor(xxhash64(line_no, line))").alias("digest"),
    )


def log_chunks(
    lines: DataFrame, sizes: DataFrame, size: int = tx.CHUNK_SIZE, overlap: int = tx.CHUNK_OVERLAP, slice_lines: int = SLICE_LINES
) -> DataFrame:
    """(run_id, chunk_no, chunk): the same as ``chunks_of`` gives for the whole text.

    Every line is cut at the chunks' borders; a chunk collects at most ``size`` characters.
    """
    step = size - overlap
    placed = running_total(lines.select("run_id", "line_no", "line"), "run_id", "line_no", F.length("line") + 1, "at", slice_lines)
    placed = placed.join(sizes.select("run_id", "last_line"), "run_id").select(
        "run_id", "at",
        F.when(F.col("line_no") == F.col("last_line"), F.col("line")).otherwise(F.concat("line", F.lit("\n"))).alias("text"),
    )
    end = F.col("at") + F.length("text")
    first = F.greatest(F.lit(0), F.floor((F.col("at") - size) / step) + 1)
    last = F.floor((end - 1) / step)
    cut = placed.where(F.length("text") > 0).select(
        "run_id", "at", "text", F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("chunk_no")
    )
    start = F.greatest(F.lit(0), F.col("chunk_no") * step - F.col("at"))
    stop = F.least(F.length("text"), F.col("chunk_no") * step + size - F.col("at"))
    pieces = cut.select(
        "run_id", "chunk_no", (F.col("at") + start).alias("at"), F.substring("text", (start + 1).cast("int"), (stop - start).cast("int")).alias("piece")
    )
    ordered = F.sort_array(F.collect_list(F.struct("at", "piece")))
    return pieces.groupBy("run_id", "chunk_no").agg(F.array_join(F.transform(ordered, lambda p: p["piece"]), "").alias("chunk"))


def documents(lines: DataFrame, sizes: DataFrame, most_chars: int = DOCUMENT_CHARS) -> DataFrame:
    """(run_id, log_content) of the logs of at most ``most_chars`` characters; all logs of ``lines`` have a row in ``sizes``."""
    if sizes.where(F.col("n_chars") > most_chars).isEmpty():  # else a join copies all lines for nothing
        short = lines.where("run_id IS NOT NULL")
    else:
        short = lines.join(sizes.where(F.col("n_chars") <= most_chars).select("run_id"), "run_id", "left_semi")
    ordered = F.sort_array(F.collect_list(F.struct("line_no", "line")))
    joined = short.groupBy("run_id").agg(ordered.alias("lines"))
    return joined.select("run_id", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("log_content"))


def failed_names(lines: DataFrame, slice_lines: int = SLICE_LINES, known: DataFrame | None = None) -> DataFrame:
    """(run_id, found): what ``failed_testcases`` finds in the whole text, in order; runs without a match are left out.

    A name stands on one line, but white space around it may hold line breaks. So a match can only go on to the next filled line if the mark ends its
    line, or if that line starts with FAILED; lines tied like this form islands, and each island is searched on its own. Only logs that hold both words
    somewhere are looked at, and none of ``known`` (run_id).
    """
    words = lines.groupBy("run_id").agg(F.max(F.col("line").contains(MARK)).alias("mark"), F.max(F.col("line").contains("FAILED")).alias("failed"))
    wanted = words.where("mark AND failed").select("run_id")
    wanted = cut_lineage(wanted if known is None else wanted.join(known, "run_id", "left_anti"))  # lines move for these logs only, if they are few
    lines = lines.join(wanted, "run_id", "left_semi")
    filled = lines.where(~tx.is_blank(F.col("line"))).select("run_id", "line_no", "line")
    filled = filled.withColumn("_slice", F.floor(F.col("line_no") / slice_lines))
    numbered = number_lines(filled, "run_id", "_slice", ["line_no"], "k").drop("_slice", "line_no")
    line = F.col("line")
    marked = numbered.select(
        "run_id", "k", "line", line.contains(MARK).alias("has"), line.rlike(r"(?U)TESTCASE:\s*$").alias("ends"),
        line.rlike(r"(?U)^\s*FAILED").alias("starts"), F.floor(F.col("k") / slice_lines).alias("slice"), F.lit(True).alias("own"),
    )
    # the last two lines of a slice are shown to the next one too
    shown = marked.where(F.col("k") % slice_lines >= slice_lines - 2).withColumn("slice", F.col("slice") + 1).withColumn("own", F.lit(False))
    shown = shown.withColumn("line", F.lit(None).cast("string"))
    order = Window.partitionBy("run_id", "slice").orderBy("k")

    def before(name: str, n: int) -> Column:
        return F.coalesce(F.lag(name, n).over(order), F.lit(False))

    tied = before("ends", 1) | F.col("starts") & (before("has", 1) | before("ends", 2))
    linked = marked.unionByName(shown).withColumn("tied", tied).where("own")
    kept = latest_marker(linked.select("run_id", "k", "line", "has", "tied"), ~F.col("tied"), line_no="k", out="island", slice_lines=slice_lines)
    kept = kept.where("has OR tied")
    ordered = F.sort_array(F.collect_list(F.struct("k", "line")))
    islands = kept.groupBy("run_id", "island").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))
    found = islands.select("run_id", "island", F.posexplode(tx.failed_testcases(F.col("text"))).alias("pos", "name"))
    names = F.sort_array(F.collect_list(F.struct("island", "pos", "name")))  # the list is one value of the run's record
    return found.groupBy("run_id").agg(F.transform(names, lambda x: x["name"]).alias("found"))
