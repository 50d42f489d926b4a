"""Order-dependent steps inside a run, for runs too long for one task.

A window over a whole run puts that run into one task. These helpers cut a run
into slices, do the window inside a slice, and pass one row per slice on.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

SLICE_LINES = 50_000


def number_lines(
    df: DataFrame, run: str, slice_: str, order: list[str], out: str = "line_no"
) -> DataFrame:
    """Dense 0-based position of every row in its run.

    ``slice_`` must be a column that never falls while ``order`` rises, such as
    the minute of the line or the offset of its file split.
    """
    inside = Window.partitionBy(run, slice_).orderBy(*order)
    earlier = (
        Window.partitionBy(run).orderBy(slice_).rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = (
        df.groupBy(run, slice_)
        .agg(F.count("*").alias("_n"))
        .select(run, slice_, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    )
    return (
        df.withColumn("_i", F.row_number().over(inside) - 1)
        .join(starts, [run, slice_])
        .withColumn(out, (F.col("_start") + F.col("_i")).cast("long"))
        .drop("_i", "_start")
    )


def latest_marker(
    df: DataFrame,
    is_marker: Column,
    run: str = "run_id",
    line_no: str = "line_no",
    out: str = "marker_no",
    slice_lines: int = SLICE_LINES,
) -> DataFrame:
    """Add the line number of the last marker line at or before each line."""
    df = df.withColumn("_slice", F.floor(F.col(line_no) / slice_lines)).withColumn(
        "_mark", F.when(is_marker, F.col(line_no))
    )
    up_to_here = (
        Window.partitionBy(run, "_slice")
        .orderBy(line_no)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    earlier = (
        Window.partitionBy(run).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = (
        df.groupBy(run, "_slice")
        .agg(F.max("_mark").alias("_last"))
        .select(run, "_slice", F.max("_last").over(earlier).alias("_carried"))
    )
    return (
        df.withColumn("_here", F.max("_mark").over(up_to_here))
        .join(carried, [run, "_slice"])
        .withColumn(out, F.coalesce("_here", "_carried"))
        .drop("_slice", "_mark", "_here", "_carried")
    )


def running_total(
    df: DataFrame, run: str, line_no: str, size: Column, out: str, slice_lines: int = SLICE_LINES
) -> DataFrame:
    """Add the sum of ``size`` over the earlier lines of the run."""
    df = df.withColumn("_slice", F.floor(F.col(line_no) / slice_lines)).withColumn("_size", size)
    inside = Window.partitionBy(run, "_slice").orderBy(line_no).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(run).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        df.groupBy(run, "_slice").agg(F.sum("_size").alias("_n"))
        .select(run, "_slice", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    )
    here = F.coalesce(F.sum("_size").over(inside), F.lit(0))
    return df.withColumn("_here", here).join(starts, [run, "_slice"]).withColumn(out, F.col("_start") + F.col("_here")).drop(
        "_slice", "_size", "_here", "_start"
    )


def neighbours(
    spots: DataFrame, lines: DataFrame, before: int, after: int, run: str = "run_id"
) -> DataFrame:
    """Lines around given spots, found by equality on (run, line_no).

    ``spots`` has (run, line_no) and any other columns; the result repeats them
    once per line found, with its ``offset`` and ``line``.
    """
    wanted = spots.withColumn(
        "offset", F.explode(F.sequence(F.lit(-before), F.lit(after)))
    ).withColumn("_at", F.col("line_no") + F.col("offset"))
    found = lines.select(F.col(run), F.col("line_no").alias("_at"), "line")
    return wanted.join(found, [run, "_at"]).drop("_at")
