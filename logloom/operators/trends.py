"""Issue trends: gap-filled time series per key, and where their level changes."""

from pyspark.sql import DataFrame, Window, functions as F


def time_series(rows: DataFrame, key: str, ts: str, bucket: str = "hour") -> DataFrame:
    """(key, bucket, n): rows of each key in each bucket from the first to the last of the whole table; empty buckets count 0.

    Rows are counted before anything else, so a key that holds most rows is no more than its buckets.
    """
    counts = rows.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).groupBy(key, F.date_trunc(bucket, ts).alias("bucket")).agg(F.count("*").alias("n"))
    # two numbers of the whole table, taken over one row per key
    ends = counts.groupBy(key).agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi"))
    everywhere = Window.partitionBy()
    span = F.sequence(F.min("lo").over(everywhere), F.max("hi").over(everywhere), F.expr(f"INTERVAL 1 {bucket}"))
    grid = ends.select(key, span.alias("buckets")).select(key, F.explode("buckets").alias("bucket"))
    return grid.join(counts, [key, "bucket"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def change_points(series: DataFrame, key: str) -> DataFrame:
    """Series rows with ``place`` (from 1), ``deviation`` and ``is_change``.

    The deviation is the running sum of the counts less their mean, times the number of buckets (so it stays whole). It turns where the level changes:
    the bucket with the largest absolute value is the last one of the old level. Ties go to the earlier bucket; a level series has no change.
    """
    whole = Window.partitionBy(key)
    order = whole.orderBy("bucket")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    placed = series.select(
        "*", F.row_number().over(order).cast("long").alias("place"), F.sum("n").over(so_far).alias("_sum"),
        F.sum("n").over(whole).alias("_total"), F.count("*").over(whole).alias("_buckets"),
    )
    moved = placed.withColumn("deviation", F.col("_buckets") * F.col("_sum") - F.col("place") * F.col("_total"))
    strongest = Window.partitionBy(key).orderBy(F.abs("deviation").desc(), "place")
    return moved.withColumn("is_change", (F.row_number().over(strongest) == 1) & (F.col("deviation") != 0)).drop("_sum", "_total", "_buckets")


def levels(points: DataFrame, key: str) -> DataFrame:
    """(key, change_at, before, after): mean count up to the change and behind it; no row for a level series."""
    at = points.where("is_change").select(key, F.col("bucket").alias("change_at"))
    joined = points.join(at, key)
    early = F.col("bucket") <= F.col("change_at")
    return joined.groupBy(key, "change_at").agg(
        F.avg(F.when(early, F.col("n"))).alias("before"), F.avg(F.when(~early, F.col("n"))).alias("after")
    )
