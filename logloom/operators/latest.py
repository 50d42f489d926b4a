"""The last row of each key, and the state of a key as it was at a time."""

from pyspark.sql import DataFrame, Window, functions as F


def latest_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last written row of each key.

    The order columns alone decide first: their maximum combines before the shuffle, so a hot key is no problem. Only the winning rows then bring their
    other columns; equal rows count once, and of rows that tie in all order columns the largest wins.
    """
    others = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max(F.struct(*order)).alias("_last"))
    last = last.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], "_last")
    same = F.struct(*order).eqNullSafe(F.col("_last"))
    for i, c in enumerate(keys):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    winners = rows.join(last, same, "left_semi")
    return winners.groupBy(*keys).agg(F.max(F.struct(*others)).alias("_row")).select(*keys, "_row.*")


def as_of(rows: DataFrame, keys: list[str], order: list[str], times: DataFrame, at: str = "at") -> DataFrame:
    """For each row of ``times`` (keys, ``at``) the last row of its key whose first order column is not after ``at``; keys without one are left out.

    Rows and times of a key are merged in one order, and each time takes the last row before it: no row meets more than its neighbours.
    """
    value = F.struct(*rows.columns)
    events = rows.select(*keys, F.col(order[0]).alias("_t"), F.lit(0).alias("_kind"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], value.alias("_row"))
    none = [F.lit(None).cast(rows.schema[c].dataType).alias(f"_o{i}") for i, c in enumerate(order)]
    asked = times.select(*keys, F.col(at).alias("_t"), F.lit(1).alias("_kind"), *none, F.lit(None).cast(events.schema["_row"].dataType).alias("_row"))
    by = Window.partitionBy(*keys).orderBy("_t", "_kind", *[f"_o{i}" for i in range(len(order))]).rowsBetween(Window.unboundedPreceding, 0)
    seen = events.unionByName(asked).withColumn("_found", F.last("_row", ignorenulls=True).over(by))
    found = seen.where("_kind = 1 AND _found IS NOT NULL")
    others = [F.col(f"_found.{c}").alias(c) for c in rows.columns if c not in keys]
    return found.select(*keys, F.col("_t").alias(at), *others)
