"""Lookup joins whose probing side may have very frequent keys."""

from pyspark.sql import Column, DataFrame, functions as F

from logloom.session import cut_lineage

HOT_ROWS = 1_000_000  # rows of one key that a task may hold; a key with more is spread
LISTED_KEYS = 100_000  # hot keys up to this number are broadcast


def hot_keys(rows: DataFrame, keys: list[str], hot_rows: int) -> DataFrame:
    """(keys, salts): the keys with more than ``hot_rows`` rows, and over how many salts to spread them."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > hot_rows)
    return counts.select(*keys, F.ceil(F.col("_n") / hot_rows).cast("int").alias("_salts"))


def repeated(lookup: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    """Lookup rows with ``_salt``: once for each salt of a hot key, once for every other key."""
    last = F.coalesce("_salts", F.lit(1)) - 1
    return lookup.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), last))).drop("_salts")


def salted_lookup(
    rows: DataFrame,
    lookup: DataFrame,
    key: str | list[str],
    spread_by: Column,
    how: str = "inner",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join ``rows`` to a table with one or a few rows per key.

    Keys are counted first. Rows of a hot key are spread over salts by ``spread_by`` and only these keys' lookup rows are repeated; without hot keys
    this is a plain join. A lookup row whose key no row asks for is left out before anything is repeated.
    """
    keys = [key] if isinstance(key, str) else key
    rows = cut_lineage(rows)
    if rows.count() <= hot_rows:  # no key can be hot
        return rows.join(lookup, keys, how)
    hot = cut_lineage(hot_keys(rows, keys, hot_rows))
    n_hot = hot.count()
    if n_hot == 0:
        return rows.join(lookup, keys, how)
    if n_hot <= LISTED_KEYS:
        hot = F.broadcast(hot)
    asked = lookup.join(rows.select(*keys).distinct(), keys, "left_semi")
    salts = F.coalesce("_salts", F.lit(1))
    spread = rows.withColumn("_spread", F.xxhash64(spread_by)).join(hot, keys, "left")
    spread = spread.withColumn("_salt", F.pmod("_spread", salts).cast("int")).drop("_spread", "_salts")
    return spread.join(repeated(asked, hot, keys), [*keys, "_salt"], how).drop("_salt")
