"""Bounded samples of labelled rows, and models that one task fits on them."""

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from logloom.llm import worker_memory
from logloom.session import cut_lineage

#: longer texts are not sampled (they are predicted like all others)
SAMPLED_BYTES = 65_536
#: log2 of the slices of the key range
SLICE_BITS = 12


def remainder(modulus: int) -> Column:
    """crc32 of doc_id as text, modulo ``modulus``; a null doc_id counts as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % modulus


def narrow(docs: DataFrame, max_bytes: int = SAMPLED_BYTES) -> DataFrame:
    """(doc_id, key) of the rows that may be sampled, with all columns but text; ``key`` is the text's hash."""
    short = docs.where(F.octet_length("text") <= max_bytes)
    return short.withColumn("key", F.xxhash64("text")).drop("text")


def smallest_keys(rows: DataFrame, per_class: int) -> DataFrame:
    """The rows of each label with keys up to the slice of the key range that holds its ``per_class``-th smallest key."""
    part = F.shiftright("key", 64 - SLICE_BITS)  # ascends with the key
    counts = rows.groupBy("label", part.alias("_part")).agg(F.count("*").alias("_c"))
    before = F.sum("_c").over(Window.partitionBy("label").orderBy("_part")) - F.col("_c")  # one row per slice
    last = counts.withColumn("_before", before).where(F.col("_before") < per_class).groupBy("label").agg(F.max("_part").alias("_last"))
    return rows.join(F.broadcast(last), "label").where(part <= F.col("_last")).drop("_last")  # one row per label


def sampled(docs: DataFrame, labelled: DataFrame, per_class: int) -> DataFrame:
    """Up to ``per_class`` rows (key, doc_id, text, label) of each label, with distinct texts, picked by the texts' hash.

    ``labelled`` is (doc_id, key, label) of rows of ``docs``, none of them null. Texts join only once the rows are picked: at most
    ``per_class`` rows for each label.
    """
    first = labelled.groupBy("label", "key").agg(F.min("doc_id").alias("doc_id"))
    picked = (
        smallest_keys(first, per_class).withColumn("_n", F.row_number().over(Window.partitionBy("label").orderBy("key")))
        .where(F.col("_n") <= per_class).drop("_n")
    )
    # as many rows as the sample has
    found = docs.select("doc_id", "text").withColumn("key", F.xxhash64("text")).join(F.broadcast(picked), ["doc_id", "key"])
    return found.dropDuplicates(["key", "label"]).select("key", "doc_id", "text", "label")


def text_sample(docs: DataFrame, labelled: DataFrame, per_class: int) -> list:
    """The rows (doc_id, text, label) of ``sampled`` on the driver."""
    return sampled(docs, labelled, per_class).orderBy("key", "label").select("doc_id", "text", "label").collect()


def stored_sample(docs: DataFrame, labelled: DataFrame, per_class: int) -> DataFrame | None:
    """The rows of ``sampled`` as a table, so that their texts never reach the driver; None if there are none."""
    sample = cut_lineage(sampled(docs, labelled, per_class))
    return None if sample.isEmpty() else sample


def in_task(sample: DataFrame, work: Callable[[list, list, list], bytes]) -> bytes:
    """What ``work`` makes of the doc_ids, texts and labels of a stored sample, in a task: the driver holds no more than the result.

    All of the sample is one group, a bounded number of bounded texts of each label.
    """

    def run(table: pa.Table) -> pa.Table:
        worker_memory.only()
        table = table.sort_by([("key", "ascending"), ("label", "ascending")])
        made = work(*(table[c].to_pylist() for c in ("doc_id", "text", "label")))
        worker_memory.only()
        return pa.table({"made": pa.array([made], pa.binary())})

    return bytes(sample.withColumn("part", F.lit(0)).groupBy("part").applyInArrow(run, "made binary").collect()[0][0])
