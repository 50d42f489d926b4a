"""Documents that hold benchmark items, found by greedy string tiling.

Shared word n-grams of documents and items are joined as seeds. Each pair with enough seeds is tiled: the longest common
run of words that is not covered yet is marked, again and again, by running Karp-Rabin matching with falling length. The
share of the item that the tiles cover is its coverage, in whatever order a document has the passages.
"""

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from logloom.llm import hash_arrays, worker_memory, words
from logloom.llm.hash_arrays import text_key
from logloom.session import cut_lineage, shared_folder

LEAST_WORDS = 5
COVERAGE = 0.5


def _matches(a: np.ndarray, b: np.ndarray, free_a: np.ndarray, free_b: np.ndarray, s: int) -> list[tuple[int, int, int]]:
    """Maximal common runs (length, start in a, start in b) of at least ``s`` words that nothing covers."""

    def windows(x: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(x) < s:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        covered = np.r_[0, np.cumsum(~free)]
        at = np.flatnonzero(covered[s:] == covered[:-s])
        return at, words.gram_hashes(x, s)[at]

    at_a, hash_a = windows(a, free_a)
    at_b, hash_b = windows(b, free_b)
    order = np.argsort(hash_a, kind="stable")
    at_a, hash_a = at_a[order], hash_a[order]
    low, high = np.searchsorted(hash_a, hash_b, "left"), np.searchsorted(hash_a, hash_b, "right")
    hits = high - low
    j = np.repeat(at_b, hits)
    i = at_a[np.repeat(low, hits) + np.arange(len(j)) - np.repeat(np.cumsum(hits) - hits, hits)]
    # keep the left end of each run
    before = (i > 0) & (j > 0)
    before &= (a[i - 1] == b[j - 1]) & free_a[i - 1] & free_b[j - 1]
    i, j = i[~before], j[~before]
    length = np.full(len(i), s)
    growing = np.arange(len(i))
    while len(growing):
        x, y = i[growing] + length[growing], j[growing] + length[growing]
        inside = (x < len(a)) & (y < len(b))
        growing, x, y = growing[inside], x[inside], y[inside]
        more = (a[x] == b[y]) & free_a[x] & free_b[y]
        growing = growing[more]
        length[growing] += 1
    return sorted(zip(length.tolist(), i.tolist(), j.tolist()), key=lambda m: (-m[0], m[1], m[2]))


def tiles(item: np.ndarray, doc: np.ndarray, least: int = LEAST_WORDS) -> list[tuple[int, int, int]]:
    """Greedy tiles (length, start in item, start in doc), the longest first, none shorter than ``least``."""
    free_a, free_b = np.ones(len(item), bool), np.ones(len(doc), bool)
    found = []
    s = max(least, len(item) // 2)
    while True:
        waiting = _matches(item, doc, free_a, free_b, s)
        while waiting:
            n, i, j = waiting.pop(0)
            whole = free_a[i : i + n] & free_b[j : j + n]
            if whole.all():
                found.append((n, i, j))
                free_a[i : i + n] = free_b[j : j + n] = False
                continue
            # what an earlier tile has left of this run waits for its turn
            edges = np.flatnonzero(np.diff(np.r_[False, whole, False].astype(np.int8)))
            rest = [(int(y - x), i + int(x), j + int(x)) for x, y in zip(edges[::2], edges[1::2]) if y - x >= s]
            waiting = sorted([*waiting, *rest], key=lambda m: (-m[0], m[1], m[2]))
        if s == least:
            return found
        s = max(least, s // 2)


def _grams(table: DataFrame, least: int) -> DataFrame:
    """(key, n_words, grams) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory.only()
        for batch in batches:
            sizes, grams = [], []
            for _, hashes, first in words.hashed(batch.column(1), words.ALPHANUMERIC):
                for a, b in zip(first[:-1], first[1:]):
                    sizes.append(int(b - a))
                    grams.append(np.unique(words.gram_hashes(hashes[a:b], least)).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(grams, pa.list_(pa.int64()))],
                names=["key", "n_words", "grams"],
            )

    return table.select(text_key().alias("key"), "text").mapInArrow(run, "key bigint, n_words bigint, grams array<bigint>")


def _seeded(docs: DataFrame, seeds: hash_arrays.HashSetFiles, least: int) -> DataFrame:
    """(key, text, grams) of the documents that hold seeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory.only()
        for batch in batches:
            row, grams = [], []
            for lo, hashes, first in words.hashed(batch.column(1), words.ALPHANUMERIC):
                every = words.gram_hashes(hashes, least)
                hits = np.flatnonzero(seeds.contains(every))
                doc = np.searchsorted(first, hits, "right") - 1
                inside = hits + least <= first[doc + 1]
                hits, doc = hits[inside], doc[inside]
                for d in np.unique(doc):
                    row.append(lo + int(d))
                    grams.append(np.unique(every[hits[doc == d]]).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), batch.column(1).take(pa.array(row, pa.int64())),
                 pa.array(grams, pa.list_(pa.int64()))],
                names=["key", "text", "grams"],
            )

    return docs.select(text_key().alias("key"), "text").mapInArrow(run, "key bigint, text string, grams array<bigint>")


def _tiled(pairs: DataFrame, least: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(column: pa.Array) -> list[np.ndarray]:
            return [h[a:b] for _, h, f in words.hashed(column, words.ALPHANUMERIC) for a, b in zip(f[:-1], f[1:])]

        for batch in batches:
            found = [tiles(a, b, least) for a, b in zip(of(batch.column(3)), of(batch.column(2)))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([sum(t[0] for t in f) for f in found], pa.int64()),
                 pa.array([len(f) for f in found], pa.int64())],
                names=["key", "item", "covered", "n_tiles"],
            )

    return pairs.select("key", "item", "text", "item_text").mapInArrow(
        run, "key bigint, item bigint, covered bigint, n_tiles bigint"
    )


def tiled_pairs(
    docs: DataFrame, benchmark: DataFrame, least: int = LEAST_WORDS, coverage: float = COVERAGE
) -> DataFrame:
    """(key, item_id, n_words, covered, n_tiles, coverage) of distinct texts and items with a coverage of at least ``coverage``.

    ``docs`` has text, ``benchmark`` item_id and text; ``key`` is ``text_key`` of the document, so repeated texts are tiled once.
    Words are runs of ASCII digits and letters and of all characters beyond ASCII, A-Z in lower case. A null text is an empty
    one. Items of fewer than ``least`` words match nothing; of items with the same text the smallest item_id is
    named. An empty table gives no rows. Other columns are ignored.
    """
    folder = f"{shared_folder(docs.sparkSession)}/seeds-{uuid.uuid4().hex}"
    items = benchmark.groupBy(text_key().alias("item")).agg(F.min("item_id").alias("item_id"), F.first("text").alias("item_text"))
    grams = cut_lineage(
        _grams(benchmark, least).dropDuplicates(["key"]).where(F.size("grams") > 0)
        .select(F.col("key").alias("item"), "n_words", F.explode("grams").alias("gram"))
    )
    bits = hash_arrays.bucket_bits(hash_arrays.text_size(benchmark))
    seeds = hash_arrays.hash_set(grams.select(F.col("gram").alias("key")), folder, bits)
    seeded = cut_lineage(_seeded(docs, seeds, least).dropDuplicates(["key"]))
    # a seed covers ``least`` words at most
    enough = F.count("*") * least >= F.lit(coverage) * F.first("n_words")
    pairs = (
        seeded.select("key", F.explode("grams").alias("gram")).join(grams, "gram")
        .groupBy("key", "item").agg(enough.alias("enough"), F.first("n_words").alias("n_words")).where("enough").drop("enough")
    )
    texts = pairs.join(seeded.select("key", "text"), "key").join(items.select("item", "item_text"), "item")
    found = _tiled(texts.repartition("key"), least)
    return (
        found.join(pairs, ["key", "item"]).join(items.select("item", "item_id"), "item")
        .withColumn("coverage", F.col("covered") / F.col("n_words")).where(F.col("coverage") >= coverage)
        .select("key", "item_id", "n_words", "covered", "n_tiles", "coverage")
    )


def document_coverage(docs: DataFrame, benchmark: DataFrame, least: int = LEAST_WORDS, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, contaminated, n_items, item_id, coverage): for every row of ``docs`` its items and the best covered of them.

    Ties go to the smaller item_id; rows without an item have 0 items, a null item_id and coverage 0.
    """
    best = (
        tiled_pairs(docs, benchmark, least, coverage).groupBy("key")
        .agg(F.count("*").alias("n_items"), F.max(F.struct("coverage", -F.col("item_id"))).alias("best"))
        .select("key", "n_items", (-F.col("best.col2")).alias("item_id"), F.col("best.coverage").alias("coverage"))
    )
    return docs.select("doc_id", text_key().alias("key")).join(best, "key", "left").select(
        "doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
        "item_id", F.coalesce("coverage", F.lit(0.0)).alias("coverage"),
    )


def without_benchmark(docs: DataFrame, benchmark: DataFrame, least: int = LEAST_WORDS, coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``docs`` that cover no item, all columns as they are."""
    found = tiled_pairs(docs, benchmark, least, coverage).select("key")
    folder = f"{shared_folder(docs.sparkSession)}/leaks-{uuid.uuid4().hex}"
    bits = hash_arrays.bucket_bits(hash_arrays.text_size(docs))
    return hash_arrays.without(docs, text_key(), hash_arrays.hash_set(found, folder, bits))
