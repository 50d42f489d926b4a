"""Nearest neighbours by collision counting.

Each block of vectors keeps one sorted array per random projection. A query opens a window around its own projection in every array
and widens all windows step by step (virtual rehashing: a wider bucket is a longer slice of the same array). A vector that
lies in enough windows is verified by its inner product. A query is done with a block when a vector nearer
than its k-th would have had enough collisions at this width almost surely; the last width covers the whole block.

The largest inner product becomes the smallest distance by one more coordinate that brings all vectors of a block to
the same length.
"""

import uuid
from functools import cached_property
from math import erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from logloom.llm.hash_arrays import map_array, write_array
from logloom.session import cut_lineage, shared_folder

K = 20
BLOCK_ROWS = 8192
QUERY_ROWS = 1024
PROJECTIONS = 96
#: collisions that make a candidate, as a share of the projections
THRESHOLD = 0.5
#: half widths of the windows, as shares of the block's radius
WIDTHS = (0.35, 0.45, 0.55, 0.65, 0.8, 1.0, 1.4, 2.0)
#: standard deviations by which a nearer vector must be expected beyond the threshold
CERTAINTY = 1.6
#: queries of a slice that try all widths; the others start at the least width at which one of these was done
PILOTS = 16
#: candidates that are more than one in so many of a block are verified by one product with the whole block
MANY = 8
#: share of the lengths by which such products may be off
ROUNDING = 1e-12


def usable(vector: str) -> Column:
    """Whether a vector takes part: no null or non-finite component, and one that is not 0."""
    v = F.col(vector)
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(sound & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1) + 0.0


def _projections(n: int, width: int) -> np.ndarray:
    return np.random.default_rng(97).standard_normal((width, n))


def build_index(vectors: DataFrame, folder: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Index files of all rows (vec_id, vec); one row per block with its dimension, size and file names.

    Equal vectors of a block share one entry that lists their ids in order.
    """
    rows = cut_lineage(vectors.select("vec_id", "vec").withColumn("dimension", F.size("vec")))
    # one row per dimension
    sizes = rows.groupBy("dimension").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("n_blocks"))
    dealt = rows.join(F.broadcast(sizes), "dimension").withColumn(
        "block", F.pmod(F.xxhash64("vec_id"), F.col("n_blocks")).cast("int")
    )

    def build(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        ids, every = table["vec_id"].to_numpy(), _matrix(table["vec"])
        _, index, inverse = np.unique(
            np.ascontiguousarray(every).view(f"V{8 * every.shape[1]}").ravel(), return_index=True, return_inverse=True
        )
        unique = every[index]
        order = np.argsort(inverse, kind="stable")
        first = np.searchsorted(inverse[order], np.arange(len(unique) + 1))
        norms = np.sqrt((unique * unique).sum(axis=1))
        radius = norms.max()
        raised = np.c_[unique, np.sqrt(np.maximum(0, radius**2 - norms**2))]
        projected = (raised @ _projections(PROJECTIONS, raised.shape[1])).T
        ranked = np.argsort(projected, axis=1, kind="stable")
        files = {
            "unique": unique, "ids": ids[order], "first": first, "radius": np.array([radius]),
            "projected": np.take_along_axis(projected, ranked, axis=1), "ranked": ranked.astype(np.int32),
        }
        return pa.table(
            {
                "dimension": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([key[1].as_py()], pa.int32()),
                "n_blocks": table["n_blocks"][:1], "files": [[write_array(folder, n, x) for n, x in files.items()]],
            }
        )

    return cut_lineage(
        dealt.select("dimension", "block", "n_blocks", "vec_id", "vec").groupBy("dimension", "block")
        .applyInArrow(build, "dimension int, block int, n_blocks int, files array<string>")
    )


class _Block:
    def __init__(self, folder: str, files: list[str]):
        kinds = ("<f8", "<i8", "<i8", "<f8", "<f8", "<i4")
        unique, self.ids, self.first, radius, projected, ranked = (map_array(folder, f, k) for f, k in zip(files, kinds))
        n = len(self.first) - 1
        self.unique, self.radius = unique.reshape(n, -1), float(radius[0])
        self.projected, self.ranked = projected.reshape(PROJECTIONS, n), ranked.reshape(PROJECTIONS, n)

    @cached_property
    def place(self) -> np.ndarray:
        """Per projection the place of every vector among the sorted values, in unsigned integers as short as the block allows."""
        n = self.ranked.shape[1]
        place = np.empty(self.ranked.shape, np.uint16 if n < 1 << 16 else np.uint32)
        for row, ranked in zip(place, self.ranked):
            row[ranked] = np.arange(n, dtype=place.dtype)
        return place

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Per query the ids and inner products of its k nearest in this block, other than itself."""
        n = len(self.unique)
        raised = np.c_[queries, np.zeros(len(queries))]
        raised *= self.radius / np.sqrt((queries * queries).sum(axis=1))[:, None]
        length = np.sqrt((queries * queries).sum(axis=1))
        centre = raised @ _projections(PROJECTIONS, raised.shape[1])
        least = int(np.ceil(THRESHOLD * PROJECTIONS))
        widths = [w * self.radius for w in WIDTHS]
        low = np.zeros((len(widths) + 1, len(queries), PROJECTIONS), np.int64)
        high = np.full_like(low, n)
        for p in range(PROJECTIONS):
            order = np.argsort(centre[:, p])  # neighbouring places are looked up one after the other
            sorted_centre = centre[order, p]
            for j, w in enumerate(widths):
                low[j, order, p] = np.searchsorted(self.projected[p], sorted_centre - w, "left")
                high[j, order, p] = np.searchsorted(self.projected[p], sorted_centre + w, "right")
        # the distance up to which a vector would have collided often enough, for each width
        reach = [_reach(w, least) for w in widths]
        found_ids, found_scores = [None] * len(queries), [None] * len(queries)
        start, needed = 0, []
        for n_done, q in enumerate(np.argsort(query_ids, kind="stable")):
            if n_done == PILOTS:
                start = min(needed)
            verified = np.zeros(n, bool)
            at, score = np.empty(0, np.int64), np.empty(0)
            products = None
            for j in range(start, len(widths) + 1):
                if j == len(widths):
                    new = np.flatnonzero(~verified)
                else:
                    counts = self._collisions(low[j, q], high[j, q])
                    new = np.flatnonzero((counts >= least) & ~verified)
                verified[new] = True
                if products is None and len(new) * MANY >= n:
                    products = self.unique @ queries[q]
                at = np.r_[at, new]
                score = np.r_[score, self.unique[new] @ queries[q] if products is None else products[new]]
                if len(at) > k + 1:
                    kth = np.partition(score, len(score) - k - 1)[len(score) - k - 1]
                    kept = score >= kth - ROUNDING * self.radius * length[q]
                    at, score = at[kept], score[kept]
                if j < len(widths) and len(at) > k:
                    # from the inner product back to the distance in the raised space
                    inner = score.min() * self.radius / length[q]
                    if sqrt(max(0.0, 2 * self.radius**2 - 2 * inner)) <= reach[j]:
                        break
            needed.append(min(j, len(widths) - 1))
            score = (self.unique[at] * queries[q]).sum(axis=1)  # of the few that are left, whatever the products' rounding
            ids = [self.ids[self.first[u] : min(self.first[u + 1], self.first[u] + k + 1)] for u in at]
            each = np.repeat(score, [len(x) for x in ids])
            every = np.concatenate(ids) if ids else np.empty(0, np.int64)
            other = every != query_ids[q]
            every, each = every[other], each[other]
            best = np.lexsort((every, -each))[:k]
            found_ids[q], found_scores[q] = every[best], each[best]
        return found_ids, found_scores

    def _collisions(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """How often each vector's place lies in the window of a sorted projection, from ``low`` to before ``high``.

        Places are compared side by side in short integers: those below a window wrap around to large ones.
        """
        kind = self.place.dtype
        inside = self.place - low[:, None].astype(kind) < (high - low)[:, None].astype(kind)
        return inside.view(np.uint8).sum(axis=0, dtype=np.uint8)  # at most PROJECTIONS


def _reach(width: float, least: int) -> float:
    """Largest distance at which collisions with windows of this half width exceed ``least`` with certainty."""
    low, high = 1e-9, 1e9
    for _ in range(80):
        middle = sqrt(low * high)
        p = erf(width / middle / sqrt(2))
        sure = PROJECTIONS * p - CERTAINTY * sqrt(PROJECTIONS * p * (1 - p)) >= least
        low, high = (middle, high) if sure else (low, middle)
    return low


def search(vectors: DataFrame, queries: DataFrame, k: int = K, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of ``vectors`` with the largest inner product found for every query.

    ``vectors`` is (vec_id, vec), ``queries`` (query_id, query_vec); ids are BIGINT. A query does not find the row of its own id. Vectors
    that are null, zero or hold null or non-finite components take no part, nor do null ids; vectors are compared with those
    of the same dimension. Ties go to the smaller vec_id; of rows that repeat an id the smallest vector takes part. Nearly all true
    neighbours are found (tests/llm measures the recall); where a block is searched to its last width, all.
    """
    folder = f"{shared_folder(vectors.sparkSession)}/vectors-{uuid.uuid4().hex}"
    known = vectors.where(F.col("vec_id").isNotNull() & usable("vec")).groupBy("vec_id").agg(F.min("vec").alias("vec"))
    index = build_index(known, folder, block_rows)
    asked = queries.where(F.col("query_id").isNotNull() & usable("query_vec")).groupBy("query_id").agg(
        F.min("query_vec").alias("query_vec")
    )
    asked = asked.withColumn("dimension", F.size("query_vec"))
    # one row per dimension: slices of queries, and how many blocks each must visit
    n_slices = asked.groupBy("dimension").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("n_slices"))
    n_blocks = index.select("dimension", "n_blocks").distinct()
    sizes = n_slices.join(n_blocks, "dimension")
    routed = (
        asked.join(F.broadcast(sizes), "dimension")
        .withColumn("slice", F.pmod(F.xxhash64("query_id"), F.col("n_slices")).cast("int"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
        .select("dimension", "block", "slice", "query_id", "query_vec")
        .join(index.select("dimension", "block", "files"), ["dimension", "block"])
    )

    def run(key: tuple, table: pa.Table) -> pa.Table:
        block = _Block(folder, table["files"][0].as_py())
        ids = table["query_id"].to_numpy()
        near, scores = block.search(ids, _matrix(table["query_vec"]), k)
        return pa.table(
            {
                "query_id": np.repeat(ids, [len(x) for x in near]),
                "vec_id": np.concatenate(near).astype(np.int64), "score": np.concatenate(scores),
            }
        )

    found = routed.groupBy("dimension", "block", "slice").applyInArrow(run, "query_id bigint, vec_id bigint, score double")
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
