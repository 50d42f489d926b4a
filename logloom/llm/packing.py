"""Best-fit packing by minimum bin slack.

Pieces of equal length are alike, so bins are filled on the histogram of lengths: at most ``capacity`` rows however
many pieces there are. A subset-sum table (one bit per total) over the lengths still available finds the fullest
bin that holds the longest piece left; that combination is then repeated as long as its lengths last. Spark
numbers the pieces of each length and looks their place up in the resulting list of combinations.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from logloom.llm import worker_memory
from logloom.llm.tokens import CACHE_WORDS, text_groups, tokenizer
from logloom.session import cut_lineage

CAPACITY = 1024
#: pieces of one length that are numbered together
RANK_GROUP = 100_000


def token_pieces(
    docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = CAPACITY, cache_words: int = CACHE_WORDS,
    keep_cache: bool = True,
) -> DataFrame:
    """(doc_id, piece, start, length, ids): every text's ids and the end id, cut into pieces of ``capacity``.

    A null text is an empty one and gives the end id alone. Only texts beyond ``capacity`` are cut; their
    first piece takes what does not fill a whole one. ``ids`` are little-endian unsigned 32-bit
    integers. Repeated rows and null doc_ids are documents like any other. ``cache_words`` bounds a worker's memory; without
    ``keep_cache`` a worker gives it back after every task. Neither touches the result.
    """
    source = docs.select("doc_id", "text")
    schema = T.StructType(
        [
            source.schema["doc_id"], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()),
        ]
    )
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(tokenizer_path, cache_words).encode
        for batch in batches:
            for first, texts in text_groups(batch.column(1).to_pylist()):
                row, piece, start, ids = [], [], [], []
                for i, data in enumerate(encode(texts)):
                    data += end
                    n = len(data) // 4
                    head = (n - 1) % capacity + 1
                    for j, at in enumerate([0, *range(head, n, capacity)]):
                        row.append(first + i)
                        piece.append(j)
                        start.append(at)
                        ids.append(data[4 * at : 4 * (at + capacity if j else head)])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                        pa.array(start, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array(ids, pa.binary()),
                    ],
                    names=schema.names,
                )
        if not keep_cache:
            worker_memory.only()

    return source.mapInArrow(run, schema)


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """Lengths (with their number) of the fullest combination that fits ``room``; longer pieces are preferred."""
    stages: list[tuple[int, int, int]] = []  # (length, copies, totals that were possible before)
    totals, goal = 1, 1 << room
    within = (goal << 1) - 1
    for length in sorted((x for x in counts if 0 < x <= room and counts[x] > 0), reverse=True):
        left = min(counts[length], room // length)
        step = 1
        while left > 0:
            copies = min(step, left)
            stages.append((length, copies, totals))
            totals |= (totals << (length * copies)) & within
            left -= copies
            step *= 2
        if totals & goal:
            break
    at = totals.bit_length() - 1
    found: dict[int, int] = {}
    for length, copies, before in reversed(stages):
        if not before >> at & 1:
            found[length] = found.get(length, 0) + copies
            at -= length * copies
    return found


def combinations(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(number of bins, lengths in each) until no piece is left."""
    left = {length: n for length, n in histogram.items() if n > 0}
    plan = []
    while left:
        longest = max(left)
        left[longest] -= 1
        inside = fullest(left, capacity - longest)
        left[longest] += 1
        inside[longest] = inside.get(longest, 0) + 1
        bins = min(left[length] // k for length, k in inside.items())
        plan.append((bins, dict(sorted(inside.items(), reverse=True))))
        for length, k in inside.items():
            left[length] -= bins * k
            if not left[length]:
                del left[length]
    return plan


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with doc_id, piece and a length of at most ``capacity``.

    Each sequence is filled from 0 without gaps. All other columns are kept (but for old ones of these two names),
    and repeated rows are placed one by one. A length that is null, not positive or above ``capacity`` is an error.
    No pieces, no rows.
    """
    pieces = cut_lineage(pieces.drop("sequence_id", "offset"))
    # one row per length, so at most ``capacity`` rows
    histogram = {
        r.length: r.n
        for r in pieces.groupBy("length").agg(F.count("*").alias("n")).limit(capacity + 1).collect()
    }
    if any(x is None or not 0 < x <= capacity for x in histogram):
        raise ValueError(f"piece lengths must lie between 1 and {capacity}")
    used: dict[int, int] = {}
    rows = []
    sequence = 0
    for bins, inside in combinations(histogram, capacity):
        at = 0
        for length, k in inside.items():
            rows.append((length, used.get(length, 0), k, sequence, at))
            used[length] = used.get(length, 0) + bins * k
            at += length * k
        sequence += bins
    places = np.array(sorted(rows), np.int64).reshape(-1, 5)
    keys = (places[:, 0] << 40) + places[:, 1]
    groups = 1 + max(histogram.values(), default=0) // RANK_GROUP

    # the piece travels as one column, so that its columns may have any names
    group = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)).alias("group")
    narrow = pieces.select(F.struct("*").alias("row"), "length", group, "doc_id", "piece")
    numbered = narrow.select(
        "row", "length", "group",
        F.row_number().over(Window.partitionBy("length", "group").orderBy("doc_id", "piece")).alias("n"),
    )
    before = narrow.groupBy("length", "group").agg(F.count("*").alias("c")).select(
        "length", "group", (F.sum("c").over(Window.partitionBy("length").orderBy("group")) - F.col("c")).alias("before")
    )
    source = numbered.join(before, ["length", "group"]).select(
        "row", F.col("length").cast("bigint").alias("length"), (F.col("n") - 1 + F.col("before")).alias("rank")
    )
    schema = T.StructType(
        [
            T.StructField("row", pieces.schema), T.StructField("sequence_id", T.LongType()),
            T.StructField("offset", T.LongType()),
        ]
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            # the last entry of this length that starts at or before the rank
            at = np.searchsorted(keys, (length << 40) + rank, "right") - 1
            _, start, k, base, offset = places[at].T
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(base + (rank - start) // k),
                    pa.array(offset + (rank - start) % k * length),
                ],
                names=schema.names,
            )

    return source.mapInArrow(place, schema).select("row.*", "sequence_id", "offset")
