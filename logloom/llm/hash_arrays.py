"""Sorted arrays of 64-bit hashes in files of the shared folder, which workers map into memory.

Tasks send sorted, delta-coded blocks to buckets of the key range; one task merges a bucket and writes its arrays
as files of their own names. A manifest names the files that count, so repeated tasks do no harm.
"""

import os
import shutil
import struct
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from logloom.llm.token_files import open_store

BLOCK_SCHEMA = "bucket int, block binary"
#: bytes of text per bucket, so that a bucket's arrays fit one task however large the input is
BUCKET_BYTES = 16 << 20


def text_size(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0


def text_key(column: str = "text") -> Column:
    """64-bit key of a text; a null text has the key of an empty one."""
    return F.xxhash64(F.coalesce(column, F.lit("")))


def bucket_bits(size: int, bucket_bytes: int = BUCKET_BYTES) -> int:
    """log2 of the number of buckets for so many bytes of text, 16 buckets at least."""
    return max(4, (max(1, size // bucket_bytes) - 1).bit_length())


def pack_planes(values: np.ndarray) -> bytes:
    """Unsigned integers as byte planes without the empty upper ones; small values compress well this way."""
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8).T
    n = next((i for i in range(8, 0, -1) if len(values) and planes[i - 1].any()), 0)
    return struct.pack("<QQ", len(values), n) + np.ascontiguousarray(planes[:n]).tobytes()


def unpack_planes(data: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    """(values, position behind them)"""
    length, n = struct.unpack_from("<QQ", data, at)
    planes = np.zeros((8, length), np.uint8)
    planes[:n] = np.frombuffer(data, np.uint8, length * n, at + 16).reshape(n, length)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1), at + 16 + length * n


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack_planes(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    deltas, at = unpack_planes(data, at)
    return np.cumsum(deltas, dtype=np.uint64), at


def squeeze(data: bytes) -> bytes:
    """A block in a tighter form than Spark's shuffle and table compression find for it."""
    return struct.pack("<Q", len(data)) + pa.compress(data, codec="zstd", asbytes=True)


def unsqueeze(block: bytes) -> bytes:
    return pa.decompress(memoryview(block)[8:], *struct.unpack_from("<Q", block), codec="zstd", asbytes=True)


def sum_by_key(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def count_blocks(keys: np.ndarray, counts: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch:
    """Blocks of sorted keys with counts; ``bucket`` must ascend with the keys."""
    edges = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(keys)] if len(keys) else np.zeros(1, int)
    blocks = [squeeze(pack_sorted(keys[a:b]) + pack_planes(counts[a:b])) for a, b in zip(edges[:-1], edges[1:])]
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[edges[:-1]].astype(np.int32)), pa.array(blocks, pa.binary())], names=["bucket", "block"]
    )


def read_counts(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    block = unsqueeze(block)
    keys, at = unpack_sorted(block)
    return keys, unpack_planes(block, at)[0]


def write_array(folder: str, name: str, values: np.ndarray) -> str:
    """Write one array under a name of its own and return the name."""
    store, root = open_store(folder)
    store.create_dir(root, recursive=True)
    file = f"{name}-{uuid.uuid4().hex}.bin"
    with store.open_output_stream(f"{root}/{file}") as out:
        out.write(np.ascontiguousarray(values).view(np.uint8))
    return file


def map_array(folder: str, file: str, dtype: str) -> np.ndarray:
    """The array as a memory map.

    A folder that is mounted is mapped in place. From any other store the file is copied to an unnamed local file first, which the
    system frees with the map.
    """
    store, root = open_store(folder)
    if store.type_name == "local":
        path = f"{root}/{file}"
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.empty(0, dtype)
    with tempfile.TemporaryFile() as local, store.open_input_stream(f"{root}/{file}") as remote:
        shutil.copyfileobj(remote, local)
        return np.memmap(local, dtype, "r") if local.tell() else np.empty(0, dtype)


#: byte that stands for a larger value
ESCAPED = 255


def write_narrow(folder: str, name: str, values: np.ndarray) -> str:
    """Write unsigned integers that are mostly small: a byte each, and a list of the positions and values of the others behind them."""
    wide = np.flatnonzero(values >= ESCAPED)
    small = values.astype(np.uint8)
    small[wide] = ESCAPED
    tail = (np.zeros(-len(small) % 8, np.uint8), *(x.astype("<u8").view(np.uint8) for x in (wide, values[wide], np.array([len(small), len(wide)]))))
    return write_array(folder, name, np.concatenate([small, *tail]))


class NarrowArray:
    """An array that ``write_narrow`` has written, as a memory map."""

    def __init__(self, folder: str, file: str):
        data = map_array(folder, file, "u1")
        n, n_wide = np.asarray(data[-16:]).view("<u8").tolist()
        at = len(data) - 16 - 16 * n_wide
        self._small = data[:n]
        self._wide, self._values = (np.asarray(data[x : x + 8 * n_wide]).view("<u8") for x in (at, at + 8 * n_wide))

    def __len__(self) -> int:
        return len(self._small)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        """The values at an array of positions."""
        found = self._small[at].astype(np.int64)
        wide = np.nonzero(found == ESCAPED)
        if len(wide[0]):
            found[wide] = self._values[np.searchsorted(self._wide, at[wide].astype(np.uint64))]
        return found


def merge_buckets(
    blocks: DataFrame, merge: Callable[[int, list[bytes]], dict[str, list]], schema: str
) -> DataFrame:
    """Call ``merge(bucket, blocks)`` for every bucket in one task; it returns columns of result rows."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        return pa.table(merge(key[0].as_py(), table["block"].to_pylist()))

    return blocks.groupBy("bucket").applyInArrow(run, schema)


class HashSetFiles:
    """Sorted distinct hashes, one file per bucket of the key range."""

    def __init__(self, folder: str, bits: int, files: dict[int, tuple[str, ...]], dtypes: tuple[str, ...] = ("<u8",)):
        self.folder, self.bits, self.files, self.dtypes = folder, bits, files, dtypes
        self._open: dict[int, tuple[np.ndarray, ...]] = {}

    def __getstate__(self):
        return {**self.__dict__, "_open": {}}

    def arrays(self, bucket: int) -> tuple[np.ndarray, ...]:
        if bucket not in self._open:
            self._open[bucket] = tuple(
                map_array(self.folder, f, d) for f, d in zip(self.files[bucket], self.dtypes)
            )
        return self._open[bucket]

    def find(self, keys: np.ndarray) -> Iterator[tuple[slice, tuple[np.ndarray, ...], np.ndarray, np.ndarray]]:
        """For ascending keys, per bucket: (their slice, the bucket's arrays, position in them, whether it is there)."""
        bucket = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        edges = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(keys)] if len(keys) else [0]
        for a, b in zip(edges[:-1], edges[1:]):
            if int(bucket[a]) not in self.files:
                continue
            arrays = self.arrays(int(bucket[a]))
            if len(arrays[0]):
                at = np.minimum(np.searchsorted(arrays[0], keys[a:b]), len(arrays[0]) - 1)
                yield slice(a, b), arrays, at, np.asarray(arrays[0][at]) == keys[a:b]

    def contains(self, keys: np.ndarray) -> np.ndarray:
        """For keys in any order."""
        order = np.argsort(keys)
        found = np.zeros(len(keys), bool)
        for part, _, _, there in self.find(keys[order]):
            found[order[part]] = there
        return found


def hash_set(keys: DataFrame, folder: str, bits: int) -> HashSetFiles:
    """Files of the distinct values of a BIGINT column ``key``; nulls are left out."""
    signed = keys.select("key").where("key IS NOT NULL").distinct()
    # the bucket of the unsigned key: its upper bits
    bucketed = signed.select(F.shiftrightunsigned("key", 64 - bits).cast("int").alias("bucket"), "key")

    def write(key: tuple, table: pa.Table) -> pa.Table:
        values = np.sort(table["key"].to_numpy().view(np.uint64))
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "file": [write_array(folder, "keys", values)]})

    rows = bucketed.groupBy("bucket").applyInArrow(write, "bucket int, file string").collect()  # one row per bucket
    return HashSetFiles(folder, bits, {r.bucket: (r.file,) for r in rows})


def without(rows: DataFrame, key: Column, dropped: HashSetFiles) -> DataFrame:
    """The rows whose 64-bit ``key`` is not among the hashes; nothing is shuffled."""
    name = "_key"
    while name in rows.columns:
        name += "_"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(batch.num_columns - 1).to_numpy().view(np.uint64)
            kept = batch.filter(pa.array(~dropped.contains(keys)))
            yield pa.RecordBatch.from_arrays(kept.columns[:-1], names=kept.schema.names[:-1])

    return rows.withColumn(name, key).mapInArrow(run, rows.schema)
