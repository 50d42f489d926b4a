"""Token files in Simple-8b words.

A file is a run of blocks and an index. A block holds up to ``BLOCK_IDS`` ids in 64-bit words: the top four bits, the
selector, say how many ids of which width fill the other sixty. Ids that need more than sixty bits are escaped: their place
holds 0 and the block lists them with their positions. The index at the end has each block's byte offset and
first id, and the documents with their number of ids, so that blocks are decoded apart from each other, one
selector at a time for all words.

    b"S8B1" padded to 8 bytes
    per block: u32 ids, u32 words, u32 escapes, u32 zero; words u64; escaped positions u64; escaped ids u64
    index: u64 blocks, u64 docs; block offsets u64; block first ids u64; doc_id i64; doc_id is set u8; doc ids u64
    u64 offset of the index, b"S8B1END\\0"
"""

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from logloom.llm.tokens import text_groups, tokenizer
from logloom.session import cut_lineage

BLOCK_IDS = 65_536
# fixed values: selector, ids per word, bits per id (the public Simple-8b table)
SELECTORS = (
    (0, 240, 0), (1, 120, 0), (2, 60, 1), (3, 30, 2), (4, 20, 3), (5, 15, 4), (6, 12, 5), (7, 10, 6),
    (8, 8, 7), (9, 7, 8), (10, 6, 10), (11, 5, 12), (12, 4, 15), (13, 3, 20), (14, 2, 30), (15, 1, 60),
)
_COUNT = np.array([n for _, n, _ in SELECTORS])
_HEAD, _TAIL = b"S8B1\0\0\0\0", b"S8B1END\0"
MANIFEST = "shard int, path string, n_docs bigint, n_ids bigint, n_bytes bigint"


def encode_block(ids: np.ndarray) -> bytes:
    """One block of any number of unsigned 64-bit ids."""
    values = ids.astype(np.uint64, copy=True)
    escaped = np.flatnonzero(values >> np.uint64(60))
    escapes = values[escaped]
    values[escaped] = 0
    n = len(values)
    # bits of each id from the exponent of its float; rounding only touches ids of more than 53 bits, which all selectors but the last refuse
    width = np.maximum((values.astype(np.float64).view(np.int64) >> 52) - 1022, 0).astype(np.uint8)
    # the selector that holds the most ids from each position on: the largest width of so many ids must fit
    best = np.full(n, 15, np.uint8)
    widest = {1: width}
    for selector, count, bits in reversed(SELECTORS[:-1]):
        if count > n:
            break
        part = max(c for c in widest if 2 * c <= count)
        while count not in widest:  # two windows side by side
            more = max(c for c in widest if c <= count - part)
            widest[part + more] = np.maximum(widest[part][: n - part - more + 1], widest[more][part : n - more + 1])
            part += more
        best[: n - count + 1][widest[count] <= bits] = selector
    step = _COUNT[best].tolist()
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at += step[at]
    start = np.array(starts, np.int64)
    chosen = best[start]
    words = np.zeros(len(start), np.uint64)
    for selector, count, bits in SELECTORS[2:]:
        rows = np.flatnonzero(chosen == selector)
        if len(rows):
            at = start[rows]
            word = values[at]
            for i in range(1, count):
                word |= values[at + i] << np.uint64(i * bits)
            words[rows] = word
    words |= chosen.astype(np.uint64) << np.uint64(60)
    head = struct.pack("<4I", n, len(words), len(escaped), 0)
    return head + b"".join(x.astype("<u8").tobytes() for x in (words, escaped, escapes))


def decode_block(data: bytes) -> np.ndarray:
    n, n_words, n_escapes, _ = struct.unpack_from("<4I", data)
    words = np.frombuffer(data, "<u8", n_words, 16)
    selector = (words >> np.uint64(60)).astype(np.int64)
    end = np.cumsum(_COUNT[selector])
    start = end - _COUNT[selector]
    out = np.zeros(n, np.uint64)
    for code, count, bits in SELECTORS[2:]:
        rows = np.flatnonzero(selector == code)
        if len(rows):
            shift = np.arange(count, dtype=np.uint64) * np.uint64(bits)
            out[start[rows][:, None] + np.arange(count)] = (words[rows][:, None] >> shift) & np.uint64((1 << bits) - 1)
    position = np.frombuffer(data, "<u8", n_escapes, 16 + 8 * n_words)
    out[position.astype(np.int64)] = np.frombuffer(data, "<u8", n_escapes, 16 + 8 * (n_words + n_escapes))
    return out


class FileWriter:
    """Writes documents one after the other; holds one block and the index in memory."""

    def __init__(self, stream, block_ids: int = BLOCK_IDS):
        self._stream, self._block_ids = stream, block_ids
        self._waiting: list[np.ndarray] = []
        self._n_waiting = self.n_ids = 0
        self._blocks: list[tuple[int, int]] = []
        self._docs: list[tuple[int | None, int]] = []
        stream.write(_HEAD)
        self.n_bytes = len(_HEAD)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self._docs.append((doc_id, len(ids)))
        self._waiting.append(ids)
        self._n_waiting += len(ids)
        if self._n_waiting >= self._block_ids:
            ids = np.concatenate(self._waiting)
            whole = len(ids) - len(ids) % self._block_ids
            for at in range(0, whole, self._block_ids):
                self._write(ids[at : at + self._block_ids])
            self._waiting, self._n_waiting = [ids[whole:]], len(ids) - whole

    def _write(self, ids: np.ndarray) -> None:
        self._blocks.append((self.n_bytes, self.n_ids))
        data = encode_block(ids)
        self._stream.write(data)
        self.n_bytes += len(data)
        self.n_ids += len(ids)

    @property
    def n_docs(self) -> int:
        return len(self._docs)

    def close(self) -> None:
        if self._n_waiting:
            self._write(np.concatenate(self._waiting))
        blocks = np.array(self._blocks, "<u8").reshape(-1, 2)
        index = struct.pack("<2Q", len(blocks), len(self._docs)) + b"".join(
            x.tobytes()
            for x in (
                blocks[:, 0], blocks[:, 1], np.array([d or 0 for d, _ in self._docs], "<i8"),
                np.array([d is not None for d, _ in self._docs], np.uint8), np.array([n for _, n in self._docs], "<u8"),
            )
        )
        self._stream.write(index + struct.pack("<Q", self.n_bytes) + _TAIL)
        self.n_bytes += len(index) + 16


def read_file(stream, group_ids: int = 1 << 20) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """(doc_ids, ids per document, all their ids) for groups of documents of about ``group_ids`` ids."""
    size = stream.size()
    stream.seek(size - 16)
    at, tail = struct.unpack("<Q8s", stream.read(16))
    if tail != _TAIL:
        raise ValueError("not a whole token file")
    stream.seek(at)
    index = stream.read(size - 16 - at)
    n_blocks, n_docs = struct.unpack_from("<2Q", index)
    offsets = np.append(np.frombuffer(index, "<u8", n_blocks, 16), np.uint64(at)).astype(np.int64)
    first_ids = np.frombuffer(index, "<u8", n_blocks, 16 + 8 * n_blocks).astype(np.int64)
    place = 16 + 16 * n_blocks
    doc_ids = np.frombuffer(index, "<i8", n_docs, place)
    is_set = np.frombuffer(index, np.uint8, n_docs, place + 8 * n_docs)
    lengths = np.frombuffer(index, "<u8", n_docs, place + 9 * n_docs).astype(np.int64)
    ends = np.cumsum(lengths)
    lo = 0
    while lo < n_docs:
        begin = ends[lo] - lengths[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, begin + group_ids, "right")))
        a = max(0, int(np.searchsorted(first_ids, begin, "right")) - 1)
        b = int(np.searchsorted(first_ids, ends[hi - 1], "left"))
        parts = []
        for k in range(a, b):
            stream.seek(int(offsets[k]))
            parts.append(decode_block(stream.read(int(offsets[k + 1] - offsets[k]))))
        ids = np.concatenate(parts) if parts else np.empty(0, np.uint64)
        skip = begin - first_ids[a] if parts else 0
        names = [int(d) if s else None for d, s in zip(doc_ids[lo:hi], is_set[lo:hi])]
        yield names, lengths[lo:hi], ids[skip : skip + ends[hi - 1] - begin]
        lo = hi


def write_tokens(
    docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, shards: int | None = None
) -> DataFrame:
    """Write every whole text of ``docs`` (doc_id, text) as token files in ``folder``; returns their manifest.

    Documents stand in ascending doc_id order, null doc_ids first and equal ones by text, over the files in the order of
    ``shard``. A null text is an empty one; every document ends with ``end_id``. ``folder`` is a path or URI that all
    workers reach. Each attempt of a task writes a file of its own name, and the manifest, which Spark
    commits, names the files that count: a lost or repeated task changes nothing. No documents, an empty manifest.
    """
    source = docs.select("doc_id", "text")
    ordered = source.repartitionByRange(*([shards] if shards else []), "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(tokenizer_path).encode
        store, root = open_store(folder)
        writer = None
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for first, texts in text_groups(batch.column(1).to_pylist()):
                if writer is None:
                    store.create_dir(root, recursive=True)
                    shard = TaskContext.get().partitionId()
                    name = f"{root}/tokens-{shard:06d}-{uuid.uuid4().hex}.s8b"
                    stream = store.open_output_stream(name)
                    writer = FileWriter(stream)
                for i, data in enumerate(encode(texts)):
                    writer.add(doc_ids[first + i], np.append(np.frombuffer(data, "<u4"), np.uint32(end_id)))
        if writer is not None:
            writer.close()
            stream.close()
            row = [[shard], [name.rpartition("/")[2]], [writer.n_docs], [writer.n_ids], [writer.n_bytes]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()))],
                names=["shard", "path", "n_docs", "n_ids", "n_bytes"],
            )

    return cut_lineage(ordered.mapInArrow(run, MANIFEST))


def open_store(folder: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder given as a URI or as a plain path."""
    if ":/" in folder:
        return pafs.FileSystem.from_uri(folder.replace("file:/", "file:///", 1) if folder[:7] != "file://" else folder)
    return pafs.LocalFileSystem(), folder


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the files a manifest names; ``start`` counts all ids before the document."""
    before = F.sum("n_ids").over(Window.orderBy("shard")) - F.col("n_ids")  # one row per file
    placed = manifest.select("path", "shard", before.alias("before"))
    files = max(1, manifest.count())
    spread = placed.repartitionByRange(files, "shard").select("path", "before")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_input_file(f"{root}/{path}") as stream:
                    for names, lengths, ids in read_file(stream):
                        ends = np.cumsum(lengths)
                        data = pa.py_buffer(ids.astype("<u4").tobytes())
                        offsets = pa.py_buffer(np.append(0, 4 * ends).astype(np.int32).tobytes())
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(names, pa.int64()), pa.array(start + ends - lengths), pa.array(lengths),
                                pa.Array.from_buffers(pa.binary(), len(names), [None, offsets, data]),
                            ],
                            names=["doc_id", "start", "n_tokens", "ids"],
                        )
                        start += int(ends[-1])

    return spread.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids binary")
