"""Interpolated modified Kneser-Ney model of word pairs or triples, counted in Spark and mapped into memory for scoring.

Tasks count words and pairs in sorted blocks; one task per bucket merges them and writes sorted arrays to the shared folder.
A word's place in the sorted hashes of the vocabulary is its number, a pair's key is made of two numbers. Pairs are
dealt to buckets by both words, so that neither a very common first nor a very common second word fills one of them. Workers map
the arrays and look up the distinct words and pairs of a slice of texts at once, in order.

Order 2: pairs interpolated with continuation counts of single words, and these with a uniform share for unknown words. Order 3: a
triple is a pair of the numbers of its two pairs, counted in the same way, interpolated with the continuation counts of pairs.
"""

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from logloom.llm import hash_arrays, words
from logloom.llm.hash_arrays import HashSetFiles, NarrowArray, map_array, pack_planes, pack_sorted, squeeze, unpack_planes, unpack_sorted, unsqueeze, write_array, write_narrow
from logloom.session import cut_lineage, shared_folder

#: key of the token that ends every text
END = np.uint64(0x5EED0E4D)
COUNTED_AT_ONCE = 3_000_000


def _token_slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, token hashes with an end after every text, first token per text and one more)."""
    for lo, hashes, first in words.hashed(column, words.NOT_BLANK):
        n = len(first) - 1
        edges = first + np.arange(n + 1)
        tokens = np.full(len(hashes) + n, END, np.uint64)
        inside = np.ones(len(tokens), bool)
        inside[edges[1:] - 1] = False
        tokens[inside] = hashes
        yield lo, tokens, edges


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Discounts of counts 1, 2 and 3 or more from the numbers of items counted 1, 2, 3 and 4 times.

    Where a number is 0 or a discount leaves its range, half of the count is taken.
    """
    found = []
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    for k in (1, 2, 3):
        d = k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else -1.0
        found.append(d if 0 < d < k else k / 2)
    return tuple(found)


@dataclass
class Model:
    folder: str
    vocabulary: HashSetFiles
    starts: dict[int, int]  # number of the first word of each bucket of the vocabulary
    n_words: int
    n_tokens: int
    side: int  # the pairs lie in side x side buckets
    pair_files: dict[int, tuple[str, str]] = field(default_factory=dict)  # keys and counts
    context_files: dict[int, str] = field(default_factory=dict)
    left_files: dict[int, str] = field(default_factory=dict)
    n_pairs: int = 0
    pair_discounts: tuple[float, ...] = (0.5, 1.0, 1.5)
    left_discounts: tuple[float, ...] = (0.5, 1.0, 1.5)
    left_counts: tuple[int, ...] = (0, 0, 0)  # words that follow 1, 2, and 3 or more different words
    lower: "Model | None" = None  # words of this model are the pairs of the lower one
    pair_starts: dict[int, int] = field(default_factory=dict)  # number of the first pair of each bucket
    follow_files: dict[int, str] = field(default_factory=dict)  # contexts of the continuation counts of pairs
    _open: dict = field(default_factory=dict)

    def __getstate__(self):
        return {**self.__dict__, "_open": {}}

    def part(self, number: np.ndarray) -> np.ndarray:
        """Which of ``side`` ranges of word numbers (the start of a text is number ``n_words``)."""
        return number * self.side // (self.n_words + 1)

    def part_start(self, part: int) -> int:
        return -(-part * (self.n_words + 1) // self.side)

    def _map(self, file: str, dtype: str) -> np.ndarray:
        if file not in self._open:
            self._open[file] = map_array(self.folder, file, dtype)
        return self._open[file]

    def _narrow(self, file: str) -> NarrowArray:
        if file not in self._open:
            self._open[file] = NarrowArray(self.folder, file)
        return self._open[file]

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, count) of every token; -1 and 0 for unknown ones."""
        distinct, inverse = np.unique(hashes, return_inverse=True)
        number, count = np.full(len(distinct), -1), np.zeros(len(distinct), np.int64)
        bucket = (distinct >> np.uint64(64 - self.vocabulary.bits)).astype(np.int64)
        for piece, arrays, at, there in self.vocabulary.find(distinct):
            start = self.starts[int(bucket[piece.start])]
            number[piece] = np.where(there, start + at, -1)
            count[piece] = np.where(there, arrays[1][at], 0)
        return number[inverse], count[inverse]

    def sequence(self, tokens: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of every token, number of the one before it)"""
        if self.lower is None:
            number = self.words(tokens)[0]
        else:
            second, first = self.lower.sequence(tokens, edges)
            number = self.lower.pairs(first, second)[1]
        return number, self.before(number, edges)

    def before(self, number: np.ndarray, edges: np.ndarray) -> np.ndarray:
        before = np.r_[self.n_words, number[:-1]]
        before[edges[:-1]] = self.n_words
        return before

    def pairs(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, number) of pairs of word numbers; 0 and -1 where either is unknown or the pair was not seen."""
        known = np.flatnonzero((first >= 0) & (second >= 0))
        keys, inverse = np.unique(_pair_key(first[known], second[known]), return_inverse=True)
        bucket = self.part(keys >> np.uint64(32)) * np.uint64(self.side) + self.part(keys & np.uint64(0xFFFFFFFF))
        order = np.argsort(bucket, kind="stable")
        edges = np.r_[np.flatnonzero(np.r_[True, np.diff(bucket[order]) > 0]), len(keys)] if len(keys) else [0]
        count, place = np.zeros(len(keys), np.int64), np.full(len(keys), -1)
        for a, b in zip(edges[:-1], edges[1:]):
            files = self.pair_files.get(int(bucket[order[a]]))
            if files is None:
                continue
            own = order[a:b]
            stored = self._map(files[0], "<u8")
            at = np.minimum(np.searchsorted(stored, keys[own]), len(stored) - 1)
            there = stored[at] == keys[own]
            count[own] = np.where(there, self._narrow(files[1])[at], 0)
            place[own] = np.where(there, self.pair_starts.get(int(bucket[order[a]]), 0) + at, -1)
        out, number = np.zeros(len(first), np.int64), np.full(len(first), -1)
        out[known], number[known] = count[inverse], place[inverse]
        return out, number

    def first_words(self, lo: int, hi: int) -> np.ndarray:
        """First words of the pairs with numbers from ``lo`` to ``hi``."""
        found = [np.empty(0, np.uint64)]
        for bucket, start in self.pair_starts.items():
            if start < hi:
                keys = map_array(self.folder, self.pair_files[bucket][0], "<u8")
                found.append(np.asarray(keys[max(0, lo - start) : hi - start]) >> np.uint64(32))
        return np.concatenate(found)

    def _ranged(self, files: dict[int, str], number: np.ndarray, width: int) -> np.ndarray:
        """Rows of dense arrays by word number; zeros for unknown numbers."""
        out = np.zeros((len(number), width), np.int64)
        distinct, inverse = np.unique(number, return_inverse=True)
        rows = np.zeros((len(distinct), width), np.int64)
        part = np.where(distinct >= 0, self.part(distinct), -1)
        for p in np.unique(part[part >= 0]):
            if int(p) in files:
                own = np.flatnonzero(part == p)
                at = (distinct[own] - self.part_start(int(p))) * width
                rows[own] = self._narrow(files[int(p)])[at[:, None] + np.arange(width)]
        out[:] = rows[inverse]
        return out

    def log10(self, tokens: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per token: (log10 of its probability, count, log10 of its base probability)."""
        if self.lower is not None:
            return self._log10_of_triples(tokens, edges)
        number, count = self.words(tokens)
        before = self.before(number, edges)
        single = self._single(number)
        probability = _interpolated(
            self.pairs(before, number)[0], self._ranged(self.context_files, before, 4), self.pair_discounts, single
        )
        return np.log10(probability), count, self._base(count)

    def _base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 1) / (self.n_tokens + self.n_words + 1))

    def _single(self, number: np.ndarray) -> np.ndarray:
        """Probability of words alone, by their continuation counts."""
        left = self._ranged(self.left_files, number, 1)[:, 0]
        share = 0.0
        if self.n_pairs:
            share = sum(d * n for d, n in zip(self.left_discounts, self.left_counts)) / self.n_pairs
        return _less(left, self.left_discounts) / max(1, self.n_pairs) + (share if self.n_pairs else 1.0) / (self.n_words + 1)

    def _log10_of_triples(self, tokens: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        low = self.lower
        number, count = low.words(tokens)
        before = low.before(number, edges)
        pair = low.pairs(before, number)[1]
        pair_before = self.before(pair, edges)
        left = self._ranged(self.left_files, pair, 1)[:, 0]
        paired = _interpolated(left, low._ranged(self.follow_files, before, 4), self.left_discounts, low._single(number))
        probability = _interpolated(
            self.pairs(pair_before, pair)[0], self._ranged(self.context_files, pair_before, 4), self.pair_discounts, paired
        )
        return np.log10(probability), count, low._base(count)


def _interpolated(count: np.ndarray, context: np.ndarray, d: tuple[float, ...], lower: np.ndarray) -> np.ndarray:
    """Discounted shares of counts in their contexts (total, and items counted 1, 2 and 3 or more times)."""
    total, rest = context[:, 0], context[:, 1:] @ np.array(d)
    return np.where(total > 0, (_less(count, d) + rest * lower) / np.maximum(total, 1), lower)


def _pair_key(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return (first.astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64)


def _less(count: np.ndarray, d: tuple[float, ...]) -> np.ndarray:
    return np.where(count > 0, count - np.array([0.0, *d])[np.minimum(count, 3)], 0.0)


def _vocabulary(docs: DataFrame, folder: str, bits: int) -> Model:
    shift = np.uint64(64 - bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0

        def flush() -> pa.RecordBatch:
            keys, counts = hash_arrays.sum_by_key(*(np.concatenate(x) for x in zip(*waiting)))
            return hash_arrays.count_blocks(keys, counts, (keys >> shift).astype(np.int64))

        for batch in batches:
            for _, tokens, _ in _token_slices(batch.column(0)):
                waiting.append(np.unique(tokens, return_counts=True))
                n += len(waiting[-1][0])
                if n >= COUNTED_AT_ONCE:
                    yield flush()
                    waiting, n = [], 0
        if n:
            yield flush()

    def merge(bucket: int, blocks: list[bytes]) -> dict[str, list]:
        keys, counts = hash_arrays.sum_by_key(*(np.concatenate(x) for x in zip(*map(hash_arrays.read_counts, blocks))))
        return {
            "bucket": pa.array([bucket], pa.int32()), "n": [len(keys)], "total": [int(counts.sum())],
            "keys": [write_array(folder, "words", keys)], "counts": [write_array(folder, "counts", counts)],
        }

    blocks = docs.select("text").mapInArrow(count, hash_arrays.BLOCK_SCHEMA)
    rows = hash_arrays.merge_buckets(
        blocks, merge, "bucket int, n bigint, total bigint, keys string, counts string"
    ).collect()  # one row per bucket
    rows.sort(key=lambda r: r.bucket)
    starts, n = {}, 0
    for r in rows:
        starts[r.bucket] = n
        n += r.n
    if n >= 1 << 32:
        raise ValueError("more distinct words than 32-bit numbers")
    files = HashSetFiles(folder, bits, {r.bucket: (r.keys, r.counts) for r in rows}, ("<u8", "<u8"))
    return Model(folder, files, starts, n, sum(r.total for r in rows), 1 << (bits // 2))


def _count_pairs(docs: DataFrame, model: Model) -> DataFrame:
    """Merged buckets of pairs (kind pair, with their files), and what they hold for contexts and left neighbours."""
    side = np.uint64(model.side)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0

        def flush() -> pa.RecordBatch:
            keys, counts = hash_arrays.sum_by_key(*(np.concatenate(x) for x in zip(*waiting)))
            bucket = (model.part(keys >> np.uint64(32)) * side + model.part(keys & np.uint64(0xFFFFFFFF))).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            return hash_arrays.count_blocks(keys[order], counts[order], bucket[order])

        for batch in batches:
            for _, tokens, edges in _token_slices(batch.column(0)):
                number, before = model.sequence(tokens, edges)
                waiting.append(np.unique(_pair_key(before, number), return_counts=True))
                n += len(waiting[-1][0])
                if n >= COUNTED_AT_ONCE:
                    yield flush()
                    waiting, n = [], 0
        if n:
            yield flush()

    def merge(bucket: int, blocks: list[bytes]) -> dict[str, list]:
        keys, counts = hash_arrays.sum_by_key(*(np.concatenate(x) for x in zip(*map(hash_arrays.read_counts, blocks))))
        first, second = keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF)
        at = np.flatnonzero(np.r_[True, first[1:] != first[:-1]])
        context = [np.add.reduceat(x.astype(np.uint64), at) for x in (counts, counts == 1, counts == 2, counts >= 3)]
        context_block = squeeze(pack_sorted(first[at]) + b"".join(map(pack_planes, context)))
        follower, lefts = np.unique(second, return_counts=True)
        return {
            "kind": ["pair", "context", "left"],
            "part": pa.array([bucket, bucket // model.side, bucket % model.side], pa.int32()),
            "keys": [write_array(model.folder, "pairs", keys), None, None],
            "counts": [write_narrow(model.folder, "pair-counts", counts), None, None],
            "block": pa.array([None, context_block, squeeze(pack_sorted(follower) + pack_planes(lefts))], pa.binary()),
            "sizes": [[int((counts == k).sum()) for k in (1, 2, 3, 4)] + [len(keys)], [], []],
        }

    blocks = docs.select("text").mapInArrow(count, hash_arrays.BLOCK_SCHEMA)
    return cut_lineage(
        hash_arrays.merge_buckets(
            blocks, merge, "kind string, part int, keys string, counts string, block binary, sizes array<bigint>"
        )
    )


def _dense(counted: DataFrame, model: Model, kind: str, width: int) -> list:
    """Sum the blocks of each range of words into one dense array; rows (part, file, sizes), one per range."""

    def merge(part: int, blocks: list[bytes]) -> dict[str, list]:
        start, end = model.part_start(part), model.part_start(part + 1)
        dense = np.zeros((end - start, width), np.uint64)
        for block in blocks:
            block = unsqueeze(block)
            keys, at = unpack_sorted(block)
            for k in range(width):
                values, at = unpack_planes(block, at)
                dense[(keys - np.uint64(start)).astype(np.int64), k] += values
        one = dense[:, 0]
        return {
            "part": pa.array([part], pa.int32()), "file": [write_narrow(model.folder, kind, dense.ravel())],
            "sizes": [[int((one == k).sum()) for k in (1, 2, 3, 4)] + [int((one >= 3).sum())]],
        }

    blocks = counted.where(F.col("kind") == kind).select(F.col("part").alias("bucket"), "block")
    return hash_arrays.merge_buckets(blocks, merge, "part int, file string, sizes array<bigint>").collect()


def _with_pairs(docs: DataFrame, model: Model, contexts: bool = True) -> None:
    """Count and set the pairs of ``model``, and its contexts if asked for."""
    counted = _count_pairs(docs, model)
    # one row per bucket
    buckets = counted.where("kind = 'pair'").select("part", "keys", "counts", "sizes").collect()
    buckets.sort(key=lambda r: r.part)
    model.pair_files = {r.part: (r.keys, r.counts) for r in buckets}
    for r in buckets:
        model.pair_starts[r.part] = model.n_pairs
        model.n_pairs += r.sizes[4]
    model.pair_discounts = discounts([sum(r.sizes[k] for r in buckets) for k in range(4)])
    if contexts:
        model.context_files = {r.part: r.file for r in _dense(counted, model, "context", 4)}
    lefts = _dense(counted, model, "left", 1)
    model.left_files = {r.part: r.file for r in lefts}
    sums = [sum(r.sizes[k] for r in lefts) for k in range(5)]
    model.left_discounts, model.left_counts = discounts(sums[:4]), (sums[0], sums[1], sums[4])


def _follow(spark: SparkSession, model: Model) -> None:
    """Set the contexts (by first word) of the continuation counts of the lower model's pairs."""
    low = model.lower

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, file in zip(*(c.to_pylist() for c in batch.columns)):
                lo, stored = model.part_start(part), NarrowArray(model.folder, file)
                left = stored[np.arange(min(len(stored), max(0, low.n_pairs - lo)))].astype(np.uint64)  # the start of a text has a number too
                first = low.first_words(lo, lo + len(left))
                order = np.argsort(first, kind="stable")
                first, left = first[order], left[order]
                at = np.flatnonzero(np.r_[True, first[1:] != first[:-1]]) if len(first) else np.empty(0, np.int64)
                for own in np.unique(low.part(first[at])) if len(at) else ():
                    here = low.part(first[at]) == own
                    sums = [np.add.reduceat(x.astype(np.uint64), at)[here] for x in (left, left == 1, left == 2, left >= 3)]
                    block = squeeze(pack_sorted(first[at][here]) + b"".join(map(pack_planes, sums)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(["follow"]), pa.array([int(own)], pa.int32()), pa.array([block], pa.binary())],
                        names=["kind", "part", "block"],
                    )

    files = spark.createDataFrame(sorted(model.left_files.items()), "part int, file string")  # one row per bucket
    blocks = files.repartition(max(1, len(model.left_files)), "part").mapInArrow(run, "kind string, part int, block binary")
    model.follow_files = {r.part: r.file for r in _dense(blocks, low, "follow", 4)}


def train(docs: DataFrame, order: int = 2) -> Model:
    """The model of order 2 or 3 of all texts of ``docs`` (text); a null text is an empty one. No rows give a model without words."""
    if order not in (2, 3):
        raise ValueError("the order must be 2 or 3")
    folder = f"{shared_folder(docs.sparkSession)}/ngrams-{uuid.uuid4().hex}"
    bits = hash_arrays.bucket_bits(hash_arrays.text_size(docs))
    model = _vocabulary(docs, folder, bits + bits % 2)
    _with_pairs(docs, model, order == 2)
    if order == 2:
        return model
    if model.n_pairs + 1 >= 1 << 32:
        raise ValueError("more distinct pairs than 32-bit numbers")
    triples = Model(folder, model.vocabulary, model.starts, model.n_pairs, model.n_tokens, 2 * model.side, lower=model)
    _with_pairs(docs, triples)
    _follow(docs.sparkSession, triples)
    return triples


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with n_tokens, n_known, train_tokens, base_score, score and perplexity.

    A token is a word (a run of bytes other than ASCII white space, A-Z in lower case) or the end of the text. ``score`` is the
    log10 probability of the text by the model, ``base_score`` that by single words with one added to all counts, perplexity is
    10 to the minus mean score of a token. A null text is an empty one. Columns of these names are replaced, all others are kept.
    """
    added = ["n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]
    docs = docs.drop(*added)
    text_at, names_out = docs.columns.index("text"), [*docs.columns, *added]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # names of files only

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shipped.value
        for batch in batches:
            found = [np.empty((0, 4))]
            for _, tokens, edges in _token_slices(batch.column(text_at)):
                log, count, base = known.log10(tokens, edges)
                first = edges[:-1]
                found.append(
                    np.stack(
                        [np.diff(edges), np.add.reduceat((count > 0).astype(np.int64), first),
                         np.add.reduceat(base, first), np.add.reduceat(log, first)], axis=1,
                    )
                )
            n, n_known, base, log = np.concatenate(found).T
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(n.astype(np.int64)), pa.array(n_known.astype(np.int64)),
                 pa.array(np.full(len(n), known.n_tokens)), pa.array(base), pa.array(log), pa.array(10 ** (-log / n))],
                names=names_out,
            )

    return docs.mapInArrow(
        run, f"{schema}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, perplexity double"
    )
