"""Spelling variants of a corpus's words, by blocked Gram matrices of letter counts.

Two words that differ by one inserted, deleted or replaced letter have letter counts whose squared distance is 1 or at most 2, and lengths that are
equal or adjacent. Words are blocked by length and by how many of their letters fall into each of a few groups of letters. A word meets others in its
own block and, once for each group, in the block it would have with one letter of that group less: so words with one letter more or less,
and words with one letter replaced, meet in exactly one block. There the product of the count matrix with itself gives all squared
distances, and pairs of at most 2 have their edit verified on the letters. Blocks beyond a size are cut into slices that meet pair by pair.

The number of letter groups rises with the vocabulary, so blocks stay small; it has no influence on the result.
"""

from collections.abc import Iterator
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from logloom.session import cut_lineage

#: letters of Latin-1: a word is a longest run of these
LETTERS = "[A-Za-zÀ-ÿ]+"
LEAST_LENGTH = 5
LEAST_COUNT = 3
COLUMNS = 32  # of the count matrices; letters whose code points are equal modulo 32 share one
BLOCK_WORDS = 8192  # larger blocks are sliced
TASK_WORDS = 60_000  # words of many blocks that are worked on together
TILE = 1 << 20
LONG = 2000  # letters; longer words are counted in double precision
WHOLE = -1


def runs(text: Column) -> Column:
    """All runs of letters of a text; null if it is null."""
    return F.regexp_extract_all(text, F.lit(LETTERS), 0)


def without_letter(word: Column, place: Column) -> Column:
    """``word`` without the letter at ``place`` (from 0)."""
    return F.concat(F.substring(word, F.lit(1), place), F.substring(word, place + 2, F.char_length(word)))


def vocabulary(words: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words (word, one row per place) that are long and frequent enough; null words count nowhere."""
    long = words.where(F.char_length("word") >= least_length)
    return long.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def letter_groups(words: DataFrame, n_words: int) -> np.ndarray:
    """The group of each code point below 256; groups hold about equally many letters of the words' letters."""
    n = max(2, min(24, round(log2(max(n_words, 1) / 1500)) + 3))
    # at most one row per letter of Latin-1
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).groupBy("letter").agg(F.count("*").alias("n"))
    group, load = np.zeros(256, np.int64), np.zeros(n)
    for row in sorted(letters.collect(), key=lambda r: (-r.n, r.letter)):
        lightest = int(load.argmin())
        group[ord(row.letter)] = lightest
        load[lightest] += row.n
    group[0] = n  # their number
    return group


def _letters(words: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all words, offsets)."""
    coded = [w.encode("latin-1") for w in words.to_pylist()]
    return np.frombuffer(b"".join(coded), np.uint8), np.r_[0, np.cumsum([len(w) for w in coded], dtype=np.int64)]


def _counts(data: np.ndarray, offsets: np.ndarray, column: np.ndarray, n: int) -> np.ndarray:
    """How many letters of each word fall into each of ``n`` columns."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    return np.bincount(row * n + column[data], minlength=(len(offsets) - 1) * n).reshape(-1, n)


def blocked(words: DataFrame, group: np.ndarray) -> DataFrame:
    """Words (word, n) with the ``block`` in which they stand whole (role -1) or with one letter of a group left out (role: the group)."""
    n = int(group[0])
    power = np.random.default_rng(11).integers(1, 1 << 63, n, np.uint64) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _letters(batch["word"])
            counts = _counts(data, offsets, group, n)
            own = (counts.astype(np.uint64) * power).sum(axis=1, dtype=np.uint64)  # counts of the groups, and so the length too
            rows, role = [np.arange(len(own))], [np.full(len(own), WHOLE)]
            block = [own]
            for g in range(n):
                some = np.flatnonzero(counts[:, g])
                rows.append(some)
                role.append(np.full(len(some), g))
                block.append(own[some] - power[g])
            taken = batch.select(["word", "n"]).take(pa.array(np.concatenate(rows)))
            yield pa.RecordBatch.from_arrays(
                [*taken.columns, pa.array(np.concatenate(block).view(np.int64)), pa.array(np.concatenate(role).astype(np.int32))],
                names=["word", "n", "block", "role"],
            )

    return words.select("word", "n").mapInArrow(run, "word string, n long, block long, role int")


def _edits(letters: np.ndarray, length: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs (i, j) of rows of a padded letter matrix differ by exactly one edit."""
    near = np.zeros(len(i), bool)
    shift = length[j] - length[i]
    swap = shift < 0
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    width = letters.shape[1]
    for lo in range(0, len(i), max(1, 16 * TILE // max(1, width))):
        at = slice(lo, lo + max(1, 16 * TILE // max(1, width)))
        x, y, adjacent = letters[i[at]], letters[j[at]], shift[at] != 0
        apart = x != y
        one = ~adjacent & (apart.sum(axis=1) == 1)
        # an insertion: equal up to a place, and equal after it with the longer word moved by one
        moved = x[:, : width - 1] != y[:, 1:]
        moved &= np.arange(width - 1) < length[i[at]][:, None]
        first = apart.argmax(axis=1)
        last = np.where(moved.any(axis=1), width - 2 - moved[:, ::-1].argmax(axis=1), -1)
        near[at] = one | adjacent & (np.abs(shift[at]) == 1) & (last < first)
    return near


def near_in_block(
    counts: np.ndarray, letters: np.ndarray, length: np.ndarray, role: np.ndarray, part: np.ndarray | None
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of a block's words that are one edit apart; with ``part`` only pairs of different parts.

    Two words that both lack a letter of one group meet in another block and are left out.
    """
    half = (counts * counts).sum(axis=1) / 2
    place = np.arange(len(counts))
    out = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for lo in range(0, len(counts), max(1, TILE // len(counts))):
        some = place[lo : lo + max(1, TILE // len(counts))]
        # half the squared distance of all pairs of rows
        square = half[some, None] + half[None, lo:] - counts[some] @ counts[lo:].T
        i, j = np.divmod(np.flatnonzero(square <= 1), len(counts) - lo)
        i, j = i + lo, j + lo
        kept = (i < j) & ((role[i] != role[j]) | (role[i] == WHOLE))
        if part is not None:
            kept &= part[i] != part[j]
        i, j = i[kept], j[kept]
        near = _edits(letters, length, i, j)
        out.append((i[near], j[near]))
    i, j = (np.concatenate(side) for side in zip(*out))
    return i, j


def _best(word_rank: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, number of its near rows, the one of largest n, the first in order of words among equals)."""
    source, other = np.r_[i, j], np.r_[j, i]
    order = np.lexsort((word_rank[other], -n[other], source))
    source, other = source[order], other[order]
    first = np.flatnonzero(np.r_[True, np.diff(source) > 0]) if len(source) else np.empty(0, np.int64)
    return source[first], np.diff(np.r_[first, len(source)]), other[first]


def _search(table: pa.Table) -> pa.Table:
    """Near words in all blocks of a task: (word, n_near, near_n, near) for each row that has any."""
    table = table.sort_by([("block", "ascending"), ("a", "ascending"), ("b", "ascending")])
    words = np.array(table["word"].to_pylist(), object)
    data, offsets = _letters(table["word"])
    length = np.diff(offsets)
    exact = np.float64 if length.max(initial=0) > LONG else np.float32
    fold = np.arange(256) % COLUMNS
    n, role, own = (table[c].to_numpy() for c in ("n", "role", "slice"))
    block, a, b = (table[c].to_numpy() for c in ("block", "a", "b"))
    starts = np.flatnonzero(np.r_[True, (np.diff(block) != 0) | (np.diff(a) != 0) | (np.diff(b) != 0)]) if len(n) else []
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for s, e in zip(starts, [*starts[1:], len(n)]):
        if e - s == 1:
            continue
        width = int(length[s:e].max()) + 1
        at = offsets[s:e, None] + np.arange(width)
        inside = np.arange(width) < length[s:e, None]
        letters = np.where(inside, data[np.minimum(at, len(data) - 1)], 0).astype(np.uint8)
        counts = _counts(data[offsets[s] : offsets[e]], offsets[s : e + 1] - offsets[s], fold, COLUMNS).astype(exact)
        i, j = near_in_block(counts, letters, length[s:e], role[s:e], own[s:e] if a[s] != b[s] else None)
        found.append((i + s, j + s))
    i, j = (np.concatenate(side) for side in zip(*found))
    met, place = np.unique(np.r_[i, j], return_inverse=True)
    rank = np.empty(len(met), np.int64)
    rank[sorted(range(len(met)), key=lambda k: words[met[k]])] = np.arange(len(met))
    row, n_near, best = _best(rank, n[met], place[: len(i)], place[len(i) :])
    return pa.table(
        {
            "word": pa.array(words[met[row]], pa.string()), "n_near": pa.array(n_near, pa.int64()),
            "near_n": pa.array(n[met[best]], pa.int64()), "near": pa.array(words[met[best]], pa.string()),
        }
    )


def near_words(words: DataFrame, block_words: int = BLOCK_WORDS, task_words: int = TASK_WORDS) -> DataFrame:
    """(word, n_near, near, near_n) of the words (word, n) with others one edit away: their number, and the one of largest n (ties: the smallest).

    ``words`` is a stored table of distinct words made of Latin-1 letters.
    """
    n_words = words.count()
    rows = cut_lineage(blocked(words, letter_groups(words, n_words)))
    n_tasks = max(1, rows.count() // task_words)
    load = F.sum(1 + F.floor(F.char_length("word") / 64))
    large = rows.groupBy("block").agg(load.alias("_load")).where(F.col("_load") > block_words)
    large = large.select("block", F.ceil(F.col("_load") / block_words).cast("int").alias("slices"))
    sliced = (
        rows.join(large, "block", "left")
        .withColumn("slices", F.coalesce("slices", F.lit(1)))
        .withColumn("slice", F.pmod(F.xxhash64("word"), F.col("slices")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        .withColumn("a", F.least("slice", "_other"))
        .withColumn("b", F.greatest("slice", "_other"))
        .withColumn("_task", F.pmod(F.xxhash64("block", "a", "b"), F.lit(n_tasks)))
        .select("_task", "word", "n", "block", "role", "slice", "a", "b")
    )
    found = sliced.groupBy("_task").applyInArrow(_search, "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("_best")).select(
        "word", "n_near", F.col("_best.near").alias("near"), (-F.col("_best.less")).alias("near_n")
    )


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words (word, form): forms are followed to the last, twice as far in every round.

    A form is at least twice as frequent as its word, so no chain is longer than the logarithm of the largest count.
    """
    links = cut_lineage(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("open")))
    while not links.where("open").isEmpty():
        further = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        # only what led on in the round before looks further, so a common root is no hot key for long
        looked = links.where("open").join(further, "root", "left").select(
            "word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("open")
        )
        links = cut_lineage(looked.unionByName(links.where("NOT open")))
    return links.select("word", "root")


def variants(words: DataFrame, block_words: int = BLOCK_WORDS, task_words: int = TASK_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word (word, n).

    ``form`` is the near word of largest n if that is at least twice the word's own, else null with ``form_n``; ``root`` is the end
    of the chain of forms, the word itself if it has no form.
    """
    words = cut_lineage(words.select("word", "n"))
    near = near_words(words, block_words, task_words)
    kept = F.col("near_n") >= 2 * F.col("n")
    known = cut_lineage(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(kept, F.col("near")).alias("form"), F.when(kept, F.col("near_n")).alias("form_n"),
        )
    )
    roots = _roots(known.where("form IS NOT NULL"))
    return known.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )

