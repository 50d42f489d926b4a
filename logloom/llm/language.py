"""Language of texts by a linear-chain conditional random field over their words.

A word's score per language adds up the weights of its character n-grams (those that touch the word's ends are its
affixes) and of the lexicons it stands in; learned transitions connect neighbouring words. Forward-backward gives every
word's probabilities, so that a text may switch languages; a text's language is the one with the largest mean.
The field is fitted on a bounded sample: runs of words of different texts are put together, which teaches it to switch.
"""

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from logloom.llm import worker_memory, words
from logloom.llm.samples import in_task, narrow, remainder, stored_sample

NGRAMS = (2, 3, 4, 5)
TABLE_BITS = 17
PER_LANGUAGE = 250
LEXICON_COUNT = 3
LEXICON_SHARE = 0.6
RUN_WORDS = (4, 40)
SEQUENCE = 64
EPOCHS = 6
STEP = 0.15
UNDETERMINED = "und"
#: words whose probabilities are computed together
WORDS_AT_ONCE = 250_000


def _features(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(table cells of all words' n-grams, first cell of each word)."""
    size = end - start + 2
    offset = np.cumsum(size) - size
    text = np.zeros(int(size.sum()), np.uint64)
    word = np.repeat(np.arange(len(start)), size)
    place = np.arange(len(text)) - offset[word]
    inside = (place > 0) & (place < size[word] - 1)
    text[inside] = words._LOWER[data[(start[word] + place - 1)[inside]]]
    text[offset] = 1
    text[offset + size - 1] = 2
    cells, owner = [], []
    code = np.zeros(len(text), np.uint64)
    for n in range(1, max(NGRAMS) + 1):
        code[: len(text) - n + 1] = code[: len(text) - n + 1] * np.uint64(257) + text[n - 1 :]
        if n in NGRAMS:
            at = np.flatnonzero(place + n <= size[word])
            cells.append((words.mix(code[at] + np.uint64(n)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64))
            owner.append(word[at])
    cells, owner = np.concatenate(cells), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return cells[order], np.searchsorted(owner[order], np.arange(len(start)))


@dataclass
class Field:
    languages: list[str]
    weights: np.ndarray  # cells x languages
    lexicon: np.ndarray  # sorted word hashes
    belongs: np.ndarray  # word x languages, 0 or 1
    lexical: np.ndarray  # languages x languages
    transitions: np.ndarray

    def emissions(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Scores of words, computed once per distinct word."""
        if not len(hashes):
            return np.empty((0, len(self.languages)), np.float32)
        distinct, index, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        cells, first = _features(data, start[index], end[index])
        scores = np.add.reduceat(self.weights[cells], first, axis=0)
        if len(self.lexicon):
            at = np.minimum(np.searchsorted(self.lexicon, distinct), len(self.lexicon) - 1)
            scores = scores + (self.belongs[at] * (self.lexicon[at] == distinct)[:, None]) @ self.lexical
        return scores[inverse].astype(np.float32)

    def marginals(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Probabilities of every word by forward-backward; all sequences advance together, word by word."""
        n_labels = len(self.languages)
        order = np.argsort(-lengths, kind="stable")
        begin = (np.cumsum(lengths) - lengths)[order]
        lengths = lengths[order]
        local = np.exp(scores - scores.max(axis=1, keepdims=True)) + 1e-12
        switch = np.exp(self.transitions - self.transitions.max()).astype(np.float32)
        forward = np.empty_like(local)
        active = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), "left")
        state = np.full((len(lengths), n_labels), 1.0, np.float32)
        for t, n in enumerate(active):
            at = begin[:n] + t
            state = (state[:n] @ switch if t else state[:n]) * local[at]
            state /= state.sum(axis=1, keepdims=True)
            forward[at] = state
        backward = np.ones((len(lengths), n_labels), np.float32)
        for t in range(len(active) - 1, -1, -1):
            at = begin[: active[t]] + t
            b = backward[: active[t]]
            found = forward[at] * b
            forward[at] = found / found.sum(axis=1, keepdims=True)
            b = (b * local[at]) @ switch.T
            backward[: active[t]] = b / b.sum(axis=1, keepdims=True)
        return forward


    def pairs(self, scores: np.ndarray, rows: int) -> np.ndarray:
        """Expected number of each pair of neighbouring labels in ``rows`` sequences of equal length.

        A pair's probability is what comes forward to its left word, times the transition, times the right word's own score and what comes back to it.
        """
        n = len(self.languages)
        local = (np.exp(scores - scores.max(axis=1, keepdims=True)) + 1e-12).reshape(rows, -1, n)
        switch = np.exp(self.transitions - self.transitions.max())
        forward, total = [local[:, 0]], np.zeros((n, n))
        for t in range(1, local.shape[1]):
            state = (forward[-1] / forward[-1].sum(axis=1, keepdims=True)) @ switch * local[:, t]
            forward.append(state)
        backward = np.ones((rows, n))
        for t in range(local.shape[1] - 1, 0, -1):
            right = local[:, t] * backward
            pair = forward[t - 1][:, :, None] * switch[None] * right[:, None, :]
            total += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            backward = right @ switch.T
            backward /= backward.sum(axis=1, keepdims=True)
        return total


def fit(texts: list[str], labels: list[str], epochs: int = EPOCHS) -> Field | None:
    """A field over the labels of ``texts``; None without any words."""
    data, offsets = words.text_bytes(pa.array(texts, pa.string()))
    start, end, first = words.spans(data, offsets, words.LETTERS)
    if not len(start):
        return None
    languages = sorted(set(labels))
    of_text = np.array([languages.index(x) for x in labels])
    label = np.repeat(of_text, np.diff(first))
    hashes = words.word_hashes(data, start, end)
    distinct, index, kind = np.unique(hashes, return_index=True, return_inverse=True)
    counts = np.zeros((len(distinct), len(languages)))
    np.add.at(counts, (kind, label), 1)
    share = counts / counts.sum(axis=1, keepdims=True)
    member = (counts >= LEXICON_COUNT) & (share >= LEXICON_SHARE)
    listed = member.any(axis=1)
    belongs = member.astype(np.float32)
    cells, cell_first = _features(data, start[index], end[index])
    cell_count = np.diff(np.r_[cell_first, len(cells)])

    rng = np.random.default_rng(7)
    by_label = [np.flatnonzero((of_text == k) & (np.diff(first) > 0)) for k in range(len(languages))]
    n = len(languages)
    weights, lexical = np.zeros((1 << TABLE_BITS, n), np.float32), np.zeros((n, n), np.float32)
    transitions = np.zeros((n, n), np.float32)
    squares = [np.full_like(x, 1e-3) for x in (weights, lexical, transitions)]
    usable = [k for k in range(n) if len(by_label[k])]
    n_sequences = min(6000, max(64, len(start) // SEQUENCE))
    model = Field(languages, weights, distinct[listed], belongs[listed], lexical, transitions)
    for _ in range(epochs):
        for _ in range(-(-n_sequences // 64)):
            rows = []
            for _ in range(64):
                sequence: list[np.ndarray] = []
                while sum(map(len, sequence)) < SEQUENCE:
                    text = rng.choice(by_label[rng.choice(usable)])
                    length = int(rng.integers(*RUN_WORDS))
                    at = int(rng.integers(first[text], first[text + 1]))
                    sequence.append(np.arange(at, min(at + length, first[text + 1])))
                rows.append(np.concatenate(sequence)[:SEQUENCE])
            at = np.concatenate(rows)
            types, local = np.unique(kind[at], return_inverse=True)
            owner = np.repeat(np.arange(len(types)), cell_count[types])
            where = np.repeat(cell_first[types], cell_count[types]) + np.arange(len(owner)) - np.repeat(
                np.cumsum(cell_count[types]) - cell_count[types], cell_count[types]
            )
            own = cells[where]
            scores = np.zeros((len(types), n), np.float32)
            np.add.at(scores, owner, weights[own])
            scores += belongs[types] @ lexical
            # the gradient of the log likelihood: observed minus expected
            given = label[at]
            probability = model.marginals(scores[local], np.full(64, SEQUENCE))
            error = np.eye(n, dtype=np.float32)[given] - probability
            by_type = np.zeros((len(types), n), np.float32)
            np.add.at(by_type, local, error)
            table = np.zeros_like(weights)
            np.add.at(table, own, by_type[owner])
            seen = np.zeros((n, n), np.float32)
            chain = given.reshape(64, SEQUENCE)
            np.add.at(seen, (chain[:, :-1].ravel(), chain[:, 1:].ravel()), 1)
            expected = model.pairs(scores[local], 64)
            for value, slope, square in zip(
                (weights, lexical, transitions), (table, belongs[types].T @ by_type, seen - expected), squares
            ):
                square += slope * slope
                value += STEP * slope / np.sqrt(square)
    return model


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Field | None:
    """Fit on at most ``per_language`` texts of each non-null lang, none of them held out (crc32 of doc_id mod 4 is 2)."""
    usable = docs.where((remainder(4) != 2) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    labelled = narrow(usable.select("doc_id", "text", F.col("lang").alias("label")))
    sample = stored_sample(usable, labelled, per_language)
    return pickle.loads(in_task(sample, lambda _, texts, labels: pickle.dumps(fit(texts, labels)))) if sample is not None else None


def predict(docs: DataFrame, model: Field | None, prefix: str = "") -> DataFrame:
    """``docs`` with lang_pred and score (names behind ``prefix``), the mean probability of that language over all words of the text.

    A text that is null or has no letter gets ``und`` and score 0, and so does every text without a model. Columns of these two
    names are replaced, all others are kept; nulls and repeated rows are predicted like any other.
    """
    added = [f"{prefix}lang_pred", f"{prefix}score"]
    docs = docs.drop(*added)
    letters_name = "_letters"
    while letters_name in docs.columns:
        letters_name += "_"
    source = docs.withColumn(letters_name, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    text_at, names_out = docs.columns.index("text"), [*docs.columns, *added]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # a table of fixed size per language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory.only()
        field = shipped.value
        for batch in batches:
            score = np.zeros(batch.num_rows)
            best = np.full(batch.num_rows, -1)
            letters = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)

            def finish(waiting: list) -> None:
                scores = np.concatenate([x for x, _, _ in waiting])
                lengths = np.concatenate([x for _, x, _ in waiting])
                rows = np.concatenate([x for _, _, x in waiting])
                found = field.marginals(scores, lengths)
                filled = lengths > 0
                begin = (np.cumsum(lengths) - lengths)[filled]
                mean = np.add.reduceat(found.astype(np.float64), begin, axis=0) / lengths[filled][:, None] if len(begin) else np.empty((0, 1))
                best[rows[filled]] = mean.argmax(axis=1)
                score[rows[filled]] = np.minimum(mean.max(axis=1), 1.0)

            waiting, n = [], 0
            for lo, data, start, end, first in words.parts(batch.column(text_at), words.LETTERS) if field else ():
                scores = field.emissions(data, start, end, words.word_hashes(data, start, end))
                waiting.append((scores, np.diff(first), lo + np.arange(len(first) - 1)))
                n += len(scores)
                if n >= WORDS_AT_ONCE:
                    finish(waiting)
                    waiting, n = [], 0
            if n:
                finish(waiting)
            known = (best >= 0) & letters
            names = [field.languages[k] if ok else UNDETERMINED for k, ok in zip(best, known)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(names, pa.string()), pa.array(np.where(known, score, 0.0))],
                names=names_out,
            )

    return source.mapInArrow(run, f"{schema}, `{added[0]}` string, `{added[1]}` double")
