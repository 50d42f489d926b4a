"""Toxicity by the nearest labelled examples in TF-IDF space.

Terms are all words of the examples and their first letters, weighted by their document frequencies over all documents and by whether
they tell the labels of the examples apart: a term whose labels chance could explain counts with a small fixed share. The examples form an inverted index of sparse postings with the largest
weight per term and block, and of whole rows for the terms that most examples share: a text visits the blocks in the order of their bounds and leaves out those that hold no nearer
example, so its neighbours by cosine are exact. Examples that tie for the last place share its vote, and a text without known terms gets the base rate. The votes, weighted by
nearness, are calibrated on folds of the examples, each scored by the others with weights that have not seen its labels.
"""

import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from logloom.llm import worker_memory, words
from logloom.llm.hash_arrays import map_array, write_array
from logloom.llm.samples import in_task, narrow, remainder, stored_sample
from logloom.session import shared_folder

PREFIXES = (4, 5, 6, 7, 8)  # bytes
PER_LABEL = 1500
NEIGHBOURS = 15
BLOCK = 64
CHANCE = 0.05
LEAST_WEIGHT = 0.05  # of a term that does not tell the labels apart
VISITED_FIRST = 4  # blocks
FOLDS = 5
DEALS = 3
LEAST_SLOPE = 0.1
EQUAL = 1e-6  # cosines this near are a tie
LONG_LIST = 16  # a term that stands in more than one of so many examples is frequent
ROWS = 4096  # most frequent terms held as rows; the others keep lists, whatever their length
TEXTS = 64  # scored together
PILOTS = 16  # texts of a slice that look at the bounds of blocks in any case
MOST_CELLS = 0.5  # visited by these: the others go through whole lists, without bounds
TERM_BYTES = 500_000  # of text whose terms are looked up together


def _terms(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per slice: (first text, text of every term, term hash, words per text)."""
    for lo, data, start, end, first in words.parts(column, words.ALPHANUMERIC):
        total = words.running_hash(data)
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        found, owner = [words.span_hashes(total, start, end)], [doc]
        for n in PREFIXES:
            long = np.flatnonzero(end - start > n)
            found.append(words.mix(words.span_hashes(total, start[long], start[long] + n) + np.uint64(n)))
            owner.append(doc[long])
        yield lo, np.concatenate(owner), np.concatenate(found), np.diff(first)


def _places(terms: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which hashes are terms, their places among the sorted terms)."""
    if not len(terms):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.minimum(np.searchsorted(terms, hashes), len(terms) - 1)
    kept = np.flatnonzero(terms[at] == hashes)
    return kept, at[kept]


def _known_terms(column: pa.Array, terms: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """Per slice: (first text, text of every term that is among ``terms``, its place there, number of texts).

    What ``_terms`` and ``_places`` give in another order; a word that stands in a slice many times is cut and looked up once.
    """
    for lo, data, start, end, first in words.parts(column, words.ALPHANUMERIC, TERM_BYTES):
        total = words.running_hash(data)
        distinct, index, inverse = np.unique(words.span_hashes(total, start, end), return_index=True, return_inverse=True)
        start, end = start[index], end[index]
        place = np.full((1 + len(PREFIXES), len(distinct)), -1, np.int64)
        kept, at = _places(terms, distinct)
        place[0, kept] = at
        for i, n in enumerate(PREFIXES, 1):
            long = np.flatnonzero(end - start > n)
            kept, at = _places(terms, words.mix(words.span_hashes(total, start[long], start[long] + n) + np.uint64(n)))
            place[i, long[kept]] = at
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        owners, found = [], []
        for row in place:
            at = row[inverse]
            kept = at >= 0
            owners.append(doc[kept])
            found.append(at[kept])
        yield lo, np.concatenate(owners), np.concatenate(found), len(first) - 1


def _cells(owner: np.ndarray, at: np.ndarray, n_terms: int, n_texts: int) -> np.ndarray:
    """One number for each text and term, sorted; narrow ones sort faster."""
    cell = owner * n_terms + at
    if n_texts * n_terms < 1 << 31:
        cell = cell.astype(np.int32)
    cell.sort()
    return cell


def _firsts(cell: np.ndarray) -> np.ndarray:
    """Where each distinct value of a sorted array begins."""
    return np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.empty(0, np.int64)


def _ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(all numbers of the ranges one after the other, the range of each)."""
    size = end - start
    own = np.repeat(np.arange(len(size)), size)
    return np.arange(len(own)) + np.repeat(start - np.cumsum(size) + size, size), own


def _unit_vectors(doc: np.ndarray, term: np.ndarray, count: np.ndarray, term_weight: np.ndarray, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(terms, weights) of ``n`` texts; the entries are in the order of the texts."""
    weight = (np.log1p(count, dtype=np.float32) * term_weight.astype(np.float32)[term]).astype(np.float32)
    norm = np.sqrt(np.bincount(doc, weights=weight * weight, minlength=n)).astype(np.float32)
    weight /= norm[doc]
    first = np.searchsorted(doc, np.arange(n + 1))
    return [(term[a:b], weight[a:b]) for a, b in zip(first[:-1], first[1:])]


class Example(NamedTuple):
    doc_id: int | None
    text: str
    label: int


@dataclass
class Examples:
    terms: np.ndarray  # sorted hashes of all terms of the examples
    weight: np.ndarray  # per term
    ids: np.ndarray
    toxic: np.ndarray  # labels in the order of the index
    class_weight: np.ndarray  # per label: rows of the training part for each example
    # postings by term and place; cells by term and block, each with its first posting and its largest weight
    post_place: np.ndarray
    post_weight: np.ndarray
    cell_first: np.ndarray  # one more than cells
    cell_block: np.ndarray
    cell_bound: np.ndarray
    term_first: np.ndarray  # first cell per term and one more
    # postings of frequent terms are whole rows, place by place; these terms have no cells
    row: np.ndarray  # per term, -1 for all others
    rows: np.ndarray
    curve: tuple[float, float]

    @property
    def n_blocks(self) -> int:
        return -(-len(self.ids) // BLOCK)

    @property
    def blocks(self) -> np.ndarray:
        """The index as a dense array, block x term x place; for small examples."""
        dense = np.zeros((self.n_blocks, len(self.terms), BLOCK), np.float32)
        cell = np.repeat(np.arange(len(self.cell_block)), np.diff(self.cell_first))
        term = np.repeat(np.arange(len(self.terms)), np.diff(self.term_first))
        dense[self.post_place // BLOCK, term[cell], self.post_place % BLOCK] = self.post_weight
        place = np.arange(len(self.ids))
        frequent = np.flatnonzero(self.row >= 0)
        dense[place[None, :] // BLOCK, frequent[:, None], place[None, :] % BLOCK] = self.rows[self.row[frequent]]
        return dense

    def index(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Postings of the examples' vectors, in their order."""
        place = np.repeat(np.arange(len(vectors), dtype=np.int32), [len(t) for t, _ in vectors])
        term, weight = (np.concatenate(x) for x in zip(*vectors))
        order = np.argsort(term, kind="stable").astype(np.int32)  # places ascend already
        place, term, weight = place[order], term[order], weight[order]
        del order
        held = np.bincount(term, minlength=len(self.terms))
        frequent = np.argsort(-held, kind="stable")[:ROWS]
        frequent = frequent[held[frequent] * LONG_LIST >= max(1, len(vectors))]
        self.row = np.full(len(self.terms), -1, np.int32)
        self.row[frequent] = np.arange(len(frequent))
        self.rows = np.zeros((len(frequent), len(vectors)), np.float32)
        long = self.row[term] >= 0
        self.rows[self.row[term[long]], place[long]] = weight[long]
        place, term, weight = place[~long], term[~long], weight[~long]
        block = place // BLOCK
        new = np.r_[True, (term[1:] != term[:-1]) | (block[1:] != block[:-1])] if len(term) else np.empty(0, bool)
        first = np.flatnonzero(new)
        self.post_place, self.post_weight = place.astype(np.int32), weight
        self.cell_first, self.cell_block = np.append(first, len(term)).astype(np.int32), block[first].astype(np.int32)
        self.cell_bound = np.maximum.reduceat(weight, first) if len(first) else np.empty(0, np.float32)
        self.term_first = np.searchsorted(term[first], np.arange(len(self.terms) + 1)).astype(np.int32)

    def vectors(self, column: pa.Array) -> Iterator[tuple[int, list[tuple[np.ndarray, np.ndarray]]]]:
        """Per slice the unit vectors of its texts as (terms, weights)."""
        for lo, owner, at, n_texts in _known_terms(column, self.terms):
            cell = _cells(owner, at, len(self.terms), n_texts)
            first = _firsts(cell)
            doc, term = np.divmod(cell[first], max(1, len(self.terms)))
            count = np.diff(first, append=len(cell))
            yield lo, _unit_vectors(doc, term, count, self.weight, n_texts)

    def frequent(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What the frequent terms of some texts add to the cosine with every example."""
        row = [self.row[t] for t, _ in vectors]
        own = np.repeat(np.arange(len(vectors)), [len(r) for r in row])
        row, weight = np.concatenate(row), np.concatenate([w for _, w in vectors])
        held = row >= 0
        queries = np.zeros((len(vectors), len(self.rows)), np.float32)
        queries[own[held], row[held]] = weight[held]
        return queries @ self.rows

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, cosines) of the k nearest examples, nearest first; ties are in the order of a hash."""
        places, cosines = self.with_ties(terms, weights, k)
        return places[:k], cosines[:k]

    def with_ties(
        self, terms: np.ndarray, weights: np.ndarray, k: int, known: np.ndarray | None = None, shares: list[float] | None = None
    ) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest examples and all others that tie with the k-th; ``known`` is the text's row of ``frequent``.

        ``shares`` collects the shares of cells that the first texts visit. Where bounds leave few out, later texts
        go through whole lists instead; the sums are the same.
        """
        cosine = (self.frequent([(terms, weights)])[0] if known is None else known).astype(np.float32)
        if not len(cosine):
            return np.empty(0, np.int64), cosine
        if shares is not None and len(shares) >= PILOTS and sum(shares) > MOST_CELLS * len(shares):
            cosine += self._whole_lists(terms, weights)
            return self._best(np.arange(len(cosine)), cosine, k)
        cells, own = _ranges(self.term_first[terms], self.term_first[terms + 1])
        block, weight = self.cell_block[cells], weights[own]
        # a block's best frequent part and the largest weights of its other terms bound its cosines
        bound = np.maximum.reduceat(cosine, np.arange(0, len(cosine), BLOCK))
        bound = bound + np.bincount(block, weights=weight * self.cell_bound[cells], minlength=self.n_blocks)
        first = np.zeros(self.n_blocks, bool)
        first[np.argsort(-bound, kind="stable")[: VISITED_FIRST + k // BLOCK]] = True
        cosine += self._cosines(cells, weight, first[block])
        held = np.flatnonzero(np.repeat(first, BLOCK)[: len(self.ids)])
        least = np.partition(cosine[held], len(held) - k)[len(held) - k] if len(held) >= k else -1.0
        more = ~first & (bound + EQUAL >= least)
        if more.any():
            cosine += self._cosines(cells, weight, more[block])
            held = np.flatnonzero(np.repeat(first | more, BLOCK)[: len(self.ids)])
        if shares is not None and len(shares) < PILOTS:
            shares.append(float((first | more)[block].mean()) if len(block) else 0.0)
        return self._best(held, cosine, k)

    def _best(self, held: np.ndarray, cosine: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest of some places and their ties, nearest first."""
        if len(held) > k:
            kth = np.partition(cosine[held], len(held) - k)[len(held) - k]
            held = held[cosine[held] >= kth - EQUAL]
            cosine[held] = np.where(cosine[held] <= kth + EQUAL, kth, cosine[held])
        order = held[np.lexsort((words.mix(self.ids[held].astype(np.uint64)), -cosine[held]))]
        return order, cosine[order]

    def votes(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int) -> Iterator[tuple[float, np.ndarray]]:
        """(vote, places of the nearest and their ties) of each text."""
        shares: list[float] = []
        for lo in range(0, len(vectors), TEXTS):
            some = vectors[lo : lo + TEXTS]
            for (terms, weights), known in zip(some, self.frequent(some)):
                places, cosines = self.with_ties(terms, weights, k, known, shares)
                yield self.vote(places, cosines, k), places

    def _cosines(self, cells: np.ndarray, weight: np.ndarray, visited: np.ndarray) -> np.ndarray:
        """Sums of products over the visited cells, per place."""
        cells, weight = cells[visited], weight[visited]
        posts, own = _ranges(self.cell_first[cells], self.cell_first[cells + 1])
        return np.bincount(self.post_place[posts], weights=weight[own] * self.post_weight[posts], minlength=len(self.ids)).astype(np.float32)

    def _whole_lists(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Sums of products over all postings of the terms, per place."""
        start, end = self.cell_first[self.term_first[terms]], self.cell_first[self.term_first[terms + 1]]
        held = np.flatnonzero(end > start)
        size, end = (end - start)[held], np.cumsum((end - start)[held])
        posts = np.arange(end[-1] if len(end) else 0) + np.repeat(start[held] - (end - size), size)
        weight = np.repeat(weights[held], size)
        weight *= self.post_weight[posts]
        return np.bincount(self.post_place[posts], weights=weight, minlength=len(self.ids)).astype(np.float32)

    def vote(self, places: np.ndarray, cosines: np.ndarray, k: int) -> float:
        """Share of the toxic label among the k nearest, weighted by nearness and by what each example stands for.

        Examples that tie for the last places share their votes. Nothing in common with any example gives the base rate.
        """
        label = self.toxic[places]
        weight = self.class_weight[label] / (1.02 - np.minimum(cosines.astype(np.float64), 1.0))
        if len(places) > k:
            tied = cosines == cosines[-1]
            weight[tied] *= (k - (~tied).sum()) / tied.sum()
        if not len(places) or cosines[0] <= EQUAL:
            label, weight = self.toxic, self.class_weight[self.toxic]
        return float((weight * label).sum() / weight.sum()) if len(label) else 0.0

    def score(self, vote: float) -> float:
        slope, shift = self.curve
        return float(1 / (1 + np.exp(-np.clip(slope * np.log((vote + 0.01) / (1.01 - vote)) + shift, -30, 30))))


def example_terms(rows: list) -> np.ndarray:
    """Sorted hashes of all terms of rows (doc_id, text, label)."""
    found = np.empty(0, np.uint64)
    for _, _, hashes, _ in _terms(pa.array([r.text for r in rows], pa.string())):
        found = np.union1d(found, hashes)
    return found


def _counted(batches: Iterator[pa.RecordBatch], wanted: np.ndarray) -> pa.RecordBatch:
    """(term, rows that hold it) and (-1, rows) of one task, which first gives back what earlier stages have cached."""
    worker_memory.only()
    total, rows = np.zeros(len(wanted), np.int64), 0
    for batch in batches:
        rows += batch.num_rows
        for _, owner, at, n_texts in _known_terms(batch.column(0), wanted):
            cell = _cells(owner, at, len(wanted), n_texts)
            total += np.bincount(cell[_firsts(cell)] % max(1, len(wanted)), minlength=len(wanted))
    worker_memory.only()
    found = np.flatnonzero(total)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.append(found, -1).astype(np.int32)), pa.array(np.append(total[found], rows))], names=["term", "n"]
    )


def document_frequencies(docs: DataFrame, terms: np.ndarray) -> tuple[np.ndarray, int]:
    """(rows of ``docs`` that hold each of the sorted terms, number of rows)."""
    shipped = docs.sparkSession.sparkContext.broadcast(terms)  # terms of a bounded number of examples

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _counted(batches, shipped.value)

    counts = docs.select("text").mapInArrow(run, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    own = counts[counts.term >= 0]
    frequency = np.zeros(len(terms), np.int64)
    frequency[own.term.to_numpy()] = own.n.to_numpy()
    return frequency, int(counts.n[counts.term < 0].sum())


def fit(rows: list, class_rows: dict[int, int], terms: np.ndarray, frequency: np.ndarray, n_docs: int) -> Examples | None:
    """An index over rows (doc_id, text, label) with all their terms (sorted) and these' frequencies in ``n_docs`` documents.

    ``class_rows`` has the training rows of each label.
    """
    if not rows:
        return None
    label, n = np.array([r.label for r in rows]), len(rows)
    parts = []
    for lo, owner, hashes, _ in _terms(pa.array([r.text for r in rows], pa.string())):
        cell, count = np.unique((owner + lo) * len(terms) + np.searchsorted(terms, hashes), return_counts=True)
        parts.append([x.astype(np.int32) for x in (*np.divmod(cell, max(1, len(terms))), count)])
    doc, term, count = (np.concatenate(x) for x in zip(*parts))
    del parts
    idf = 1 + np.log((1 + n_docs) / (1 + frequency))
    class_weight = np.array([class_rows.get(k, 0) / max(1, (label == k).sum()) for k in (0, 1)])
    ids = np.array([r.doc_id if r.doc_id is not None else -1 for r in rows])

    def indexed(some: np.ndarray) -> tuple[Examples, list]:
        """An index over some of the rows, whose labels alone weight the terms, and the vectors of all rows."""
        weight = idf * _told_apart(doc, term, label, some, len(terms))
        vectors = _unit_vectors(doc, term, count, weight, n)
        # similar examples side by side make tight blocks
        order = sorted(
            np.flatnonzero(some).tolist(),
            key=lambda i: (label[i], int(vectors[i][0][np.argmax(vectors[i][1])]) if len(vectors[i][0]) else -1, len(vectors[i][0]), i),
        )
        model = Examples(terms, weight, ids[order], label[order], class_weight, *[np.empty(0)] * 8, (1.0, 0.0))
        model.index([vectors[i] for i in order])
        return model, vectors

    model, _ = indexed(np.ones(n, bool))
    votes, owner = [], []
    for deal in range(DEALS):  # few examples stand near the border, so each is scored in several deals
        fold = np.random.default_rng(deal).permutation(n) % FOLDS
        for f in range(FOLDS):
            if (fold == f).any() and (fold != f).any():
                part, vectors = indexed(fold != f)
                inside = np.flatnonzero(fold == f)
                votes += [vote for vote, _ in part.votes([vectors[i] for i in inside], NEIGHBOURS)]
                owner += inside.tolist()
                del part, vectors  # one index at a time
    votes, owner = np.array(votes), label[np.array(owner, np.int64)]
    model.curve = _calibrate(np.log((votes + 0.01) / (1.01 - votes)), owner, class_weight[owner])
    return model


def _told_apart(doc: np.ndarray, term: np.ndarray, label: np.ndarray, some: np.ndarray, n_terms: int) -> np.ndarray:
    """1 for each term whose labels among some of the rows chance would hardly bring about in any term, LEAST_WEIGHT for all others.

    This selects features, with a floor that keeps all terms in; it does not grade them, so words that stand in a few more rows of one label
    by chance do not draw texts towards it.
    """
    inside = some[doc]
    n, n_toxic = some.sum(), label[some].sum()
    texts = np.bincount(term[inside], minlength=n_terms)
    toxic_texts = np.bincount(term[inside], weights=label[doc[inside]], minlength=n_terms)
    # chi-squared of term and label
    expected = texts * n_toxic / n
    spread = texts * (1 - texts / n) * (n_toxic / n) * (1 - n_toxic / n) * n / max(1, n - 1)
    strength = np.where(spread > 0, (toxic_texts - expected) ** 2 / np.maximum(spread, 1e-9), 0)
    return np.where(strength >= 2 * np.log(max(2, n_terms) / CHANCE), 1.0, LEAST_WEIGHT)


def _calibrate(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Weighted logistic regression with a small pull towards the votes themselves (slope 1, shift 0)."""
    theta = np.array([1.0, 0.0])
    if not len(x):
        return 1.0, 0.0
    design = np.stack([x, np.ones_like(x)], axis=1)
    w = w / max(w.mean(), 1e-9)
    free = np.array([True, True])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        slope = design.T @ (w * (y - p)) - (theta - [1.0, 0.0])
        curve = (design * (w * p * (1 - p))[:, None]).T @ design + np.eye(2)
        theta[free] += np.linalg.solve(curve[np.ix_(free, free)], slope[free])
        if theta[0] < LEAST_SLOPE:  # votes that say nothing: only the shift is left to fit
            theta[0], free[0] = LEAST_SLOPE, False
    return float(theta[0]), float(theta[1])


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> "Stored | None":
    """An index over at most ``per_label`` texts of each label, none of them held out (crc32 of doc_id mod 5 is 0).

    Null labels and null texts are left out; where labels of one document differ, toxic counts.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(
        (F.max("toxic") > 0).cast("int").alias("label")
    )
    usable = docs.where((remainder(5) != 0) & F.col("text").isNotNull()).select("doc_id", "text")
    class_rows = {
        r.label: r.n for r in usable.select("doc_id").join(known, "doc_id").groupBy("label").agg(F.count("*").alias("n")).collect()
    }  # two rows
    sample = stored_sample(usable, narrow(usable).join(known, "doc_id"), per_label)
    if sample is None:
        return None
    terms = np.frombuffer(in_task(sample, lambda *columns: example_terms(_examples(*columns)).tobytes()), np.uint64)
    about = (class_rows, terms, *document_frequencies(docs, terms))
    folder = f"{shared_folder(docs.sparkSession)}/examples-{uuid.uuid4().hex}"
    return Stored(folder, in_task(sample, lambda *columns: _store(folder, fit(_examples(*columns), *about))).decode())


def _examples(*columns: list) -> list[Example]:
    return [Example(*values) for values in zip(*columns)]


def _store(folder: str, model: Examples) -> bytes:
    return write_array(folder, "examples", np.frombuffer(pickle.dumps(model), np.uint8)).encode()


_loaded: dict[str, Examples] = {}


class Stored:
    """Examples in a file of the shared folder; each process that looks into them loads them once."""

    def __init__(self, folder: str, file: str):
        self.folder, self.file = folder, file

    def load(self) -> Examples:
        if self.file not in _loaded:
            _loaded.clear()
            _loaded[self.file] = pickle.loads(map_array(self.folder, self.file, "u1").tobytes())
            worker_memory.keep("examples", _loaded.clear)
        return _loaded[self.file]

    def __getattr__(self, name: str):
        if name.startswith("__"):
            raise AttributeError(name)
        return getattr(self.load(), name)


def predict(docs: DataFrame, model: Examples | Stored | None, k: int = NEIGHBOURS, prefix: str = "") -> DataFrame:
    """``docs`` with score (0 to 1), predicted (0 or 1) and evidence (names behind ``prefix``), the doc_ids of the nearest examples, nearest first.

    A null text is an empty one; it gets the base rate, as all texts without known terms. Ties for the last place share its vote. Without examples the score is 0. Columns of these names are replaced,
    all others are kept; repeated rows and nulls elsewhere change nothing.
    """
    added = [f"{prefix}{name}" for name in ("score", "predicted", "evidence")]
    docs = docs.drop(*added)
    text_at, names_out = docs.columns.index("text"), [*docs.columns, *added]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory.only("examples")
        index = model.load() if isinstance(model, Stored) else model
        for batch in batches:
            score, evidence = [0.0] * batch.num_rows, [[]] * batch.num_rows
            for lo, vectors in index.vectors(batch.column(text_at)) if index else ():
                for i, (vote, places) in enumerate(index.votes(vectors, k)):
                    score[lo + i] = index.score(vote)
                    evidence[lo + i] = index.ids[places[:k]]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(score, pa.float64()), pa.array([int(s >= 0.5) for s in score], pa.int32()),
                 pa.array(evidence, pa.list_(pa.int64()))],
                names=names_out,
            )

    return docs.mapInArrow(run, f"{schema}, `{added[0]}` double, `{added[1]}` int, `{added[2]}` array<bigint>")
