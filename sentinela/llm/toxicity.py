"""Toxicity: cumulative-link ordinal regression over sparse text features (operator 7).

P(grade > k) = sigmoid(w x - t_k): one weight per feature for all grades and ascending
thresholds t_k. Features are the words of a text and their beginnings, hashed, with how often they occur; only
those in at least ``LEAST_DOCUMENTS`` training texts that are oftener in toxic ones have a weight. The expected severity is the sum of P(grade > k)
over k. Grades come from the labels: 0 not toxic, 1 toxic, 2 toxic and of low quality.

The model is fitted on at most ``TRAIN_ROWS`` labelled rows, chosen by a hash of their id; all
documents are scored, whole, in one pass. Which features have a weight is counted on Spark; only
those, and the rows' lists of them, come to the driver, however long the labelled texts are.

Edge cases: a null or empty text has no features, so its severity is that of the thresholds;
labels with nulls are not used; without labels or with one grade only nothing is toxic; a null id
is scored and not trained on; repeated ids give one row each, and those with a label are trained on
each; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentinela.llm.common import drop_stored, slices, stored
from sentinela.llm.words import mix, word_hashes, words

TRAIN_ROWS = 6000
BITS = 22
PREFIXES = (4, 6)             # letters of a word's beginnings
LEVELS = 3                   # counts of 1, 2 and 4
LEAST_DOCUMENTS = 5
LEAST_RATIO = 1.0            # logarithm of how much oftener a feature occurs in toxic texts
PENALTY = 0.0001
ROUNDS = 600
EDGES = ".,;:!?()[]{}<>\"'*#/-_`|"


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers of each text, flat, and where each text's begin.

    For every word and its first letters: that they occur, that they occur twice, four times
    and so on.
    """
    flat, offsets = words(texts)
    flat = pc.ascii_trim(flat, EDGES).dictionary_encode()
    own = pc.cast(flat.dictionary, pa.large_string())
    kinds = [own, *(pc.utf8_slice_codeunits(own, 0, k) for k in PREFIXES)]
    hashes = [mix(word_hashes(kind) + np.uint64(k)) for k, kind in enumerate(kinds)]
    # A word no longer than a prefix has no such prefix.
    lengths = pc.utf8_length(own).to_numpy(zero_copy_only=False)
    codes = flat.indices.to_numpy()
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    parts = []
    for k, kind in enumerate(hashes):
        use = lengths[codes] > (PREFIXES[k - 1] if k else 0)
        number = (kind & np.uint64((1 << BITS) - 1)).astype(np.int64)[codes[use]]
        pairs, count = np.unique(row[use] << BITS | number, return_counts=True)
        for level in range(LEVELS):
            some = pairs[count >= 1 << level]
            parts.append((some & ~((1 << BITS) - 1)) | (
                mix((some & ((1 << BITS) - 1)).astype(np.uint64) * np.uint64(LEVELS) + np.uint64(level))
                & np.uint64((1 << BITS) - 1)).astype(np.int64))
    pairs = np.unique(np.concatenate([np.empty(0, np.int64), *parts]))
    starts = np.searchsorted(pairs >> BITS, np.arange(len(offsets)))
    return pairs & ((1 << BITS) - 1), starts


@dataclass(frozen=True)
class OrdinalModel:
    """Sorted feature numbers with their weights, and the thresholds."""

    known: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def scores(self, found: np.ndarray, starts: np.ndarray) -> np.ndarray:
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, found), len(self.known) - 1)
            each = np.where(self.known[at] == found, self.weights[at], 0.0)
        else:
            each = np.zeros(len(found))
        return np.diff(np.concatenate([[0.0], np.cumsum(each)])[starts])

    def above(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k), a column for each k."""
        return _sigmoid(scores[:, None] - self.thresholds)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fit(found: np.ndarray, starts: np.ndarray, grades: np.ndarray) -> OrdinalModel:
    """Gradient descent with momentum and scaling on the penalised likelihood."""
    most = int(grades.max(initial=0))
    if len(np.unique(grades)) < 2:
        return OrdinalModel(np.empty(0, np.int64), np.empty(0), np.array([50.0]))
    counts = np.bincount(found, minlength=1 << BITS)
    known = np.flatnonzero(counts >= LEAST_DOCUMENTS)
    # A feature is scaled by how much oftener it occurs in graded texts than in others (Wang and
    # Manning 2012), so that the penalty falls on those that tell nothing.
    toxic = np.repeat(grades > 0, np.diff(starts))
    with_, without = (np.bincount(found[side], minlength=1 << BITS)[known] for side in (toxic, ~toxic))
    ratio = np.log(((with_ + 0.5) / ((grades > 0).sum() + 1)) / ((without + 0.5) / ((grades == 0).sum() + 1)))
    known, ratio = known[ratio >= LEAST_RATIO], ratio[ratio >= LEAST_RATIO]
    column = np.full(1 << BITS, -1)
    column[known] = np.arange(len(known))
    row = np.repeat(np.arange(len(grades)), np.diff(starts))
    use = column[found] >= 0
    row, column = row[use], column[found[use]]
    # Thresholds: the first and the logarithms of the steps between them, so they ascend.
    state = np.concatenate([np.zeros(len(known)), [2.0], np.zeros(most - 1)])
    first, second = np.zeros_like(state), np.zeros_like(state)
    levels = np.arange(most)
    for step in range(1, ROUNDS + 1):
        weights, steps = state[:len(known)], np.exp(state[len(known) + 1:])
        thresholds = state[len(known)] + np.concatenate([[0.0], np.cumsum(steps)])
        scores = np.bincount(row, (weights * ratio)[column], len(grades))
        above = _sigmoid(scores[:, None] - thresholds)
        # P(grade = g) = above[g - 1] - above[g]; slopes of its logarithm by both.
        edge = np.concatenate([np.ones((len(grades), 1)), above, np.zeros((len(grades), 1))], 1)
        slope = np.pad(above * (1 - above), ((0, 0), (1, 1)))
        each = np.arange(len(grades))
        own = np.maximum(edge[each, grades] - edge[each, grades + 1], 1e-12)
        up, down = slope[each, grades] / own, slope[each, grades + 1] / own
        by_score = up - down
        by_threshold = np.stack([(down * (grades == k)) - (up * (grades == k + 1)) for k in levels], 1
                                ).sum(0)
        by_step = np.cumsum(by_threshold[::-1])[::-1][1:] * steps
        gradient = np.concatenate([
            np.bincount(column, by_score[row], len(known)) * ratio - PENALTY * len(grades) * weights,
            [by_threshold.sum()], by_step]) / len(grades)
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient ** 2
        state = state + 0.02 * (first / (1 - 0.9 ** step)) / (
            np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
    steps = np.exp(state[len(known) + 1:])
    return OrdinalModel(known, state[:len(known)] * ratio,
                        state[len(known)] + np.concatenate([[0.0], np.cumsum(steps)]))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, text, grade) of at most ``rows`` labelled documents, chosen by hash."""
    graded = labels.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.when(F.col("toxic") == 0, 0).when(F.col("toxic") == 1, 2 - F.col("quality").cast("int"))
        .alias("grade")).where("doc_id is not null and grade between 0 and 2")
    chosen = graded.orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(rows)
    # At most ``rows`` pairs of integers.
    return docs.join(F.broadcast(chosen), "doc_id")


def telling_features(rows: DataFrame) -> np.ndarray:
    """Features that may have a weight, of rows of ``(grade, found)``: 2 to the ``BITS`` at most."""
    sides = rows.agg(F.count_if(F.col("grade") > 0), F.count("*")).first()
    graded, others = sides[0], sides[1] - sides[0]
    counts = rows.select(F.explode("found").alias("feature"), (F.col("grade") > 0).alias("toxic")
                         ).groupBy("feature").agg(F.count_if("toxic").alias("with_"), F.count("*").alias("n"))
    ratio = F.log(((F.col("with_") + 0.5) / (graded + 1)) / ((F.col("n") - F.col("with_") + 0.5) / (others + 1)))
    # The fit judges the edge again, by its own arithmetic.
    known = counts.where((F.col("n") >= LEAST_DOCUMENTS) & (ratio >= LEAST_RATIO - 1e-6)).select("feature")
    return np.sort(known.toArrow().column(0).to_numpy()).astype(np.int64)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> OrdinalModel:
    """Fit on the chosen rows; the features that count, not the texts, come to the driver."""

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found, starts = features(part.column("text"))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("grade"),
                 pa.ListArray.from_arrays(starts.astype(np.int32), found.astype(np.int32))],
                ["doc_id", "grade", "found"])

    everything = stored(training_rows(docs, labels, rows).select("doc_id", "grade", "text").mapInArrow(
        extracted, "doc_id long, grade int, found array<int>"), "toxicity-features")
    known = telling_features(everything)

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.asarray(f, "<i4") for f in batch.column("found").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("grade"),
                 pa.array([f[np.isin(f, known)].tobytes() for f in own], pa.binary())],
                ["doc_id", "grade", "found"])

    got = everything.mapInArrow(reduced, "doc_id long, grade int, found binary").collect()
    drop_stored(everything)
    got.sort(key=lambda r: (r.doc_id, r.grade, bytes(r.found)))     # the same sums every time
    found = [np.frombuffer(bytes(r.found), "<i4").astype(np.int64) for r in got]
    starts = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int64)
    return fit(np.concatenate([np.empty(0, np.int64), *found]), starts,
               np.array([r.grade for r in got], np.int64))


def score_documents(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """One row per document: ``doc_id, expected_severity, grade, toxic``."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            above = model.above(model.scores(*features(part.column("text"))))
            severity = above.sum(1)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(severity), pa.array((above >= 0.5).sum(1).astype(np.int32)),
                 pa.array(above[:, 0] >= 0.5)], ["doc_id", "expected_severity", "grade", "toxic"])

    return docs.mapInArrow(scored, "doc_id long, expected_severity double, grade int, toxic boolean")


def grade_toxicity(docs: DataFrame, labels: DataFrame, *, rows: int = TRAIN_ROWS,
                   id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Fit on the labelled documents and score all."""
    own = docs.select(F.col(id_column).cast("long").alias("doc_id"),
                      F.col(text_column).cast("string").alias("text"))
    return score_documents(own, train(own, labels, rows))
