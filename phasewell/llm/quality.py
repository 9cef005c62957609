"""Text quality by votes of the nearest labelled neighbours in a latent-semantic space.

The space is one of character shapes, not of words, so that it holds for languages that the labels don't show. A
document's terms are trigrams of shapes (upper and lower case, digits, white space, single signs), and the shares of
words and lines that repeat, of words in capitals and of words that end in a sign. Square roots of term shares,
weighted by inverse document frequency in the labelled sample, are projected by a truncated singular value
decomposition. The labelled vectors are a bounded sample that every task holds; each document's exact cosine with all
of them is a blocked matrix product, and the NEIGHBOURS nearest vote, each with the fourth power of its cosine (POWER), negative
ones not at all.

Defined results: null and empty texts get the sample's share of label 1; long texts are read whole; repeated rows are
scored each; columns other than the id and the text are never read, whatever their names; without any usable label
every score is 1, so that nothing is rejected; an empty table gives no rows. Components of vectors count in steps of 2^-20, so that cosines are exact sums whatever the blocks, and ties
go to the smaller doc_id, so that the neighbours don't depend on how the tables are partitioned.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, labelled_sample, prepare, sampled_texts, slices, texts_of

#: Labelled documents that the space and the neighbours come from, at the most.
MAX_LABELLED = 6_000
DIMENSIONS = 32
NEIGHBOURS = 15
POWER = 4
#: A unit in steps of a vector's components.
STEP = float(1 << 20)
#: Texts whose cosines with all labelled vectors are held together.
BLOCK = 64
THRESHOLD = 0.3

#: Texts of up to so many words say nothing by words that repeat.
SHORT = 20

_SIGNS = b" \n.,!?|#*&%$-:;'\"()"
_CLASSES = 25
_REPEATS = 6
TERMS = _CLASSES**3 + _REPEATS


def _classes() -> np.ndarray:
    kind = np.full(256, 3, np.int64)  # any other sign
    kind[[*range(ord("a"), ord("z") + 1)]] = 0
    kind[128:] = 0
    kind[[*range(ord("A"), ord("Z") + 1)]] = 1
    kind[[*range(ord("0"), ord("9") + 1)]] = 2
    for i, sign in enumerate(_SIGNS):
        kind[sign] = 4 + i
    return kind


_KIND = _classes()


def term_shares(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The terms of a text and the square roots of their shares; two empty arrays for a text without characters."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    if not len(raw):
        return np.empty(0, np.int64), np.empty(0, np.float32)
    kind = _KIND[raw]
    kind = np.concatenate([[5, 5], kind, [5]])
    grams = kind[:-2] * _CLASSES**2 + kind[1:-1] * _CLASSES + kind[2:]
    counts = np.bincount(grams, minlength=TERMS).astype(np.float32)
    counts /= len(grams)
    words, lines = text.split(), text.split("\n")
    n = max(1, len(words))
    same = sum(map(operator.eq, words, words[1:])) / n
    base = _CLASSES**3
    counts[base] = same
    counts[base + 1] = 1 - len(set(words)) / n if n > SHORT else 0
    counts[base + 2] = 1 - len(set(lines)) / len(lines)
    upper = sum(w.isupper() for w in words) / n
    counts[base + 3] = upper
    counts[base + 4] = sum(not w[-1].isalnum() for w in words) / n
    counts[base + 5] = 4 * same
    at = np.flatnonzero(counts)
    return at, np.sqrt(counts[at])


@dataclass
class Neighbours:
    """A projection of terms, and the labelled vectors in its space."""

    projection: np.ndarray  # kept terms x dimensions, with the inverse document frequencies
    column: np.ndarray  # of each term, its row of the projection, or -1
    vectors: np.ndarray  # labelled x dimensions, of length 1
    labels: np.ndarray  # in the order of the doc_ids
    prior: float

    def vector(self, terms: np.ndarray, shares: np.ndarray) -> np.ndarray:
        at = self.column[terms]
        known = at >= 0
        out = shares[known] @ self.projection[at[known]]
        length = np.sqrt(out @ out)
        return out / length if length > 0 else out * 0

    def votes(self, block: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        """The neighbours' labels weighted by similarity, for a block of vectors."""
        if not len(self.labels):
            return np.full(len(block), self.prior)
        k = min(neighbours, len(self.labels))
        cosines = _steps(block) @ _steps(self.vectors).T / STEP**2
        least = np.partition(cosines, -k, axis=1)[:, -k, None]  # ties with the last go to the first rows
        above, last = cosines > least, cosines == least
        near = above | last & (last.cumsum(1) <= k - above.sum(1, keepdims=True)) if (last.sum(1) > 1).any() else above | last
        near = np.nonzero(near)[1].reshape(len(block), k)
        weight = np.clip(np.take_along_axis(cosines, near, 1), 0, None) ** POWER + 1e-9
        out = (weight * self.labels[near]).sum(1) / weight.sum(1)
        return np.where(np.abs(block).sum(1) > 0, out, self.prior)


def _steps(vectors: np.ndarray) -> np.ndarray:
    """Components as whole numbers, whose products have exact sums in any order."""
    return np.rint(vectors.astype(np.float64) * STEP)


def _shares_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            found = [term_shares(t) for t in texts_of(part)]
            yield pa.record_batch(
                [part.column("doc_id"), pa.array([a.astype(np.int32).tobytes() for a, _ in found], pa.binary()), pa.array([b.astype(np.float32).tobytes() for _, b in found], pa.binary()), part.column("label")],
                ["doc_id", "terms", "shares", "label"],
            )


def learn(documents: DataFrame, labels: DataFrame, train=lambda doc_id: F.lit(True), max_labelled: int = MAX_LABELLED, dimensions: int = DIMENSIONS) -> Neighbours:
    """Fit on at most ``max_labelled`` of the labelled documents where ``train(doc_id)`` holds."""
    prepare(documents.sparkSession)
    texts = sampled_texts(documents, labelled_sample(labels, "quality", train, max_labelled)).withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = [(r[0], np.frombuffer(r[1], np.int32), np.frombuffer(r[2], np.float32), r[3]) for r in texts.mapInArrow(_shares_in, "doc_id long, terms binary, shares binary, label int").collect()]
    rows = [r[1:] for r in sorted(rows, key=lambda r: r[0]) if len(r[1])]
    y = np.array([r[2] for r in rows], np.float64)
    if not len(rows):
        return Neighbours(np.zeros((1, 1), np.float32), np.full(TERMS, -1), np.zeros((0, 1), np.float32), y, 1.0)
    frequency = np.zeros(TERMS)
    for terms, _, _ in rows:
        frequency[terms] += 1
    kept = np.flatnonzero(frequency >= min(3, len(rows)))
    column = np.full(TERMS, -1)
    column[kept] = np.arange(len(kept))
    idf = (np.log((1 + len(rows)) / (1 + frequency[kept])) + 1).astype(np.float32)
    x = np.zeros((len(rows), len(kept)), np.float32)
    for i, (terms, shares, _) in enumerate(rows):
        at = column[terms]
        x[i, at[at >= 0]] = shares[at >= 0]
    x *= idf
    rng = np.random.default_rng(7)
    width = min(dimensions + 16, *x.shape)
    q = x @ rng.standard_normal((x.shape[1], width)).astype(np.float32)
    for _ in range(3):  # subspace iterations
        q, _ = np.linalg.qr(x @ (x.T @ np.linalg.qr(q)[0]))
    right = np.linalg.svd(q.T @ x, full_matrices=False)[2][: min(dimensions, width)]
    vectors = x @ right.T
    lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors = np.where(lengths > 0, vectors / np.maximum(lengths, 1e-12), 0)
    return Neighbours((idf[:, None] * right.T).astype(np.float32), column, vectors.astype(np.float32), y, float(y.mean()))


def _scores(model: Neighbours, texts: list[str]) -> np.ndarray:
    out = [np.empty(0)]
    for begin in range(0, len(texts), BLOCK):
        block = np.array([model.vector(*term_shares(t)) for t in texts[begin : begin + BLOCK]], np.float32)
        out.append(model.votes(block))
    return np.clip(np.concatenate(out), 0, 1)


def score(documents: DataFrame, model: Neighbours) -> DataFrame:
    """(doc_id, score) for each row of ``documents``."""
    shared = prepare(documents.sparkSession).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.record_batch([part.column("doc_id"), pa.array(_scores(shared.value, texts_of(part)), pa.float64())], ["doc_id", "score"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def keep_good(documents: DataFrame, model: Neighbours, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``documents``, all columns, whose score reaches ``threshold``."""
    shared = prepare(documents.sparkSession).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(_scores(shared.value, texts_of(part)) >= threshold, pa.bool_()))

    return documents.mapInArrow(run, documents.schema)


def held_out(doc_id):
    """The rows whose labels are never learned from."""
    return fold_of(doc_id, 5) == 0


def scored(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the labels that aren't held out; (doc_id, held_out, score, predicted) for each document."""
    model = learn(documents, labels, lambda doc_id: ~held_out(doc_id))
    return score(documents, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
