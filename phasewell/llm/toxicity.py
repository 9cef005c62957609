"""Toxicity by a weighted lexicon.

The texts are folded (case, look-alike letters of other scripts, digits and signs that stand for letters, invisible
characters, styled letters, stray marks), an Aho-Corasick automaton finds the lexicon's entries at the beginnings of words, hits inside an
exception phrase are void, and the weighted sum, also normalised by the text's length, is calibrated to a probability.

The lexicon is learned: an entry is a word or the beginning of a word whose documents are labelled toxic far more
often than others; its weight is the smoothed log odds. Exception phrases are two words, one of them an entry, that
occur in clean labelled documents but in no toxic one. Only the labelled rows are bounded (MAX_LABELLED), their number
by a hash of the id; of texts with eight equal minima over their shingles, near copies, the smallest doc_id's counts.
Entries are no more than 1 / MIN_SHARE times the terms of a toxic document, so the lexicon needs no bound of its own.
The same rows give the same lexicon and scores however the tables are partitioned.

Defined results: null and empty texts have no hits and get the score of a text without hits; long texts are matched
whole; repeated rows are scored each; columns other than the id and the text are never read, whatever their names;
without any usable label the lexicon is empty and every score is 0; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fold_of, labelled_sample, prepare, sampled_texts, slices, texts_of
from .shingles import MinHash, shingle_set

#: Labelled documents that a lexicon is learned from, at the most.
MAX_LABELLED = 8_000
#: Labelled texts count as copies where so many minima are equal: two that share half of their shingles in 1 of 256 cases.
MINIMA = 8
#: An entry is in at least so many toxic documents, and in at least this share of them; of all documents that hold it,
#: at least MIN_PURITY are toxic.
MIN_TOXIC = 3
MIN_SHARE = 0.015
MIN_PURITY = 0.85
#: A beginning stands for all words that begin with it, so it must be purer.
MIN_PREFIX_PURITY = 0.97
#: Beginnings of words that can be entries have these lengths.
PREFIXES = (4, 5, 6)
THRESHOLD = 0.3

#: Letters that look like Latin ones.
LOOKALIKES = dict(zip("аеорсухіјѕһԁԛԝкмтвнαεορκινυτχ", "aeopcyxijshdqwkmtbhaeopkivutx", strict=True))
#: Digits and signs that stand for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
INVISIBLE = "­​‌‍⁠﻿"
_FULLWIDTH = {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)}
_FOLD = str.maketrans(
    {k: SUBSTITUTES.get(v.lower(), v.lower()) for k, v in _FULLWIDTH.items()} | LOOKALIKES | SUBSTITUTES | dict.fromkeys(INVISIBLE, "")
)
#: Combining marks that make no letter with what they stand on.
_MARKS = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]+")
_BANG = re.compile(r"(?<=[a-z])[!|](?=[a-z])")
_WORD = re.compile(r"[^\W_]+")
_REST = re.compile(r"[^\W_]*")


def fold(text: str) -> str:
    """Lower case, with look-alikes, styled letters and substitutes replaced by the letters they stand for."""
    if not text.isascii():  # letters keep the accents that they are written with, as these tell words apart
        text = _MARKS.sub("", unicodedata.normalize("NFKC", text))
    text = text.lower().translate(_FOLD)
    return _BANG.sub("i", text) if "!" in text or "|" in text else text


@dataclass
class Lexicon:
    """Entries and their weights, exception phrases, and the calibration (intercept, sum, density)."""

    weights: dict[str, float]
    whole: set[str] = field(default_factory=set)  # entries that must be whole words
    exceptions: list[str] = field(default_factory=list)
    calibration: tuple[float, float, float] = (-3.0, 2.0, 2.0)

    def automaton(self) -> ahocorasick.Automaton | None:
        if not self.weights:
            return None
        machine = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            machine.add_word(entry, (len(entry), weight, entry in self.whole))
        for phrase in self.exceptions:
            machine.add_word(phrase, (len(phrase), None, True))
        machine.make_automaton()
        return machine


def hits(text: str, machine: ahocorasick.Automaton | None) -> list[tuple[int, int, float]]:
    """(start, end, weight) of the entries in a folded text: the longest at each word's beginning, none in an exception."""
    if machine is None:
        return []
    found: dict[int, tuple[int, float]] = {}
    void: list[tuple[int, int]] = []
    for last, (length, weight, whole) in machine.iter(text):
        start, end = last - length + 1, last + 1
        if start and text[start - 1].isalnum() or whole and end < len(text) and text[end].isalnum():
            continue
        if weight is None:
            void.append((start, end))
        elif start not in found or found[start][0] < end:
            found[start] = (end, weight)
    void.sort()
    starts, ends = [a for a, _ in void], list(accumulate((b for _, b in void), max))
    inside = lambda s, e: (i := bisect_right(starts, s)) and e <= ends[i - 1]
    return [(s, e, w) for s, (e, w) in sorted(found.items()) if not inside(s, e)]


def features(text: str, machine: ahocorasick.Automaton | None) -> tuple[float, float]:
    """The weighted sum of the hits, and that sum for a thousand characters; both as logarithms."""
    folded = fold(text)
    total = sum(w for _, _, w in hits(folded, machine))
    return math.log1p(total), math.log1p(1000 * total / (len(folded) + 200))


def _distinct_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with a key over minima of a text's shingles, which equal texts and most near copies share, others hardly."""
    hashes = MinHash(1, MINIMA)
    for batch in batches:
        for part in slices(batch):
            sets = [shingle_set(t) for t in texts_of(part)]
            keys = [int(hashes.keys(hashes.minima(s))[0]) if len(s) else 0 for s in sets]
            yield pa.record_batch([part.column("doc_id"), part.column("label"), part.column("text"), pa.array(keys, pa.int64())], ["doc_id", "label", "text", "key"])


def _terms(text: str) -> set[str]:
    words = set(_WORD.findall(fold(text)))
    return {f"={w}" for w in words if len(w) >= 3} | {f"<{w[:n]}" for w in words for n in PREFIXES if len(w) > n}


def _terms_in(known: frozenset[str] | None):
    """Counts of the documents of a slice that hold a term, of the known terms only where they are given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found: Counter[str] = Counter()
                for text in texts_of(part):
                    found.update(_terms(text) if known is None else _terms(text) & known)
                yield pa.record_batch([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["term", "n"])

    return run


def _word_end(text: str, at: int) -> int:
    return _REST.match(text, at).end()


def _word_begin(text: str, at: int) -> int:
    while at and _REST.match(text, at - 1, at).end() == at:
        at -= 1
    return at


def _pairs_in(machine_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = machine_of()
        for batch in batches:
            for part in slices(batch):
                phrases, labels = [], []
                for text, label in zip(texts_of(part), part.column("label").to_pylist(), strict=True):
                    folded, own = fold(text), set()
                    for start, end, _ in hits(folded, machine):
                        tail = _word_end(folded, start)
                        if start and folded[start - 1] == " " and (begin := _word_begin(folded, start - 1)) < start - 1:
                            own.add(folded[begin:tail])
                        if folded[tail : tail + 1] == " " and (after := _word_end(folded, tail + 1)) > tail + 1:
                            own.add(folded[start:after])
                    phrases += own
                    labels += [label] * len(own)
                yield pa.record_batch([pa.array(phrases, pa.string()), pa.array(labels, pa.int32())], ["term", "label"])

    return run


def _features_in(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = lexicon.automaton()
        for batch in batches:
            for part in slices(batch):
                rows = [features(t, machine) for t in texts_of(part)]
                yield pa.record_batch([pa.array([r[0] for r in rows], pa.float64()), pa.array([r[1] for r in rows], pa.float64()), part.column("label")], ["total", "density", "label"])

    return run


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Newton's method with a small ridge."""
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 0.05 * np.eye(x.shape[1])
        step = np.linalg.solve(hessian, x.T @ (y - p) - 0.05 * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


def learn(documents: DataFrame, labels: DataFrame, train=lambda doc_id: F.lit(True), max_labelled: int = MAX_LABELLED) -> Lexicon:
    """Learn a lexicon from at most ``max_labelled`` of the labelled documents where ``train(doc_id)`` holds."""
    prepare(documents.sparkSession)
    texts = sampled_texts(documents, labelled_sample(labels, "toxic", train, max_labelled))
    distinct = texts.select(F.col("doc_id").cast("long").alias("doc_id"), "label", "text").mapInArrow(_distinct_in, "doc_id long, label int, text string, key long")
    kept = distinct.groupBy("label", "key").agg(F.min(F.struct("doc_id", "text")).alias("least"))  # copies say a word once
    texts = cut(kept.select("label", "least.text"))
    size = {r["label"]: r["n"] for r in texts.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = size.get(1, 0), size.get(0, 0)
    if not toxic or not clean:
        return Lexicon({}, calibration=(-30.0, 0.0, 0.0))
    held = texts.where("label = 1").mapInArrow(_terms_in(None), "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    held = held.where(F.col("n") >= max(MIN_TOXIC, MIN_SHARE * toxic))
    in_toxic = {r["term"]: r["n"] for r in held.collect()}
    others = texts.where("label = 0").mapInArrow(_terms_in(frozenset(in_toxic)), "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    in_clean = {r["term"]: r["n"] for r in others.collect()}
    best = {}
    for term, n1 in in_toxic.items():
        n0 = in_clean.get(term, 0)
        if n1 >= (MIN_PREFIX_PURITY if term[0] == "<" else MIN_PURITY) * (n1 + n0) and (odds := math.log((n1 + 0.5) / (toxic + 1)) - math.log((n0 + 0.5) / (clean + 1))) > 1:
            best[term] = odds
    weights, whole = {}, set()
    for term in sorted(best, key=lambda t: (len(t), t)):  # the shortest pure beginning stands for all that begin with it
        if any(f"<{term[1 : 1 + n]}" in best and n < len(term) - 1 for n in PREFIXES):
            continue
        entry = term[1:]
        if entry not in weights or term[0] == "<":
            weights[entry] = max(best[term], weights.get(entry, 0))
            whole.discard(entry)
            if term[0] == "=":
                whole.add(entry)
    lexicon = Lexicon(weights, whole)
    phrases = (
        texts.mapInArrow(_pairs_in(lexicon.automaton), "term string, label int")
        .groupBy("term")
        .agg(F.sum("label").alias("n1"), F.sum(1 - F.col("label")).alias("n0"))
        .where("n1 = 0 and n0 >= 3")
    )
    lexicon.exceptions = sorted(r["term"] for r in phrases.collect() if r["term"] not in weights)
    table = np.array(sorted(tuple(r) for r in texts.mapInArrow(_features_in(lexicon), "total double, density double, label int").collect()), dtype=float)
    lexicon.calibration = _logistic(table[:, :2], table[:, 2])
    return lexicon


def _scorer(lexicon: Lexicon):
    a, b, c = lexicon.calibration

    def run(texts: list[str], machine) -> list[float]:
        found = (features(t, machine) for t in texts)
        return [1 / (1 + math.exp(-min(30.0, max(-30.0, a + b * x + c * y)))) if a > -30 else 0.0 for x, y in found]

    return run


def score(documents: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, score) for each row of ``documents``."""
    prepare(documents.sparkSession)
    of = _scorer(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = lexicon.automaton()
        for batch in batches:
            for part in slices(batch):
                yield pa.record_batch([part.column("doc_id"), pa.array(of(texts_of(part), machine), pa.float64())], ["doc_id", "score"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def drop_toxic(documents: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``documents``, all columns, whose score is under ``threshold``."""
    prepare(documents.sparkSession)
    of = _scorer(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = lexicon.automaton()
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array([s < threshold for s in of(texts_of(part), machine)], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)


def held_out(doc_id):
    """The rows whose labels are never learned from."""
    return fold_of(doc_id, 4) == 2


def scored(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the labels that aren't held out; (doc_id, held_out, score, predicted) for each document."""
    lexicon = learn(documents, labels, lambda doc_id: ~held_out(doc_id))
    return score(documents, lexicon).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
