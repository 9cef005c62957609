"""Importance resampling towards a target text collection, by hashed word runs.

Every text is written once as a packed stream of 16-bit buckets, one row of bytes for each document, so that an Arrow
batch holds the streams of its documents one after another beside their offsets. Counts come from sorting a batch's
stream and encoding its runs; a document's weight comes from gathering the buckets' gains along the stream and summing
between the offsets. Only the counts of buckets, at most 65,536, reach the driver.

The draw is Gumbel's: the highest of weight and a noise that a hash of the id gives. Scores are whole thousandths of a
logarithm and lie in a narrow range whatever the data, so their histogram finds the lowest score drawn; the rows
above it are ranked by a sort over ranges.

Defined results: null and empty texts, and texts without words, have no features and weight 0; repeated rows are scored
and drawn each; among equal scores the smaller id comes first and null ids, hashed as no digits, last; an empty target
or an empty table counts nothing; columns other than the id and the text are never read. Long texts are read in parts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, in_order, slices

#: Bytes of one text that are split into words at once.
PART = 1 << 20
#: Words are digits, letters without case and all characters beyond ASCII; every other byte ends one.
_WORD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def _parts(raw: bytes) -> Iterator[bytes]:
    """Parts of a text that end between words."""
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + PART)
        end = len(raw) if end < 0 else end
        yield raw[at:end]
        at = end


def features(text: bytes, buckets: int, longest: int = 2) -> tuple[int, np.ndarray]:
    """The number of words, and the buckets of all runs of 1 to ``longest`` words, shorter runs of a part first."""
    count, out, carried = 0, [np.zeros(0, np.uint16)], []
    for part in _parts(text.translate(_WORD)):
        words = part.split()
        fresh = len(words)
        count += fresh
        words = carried + words
        hashes = list(map(crc32, words))
        for size in range(1, longest + 1):
            if size > 1:  # hashes of runs go on from those of the runs that are one word shorter
                hashes = list(map(crc32, words[size - 1 :], map(crc32, repeat(b" "), hashes)))
            new = hashes[max(0, len(hashes) - fresh) :]
            out.append((np.fromiter(new, np.uint32, len(new)) % buckets).astype(np.uint16))
        carried = words[len(words) - longest + 1 :] if longest > 1 else []
    return count, np.concatenate(out)


def streams(rows: DataFrame, id_column: str, buckets: int, longest: int = 2) -> DataFrame:
    """(doc_id, n_words, stream) of each row: its features' buckets as packed little-endian 16-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = [features(t or b"", buckets, longest) for t in part.column("text").cast(pa.binary()).to_pylist()]
                counts = pa.array([n for n, _ in found], pa.int64())
                packed = pa.array([s.astype("<u2").tobytes() for _, s in found], pa.binary())
                yield pa.record_batch([part.column("doc_id"), counts, packed], ["doc_id", "n_words", "stream"])

    kept = rows.select(F.col(id_column).cast("long").alias("doc_id"), "text")
    return kept.mapInArrow(run, "doc_id long, n_words long, stream binary")


def _packed(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """A batch's streams as one array, and where each document's begins and the last one ends."""
    column = batch.column("stream")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] // 2
    data = column.buffers()[2]
    return np.frombuffer(data, "<u2", int(offsets[-1])) if data else np.zeros(0, np.uint16), offsets


def bucket_counts(written: DataFrame) -> DataFrame:
    """(bucket, n): how often each bucket occurs in all streams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stream, offsets = _packed(batch)
            stream = np.sort(stream[offsets[0] : offsets[-1]])
            if len(stream):
                first = np.flatnonzero(np.concatenate([[True], stream[1:] != stream[:-1]]))
                runs = np.diff(np.append(first, len(stream)))
                yield pa.record_batch([pa.array(stream[first].astype(np.int32)), pa.array(runs)], ["bucket", "n"])

    return written.select("stream").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: dict[int, int], target: dict[int, int], buckets: int) -> np.ndarray:
    """Thousandths of the logarithm by which the target prefers each bucket, counts raised by one."""
    of_source, of_target = float(sum(source.values()) + buckets), float(sum(target.values()) + buckets)
    return np.array([
        math.floor(1000 * math.log((target.get(b, 0) + 1.0) * of_source / ((source.get(b, 0) + 1.0) * of_target))) for b in range(buckets)
    ], np.int64)


def weights(written: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean of the gains along each stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stream, offsets = _packed(batch)
            sizes = np.diff(offsets).astype(np.int64)
            sums, some = np.zeros(len(sizes), np.int64), sizes > 0
            if some.any():
                sums[some] = np.add.reduceat(gain[stream], offsets[:-1][some])
            means = sums // np.maximum(sizes, 1)
            yield pa.record_batch([batch.column("doc_id"), batch.column("n_words"), pa.array(sizes), pa.array(means)], ["doc_id", "n_words", "n_features", "weight"])

    return written.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def _lowest_drawn(histogram: dict[int, int], drawn: int) -> int | None:
    for score in sorted(histogram, reverse=True):
        drawn -= histogram[score]
        if drawn <= 0:
            return score
    return None


def resample(
    documents: DataFrame, target: DataFrame, target_id: str, buckets: int = 10_000, longest: int = 2, percent: int = 25,
    least_words: int = 20, seed: int = 7,
) -> DataFrame:
    """Every document's (doc_id, n_features, weight, score, rank), null ranks where it isn't drawn.

    ``percent`` of the documents with ``least_words`` words or more are drawn, towards the texts of ``target``.
    """
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets must fit 16 bits")
    written = cut(streams(documents, "doc_id", buckets, longest))
    counts = [dict(bucket_counts(s).toPandas().itertuples(index=False)) for s in (written, streams(target, target_id, buckets, longest))]
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10)
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h.cast("double") + 0.5) / 4294967296.0)))
    scored = cut(weights(written, gains(*counts, buckets)).withColumn("score", (F.col("weight") + noise).cast("long")))

    may = F.col("n_words") >= least_words
    histogram = dict(scored.where(may).groupBy("score").count().toPandas().itertuples(index=False))
    drawn = percent * sum(histogram.values()) // 100
    lowest = _lowest_drawn(histogram, drawn)
    above = (may & (F.col("score") >= lowest)) if drawn else F.lit(False)
    ranked = in_order(scored.where(above), [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], "place")
    rank = F.when(F.col("place") < drawn, F.col("place") + 1)
    columns = ["doc_id", "n_features", "weight", "score"]
    return scored.where(~above).select(*columns, F.lit(None).cast("long").alias("rank")).unionAll(ranked.select(*columns, rank.alias("rank")))
