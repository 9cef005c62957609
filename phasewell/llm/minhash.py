"""Near-duplicate documents by MinHash.

Documents are sets of word shingles. Equal sets are one class, whose smallest id stands for it. Universal hash minima
are banded; classes that share a band's key meet in a bucket, buckets with the same members are compared once. In a
bucket, signatures (the low byte of every minimum) are verified: only classes whose estimated similarity is near the
threshold stay connected. What stays connected is a coarse group, found by alternating large-star and small-star; the
full sets of a coarse group's classes are then compared exactly, and components of the exact links are the result.

No pairs are written: a block of a bucket or of a coarse group gives, for the links found in it, each class's edge to
the least one that it reaches there, and larger groups than a block are compared block by block, each two blocks in a task of their own. So a group's work is
spread, though it stays quadratic in the number of different texts of one coarse group; equal texts cost nothing.
Blocks are dealt by the sizes of their sets, so that long texts don't fill a task.

At a similarity of 0.8, 32 bands of 5 rows miss a link with a probability of 3e-6, at 0.85 of 7e-9; the signatures'
margin of five standard deviations adds less than 1e-6.

Defined results: null and empty texts, and texts without words, have no shingles and link with nothing; with fewer
words than a shingle, the whole sequence is one; long texts are read whole; rows that repeat an id and a text are one
class; a null doc_id never stands for a class, and is its own component (null) without a named copy; columns other
than the id and the text are never read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, prepare, slices, texts_of
from .graph import components, in_blocks, map_groups, stars
from .shingles import WORDS, MinHash, shingle_set

BANDS, ROWS = 32, 5
#: Classes in one block of a bucket, and in one block of a coarse group.
BUCKET_BLOCK, GROUP_BLOCK = 1_000, 400
#: Shingles that count as one class more when blocks are dealt.
SHINGLES = 10_000
#: Two texts are near duplicates from this similarity, as hundredths.
HUNDREDTHS = 80


def _signed(hasher: MinHash, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                size, high, low, signatures, keys = [], [], [], [], []
                for text in texts_of(part):
                    own = shingle_set(text, words)
                    size.append(len(own))
                    if not len(own):
                        high.append(None), low.append(None), signatures.append(None), keys.append(None)
                        continue
                    a, b = np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), np.int64)
                    minima = hasher.minima(own)
                    high.append(int(a)), low.append(int(b))
                    signatures.append(minima.astype(np.uint8).tobytes())
                    keys.append(hasher.keys(minima))
                yield pa.record_batch(
                    [part.column("doc_id"), pa.array(size, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(signatures, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    ["doc_id", "n_shingles", "high", "low", "signature", "keys"],
                )

    return run


def _margin(hundredths: int, hashes: int) -> float:
    """The share of equal signature bytes under which two classes surely aren't linked."""
    s = hundredths / 100
    return s - 5 * float(np.sqrt(s * (1 - s) / hashes))


def _blocks(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """The ids of two blocks' rows, the places of the first and of the second block, and whether they are one."""
    ids, own = rows.column("id").to_numpy(), rows.column("own").to_numpy()
    i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
    return ids, np.flatnonzero(own == i), np.flatnonzero(own == j), i == j


def _signatures(rows: pa.Table) -> np.ndarray:
    return np.array([np.frombuffer(s.as_buffer(), np.uint8) for s in rows.column("signature")])


def _coarse_links(least: float):
    def run(rows: pa.Table) -> pa.RecordBatch | None:
        ids, left, right, same = _blocks(rows)
        signatures, group = _signatures(rows), np.arange(len(ids))
        for at in left:
            others = right[right > at] if same else right
            others = others[group[others] != group[at]]  # the rest is linked by others already
            if len(others):
                near = others[(signatures[others] == signatures[at]).mean(1) >= least]
                group[np.isin(group, group[near])] = group[at]
        return stars(ids, group)

    return run


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """The size of the intersection of two sorted sets."""
    if len(a) < len(b):
        a, b = b, a
    return int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())


def _exact_links(hundredths: int, least: float):
    def run(rows: pa.Table) -> pa.RecordBatch | None:
        ids, left, right, same = _blocks(rows)
        sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in rows.column("shingles")]
        signatures, size, group = _signatures(rows), np.array([len(s) for s in sets]), np.arange(len(ids))
        for at in left:
            others = right[right > at] if same else right
            others = others[group[others] != group[at]]
            others = others[100 * np.minimum(size[others], size[at]) >= hundredths * np.maximum(size[others], size[at])]
            if not len(others):
                continue
            for b in others[(signatures[others] == signatures[at]).mean(1) >= least]:
                if group[b] != group[at]:
                    both = _shared(sets[at], sets[b])
                    if 100 * both >= hundredths * (size[at] + size[b] - both):
                        group[group == group[b]] = group[at]
        return stars(ids, group)

    return run


def _sets_in(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = [shingle_set(t, words) for t in texts_of(part)]
                digest = [np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64) for s in found]
                yield pa.record_batch(
                    [part.column("id"), part.column("gid"), pa.array([int(d[0]) for d in digest], pa.int64()), pa.array([int(d[1]) for d in digest], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())],
                    ["id", "gid", "high", "low", "shingles"],
                )

    return run


def near_duplicates(documents: DataFrame, hundredths: int = HUNDREDTHS, words: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row: the smallest doc_id that links reach, kept where it is its own.

    Documents are linked where 100 * intersection >= ``hundredths`` * union of their sets.
    """
    prepare(documents.sparkSession)
    hasher = MinHash(bands, rows)
    least = _margin(hundredths, bands * rows)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    base = cut(texts.mapInArrow(_signed(hasher, words), "doc_id long, n_shingles long, high long, low long, signature binary, keys array<long>"))
    classes = cut(base.where("n_shingles > 0").groupBy("high", "low").agg(F.min("doc_id").alias("id"), F.first("signature").alias("signature"), F.first("keys").alias("keys")).where("id is not null"))

    banded = classes.select("id", F.explode("keys").alias("key"))
    buckets = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"), F.bit_xor(F.xxhash64("id")).alias("members")).where("n > 1")
    buckets = cut(buckets.groupBy("n", "least", "members").agg(F.min("key").alias("key")).select("key", "n"))
    met = in_blocks(banded.join(buckets.select("key"), "key", "left_semi"), "key", F.col("id"), buckets, BUCKET_BLOCK)
    met = met.join(classes.select("id", "signature"), "id")
    coarse = cut(components(map_groups(met, ["key", "i", "j"], _coarse_links(least), "u long, v long")).withColumnRenamed("component", "gid"))

    whole = texts.join(coarse.withColumnRenamed("id", "doc_id"), "doc_id").withColumnRenamed("doc_id", "id")
    sets = whole.mapInArrow(_sets_in(words), "id long, gid long, high long, low long, shingles binary")
    sets = cut(sets.join(classes.select("high", "low", "id", "signature"), ["high", "low", "id"]).drop("high", "low"))
    shingles = F.ceil(F.sum(F.octet_length("shingles")) / (8 * SHINGLES))
    sizes = cut(sets.groupBy("gid").agg(F.greatest(F.count(F.lit(1)), shingles).cast("long").alias("n")))
    blocks = in_blocks(sets, "gid", F.col("id"), sizes, GROUP_BLOCK)
    linked = components(map_groups(blocks, ["gid", "i", "j"], _exact_links(hundredths, least), "u long, v long"))

    found = classes.select("high", "low", "id").join(linked, "id", "left").select("high", "low", F.coalesce("component", "id").alias("component"))
    members = base.where("n_shingles > 0").select("doc_id", "n_shingles", "high", "low").join(found, ["high", "low"], "left")
    out = members.select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    out = out.unionByName(base.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def keep_first(documents: DataFrame, hundredths: int = HUNDREDTHS) -> DataFrame:
    """The rows of ``documents``, all columns, one for each group of near duplicates: that of the smallest doc_id.

    Rows that repeat a doc_id are one document; rows without an id can't be told apart and stay.
    """
    found = near_duplicates(documents, hundredths).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    whole = documents.select(F.struct("*").alias("row"))  # so that no column's name clashes
    named = whole.join(found, F.col("row.doc_id") == F.col("kept_id"), "left_semi")
    order = Window.partitionBy("row.doc_id").orderBy(F.xxhash64("row.text"))
    first = named.withColumn("nth", F.row_number().over(order)).where("nth = 1").select("row.*")
    return first.unionByName(documents.where("doc_id is null"))
