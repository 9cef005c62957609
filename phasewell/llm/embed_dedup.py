"""Near-duplicate embeddings by spherical k-means cells.

Equal vectors are one class with a multiplicity. A bounded sample of the classes fits unit centroids; every class
belongs to its nearest cell and is also shown in every other cell whose centroid is nearly as near (MARGIN), so that
pairs across a border meet. Within a cell blocked products give all cosines in double precision; a pair that meets in
several cells counts in the first of them, whichever cells are the two vectors' own. A block gives each vector's number of links and a spanning forest of them,
never the pairs, and alternating large-star and small-star joins the forests. One representative of a group, its
smallest id, is kept. A cell that holds more than a block, as a hot group's does, is compared block by block, each two
blocks in a task of their own.

Cells are an index: pairs that share no cell are not found; recall against brute force is a test. The cells' number
grows with the classes, so that cells stay of one size, up to MAX_CELLS: the centroids are fitted on the driver and held
by every task, so their number is bounded. Beyond MAX_CELLS * CELL classes cells grow and are still compared whole. With
one cell, up to CELL classes, the result is exact.

Defined results: vectors that are null, zero, empty, or hold null or non-finite components link with nothing and are
their own component; vectors of different lengths don't link; repeated rows are vectors of their own, each linked with
the others; a null id never stands for a group; other columns are never read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, prepare
from .graph import components, in_blocks, join_pairs, map_groups, met_by
from .vectors import usable

COSINE = 0.9
#: Classes for one cell, cells at the most, and sampled classes for each cell, from which centroids are fitted.
CELL, MAX_CELLS, SAMPLE = 2_000, 16_384, 24
#: A class is shown in the cells whose centroid's cosine falls short of the best by at most this.
MARGIN = 0.12
BLOCK = 2_048
#: Vectors that are compared with all centroids at once.
FIT = 1_024


def fit_cells(vectors: np.ndarray, cells: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Unit centroids of spherical k-means over unit vectors."""
    rng = np.random.default_rng(seed)
    centroids = vectors[rng.choice(len(vectors), min(cells, len(vectors)), replace=False)]
    for _ in range(rounds):
        sums = np.zeros_like(centroids)
        for begin in range(0, len(vectors), FIT):
            part = vectors[begin : begin + FIT]
            np.add.at(sums, (part @ centroids.T).argmax(1), part)
        lengths = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(lengths > 0, sums / np.maximum(lengths, 1e-300), centroids)
    return centroids


def _unit(vector: np.ndarray | None) -> np.ndarray | None:
    if vector is None or not len(vector):
        return None
    largest = np.abs(vector).max()
    if not largest > 0:
        return None
    vector = vector / largest  # so that squares neither overflow nor vanish
    return vector / np.sqrt(vector @ vector)


def _assigned(shared, margin: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids: dict[int, np.ndarray] = shared.value
        for batch in batches:
            ids, times = batch.column("id").to_numpy(), batch.column("times").to_numpy()
            by_size: dict[int, list[tuple[int, np.ndarray]]] = {}
            for at, vector in enumerate(usable(batch.column("vector"))):
                if (unit := _unit(vector)) is not None and len(unit) in centroids:
                    by_size.setdefault(len(unit), []).append((at, unit))
            parts = []
            for size, rows in by_size.items():
                for begin in range(0, len(rows), FIT):
                    at = np.array([i for i, _ in rows[begin : begin + FIT]])
                    units = np.array([u for _, u in rows[begin : begin + FIT]])
                    cosines = units @ centroids[size].T
                    row, cell = np.nonzero(cosines >= cosines.max(1, keepdims=True) - margin)
                    bounds = np.searchsorted(row, np.arange(len(at) + 1)).astype(np.int32)
                    cells = pa.ListArray.from_arrays(pa.array(bounds), pa.array(cell.astype(np.int32)))
                    columns = [pa.array(ids[at]), pa.array(times[at]), pa.array([size] * len(at), pa.int32()), pa.array([u.tobytes() for u in units], pa.binary()), cells]
                    parts.append(pa.record_batch(columns, ["id", "times", "size", "unit", "cells"]))
            if parts:
                yield pa.concat_batches(parts)

    return run


def _earlier_cells(cells: pa.ChunkedArray, cell: int) -> list[np.ndarray]:
    """The cells before this one in which each row is shown, as words of 64 bits."""
    cells = pa.concat_arrays(cells.chunks)
    flat, counts = cells.flatten().to_numpy(), pc.list_value_length(cells).to_numpy()
    row, before = np.repeat(np.arange(len(counts)), counts), flat < cell
    known, at = np.unique(flat[before], return_inverse=True)
    words = np.zeros((-(-len(known) // 64), len(counts)), np.uint64)
    np.bitwise_or.at(words, (at // 64, row[before]), np.uint64(1) << (at % 64).astype(np.uint64))
    return list(words)


def _compared(least: float):
    def run(rows: pa.Table) -> pa.RecordBatch | None:
        cell, i, j = (rows.column(c)[0].as_py() for c in ("cell", "i", "j"))
        ids, times, own = (rows.column(c).to_numpy() for c in ("id", "times", "own"))
        units = np.array([np.frombuffer(u.as_buffer(), np.float64) for u in rows.column("unit")])
        earlier = _earlier_cells(rows.column("cells"), cell)
        mine = np.flatnonzero(own == i)
        others = mine if i == j else np.flatnonzero(own == j)
        if not len(mine) or not len(others):
            return None
        links, group = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for begin in range(0, len(mine), 256):
            left = mine[begin : begin + 256]
            a, b = np.nonzero(units[left] @ units[others].T >= least)
            a, b = left[a], others[b]
            if i == j:
                a, b = a[a < b], b[a < b]
            first = np.ones(len(a), bool)
            for word in earlier:
                first &= (word[a] & word[b]) == 0
            a, b = a[first], b[first]
            np.add.at(links, a, times[b])
            np.add.at(links, b, times[a])
            join_pairs(group, a, b)
        linked, joined = np.flatnonzero(links), np.flatnonzero(group != np.arange(len(ids)))
        u = np.concatenate([ids[linked], ids[joined]])
        v = np.concatenate([ids[linked], ids[group[joined]]])
        n = np.concatenate([links[linked], np.zeros(len(joined), np.int64)])
        return pa.record_batch([pa.array(u), pa.array(v), pa.array(n)], ["u", "v", "n"])

    return run


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE, id_column: str = "vec_id", vector_column: str = "embedding", cell: int = CELL, margin: float = MARGIN) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row."""
    spark = prepare(embeddings.sparkSession)
    rows = embeddings.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("vector"))
    every = cut(rows.where("vector is not null").groupBy("vector").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("times")))
    classes = every.where("id is not null")
    sizes = {r["size"]: r["n"] for r in classes.groupBy(F.size("vector").alias("size")).agg(F.count(F.lit(1)).alias("n")).where("size > 0").collect()}
    centroids = {}
    for size, n in sizes.items():
        cells = int(min(MAX_CELLS, max(1, -(-n // cell))))
        wanted = max(1_000, SAMPLE * cells)
        order = F.pmod(F.xxhash64("id", F.lit(9)), F.lit(1 << 30))
        sample = classes.where((F.size("vector") == size) & (order < int(min(1.0, 1.2 * wanted / n) * (1 << 30))))
        found = sample.orderBy(order, "id").limit(wanted).select("vector").toArrow().column("vector")
        vectors = [u for chunk in found.chunks for u in map(_unit, usable(chunk)) if u is not None]
        if not vectors:
            vectors = [np.eye(1, size)[0]]
        centroids[size] = fit_cells(np.array(vectors), cells)
    shared = spark.sparkContext.broadcast(centroids)
    assigned = cut(classes.mapInArrow(_assigned(shared, margin), "id long, times long, size int, unit binary, cells array<int>"))
    shown = assigned.withColumn("cell", F.explode("cells")).withColumn("place", F.concat_ws(":", "size", "cell"))
    counts = cut(shown.groupBy("place").agg(F.count(F.lit(1)).alias("n")))
    met = in_blocks(shown, "place", F.col("id"), counts, BLOCK)
    found = cut(map_groups(met, ["place", "i", "j"], _compared(cosine), "u long, v long, n long"))
    links = found.where("u = v").groupBy(F.col("u").alias("id")).agg(F.sum("n").alias("links"))
    groups = components(found.where("u <> v").select("u", "v"))
    linked = assigned.select("id", (F.col("times") - 1).alias("copies")).join(links, "id", "left").join(groups, "id", "left")
    known = every.join(linked, "id", "left").select(
        "vector", F.col("times").alias("n"), F.coalesce(F.coalesce("links", F.lit(0)) + F.col("copies"), F.lit(0)).alias("n_links"), F.coalesce("component", "id").alias("component")
    )
    columns = [F.col("id").alias("vec_id"), F.col("n_links").cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id")]
    total = every.agg(F.sum("times")).first()[0] or 0
    alone = rows.where("vector is null").select("id", F.lit(0).alias("n_links"), F.lit(None).cast("long").alias("component"))
    out = met_by(rows.where("vector is not null"), known, "vector", total).select("id", "n_links", "component").unionByName(alone).select(*columns)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
