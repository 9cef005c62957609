"""Exact top-k search by inner product with multi-resolution segment statistics.

For segments of n components with means m and deviations s, the squared distance of two vectors is at least the sum of
n ((m_x - m_q)^2 + (s_x - s_q)^2), so their inner product is at most the sum of n (m_x m_q + s_x s_q). A block of
candidates is bounded with few long segments first and with more and shorter ones for what survives, against the score
that a query's k-th best has so far; exact products are computed for the last survivors only. Bounds have a margin for
rounding, so the result is exact, ties included.

Before they are cut into segments, vectors are turned onto the principal axes of a bounded sample (AXES_SAMPLE rows),
the axes with the most energy first, and segments grow along them. A rotation keeps products, so bounds hold for every
vector, and they are the tighter the less even its energy is; on vectors without such axes they prune little. A first
pass over one block gives each query a floor before the others are met. Statistics are computed where blocks meet, as
they cost a thousandth of the products and would double what is moved.

Blocks of queries meet blocks of rows by equi-joins on their numbers, so neither side is broadcast; each pair of
blocks gives at most k rows for a query, and a window with its group limit keeps the k best. The work is that of an
exact search, all rows for each query, spread over as many tasks as there are pairs of blocks.

Defined results: vectors that are null or hold null or non-finite components take no part; vectors of different
lengths have no score; rows that repeat a query's id count as that query, with the least of its vectors, and never as
its candidates; rows with a null id take no part; other columns are never read; an empty table gives no rows. Whole
components beyond 2^62 count as 2^62, and scores beyond the longs as the largest or smallest long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, prepare
from .vectors import usable

#: Rows of a block of candidates, of a tile within it, and of a block of queries.
BLOCK, TILE, QUERIES = 8_192, 1_024, 4_096
#: Segments of each resolution.
LEVELS = (1, 4, 16)
#: The share of a tile's pairs under which exact products are computed pair by pair, not as a block.
FEW = 0.02
#: Rows from which the axes are found, and the longest vectors that are turned.
AXES_SAMPLE, LONGEST = 4_096, 1_024
#: Products up to this are exact in double precision.
_EXACT = float(1 << 53)
_LARGEST = float(1 << 62)


def _integers(scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each block: its vectors' length, ids and components."""
        held: dict[int, list[tuple[int, np.ndarray]]] = {}
        task, made = TaskContext.get().partitionId(), 0

        def block(rows):
            nonlocal made
            made += 1
            ids = np.array([i for i, _ in rows], np.int64)
            values = np.array([v for _, v in rows], np.int64)
            return pa.record_batch([pa.array([task << 32 | made], pa.int64()), pa.array([values.shape[1]], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([values.tobytes()], pa.binary())], ["block", "size", "ids", "values"])

        for batch in batches:
            for i, vector in zip(batch.column("id").to_pylist(), usable(batch.column("vector")), strict=True):
                if vector is None or i is None:
                    continue
                with np.errstate(over="ignore"):
                    scaled = np.clip(np.floor(scale * vector), -_LARGEST, _LARGEST)
                rows = held.setdefault(len(vector), [])
                rows.append((i, scaled.astype(np.int64)))
                if len(rows) == BLOCK:
                    yield block(held.pop(len(vector)))
        for rows in held.values():
            yield block(rows)

    return run


def _edges(size: int, parts: int) -> list[int]:
    """Where segments begin and end; each is longer than the one before by the same factor, about."""
    return sorted({0, size, *(round(size ** (i / parts)) for i in range(1, parts))})


def _statistics(x: np.ndarray, parts: int) -> np.ndarray:
    """For each row, the square roots of the segments' sizes times their means, then times their deviations."""
    edges = _edges(x.shape[1], parts)
    means, deviations = [], []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        own = x[:, a:b]
        means.append(own.mean(1) * np.sqrt(b - a))
        if b - a > 1:
            deviations.append(own.std(1) * np.sqrt(b - a))
    return np.stack(means + deviations, 1)


def axes(vectors: np.ndarray) -> np.ndarray:
    """The principal axes of some vectors as columns, those with the most energy first: an orthogonal matrix."""
    x = vectors / max(float(np.abs(vectors).max(initial=0)), 1e-300)
    return np.linalg.eigh(x.T @ x)[1][:, ::-1]


def _products(queries: np.ndarray, rows: np.ndarray, exact: bool) -> np.ndarray:
    """Integer inner products of the pairs (queries[i], rows[i])."""
    if exact:
        return np.rint(np.einsum("ij,ij->i", queries.astype(np.float64), rows.astype(np.float64))).astype(np.int64)
    low, high = -(1 << 63), (1 << 63) - 1
    return np.array([min(max(sum(map(int.__mul__, a, b)), low), high) for a, b in zip(queries.tolist(), rows.tolist(), strict=True)], np.int64)


def search_block(qids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, turn: np.ndarray | None = None, floor: np.ndarray | None = None, alive_shares: list | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, scores) of each query's k best rows, ties to the smaller id, without its own id.

    ``turn`` is an orthogonal matrix; rows that score less than ``floor`` may be left out. ``alive_shares`` takes the
    shares of pairs that survive each level, tile by tile.
    """
    best_id = [np.empty(0, np.int64)] * len(q)
    best = [np.empty(0, np.int64)] * len(q)
    floor = np.full(len(q), -np.inf) if floor is None else floor.copy()  # the k-th best score so far, or less
    qf, xf = q.astype(np.float64), x.astype(np.float64)
    size = q.shape[1]
    exact = float(np.abs(qf).max(initial=0)) * float(np.abs(xf).max(initial=0)) * size < _EXACT
    levels = sorted({min(n, size) for n in LEVELS}) if size else []
    turned = (qf, xf) if turn is None else (qf @ turn, xf @ turn)
    of_q, of_x = [_statistics(turned[0], n) for n in levels], [_statistics(turned[1], n) for n in levels]
    norm_q, norm_x = np.sqrt((qf**2).sum(1)), np.sqrt((xf**2).sum(1))
    for begin in range(0, len(x), TILE):
        tile, own = x[begin : begin + TILE], ids[begin : begin + TILE]
        alive = own[None, :] != qids[:, None]
        slack = 1e-9 * norm_q * norm_x[begin : begin + TILE].max(initial=0) + 1e-6
        shares = []
        for stat_q, stat_x in zip(of_q, of_x, strict=True):  # coarse to fine
            some, those = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
            bound = stat_q[some] @ stat_x[begin : begin + TILE][those].T
            alive[np.ix_(some, those)] &= bound >= (floor - slack)[some, None]
            shares.append(float(alive.mean()))
        if alive_shares is not None:
            alive_shares.append(shares)
        if exact and alive.mean() > FEW:  # products of the queries and rows that have survivors, as one block
            some, those = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
            products = qf[some] @ xf[begin : begin + TILE][those].T
            a, b = np.nonzero(alive[np.ix_(some, those)] & (products >= floor[some, None]))
            scores = np.rint(products[a, b]).astype(np.int64)
            a, b = some[a], those[b]
        else:
            a, b = np.nonzero(alive)
            scores = np.empty(len(a), np.int64)
            for at in range(0, len(a), 65_536):
                part = slice(at, at + 65_536)
                scores[part] = _products(q[a[part]], tile[b[part]], exact)
            good = scores >= floor[a]
            a, b, scores = a[good], b[good], scores[good]
        bounds = np.searchsorted(a, np.arange(len(q) + 1))
        for i in np.flatnonzero(np.diff(bounds)):
            part = slice(bounds[i], bounds[i + 1])
            all_ids, all_scores = np.concatenate([best_id[i], own[b[part]]]), np.concatenate([best[i], scores[part]])
            order = np.lexsort((all_ids, -all_scores))[:k] if all_scores.min() > -(1 << 63) else sorted(range(len(all_ids)), key=lambda n: (-int(all_scores[n]), all_ids[n]))[:k]  # noqa: B023
            best_id[i], best[i] = all_ids[order], all_scores[order]
            if len(order) == k:
                floor[i] = max(floor[i], all_scores[order[-1]])
    return list(zip(best_id, best, strict=True))


def _blocks_of(batches: Iterator[pa.RecordBatch], turns, k: int):
    """(query ids, found, k-th scores) of each row, a pair of blocks."""
    for batch in batches:
        for row in range(batch.num_rows):
            size = batch.column("size")[row].as_py()
            get = lambda c, kind=np.int64: np.frombuffer(batch.column(c)[row].as_buffer(), kind)  # noqa: B023, E731
            qids, ids = get("query_ids"), get("ids")
            floor = get("floors", np.float64) if "floors" in batch.schema.names else None
            found = search_block(qids, get("query_values").reshape(len(qids), size), ids, get("values").reshape(len(ids), size), k, turns.value.get(size), floor)
            yield batch.column("query_block")[row].as_py(), qids, found


def _seeded(turns, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, found in _blocks_of(batches, turns, k):
            floors = np.array([s[k - 1] if len(s) == k else -np.inf for _, s in found], np.float64)
            yield pa.record_batch([pa.array([block], pa.int64()), pa.array([np.nextafter(floors, -np.inf).tobytes()], pa.binary())], ["query_block", "floors"])

    return run


def _searched(turns, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, qids, found in _blocks_of(batches, turns, k):
            counts = [len(i) for i, _ in found]
            yield pa.record_batch(
                [pa.array(np.repeat(qids, counts)), pa.array(np.concatenate([i for i, _ in found])), pa.array(np.concatenate([s for _, s in found]))],
                ["query_id", "vec_id", "score"],
            )

    return run


def _turns(named: DataFrame, sizes: list[int], scale: float) -> dict[int, np.ndarray]:
    """For each length of vectors the axes of a sample, which a hash of the id picks."""
    out = {}
    for size in sizes:
        if 1 < size <= LONGEST:
            rows = named.where(F.col("id").isNotNull() & (F.size("vector") == size)).select("vector", F.xxhash64("id", F.lit(3)).alias("order"), "id")
            found = rows.orderBy("order", "id").limit(AXES_SAMPLE).select("vector").toArrow().column("vector")
            vectors = [v for chunk in found.chunks for v in usable(chunk) if v is not None]
            if vectors:
                out[size] = axes(np.clip(scale * np.array(vectors), -_LARGEST, _LARGEST))
    return out


def top_k(rows: DataFrame, is_query: Column, k: int, scale: float = 1.0, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows with the highest integer products with each row where ``is_query``.

    Components count as floor(scale * component).
    """
    spark = prepare(rows.sparkSession)
    named = rows.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("vector"))
    schema = "block long, size int, ids binary, values binary"
    blocks = cut(named.mapInArrow(_integers(scale), schema))
    asked = named.where(is_query & F.col("id").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", lambda v: F.isnull(v) | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))))
    asked = asked.groupBy("id").agg(F.min("vector").alias("vector"))
    parts = max(1, -(-asked.count() // QUERIES))
    made = cut(asked.repartition(parts, F.xxhash64("id")).mapInArrow(_integers(scale), schema))
    number = F.row_number().over(Window.partitionBy("size").orderBy("block")) - 1
    numbers = cut(made.select("block", "size", number.alias("nth")))
    held = {r["size"]: r["n"] for r in numbers.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    found = blocks.groupBy("size").agg(F.min("block").alias("first"), F.count(F.lit(1)).alias("n")).where(F.col("size").isin(*held)).collect() if held else []
    turns = spark.sparkContext.broadcast(_turns(named, [r["size"] for r in found], scale))
    queries = made.select(F.col("block").alias("query_block"), "size", F.col("ids").alias("query_ids"), F.col("values").alias("query_values"))

    last = F.lit(-1)
    for size, n in held.items():
        last = F.when(F.col("size") == size, F.lit(n - 1)).otherwise(last)
    dealt = lambda some: some.withColumn("last", last).where("last >= 0").withColumn("nth", F.explode(F.sequence(F.lit(0), "last"))).drop("last")
    numbers = numbers.withColumnRenamed("block", "query_block")
    first = blocks.where(F.col("block").isin(*[r["first"] for r in found]) if found else F.lit(False)).drop("block")  # one for each length
    seeds = dealt(first).join(numbers, ["size", "nth"]).drop("size", "nth").join(queries, "query_block").repartition("query_block")
    queries = cut(queries.join(seeds.mapInArrow(_seeded(turns, k), "query_block long, floors binary"), "query_block"))

    pairs = dealt(blocks.select("block", "size"))  # numbers, not rows
    pairs = pairs.join(numbers, ["size", "nth"]).select("block", "query_block")
    met = pairs.join(queries, "query_block").join(blocks.drop("size"), "block")
    if sum(r["n"] for r in found) < 4 * int(spark.conf.get("spark.sql.shuffle.partitions")):
        met = met.repartition("block", "query_block")  # few blocks: deal out their pairs
    scored = met.mapInArrow(_searched(turns, k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
