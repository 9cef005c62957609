"""Connected components by alternating large-star and small-star, and pairs of rows in bounded blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Rounds after which the stars must have settled; each at least halves what is left to settle in practice.
MAX_ROUNDS = 60
#: Edges, and rows of a group, from which a key can be hot, and hot keys at the most.
HOT_EDGES, HOT, HOT_KEYS = 100_000, 1_000, 1_000


def _pointed(edges: DataFrame) -> DataFrame:
    """Distinct edges from the larger id to the smaller, without loops and nulls."""
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def met_by(rows: DataFrame, keyed: DataFrame, key: str, total: int, hot_from: int = HOT) -> DataFrame:
    """``rows``, ``total`` of them, joined with ``keyed``, which has each key once and its number of rows n.

    Keys with more rows than ``hot_from`` are broadcast, no more than HOT_KEYS of them, so that the rows of a hot key
    stay where they are. The others meet by a shuffle.
    """
    most = max(hot_from, total // HOT_KEYS)
    if total <= most:
        return rows.join(keyed.drop("n"), key)
    hot = F.broadcast(keyed.where(F.col("n") > most).withColumnRenamed(key, "_hot").drop("n"))
    values = [c for c in keyed.columns if c not in (key, "n")]
    marked = rows.join(hot, rows[key] == F.col("_hot"), "left")
    there = marked.where("_hot is not null").drop("_hot")
    rest = marked.where("_hot is null").drop("_hot", *values).join(keyed.where(F.col("n") <= most).drop("n"), key)
    return there.unionByName(rest)


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Every larger neighbour of u is joined to the least of u and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return _pointed(met_by(both.where("v > u"), least, "u", 2 * total, HOT_EDGES).select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """u and its smaller neighbours are joined to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    return _pointed(met_by(edges, least, "u", total, HOT_EDGES).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))))


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of each id that has an edge: the smallest id that it reaches.

    ``edges`` has the columns u and v. Hubs are never gathered: minima are pre-aggregated, and those of hubs, a bounded
    number, are broadcast to the edges. Each round is kept in the shared checkpoint folder.
    """
    state, before = cut(_pointed(edges)), None
    for _ in range(MAX_ROUNDS):
        now = state.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("u").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
        state = cut(_small_star(_large_star(state, now[0]), 2 * now[0]))
    else:
        raise RuntimeError("the stars haven't settled")
    roots = state.select(F.col("v").alias("id")).distinct()
    return state.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots.select("id", F.col("id").alias("component")))


def in_blocks(rows: DataFrame, group: str, member: Column, sizes: DataFrame, block: int) -> DataFrame:
    """``rows`` with the columns i and j: every two rows of a group meet in exactly one (group, i, j), or in (i, i).

    ``sizes`` has the group and its size n. A group of at most ``block`` rows is one block, a larger one is split by a
    hash of ``member``; a row then goes to one (i, j) for each block of its group. Column ``own`` is the row's block.
    """
    count = F.ceil(F.col("n") / F.lit(block)).cast("int")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    placed = met_by(rows, sizes.select(group, "n", count.alias("blocks")), group, total).withColumn("own", F.pmod(F.xxhash64(member, F.lit(5)), F.col("blocks")).cast("int"))
    other = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return other.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other", "blocks")


def map_groups(rows: DataFrame, keys: list[str], run: Callable[[pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``run`` over the rows of each key, as an Arrow table; groups are bounded, many small ones share a task."""
    spread = rows.repartition(*keys).sortWithinPartitions(*keys)

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in keys]
            begin = 0
            for at, key in enumerate(zip(*columns, strict=True)):
                if key != last:
                    if at > begin:
                        held.append(batch.slice(begin, at - begin))
                    if held and (out := run(pa.Table.from_batches(held))) is not None and out.num_rows:
                        yield out
                    held, begin, last = [], at, key
            if batch.num_rows > begin:
                held.append(batch.slice(begin))
        if held and (out := run(pa.Table.from_batches(held))) is not None and out.num_rows:
            yield out

    return spread.mapInArrow(groups, schema)


def join_pairs(group: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the rows a[i] and b[i] of a block; ``group`` has the least row of each row's group, and is changed."""
    while len(a):
        left, right = group[a], group[b]
        apart = left != right
        a, b, left, right = a[apart], b[apart], left[apart], right[apart]
        np.minimum.at(group, np.maximum(left, right), np.minimum(left, right))
        while (group[group] != group).any():
            group[:] = group[group]


def stars(ids: np.ndarray, group: np.ndarray) -> pa.RecordBatch:
    """Edges (u, v) from each row of a block to the least id of its group; ``group`` names each row's group."""
    order = np.lexsort((ids, group))
    first = np.concatenate([[True], group[order][1:] != group[order][:-1]])
    least = ids[order][np.flatnonzero(first)][np.cumsum(first) - 1]
    return pa.record_batch([pa.array(ids[order][~first]), pa.array(least[~first])], ["u", "v"])
