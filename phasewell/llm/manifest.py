"""A Merkle manifest of a table: one root over all rows, and for each row the siblings that lead from it to the root.

Rows are leaves, ordered within their tree (a source); every ``fanout`` consecutive nodes become one until one is left,
and the trees' roots are joined likewise. Trees are built by superblocks: a node's index divided by fanout^levels names
its bucket, one task collapses a bucket by that many levels, and the buckets' roots are the next round's nodes, so three
rounds of three levels reach 16^9 leaves and no task holds more than 4,096 nodes. On the way down each bucket's nodes get
the siblings inside their bucket followed by those of the bucket itself. Leaves move as 32 bytes, never as texts.

A tree's rows are numbered over ranges of the whole order, so a tree of any size is split; of each range only the first
and the last tree's number of rows reach the driver.

Defined results: null values count as such, also a null id (first in its source, and tampered with) and a null source
(the first one); rows with equal ids stand in the order of their leaves, equal rows are leaves each; an empty table gives
no rows; other columns are never read. Names that begin with ``_`` are reserved.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .common import cut, fold_of, in_parts, prepare

#: Bytes of one digest.
DIGEST = 32
_PROOF = "turns array<int>, sizes array<int>, siblings binary, subroot binary, root binary"
_NAMES = ["turns", "sizes", "siblings", "subroot", "root"]


def hashed(*values: Column) -> Column:
    """The digest of values one after another, each as `-` if null, else its UTF-8 bytes' count, a colon and itself."""
    texts = [v.cast("string") for v in values]
    return F.unhex(F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)).cast("binary"), 256))


def parent(run: list[bytes]) -> bytes:
    """The digest of a run of digests, each as lowercase hex text."""
    return sha256(b"".join(run).hex().encode()).digest()


def collapse(nodes: list[bytes], fanout: int, levels: int, exactly: bool) -> list[list[bytes]]:
    """The nodes of each level from the bottom: ``levels`` more if ``exactly``, else at most so many, until one is left.

    A tree's only bucket, unless it is full, ends where one node is left; a full one ends there anyway.
    """
    found = [nodes]
    while len(found) <= levels and (exactly or len(found[-1]) > 1):
        below = found[-1]
        found.append([parent(below[i : i + fanout]) for i in range(0, len(below), fanout)])
    return found


def _split(packed: bytes) -> list[bytes]:
    return [packed[i : i + DIGEST] for i in range(0, len(packed), DIGEST)]


def _before(parts: DataFrame) -> dict[int, int]:
    """For each range, how many rows the tree that it begins with has in earlier ranges."""
    sizes = parts.groupBy("_part", "_tree").agg(F.count("*").alias("n"), F.min("_at").alias("at"))
    ends = sizes.groupBy("_part").agg(
        F.min_by("_tree", "at").alias("head"), F.min_by("n", "at").alias("n_head"),
        F.max_by("_tree", "at").alias("tail"), F.max_by("n", "at").alias("n_tail"),
    )
    found: dict[int, int] = {}
    running, count = None, 0
    for row in sorted(ends.collect()):
        found[row["_part"]] = begun = count if row["head"] == running else 0
        running, count = row["tail"], row["n_tail"] + (begun if row["head"] == row["tail"] else 0)
    return found


def _numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with _index, each row's place in its _tree."""
    parts = in_parts(rows, [F.col("_tree"), *order])
    before, names = _before(parts), rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, count = None, 0
        for batch in batches:
            index = []
            for value in batch.column("_tree").to_pylist():
                if value != tree:
                    count = before.get(batch.column("_part")[0].as_py(), 0) if tree is None else 0
                    tree = value
                index.append(count)
                count += 1
            yield pa.record_batch([*(batch.column(c) for c in names), pa.array(index, pa.int64())], [*names, "_index"])

    schema = rows.withColumn("_index", F.lit(0).cast("long")).schema
    return parts.mapInArrow(run, schema)


def _bucket(fanout: int, levels: int) -> Column:
    return F.expr(f"_index div {fanout**levels}").alias("_bucket")


def _collapsed(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """The roots of the buckets of ``nodes`` (_tree, _index, leaf) as nodes of the next round."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        held = group.sort_values("_index")["leaf"].tolist()
        return pd.DataFrame({"_tree": [key[0]], "_index": [key[1]], "leaf": [collapse(held, fanout, levels, key[1] > 0)[-1][0]]})

    return nodes.groupBy("_tree", _bucket(fanout, levels)).applyInPandas(run, "_tree string, _index long, leaf binary")


def _levels(nodes: DataFrame, fanout: int, levels: int) -> list[DataFrame]:
    """Nodes of each round, until one is left of each tree."""
    found = [nodes]
    while len(found) == 1 or found[-1].where("_index > 0").limit(1).count():
        found.append(cut(_collapsed(found[-1].select("_tree", "_index", "leaf"), fanout, levels)))
    return found


def _places(steps: list[list[bytes]], at: int, fanout: int) -> tuple[list[int], list[int], bytes]:
    """A bucket's node's places in its runs, the runs' sizes, and the packed others."""
    turns, sizes, others = [], [], []
    for level in steps:
        begin, turn = at - at % fanout, at % fanout
        run = level[begin : begin + fanout]
        turns.append(turn)
        sizes.append(len(run))
        others += run[:turn] + run[turn + 1 :]
        at //= fanout
    return turns, sizes, b"".join(others)


def _with_proofs(nodes: DataFrame, above: DataFrame, fanout: int, levels: int) -> DataFrame:
    """``nodes`` with their proofs: the siblings inside their bucket, then those of the bucket, a node of ``above``."""
    schema = nodes.select("*", *(F.lit(None).cast(kind).alias(name) for name, kind in (x.split(" ") for x in _PROOF.split(", ")))).schema
    kinds, names = [pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary()], nodes.columns

    def run(key: tuple, held: pa.Table, up: pa.Table) -> pa.Table:
        if not held.num_rows:
            held = held.select(names)
            return pa.table([*held.columns, *(pa.array([], k) for k in kinds)], [*names, *_NAMES])
        held = held.take(pc.sort_indices(held, [("_index", "ascending")])).select(names)
        (bucket,) = up.to_pylist()
        steps = collapse(held.column("leaf").to_pylist(), fanout, levels, key[1].as_py() > 0)[:-1]
        found = [_places(steps, i, fanout) for i in range(held.num_rows)]
        columns = [
            [turns + bucket["turns"] for turns, _, _ in found],
            [sizes + bucket["sizes"] for _, sizes, _ in found],
            [others + bucket["siblings"] for _, _, others in found],
            [bucket["subroot"]] * len(found),
            [bucket["root"]] * len(found),
        ]
        return pa.table([*held.columns, *(pa.array(c, k) for c, k in zip(columns, kinds))], [*names, *_NAMES])

    bucketed = nodes.groupBy("_tree", _bucket(fanout, levels))
    upper = above.select("_tree", F.col("_index").alias("_bucket"), *_NAMES).groupBy("_tree", "_bucket")
    return bucketed.cogroup(upper).applyInArrow(run, schema)


def _down(rounds: list[DataFrame], above: DataFrame, fanout: int, levels: int) -> DataFrame:
    for nodes in reversed(rounds):
        above = _with_proofs(nodes, above, fanout, levels)
    return above


def manifest(leaves: DataFrame, tree: str, order: list[Column], fanout: int = 16, levels: int = 3) -> DataFrame:
    """``leaves``, whose column ``leaf`` is a digest, with a proof for each: ``turns`` are its places in the runs from the
    leaf through its tree's root to the root, ``sizes`` the runs' sizes, ``siblings`` the others' digests one after
    another; ``subroot`` and ``root`` are where these lead. ``order`` must tell apart rows whose leaves differ."""
    prepare(leaves.sparkSession)
    named = leaves.withColumn("_tree", F.coalesce(F.concat(F.lit(":"), F.col(tree).cast("string")), F.lit("")))
    lower = _levels(cut(_numbered(cut(named), order)), fanout, levels)
    roots = lower[-1].select(F.lit("").alias("_tree"), F.col("_tree").alias("_name"), "leaf")
    upper = _levels(cut(_numbered(roots, [F.col("_name")])), fanout, levels)
    no = F.array().cast("array<int>")
    top = upper[-1].select("_tree", "_index", no.alias("turns"), no.alias("sizes"), F.unhex(F.lit("")).alias("siblings"), "leaf", F.col("leaf").alias("subroot"), F.col("leaf").alias("root"))
    trees = _down(upper[:-1], top, fanout, levels)
    above = trees.select(F.col("_name").alias("_tree"), F.lit(0).cast("long").alias("_index"), "turns", "sizes", "siblings", F.col("leaf").alias("subroot"), "root")
    return _down(lower[:-1], cut(above), fanout, levels).drop("_tree", "_index")


def fold(leaf: bytes, turns: list[int], sizes: list[int], siblings: bytes) -> bytes:
    """The root that a leaf and its siblings lead to."""
    at = 0
    for turn, size in zip(turns, sizes):
        others = _split(siblings[at : at + (size - 1) * DIGEST])
        at += (size - 1) * DIGEST
        leaf = parent([*others[:turn], leaf, *others[turn:]])
    return leaf


@F.pandas_udf(BinaryType())
def folded(leaf: pd.Series, turns: pd.Series, sizes: pd.Series, siblings: pd.Series) -> pd.Series:
    """``fold`` of each row's columns."""
    return pd.Series([fold(*row) for row in zip(leaf, turns, sizes, siblings)], dtype=object)


def document_leaves(documents: DataFrame) -> DataFrame:
    """(doc_id, source, leaf, tampered): the rows' digests, and those of the rows whose text a test tampers with."""
    texts = F.col("text"), F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    leaf, other = (hashed(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text) for text in texts)
    return documents.select("doc_id", "source", leaf.alias("leaf"), F.when(fold_of(F.col("doc_id"), 5) == 0, other).alias("tampered"))


def digests(documents: DataFrame) -> DataFrame:
    """Each document's leaf, roots and proof, and whether a tampered leaf still leads to the root."""
    proofs = manifest(document_leaves(documents), "source", [F.col("doc_id").asc_nulls_first(), F.col("leaf")])
    led = proofs.withColumn("folded", folded(F.coalesce("tampered", "leaf"), "turns", "sizes", "siblings"))

    def text(name: str) -> Column:
        return F.lower(F.hex(name))

    return led.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text("leaf").alias("leaf"),
        text("subroot").alias("subroot"),
        text("root").alias("root"),
        F.sha2(text("siblings").cast("binary"), 256).alias("proof_sha256"),
        text("folded").alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )
