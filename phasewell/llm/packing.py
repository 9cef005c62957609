"""Packing of documents into sequences, shortest pack first over the histogram of lengths.

A document's ids and an end id are cut into full sequences and a rest. Only the histogram of the pieces' lengths, as
many rows as a sequence is long, goes to the driver. There the lengths are placed longest first, each into the open
pattern with the most room, many packs of one pattern at a time; what fits nowhere opens new packs. Patterns are
joined back by rank: the n-th piece of a length takes the n-th place of that length. Ranks are counted within salted
groups of about SALTED pieces and shifted by the groups' sizes, so that a length which a third of all documents share
isn't one task's.

Literals of a tokenizer's added tokens, like `<|endoftext|>`, are text unless ``added`` is true: so no document can
forge a control token. With ``added`` they are the tokens, as a plain call of the tokenizer has them.

Defined results: null and empty texts are the end id alone; long texts are cut, never shortened; repeated rows are
packed each; columns other than the id and the text are never read; an empty table has no pieces.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import Remembered, encode, is_word
from .common import cut, prepare, slices, texts_of

SEQUENCE = 2048
END_ID = 1
#: Pieces of one length that are ranked together, about.
SALTED = 20_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _plain(tokenizer) -> Callable[[str], bytes]:
    """The ids of a part of a text as bytes; straight from the model where nothing but the pre-tokenizer precedes it."""
    from tokenizers.pre_tokenizers import ByteLevel

    if tokenizer.normalizer is not None or type(tokenizer.pre_tokenizer).__name__ != "ByteLevel":
        return lambda part: array("I", tokenizer.encode(part, add_special_tokens=False).ids).tobytes()
    split, merge = tokenizer.pre_tokenizer.pre_tokenize_str, tokenizer.model.tokenize
    letters = {}  # the characters that stand for bytes
    for character in ByteLevel.alphabet():
        letters[_byte_of(character)] = character

    space = letters[0x20]

    def of(part: str) -> bytes:
        if is_word(part[1:] if part[:1] == " " else part):
            if part.isascii():  # letters stand for themselves
                return array("I", [x.id for x in merge(part.replace(" ", space))]).tobytes()
            return array("I", [x.id for x in merge(part.encode().decode("latin-1").translate(letters))]).tobytes()
        return array("I", [x.id for token, _ in split(part) for x in merge(token)]).tobytes()

    return of


def _byte_of(character: str) -> int:
    """The byte that a character of the byte-level alphabet stands for: itself where it is printable."""
    at = ord(character)
    if at < 256:
        return at
    hidden = [*range(0x21), *range(0x7F, 0xA1), 0xAD]
    return hidden[at - 256]


def _added_tokens(tokenizer_json: str) -> tuple[re.Pattern | None, dict[str, bytes], bool]:
    """A pattern of the added tokens' literals, their ids, and whether they are found plainly, without options."""
    tokens = [t for t in json.loads(tokenizer_json).get("added_tokens", []) if t["content"]]
    if not tokens:
        return None, {}, True
    literals = sorted((t["content"] for t in tokens), key=len, reverse=True)
    plain = not any(t.get(option) for t in tokens for option in ("single_word", "lstrip", "rstrip", "normalized"))
    return re.compile("|".join(map(re.escape, literals))), {t["content"]: array("I", [t["id"]]).tobytes() for t in tokens}, plain


def _encoder(tokenizer_json: str, added: bool) -> Callable[[str], bytes]:
    """The ids of a text as bytes, without special tokens."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(tokenizer_json)
    tokenizer.encode_special_tokens = not added
    remembered = Remembered(_plain(tokenizer))
    pattern, own, plain = _added_tokens(tokenizer_json)
    if not added or pattern is None:
        return lambda text: encode(text, remembered)

    def of(text: str) -> bytes:
        if not pattern.search(text):
            return encode(text, remembered)
        if not plain:
            return array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        out, at = [], 0
        for m in pattern.finditer(text):
            out += [encode(text[at : m.start()], remembered), own[m[0]]]
            at = m.end()
        return b"".join([*out, encode(text[at:], remembered)])

    return of


def _pieces_in(tokenizer_json: str, end_id: int, most: int, with_ids: bool, added: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _encoder(tokenizer_json, added)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for part in slices(batch):
                rows = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), texts_of(part), strict=True):
                    ids = of(text) + end
                    for at in range(0, len(ids), 4 * most):
                        piece = ids[at : at + 4 * most]
                        rows.append((doc_id, at // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4, piece))
                columns = list(zip(*rows, strict=True)) or [()] * 6
                arrays = [pa.array(c, pa.int64()) for c in columns[:5]]
                if with_ids:
                    bounds = np.concatenate([[0], np.cumsum(columns[2], dtype=np.int64)]).astype(np.int32)
                    values = pa.Array.from_buffers(pa.int32(), int(bounds[-1]), [None, pa.py_buffer(b"".join(columns[5]))])
                    arrays.append(pa.ListArray.from_arrays(pa.array(bounds), values))
                yield pa.record_batch(arrays, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids])

    return run


def pieces(documents: DataFrame, tokenizer_json: str, end_id: int = END_ID, most: int = SEQUENCE, with_ids: bool = False, added: bool = False) -> DataFrame:
    """The documents cut into pieces of at most ``most`` ids; with the ids themselves, an array, where asked for."""
    prepare(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_pieces_in(tokenizer_json, end_id, most, with_ids, added), PIECES + ", ids array<int>" * with_ids)


@dataclass
class Places:
    """For each length, ranges of ranks: the first rank, the sequence that takes it, and the offset there."""

    first: dict[int, np.ndarray]
    sequence: dict[int, np.ndarray]
    offset: dict[int, np.ndarray]
    sequences: int


def patterns(histogram: dict[int, int], most: int = SEQUENCE) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths) of packing patterns that hold every length of the histogram exactly as often as it occurs."""
    open_by_room: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    done: list[tuple[int, tuple[int, ...]]] = []

    def put(count: int, lengths: tuple[int, ...], room: int) -> None:
        if room:
            open_by_room.setdefault(room, []).append((count, lengths))
        else:
            done.append((count, lengths))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = max((r for r in open_by_room), default=0)
            if room >= length:  # the shortest pack
                count, lengths = open_by_room[room].pop()
                if not open_by_room[room]:
                    del open_by_room[room]
                taken = min(count, left)
                if count > taken:
                    put(count - taken, lengths, room)
                put(taken, (*lengths, length), room - length)
                left -= taken
            else:  # new packs; one takes the next of the same length while it has room, as it is the shortest
                each = most // length
                if left >= each:
                    put(left // each, (length,) * each, most - each * length)
                if rest := left % each:
                    put(1, (length,) * rest, most - rest * length)
                left = 0
    return done + [p for packs in open_by_room.values() for p in packs]


def places(found: list[tuple[int, tuple[int, ...]]]) -> Places:
    """Number the patterns' sequences, and each length's places in them."""
    taken: dict[int, int] = {}
    rows: dict[int, list[tuple[int, int, int]]] = {}
    base = 0
    for count, lengths in found:
        offset = 0
        for length in lengths:
            at = taken.get(length, 0)
            rows.setdefault(length, []).append((at, base, offset))
            taken[length] = at + count
            offset += length
        base += count
    columns = {k: np.array(v, np.int64).T for k, v in rows.items()}
    return Places({k: v[0] for k, v in columns.items()}, {k: v[1] for k, v in columns.items()}, {k: v[2] for k, v in columns.items()}, base)


def _placed_in(shared, carried: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: Places = shared.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for n in np.unique(length):
                own = np.flatnonzero(length == n)
                i = np.searchsorted(at.first[n], rank[own], "right") - 1
                sequence[own] = at.sequence[n][i] + rank[own] - at.first[n][i]
                offset[own] = at.offset[n][i]
            yield pa.record_batch([*[batch.column(c) for c in carried], pa.array(sequence), pa.array(offset)], [*carried, "sequence_id", "offset"])

    return run


def pack(cut_pieces: DataFrame, most: int = SEQUENCE) -> DataFrame:
    """Add sequence_id and offset to pieces with columns doc_id, start, length and any others.

    ``cut_pieces`` is read twice and should be a computed table.
    """
    spark = prepare(cut_pieces.sparkSession)
    histogram = {r["length"]: r["n"] for r in cut_pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    salts = F.lit(1)
    if many := {length: -(-n // SALTED) for length, n in histogram.items() if n > SALTED}:
        salts = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in many.items() for x in pair]), F.col("length").cast("int")), F.lit(1))
    salted = cut_pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), salts).cast("long"))
    groups = cut(salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")))
    shared = spark.sparkContext.broadcast(places(patterns(histogram, most)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    shifts = groups.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "start")
    ranked = salted.withColumn("place", F.row_number().over(within)).join(shifts, ["length", "salt"])
    carried = cut_pieces.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut_pieces.schema)
    return ranked.select(*carried, (F.col("place") - 1 + F.col("shift")).cast("long").alias("rank")).mapInArrow(
        _placed_in(shared, carried), f"{schema}, sequence_id long, offset long"
    )


def pack_documents(documents: DataFrame, tokenizer_json: str, end_id: int = END_ID, most: int = SEQUENCE, with_ids: bool = False, added: bool = False) -> DataFrame:
    """One row for each piece: PIECES, its sequence and its offset there, and its ids where asked for."""
    return pack(cut(pieces(documents, tokenizer_json, end_id, most, with_ids, added)), most)
