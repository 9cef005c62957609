"""Byte-level BPE by a sentencepiece model that is serialised straight from a vocabulary of ranks.

Each byte stands as one character outside white space, each vocabulary entry as one piece whose score is its negative
rank, and the normaliser is the identity, so sentencepiece merges the same pairs in the same order as the ranks say.
Pre-tokens are encoded one by one; one that is an entry itself is its rank. Decoding maps ids back to bytes.

Defined results: null and empty texts have no ids and decode to no bytes; long texts are encoded whole; repeated rows
are encoded each; columns other than the id and the text are never read. Lone surrogates can't occur in Spark strings.
Ids outside the vocabulary raise an error when decoding. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import Remembered, encode, is_word
from .common import prepare, slices, texts_of

#: Ids that are decoded at once, unless one row has more.
DECODED = 1 << 20
_FIRST = 0x100  # the character that stands for byte 0


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """One field of a protocol-buffer message: bytes, an integer or a 32-bit float."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def _characters(raw: bytes) -> str:
    return "".join(chr(_FIRST + b) for b in raw)


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece model whose piece i is the entry of rank i; the unknown piece comes last."""
    entries = sorted(ranks, key=ranks.get)
    out = b"".join(_field(1, _field(1, _characters(raw).encode()) + _field(2, -float(ranks[raw]))) for raw in entries)
    out += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(entries) + 1) + _field(40, len(entries))
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return out + _field(2, trainer) + _field(3, normaliser)


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a file of lines of a base64 entry and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(entry): int(rank) for entry, rank in map(bytes.split, lines)}


@dataclass
class Codec:
    """A vocabulary with its pre-token pattern; tasks hold one each."""

    ranks: dict[bytes, int]
    pattern: str

    def __getstate__(self):
        return {"ranks": self.ranks, "pattern": self.pattern}

    @cached_property
    def _entries(self) -> list[bytes]:
        entries = sorted(self.ranks, key=self.ranks.get)
        if [self.ranks[x] for x in entries] != list(range(len(entries))):
            raise ValueError("ranks must be 0 to n - 1")
        return entries

    @cached_property
    def _model(self) -> sentencepiece.SentencePieceProcessor:
        return sentencepiece.SentencePieceProcessor(model_proto=model_bytes(self.ranks))

    @cached_property
    def _remembered(self) -> Remembered:
        split, ranks, model = regex.compile(self.pattern).findall, self.ranks, self._model
        letters = [chr(_FIRST + b) for b in range(256)]

        def of(part: str) -> bytes:
            ids: list[int] = []
            for token in [part] if is_word(part[1:] if part[:1] == " " else part) else split(part):
                raw = token.encode()
                if (rank := ranks.get(raw)) is not None:
                    ids.append(rank)
                else:
                    ids += model.encode("".join([letters[b] for b in raw]), num_threads=1)
            return array("I", ids).tobytes()

        return Remembered(of)

    @cached_property
    def _bytes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All entries' bytes, each entry's start and length."""
        lengths = np.array([len(x) for x in self._entries], np.int64)
        return np.frombuffer(b"".join(self._entries), np.uint8), np.cumsum(lengths) - lengths, lengths

    def encode(self, text: str) -> bytes:
        return encode(text, self._remembered)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, and where each id's bytes end."""
        raw, starts, lengths = self._bytes
        if len(ids) and (ids.min() < 0 or ids.max() >= len(lengths)):
            raise ValueError("id outside the vocabulary")
        size = lengths[ids]
        ends = np.cumsum(size)
        at = np.repeat(starts[ids] - (ends - size), size)
        at += np.arange(len(at))
        return raw[at], ends


def _list_array(parts: list[bytes]) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
    values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(parts))])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def encode_documents(documents: DataFrame, codec: Codec) -> DataFrame:
    """(doc_id, ids) for each row of ``documents``; ids without special tokens."""
    shared = prepare(documents.sparkSession).sparkContext.broadcast(codec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value.encode
        for batch in batches:
            for part in slices(batch):
                yield pa.record_batch([part.column("doc_id"), _list_array([of(t) for t in texts_of(part)])], ["doc_id", "ids"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def _decodable(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with at most DECODED ids, or one row."""
    counts = pc.fill_null(pc.list_value_length(batch.column("ids")), 0).to_pylist()
    begin, held = 0, 0
    for at, n in enumerate(counts):
        if held and held + n > DECODED:
            yield batch.slice(begin, at - begin)
            begin, held = at, 0
        held += n
    if begin < batch.num_rows:
        yield batch.slice(begin)


def decode_documents(encoded: DataFrame, codec: Codec) -> DataFrame:
    """(doc_id, ids, decoded): the bytes that each row's ids stand for; null ids stand for none."""
    shared = prepare(encoded.sparkSession).sparkContext.broadcast(codec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value
        for batch in batches:
            for part in _decodable(batch):
                lists = part.column("ids").fill_null([]) if part.column("ids").null_count else part.column("ids")
                raw, ends = codec.decode(lists.flatten().to_numpy(zero_copy_only=False))
                counts = np.diff(lists.offsets.to_numpy())
                last = np.cumsum(counts)
                bounds = np.concatenate([[0], np.concatenate([[0], ends])[last]]).astype(np.int32)
                decoded = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(bounds), pa.py_buffer(raw.tobytes())])
                yield pa.record_batch([part.column("doc_id"), lists, decoded], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def digests(documents: DataFrame, codec: Codec) -> DataFrame:
    """Encode and decode each document; (doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    return decode_documents(encode_documents(documents, codec), codec).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
