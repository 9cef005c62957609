"""Sentencepiece BPE encoding that keeps each piece's place in the source text, and decoding.

A text is normalised here, by the longest entry of the model's compiled character map at each place, and every byte of
the normalised text remembers the source byte that it came from. The model itself, with an identity normaliser in place
of its own, then cuts the normalised text into pieces, and each piece is projected back to the bytes [begin, end) of the
source. Where no piece holds a space sign after another character, merges can't cross the place before a space sign, so
the words that begin there are encoded one by one and remembered.

Defined results: a null or empty text has no pieces, only the end id if one is asked for, and decodes to the empty text.
Of a character that is spelled in byte pieces the last one has its span, the others are empty at its start; an added
space sign and ids after the text are empty too, unless the text begins with a character that shares the piece. Long
texts are encoded whole; repeated rows each; an empty table gives no rows; columns other than the id and the text are
never read. Ids outside the vocabulary raise an error when decoding; byte pieces that aren't UTF-8 decode to U+FFFD.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _decodable, _field
from .chunks import LONGEST, REMEMBERED
from .common import prepare, slices, texts_of

SPACE = "▁"
#: Kinds of vocabulary entries, and the kind of model, in the serialised form.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2
_STARTS = re.compile(f"(?<=[^{SPACE}])(?={SPACE})")


def fields(raw: bytes) -> Iterator[tuple[int, bytes | int]]:
    """The fields of a protocol-buffer message: number, and bytes, an integer or the raw bytes of a fixed-width number."""

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    at = 0
    while at < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, raw[at : at + size]
            at += size


def character_map(compiled: bytes) -> dict[str, str]:
    """All entries of a compiled character map: a double array over UTF-8 bytes, then the replacements it points to."""
    if not compiled:
        return {}
    size = struct.unpack_from("<I", compiled)[0]
    units = np.frombuffer(compiled, "<u4", size // 4, 4).astype(np.int64)
    texts = compiled[4 + size :]

    def below(unit: np.ndarray) -> np.ndarray:
        return (unit >> 10) << ((unit & 512) >> 6)

    found: dict[str, str] = {}
    labels = np.arange(1, 256)
    keys, bases = [b""], below(units[:1])
    while keys:  # one byte deeper each time
        deeper, next_keys, next_bases = 1 << 12, [], []
        for begin in range(0, len(keys), deeper):
            at = bases[begin : begin + deeper, None] ^ labels
            unit = np.where(at < len(units), units[np.minimum(at, len(units) - 1)], 0)
            row, label = np.nonzero(unit & (0x80000000 | 255) == labels)
            unit, base = unit[row, label], at[row, label]
            base ^= below(unit)
            for r, byte, leaf, b in zip(row.tolist(), (label + 1).tolist(), (unit >> 8 & 1).tolist(), base.tolist()):
                key = keys[begin + r] + bytes([byte])
                next_keys.append(key)
                if leaf:
                    start = int(units[b]) & 0x7FFFFFFF
                    found[key.decode()] = texts[start : texts.index(b"\0", start)].decode()
            next_bases.append(base)
        keys, bases = next_keys, np.concatenate(next_bases) if next_bases else np.zeros(0, np.int64)
    return found


@dataclass
class Normaliser:
    """A model's normaliser: ``apply`` gives the text and, for each of its bytes and its end, the source byte."""

    replaced: dict[str, str]
    kept: list[str]
    prefix: bool
    no_extra: bool
    escape: bool

    @cached_property
    def _longest(self) -> int:
        return max(map(len, self.replaced), default=0)

    @cached_property
    def _candidates(self) -> re.Pattern | None:
        """Where a kept symbol (a group) or an entry of the map can begin."""
        either = [f"({'|'.join(map(re.escape, sorted(self.kept, key=len, reverse=True)))})"] if self.kept else []
        if self.replaced:
            single = {k for k in self.replaced if len(k) == 1}
            lead, second = {k[0] for k in self.replaced if len(k) > 1}, {k[1] for k in self.replaced if len(k) > 1}

            def among(signs: set[str]) -> str:
                return f"[{''.join(map(re.escape, sorted(signs)))}]"

            either += [among(single)] * bool(single) + [f"{among(lead)}(?={among(second)})"] * bool(lead)
        return re.compile("|".join(either), re.S) if either else None

    def _parts(self, text: str) -> Iterator[tuple[str, int, bool]]:
        """(normalised text, characters of the source, whether it is one unit) from left to right."""
        done = at = 0
        while found := self._candidates.search(text, at):
            at = found.start()
            if self.kept and found.group(1) is not None:
                unit = new = found.group(1)
            else:
                for size in range(min(self._longest, len(text) - at), 0, -1):
                    if (new := self.replaced.get(text[at : at + size])) is not None:
                        unit = text[at : at + size]
                        break
                else:
                    at += 1
                    continue
            if at > done:
                yield text[done:at], at - done, False
            yield new, len(unit), True
            done = at = at + len(unit)
        if done < len(text):
            yield text[done:], len(text) - done, False

    def apply(self, text: str) -> tuple[str, np.ndarray]:
        if not text:
            return "", np.zeros(1, np.int32)
        source = text.encode()
        if self._candidates is None:
            raw, origin = source, np.arange(len(source), dtype=np.int32)
            single = None
        else:
            raws, origins, singles, at, used = [], [], [], 0, 0
            for new, size, unit in self._parts(text):
                piece, width = new.encode(), len(text[used : used + size].encode())
                raws.append(piece)
                origins.append(np.full(len(piece), at, np.int32) if unit else np.arange(at, at + width, dtype=np.int32))
                lead = len(piece) - len(piece.lstrip(b" ")) if unit else 0
                singles.append(np.concatenate([np.zeros(min(lead, 1), np.int8), np.ones(max(lead - 1, 0), np.int8), np.full(len(piece) - lead, 2, np.int8)]) if unit else np.zeros(len(piece), np.int8))
                at, used = at + width, used + size
            raw, origin, single = b"".join(raws), np.concatenate(origins), np.concatenate(singles)
        byte = np.frombuffer(raw, np.uint8)
        space = byte == 32
        end = len(source)
        if self.no_extra:
            follows = np.concatenate([[True], space[:-1]]) if len(space) else space.copy()
            drop = space & follows
            if single is not None:  # spaces inside a replacement stay, those at its start go as its first one does
                drop &= single == 0
                for i in np.flatnonzero(single == 1):
                    drop[i] = drop[i - 1]
            byte, origin, space = byte[~drop], origin[~drop], space[~drop]
            if not len(byte):
                return "", np.full(1, end, np.int32)
        width = np.where(space, 3, 1) if self.escape else np.ones(len(byte), np.int64)
        out = byte.tobytes().decode()
        if self.escape:
            out = out.replace(" ", SPACE)
        origin = np.repeat(origin, width)
        sign = SPACE if self.escape else " "
        if self.prefix:
            out = sign + out
            first = origin[:1] if len(origin) else np.full(1, end, np.int32)
            origin = np.concatenate([np.repeat(first, len(sign.encode())), origin])
        if self.no_extra:
            bare = out.rstrip(sign)
            if len(bare) < len(out):
                size = len(bare.encode())
                end, origin, out = int(origin[size]), origin[:size], bare
        return out, np.append(origin, np.int32(end))


@dataclass
class Codec:
    """A sentencepiece model; tasks hold one each. ``end`` adds the model's end id after each text."""

    model: bytes
    end: bool = True

    def __getstate__(self):
        return {"model": self.model, "end": self.end}

    @cached_property
    def _read(self) -> tuple[list[bytes], np.ndarray, dict, dict]:
        names, kinds, trainer, spec = [], [], {}, {}
        for number, value in fields(self.model):
            if number == 1:
                entry = dict(fields(value))
                names.append(entry[1])
                kinds.append(entry.get(3, NORMAL))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                spec = dict(fields(value))
        if trainer.get(3, 1) != BPE or trainer.get(24, 0):
            raise ValueError("only BPE models with space signs before words")
        return names, np.array(kinds), trainer, spec

    @cached_property
    def normaliser(self) -> Normaliser:
        names, kinds, _, spec = self._read
        kept = [n.decode() for n, k in zip(names, kinds) if k == USER]
        return Normaliser(character_map(spec.get(2, b"")), kept, bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1)))

    @cached_property
    def _model(self) -> sentencepiece.SentencePieceProcessor:
        """The model behind an identity normaliser that adds, drops and escapes nothing."""
        own = b"".join(_field(n, v) for n, v in fields(self.model) if n in (1, 2))
        return sentencepiece.SentencePieceProcessor(model_proto=own + _field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)))

    @cached_property
    def _whole(self) -> sentencepiece.SentencePieceProcessor:
        return sentencepiece.SentencePieceProcessor(model_proto=self.model)

    @cached_property
    def cuts(self) -> bool:
        """Can words be encoded one by one?"""
        names, kinds, _, _ = self._read
        spelled = [n.decode() for n, k in zip(names, kinds) if k in (NORMAL, USER, UNUSED)]
        return SPACE in spelled and not any(_STARTS.search(n) for n in spelled)

    @cached_property
    def _lengths(self) -> np.ndarray:
        """Bytes of normalised text that each piece stands for; byte pieces and the unknown piece: 0."""
        names, kinds, _, _ = self._read
        return np.where(np.isin(kinds, (NORMAL, USER, UNUSED)), [len(n) for n in names], 0)

    def _spans(self, clean: str, ids: np.ndarray) -> np.ndarray:
        """Bytes of the normalised text that each piece stands for: of a spelled character the last byte has them all."""
        names, kinds, _, _ = self._read
        lengths = self._lengths[ids]
        if lengths.all():
            return lengths
        kind = kinds[ids]
        if (kind == UNKNOWN).any():
            return np.array([len(p.encode()) for p in self._model.encode(clean, out_type=str, num_threads=1)])
        at = np.flatnonzero(kind == BYTE)
        values = self._values[ids[at]]
        starts = values & 0xC0 != 0x80
        last = np.append(starts[1:], True)
        width = np.where(values < 0x80, 1, np.where(values < 0xE0, 2, np.where(values < 0xF0, 3, 4)))
        lengths[at[last]] = width[starts]
        return lengths

    @cached_property
    def _values(self) -> np.ndarray:
        """The byte that each byte piece stands for, 0 for others."""
        names, kinds, _, _ = self._read
        return np.array([int(n[3:5], 16) if k == BYTE else 0 for n, k in zip(names, kinds.tolist())])

    @cached_property
    def _remembered(self) -> dict[str, bytes]:
        return {}

    def _ids(self, clean: str) -> np.ndarray:
        if not self.cuts:
            return np.array(self._model.encode(clean, num_threads=1), np.int32)
        words, known = _STARTS.split(clean), self._remembered
        if missing := [w for w in dict.fromkeys(words) if w not in known]:
            if len(known) + len(missing) > REMEMBERED:
                known.clear()
                missing = list(dict.fromkeys(words))
            for word, ids in zip(missing, self._model.encode(missing, num_threads=1)):
                known[word] = array("I", ids).tobytes()
        raw = b"".join(map(known.__getitem__, words))
        for word in missing:
            if len(word) > LONGEST:
                del known[word]
        return np.frombuffer(raw, np.int32)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and begins and ends of their spans in the text's UTF-8 bytes."""
        clean, origin = self.normaliser.apply(text)
        ids = self._ids(clean) if clean else np.zeros(0, np.int32)
        lengths = self._spans(clean, ids)
        ends = np.cumsum(lengths)
        begins, ends = origin[ends - lengths], origin[ends]
        if self.end:
            last = np.full(1, len(text.encode()), np.int32)
            ids, begins, ends = np.append(ids, np.int32(self._whole.eos_id())), np.append(begins, last), np.append(ends, last)
        return ids, begins, ends

    @cached_property
    def _bytes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All entries' decoded bytes, each entry's start and length."""
        names, kinds, trainer, _ = self._read
        unknown = trainer.get(44, " ⁇ ".encode())
        sign = SPACE.encode()
        by_kind = {UNKNOWN: lambda n: unknown, CONTROL: lambda n: b"", BYTE: lambda n: bytes([int(n[3:5], 16)])}
        raw = [by_kind.get(k, lambda n: n.replace(sign, b" "))(n) for n, k in zip(names, kinds.tolist())]
        lengths = np.array([len(x) for x in raw], np.int64)
        return np.frombuffer(b"".join(raw), np.uint8), np.cumsum(lengths) - lengths, lengths

    def decode(self, ids: np.ndarray) -> str:
        raw, starts, lengths = self._bytes
        names, kinds, _, spec = self._read
        if len(ids) and (ids.min() < 0 or ids.max() >= len(lengths)):
            raise ValueError("id outside the vocabulary")
        size = lengths[ids]
        ends = np.cumsum(size)
        at = np.repeat(starts[ids] - (ends - size), size)
        at += np.arange(len(at))
        try:
            text = raw[at].tobytes().decode()
        except UnicodeDecodeError:
            return self._whole.decode(ids.tolist())
        first = next((int(i) for i in ids if kinds[i] != CONTROL), None)
        added = spec.get(3, 1) or spec.get(4, 1)
        if first is not None and added and kinds[first] in (NORMAL, USER, UNUSED) and names[first].startswith(SPACE.encode()):
            return self._whole.decode(ids.tolist()) if spec.get(4, 1) else text[1:]
        return text


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    values = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))


def encode_documents(documents: DataFrame, codec: Codec) -> DataFrame:
    """(doc_id, ids, begins, ends) for each row of ``documents``: piece i stands for bytes [begins[i], ends[i])."""
    shared = prepare(documents.sparkSession).sparkContext.broadcast(codec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value.encode
        for batch in batches:
            for part in slices(batch):
                columns = zip(*map(of, texts_of(part))) if len(part) else ([], [], [])
                yield pa.record_batch([part.column("doc_id"), *(_lists(list(c)) for c in columns)], ["doc_id", "ids", "begins", "ends"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, ids array<int>, begins array<int>, ends array<int>")


def decode_documents(encoded: DataFrame, codec: Codec) -> DataFrame:
    """The columns of ``encoded`` and ``decoded``, the text that ``ids`` stand for; null ids stand for none."""
    shared = prepare(encoded.sparkSession).sparkContext.broadcast(codec)
    names = [c for c in encoded.columns if c != "decoded"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.select(*names).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value
        for batch in batches:
            for part in _decodable(batch):
                lists = part.column("ids").fill_null([]) if part.column("ids").null_count else part.column("ids")
                values, at = lists.flatten().to_numpy(zero_copy_only=False), 0
                texts = []
                for n in np.diff(lists.offsets.to_numpy()).tolist():
                    texts.append(codec.decode(values[at : at + n]))
                    at += n
                yield pa.record_batch([*part.columns, pa.array(texts, pa.string())], [*names, "decoded"])

    return encoded.select(*names).mapInArrow(run, f"{kinds}, decoded string")


def digests(documents: DataFrame, codec: Codec) -> DataFrame:
    """Encode and decode each document: (doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes); n_bytes is where the
    last piece ends in the text's UTF-8."""
    placed = encode_documents(documents, codec).select("doc_id", "ids", F.element_at("ends", -1).cast("long").alias("n_bytes"))
    return decode_documents(placed, codec).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        "n_bytes",
    )
