"""Packing by a plain call of the tokenizer, hot lengths, very long texts, and disclosing terms against brute force."""

import hashlib
import json
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import regex
from test_documents import _joined, _pii_by_hand
from tokenizers import Tokenizer

from phasewell.llm import bpe, chunks, packing, pii, queries


def _json():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        return file.read()


ADDED = ["a <|endoftext|> b", "<|endoftext|>", " <|endoftext|><|endoftext|>  x\n<|endoftext|> y", "<|endoftext", None, "plain words", "é<|endoftext|>"]


def test_added_tokens_as_the_plain_call_has_them(spark, tmp_path):
    spark.createDataFrame(list(enumerate(ADDED)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    tokenizer = Tokenizer.from_str(_json())
    got = {r["doc_id"]: r for r in queries.op5_histogram_packing(spark, str(tmp_path)).collect()}
    for i, text in enumerate(ADDED):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        assert got[i]["doc_tokens"] == len(ids) and got[i]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
    assert 50256 in tokenizer.encode(ADDED[0], add_special_tokens=False).ids


def test_added_tokens_with_options_go_to_the_tokenizer():
    changed = json.loads(_json())
    changed["added_tokens"][0]["lstrip"] = True
    text, changed = "a   <|endoftext|> b", json.dumps(changed)
    ids = Tokenizer.from_str(changed).encode(text, add_special_tokens=False).ids
    assert packing._encoder(changed, True)(text) == np.array(ids, "<u4").tobytes()


def test_parts_that_occur_once_take_no_room(monkeypatch):
    """In a large corpus most different parts are such; those that come again, with signs or without, are remembered."""
    monkeypatch.setattr(chunks, "REMEMBERED_SIGNS", 20, raising=False)
    made: list[str] = []
    remembered = chunks.Remembered(lambda part: (made.append(part), part.encode())[1])
    chunks.encode("start " + " ".join(f"{i}th" for i in range(100_000)), remembered)
    assert len(remembered) < 10_000
    for _ in range(3):
        chunks.encode("start again and again, and again!! again.", remembered)
    assert made.count(" again") == 2 and {"again", "again,", "again!!"} <= remembered.keys()
    chunks.encode("start " + " ".join("again" + "!" * i for i in range(100)), remembered)
    assert len(remembered.signs) <= 20


def test_runs_of_signs_after_words(monkeypatch):
    """Every sign, alone and in runs, after letters of several scripts, digits and nothing, and at the bounds of the memory."""
    monkeypatch.setattr(chunks, "REMEMBERED", 50)
    signs = [*map(chr, range(0x21, 0x30)), *":;<=>?@[\\]^_`{|}~", "$$$", "#%&", "'s!", "!'s", "''", "_x_", "!\u00a0", "\u2026", "!\u0301"]
    text = " ".join(f"{word}{sign}" for _ in range(3) for sign in signs for word in ("word", "\u00e9t\u00e9", "\u0436\u0443\u043a", "\u01c5", "12", "", "a1"))
    tokenizer = Tokenizer.from_str(_json())
    assert packing._encoder(_json(), False)(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    plain = bpe.Codec(ranks, public_tokenizers.PATTERN)
    split = regex.compile(public_tokenizers.PATTERN).findall(text)
    assert plain.encode(text) == b"".join(plain._remembered.plain(token) for token in split)


def test_packed_ids_are_the_documents(spark, monkeypatch):
    """Ids travel with the pieces; a length that most documents share is ranked in several groups."""
    monkeypatch.setattr(packing, "SALTED", 7)
    texts = ["same four plain words"] * 300 + [f"text {i} " * (i % 400) for i in range(90)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    tokenizer = Tokenizer.from_str(_json())
    rows = packing.pack_documents(df, _json(), most=64, with_ids=True).collect()
    parts, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert len(r["ids"]) == r["length"] and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
        parts[r["doc_id"]].append((r["start"], r["ids"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, text in enumerate(texts):
        assert sum((ids for _, ids in sorted(parts[i])), []) == [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
    for held in sequences.values():
        ends = np.cumsum([n for _, n in sorted(held)])
        assert [o for o, _ in sorted(held)] == [0, *ends[:-1]] and ends[-1] <= 64
    assert sorted(sequences) == list(range(len(sequences)))


def test_texts_longer_than_a_slice(spark):
    """Over 4 MiB in one row, beside short and null ones."""
    long = "words of a very long text, 12 of them. " * 140_000
    df = spark.createDataFrame([(0, long), (1, "short"), (2, None)], "doc_id long, text string")
    assert len(long) > 5 << 20
    codec = bpe.Codec(bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)
    got = {r["doc_id"]: r for r in bpe.digests(df, codec).collect()}
    assert got[0]["decoded_sha256"] == hashlib.sha256(long.encode()).hexdigest() and got[2]["n_tokens"] == 0
    rows = packing.pack_documents(df, _json(), added=True).collect()
    lengths = [r["length"] for r in rows if r["doc_id"] == 0]
    assert sum(lengths) == rows[0]["doc_tokens"] or sum(lengths) == max(r["doc_tokens"] for r in rows)
    assert sorted(lengths, reverse=True)[:-1] == [2048] * (len(lengths) - 1)


TERM = regex.compile(r"\p{L}[\p{L}\p{Nd}_]{3,}")


def _spans_by_hand(text):
    return [(a, b, k, re.sub("[^0-9]", "", text[a:b]) if k in (2, 3) else text[a:b].lower()) for a, k, b, _ in _pii_by_hand(text)]


def _terms_by_hand(text, spans):
    """(start, end, term) of the words that no base span touches."""
    return [(*m.span(), m[0].lower()) for m in TERM.finditer(text) if not any(a <= m.end() and m.start() <= b for a, b, _, _ in spans)]


def _added_by_hand(docs):
    """The disclosing terms of texts that are no near copies, straight from the rule."""
    spans, terms = {i: _spans_by_hand(t) for i, t in docs.items()}, {}
    holding, near, pool_near, members = defaultdict(set), defaultdict(set), defaultdict(set), defaultdict(set)
    for i, text in docs.items():
        terms[i] = _terms_by_hand(text, spans[i])
        for _, _, k, v in spans[i]:
            holding[k, v].add(i)
    pooled = {e for e, d in holding.items() if len(d) < 3}
    for i, text in docs.items():
        for a, b, k, v in spans[i]:
            low, high = max(0, a - 60), min(len(text), b + 60)
            for s, e, t in terms[i]:
                if low <= s and e <= high:
                    near[(k, v), t].add((text[low:a], text[b:high]))
                    if (k, v) in pooled:
                        pool_near[k, t].add((text[low:a], text[b:high]))
                        members[k, t].add(((k, v), i))
    n_term = defaultdict(int)
    for text in docs.values():
        for t in {m[0].lower() for m in TERM.finditer(text)}:
            n_term[t] += 1
    told, n = defaultdict(set), len(docs)

    def judge(t, both, held):
        if (information := math.log2(n / len(held))) > 0 and math.log2(n * both / (len(held) * n_term[t])) >= 0.75 * information:
            for i in held:
                told[i].add(t)

    for e, held in holding.items():
        c = Counter(t for i in held for t in {x[2] for x in terms[i]})
        for t, both in c.items():
            if len(held) >= 2 and both >= min(len(held), 3) or len(near[e, t]) >= 3:
                judge(t, both, held)
    for (k, t), contexts in pool_near.items():
        if len(contexts) >= 3 and len({e for e, _ in members[k, t]}) >= 3:
            judge(t, len({i for _, i in members[k, t]}), {i for e in pooled if e[0] == k for i in holding[e]})
    return {i: [(a, b) for a, b, t in terms[i] if t in told[i]] for i in docs}


def test_disclosing_terms_equal_brute_force(spark):
    rng = np.random.default_rng(21)
    vocabulary = ["".join(rng.choice(list("abcdefghijé"), 6)) for _ in range(500)]
    docs = {}
    for i in range(160):
        words = rng.choice(vocabulary, 60).tolist()
        if i < 60:  # entities of one to five texts, with words of their own near and far
            who = i % 18
            value = [f"ann{who}@mail.com", f"10.0.{who}.1", f"+1 234 555 10{who:02d}"][who % 3]
            words[rng.integers(60)] = f"Secretword{who}x"
            words.insert(int(rng.integers(55)), f"Kindword{who % 3} {value} ,")
        if i % 7 == 0:
            words.insert(30, f"bob{i}@other.org\U0001f600 Quuxline")
        docs[i] = " ".join(words)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.digests(df).collect()}
    wanted = _added_by_hand(docs)
    added = {i: [(int(a), int(b)) for k, a, b in (s.split(":") for s in filter(None, got[i].split(","))) if k == "term"] for i in docs}
    assert added == wanted and sum(map(len, wanted.values())) > 60
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    for i, text in docs.items():
        for a, b in wanted[i]:
            assert text[a:b] not in clean[i]


def test_personal_data_in_a_long_text(spark):
    """Over 4 MiB and 4,000 matches in one row: many blocks of text and of matches, signs outside the basic plane."""
    words = "some plain words " * 250
    part = f"\U0001f600 ask ann@mail.com or 10.0.0.1, +1 234 555 1000 then 4111 1111 1111 1111 and {words}; "
    text, few = part * 1_000 + "tail", part * 20
    df = spark.createDataFrame([(0, text), (1, few), (2, None), (3, "x" * 9_000 + "@" + "y.z")], "doc_id long, text string")
    assert len(text.encode()) > 4 << 20
    got = {r["doc_id"]: r for r in pii.digests(df).collect()}
    for i, t in ((0, text), (1, few)):
        assert got[i]["base_sha256"] == hashlib.sha256(_joined(_pii_by_hand(t)).encode()).hexdigest()
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    marked = f"\U0001f600 ask [EMAIL] or [IP], [PHONE] then [CARD] and {words}; "
    assert clean[0] == marked * 1_000 + "tail" and clean[1] == marked * 20 and clean[2] is None and clean[3] == "[EMAIL]"


def test_spans_that_overlap_are_replaced_once(spark):
    texts = ["1.2.3.4111 1111 1111 1111 +4111 1111 1111", "a@1.2.3.4 +1.2.3.4.5678901", "+1 234 567 8901 234 5678 9012 3456"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    for i, text in enumerate(texts):
        out, at = "", 0
        marks = ["[EMAIL]", "[IP]", "[CARD]", "[PHONE]"]
        for a, b, mark in sorted((a, b, marks[k]) for a, k, b, _ in _pii_by_hand(text)):
            if a >= at:
                out += text[at:a] + mark
            at = max(at, b)
        assert clean[i] == out + text[at:]
