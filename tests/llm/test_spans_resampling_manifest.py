"""Sentencepiece spans against the library, importance weights and Merkle proofs against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from phasewell.llm import common, manifest, pieces, queries, resample
from phasewell.llm.bpe import _field


def _model() -> bytes:
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        return file.read()


def _variant(rule: str = "identity", prefix: int = 1, extra: int = 0, symbols: tuple = (), fallback: bool = True) -> bytes:
    """The model with another normaliser, added symbols, or without byte pieces."""
    spec = dict(pieces.fields(dict(pieces.fields(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()))[3]))
    out = b""
    for number, value in pieces.fields(_model()):
        if number == 1 and (fallback or dict(pieces.fields(value)).get(3) != pieces.BYTE):
            out += _field(1, value)
        elif number == 2:  # without the fixed-width fields, which the writer takes for bytes
            out += _field(2, b"".join(_field(n, v if n != 35 or fallback else 0) for n, v in pieces.fields(value) if n not in (10, 15, 51)))
    for symbol in symbols:
        out += _field(1, _field(1, symbol.encode()) + _field(2, 0.0) + _field(3, pieces.USER))
    return out + _field(3, _field(1, b"x") + _field(2, spec.get(2, b"")) + _field(3, prefix) + _field(4, extra) + _field(5, 1))


SIGNS = [*"ab cd  e.,\n\t▁é日😀<>0Ⅳﬁ½ ͏̈ｱﾞ①㌀​　\u0000", "a\u0301", "<0x41>", "</s>", "<unk>", "가", "zq", "▁▁d", "Ⅳﬁ"]


def _random_texts(n: int) -> list[str]:
    rng = random.Random(1)
    return ["", " ", "   ", "▁", "¨", "  ¨ x", " a "] + ["".join(rng.choices(SIGNS, k=rng.randint(0, 25))) for _ in range(n)]


@pytest.mark.parametrize(
    "options",
    [{}, {"rule": "nmt_nfkc", "extra": 1}, {"rule": "nfkc", "prefix": 0, "symbols": ("zq", "▁▁d", "Ⅳﬁ")},
     {"rule": "nmt_nfkc_cf", "extra": 1, "symbols": ("zq", "▁▁d")}, {"extra": 1, "prefix": 0}, {"fallback": False}],
)
def test_ids_and_spans_are_the_librarys(options):
    raw = _variant(**options)
    mine, library = pieces.Codec(raw, end=False), sentencepiece.SentencePieceProcessor(model_proto=raw)
    for text in _random_texts(1500):
        ids, begins, ends = (x.tolist() for x in mine.encode(text))
        told = library.encode(text, return_type="proto").pieces
        assert list(zip(ids, begins, ends)) == [(p.id, p.begin, p.end) for p in told], text
        assert mine.decode(np.array(ids, np.int64)) == library.decode(ids)


def test_decoding_any_ids():
    codec, library = pieces.Codec(_model()), sentencepiece.SentencePieceProcessor(model_proto=_model())
    rng = np.random.default_rng(3)
    for _ in range(300):
        ids = rng.integers(0, rng.choice([300, 32000]), rng.integers(0, 8))
        assert codec.decode(ids) == library.decode(ids.tolist())
    with pytest.raises(ValueError):
        codec.decode(np.array([32000]))


def test_a_character_map_is_read_whole():
    spec = dict(pieces.fields(dict(pieces.fields(sentencepiece.SentencePieceNormalizer(rule_name="nfkc").serialized_model_proto()))[3]))
    read = pieces.character_map(spec[2])
    assert len(read) > 10_000 and read["Ⅳ"] == "IV" and read["e\u0301"] == "\u00e9" and pieces.character_map(b"") == {}


ODD = [(1, None), (2, ""), (3, "plain words, plain words"), (3, "plain words, plain words"), (None, "é日😀\u0000 x"), (5, "ab " * 60_000), (6, "x" * 5_000)]


def test_op11_on_odd_rows(spark, tmp_path):
    rows = spark.createDataFrame([(i, t, "x") for i, t in ODD], "doc_id long, text string, ids string")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    library = sentencepiece.SentencePieceProcessor(model_proto=_model())
    expected = Counter()
    for i, text in ODD:
        ids = [*library.encode(text or ""), library.eos_id()]
        shas = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), library.decode(ids))]
        expected[(i, len(ids), *shas, len((text or "").encode()))] += 1
    got = queries.op11_sentencepiece_spans(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes")
    assert Counter(map(tuple, got.collect())) == expected
    codec = pieces.Codec(_model())
    assert pieces.digests(rows.where("doc_id > 99"), codec).count() == 0
    spans = pieces.encode_documents(rows.where("doc_id = 3"), codec).first()
    text = ODD[2][1].encode()
    assert b"".join(text[b:e] for b, e in zip(spans["begins"], spans["ends"])) == text


def _resampled_by_hand(documents, target, buckets=10_000, percent=25, least=20, seed=7):
    def runs(text):
        words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
        return len(words), [zlib.crc32(x) % buckets for x in words + [a + b" " + b for a, b in zip(words, words[1:])]]

    held, s, t = [(i, *runs(x)) for i, x in documents], Counter(), Counter()
    for _, _, f in held:
        s.update(f)
    for text in target:
        t.update(runs(text)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    rows = []
    for i, n, f in held:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    may = sorted((-r[3], r[0] is None, r[0] or 0, r[1], r[2]) for r in rows if r[4] >= least)
    return sorted(((-a, c, d, e) for a, _, c, d, e in may[: percent * len(may) // 100]), reverse=True), Counter(r[:4] for r in rows)


def test_resampling_by_hand(spark, monkeypatch):
    """Hot repeats, ties, nulls, texts without words, runs over the borders of a long text's parts."""
    monkeypatch.setattr(resample, "PART", 37)
    rng = random.Random(5)
    words = ["Alpha", "beta", "gamma", "d9", "É", "日本", "x"]
    held = [(i, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(200)]
    held += [(7, "Alpha beta " * 15)] * 90 + [(None, "beta x " * 12)] * 3 + [(300, None), (301, "  --  "), (302, "")]
    target = ["alpha BETA gamma", None, "x x x", ""]
    documents = spark.createDataFrame([(i, t, 0, 0) for i, t in held], "doc_id long, text string, rank int, score int").repartition(5)
    benchmark = spark.createDataFrame(list(enumerate(target)), "item_id long, text string")
    drawn, rows = _resampled_by_hand(held, target)
    got = resample.resample(documents, benchmark, "item_id").collect()
    assert Counter((r["doc_id"], r["n_features"], r["weight"], r["score"]) for r in got) == rows
    ranked = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
    assert sorted(((r["score"], r["doc_id"] or 0, r["n_features"], r["weight"]) for r in ranked), reverse=True) == drawn
    order = [(-r["score"], r["doc_id"] is None, r["doc_id"] or 0) for r in ranked]
    assert order == sorted(order)
    assert resample.resample(documents.limit(0), benchmark.limit(0), "item_id").collect() == []
    with pytest.raises(ValueError):
        resample.resample(documents, benchmark, "item_id", buckets=1 << 17)


def test_features_of_longer_runs(monkeypatch):
    for part in (5, 1 << 20):
        monkeypatch.setattr(resample, "PART", part)
        n, found = resample.features(b"a bb ccc a bb", 60_000, longest=3)
        runs = [b"a", b"bb", b"ccc", b"a", b"bb", b"a bb", b"bb ccc", b"ccc a", b"a bb", b"a bb ccc", b"bb ccc a", b"ccc a bb"]
        assert n == 5 and sorted(found.tolist()) == sorted(zlib.crc32(r) % 60_000 for r in runs)


def _h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _climb(nodes: list[str], fanout: int) -> tuple[str, list[list[str]]]:
    """The root and each node's siblings level by level."""
    at, found = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for k, i in enumerate(at):
            begin = i // fanout * fanout
            found[k].append((i - begin, [n for j, n in enumerate(nodes[begin : begin + fanout]) if j != i - begin]))
        nodes, at = [_h(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)], [i // fanout for i in at]
    return nodes[0], found


def _manifest_by_hand(rows, fanout):
    def leaf(row):
        return _h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    trees = {}
    for row in rows:  # doc_id, source, lang, n_chars, text
        trees.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, leaf(row), row))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    low = {s: (sorted(trees[s], key=lambda r: r[:3]), *_climb([r[2] for r in sorted(trees[s], key=lambda r: r[:3])], fanout)) for s in order}
    root, high = _climb([low[s][1] for s in order], fanout)
    out = Counter()
    for s, above in zip(order, high):
        held, subroot, proofs = low[s]
        for (_, _, own, row), below in zip(held, proofs):
            other = own
            if zlib.crc32(("" if row[0] is None else str(row[0])).encode()) % 5 == 0:
                other = leaf((*row[:4], row[4] and re.sub("[A-Z]", lambda m: m[0].lower(), row[4])))
            for turn, others in below + above:
                other = _h(*others[:turn], other, *others[turn:])
            siblings = "".join("".join(others) for _, others in below + above)
            out[(row[0], own, subroot, root, _h(siblings), other, other == root)] += 1
    return out


@pytest.mark.parametrize("fanout,levels", [(16, 3), (2, 1), (3, 2)])
def test_manifest_by_hand(spark, fanout, levels):
    """A hot source, sources of every size, null sources and ids, equal rows, more ranges than rows of a source."""
    rng = random.Random(2)
    rows = [(i, "hot", "en", i, f"Text {i}") for i in rng.sample(range(10_000), 100)]
    for size in (1, 2, 3, 4, 8, 9, 16, 17, 27, 28):
        rows += [(i, f"s{size}é", None, None, rng.choice(["ABC", "abc", "", None])) for i in range(size)]
    rows += [(None, "hot", None, 1, None), (None, None, None, None, None), (4, None, "x", 2, "É")] + [(77, "hot", "en", 5, "Same")] * 40
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string").repartition(7)
    leaves = manifest.document_leaves(df)
    proofs = manifest.manifest(leaves, "source", [F.col("doc_id").asc_nulls_first(), F.col("leaf")], fanout, levels)
    led = proofs.withColumn("folded", manifest.folded(F.coalesce("tampered", "leaf"), "turns", "sizes", "siblings"))
    got = Counter(
        (r["doc_id"], r["leaf"].hex(), r["subroot"].hex(), r["root"].hex(), _h(r["siblings"].hex()), r["folded"].hex(), r["folded"] == r["root"]) for r in led.collect()
    )
    assert got == _manifest_by_hand(rows, fanout)


def test_manifest_of_few_rows(spark):
    rows = [(3, "a", "en", 1, "One")]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = [tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in manifest.digests(df).collect()]
    assert Counter(got) == _manifest_by_hand(rows, 16)
    assert manifest.digests(df.limit(0)).collect() == []


def test_order_over_ranges(spark):
    """Places are 0 to n - 1 in order, with a key that nearly all rows share."""
    df = spark.createDataFrame([(1 if i % 10 else i, i) for i in range(500)], "k long, v long").repartition(6)
    got = sorted((r["place"], r["k"]) for r in common.in_order(df, [F.col("k")], "place").collect())
    assert [p for p, _ in got] == list(range(500)) and [k for _, k in got] == sorted(k for _, k in got)
    parts = common.in_parts(df, [F.col("k")]).groupBy("_part").count().collect()
    assert max(r["count"] for r in parts) < 300


def test_new_operators_against_sql(spark, small, same):
    for name in ("op12_importance_resampling", "op13_merkle_manifest"):
        same(queries.QUERIES[name](spark, small), queries.ORACLE_SQL[name], small)
