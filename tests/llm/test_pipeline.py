"""The pipeline against a version by hand on the smallest tables."""

import re

import corpus_pipeline
import public_tokenizers
from test_documents import _linked_by_hand, _pii_by_hand

from phasewell.llm import quality, toxicity


def test_stages(spark, small, tmp_path):
    read = spark.read.parquet
    docs, labels = read(f"{small}/documents.parquet"), read(f"{small}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "minhash_dedup", "pii", "packing"]
    kept = []
    at = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, at, small).write.parquet(f"{tmp_path}/{name}")
        at = read(f"{tmp_path}/{name}")
        if name != "packing":
            assert sorted(at.columns) == sorted(docs.columns)
            kept.append({r["doc_id"]: r["text"] or "" for r in at.collect()})
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}

    lexicon = toxicity.learn(docs, labels)
    rejected = {r["doc_id"] for r in toxicity.score(docs, lexicon).collect() if r["score"] >= 0.3}
    assert kept[0] == {i: t for i, t in text.items() if i not in rejected}
    model = quality.learn(docs, labels)
    scores = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    assert kept[1].keys() == {i for i in kept[0] if scores[i] >= 0.3}
    linked = _linked_by_hand(sorted(kept[1].items()), 80)
    assert kept[2] == {i: t for i, t in kept[1].items() if linked[i][1] == i}
    assert kept[3].keys() == kept[2].keys()
    for i, t in kept[2].items():
        spans = _pii_by_hand(t)
        if not spans:
            assert kept[3][i] == t
        assert not any(t[a:b] in kept[3][i] for a, _, b, _ in spans)
        assert len(re.findall(r"\[(?:EMAIL|IP|CARD|PHONE)\]", kept[3][i])) <= len(spans)

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    tokens = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in kept[3].items()}
    pieces = at.collect()
    assert {r["doc_id"]: r["doc_tokens"] for r in pieces} == tokens
    assert sum(r["length"] for r in pieces) == sum(tokens.values())
    assert corpus_pipeline.run(spark, small).count() == len(pieces)


def test_stages_after_the_first_run_without_the_table_of_documents(spark, small, tmp_path):
    gone = tmp_path / "tables"
    gone.mkdir()
    (gone / "labels.parquet").symlink_to(f"{small}/labels.parquet")
    first = spark.read.parquet(f"{small}/documents.parquet")
    corpus_pipeline.STAGES[0][1](spark, first, small).write.parquet(f"{tmp_path}/kept")
    kept = spark.read.parquet(f"{tmp_path}/kept")
    whole = {r["doc_id"] for r in corpus_pipeline.keep_quality(spark, kept, str(gone)).collect()}
    scores = {r["doc_id"]: r["score"] for r in quality.score(kept, quality.learn(kept, spark.read.parquet(f"{small}/labels.parquet"))).collect()}
    assert whole == {i for i, s in scores.items() if s >= 0.3}
