"""A corpus pipeline of five stages: each takes what its predecessor kept, and its decisions take effect.

Stages read the labels where they learn, and learn from the documents that they are given: the table of documents may be
gone once the first stage is written. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from phasewell.llm import minhash, packing, pii, quality, toxicity
from phasewell.llm.common import prepare, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity lexicon rejects go."""
    prepare(spark)
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, lexicon)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    prepare(spark)
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    prepare(spark)
    return minhash.keep_first(docs)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, and terms that disclose it, are replaced."""
    prepare(spark)
    return pii.sanitise(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, each with its ids, its sequence and its offset there."""
    prepare(spark)
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        return packing.pack_documents(docs, file.read(), with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality", keep_quality),
    ("minhash_dedup", drop_near_duplicates),
    ("pii", sanitise),
    ("packing", pack),
]

#: SQL can't express these stages.
ORACLE_SQL = None


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again by the next.

    A stage's folder is removed once the next one is written; that of the last but one stays for the result.
    """
    prepare(spark)
    docs, before = table(spark, sf_dir, "documents"), None
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            _remove(spark, f"{folder}/{before}")
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
