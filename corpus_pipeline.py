"""A training corpus from raw documents: five stages, each written and read again.

`STAGES` lists (name, function); a function takes (spark, docs, sf_dir) and
returns what it keeps of `docs`, with the columns of `documents` but for the
last stage, which returns token counts and digests. `run` applies them all.

Defined results: a null, empty or letterless text is rejected by the first
stage; a later document that loses all its text to line dedup goes; of a class
of near copies the smallest id stays, rows with equal ids share their fate,
and a row without an id stays; columns besides those of documents are dropped,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandflow.llm import bpe, jaccard_join, langid, linededup, mixing
from bandflow.llm.common import delete, shared_dir, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Pooled probability below which no language is believed.
LEAST_SCORE = 0.3

#: The language network, the alignment, the sketches and the sampling hash have no SQL form; tests hold `run` against brute force.
ORACLE_SQL = None


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter or without a believable language."""
    net = langid.learn(docs)
    scored = langid.predictions(docs, net, docs.columns)
    return scored.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes aligned common blocks of lines from later documents; documents left without text go."""
    out = linededup.dedup_lines(docs)
    return out.where((F.col("n_lines_cut") == 0) | (F.trim("text") != "")).select(*COLUMNS)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each class at five words and similarity 0.8."""
    return jaccard_join.deduplicate(docs).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws documents by probabilities raked to source, language and topic."""
    return mixing.mix(docs).where("drawn").select(*COLUMNS)


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text."""
    return bpe.digests(docs)


STAGES = [
    ("language ID", by_language),
    ("line dedup", without_repeated_lines),
    ("n-gram Jaccard join", without_near_copies),
    ("mixing to target weights", mixed),
    ("BPE encoding", tokenised),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`, each written to the shared folder and read back; only the last one's rows stay there."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}")
        if i:
            delete(spark, f"{base}/{i - 1}")
        docs = spark.read.parquet(f"{base}/{i}")
    return docs
