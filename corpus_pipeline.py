"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns a
DataFrame that is written as Parquet and read again as the docs of the next one. All but the last
return the columns of documents, whatever further columns there are. Empty tables give empty results;
texts are treated whole, whatever their length.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm import packing, quality, secret_scan, simhash, toxicity
from basketry.llm.common import fresh_path, table, unused
from basketry.llm.queries import held_out


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the model's cut, which is chosen for recall on rows that the counts did not come from.

    Null and empty texts have the score of no evidence and stay; without labels of both classes all stay.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), held_out=held_out("label_id"))
    score = unused(docs, "score")
    return toxicity.scores(docs, model, name=score).where(F.col(score) < model.cut).drop(score)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; null and empty texts have no words and go."""
    verdict = unused(docs, "quality")
    return quality.judge(docs, name=verdict).where(F.col(verdict)["kept"]).drop(verdict)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the least id; of equal rows, null and empty texts too, one stays."""
    return simhash.keep_one_of_each(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, repeated rows too, with the secrets in them masked; null texts stay null."""
    return secret_scan.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences; a null or empty text is one piece of the id 0 alone."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_poor),
    ("near-duplicates", drop_copies),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]
#: SQL cannot express the trained, hashed and tokenised stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = fresh_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
