"""A corpus from raw documents to token ids: each stage works on all that the one before it kept.

``STAGES`` are (name, function); a function takes (spark, docs, sf_dir). ``run`` applies them in order and keeps each
stage's rows as files, so that no stage is computed twice. All but the last return the columns of documents.
``ORACLE_SQL`` is None: the classifier, the surrogates and the vocabulary cannot be expressed in SQL; tests/llm holds
``run`` against a version of the stages that goes through rows one by one.

Null and empty texts have the classifier's intercept as score, no words, no personal data, size 0 and no tokens; those
that stay are taken once. Null ids and rows that share an id are documents like others; of documents that are near
duplicates of each other, rows that repeat one included, one stays. Null sources are one source. Ties go as the
operators state. Texts are read whole, however long. Empty tables give no rows, and without labels every score is
0.5, so that all documents stay. Columns beyond those of documents are dropped by the first stage, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import bpe, mixing, pii, quality_model, simhash
from quern.llm.common import remainder, table
from quern.llm.queries import SURROGATE_KEY
from quern.sources.tables import new_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    labels = table(spark, sf_dir, "labels").filter(remainder(F.col("doc_id"), 5) != 0)
    return quality_model.classify(docs, labels).filter("predicted = 1").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return simhash.keep_one(docs).select(*COLUMNS)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gets surrogates; the length follows."""
    out = pii.checked(docs, SURROGATE_KEY)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.repeat_rows(mixing.mix(docs)).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and the digests of the ids and of the text that they decode to, in one pass over the texts."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = bpe.round_trip(docs.select("doc_id", "source", "text"), ranks, public_tokenizers.PATTERN, ids="ids")
    return out.select("doc_id", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("PII surrogates", replace_personal_data),
    ("source mix", mix_sources),
    ("byte-level BPE", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage before it is written as Parquet to the shared folder and read again."""
    docs, folder = table(spark, sf_dir, "documents"), new_folder(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return STAGES[-1][1](spark, docs, sf_dir)
