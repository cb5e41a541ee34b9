"""From documents to training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs.
All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import read, written
from quarry.llm.jaccard import jaccard_join
from quarry.llm.mixing import mix_sources
from quarry.llm.packing import pack
from quarry.llm.quality import keep_good
from quarry.llm.substrings import substring_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; labels without documents and documents without labels are no matter."""
    return keep_good(docs.select(*COLUMNS), read(spark, sf_dir, "labels"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of near copies stays. Rows equal in id and text are one document and stay once;
    different texts under one id stay or go together, as rows are told apart by id alone."""
    if docs.groupBy("doc_id").count().filter("count > 1").limit(1).count():
        docs = docs.dropDuplicates(["doc_id", "text"])
    stays = jaccard_join(docs).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_id")).distinct()
    return docs.select(*COLUMNS).join(stays, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")


def substring_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that start earlier in the corpus go; the others are joined by one space.
    A document of which no word is left stays with an empty text, as does a null one."""
    out = substring_dedup(docs, carry=("lang", "source"))
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of documents by the calibrated probabilities of their cells; rows of one id are drawn alike."""
    return mix_sources(docs.select(*COLUMNS)).filter("kept").select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of 1024 tokens; an empty text is its end token."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), added=True)


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("substring dedup", substring_removal),
    ("mixing sources to target weights", source_mixing),
    ("best-fit packing", best_fit_packing),
]
ORACLE_SQL = None  # the classifier and the token ids have no form in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
